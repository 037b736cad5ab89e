"""Parcel-logistics analytics as compositions of Spark DataFrame operators."""
