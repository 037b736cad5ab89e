"""Tables that a run writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session without it, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: its input is read once, however often it is used, and its size is known to later joins.

    A lost executor costs its tasks, not the work behind the table. Like checkpoint files, the table stays until the cluster clears that folder.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, table: str, column: str, buckets: int) -> DataFrame:
    """``df`` as a catalog table whose rows lie in ``buckets`` files by the hash of ``column``, sorted by it.

    Joins and aggregations on that column read the table without a shuffle. The table replaces one of the same name.
    """
    # Each task writes its own bucket, so there are as many files as buckets.
    df.repartition(buckets, column).write.mode("overwrite").format("parquet").bucketBy(buckets, column).sortBy(column).saveAsTable(table)
    return df.sparkSession.table(table)
