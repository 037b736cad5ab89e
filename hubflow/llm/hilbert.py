"""Sharding by a Hilbert curve over quantised metadata: each shard is a run of the curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import scaled, written

#: Rows that one task numbers, on average at most, when a cell of the grid is larger.
ROWS_PER_SLICE, LEAST_SLICES = 1_000_000, 64


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of the points in ``axes`` (one column per dimension, ``bits`` bits each).

    From the highest bit down, each step turns the frame of the sub-cube that the point lies in; the bits of the turned
    coordinates, read across dimensions and Gray-decoded, are the index.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> level) & 1)
    return index


def document_axes(bits: int) -> list[Column]:
    """Quantised metadata of documents: language, source, and the binary logarithm of the size."""
    top = 1 << bits
    name = lambda c: F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(top - 1)) + 1, F.lit(0))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return [F.when(F.col("lang").isNull(), 0).otherwise(name("lang")), F.when(F.col("source").isNull(), 0).otherwise(name("source")), F.least(F.floor(F.log2(size + 1)), F.lit(top - 1))]


def hilbert_shards(rows: DataFrame, axes: list[Column], shards: int, *, bits: int = 5, key: str = "doc_id") -> DataFrame:
    """Number rows along the curve and cut the order into ``shards`` runs whose row counts differ by at most one.

    Adds ``cell`` (curve index of the quantised axes), ``shard`` and ``slot`` (place in the shard, gapless from 0) to
    the columns of ``rows``, which should be slim: the text itself need not travel. Within a cell, rows stand in
    an order given by ``key`` alone; rows with equal keys and columns are interchangeable and each gets a slot.
    Null axes count as 0. Fewer rows than shards leave shards empty; an empty table gives no row.

    Only counts are gathered: per cell (at most 2 ** (bits * axes)) and slice. A cell with very many rows is cut into
    slices by its key, so no task numbers more than a slice.
    """
    grid = sum((F.shiftleft(a.cast("long"), bits * i) for i, a in enumerate(axes)), F.lit(0).cast("long"))
    slim = written(rows.withColumn("grid", grid), "hilbert-rows")
    n = slim.count()
    slices = scaled(n, ROWS_PER_SLICE, LEAST_SLICES)
    slim = slim.withColumn("slice", F.pmod(F.xxhash64(F.col(key)), F.lit(slices)))
    counts = slim.groupBy("grid", "slice").agg(F.count("*").alias("n"))
    width = len(axes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column("grid").to_numpy()
            points = np.stack([(g >> (bits * i)) & ((1 << bits) - 1) for i in range(width)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("grid"), pa.array(curve_index(points, bits)), batch.column("total")], ["grid", "cell", "total"])

    cells = counts.groupBy("grid").agg(F.sum("n").alias("total")).mapInArrow(index, "grid long, cell long, total long")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One task orders the cells: a grid of fixed size, whatever the number of rows.
    cells = cells.withColumn("before", F.coalesce(F.sum("total").over(ahead(Window.orderBy("cell"))), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(ahead(Window.partitionBy("grid").orderBy("slice"))), F.lit(0))
    starts = counts.withColumn("inner", inner).join(cells, "grid").select("grid", "slice", "cell", (F.col("before") + F.col("inner")).alias("base"))
    order = Window.partitionBy("grid", "slice").orderBy(key, *[c for c in rows.columns if c != key])
    placed = slim.withColumn("nth", F.row_number().over(order) - 1).join(starts, ["grid", "slice"])
    place = F.col("base") + F.col("nth")
    shard = F.expr(f"(base + nth) * {shards}L div {n}L") if n else F.lit(0)
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", place - first).select(*rows.columns, "cell", "shard", "slot")


def write_shards(docs: DataFrame, axes: list[Column], path: str, shards: int, *, bits: int = 5, files_per_shard: int = 1) -> None:
    """Write documents, all columns, along the curve over ``axes`` (columns of ``docs``): a folder ``curve_shard=k`` per shard, in it
    files whose rows follow each other on the curve, so that a file carries narrow ranges of every axis and readers skip others.

    Rows are told apart by a number that is written with them, so rows without an id, or with the id of another, are
    rows of their own, and a hot id is spread. An empty table writes no row.
    """
    row = F.monotonically_increasing_id().alias("row")
    numbered = written(docs.select(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *[a.alias(f"axis{i}") for i, a in enumerate(axes)]), "hilbert-documents")
    slim = numbered.select("row", *[f"axis{i}" for i in range(len(axes))])
    placed = hilbert_shards(slim, [F.col(f"axis{i}") for i in range(len(axes))], shards, bits=bits, key="row").select("row", F.col("shard").alias("curve_shard"), "slot")
    ordered = numbered.join(placed, "row").repartitionByRange(shards * files_per_shard, "curve_shard", "slot").sortWithinPartitions("curve_shard", "slot")
    ordered.select("whole.*", "curve_shard").write.partitionBy("curve_shard").parquet(path)
