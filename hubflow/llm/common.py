"""Shared helpers: the cluster's shared folder, and byte-level views of text columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once inside a task; a longer text is handled alone.
BLOCK_BYTES = 4 << 20
#: Whether Spark deletes the shuffle files of a query when it ends, and not only when the driver drops its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in a local session without it, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once.

    Like checkpoint files, such tables stay until the cluster clears that folder. The shuffle files behind the table are of no
    more use and are deleted; the session's own setting for that holds again afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def scaled(rows: int, per_partition: int, least: int) -> int:
    """Number of buckets for ``rows`` that keeps each near ``per_partition`` rows."""
    return max(least, -(-rows // per_partition))


class Block:
    """Texts ``first`` to ``last`` of a batch as one byte array; ``at[i]`` to ``at[i + 1]`` holds text i."""

    def __init__(self, first: int, last: int, data: np.ndarray, at: np.ndarray):
        self.first, self.last, self.data, self.at = first, last, data, at

    def __len__(self) -> int:
        return self.last - self.first

    def text(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of at most ``limit`` bytes (or one text). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield Block(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def flag_table(*spans: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true for bytes in the given inclusive spans."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(block: Block, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, never across texts, and the text that each belongs to."""
    n = len(block.data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = is_word[block.data]
    # A text boundary ends a run also where both its sides are word bytes.
    edge = np.zeros(n + 1, bool)
    edge[block.at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(block.at, starts, side="right") - 1
    return starts, ends, owner


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives 64-bit hashes of byte spans, from prefix sums of a polynomial; equal bytes hash alike anywhere."""
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))[: len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
    back = _powers(_INVERSE, len(data))

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (sums[ends] - sums[starts]) * back[np.minimum(starts, len(back) - 1)]
            return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def hashed_sample(rows: DataFrame, key: str, size: int, total: int, spare: str | None = None) -> DataFrame:
    """About ``size`` of ``total`` rows, chosen by a hash of ``key`` alone, or of ``spare`` where that is null; all rows if there are fewer."""
    if total <= size:
        return rows
    keys = [F.col(key)] if spare is None else [F.col(key), F.when(F.col(key).isNull(), F.col(spare))]  # a null adds nothing to a hash
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) < F.lit(int((1 << 30) * size / total)))
