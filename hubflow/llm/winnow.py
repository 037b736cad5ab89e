"""Benchmark decontamination by winnowing: minimum k-gram hashes per window, joined and extended to whole spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import LOWER, Block, blocks, flag_table, mixed, span_hashes, word_spans, written

#: Bytes of words once A-Z are lower-cased: digits, a-z and all bytes beyond ASCII.
WORD_BYTES = flag_table((48, 57), (97, 122), (128, 255))
#: Bytes of text that a kernel handles at once: it holds about six numbers of 8 bytes for each.
BLOCK_BYTES = 1 << 20
#: log2 of the bits in the filter of benchmark fingerprints; a fixed 1 MB, whatever the benchmark's size.
FILTER_BITS = 23


class Words:
    """Lower-cased words of the texts of a block."""

    def __init__(self, block: Block):
        self.rows = len(block)
        self.data = LOWER[block.data]
        self.starts, self.ends, self.owner = word_spans(Block(0, len(block), self.data, block.at), WORD_BYTES)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.counts = np.bincount(self.owner, minlength=self.rows)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``length`` words, and the fingerprint that winnowing keeps of each.

        Of the k-grams inside a window (k is half its length, rounded up) the one with the smallest hash is kept.
        Equal windows keep equal fingerprints, so no shared window is missed.
        """
        n = len(self.starts) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        k = (length + 1) // 2
        size = len(self.starts) - k + 1
        with np.errstate(over="ignore"):
            grams = np.full(size, k, np.uint64)
            for j in range(k):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + self.hashes[j : j + size]
            grams = mixed(grams)
        least = grams[:n].copy()
        for j in range(1, length - k + 1):
            np.minimum(least, grams[j : j + n], out=least)
        whole = self.owner[:n] == self.owner[length - 1 : length - 1 + n]
        return np.flatnonzero(whole), least[whole]

    def digest(self, first: int, length: int) -> bytes:
        """128 bits that stand for the words of a window."""
        s, e = self.starts[first : first + length].tolist(), self.ends[first : first + length].tolist()
        raw = self.data[s[0] : e[-1]].tobytes()
        return hashlib.blake2b(b" ".join([raw[a - s[0] : b - s[0]] for a, b in zip(s, e)]), digest_size=16).digest()


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, length, fingerprint, digest`` of every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                words = Words(block)
                for length in sorted({min(window, int(c)) for c in words.counts if c}):
                    first, least = words.windows(length)
                    mine = np.minimum(words.counts[words.owner[first]], window) == length
                    first, least = first[mine], least[mine]
                    item = batch.column("item_id").take(pa.array(words.owner[first] + block.first))
                    digests = [words.digest(i, length) for i in first.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [item, pa.array([length] * len(first), pa.int32()), pa.array(least.view(np.int64)), pa.array(digests, pa.binary())],
                        ["item_id", "length", "fingerprint", "digest"],
                    )

    return benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, length int, fingerprint long, digest binary")


def _filter_of(windows: DataFrame) -> np.ndarray:
    """A bit for each benchmark fingerprint, in a filter of fixed size."""
    bit = F.shiftrightunsigned("fingerprint", 64 - FILTER_BITS)
    words = windows.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fingerprint, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for word, bits in words.collect():  # at most 2 ** 17 rows
        out[word] = np.int64(bits).view(np.uint64)
    return out


def candidate_windows(docs: DataFrame, kept: np.ndarray, lengths: list[int]) -> DataFrame:
    """Each document with its word count and the windows whose fingerprint may be one of the benchmark's."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        kind = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())])
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                words = Words(block)
                found: list[list[dict]] = [[] for _ in range(len(block))]
                base = np.cumsum(words.counts) - words.counts
                for length in lengths:
                    first, least = words.windows(length)
                    bit = least >> np.uint64(64 - FILTER_BITS)
                    hit = (kept[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    for i in first[hit].tolist():
                        r = int(words.owner[i])
                        found[r].append({"start": i - int(base[r]), "length": length, "digest": words.digest(i, length)})
                n = len(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(block.first, n), pa.array(words.counts.astype(np.int64)), pa.array(found, pa.list_(kind))],
                    ["row", "doc_id", "n_words", "found"],
                )
                row += n

    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, found array<struct<start:int,length:int,digest:binary>>"
    return docs.select("doc_id", "text").mapInArrow(search, schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """Words of documents that stand inside a benchmark window.

    One row per document row: ``row, doc_id, n_words, n_hit, items`` (sorted item ids as strings). A window is
    ``window`` consecutive words of an item; a shorter item, but not an empty one, is one window. A word is hit if any
    occurrence of a window covers it. Null or empty texts have no words and no hits. Repeated rows, and rows that
    share a doc_id, are judged one by one. Items with the same text all count. An empty benchmark leaves
    every document clean; an empty document table gives no row. Other columns are ignored.

    A task reads each text once and keeps the windows whose fingerprint passes a filter of fixed size; the exact join
    follows on 128-bit digests of the windows' words, first against distinct windows, so that a passage that many
    items and many documents share is not multiplied before spans are counted.
    """
    windows = written(benchmark_windows(benchmark, window), "benchmark-windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most ``window`` values
    found = written(candidate_windows(docs, _filter_of(windows), lengths), "benchmark-candidates")
    distinct = windows.select("digest").distinct()
    hits = found.select("row", F.explode("found").alias("w")).select("row", "w.*").join(distinct, "digest", "left_semi")
    in_order = Window.partitionBy("row").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), reached)))
    covered = spans.groupBy("row").agg(F.sum("new").alias("n_hit"))
    pairs = windows.select("digest", F.col("item_id").cast("string").alias("item")).distinct()
    items = hits.select("row", "digest").distinct().join(pairs, "digest").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return (
        found.select("row", "doc_id", "n_words")
        .join(covered.join(items, "row", "left"), "row", "left")
        .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The documents, all columns, that hold no benchmark window. Each row is judged by its own text, whatever its doc_id.

    A hit depends on the text alone, so a digest of 128 bits of the text names the rows to drop; a null doc_id and one that
    several rows share make no difference, and rows without a text have no hit. An empty table gives no row, an empty
    benchmark leaves all rows. Columns keep their names, whatever these are.
    """
    named = docs.select(_digest(F.col("text")).alias("doc_id"), "text")
    dirty = benchmark_hits(named, benchmark, window=window).where("n_hit > 0").select(F.col("doc_id").alias("digest")).distinct()
    # Written, so that its size is known: where few texts go, no text is shuffled.
    dirty = written(dirty, "benchmark-dirty")
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)])
    clean = own.join(dirty, _digest(F.col(f"own_{docs.columns.index('text')}")) == F.col("digest"), "left_anti")
    return clean.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))
