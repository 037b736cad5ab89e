"""Removal of repeated byte strings through suffix arrays: common prefixes from a Burrows-Wheeler transform, bounded by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import Block, blocks, mixed, scaled, span_hasher, written

#: Bytes of the grams that name a window's bucket; windows are longer by what a search for the smallest gram needs.
GRAM = 20
#: Copies that may be broadcast, bits of the filter of shared buckets at most, segments of a task, and of a bucket before it is cut again.
BROADCAST_ROWS, FILTER_BITS, SEGMENTS_PER_TASK, HOT_BUCKET, LEVELS = 1_000_000, 26, 60_000, 100_000, 4
#: Segments that are sorted together inside a task, unless one bucket has more.
SEGMENTS_AT_ONCE = 1000
#: Rows of a batch of single windows, and a code for each byte, for a second hash that is independent of the first.
WINDOW_ROWS, BYTE_CODES = 1 << 16, mixed(np.arange(1, 257))


def bucket_runs(block: Block, length: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes that share a bucket: first window, number of windows, bucket, text.

    A window's bucket is the smallest hash of the grams inside it, which depends on its bytes alone: equal windows fall in
    equal buckets, and neighbouring windows mostly in the same. ``level`` selects another hash.
    """
    data, n = block.data, len(block.data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none
    at = np.arange(n - GRAM + 1)
    h = span_hasher(data)(at, at + GRAM)
    if level:
        h = mixed(h + np.uint64(level))
    span, wide = length - GRAM + 1, 1
    least = h
    while 2 * wide <= span:
        least = np.minimum(least[: len(least) - wide], least[wide:])
        wide *= 2
    windows = n - length + 1
    least = np.minimum(least[:windows], least[span - wide : span - wide + windows])
    valid = np.ones(windows, bool)
    tail = (block.at[1:, None] - np.arange(1, length)).ravel()
    valid[tail[(tail >= 0) & (tail < windows)]] = False
    size = np.diff(block.at)
    for a, b in zip(block.at[:-1][size < length], block.at[1:][size < length]):
        valid[a:b] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    many = np.flatnonzero(last) - first + 1
    return first, many, least[first] >> np.uint64(16), np.searchsorted(block.at, first, side="right") - 1


def common_prefix_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols up to 256) in order, and for each place the number of its class of equal ``length``-prefixes.

    Suffixes are sorted by their first symbols, doubling until ``length`` is covered, and transformed to the symbol before
    each. Then intervals of equal prefixes are expanded breadth-first. In round l, every interval of suffixes that
    share l symbols is extended backward by every symbol of its part of the transform: the suffixes which that symbol precedes
    move to where the longer strings stand. Two that become neighbours from different intervals have a common prefix of
    exactly l symbols, so values are found in increasing order, and each is found once. After ``length`` - 1
    rounds whatever has not been parted agrees in ``length`` symbols or more, and no larger value is derived.
    """
    n = len(text)
    rank, covered = np.zeros(n, np.int64), min(7, length)
    for k in range(covered):  # seven symbols of nine bits fit in one number
        rank <<= 9
        rank[: max(0, n - k)] |= text[k:]
    order = np.argsort(rank)
    while True:
        sorted_rank = rank[order]
        dense = np.zeros(n, np.int64)
        dense[order] = np.cumsum(np.concatenate([[0], (sorted_rank[1:] != sorted_rank[:-1]).astype(np.int64)]))
        if covered >= length or dense[order[-1]] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - covered)] = dense[covered:] + 1
        rank = dense * (n + 1) + after
        order = np.argsort(rank)
        covered *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # Where a suffix's first symbol is dropped: the inverse of moving back by the symbol before it.
    dropped = place[np.minimum(order + 1, n - 1)]
    first = text[order]
    parted = np.ones(n, bool)
    parted[1:] = first[1:] != first[:-1]
    # Symbol 0 ends a segment: no common prefix of use runs beyond the nearer end of two suffixes.
    ends = np.append(np.flatnonzero(text == 0), n)
    left = (ends[np.searchsorted(ends, np.arange(n))] - np.arange(n))[order]
    use = np.minimum(left, np.concatenate([left[:1], left[:-1]]))
    open_ = np.flatnonzero(~parted)
    for shared in range(1, length):
        open_ = open_[~parted[open_]]
        if not len(open_):
            break
        interval = np.cumsum(parted, dtype=np.int32)
        split = (interval[dropped[open_]] != interval[dropped[open_ - 1]]) | (use[open_] <= shared)
        parted[open_[split]] = True
    return order, np.cumsum(parted) - 1


def least_documents(bodies: pa.Array, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For windows of distinct segments, the smallest document that holds the same bytes: segment, first window, end, document."""
    segments = bodies.to_pylist()
    sizes = np.array([len(s) for s in segments], np.int64)
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = raw.astype(np.int64) + 1
    text[begin + sizes] = 0  # ends a segment; no byte equals it
    order, classes = common_prefix_classes(text, length)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    offset = np.arange(len(text)) - begin[owner]
    whole = offset + length <= sizes[owner]
    top = np.iinfo(np.int64).max
    held = np.where(whole, least[owner], top)
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    found = np.empty(len(text), np.int64)
    found[order] = np.minimum.reduceat(held[order], starts)[classes]
    at = np.flatnonzero(whole)
    who, doc = owner[at], found[at]
    new = np.ones(len(at), bool)
    new[1:] = (who[1:] != who[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    end = np.append(run[1:], len(at))
    return who[run], offset[at[run]], offset[at[end - 1]] + 1, doc[run]


def _bits(shared: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``2 ** bits`` bits of the buckets, as an array of words; its size has a fixed bound."""
    hashed = F.col("bucket").bitwiseAND(F.lit((1 << bits) - 1))  # a bucket's name is a hash already
    words = shared.select(hashed.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _segments(rows: DataFrame, length: int, kept: np.ndarray | None, level: int) -> DataFrame:
    """Segments of rows ``id, hash, start, body``: one per run of windows in a bucket; with ``kept``, only where the filter holds the bucket."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("body")):
                first, many, bucket, owner = bucket_runs(block, length, level)
                if level:  # a bucket cut again keeps its name in the new one
                    own = batch.column("bucket").to_numpy().view(np.uint64)[block.first + owner]
                    bucket = mixed(own * np.uint64(5) + bucket) >> np.uint64(16)
                if kept is not None:
                    h = bucket & np.uint64(len(kept) * 64 - 1)
                    ok = (kept[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1
                    first, many, bucket, owner = first[ok], many[ok], bucket[ok], owner[ok]
                if not len(first):
                    continue
                body = [block.data[a : a + m + length - 1].tobytes() for a, m in zip(first.tolist(), many.tolist())]
                take = pa.array(owner + block.first)
                start = batch.column("start").take(take).to_numpy() + first - block.at[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("hash").take(take), pa.array(start), pa.array(bucket.view(np.int64)), pa.array(body, pa.binary())],
                    ["id", "hash", "start", "bucket", "body"],
                )

    return rows.mapInArrow(cut, "id long, hash long, start long, bucket long, body binary")


def _windows(bodies: DataFrame, length: int) -> DataFrame:
    """Every window of segments ``bucket, segment, body, least, n``: its first byte, and its bytes as a hash of 128 bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("body")):
                low, high = span_hasher(block.data), span_hasher(BYTE_CODES[block.data])
                many = np.diff(block.at) - length + 1  # a segment has one window at least
                before = np.cumsum(many) - many
                for at in range(0, int(many.sum()), WINDOW_ROWS):
                    nth = np.arange(at, min(at + WINDOW_ROWS, int(many.sum())))
                    who = np.searchsorted(before, nth, side="right") - 1
                    first = nth - before[who]
                    start = block.at[who] + first
                    take = pa.array(who + block.first)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(take) for c in ("bucket", "segment", "least", "n")), pa.array(first), *(pa.array(h(start, start + length).view(np.int64)) for h in (low, high))],
                        ["bucket", "segment", "least", "n", "first", "low", "high"],
                    )

    return bodies.select("bucket", "segment", "body", "least", "n").mapInArrow(cut, "bucket long, segment long, least long, n long, first long, low long, high long")


def _met_by_window(bodies: DataFrame, length: int) -> DataFrame:
    """What ``least_documents`` finds, for segments of buckets of any size: equal windows meet by their own hash.

    The smallest id of a window is pre-aggregated before its shuffle, and joined back only where several segments or
    documents hold the window; a window that very many segments hold is a skewed join key, split at run time.
    """
    windows = _windows(bodies, length)
    shared = windows.groupBy("low", "high").agg(F.min("least").alias("smallest"), F.sum("n").alias("held")).where("held > 1").drop("held")
    met = windows.join(shared, ["low", "high"]).where("n > 1 OR smallest < least")
    # Neighbouring windows with the same smallest document are one run again.
    run = F.col("first") - F.row_number().over(Window.partitionBy("bucket", "segment", "smallest").orderBy("first"))
    runs = met.select("bucket", "segment", "first", "smallest", run.alias("run")).groupBy("bucket", "segment", "smallest", "run")
    return runs.agg(F.min("first").alias("first"), (F.max("first") + 1).alias("end")).select("bucket", "segment", "first", "end", F.col("smallest").alias("least"))


def repeated_spans(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """``id, hash, spans`` of rows with bytes that a smaller document holds too; ``spans`` are sorted ``start, stop`` pairs that may overlap.

    ``id`` is the doc_id, or the largest long for null, which makes such a row later than all others; ``hash`` tells apart rows of one
    doc_id. A string of ``length`` bytes counts if it also starts in a row with a smaller id.

    Copies of whole texts are settled first: all but the smallest id's are covered entirely. The rest is cut into
    runs of windows by bucket; a bucket that only one text has cannot repeat. Of those that remain, distinct segments
    meet once, with their smallest id, whatever the number of documents that hold them, and the suffix array of
    a bucket's segments gives every window's smallest document. A bucket with very many distinct segments is cut again
    by another hash, so that equal windows still meet but others part. A passage that very many distinct neighbours
    surround keeps its bucket large under any hash of grams; there, single windows meet by a hash of all their bytes.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = written(rows.select("id", "hash", F.xxhash64(F.lit("second"), "text").alias("second"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= length), "suffix-texts")
    same = keys.groupBy("hash", "second", "n").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    copies = written(keys.join(same, ["hash", "second", "n"]).where("id > least").select("id", "hash", "n").distinct(), "suffix-copies")
    few = copies.select("id", "hash")
    few = F.broadcast(few) if copies.count() <= BROADCAST_ROWS else few
    first = rows.where(F.octet_length("text") >= length).join(few, ["id", "hash"], "left_anti").select("id", "hash", F.lit(0).cast("long").alias("start"), F.col("text").cast("binary").alias("body"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("body"), 2 << 20):
                _, _, bucket, owner = bucket_runs(block, length)
                once = np.unique((owner.astype(np.uint64) << np.uint64(48)) | bucket) if len(block) < 1 << 16 else None
                found = once & np.uint64((1 << 48) - 1) if once is not None else np.unique(np.stack([owner.astype(np.uint64), bucket]), axis=1)[1]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["bucket"])

    shared = first.select("body").mapInArrow(name, "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = written(shared, "suffix-shared")
    bits = min(FILTER_BITS, max(16, (16 * shared.count()).bit_length()))
    segments = _segments(first, length, _bits(shared, bits), 0)
    segments = written(segments.withColumn("segment", F.xxhash64("body")), "suffix-segments", "zstd")
    for level in range(1, LEVELS + 1):
        # Slim rows first: how often each distinct segment occurs, and how many a bucket has.
        distinct = written(segments.groupBy("bucket", "segment").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min(F.octet_length("body")).alias("size")), "suffix-distinct")
        many = distinct.groupBy("bucket").agg(F.count("*").alias("distinct_segments")).where("distinct_segments > 1")
        many = written(many, "suffix-many")
        hot = many.where(F.col("distinct_segments") > HOT_BUCKET).select("bucket")
        if level == LEVELS or hot.isEmpty():
            break
        again = segments.join(hot, "bucket", "left_semi").select("id", "hash", "start", "bucket", "body")
        cut = _segments(again, length, None, level).withColumn("segment", F.xxhash64("body"))
        segments = written(segments.join(hot, "bucket", "left_anti").select(*cut.columns).union(cut), "suffix-segments", "zstd")
    several = many.select("bucket")
    few = several if hot.isEmpty() else many.where(F.col("distinct_segments") <= HOT_BUCKET).select("bucket")
    # A bucket's only segment: all its windows have the same smallest document, and there is nothing to compare.
    alone = distinct.where("n > 1").join(several, "bucket", "left_anti")
    alone = alone.select("bucket", "segment", F.lit(0).cast("long").alias("first"), (F.col("size") - (length - 1)).cast("long").alias("end"), "least")
    tasks = scaled(distinct.join(few, "bucket", "left_semi").count(), SEGMENTS_PER_TASK, 1)

    def bodies_of(buckets: DataFrame) -> DataFrame:
        bodies = segments.join(buckets, "bucket", "left_semi").groupBy("bucket", "body").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        return bodies.withColumn("segment", F.xxhash64("body"))

    bodies = bodies_of(few).withColumn("task", F.pmod(F.xxhash64("bucket"), F.lit(tasks)))

    def expand(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("bucket")
        bucket, segment, least, n = (table.column(c).to_numpy() for c in ("bucket", "segment", "least", "n"))
        body, found = table.column("body").combine_chunks(), []
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        at = 0
        while at < len(bucket):  # whole buckets, as many as keep the arrays small
            nth = int(np.searchsorted(edges, at + SEGMENTS_AT_ONCE, side="right"))
            end = int(edges[nth - 1]) if nth and edges[nth - 1] > at else (int(edges[nth]) if nth < len(edges) else len(bucket))
            end = len(bucket) if len(bucket) - at <= SEGMENTS_AT_ONCE else end
            who, first, stop, doc = least_documents(body.slice(at, end - at), least[at:end], length)
            who = who + at
            # A segment of one document is of use only where a smaller document holds some of it.
            use = (n[who] > 1) | (doc < least[who])
            found.append((bucket[who[use]], segment[who[use]], first[use], stop[use], doc[use]))
            at = end
        names = ("bucket", "segment", "first", "end", "least")
        return pa.table({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(names)})

    compared = bodies.groupBy("task").applyInArrow(expand, "bucket long, segment long, first long, end long, least long")
    found = compared.union(alone)
    if not hot.isEmpty():
        found = found.union(_met_by_window(written(bodies_of(hot), "suffix-hot", "zstd"), length))
    found = written(found, "suffix-found")
    hits = segments.select("id", "hash", "start", "bucket", "segment").join(found, ["bucket", "segment"]).where("least < id")
    hits = hits.select("id", "hash", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("end") + (length - 1)).alias("stop"))
    hits = hits.union(copies.select("id", "hash", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))
    return written(hits.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")), "suffix-spans")


def without_repeats(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` per row: ``kept`` is the text's bytes outside repeated spans, joined.

    Null counts as empty; empty and shorter texts keep all. Of equal texts the smallest doc_id keeps its bytes; rows
    that repeat a doc_id are not smaller than each other and so do not remove from each other. A null doc_id counts as
    larger than all. Strings never cross documents and are judged on the input. An empty table gives no row.
    Other columns are ignored.
    """
    spans = repeated_spans(docs, length=length)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    joined = rows.join(spans, ["id", "hash"], "left").select("doc_id", F.col("text").cast("binary").alias("body"), "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                removed, runs, kept = [], [], []
                for body, cuts in zip(part.column("body").to_pylist(), part.column("spans").to_pylist()):
                    pieces, reach, many, gone = [], 0, 0, 0
                    for cut in cuts or ():
                        start, stop = cut["start"], cut["stop"]
                        if start > reach or not many:
                            pieces.append(body[reach:start])
                            many += 1
                        gone += max(0, stop - max(start, reach))
                        reach = max(reach, stop)
                    pieces.append(body[reach:])
                    removed.append(gone), runs.append(many), kept.append(b"".join(pieces))
                sizes = [len(b) for b in part.column("body").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(remove, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
