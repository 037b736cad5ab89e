"""SimHash near-duplicates through vantage-point trees over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import scaled, written

#: Fixed value: the seed of Spark's xxhash64, also used for shingles.
SEED = 42
#: Distinct fingerprints that a shard holds on average while the tree may still grow, sampled ones that place each cut,
#: and levels of the tree at most. Deeper trees would copy more askers than they save comparisons.
SHARD_ROWS, SAMPLED_PER_SHARD, MAX_DEPTH = 4096, 64, 12
#: Askers that meet a shard's own fingerprints in one task; more are dealt over several tasks.
ASKERS_PER_TASK = 4_000_000
#: Fingerprints in a leaf of the tree inside a shard.
LEAF_ROWS = 48


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words.

    A-Z are lower-cased; words are runs of bytes other than blank and \\x09-\\x0D (what ``bytes.split`` cuts at).
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = zip(*(words[i:] for i in range(words_per_shingle)))
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64, len(words) - words_per_shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words_per_shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def distances(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree: node i keeps points within ``radius[i]`` of ``vantage[i]`` in child 2i + 1, others in 2i + 2.

    ``route`` sends a point to the one leaf that holds it and to every other leaf that may hold something within the
    search distance. By the triangle inequality that is a side only if the point's own distance is within reach of
    the cut. Of a pair parted by a cut, only the outer point asks the inner side, so no pair is looked for twice.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        nodes = (1 << depth) - 1
        self.vantage, self.radius = np.zeros(nodes, np.uint64), np.zeros(nodes, np.int64)
        parts = [sample]
        for node in range(nodes):
            part = parts[node]
            if len(part):
                self.vantage[node] = part[0]
                d = distances(part, part[0])
                self.radius[node] = median_cut(d)
                inner = d <= self.radius[node]
                parts += [part[inner], part[~inner]]
            else:
                parts += [part, part]

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each copy, its leaf, and whether the leaf is the row's home."""
        row = np.arange(len(points))
        node, home = np.zeros(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            d = distances(points[row], self.vantage[node]).astype(np.int64)
            radius = self.radius[node]
            inside = d <= radius
            # homes stay on their side; as askers they also visit the inner side from just outside
            to_inner = np.where(home, inside, d - reach <= radius)
            to_outer = np.where(home, ~inside, d + reach > radius)
            asks = home & ~inside & (d - reach <= radius)
            row = np.concatenate([row[to_inner], row[to_outer], row[asks]])
            node = np.concatenate([2 * node[to_inner] + 1, 2 * node[to_outer] + 2, 2 * node[asks] + 1])
            home = np.concatenate([home[to_inner], home[to_outer], np.zeros(int(asks.sum()), bool)])
        return row, node - ((1 << self.depth) - 1), home


def median_cut(d: np.ndarray) -> int:
    """The radius that halves a set best with both sides non-empty where possible."""
    counts = np.bincount(d, minlength=65)
    inner = np.cumsum(counts)
    return int(np.argmin(np.abs(2 * inner - len(d)) + (inner == len(d)) * len(d)))


class Forest:
    """Union of links as a parent array: links become one star per component, so memory stays one entry per point."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            self.parent[x] = self.parent[up]
            x = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def link_shard(points: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most ``reach`` bits between homes, and between homes and visitors, as stars (positions a, b)."""
    forest = Forest(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, ask = todo.pop()
        if not len(own) or len(own) + len(ask) < 2:
            continue
        d_own = distances(points[own], points[own[0]]).astype(np.int64)
        cut = median_cut(d_own)
        inner = d_own <= cut
        if len(own) <= LEAF_ROWS or inner.all():
            everyone = np.concatenate([own, ask])
            step = max(1, (1 << 21) // len(everyone))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                near = distances(points[part][:, None], points[everyone][None, :]) <= reach
                a, b = np.nonzero(near)
                forest.join(part[a], everyone[b])
            continue
        vantage = points[own[0]]
        d_ask = distances(points[ask], vantage).astype(np.int64) if len(ask) else np.zeros(0, np.int64)
        crossing = own[~inner & (d_own - reach <= cut)]
        todo.append((own[inner], np.concatenate([ask[d_ask - reach <= cut], crossing])))
        todo.append((own[~inner], ask[d_ask + reach > cut]))
    root = forest.find(np.arange(len(points)))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return linked, root[linked]


def links(distinct: DataFrame, reach: int) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) at ``reach`` or fewer differing bits: ``a > b``, enough of them to connect every linked pair."""
    n = distinct.count()
    depth = min(MAX_DEPTH, (scaled(n, SHARD_ROWS, 1) - 1).bit_length())
    # The sample only places the cuts; every fingerprint is indexed and every shard searched exactly.
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLED_PER_SHARD << depth).collect()], np.int64).view(np.uint64)
    tree = Tree(sample, depth)
    askers = int((~tree.route(sample[:4096], reach)[2]).sum()) * n // max(1, len(sample[:4096])) >> depth
    chunks = scaled(askers, ASKERS_PER_TASK, 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(points), 4096):
                part = points[at : at + 4096]
                row, leaf, home = tree.route(part, reach)
                chunk = (part[row] % np.uint64(chunks)).astype(np.int64)
                for c in range(chunks):  # homes go to every chunk of their shard, an asker to one
                    mine = home | (chunk == c)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[mine] * chunks + c), pa.array(part[row[mine]].view(np.int64)), pa.array(home[mine])], ["shard", "fp", "home"]
                    )

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        points = table.column("fp").to_numpy().view(np.uint64)
        a, b = link_shard(points, table.column("home").to_numpy(zero_copy_only=False), reach)
        signed = points.view(np.int64)
        x, y = signed[a], signed[b]
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    routed = distinct.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a > b``: the smallest node that it reaches.

    Alternating large-star and small-star steps. Each is a minimum per node, pre-aggregated before its shuffle, joined
    back to the edges, so a hub with very many neighbours is a skewed join (split at run time), never a list.
    """
    edges, state = written(edges.where("a != b").distinct(), "star"), None
    while state != (state := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large, "star")
        pairs = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(pairs.select("a", F.col("m").alias("b")))
        edges = written(small.where("a != b").distinct(), "star")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` per row: documents are linked if their fingerprints differ in at most ``max_bits`` bits.

    ``component_id`` is the smallest doc_id reachable over links. Null, empty and blank texts have fingerprint 0 and are
    linked like any other. Equal fingerprints (exact copies, repeated rows) form one class before any search, so
    a group of copies costs one point. A null doc_id counts as larger than all others. An empty table gives no row.
    Other columns are ignored.
    """
    prints = written(fingerprints(docs, words_per_shingle), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes, max_bits))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(first, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, *, words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each group, all columns: of the rows with the group's smallest doc_id (null counts as larger than all) the first.

    Rows are told apart by a key that is written with them, so a repeated row, one whose doc_id another row has too and one
    without a doc_id are rows of their own. Null, empty and very long texts are judged like others. An empty table
    gives no row. Columns keep their names, whatever these are.
    """
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), *own), "near-duplicate-rows")
    key, text = (F.col(f"own_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    named = keyed.select(F.struct(key.isNull().alias("none"), key.alias("doc_id"), "row").alias("doc_id"), text.alias("text"))
    groups = near_duplicates(named, words_per_shingle=words_per_shingle, max_bits=max_bits)
    # Written, so that its size is known: where few rows go, no text is shuffled.
    gone = written(groups.where("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias("row")), "near-duplicate-gone")
    return keyed.join(gone, "row", "left_anti").select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
