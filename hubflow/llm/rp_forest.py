"""Approximate nearest neighbours: a forest of random-projection trees, one shared priority queue, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import hashed_sample, scaled, written

#: Trees of the forest, and leaves of all trees that a query visits, however large the table. For recall measured with them see README.
TREES, VISITED = 16, 720
#: Rows that a leaf holds on average, and from which a cell is split again.
LEAF_ROWS, SPLIT_ROWS = 24, 384
#: Levels that one round of splitting adds at most: a fit holds ``SAMPLED_PER_LEAF << STEP`` vectors, a model ``1 << STEP`` cuts.
STEP, SAMPLED_PER_LEAF = 12, 24
#: Children of one cell that a query looks at when the cell is split again.
CHILDREN = 64
#: log2 of the leaves that are searched together, as one page; rows and queries of a cell or page that meet in one task.
PAGE_BITS, ROWS_PER_TASK, QUERIES_PER_TASK = 10, 100_000, 20_000
#: Pairs whose scores a task holds at once.
PAIRS_AT_ONCE = 2_000_000


class Grove:
    """A tree of ``depth`` levels: a node splits by the projection on the difference of two centres of sampled points, at their median."""

    def __init__(self, depth: int, ways: np.ndarray, cuts: np.ndarray):
        self.depth, self.ways, self.cuts = depth, ways, cuts

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, seed: int) -> Grove:
        rng = np.random.default_rng(seed)
        nodes, width = (1 << depth) - 1, sample.shape[1]
        ways, cuts = np.zeros((nodes, width), np.float32), np.zeros(nodes)
        parts = [sample]
        for k in range(nodes):
            part = parts[k]
            way = rng.normal(size=width)
            if len(part) > 1:
                few = part[rng.choice(len(part), min(len(part), 128), replace=False)]
                a, b = few[0], few[1]
                for _ in range(3):
                    side = few @ (a - b) > ((a @ a) - (b @ b)) / 2
                    if side.all() or not side.any():
                        break
                    a, b = few[side].mean(axis=0), few[~side].mean(axis=0)
                way = a - b if np.any(a != b) else way
            ways[k] = way / np.linalg.norm(way)
            at = part @ ways[k]
            cuts[k] = np.median(at) if len(part) else 0.0
            parts += [part[at <= cuts[k]], part[at > cuts[k]]]
            parts[k] = part[:0]
        return cls(depth, ways, cuts)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((points * self.ways[node]).sum(axis=1) > self.cuts[node])
        return node - len(self.cuts)


def visit(groves: list[Grove], margins: list[list[float]], far: list[float], leaves: int) -> list[tuple[float, int, int]]:
    """The first ``leaves`` leaves of all groves, as (farness, grove, leaf): squared distances to the cuts on whose wrong side they lie, summed.

    One queue holds open nodes of all groves, so one whose cuts the point straddles is searched deeper than others. ``far`` is
    what each grove's root starts with.
    """
    queue = [(start, g, 0) for g, start in enumerate(far)]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < leaves:
        wrong, g, node = heapq.heappop(queue)
        inner, mine = len(groves[g].cuts), margins[g]
        while node < inner:
            m = mine[node]
            near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (wrong + m * m, g, other))
            node = near
        found.append((wrong, g, node - inner))
    return found


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def lifted(points: np.ndarray, longest: float) -> np.ndarray:
    """Points with one more coordinate that makes all of them ``longest``: nearest by angle is then largest by inner product."""
    rest = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0.0))
    return np.concatenate([points, rest[:, None]], axis=1)


def asked(points: np.ndarray, longest: float) -> np.ndarray:
    """Query points among lifted ones."""
    return np.concatenate([points * (longest / np.linalg.norm(points, axis=1))[:, None], np.zeros((len(points), 1))], axis=1)


def depth_for(rows: int) -> int:
    """Levels that cut ``rows`` into leaves of about ``LEAF_ROWS``, at most ``STEP``."""
    return int(min(STEP, max(0, round(np.log2(max(1, rows) / LEAF_ROWS)))))


def valid_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, v``: rows whose vector has the table's commonest length, only finite components, and not just zeros."""
    parts = table.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    parts = parts.where(F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"))
    sizes = parts.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return parts.where(F.size("v") == (sizes[0].n if sizes else 0))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), blocks)


class Index:
    """The forest over classes of equal vectors, in tables.

    A cell is a number: a leading one, the tree, then a bit for each level. ``placed`` (``id, cls``) has the leaf of every
    class in each tree, ``visits`` (``q, id, far``) the leaves that each query visits. The first round's groves are fitted on one bounded sample and
    sent to the tasks. A cell that has more than ``SPLIT_ROWS`` rows after a round gets a grove of its own in the next, fitted where
    its sampled rows meet; rows and queries meet their cell's grove in blocks. So neither a leaf nor a model grows with the table.
    """

    def __init__(self, classes: DataFrame, queries: DataFrame, rows: int, dims: int, longest: float, trees: int, visited: int):
        self.classes, self.dims, self.longest, self.trees, self.visited = classes, dims, longest, trees, visited
        self.kind = classes.schema["v"].dataType.simpleString()
        depth = depth_for(rows)
        sample = hashed_sample(classes.select("cls", "v"), "cls", SAMPLED_PER_LEAF << depth, rows).collect()
        points = lifted(np.array([r.v for r in sorted(sample)] or [[0.0] * dims], np.float64), longest)
        groves = [Grove.fit(points, depth, seed) for seed in range(trees)]
        base = 1 << (trees - 1).bit_length()

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = lifted(_matrix(batch.column("v"), dims), longest)
                for g, grove in enumerate(groves):
                    yield pa.RecordBatch.from_arrays([pa.array(((base + g) << depth) + grove.home(points)), batch.column("cls")], ["id", "cls"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    q = asked(_matrix(part.column("v"), dims), longest)
                    margins = [(q @ g.ways.T - g.cuts) / longest for g in groves]
                    found = [visit(groves, [m[i].tolist() for m in margins], [0.0] * trees, visited) for i in range(len(q))]
                    row = np.repeat(np.arange(len(q)), [len(f) for f in found])
                    far, grove, leaf = (np.array([x[k] for f in found for x in f]) for k in range(3))
                    yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(row)), pa.array(((base + grove) << depth) + leaf), pa.array(far)], ["q", "id", "far"])

        self.placed = written(classes.select("cls", "v").mapInArrow(place, "id long, cls long"), "forest-placed")
        wanted = classes.select("cls", "v").join(queries, "cls", "left_semi")
        self.visits = written(wanted.mapInArrow(search, "q long, id long, far double"), "forest-visits")
        cells = self.placed.groupBy("id").agg(F.count("*").alias("n"))
        while not (big := self._big(cells)).isEmpty():
            cells = self._split(big)

    def _big(self, cells: DataFrame) -> DataFrame:
        room = F.length(F.bin("id")) + STEP <= 62
        depth = F.least(F.lit(STEP), F.greatest(F.lit(1), F.round(F.log2(F.col("n") / LEAF_ROWS)).cast("int")))
        return written(cells.where((F.col("n") > SPLIT_ROWS) & room).select("id", "n", depth.alias("depth")), "forest-big")

    def _split(self, big: DataFrame) -> DataFrame:
        """One more round for the cells of ``big``. Returns the sizes of their children."""
        dims, longest, kind, step = self.dims, self.longest, self.kind, SAMPLED_PER_LEAF

        def fit(rows: pa.Table) -> pa.Table:
            cell, depth = rows.column("id")[0].as_py(), rows.column("depth")[0].as_py()
            order = np.argsort(rows.column("cls").to_numpy())
            grove = Grove.fit(lifted(_matrix(rows.column("v"), dims), longest)[order], depth, cell % (1 << 31))
            return pa.table({"id": [cell], "depth": pa.array([depth], pa.int32()), "ways": [grove.ways.tobytes()], "cuts": [grove.cuts.tobytes()]})

        def grove_of(model: pa.Table) -> Grove:
            depth = model.column("depth")[0].as_py()
            return Grove(depth, np.frombuffer(model.column("ways")[0].as_py(), np.float32).reshape((1 << depth) - 1, -1), np.frombuffer(model.column("cuts")[0].as_py()))

        def route(rows: pa.Table, model: pa.Table) -> pa.Table:
            if not rows.num_rows or not model.num_rows:
                return pa.table({"id": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "above": pa.array([], pa.int64())})
            grove = grove_of(model)
            cell = model.column("id")[0].as_py()
            home = grove.home(lifted(_matrix(rows.column("v"), dims), longest))
            return pa.table({"id": (cell << grove.depth) + home, "cls": rows.column("cls"), "above": rows.column("n")})

        def look(asking: pa.Table, model: pa.Table) -> pa.Table:
            if not asking.num_rows or not model.num_rows:
                return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "far": pa.array([], pa.float64())})
            grove, cell = grove_of(model), model.column("id")[0].as_py()
            q = asked(_matrix(asking.column("v"), dims), longest)
            margins, starts = (q @ grove.ways.T - grove.cuts) / longest, asking.column("far").to_pylist()
            found = [visit([grove], [m.tolist()], [s], CHILDREN) for m, s in zip(margins, starts)]
            row = np.repeat(np.arange(len(q)), [len(f) for f in found])
            return pa.table({"q": asking.column("q").take(pa.array(row)), "id": np.array([(cell << grove.depth) + x[2] for f in found for x in f]), "far": np.array([x[0] for f in found for x in f])})

        vectors = self.classes.select("cls", "v")
        inside = self.placed.join(big, "id")
        share = F.least(F.lit(1.0), F.expr(f"shiftleft({step}, depth) / n"))
        sampled = inside.where(F.pmod(F.xxhash64("cls", "id"), F.lit(1 << 30)) < F.ceil(share * (1 << 30)))
        models = sampled.join(vectors, "cls").select("id", "depth", "cls", "v").groupBy("id").applyInArrow(fit, "id long, depth int, ways binary, cuts binary")
        models = written(models, "forest-models")
        asking = self.visits.join(big.select("id"), "id")
        loads = big.select("id", F.ceil(F.col("n") / ROWS_PER_TASK).alias("blocks"))
        asks = asking.groupBy("id").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).alias("blocks"))

        def dealt(blocks: DataFrame) -> DataFrame:
            return models.join(blocks, "id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

        def spread(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
            return rows.join(blocks, "id").withColumn("block", _block(F.col(key), F.col("blocks"))).drop("blocks")

        rows = spread(inside, loads, "cls").join(vectors, "cls").select("id", "block", "cls", "n", "v")
        routed = written(rows.groupBy("id", "block").cogroup(dealt(loads).groupBy("id", "block")).applyInArrow(route, "id long, cls long, above long"), "forest-routed")
        looked = spread(asking, asks, "q").join(vectors.withColumnRenamed("cls", "q"), "q").select("id", "block", "q", "far", "v")
        looked = looked.groupBy("id", "block").cogroup(dealt(asks).groupBy("id", "block")).applyInArrow(look, "q long, id long, far double")
        rest = self.visits.join(big.select("id"), "id", "left_anti").select("q", "id", "far")
        nearest_first = F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))
        self.visits = written(rest.union(looked).withColumn("nth", nearest_first).where(F.col("nth") <= self.visited).drop("nth"), "forest-visits")
        self.placed = written(self.placed.join(big.select("id"), "id", "left_anti").select("id", "cls").union(routed.select("id", "cls")), "forest-placed")
        # Rows that no projection parts stay one leaf.
        return routed.groupBy("id").agg(F.count("*").alias("n"), F.max("above").alias("above")).where("n < above").select("id", "n")

    def hits(self, k: int) -> DataFrame:
        """``q, cls, score``: for each query and page the ``k + 1`` largest inner products among the rows of visited leaves."""
        dims, longest = self.dims, self.longest

        def rerank(queries: pa.Table, held: pa.Table) -> pa.Table:
            if not queries.num_rows or not held.num_rows:
                return pa.table({"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            leaf, cls = held.column("id").to_numpy(), held.column("cls").to_numpy()
            order = np.lexsort((cls, leaf))
            leaf, cls, v = leaf[order], cls[order], _matrix(held.column("v"), dims)[order]
            cells, begins, sizes = np.unique(leaf, return_index=True, return_counts=True)
            asking, q = queries.column("q").to_numpy(), _matrix(queries.column("v"), dims)
            wanted = queries.column("ids").combine_chunks()
            row, cell = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            row, at = row[cells[at] == cell], at[cells[at] == cell]  # other leaves are empty
            turns = np.cumsum(np.bincount(row, weights=sizes[at], minlength=len(q))) // PAIRS_AT_ONCE
            out = []
            for turn in np.unique(turns[row]):
                mine = turns[row] == turn
                r, c = row[mine], at[mine]
                by_cell = np.argsort(c, kind="stable")
                r, c = r[by_cell], c[by_cell]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
                a, b, s = [], [], []
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    begin, size = int(begins[c[low]]), int(sizes[c[low]])
                    a.append(np.repeat(r[low:high], size))
                    b.append(np.tile(np.arange(begin, begin + size), high - low))
                    s.append((q[r[low:high]] @ v[begin : begin + size].T).ravel())
                a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
                a, b, s = _first(a, cls[b], s, k + 1, 1e-9 * longest**2, b)
                exact = np.concatenate([(q[a[i : i + 65536]] * v[b[i : i + 65536]]).sum(axis=1) for i in range(0, len(a), 65536)])
                a, b, s = _first(a, cls[b], exact, k + 1, 0.0, b)
                out.append((asking[a], cls[b], s))
            if not out:
                out = [(asking[:0], cls[:0], np.zeros(0))]
            return pa.table({n: np.concatenate([o[i] for o in out]) for i, n in enumerate(("q", "cls", "score"))})

        vectors = self.classes.select("cls", "v")
        page = F.shiftright("id", PAGE_BITS)
        # A leaf that lies less deep than a page's leaves is a page of its own.
        shallow = F.length(F.bin("id")) <= PAGE_BITS + (self.trees - 1).bit_length() + 1
        page = F.when(shallow, F.expr(f"shiftright(id, length(bin(id)) - {(self.trees - 1).bit_length() + 1})")).otherwise(page)
        pages = written(self.visits.groupBy("q", page.alias("page")).agg(F.collect_list("id").alias("ids")), "forest-pages")
        blocks = pages.groupBy("page").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).alias("blocks"))
        blocks = written(blocks, "forest-blocks")
        asking = pages.join(blocks, "page").withColumn("block", _block(F.col("q"), F.col("blocks"))).join(vectors.withColumnRenamed("cls", "q"), "q")
        rows = self.placed.select("id", "cls", page.alias("page")).join(blocks, "page").join(vectors, "cls")
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        fresh = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731 (both sides come from the same tables)
        asking, rows = asking.select(*fresh("page", "block", "q", "ids", "v")), rows.select(*fresh("page", "block", "id", "cls", "v"))
        return asking.groupBy("page", "block").cogroup(rows.groupBy("page", "block")).applyInArrow(rerank, "q long, cls long, score double")


def _first(a: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int, margin: float, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``a`` the ``keep`` largest scores, ties to the smaller id, and all within ``margin`` of the last."""
    order = np.lexsort((ids, -score, a))
    a, b, score = a[order], b[order], score[order]
    begin = np.searchsorted(a, a, side="left")
    nth = np.arange(len(a)) - begin
    last = np.minimum(begin + keep, np.searchsorted(a, a, side="right")) - 1
    top = (nth < keep) | ((margin > 0) & (score >= score[last] - margin))
    return a[top], b[top], score[top]


def nearest(
    table: DataFrame, is_query, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, visited: int = VISITED
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` largest inner products among the other rows found.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id. Null, zero or not wholly finite vectors, and
    vectors of another length than most, take no part, nor do rows with a null id. Rows that repeat an id and a vector count once.
    With fewer candidates a query gets fewer rows; an empty table gives none. Other columns are ignored.

    Equal vectors form one class, indexed and searched once, with its ``k + 1`` smallest ids, which is all that can ever
    be returned of it; so a vector that a third of the rows hold is one point. Every class is indexed in each tree. A query
    visits ``visited`` leaves of bounded size, so its cost does not grow with the table; what that finds of the true neighbours depends on
    how many directions the vectors really spread over. Queries meet a page's rows in blocks.
    """
    rows = written(valid_vectors(table, key, vector).distinct(), "vectors")
    ahead = Window.partitionBy("v").orderBy("vec_id")
    classes = rows.withColumn("nth", F.row_number().over(ahead)).where(F.col("nth") <= k + 1)
    classes = classes.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).orderBy(F.col("ids")[0], F.xxhash64("v"))
    # Numbers in the order of the smallest id, also where one id has several vectors.
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    asked_rows = written(rows.where(is_query).join(classes.select("v", "cls"), "v").select(F.col("vec_id").alias("query_id"), "cls"), "vector-queries")
    shape = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + double(x) * double(x))")).alias("square")).first()
    if not shape.n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(classes, asked_rows.select("cls").distinct(), shape.n, shape.dims, float(np.sqrt(shape.square)), trees, visited)
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    best = index.hits(k).groupBy("q", "cls").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1)
    members = best.join(classes.select("cls", "ids"), "cls").select("q", F.explode("ids").alias("vec_id"), "score")
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = members.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1).select("q", "vec_id", "score")
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = asked_rows.join(lists, asked_rows.cls == lists.q).where("vec_id <> query_id").withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k)
    return answers.select(F.col("query_id").cast("long"), "rank", F.col("vec_id").cast("long"), "score")
