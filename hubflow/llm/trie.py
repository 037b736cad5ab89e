"""Conversation prefix trie whose subtree totals come from parallel tree contraction: rake leaves, compress unary chains, expand again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import written

#: At most so many turns are taken over from another conversation: ``borrowed`` is a remainder by one more.
BORROWED = 8
#: Bits of a row's number inside its partition in ``monotonically_increasing_id``.
ID_BITS = 33


def borrowed(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % (BORROWED + 1)).cast("long")


def _lanes(*parts) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(lane), *parts) for lane in (1, 2)]


def _chunked(rows: DataFrame, order: str, sums: dict[str, tuple]) -> DataFrame:
    """What lies before each chunk ``(conv_id, task)`` of its conversation: ``name: (aggregate, value)``. A chunk is one row, so a long conversation is few."""
    ahead = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "task").agg(F.min(order).alias("first"), *[how(value).alias(name) for name, (how, value) in sums.items()])
    return totals.select("conv_id", "task", "first", *[name for name in sums], *[F.coalesce(how(name).over(ahead), F.lit(0)).alias(f"{name}_ahead") for name, (how, _) in sums.items()])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, task, idx, bytes, t1, t2`` of every turn: its number in the conversation, the text's bytes and a 128-bit hash of role and text.

    Turns are sorted by range, so a long conversation lies in several partitions, and counted per partition; what a
    conversation has in earlier partitions is added from one row per conversation and partition.
    """
    text = F.coalesce("text", F.lit(""))
    t1, t2 = _lanes(F.coalesce("role", F.lit("")), text)
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.octet_length(text).cast("long").alias("bytes"), t1.alias("t1"), t2.alias("t2")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    sorted_rows = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    # Range partitions are in order, so these ids are in order over the whole table.
    rows = written(sorted_rows.withColumn("row", F.monotonically_increasing_id()).withColumn("task", F.shiftright("row", ID_BITS)), "trie-turns")
    chunks = _chunked(rows, "row", {"n": (F.sum, F.lit(1))})
    return rows.join(chunks, ["conv_id", "task"]).select("conv_id", "task", (F.col("row") - F.col("first") + F.col("n_ahead")).alias("idx"), "bytes", "t1", "t2")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, length``) and their turns (``conv_id, task, pos, bytes, t1, t2, length``) after the exchange of first turns."""
    sizes = turns.groupBy("conv_id").agg((F.max("idx") + 1).alias("own"))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", borrowed(F.col("conv_id")))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    head = F.least("h", F.coalesce("base_own", F.lit(0)))
    convs = sizes.join(bases, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = written(convs, "trie-conversations")
    rest = ["bytes", "t1", "t2", "length"]
    own = turns.join(convs, "conv_id").where("idx >= h").select("conv_id", "task", (F.col("head") + F.col("idx") - F.col("h")).alias("pos"), *rest)
    first = turns.where(F.col("idx") < BORROWED).withColumnRenamed("conv_id", "base")
    # At most nine conversations share a base.
    taken = first.join(convs, "base").where("idx < h").select("conv_id", F.lit(-1).cast("long").alias("task"), F.col("idx").alias("pos"), *rest)
    return convs, own.union(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, q1, q2, bytes, length``: a 128-bit name of the first ``depth`` turns, and of one turn fewer.

    A name is the XOR of hashes of (place, turn), so that of a long conversation is put together from its chunks.
    """
    g1, g2 = _lanes("pos", "t1", "t2")
    rows = written(turns.select("conv_id", "task", "pos", "bytes", "length", g1.alias("g1"), g2.alias("g2")), "trie-rebuilt")
    upto = Window.partitionBy("conv_id", "task").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("r1", F.bit_xor("g1").over(upto)).withColumn("r2", F.bit_xor("g2").over(upto))
    chunks = _chunked(rows, "pos", {"x1": (F.bit_xor, "g1"), "x2": (F.bit_xor, "g2")})
    p = [F.col(f"r{k}").bitwiseXOR(F.col(f"x{k}_ahead")) for k in (1, 2)]
    return run.join(chunks, ["conv_id", "task"]).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("g1")).alias("q1"), p[1].bitwiseXOR(F.col("g2")).alias("q2"), "bytes", "length"
    )


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``node`` and the sum of each value over the node's subtree, itself included.

    ``tree`` has ``node``, ``parent`` (null for a root), ``depth`` and the values, as longs. Rounds of joins contract it. *Rake*:
    a node without children is final; what it holds goes to its parent, summed before the shuffle. *Compress*: of a chain of
    nodes with one child each about every other one is taken out and its value put on the edge around it; which ones,
    a bit of their depth tells, and a hash once all bits had their turn, so that never two neighbours go at once. Both
    together leave a fixed share of the nodes, so rounds grow with the logarithm of the nodes, also in a tree
    that is one chain. Then the rounds are gone through backwards: a node that was taken out has the total of the child below it plus
    what was put on the edge. Every round works on written tables; a lost executor costs its tasks.
    """
    w, e, t = ([f"{k}_{v}" for v in values] for k in "wet")
    active = tree.select("node", "parent", "depth", *[F.col(v).alias(x) for v, x in zip(values, w)], *[F.lit(0).cast("long").alias(x) for x in e])
    active = written(active, "trie-active")
    bits = max(1, int(active.agg(F.max("depth")).first()[0] or 0).bit_length())
    raked, spliced = [], []
    while not active.isEmpty():
        turn = len(raked)

        def coin(node: Column, depth: Column, turn: int = turn) -> Column:
            return F.shiftright(depth, turn).bitwiseAND(F.lit(1)) if turn < bits else F.xxhash64(F.lit(turn), node).bitwiseAND(F.lit(1))

        with_child = active.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
        marked = written(active.join(with_child, "node", "left"), "trie-marked")
        raked.append(marked.where("inner IS NULL").select("node", *[F.col(x).alias(y) for x, y in zip(w, t)]))
        below = marked.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(F.col("inner").isNull(), F.col(x) + F.col(y)).otherwise(0)).alias(f"gain_{x}") for x, y in zip(w, e)],
            F.count("inner").alias("left"),
            F.min(F.when(F.col("inner"), F.struct("node", "depth"))).alias("child"),
        )
        grown = marked.where("inner").join(below, "node").select("node", "parent", "depth", *[(F.col(x) + F.col(f"gain_{x}")).alias(x) for x in w], *e, "left", "child")
        goes = (F.col("left") == 1) & F.col("parent").isNotNull() & (coin(F.col("node"), F.col("depth")) == 1) & (coin(F.col("child.node"), F.col("child.depth")) == 0)
        grown = written(grown.select("node", "parent", "depth", *w, *e, goes.alias("goes")), "trie-grown")
        out = grown.where("goes").select(F.col("node").alias("passed"), F.col("parent").alias("over"), *[F.col(x).alias(f"o{x}") for x in w + e])
        around = grown.where("NOT goes").join(out, F.col("parent") == F.col("passed"), "left")
        more = [F.coalesce(F.col(f"o{x}") + F.col(f"o{y}"), F.lit(0)) for x, y in zip(w, e)]
        active = around.select(
            "node", F.when(F.col("passed").isNull(), F.col("parent")).otherwise(F.col("over")).alias("parent"), "depth", *w,
            *[(F.col(y) + m).alias(y) for y, m in zip(e, more)], "passed", *[(F.col(y) + F.col(f"o{x}")).alias(f"add_{x}") for x, y in zip(w, e)],
        )
        active = written(active, "trie-active")
        spliced.append(active.where("passed IS NOT NULL").select("passed", F.col("node"), *[f"add_{x}" for x in w]))
        active = active.select("node", "parent", "depth", *w, *e)
    final = raked[-1:]
    for gone, leaves in zip(reversed(spliced[:-1]), reversed(raked[:-1])):
        known = final[0]
        for more in final[1:]:
            known = known.union(more)
        back = gone.join(known, "node").select(F.col("passed").alias("node"), *[(F.col(y) + F.col(f"add_{x}")).alias(y) for x, y in zip(w, t)])
        final += [written(back, "trie-expanded"), leaves]
    totals = final[0] if final else active.select("node", *[F.col(x).alias(y) for x, y in zip(w, t)])
    for more in final[1:]:
        totals = totals.union(more)
    return totals.select("node", *[F.col(y).alias(v) for y, v in zip(t, values)])


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, comma-joined, from rows sorted by node and id. Only the hash's state is held, however many ids a node has."""
    node, state = None, None
    for batch in batches:
        names, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        done = []
        for name, i in zip(names, ids):
            if name == node:
                state.update(b",%d" % i)
            else:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(b"%d" % i)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a node is a distinct
    sequence of first turns (role, text), named by the smallest conversation that starts with it and the
    number of turns; the root stands for no turns. A conversation consists of the first ``h`` turns of the
    conversation whose id is the next multiple of 5 towards zero, ``h`` being given by its own id, and of its own turns after ``h``.

    Turns are taken in order of ``turn``, null first, those of one number (repeated rows) in the order of a hash of role and text. Null roles and texts are
    empty. Rows without a conv_id belong to no conversation and take no part. An empty table gives no row. Other columns
    are ignored. Texts, of any length, are hashed where they are read and never shuffled.
    """
    convs, turns = rebuilt(numbered_turns(conversations))
    rows = written(prefixes(turns), "trie-prefixes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("bytes"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = rows.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    name = F.concat_ws(":", "depth", "conv_id")
    nodes = written(nodes.unionByName(root).withColumn("node", name), "trie-nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    tree = nodes.join(up, ["depth", "q1", "q2"], "left")
    kids = up.join(nodes.select("depth", "q1", "q2"), ["depth", "q1", "q2"]).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = tree.join(kids, "node", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "p1", "p2", F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    tree = written(tree, "trie-tree")
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    last = rows.where("depth = length").select("conv_id", "depth", "p1", "p2").union(convs.where("length = 0").select("conv_id", zero, zero, zero))
    ends = last.withColumnRenamed("conv_id", "member").join(tree.select("node", "depth", "p1", "p2"), ["depth", "p1", "p2"]).select("node", F.col("member").alias("conv_id"))
    hashes = ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_joined_hashes, "node string, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        tree.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
        .join(totals, "node")
        .join(hashes, "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    )
