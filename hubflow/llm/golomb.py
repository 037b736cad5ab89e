"""Exact deduplication: partitions send sorted, Golomb-coded hashes to owners and get bitmaps back; only suspects are shuffled and compared."""

from __future__ import annotations

import math
import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import scaled, shared_folder, written

#: log2 of the rows whose fingerprints are sorted and sent together. A longer partition has several senders.
SENDER_BITS = 20
#: Fingerprints that one owner holds on average.
PER_OWNER = 1 << 22
#: Bits of a sent fingerprint beyond those that count the rows: about one row in 2 ** SPARE_BITS is suspected in vain.
SPARE_BITS = 12


def divisor_bits(count: int, span: int) -> int:
    """The power of two nearest below the best Golomb divisor for ``count`` values spread evenly over ``span``."""
    return max(0, int(math.log2(max(1.0, span * math.log(2) / count))))


def golomb_encode(values: np.ndarray, span: int) -> bytes:
    """Sorted distinct integers from 0 to below ``span`` as Golomb codes of their gaps: all remainders, then all unary quotients."""
    if not len(values):
        return b""
    k = divisor_bits(len(values), span)
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    remainders = (gaps[:, None] >> np.arange(k)) & 1
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    return np.packbits(remainders.astype(np.uint8)).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(code: bytes, count: int, span: int) -> np.ndarray:
    """The ``count`` integers of a code."""
    if not count:
        return np.zeros(0, np.int64)
    k = divisor_bits(count, span)
    cut = -(-count * k // 8)
    low = np.unpackbits(np.frombuffer(code, np.uint8, cut), count=count * k).reshape(count, k)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, offset=cut)))[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = (quotients << k) + (low.astype(np.int64) << np.arange(k)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


class Exchange:
    """The three kernels of the exchange. Owner ``o`` holds the fingerprints from ``o * width`` on."""

    def __init__(self, rows: int, owners: int):
        self.bits = min(62, max(1, rows - 1).bit_length() + SPARE_BITS)
        self.owners = owners
        self.width = -(-(1 << self.bits) // owners)

    def _sorted(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct short fingerprints, the place of each row among them, their counts, and where each owner's part ends."""
        short = (fp.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        values, place, counts = np.unique(short, return_inverse=True, return_counts=True)
        return values, place, counts, np.searchsorted(values, np.arange(1, self.owners + 1) * self.width)

    def send(self, rows: pa.Table) -> pa.Table:
        """One message per owner: a value that several of the sender's rows share is sent once."""
        values, _, _, ends = self._sorted(rows.column("fp").to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        owners = np.flatnonzero(ends > starts)
        codes = [golomb_encode(values[starts[o] : ends[o]] - o * self.width, self.width) for o in owners.tolist()]
        sender = rows.column("sender")[0].as_py()
        return pa.table(
            {"owner": pa.array(owners, pa.int32()), "sender": pa.array([sender] * len(owners), pa.int64()), "n": pa.array((ends - starts)[owners], pa.int32()), "code": pa.array(codes, pa.binary())}
        )

    def answer(self, messages: pa.Table) -> pa.Table:
        """A bitmap per message: which of its values another message holds too."""
        counts = messages.column("n").to_pylist()
        codes = messages.column("code").to_pylist()
        values = np.concatenate([golomb_decode(c, n, self.width) for c, n in zip(codes, counts)])
        _, place, times = np.unique(values, return_inverse=True, return_counts=True)
        shared = np.split(times[place] > 1, np.cumsum(counts)[:-1])
        return pa.table({"sender": messages.column("sender"), "owner": messages.column("owner"), "n": messages.column("n"), "bitmap": pa.array([np.packbits(x).tobytes() for x in shared], pa.binary())})

    def receive(self, rows: pa.Table, replies: pa.Table) -> pa.Table:
        """A sender's suspects, as words of 64 bits by the row's number in the sender."""
        _, place, counts, _ = self._sorted(rows.column("fp").to_numpy())
        replies = replies.sort_by("owner")
        shared = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(replies.column("bitmap").to_pylist(), replies.column("n").to_pylist())])
        suspect = (shared.astype(bool) | (counts > 1))[place]
        nth = rows.column("nth").to_numpy()
        flags = np.zeros(-(-int(nth.max() + 1) // 64) * 64, np.uint8)
        flags[nth] = suspect
        words = np.packbits(flags, bitorder="little").view("<i8")
        return pa.table({"sender": rows.column("sender").slice(0, 1), "words": pa.array([words], pa.list_(pa.int64()))})


def folded(text: Column) -> Column:
    """A text with A-Z, and only them, in lower case; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _bucketed(df: DataFrame, column: str) -> DataFrame:
    """``df`` as a table in the shared folder whose rows with equal ``column`` are read by one task, without a shuffle on either side.

    Buckets of a table are known to Spark only through its catalog, which the table leaves at once; its files stay.
    """
    spark = df.sparkSession
    name = f"exact_dedup_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, column).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def suspects_of(rows: DataFrame) -> DataFrame:
    """``sender, words``: for each sender a bit per row that is set if its short fingerprint occurs in another row too.

    ``rows`` has ``sender``, ``nth`` (the row's number in the sender) and ``fp``, and is bucketed by sender.
    """
    spark = rows.sparkSession
    n = rows.count()
    exchange = Exchange(n, scaled(n, PER_OWNER, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    slim = rows.select("sender", "nth", "fp")
    messages = slim.groupBy("sender").applyInArrow(lambda t: exchange.send(t), "owner int, sender long, n int, code binary")
    replies = messages.groupBy("owner").applyInArrow(lambda t: exchange.answer(t), "sender long, owner int, n int, bitmap binary")
    found = slim.groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(lambda mine, back: exchange.receive(mine, back), "sender long, words array<long>")
    return written(found, "exact-suspects")


def classes(suspects: DataFrame) -> DataFrame:
    """``row, doc_id, cls``: suspects are in one class if their texts are equal byte by byte; ``cls`` is the class's first row.

    Of a sender's equal texts only the first is shuffled. These are compared with one witness per full fingerprint, so a text that
    very many senders hold is a skewed join, split at run time. Texts that share a fingerprint with another text meet in a
    second comparison, grouped by the texts themselves.
    """
    local = Window.partitionBy("sender", "fp", "text")
    marked = suspects.withColumn("first", F.min("row").over(local))
    marked = written(marked.select("row", "doc_id", "fp", "first", F.when(F.col("row") == F.col("first"), F.col("text")).alias("text")), "exact-marked")
    firsts = marked.where("row = first").select("fp", "first", "text")
    witness = firsts.groupBy("fp").agg(F.min("first").alias("cls"), F.min_by("text", "first").alias("seen"))
    judged = firsts.join(witness, "fp").select("fp", "first", "cls", F.when(F.col("text") != F.col("seen"), F.col("text")).alias("other"))
    judged = written(judged, "exact-judged")
    others = judged.where("other IS NOT NULL")
    apart = others.groupBy("fp", "other").agg(F.min("first").alias("own_class"))
    named = judged.where("other IS NULL").select("first", "cls").union(others.join(apart, ["fp", "other"]).select("first", F.col("own_class").alias("cls")))
    return marked.select("row", "doc_id", "first").join(named, "first").select("row", "doc_id", "cls")


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: Column | None = None, fingerprint: Column | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` (and ``carried``, if given) for every row: rows with equal texts, A-Z folded, form a group.

    The row with the largest ``key`` stays; a null key counts as smaller than all, and of rows with the same key the first one
    read stays, so exactly one row of a group has ``kept``. A null text counts as empty; empty texts, and texts of any length, are
    grouped like others. An empty table gives no row. Other columns are ignored, whatever their names. ``fingerprint`` replaces
    the 64-bit hash of the folded text (column ``text``).

    Texts are read once and written with their fingerprints, one sender after the other. Only coded hashes go to their owners and
    only bitmaps come back; rows whose fingerprint is alone are unique without further work.
    """
    row, spark = F.monotonically_increasing_id(), docs.sparkSession
    extra = {} if carry is None else {"carried": carry}
    read = docs.select(row.alias("row"), F.col(key).alias("doc_id"), folded(F.col(text)).alias("text"), *[c.alias(n) for n, c in extra.items()])
    low = (1 << SENDER_BITS) - 1
    keyed = read.select(
        F.shiftright("row", SENDER_BITS).alias("sender"),
        F.col("row").bitwiseAND(F.lit(low)).cast("int").alias("nth"),
        (F.xxhash64("text") if fingerprint is None else fingerprint).alias("fp"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        *read.columns,
    )
    keyed = _bucketed(keyed, "sender")
    if keyed.isEmpty():
        return spark.createDataFrame([], _result(keyed, extra))
    bits = suspects_of(keyed).hint("shuffle_hash")
    told = F.expr("shiftright(get(words, shiftright(nth, 6)), nth & 63) & 1L") == 1
    flagged = keyed.join(bits, "sender").withColumn("suspect", told).drop("words")
    found = classes(flagged.where("suspect").select("sender", "row", "doc_id", "fp", "text"))
    found = written(found, "exact-classes")
    groups = found.groupBy("cls").agg(F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("best"), F.count("*").alias("group_size"))
    decided = found.join(groups, "cls").select("row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.back") == -F.col("row")).alias("kept"))
    rest = ["text_sha256", *extra]
    alone = flagged.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *rest)
    shared = flagged.where("suspect").select("row", "doc_id", *rest).join(decided, "row")
    return alone.union(shared.select("doc_id", "keep_id", "group_size", "kept", *rest))


def _result(keyed: DataFrame, extra: dict) -> str:
    kind = {f.name: f.dataType.simpleString() for f in keyed.schema}
    carried = "".join(f", {n} {kind[n]}" for n in extra)
    return f"doc_id {kind['doc_id']}, keep_id {kind['doc_id']}, group_size long, kept boolean, text_sha256 string{carried}"


def without_exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, all columns; see ``exact_duplicates`` for which."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return exact_duplicates(docs, key=key, text=text, carry=whole).where("kept").select("carried.*")
