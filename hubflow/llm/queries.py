"""The registered queries of this folder: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.llm import crf, golomb, hilbert, packing, pii, repair, rp_forest, suffix, toxicity, trie, vptree, weak_labels, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that a smaller doc_id holds in a string of 50 bytes."""
    left = suffix.without_repeats(table(spark, sf_dir, "documents"), length=50)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts along a Hilbert curve over language, source and size (law ``rows``)."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    axes = [a.alias(f"axis{i}") for i, a in enumerate(hilbert.document_axes(5))]
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *axes)
    placed = hilbert.hilbert_shards(slim, [F.col(f"axis{i}") for i in range(len(axes))], 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every twentieth vector, among all others."""
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base patterns and what learned contexts add."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"CAST(size(filter(base, x -> x.rank = {pii.KINDS.index(k)})) AS long)").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"),
        pii.listed("array_sort(concat(base, added))").alias("spans"),
    )


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; the field is fitted only on rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = crf.learn(docs.where(crc_of("doc_id") % 4 != 2))
    return crf.languages(docs, model).select("doc_id", (crc_of("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in documents."""
    hits = winnow.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents by SimHash."""
    found = vptree.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a scorer that weakly labelled documents train."""
    return weak_labels.quality(table(spark, sf_dir, "documents"))


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens with each source at its share of the corpus."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue")


def op10_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels are learned only from rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(crc_of("doc_id") % 3 != 1))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal once A-Z are lower-cased."""
    return golomb.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_branch_and_bound_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations after a fixed damage."""
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_contracted_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations, with what their subtrees hold."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_projection_forest": op3_projection_forest,
    "op4_bootstrapped_pii": op4_bootstrapped_pii,
    "op5_crf_language": op5_crf_language,
    "op6_winnowing": op6_winnowing,
    "op7_simhash_vptree": op7_simhash_vptree,
    "op8_weak_label_quality": op8_weak_label_quality,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_boosted_toxicity": op10_boosted_toxicity,
    "op11_golomb_exact_dedup": op11_golomb_exact_dedup,
    "op12_branch_and_bound_repair": op12_branch_and_bound_repair,
    "op13_contracted_prefix_trie": op13_contracted_prefix_trie,
}

#: Words and windows spelled out; the join is on whole windows, so no fingerprint is involved.
OP6_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(10, len(words)) AS m FROM asked WHERE len(words) > 0),
item_starts AS (SELECT item_id, words, m, unnest(range(1, len(words) - m + 2)) AS s FROM sized),
item_windows AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(words, s, s + m - 1), ' ') AS w FROM item_starts),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_starts AS (SELECT doc_id, words, m, unnest(range(1, greatest(1, len(words) - m + 2))) AS s FROM lowered, lengths),
doc_windows AS (SELECT doc_id, m, s, array_to_string(list_slice(words, s, s + m - 1), ' ') AS w FROM doc_starts),
hits AS (SELECT d.doc_id, d.m, d.s, i.item_id FROM doc_windows d JOIN item_windows i ON d.w = i.w AND d.m = i.m),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, m, s FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

#: Equal texts meet as texts; no hash decides.
OP11_SQL = """
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM lowered
"""



def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in DuckDB, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda crc, byte: {step}), 4294967295)"


#: A dynamic program over turns and states, on all conversations at once, then the repaired text from its audit.
OP12_SQL = rf"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_replace(text, '[ 	-
]+$', '') AS body FROM hurt),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
more(letters, c, hops) AS (VALUES ('', 0, 0), ('I', 5, 1), ('II', 10, 2)),
best(conv_id, i, state, m) AS (
  SELECT conv_id, CAST(0 AS BIGINT), CASE hops WHEN 0 THEN '-' WHEN 1 THEN 'u' ELSE 'a' END, printf('%09d', c) || letters FROM counted, more
  UNION ALL
  SELECT conv_id, i, state, min(m) FROM (
    SELECT conv_id, i, CASE WHEN hops = 0 THEN state WHEN (state = 'u') = (hops = 1) THEN 'a' ELSE 'u' END AS state, printf('%09d', cost + c) || audit || letters AS m
    FROM (
      SELECT conv_id, i, CASE edit WHEN 'D' THEN state WHEN 'R' THEN CASE state WHEN 'u' THEN 'a' ELSE 'u' END ELSE initial END AS state, audit || edit AS audit,
             cost + CASE edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost
      FROM (
        SELECT j.conv_id, j.i, b.state, j.role[1] AS initial, j.fault, unnest(['D', 'K', 'R']) AS edit, CAST(left(b.m, 9) AS INTEGER) AS cost, substr(b.m, 10) AS audit
        FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1)
      WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR (state || initial) IN ('-s', '-u', 'su', 'ua', 'au')))), more)
  GROUP BY conv_id, i, state),
chosen AS (
  SELECT c.conv_id, min(m) AS m FROM counted c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n AND b.state IN ('-', 'a') GROUP BY c.conv_id),
edits AS (SELECT conv_id, unnest(string_split(substr(m, 10), '')) AS edit, generate_subscripts(string_split(substr(m, 10), ''), 1) AS j FROM chosen),
run AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS nth_out FROM edits),
lines AS (
  SELECT r.conv_id, r.j, r.edit, r.nth_out, t.role, CASE r.edit WHEN 'I' THEN '' ELSE t.text END AS text,
         max(CASE WHEN r.nth_out = 1 AND r.edit = 'K' AND t.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY r.conv_id) AS shift
  FROM run r LEFT JOIN judged t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i WHERE r.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth_out - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole
  FROM lines GROUP BY conv_id),
asked AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(CAST(left(m, 9) AS BIGINT), 0) AS cost, coalesce(substr(m, 10), '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM asked a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN chosen h ON a.conv_id IS NOT DISTINCT FROM h.conv_id
LEFT JOIN texts t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""

#: Whole prefixes as lists of digests; a subtree is every node whose smallest conversation starts with the prefix.
OP13_SQL = rf"""
WITH told AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS idx, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM told GROUP BY conv_id),
convs AS (SELECT s.*, least(s.h, coalesce(b.own, 0)) AS head FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
turns AS (
  SELECT c.conv_id, t.idx AS pos, t.role, t.text FROM convs c JOIN told t ON t.conv_id = c.base AND t.idx < c.h
  UNION ALL SELECT c.conv_id, c.head + t.idx - c.h, t.role, t.text FROM convs c JOIN told t ON t.conv_id = c.conv_id AND t.idx >= c.h),
named AS (
  SELECT conv_id, pos + 1 AS depth, strlen(text) AS bytes, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
prefixes AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM named),
nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(CASE WHEN is_end THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM prefixes GROUP BY k, depth),
kids AS (SELECT substr(k, 1, length(k) - 64) AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
tree AS (
  SELECT n.*, u.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children FROM nodes n
  LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.k = substr(n.k, 1, length(n.k) - 64) LEFT JOIN kids c ON c.k = n.k),
totals AS (
  SELECT p.k, count(*) FILTER (t.n_children = 0) AS n_leaves, CAST(sum((t.n_convs - 1) * t.bytes) AS BIGINT) AS saved_tokens
  FROM tree t JOIN prefixes p ON p.conv_id = t.conv_id AND p.depth <= t.depth GROUP BY p.k)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM tree JOIN totals USING (k)
"""

ORACLE_SQL: dict[str, str] = {
    "op6_winnowing": OP6_SQL,
    "op11_golomb_exact_dedup": OP11_SQL,
    "op12_branch_and_bound_repair": OP12_SQL,
    "op13_contracted_prefix_trie": OP13_SQL,
}
