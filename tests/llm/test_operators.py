"""Each operator against brute force, on odd rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from hubflow.llm import common, crf, hilbert, packing, pii, queries, rp_forest, suffix, toxicity, vptree, weak_labels, winnow

ODD = [(0, None), (1, ""), (2, " \n"), (3, "…"), (4, "the same text again and again " * 4), (5, "the same text again and again " * 4), (5, "the same text again and again " * 4), (6, "x" * 200_000), (7, "You 1d1ot! +1 (415) 555-0134 a@b.co")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, letterless, repeated and very long texts, with extra columns of clashing names."""
    rows = [(i, t, "en", "s", 0, 0, 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, id int, task int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def brute_spans(rows, length=50):
    first, out = {}, {}
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in rows:
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        out[i] = (sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_array_matches_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BUCKET", 20)
    monkeypatch.setattr(suffix, "SEGMENTS_AT_ONCE", 40)
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(300))
    parts = lambda: rng.choice([base[k : k + rng.randint(1, 120)] for k in (rng.randint(0, 250),)] + ["a" * 60, "é" * 30, "\0" * 55])
    rows = [(i, "".join(parts() for _ in range(rng.randint(0, 6)))) for i in range(120)]
    for docs, plain in ((spark.createDataFrame(rows, "doc_id long, text string"), rows), (odd, [r for r in ODD])):
        got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(docs).collect()}
        assert got == brute_spans(plain)


def test_phrases_amid_many_neighbours_leave_no_large_bucket(spark, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(suffix, "HOT_BUCKET", 60)
    compared, apply = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: (compared.append(self._df), apply(self, *a))[1])
    rng = random.Random(9)
    words = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrases = [words(n) for n in (40, 49, 80)]
    rows = [(i, words(70) + phrases[i % 3] + words(70)) for i in range(900)]
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_spans(rows)
    (bodies,) = compared
    assert (bodies.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0) <= 60


def test_hilbert_curve_visits_each_cell_once_in_steps_of_one():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    index = hilbert.curve_index(grid, 3)
    assert sorted(index) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(spark):
    rows = queries.op2_hilbert_sharding(spark, SMALL).toPandas()
    counts = rows.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert counts["size"].max() - counts["size"].min() <= 1
    assert (counts["max"] + 1 == counts["size"]).all() and (counts["nunique"] == counts["size"]).all()
    assert (rows.sort_values(["shard", "slot"]).cell.diff().dropna() >= 0).all()


def test_written_shards_hold_every_row_and_narrow_ranges(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, i]), f"t{i}", rng.randrange(32), rng.randrange(32), "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, row string").repartition(5)
    path = str(tmp_path / "shards")
    hilbert.write_shards(docs, [F.col("a"), F.col("b")], path, 16)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    sizes = back.groupBy("curve_shard").agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "ab"]).toPandas()
    assert len(sizes) == 16 and sizes.n.max() - sizes.n.min() <= 1
    # A cell of the grid of 16 shards is 8 by 8: files span a part of either axis, where files of an unsorted table span all of both.
    assert sizes.a.mean() < 14 and sizes.b.mean() < 14
    hit = back.where("a BETWEEN 3 AND 5 AND b BETWEEN 20 AND 22").select("curve_shard").distinct().count()
    assert 1 <= hit <= 4
    hilbert.write_shards(docs.where("false"), [F.col("a"), F.col("b")], str(tmp_path / "none"), 4)


def test_neighbours_have_exact_scores_and_recall(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(table.vec_id, table.embedding)]
    rows += [(10_000, None), (10_001, [0.0] * 64), (10_002, [float("nan")] * 64), (10_003, rows[0][1]), (10_020, rows[0][1])]
    got = rp_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").toPandas()
    valid = {i: np.array(v) for i, v in rows if i not in (10_000, 10_001, 10_002)}
    found = total = 0
    for q in (i for i in valid if i % 20 == 0):
        best = sorted(((-(valid[q] * v).sum(), i) for i, v in valid.items() if i != q))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert all(abs(s - (valid[q] * valid[i]).sum()) < 1e-9 for i, s in zip(mine.vec_id, mine.score))
        found += len({i for _, i in best} & set(mine.vec_id))
        total += len(best)
    assert found >= 0.9 * total
    assert rp_forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), "true").count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    doubled = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False, "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]


def test_base_patterns_match_their_definition(spark):
    rng = random.Random(3)
    bits = ["a", "@", ".", "-", "_", "1", "4", "+", " ", "(", ")", "é", "😀", "4111111111111111", "1.2.3.4", "+1 456 555 2186", "\n"]
    texts = ["a@b.c@d.e", "x@y.z._q@r.s", "1.2.3.4.5.6.7.8", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500))]
    rows = pii.located(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "base").collect()
    for r in rows:
        want = sorted((m.start(), i, m.end()) for i, k in enumerate(pii.KINDS) for m in re.finditer(BASE[k], texts[r.doc_id]) if holds(k, m.group()))
        assert [(x.start, x.rank, x.stop) for x in r.base] == want


def test_contexts_of_seeds_find_other_forms_and_spare_prose(spark):
    rows = [(i, f"filler words please call {'+1 (415) 555-%04d' % i if i % 2 else '415 555 %04d' % i} now") for i in range(60)]
    rows += [(100 + i, f"the order number {i * 99991:010d} was shipped") for i in range(20)]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(r.added) for r in found if r.doc_id < 100) == 30
    assert not any(r.added for r in found if r.doc_id >= 100)


def added_values(spark, texts):
    rows = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {(pii.KINDS[x.rank], texts[r.doc_id][x.start : x.stop]) for r in rows for x in r.added}


def test_seeds_glued_to_a_label_or_at_a_start_support_its_context(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ghijklmnop") for _ in range(7))
    seeds = lambda form: [form.format(i=i, w=word(), v=word()) for i in range(10)]
    texts = [*seeds("{w} {v} email:u{i}@b.co {w}"), *seeds("{w} {v} phone=+1 415 555 01{i:02d}"), *seeds("mail <m{i}@b.co> now"), *seeds("{w} please write (n{i}@b.co) {w}"), *seeds("Reach s{i}@b.co {v}")]
    wanted = {"ee(at)b.co", "415-555-0134", "mm(at)b.co", "nn(at)b.co", "rr(at)b.co"}
    texts += ["odd ones email:ee(at)b.co", "other words phone=415-555-0134", "mail <mm(at)b.co> now", "x please write (nn(at)b.co)", "Reach rr(at)b.co"]
    # A label that mostly leads to ordinary words is no context, even if what looks like an identifier there is one.
    texts += [*seeds("{w} note:k{i}@b.co"), *(f"{word()} note:{word()}" for _ in range(60)), "a b note:zz(at)b.co"]
    assert {v for _, v in added_values(spark, texts)} == wanted


@pytest.mark.parametrize(
    ("kind", "values"),
    [
        ("phone", ["06 12 34 56 78", "12-34-56-78-90", "55/12/34/56/78", "(06) 12 34 56 78", "1 415 555 0134", "06  12  34  56  78", "5551234"]),
        ("ip", ["fe80:0:a1:b2", "fe80::a1:b2", "10.0.0.300", "ab:cd:ef:0:1:2"]),
        ("email", ["q(at)b.co", "q[at]b.co", "q@localhost"]),
        ("card", ["4111/1111/1111/1112", "41 11 11 11 11 11 11 12"]),
    ],
)
def test_every_form_is_found_behind_a_learned_context(spark, kind, values):
    seed = {"phone": "+1 415 555 01{:02d}", "ip": "10.0.0.{}", "email": "u{}@b.co", "card": ""}[kind]
    seeds = [seed.format(i) for i in range(20)]
    if kind == "card":
        seeds = [f"41111111111{i:04d}" for i in range(300) if holds("card", f"41111111111{i:04d}")][:20]
    assert all(re.search(pii.FORM[kind], v) for v in values)
    texts = [f"words then reach via {v} today" for v in seeds] + [f"words then reach via {v} today" for v in values]
    assert added_values(spark, texts) == {(kind, v) for v in values}


def test_a_context_of_two_kinds_finds_both(spark):
    texts = [f"words contact me u{i}@b.co" for i in range(10)] + [f"words contact me +1 415 555 01{i:02d}" for i in range(8)]
    texts += ["words contact me q(at)b.co", "words contact me 415-555-0134"]
    assert added_values(spark, texts) == {("email", "q(at)b.co"), ("phone", "415-555-0134")}


def test_language_on_held_out_rows(spark):
    rows = queries.op5_crf_language(spark, SMALL).toPandas().merge(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas())
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97


def test_field_labels_both_sides_of_a_switch():
    rng = random.Random(2)
    words = {"a": [b"banan", b"anana", b"naban"], "b": [b"xyzzy", b"zyxx", b"yxxz"]}
    chains = [([rng.choice(words[k]) for _ in range(20)], k) for k in "ab" * 30]
    model = crf.fit(chains)
    import pyarrow as pa

    from hubflow.llm.common import blocks

    (block,) = blocks(pa.array([" ".join(w.decode() for w in words["a"] * 3 + words["b"] * 3)]))
    mean, _ = model.label(block)
    assert abs(mean[0, 0] - 0.5) < 0.1


def test_every_language_is_learned_however_many(spark):
    rng = random.Random(8)
    letters = "bcdfghjklmnpqrstvwxz"
    tongues = [f"l{k:02d}" for k in range(70)]
    words = {k: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(4)] for k in tongues}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(24)), k) for i, k in enumerate(t for n, t in enumerate(tongues) for _ in range(60 if n < 3 else 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.learn(docs)
    assert model.languages == tongues
    said = {r.doc_id: r.lang_pred for r in crf.languages(docs, model).collect()}
    assert np.mean([said[i] == k for i, _, k in rows]) >= 0.95 and set(said.values()) == set(tongues)


def test_simhash_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 16)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: vptree.fingerprint((t or "").encode()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in vptree.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in texts}


def test_tree_finds_every_near_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))]))
    a, b = vptree.link_shard(points, np.ones(len(points), bool), 3)
    forest = vptree.Forest(len(points))
    forest.join(a, b)
    near = np.argwhere(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    assert (forest.find(near[:, 0]) == forest.find(near[:, 1])).all()


def test_winnowing_matches_whole_windows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, "short ITEM"), (4, None), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x One, two three-four five six seven eight nine TEN y"), (2, "a short item b short"), (3, "one two three"), (4, None), (5, "é short item")], "doc_id long, text string"
    )
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in winnow.benchmark_hits(docs, bench).collect()}
    assert got == {1: (12, 10, ["1"]), 2: (5, 2, ["2", "3"]), 3: (3, 0, []), 4: (0, 0, []), 5: (3, 2, ["2", "3"])}


def test_quality_separates_labels(spark):
    rows = queries.op8_weak_label_quality(spark, SMALL.replace("0.001", "0.01")).toPandas().merge(spark.read.parquet(SMALL.replace("0.001", "0.01") + "/labels.parquet").toPandas())
    assert rows[rows.quality == 1].keep.mean() >= 0.99 and rows[rows.quality == 0].keep.mean() <= 0.2


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plain = Tokenizer.from_file(queries.vocabulary())
    ids = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs, queries.vocabulary()).toPandas()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {i: len(x) for i, x in ids.items()}
    import zlib

    assert all(zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in rows.itertuples())
    filled = rows.groupby("sequence_id")["length"].sum()
    assert (filled.iloc[:-1] == 1024).all()
    shares = rows.groupby(["sequence_id", "queue"])["length"].sum().unstack(fill_value=0).iloc[:-1]
    target = rows.groupby("queue")["length"].sum() / rows["length"].sum() * 1024
    assert ((shares.cumsum() - np.outer(np.arange(1, len(shares) + 1), target)).abs().to_numpy() <= len(target) / 2 + 1).all()


def test_schedule_serves_every_token_once():
    schedule = packing.Schedule([5, 17, 1000, 3, 250])
    served = schedule.served(np.arange(schedule.n + 1))
    assert (served.sum(axis=1) == np.arange(schedule.n + 1)).all() and (np.diff(served, axis=0) >= 0).all()


@pytest.mark.parametrize("rates", [None, [1.0 + i % 3 for i in range(150)]])
def test_mixture_of_many_queues_places_every_token_once_at_its_share(rates):
    totals = sorted((40 + 37 * i % 400 for i in range(150)), reverse=True)
    mixture = packing.Mixture(totals, rates, width=8)
    queue, zero = np.arange(150), np.zeros(150, np.int64)
    row, at, low, high, offset = mixture.pieces(queue, zero, np.array(totals), 512)
    assert np.bincount(row, weights=high - low).tolist() == totals
    spots = np.concatenate([w * 512 + np.arange(o, o + h - l) for w, o, l, h in zip(at, offset, low, high)])
    assert sorted(spots.tolist()) == list(range(sum(totals)))
    if rates is None:
        given = np.zeros((at.max() + 1, 150))
        np.add.at(given, (at, row), high - low)
        ends = np.minimum(np.arange(1, len(given) + 1) * 512, sum(totals))
        assert np.abs(given.cumsum(axis=0) - np.outer(ends, np.array(totals) / sum(totals))).max() <= 12


def test_windows_hold_more_sources_than_lanes_and_given_shares(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * 8, f"s{i % 100:02d}") for i in range(2000)], "doc_id long, text string, source string")
    rows = packing.pack(docs, queries.vocabulary()).toPandas()
    held = rows.groupby(["sequence_id", "queue"])["length"].sum().unstack(fill_value=0).iloc[:-1]
    assert ((held.cumsum().sub(1024 / 100 * np.arange(1, len(held) + 1), axis=0)).abs().to_numpy() <= 60).all()
    rows = packing.pack(docs, queries.vocabulary(), shares={"s07": 0.25}).toPandas()
    first = rows[rows.sequence_id == 0].groupby("queue")["length"].sum()
    assert abs(first["s07"] - 256) <= 100 / 2 and first.sum() == 1024  # half a token per queue
    assert rows[rows.start + rows.length == rows.doc_tokens].doc_id.nunique() == 2000


def test_encoder_equals_the_tokenizer():
    encoder, rng = packing.Encoder(queries.vocabulary()), random.Random(1)
    bits = ["a", "b1", " ", "  ", "\n", "\t", "é", "'s", ".", "\x1c", "\x85", "中", "😀", "<|endoftext|>"]
    for text in ("".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)):
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", "\u3000", "a", "7", "#", "a" * 9 + " " * 9_999, " \n" * 5_000 + "x"])
def test_long_runs_have_the_tokenizer_s_ids(unit):
    encoder = packing.Encoder(queries.vocabulary())
    for n in (20_000, 1_000_000 if unit == " " else 100_000):
        text = unit * (n // len(unit))
        same = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(encoder.encode(text), encoder.kind) == np.array(same)).all()


def test_a_text_of_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000, "s"), (2, "\n" * 1_000_000 + "x", "s"), (3, "short", "t")], "doc_id long, text string, source string")
    rows = packing.pack(docs, queries.vocabulary()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id: r.n == r["all"] for r in rows} == {1: True, 2: True, 3: True}


@pytest.mark.parametrize("rates", [None, [5.0, 1.0, 2.0, 2.0]])
def test_schedule_equals_a_token_by_token_round(rates):
    """Every token gives each queue credit at its rate; the queue whose next token has waited for half its credit longest serves."""
    totals = [70, 11, 40, 3]
    schedule, given = packing.Schedule(totals, rates), [0] * 4
    pace = rates or totals
    for n in range(sum(totals)):
        assert schedule.served(np.array([n]))[0].tolist() == given
        open_queues = [q for q in range(4) if given[q] < totals[q]]
        given[min(open_queues, key=lambda q: ((given[q] + 0.5) / pace[q], q))] += 1


def test_isotonic_fit_never_falls():
    rng = np.random.default_rng(4)
    raw = rng.normal(size=300)
    _, value = toxicity.isotonic(raw, (rng.random(300) < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(value) >= -1e-9).all() and 0 <= value.min() and value.max() <= 1


OPERATORS = {
    "suffix": lambda d: suffix.without_repeats(d),
    "simhash": lambda d: vptree.near_duplicates(d),
    "pii": lambda d: pii.personal_data(d),
    "redacted": lambda d: pii.redacted(d),
    "quality": lambda d: weak_labels.quality(d),
    "language": lambda d: crf.languages(d, crf.learn(d)),
    "toxicity": lambda d: toxicity.toxicity(d, toxicity.learn(d, d.selectExpr("doc_id", "doc_id % 2 AS toxic"))),
    "winnowing": lambda d: winnow.benchmark_hits(d, d.selectExpr("doc_id AS item_id", "text").where("doc_id = 4")),
    "packing": lambda d: packing.pack(d, queries.vocabulary()),
    "sharding": lambda d: hilbert.hilbert_shards(d.select("doc_id", "lang"), [d.doc_id % 4], 3),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(odd, empty, name):
    got = OPERATORS[name](odd).collect()
    assert {r.doc_id for r in got} == set(range(8))
    assert name == "packing" or len(got) == len(ODD)
    assert OPERATORS[name](empty).collect() == []


def stages(spark, rows):
    """What each stage of the pipeline makes of the same rows, read from a table like the one that the stage before writes."""
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), "test-stage")
    return {name: stage(spark, docs, SMALL).collect() for name, stage in corpus_pipeline.STAGES}


def prose(spark, n):
    """Good documents without benchmark passages or near copies, and a benchmark text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = weak_labels.without_low_quality(docs)
    clean = vptree.without_near_duplicates(winnow.decontaminated(good, spark.read.parquet(f"{SMALL}/benchmark.parquet")))
    texts = [r.text for r in clean.where("length(text) > 400").orderBy("doc_id").limit(n).collect()]
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.desc(F.length("text")), "item_id").first().text
    assert len(texts) == n
    return texts, bench


def test_rows_with_a_null_id_pass_each_stage_by_their_text(spark):
    texts, bench = prose(spark, 12)
    junk = "%$ ## @@ 00 ]] {{ " * 40
    rows = [(None if i % 2 else i, t, "en", "s") for i, t in enumerate(texts)] + [(None, f"{texts[0]} {bench}", "en", "s"), (None, junk, "en", "s"), (None, None, "en", "s")]
    got = stages(spark, rows)
    kept = {name: [r.text for r in found] for name, found in got.items() if name != "packing"}
    assert set(texts) <= set(kept["quality"]) and junk not in kept["quality"] and None not in kept["quality"]
    assert set(texts) <= set(kept["near_duplicates"])
    assert sorted(kept["decontamination"], key=str) == sorted([*texts, junk, None], key=str)
    assert len(kept["personal_data"]) == len(rows)
    assert sum(r.length for r in got["packing"]) == sum(r.doc_tokens for r in got["packing"] if r.start == 0)
    assert sum(r.start == 0 for r in got["packing"]) == len(rows)


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    texts, bench = prose(spark, 3)
    a, b, c = texts
    junk, dirty = "%$ ## @@ 00 ]] {{ " * 40, f"{a} {bench}"
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (7, c), (8, junk), (8, a), (9, dirty), (9, c)]
    got = stages(spark, [(i, t, "en", "s") for i, t in rows])
    found = {name: sorted((r.doc_id, r.text) for r in got[name]) for name in ("quality", "near_duplicates", "decontamination")}
    assert (8, junk) not in found["quality"] and (8, a) in found["quality"]
    assert [x for x in found["near_duplicates"] if x[1] in texts] == sorted([(3, b), (5, a), (7, c)])
    assert found["decontamination"] == sorted(x for x in rows if x[1] != dirty)


def test_stages_take_odd_rows_clashing_names_and_empty_tables(spark):
    texts, bench = prose(spark, 2)
    names = ["row", "survivor_row", "dirty_digest", "digest", "own_0", "pii_id", "first"]
    rows = [(i, t, "en", "s", *([0] * len(names))) for i, t in enumerate([texts[0], texts[1], texts[0] + " ", None, "", "x " * 500_000, f"{texts[1]} {bench}"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SMALL)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= ({0, 1} if name != "near_duplicates" else {0, 1, 3})
        assert stage(spark, docs.where("false"), SMALL).collect() == []
    assert sum(r.start == 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()) == len(rows)


def test_written_table_leaves_the_session_setting(spark):
    before = spark.conf.get(common.CLEANUP)
    rows = common.written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert rows.count() == 7 and spark.conf.get(common.CLEANUP) == before
