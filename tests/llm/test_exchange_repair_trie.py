"""Exact deduplication, conversation repair and prefix trie against plain loops."""

from __future__ import annotations

import hashlib
import random
import string
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from hubflow.llm import golomb, queries, repair, trie

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize(("count", "span"), [(0, 9), (1, 1), (1, 1 << 50), (10, 10), (999, 1000), (5000, 1 << 40), (3, 1 << 61)])
def test_golomb_codes_are_an_exact_round_trip(count, span):
    rng = np.random.default_rng(count)
    values = np.sort(rng.choice(span, count, replace=False)) if span < 1 << 20 else np.unique(rng.integers(0, span, count))
    code = golomb.golomb_encode(values, span)
    assert golomb.golomb_decode(code, len(values), span).tolist() == values.tolist()
    if len(values) > 100 and span > 1 << 20:  # near the entropy of such a set, far below the values themselves
        assert len(code) * 8 < len(values) * (np.log2(span / len(values)) + 2)


def brute_groups(rows):
    groups = defaultdict(list)
    for nth, (i, t) in enumerate(rows):
        groups[(t or "").translate(FOLD)].append((i is not None, i or 0, -nth))
    out = []
    for i, t in rows:
        group = groups[(t or "").translate(FOLD)]
        known, best, _ = max(group)
        out.append((i, best if known else None, len(group), hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, rng.choice(["Aa b", "aA B", "ÄB", "äB", "", None, " ", "x" * 300_000, "X" * 300_000, f"only {i}"])) for i in range(200)]
    return rows + [(None, "Aa b"), (None, "no id"), (None, "NO ID"), (7, "again"), (7, "again"), (7, "AGAIN")]


@pytest.mark.parametrize("fingerprint", [None, "shiftleft(cast(pmod(length(text), 3) AS long), 60)", "0L"])
def test_exact_groups_match_brute_force(spark, texts, monkeypatch, fingerprint):
    monkeypatch.setattr(golomb, "SENDER_BITS", 3)
    monkeypatch.setattr(golomb, "PER_OWNER", 8)
    docs = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in texts], "doc_id long, text string, row int, sender string, words int").repartition(5)
    got = golomb.exact_duplicates(docs, fingerprint=F.expr(fingerprint) if fingerprint else None).collect()
    want, groups = brute_groups(texts)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == groups and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_survivors_keep_all_columns(spark, texts):
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(texts)], "doc_id long, text string, sender int, words string")
    left = golomb.without_exact_duplicates(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert len({(r.text or "").translate(FOLD) for r in rows}) == len(rows) == brute_groups(texts)[1]
    assert golomb.without_exact_duplicates(docs.where("false")).collect() == []
    assert golomb.exact_duplicates(docs.where("false")).collect() == []


def test_texts_are_not_shuffled_to_find_suspects(spark):
    """What reaches the suspects is read bucket by bucket: the only exchanges are those of codes, bitmaps and suspects."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = golomb._bucketed(docs.select(F.col("doc_id").alias("sender"), F.lit(0).alias("nth"), F.xxhash64("text").alias("fp"), "text"), "sender")
    bits = golomb.suspects_of(rows).hint("shuffle_hash")
    plan = rows.join(bits, "sender")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


# ---- repair


def cheapest(codes):
    """Best (cost, audit) over all edits, by a plain table of states."""

    def with_insertions(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to, new = repair.WRITES[state], (cost + 5, audit + "I")
                best[to] = min(best.get(to, new), new)
        return best

    best = with_insertions({repair.START: (0, "")})
    for code in codes:
        after = {}
        for state, (cost, audit) in best.items():
            options = [(state, cost + 2, "D")]
            if code != "x":
                extra = 5 if code.isupper() else 0
                options.append((repair.WRITES[state], cost + 1 + extra, "R"))
                if code.lower() in repair.NEXT[state]:
                    options.append((repair.NEXT[state][code.lower()], cost + extra, "K"))
            for to, c, edit in options:
                after[to] = min(after.get(to, (c, audit + edit)), (c, audit + edit))
        best = with_insertions(after)
    return min(best[s] for s in repair.VALID_ENDS if s in best)


NAMES = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}


@pytest.mark.parametrize("part", [1, 2, 5, 16])
def test_search_proves_the_cheapest_audit(monkeypatch, part):
    monkeypatch.setattr(repair, "PART", part)
    rng = random.Random(part)
    for _ in range(600):
        codes = "".join(rng.choice("suuaaxxoSUAO") for _ in range(rng.randint(0, 20)))
        at = repair.Repair("c")
        for n, code in enumerate(codes):
            text = "" if code == "x" else f"t{n}" if code.isupper() else f"t{n}."
            at.add(n, NAMES[code.lower()], text, False)
        assert at.result()[6:8] == cheapest(codes)


def plain_repair(rows):
    """``rows`` of one conversation after damage, in order."""
    seen, faults, codes = set(), [], []
    for turn, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        codes.append(repair.code_of(role, fault))
    cost, audit = cheapest(codes)
    lines, left, state = [], list(rows), repair.START
    for edit in audit:
        role, text = ("", "") if edit == "I" else left.pop(0)[1:]
        if edit != "D":
            state = repair.NEXT[state][role[:1]] if edit == "K" else repair.WRITES[state]
            lines.append(f"{role if edit == 'K' else repair.ROLE[state]}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def hurt(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0)) for c, x in out.items()}


def test_repair_matches_plain_loops(spark):
    rng = random.Random(11)
    rows = []
    for conv in [*range(150), None]:
        for turn in [*rng.sample(range(12), rng.randint(1, 9)), *([None] if rng.random() < 0.2 else [])]:
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(["a.", "b?", "c", " \n", "", None, "é! ", "long " * 20_000 + "."])))
    rows += [(900, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(500)]
    rows += [(901, t, None, None) for t in range(3)]
    table = spark.createDataFrame([(*r, 0, "x", True) for r in rows], "conv_id long, turn long, role string, text string, nth int, conv string, gone boolean")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(repair.damaged(table)).collect()}
    assert got == {c: plain_repair(x) for c, x in hurt(rows).items()}


def test_repair_of_gone_and_empty_conversations(spark):
    kinds = {(c, t): zlib.crc32(f"{c}:{t}".encode()) % 20 for c in range(400) for t in range(1)}
    conv = next(c for (c, _), k in kinds.items() if k == 0)
    got = repair.repaired(repair.damaged(spark.createDataFrame([(conv, 0, "user", "a.")], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(repair.damaged(empty)).collect() == [] and trie.prefix_trie(empty).collect() == []


def test_repeated_rows_are_neighbours_and_duplicates(spark):
    rows = [(1, 5, "user", "a."), (1, 5, "user", "a."), (1, 5, "assistant", "b."), (1, 5, "assistant", "b."), (1, 6, "user", "a.")]
    (got,) = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert (got.duplicate, got.blank, got.gaps) == (3, 0, 0) and got.audit == cheapest("axuxx")[1]


# ---- trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    if not members:
        return []
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_matches_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for conv in rng.sample(range(400), 230):
        for turn in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((conv, turn if rng.random() < 0.95 or turn else None, rng.choice(["user", None, ""]), rng.choice(["é", "a", None, "", "zz"])))
    rows += [(1000, t, "user", "same") for t in range(90)] + [(1001, t, "user", "same") for t in range(80)] + [(1005, t, "user", "same" if t < 60 else "other") for t in range(75)]
    rows += [(None, 1, "user", "nobody"), (2000, 1, "user", "twice"), (2000, 1, "user", "twice"), (2001, 0, "user", "long " * 50_000)]
    assert len({(c, t) for c, t, _, _ in rows}) == len(rows) - 1
    table = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, task int, node string, idx int").repartition(7)
    got = sorted((tuple(r) for r in trie.prefix_trie(table).collect()), key=str)
    assert got == brute_trie(rows)


def test_prefixes_of_a_conversation_in_many_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, t, "user", str(t % 3)) for t in range(120)] + [(6, t, "user", str(t % 3)) for t in range(50)]
        turns = trie.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert turns.where("conv_id = 7").select("task").distinct().count() > 1
        assert sorted((r.conv_id, r.idx) for r in turns.select("conv_id", "idx").collect()) == sorted((c, t) for c, t, _, _ in rows)
        assert sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("shape", ["chain", "random"])
def test_contraction_of_any_tree(spark, shape):
    rng, n = random.Random(3), 120
    parent = {0: None} | {k: {"chain": k - 1, "random": rng.randrange(k)}[shape] for k in range(1, n)}
    depth = {0: 0}
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
    value = {k: rng.randint(-5, 9) for k in parent}
    total = dict(value)
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
    tree = spark.createDataFrame([(k, p, depth[k], value[k], 1) for k, p in parent.items()], "node long, parent long, depth long, v long, one long")
    got = {r.node: r.v for r in trie.subtree_totals(tree, ["v", "one"]).collect()}
    assert got == total


@pytest.mark.parametrize("name", ["op11_golomb_exact_dedup", "op12_branch_and_bound_repair", "op13_contracted_prefix_trie"])
def test_new_queries_match_sql(spark, name):
    from verify import connect, differences

    assert not differences(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLE_SQL[name])
