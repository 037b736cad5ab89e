"""The nearest-neighbour forest with small limits, so that every path runs, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from hubflow.llm import rp_forest

SCHEMA = "vec_id long, embedding array<double>, id long, cls string, q int, page int"


def brute(rows, k=20):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in sorted({int(x) for x in ids if x % 20 == 0}):
        (own,) = np.flatnonzero(ids == i)
        score = (v * v[own]).sum(axis=1)
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in best]
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, [float(x) for x in v], 0, "x", 0, 0) for i, v in rows], SCHEMA).repartition(6)
    got = rp_forest.nearest(table, "vec_id % 20 = 0", **options).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture
def small(monkeypatch):
    for name, value in {"LEAF_ROWS": 8, "SPLIT_ROWS": 24, "STEP": 2, "SAMPLED_PER_LEAF": 8, "PAGE_BITS": 2, "ROWS_PER_TASK": 60, "QUERIES_PER_TASK": 7, "PAIRS_AT_ONCE": 300, "CHILDREN": 4}.items():
        monkeypatch.setattr(rp_forest, name, value)


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    return [(i, v) for i, v in enumerate(rng.normal(size=(n, dims)) * rng.uniform(0.5, 2, size=(n, 1)))]


def test_all_leaves_of_many_levels_give_the_exact_answer(spark, small):
    rows = vectors(900, 12, 1)
    rows += [(900 + i, rows[40][1]) for i in range(60)]  # one vector held by many
    got, want = found(spark, rows, trees=2, visited=5000), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_leaves_stay_small_and_a_budget_keeps_its_recall(spark, small):
    rows = vectors(1500, 6, 2)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "cls long, v array<double>")
    longest = float(max(np.linalg.norm(v) for _, v in rows))
    index = rp_forest.Index(table, table.where("cls % 20 = 0").select("cls"), len(rows), 6, longest, 4, 60)
    sizes = index.placed.groupBy("id").count().toPandas()
    assert sizes["count"].max() <= 24 and sizes["id"].map(int.bit_length).nunique() > 1 and sizes["id"].map(int.bit_length).max() > 3 + 2 * 2
    assert index.placed.groupBy("cls").count().where("count <> 4").count() == 0
    assert index.visits.groupBy("q").count().where("count > 60").count() == 0
    got, want = found(spark, rows, trees=4, visited=60), brute(rows)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_rows_of_one_id_and_rows_that_cannot_be_parted(spark, small):
    base = np.ones(4)
    rows = [(i, base * 2.0 ** -(i % 40)) for i in range(200)]  # one direction only
    got, want = found(spark, rows, trees=1, visited=5000), brute(rows)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    rows = rp_forest.nearest(table, "vec_id = 20").collect()
    assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1.0), (1, 0.5), (3, 0.5)]
