import numpy as np
import pytest

from pyspark.sql import functions as F

from edgeloom.llm import neighbours
from edgeloom.llm.grid_join import near_vectors
from edgeloom.llm.neighbours import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"
BROKEN = [(9001, None, 1), (9002, [0.0] * 8, 1), (9003, [float("nan")] + [1.0] * 7, 1), (9004, [float("inf")] + [1.0] * 7, 1), (9005, [None] + [1.0] * 7, 1), (9006, [], 1)]


def vectors(n, d=8, seed=1, labels=3, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), d))
    x = (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d))).astype(np.float32)
    return [(i * 3, [float(v) for v in row], int(rng.integers(0, labels))) for i, row in enumerate(x)]


def cosines(rows):
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_links_against_brute_force(spark, stage):
    rows = vectors(260)
    rows += [(4000 + i, rows[5][1], rows[5][2]) for i in range(7)] + [(5000, [v * 2 for v in rows[6][1]], rows[6][2]), rows[8]]
    alone = BROKEN + [(9100, rows[0][1], None), (None, rows[0][1], 1)]
    sims, label = cosines(rows), np.array([r[2] for r in rows])
    linked = (sims >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    least = np.array([r[0] for r in rows])
    while True:
        further = np.array([min([least[i], *least[linked[i]]]) for i in range(len(rows))])
        if (further == least).all():
            break
        least = further
    want = [(r[0], int(linked[i].sum()), int(least[i]), r[0] == least[i]) for i, r in enumerate(rows)] + [(r[0], 0, r[0], True) for r in alone]
    table = spark.createDataFrame(rows + alone, SCHEMA).selectExpr("*", "1 AS rep", "2 AS kept", "3 AS copies")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table, stage).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_vectors(spark, stage):
    assert near_vectors(spark.createDataFrame([], SCHEMA), stage).count() == 0
    assert nearest(spark.createDataFrame([], SCHEMA), F.lit(True), stage.__class__(spark)).count() == 0


def check_nearest(spark, stage, rows, alone, divisor, k, least):
    out = nearest(spark.createDataFrame(rows + alone, SCHEMA).selectExpr("*", "1 AS rank", "2 AS score"), F.col("vec_id") % divisor == 0, stage, k).collect()
    sims, ids = cosines(rows), np.array([r[0] for r in rows])
    got = {}
    for r in out:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    queries = [i for i in range(len(rows)) if ids[i] % divisor == 0]
    assert set(got) == {int(ids[i]) for i in queries if len(rows) > 1}
    hits = 0
    for i in queries:
        want = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-round(sims[i, j], 12), ids[j]))[:k]
        mine = got[int(ids[i])]
        assert sorted(mine) == list(range(1, min(k, len(rows) - 1) + 1))
        for v, s in mine.values():
            assert s == pytest.approx(sims[i, list(ids).index(v)], abs=1e-12)
        hits += len({int(ids[j]) for j in want} & {v for v, _ in mine.values()})
    assert hits >= least * sum(min(k, len(rows) - 1) for _ in queries)


def test_nearest_small_tables_ties_and_broken_rows(spark, stage):
    rows = vectors(60) + [(4000 + i, [1.0] * 8, 1) for i in range(8)]
    check_nearest(spark, stage, rows, BROKEN + [(None, [1.0] * 8, 1)], 10, 5, 1.0)
    check_nearest(spark, stage.__class__(spark), rows[:3], [], 1, 5, 1.0)


def test_recall_of_the_walk(spark, stage, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 128)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(rng.normal(size=(1500, 24)).astype(np.float32))]
    check_nearest(spark, stage, rows, [], 50, 5, 0.9)


def test_recall_among_close_vectors_and_of_each_length(spark, stage, monkeypatch):
    """Within a cluster cosines differ in the fifth digit only, which 8 or 16 bits a component do not tell."""
    monkeypatch.setattr(neighbours, "LEAF", 128)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 24))[rng.integers(0, 3, 1200)] + 0.003 * rng.normal(size=(1200, 24))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    check_nearest(spark, stage, rows, [], 50, 5, 0.9)
    shorter = [(i + 5000, [float(v) for v in r], 0) for i, r in enumerate(rng.normal(size=(300, 8)).astype(np.float32))]
    found = nearest(spark.createDataFrame(rows[:400] + shorter, SCHEMA), F.col("vec_id") % 50 == 0, stage.__class__(spark)).collect()
    sims = cosines(shorter)
    np.fill_diagonal(sims, -2)
    want = {(5000 + q, 5000 + int(j)) for q in range(0, 300, 50) for j in np.argsort(-sims[q])[:5]}
    got = {(r.query_id, r.vec_id) for r in found}
    assert len(want & got) >= 0.9 * len(want) and all((q < 5000) == (v < 5000) for q, v in got)
    assert {q for q, _ in got} == {*range(0, 400, 50), *range(5000, 5300, 50)}
