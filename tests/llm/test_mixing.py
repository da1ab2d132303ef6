import random

import pytest

from edgeloom.llm.mixing import mix

from .helpers import corpus

def fill(sizes, weights=(5, 2, 1), ceiling=3):
    """Targets by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > ceiling * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(ceiling * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = []
    for source, n in (("b", 150), ("a", 40), (None, 60), ("ä", 10), ("z", 90), ("Z", 1)):
        made += [(len(made) + i, " \t".join("w" * rng.randint(1, 4) for _ in range(min(400, int(rng.expovariate(1 / 40))))), "en", source) for i in range(n)]
    return made + [(9001, None, "en", "a"), (9002, "", "en", "b"), (None, "one two", "en", "b"), (9003, "same copy", "en", "z"), (9003, "same copy", "en", "z")]


def test_targets_sums_and_limits(spark, stage, rows):
    docs = corpus(spark, rows).selectExpr("*", "'t' AS target", "7 AS tilt", "8 AS mean")
    got = mix(docs, stage).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 3 * r.size and (r.tilt, r.mean) == (7, 8)
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    largest = {s: max((len((r[1] or "").split()) for r in rows if r[3] == s), default=0) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
    again = mix(corpus(spark, rows[::-1]), stage.__class__(spark)).collect()
    key = lambda r: (repr(r.doc_id), r.text or "")
    assert [(key(r), r.taken) for r in sorted(got, key=key)] == [(key(r), r.taken) for r in sorted(again, key=key)]


def test_no_rows_and_no_words(spark, stage):
    assert mix(corpus(spark, []), stage).count() == 0
    out = mix(corpus(spark, [(1, None), (2, "  ")]), stage.__class__(spark)).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
