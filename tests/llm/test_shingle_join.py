import random
from collections import Counter

import pyarrow as pa
import pytest

from edgeloom.llm import shingle_join
from edgeloom.llm.shingle_join import RECALL, branching, drop_near_copies, near_copies, repetitions, shingle_sets, survival

from .helpers import LONG, corpus, words


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    """Links per row, and the smallest id reachable."""
    sets = [grams(t) if i is not None else set() for i, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i) if i is not None else None
    return sorted(((i, links[k], least[root(k)], i == least[root(k)] or i is None) for k, (i, _) in enumerate(rows)), key=repr)


def made():
    rng = random.Random(6)
    passage, rows = words(rng, 55), []
    for k in range(40):
        rows.append(words(rng, rng.randint(20, 200)))
        if k % 3 == 0:
            rows[-1][10:10] = passage
    for k in range(25):  # copies with 1 to 12 words changed, also copies of copies
        copy = list(rng.choice(rows))
        for _ in range(rng.choice((1, 1, 2, 3, 5, 12))):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append(copy)
    base = words(rng, 150)
    for k in range(90):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(150)] = f"y{k}"
        rows.append(copy)
    rows += [rows[3]] * 5 + [["one", "two"]] * 3 + [["one"]] + [LONG.split()] * 2 + [LONG.split()[:-1] + ["other"]]
    rng.shuffle(rows)
    return [(7 * k % 1009, " ".join(r)) for k, r in enumerate(rows)]


def test_against_brute_force(spark, stage):
    rows = made()
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (None, rows[0][1]), (2003, "\n" + rows[1][1].replace(" ", "\t ") + " "), rows[2]]
    docs = corpus(spark, rows).selectExpr("*", "1 AS n_links", "2 AS rep", "3 AS bucket", "4 AS kept")
    got = sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in near_copies(docs, stage).collect()), key=repr)
    assert got == brute(rows)


def test_drop_keeps_one_of_each_group(spark, stage):
    rows = made()[:80] + [(None, "no id"), (5000, None)]
    want = {i for i, _, _, kept in brute(rows) if kept}
    out = drop_near_copies(corpus(spark, rows).withColumnRenamed("n_chars", "component_id"), stage).collect()
    assert {r.doc_id for r in out} == want and len(out) == len(want)
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "component_id"}


def test_versions_under_one_id_are_one_document(spark, stage):
    rng = random.Random(1)
    one, two = " ".join(words(rng, 50)), " ".join(words(rng, 50))
    out = near_copies(corpus(spark, [(5, one), (5, two), (6, one), (7, two), (8, "alone")]), stage).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_no_rows(spark, stage):
    assert near_copies(corpus(spark, []), stage).count() == 0


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four", "one two three four five"])
def test_slice_of_one_short_text(text):
    alone, beside = shingle_sets(pa.array([text]))[0], shingle_sets(pa.array([text, "six seven eight nine ten eleven"]))[0]
    assert len(alone) == 1 and alone.tolist() == beside.tolist()


def test_table_of_one_short_text(spark, stage):
    out = near_copies(corpus(spark, [(1, "hello world"), (2, None)]), stage).collect()
    assert sorted((r.doc_id, r.n_links, r.kept) for r in out) == [(1, 0, True), (2, 0, True)]


def test_repetitions_reach_the_recall_at_every_depth():
    chances = survival(0.8, branching(0.8))
    assert len(chances) == shingle_join.DEPTH and chances == sorted(chances, reverse=True)
    assert all(1 - (1 - c) ** repetitions(0.8) >= RECALL for c in chances)
    assert 1 - (1 - chances[-1]) ** (repetitions(0.8) - 1) < RECALL
    # Nothing agrees, or everything.
    assert survival(0.0, 0.25)[-1] == 0 and survival(1.0, 0.25)[-1] == 1 and repetitions(1.0) == 1


def test_pairs_in_deep_buckets(spark, stage, monkeypatch):
    """Every word is in half of the texts, so buckets only halve and are split down to the last depth; planted pairs lie just above 0.8."""
    monkeypatch.setattr(shingle_join, "SMALL", 2)
    rng, known, rows = random.Random(8), [f"s{k}" for k in range(400)], []
    for k in range(1000):
        mixed = rng.sample(known, 400)
        rows += [(2 * k, " ".join(mixed[:200])), (2 * k + 1, " ".join(mixed[22:222]))]
    sets = [set(t.split()) for _, t in rows]
    links = Counter(i for a in range(2000) for b in range(a) if 9 * len(sets[a] & sets[b]) >= 4 * 400 for i in (a, b))
    assert links == {i: 1 for i in range(2000)}
    out = near_copies(corpus(spark, rows), stage, words=1).collect()
    assert len(out) == 2000 and all(r.component_id == r.doc_id - r.doc_id % 2 * r.n_links for r in out)
    assert sum(r.n_links for r in out) / 2000 >= 0.997


def test_blocks_dealt_in_shares_give_the_same(spark, stage, monkeypatch):
    """The group of near copies has many blocks, so its sets move often; they are compared in shares, each block in one of them."""
    monkeypatch.setattr(shingle_join, "BLOCK", 16)
    monkeypatch.setattr(shingle_join, "COPIES", 1)
    rows = made()
    got = sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in near_copies(corpus(spark, rows), stage).collect()), key=repr)
    assert got == brute(rows) and "compared_1" in stage.names() and "texts" not in stage.names()
