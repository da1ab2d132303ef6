import random

from edgeloom.llm.toxicity import fit, score

from .helpers import LONG, corpus, words

BAD = ["grumblefool", "nastywort"]


def made(n=160):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        text = words(rng, rng.choice((5, 30, 120)), of=300)
        if i % 3 == 0:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(("", "s", ".", "ly")))
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    return docs, labels


def test_held_out_scores_and_edge_cases(spark):
    docs, labels = made()
    table = spark.createDataFrame(labels + labels[:3] + [(None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    net = fit(corpus(spark, docs[:120]), table.where("doc_id < 120"), steps=60)
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, LONG), (1004, LONG + " grumblefool nastywort grumblefools"), (None, docs[0][1]), (1005, docs[0][1]), (1005, docs[0][1])]
    out = score(corpus(spark, docs + odd).selectExpr("*", "'x' AS score", "1 AS predicted", "3 AS toxic"), net).collect()
    got = {r.doc_id: r.score for r in out}
    truth = dict(labels)
    right = [(got[i] >= 0.3) == bool(truth[i]) for i, _ in docs[120:]]
    assert sum(right) / len(right) > 0.9
    assert len(out) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.toxic == 3 for r in out)
    assert got[1000] == got[1001] == got[1002] and got[1004] > got[1003]


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    net = fit(corpus(spark, [(1, "a")]), labels)
    assert [r.score < 0.01 for r in score(corpus(spark, [(1, "a"), (2, None)]), net).collect()] == [True, True]
    assert score(corpus(spark, []), net).count() == 0
