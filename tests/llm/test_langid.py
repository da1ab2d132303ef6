import random

from edgeloom.llm.common import held_out
from edgeloom.llm.langid import fit, identify

from pyspark.sql import functions as F

from .helpers import TONGUES, corpus, sentence


def rows(n=150):
    rng = random.Random(5)
    return [(i, sentence(rng, lang, rng.randint(5, 80)), lang) for i, lang in ((i, list(TONGUES)[i % len(TONGUES)]) for i in range(n))]


def test_held_out_accuracy_and_edge_cases(spark):
    made = rows()
    docs = corpus(spark, made)
    net = fit(docs.where(~held_out(F.col("doc_id"))), per_language=60, steps=120)
    odd = [(1000, None, None), (1001, "", None), (1002, "123 456 !?", "en"), (1005, "½ ² Ⅷ ①", "en"), (None, made[0][1], None), (1003, made[1][1] * 300, None), (1004, made[2][1], "zz"), (1004, made[2][1], "zz")]
    out = identify(corpus(spark, made + odd).selectExpr("*", "'x' AS score", "0 AS label"), net).collect()
    right = [r.lang_pred == r.lang for r in out if r.doc_id is not None and r.doc_id < 1000]
    assert sum(right) / len(right) > 0.95
    got = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert got[1000] == got[1001] == got[1002] == got[1005] == ("und", 0.0)
    assert got[1003][0] == "de" and got[1004][0] == "fr" and all(0 <= r.score <= 1 for r in out) and len(out) == len(made) + len(odd)


def test_nothing_to_learn_from(spark):
    assert fit(corpus(spark, [])) is None
    assert [r.lang_pred for r in identify(corpus(spark, [(1, "text")]), None).collect()] == ["und"]
    only = fit(corpus(spark, [(1, "some text", "en"), (2, "more text", "en")]), steps=5)
    assert [r.lang_pred for r in identify(corpus(spark, [(1, "text"), (2, "7")]), only).orderBy("doc_id").collect()] == ["en", "und"]
    assert identify(corpus(spark, []), only).count() == 0


def test_labels_without_letters_do_not_stop_training(spark):
    made = rows()
    late = "1 " * 400 + "über die Straße"
    odd = [(2000, "123 456", "x1"), (2001, " \n\t ", "x2"), (2002, None, "x3"), (2004, late, "late")]
    net = fit(corpus(spark, made + odd), per_language=60, steps=120)
    assert net.labels == sorted(["en", "de", "fr", "late"])
    out = identify(corpus(spark, made), net).collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert fit(corpus(spark, odd[:3])) is None


def test_every_language_is_learned(spark):
    net = fit(corpus(spark, [(i, f"text number {i}", f"l{i % 450}") for i in range(500)]), steps=1)
    assert len(net.labels) == 450
