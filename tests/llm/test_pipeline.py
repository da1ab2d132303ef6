import random

import pytest

import corpus_pipeline
from edgeloom.llm.pieces import PieceCodec, PieceModel, default_model

from .helpers import LONG, corpus, sentence

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(2)
    common = "a line that is the same in many of these documents"
    rows = [(i, sentence(rng, "en", 60) + f"\n{common}\n" + sentence(rng, "en", 30), "en", "ab"[i % 2]) for i in range(30)]
    rows += [(100, rows[3][1].replace("\n" + common, ""), "en", "a"), (101, None, "en", None), (102, "", "en", "b"), (103, None, None, None), (4, rows[4][1], "en", "a"), (104, "words", "en", "c"), (105, LONG, "en", "b")]
    return corpus(spark, rows).selectExpr("*", "'extra' AS label", "7 AS size", "8 AS copies", "'x' AS score")


def stages(spark, docs, upto):
    for name, step in corpus_pipeline.STAGES[:upto]:
        docs = step(spark, docs, DATA)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return docs


def test_stages_keep_the_columns_of_documents(spark, documents):
    for upto in range(1, len(corpus_pipeline.STAGES)):
        assert tuple(stages(spark, documents, upto).columns) == corpus_pipeline.COLUMNS, upto


def test_whole_run_on_odd_rows(spark, documents, tmp_path):
    """Every decision takes effect: shared lines once, one of each group of near copies, ids of what is left."""
    deduped = {}
    for r in stages(spark, documents, 2).collect():
        deduped.setdefault(r.doc_id, []).append(r.text)
    shared = [i for i, texts in deduped.items() for t in texts if "the same in many" in (t or "")]
    assert len(set(shared)) <= 1
    left = [r.doc_id for r in stages(spark, documents, 3).collect()]
    assert not {3, 100} <= set(left) and left.count(4) == 2  # rows of one id are one document
    final = stages(spark, documents, 5).collect()
    codec = PieceCodec(PieceModel.read(default_model()))
    mixed = {r.doc_id: r.text for r in stages(spark, documents, 4).collect()}
    assert {r.doc_id for r in final} == set(mixed) and all(r.ids == codec.encode(mixed[r.doc_id] or "")[0].tolist() for r in final)


def test_no_rows(spark, tmp_path):
    assert stages(spark, corpus(spark, []), 5).count() == 0
