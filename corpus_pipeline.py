"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.line_dedup import line_dedup
from edgeloom.llm.mixing import mix
from edgeloom.llm.pieces import default_model, encode_documents
from edgeloom.llm.shingle_join import drop_near_copies
from edgeloom.llm.toxicity import fitted, score
from edgeloom.session import Stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame, n_chars: Column | None = None) -> DataFrame:
    return docs.select(*[n_chars.cast("long").alias(c) if c == "n_chars" and n_chars is not None else F.col(c) for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    return _as_documents(score(docs, fitted(spark, sf_dir)).where("predicted = 0"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one with the largest id; ``n_chars`` follows the text."""
    return _as_documents(line_dedup(docs, Stage(spark)), F.length("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return _as_documents(drop_near_copies(docs, Stage(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents without a word, which weigh nothing, stay once."""
    mixed = mix(docs, Stage(spark)).withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))
    return _as_documents(mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, and digests of the ids and of the text decoded from them."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), default_model(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("shingle_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The stages train a network, search for near copies and solve for rates, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    stage, docs = Stage(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.table(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
