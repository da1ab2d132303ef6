"""Line de-duplication: lines found in many documents stay in one of them.

Lines are exploded and reduced to a 128-bit hash of their key; documents are counted per hash in two steps (distinct
pairs first, then a count with map-side combine), so a line that a third of all documents hold is no hot group. The
join back to the lines is left to adaptive skew splitting. Texts are shuffled once, with the positions to drop.

Defined results: a null or empty text is one empty line and becomes ''. Rows without an id keep all their lines and
are not counted. Rows repeated with the same id count as one document. Columns ``n_lines`` and ``n_dropped`` are
replaced if the input has them; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import Stage

from .common import WHITE, ascii_lower, table

MIN_DOCS, MIN_CHARS = 3, 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, stage: Stage, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with ``text`` reassembled from the lines that stay, and ``n_lines`` (before), ``n_dropped``.

    A line whose key (white space stripped, A-Z lower-cased) has ``min_chars`` code points or more and occurs in
    ``min_docs`` documents or more stays only in the largest ``doc_id`` that holds it.
    """
    version = F.xxhash64("text")  # tells rows apart that share an id
    keyed = stage.table(
        docs.where("doc_id is not null")
        .select("doc_id", version.alias("version"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
        .withColumn("key", ascii_lower(F.btrim("line", F.lit(WHITE))))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "version", "place", F.unhex(F.md5("key")).alias("hash")),
        "line_keys",
    )
    common = stage.table(  # stored, so that both sides of the join are shuffled anew and hot hashes can be split
        keyed.select("hash", "doc_id").distinct()
        .groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).select("hash", "keeper"),
        "common_lines",
    )
    dropped = (
        keyed.join(common, "hash").where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("__doc_id"), F.col("version").alias("__version"))
        .agg(F.collect_set("place").alias("__places"))
    )
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    split = docs.select(*rest).join(dropped, (F.col("doc_id") == F.col("__doc_id")) & (version == F.col("__version")), "left").select(*rest, "__places", _lines(F.col("text")).alias("__lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__places"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("__lines"), i)), "\n")
    return split.select(
        *[F.when(F.col("__places").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in rest],
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__places").isNull(), 0).otherwise(F.size("__places")).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines before, lines dropped and the digest of what stays."""
    out = line_dedup(table(spark, sf_dir, "documents"), Stage(spark))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
placed AS (SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM numbered),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.row, k.doc_id, k.place, k.line, coalesce(c.keeper <> k.doc_id, false) AS drops FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT drops), '')) AS kept_sha256
FROM judged GROUP BY row
"""
