"""Matchers, ensemble, run statistics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import temporal_confidence, two_decimals, within
from ..operators import combine as cb
from ..operators.matchers import ExactMatcher, LinkInputs, SkuMatcher, TemporalMatcher, View, raw_edges
from ..operators.rangejoin import window_join
from ..operators.stats import edge_classes, proof_figures, raw_edge_counts, run_stats
from ..operators.validate import checked_inputs
from ..plans.linkage import Ensemble, run
from ..recipe import EXACT, SKU, TEMPORAL, Recipe
from ..session import Stage
from ..sources import testviews as tv
from ..sources.testviews import mac_sql, with_views
from .common import Catalog, test_hasher

catalog = Catalog()
RECIPE = Recipe()
W = RECIPE.window_sec
FLAT_EDGE = ["from", "to", "kind", "confidence", "proof", "recipe", "at", "notes"]


def setting(spark: SparkSession) -> tuple[Ensemble, Stage]:
    return Ensemble.default(RECIPE, test_hasher(spark)), Stage(spark)


def compact(spark: SparkSession, sf_dir: str) -> tuple[View, Ensemble, Stage]:
    ensemble, stage = setting(spark)
    return ensemble.view(tv.link_inputs(spark, sf_dir, ensemble.hasher), stage), ensemble, stage


def flat(edges: DataFrame) -> DataFrame:
    return edges.select(*FLAT_EDGE, F.col("meta.schema").alias("schema_name"), F.col("meta.id_mode").alias("id_mode"))


def _matcher_edges(spark: SparkSession, sf_dir: str, evidence, billed: str) -> DataFrame:
    hasher = test_hasher(spark)
    view = View.raw(tv.link_inputs(spark, sf_dir, hasher)).stored(Stage(spark), ("by_sku", "index" if billed == "items" else billed))
    return raw_edges(evidence(view), hasher).select(*FLAT_EDGE)


# ---------------------------------------------------------------- raw edges as SQL


def _edge_sql(kind: str, to: str, conf: str, detail: str, matcher: str, note: str, source: str) -> str:
    text = f"""u."user" || '|' || {to} || '|{kind}|' || {detail}"""
    return (
        f"""SELECT u."user" AS "from", {to} AS "to", '{kind}' AS kind, CAST({conf} AS DOUBLE) AS confidence, {mac_sql(text)} AS proof, """
        f"""'{matcher}/v1' AS recipe, u."at" AS "at", {note} AS notes FROM {source}"""
    )


_DET = f"'{EXACT}|' || u.sku || '|strict'"
_SKU = f"'{SKU}|' || u.sku"
_DIFF = 'abs(u."at" - t.created_at)'
_CONF = f"least(CAST(0.6 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(0.6 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST({_DIFF} AS DOUBLE) / CAST({W} AS DOUBLE))))"
_INDEX = "SELECT sub_id, item_id, count(*) AS hits, bool_or(item_kind = 'price') AS is_price FROM items GROUP BY sub_id, item_id"


def _item_edges(conf: str, detail: str, matcher: str, source: str, is_price: str) -> str:
    parts = []
    for kind, word, test in (("user->price", "price", is_price), ("user->product", "product", f"NOT ({is_price})")):
        parts.append(_edge_sql(kind, "u.sku", conf, detail, matcher, f"'exact SKU-{word} match'", f"{source} WHERE {test}"))
    return " UNION ALL ".join(parts)


EDGES = {
    "exact_subscription_edges": _edge_sql("user->subscription", "t.id", "1", _DET, EXACT, "'exact customer ID match'", 'usages u JOIN subs t ON u."user" = t.customer'),
    "exact_invoice_edges": _edge_sql("user->invoice", "t.id", "1", _DET, EXACT, "'exact customer ID match'", 'usages u JOIN invs t ON u."user" = t.customer'),
    "exact_item_edges": _item_edges("1", _DET, EXACT, 'usages u JOIN items i ON u."user" = i.customer AND u.sku = i.item_id', "i.item_kind = 'price'"),
    "temporal_subscription_edges": _edge_sql(
        "user->subscription", "t.id", _CONF, f"'{TEMPORAL}|' || {_DIFF}", TEMPORAL, f"'usage within ' || {_DIFF} || 's of subscription creation'",
        f'usages u JOIN subs t ON u."at" BETWEEN t.created_at - {W} AND t.created_at + {W}'),
    "temporal_invoice_edges": _edge_sql(
        "user->invoice", "t.id", _CONF, f"'{TEMPORAL}|' || {_DIFF}", TEMPORAL, f"'usage within ' || {_DIFF} || 's of invoice creation'",
        f'usages u JOIN invs t ON u."at" BETWEEN t.created_at - {W} AND t.created_at + {W}'),
    "sku_subscription_edges": _edge_sql(
        "user->subscription", "x.sub_id", "0.8", _SKU, SKU, "'SKU matched subscription ' || CASE WHEN x.is_price THEN 'price' ELSE 'product' END",
        f"usages u JOIN items i ON u.sku = i.item_id JOIN ({_INDEX}) x ON x.sub_id = i.sub_id AND x.item_id = i.item_id"),
    "sku_item_edges": _item_edges(
        "0.9", _SKU, SKU, f"usages u JOIN items i ON u.sku = i.item_id JOIN ({_INDEX}) x ON x.sub_id = i.sub_id AND x.item_id = i.item_id", "x.is_price"),
}
NEEDS = {"exact_subscription_edges": ("usages", "subs"), "exact_invoice_edges": ("usages", "invs"), "exact_item_edges": ("usages", "items"),
         "temporal_subscription_edges": ("usages", "subs"), "temporal_invoice_edges": ("usages", "invs"),
         "sku_subscription_edges": ("usages", "items"), "sku_item_edges": ("usages", "items")}

_BUILD = {
    "exact_subscription_edges": lambda v: ExactMatcher().subscriptions(v),
    "exact_invoice_edges": lambda v: ExactMatcher().invoices(v),
    "exact_item_edges": lambda v: ExactMatcher().items(v),
    "temporal_subscription_edges": lambda v: TemporalMatcher(W).subscriptions(v),
    "temporal_invoice_edges": lambda v: TemporalMatcher(W).invoices(v),
    "sku_subscription_edges": lambda v: SkuMatcher().subscriptions(v),
    "sku_item_edges": lambda v: SkuMatcher().items(v),
}

for _name, _build in _BUILD.items():
    catalog.add(_name, with_views(EDGES[_name], *NEEDS[_name]))(lambda spark, sf_dir, build=_build, billed=NEEDS[_name][1]: _matcher_edges(spark, sf_dir, build, billed))

# ---------------------------------------------------------------- combined edges as SQL

_VIEWS = ("usages", "subs", "invs", "items")
_RAW = " UNION ALL ".join(f"({sql})" for sql in EDGES.values())


def _weight(matcher: str) -> str:
    return f"greatest(coalesce(max(CASE WHEN split_part(recipe, '/', 1) = '{matcher}' THEN CAST({RECIPE.weight(matcher)} AS DOUBLE) * confidence END), 0), 0)"


_SCORED = f"""SELECT "from", "to", kind, (CAST(0 AS DOUBLE) + {_weight(EXACT)} + {_weight(TEMPORAL)}) + {_weight(SKU)} AS score, max("at") AS "at",
    count(*) AS edges, max(confidence) AS best_confidence, string_agg(proof, ',' ORDER BY proof) AS proofs,
    string_agg(DISTINCT notes, '; ' ORDER BY notes) AS joined FROM raw GROUP BY "from", "to", kind"""
_NOTE = "joined || ' (score=' || printf('%.2f', score) || ')'"
_LINKED = f"""SELECT "from", "to", kind, least(CAST(1 AS DOUBLE), score) AS confidence,
    {mac_sql('''"from" || '|' || "to" || '|' || kind || '|ensemble|' || proofs''')} AS proof, '{RECIPE.label}' AS recipe, "at",
    {_NOTE} AS notes,
    'link-edge/v1' AS schema_name, 'strict' AS id_mode FROM scored WHERE score >= {RECIPE.threshold}"""
_ALL = {"raw": _RAW, "scored": _SCORED, "linked": _LINKED}


@catalog.add("linked_edges", with_views("SELECT * FROM linked", *_VIEWS, extra=_ALL))
def linked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensemble, stage = setting(spark)
    return flat(ensemble.run(tv.link_inputs(spark, sf_dir, ensemble.hasher), stage))


# Every seventh subscription and fifth usage second keep their raw customer; their items must not link either.
_SPOILED = {
    "good_usages": 'SELECT * FROM usages WHERE "at" % 5 <> 0', "good_subs": "SELECT * FROM subs WHERE created_at % 7 <> 0", "good_invs": "SELECT * FROM invs WHERE created_at % 11 <> 0",
    "good_items": "SELECT * FROM items WHERE created_at % 7 <> 0",
}
_GOOD_RAW = _RAW
for _relation in _VIEWS:
    for _before in ("FROM ", "JOIN "):
        _GOOD_RAW = _GOOD_RAW.replace(f"{_before}{_relation} ", f"{_before}good_{_relation} ")


def _spoiled(spark: SparkSession, sf_dir: str, hasher) -> LinkInputs:
    inputs = tv.link_inputs(spark, sf_dir, hasher)
    spoil = lambda df, name, every, by: df.withColumn(name, F.when(F.col(by) % every == 0, F.concat(F.lit("cus_raw_"), name)).otherwise(F.col(name)))
    return replace(inputs, usages=spoil(inputs.usages, "user", 5, "at"), subs=spoil(inputs.subs, "customer", 7, "created_at"), invs=spoil(inputs.invs, "customer", 11, "created_at"))


@catalog.add("linked_edges_of_valid_rows", with_views("SELECT * FROM linked", *_VIEWS, extra=_SPOILED | {"raw": _GOOD_RAW, "scored": _SCORED, "linked": _LINKED}))
def linked_edges_of_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on spoiled tables, with the rejected rows in quarantine."""
    ensemble, stage = setting(spark)
    return flat(run(_spoiled(spark, sf_dir, ensemble.hasher), ensemble, stage, on_invalid="quarantine").edges)


@catalog.add("link_rejects", with_views("""SELECT 'usages' AS relation, 'user_not_synthetic' AS reason, count(*) AS "rows" FROM usages WHERE "at" % 5 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'subs', 'customer_not_synthetic', count(*) FROM subs WHERE created_at % 7 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'invs', 'customer_not_synthetic', count(*) FROM invs WHERE created_at % 11 = 0 HAVING count(*) > 0
    UNION ALL SELECT 'items', 'subscription_not_valid', count(*) FROM items WHERE created_at % 7 = 0 HAVING count(*) > 0""", *_VIEWS))
def link_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows of the same run by relation and reason: they come from its checks, so nothing is linked for them."""
    _, rejects = checked_inputs(_spoiled(spark, sf_dir, test_hasher(spark)))
    return rejects.groupBy("relation", "reason").agg(F.count(F.lit(1)).alias("rows"))


_LOW = Recipe(threshold=0.5)
_LOW_LINKED = _LINKED.replace(f"score >= {RECIPE.threshold}", f"score >= {_LOW.threshold}")


@catalog.add("linked_edges_low_threshold", with_views("SELECT * FROM linked", *_VIEWS, extra=_ALL | {"linked": _LOW_LINKED}))
def linked_edges_low_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold that SKU or id alone can reach but time cannot, so time is looked up for keys of the other two."""
    stage, hasher = Stage(spark), test_hasher(spark)
    return flat(Ensemble.default(_LOW, hasher).run(tv.link_inputs(spark, sf_dir, hasher), stage))


@catalog.add("top_linked_edges", with_views('SELECT "from", "to", kind, confidence, notes FROM linked ORDER BY confidence DESC, "from", "to", kind LIMIT 100', *_VIEWS, extra=_ALL))
def top_linked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_edges(spark, sf_dir).select("from", "to", "kind", "confidence", "notes").limit(100)


@catalog.add("evidence_by_matcher", with_views(
    """SELECT split_part(recipe, '/', 1) AS matcher, kind, count(*) AS edges, count(DISTINCT proof) AS proofs, min(proof) AS first_proof,
    max(proof) AS last_proof, max("at") AS last_at FROM raw GROUP BY ALL""", *_VIEWS, extra={"raw": _RAW}))
def evidence_by_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all matchers, folded per matcher and kind: rows sharing a proof count as one proof."""
    view, ensemble, _ = compact(spark, sf_dir)
    return proof_figures(view, ensemble.matchers, ensemble.hasher)


@catalog.add("candidate_scores", with_views('SELECT "from", "to", kind, score, edges, best_confidence, "at" FROM scored', *_VIEWS, extra={"raw": _RAW, "scored": _SCORED}))
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate key's weighted score and best single confidence, whether or not it passes."""
    view, ensemble, stage = compact(spark, sf_dir)
    grouped, alone = ensemble.candidates(view, stage)
    scored = cb.scored_keys(grouped, RECIPE, ensemble.names).unionByName(cb.scored_rows(alone, RECIPE, ensemble.names))
    return scored.select("from", "to", "kind", "score", "edges", "best_confidence", "at")


@catalog.add("best_single_proof", with_views(
    f"""SELECT "from", "to", kind, arg_min(proof, (-confidence, proof)) AS best_proof, max(confidence) AS best_confidence FROM raw GROUP BY "from", "to", kind""",
    *_VIEWS, extra={"raw": _RAW}))
def best_single_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the evidence of all matchers; of the time evidence of a key only the nearest is signed."""
    view, ensemble, stage = compact(spark, sf_dir)
    grouped, alone = ensemble.candidates(view, stage)
    grouped, alone = (ensemble.hasher.with_columns(rows, {"proof": cb.first_proof()}) for rows in (grouped, alone))
    return cb.best_proof(grouped).unionByName(alone.select(*cb.KEY, F.col("proof").alias("best_proof"), F.col("confidence").alias("best_confidence")))


@catalog.add("raw_edges_per_matcher", with_views("SELECT split_part(recipe, '/', 1) AS matcher, count(*) AS edges FROM raw GROUP BY 1", *_VIEWS, extra={"raw": _RAW}))
def raw_edges_per_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, ensemble, _ = compact(spark, sf_dir)
    return raw_edge_counts(view, ensemble.matchers)


_CLASSES = """count(*) AS accepted_edges, count(*) FILTER (confidence >= 0.9) AS high_confidence,
    count(*) FILTER (confidence >= 0.6 AND confidence < 0.9) AS medium_confidence, count(*) FILTER (confidence < 0.6) AS low_confidence"""


@catalog.add("run_statistics", with_views(
    f"""SELECT (SELECT count(*) FROM usages) AS usage_events, (SELECT count(*) FROM subs) AS subscriptions, (SELECT count(*) FROM invs) AS invoices,
    (SELECT count(*) FROM raw) AS raw_edges, {_CLASSES}, count(*) AS exported_edges FROM linked""", *_VIEWS, extra=_ALL))
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, ensemble, stage = compact(spark, sf_dir)
    accepted = cb.accepted_keys(cb.scored_keys(ensemble.deciding_evidence(view, stage), RECIPE, ensemble.names), RECIPE.threshold)
    return run_stats(view, raw_edge_counts(view, ensemble.matchers), accepted, exported=True)


@catalog.add("confidence_classes", with_views(f"SELECT kind, {_CLASSES} FROM linked GROUP BY kind", *_VIEWS, extra=_ALL))
def confidence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, ensemble, stage = compact(spark, sf_dir)
    accepted = cb.accepted_keys(cb.scored_keys(ensemble.deciding_evidence(view, stage), RECIPE, ensemble.names), RECIPE.threshold)
    return edge_classes(accepted.groupBy("kind"))


# ---------------------------------------------------------------- scalar rules over table pairs

_NEAR = f'invs t JOIN usages u ON u."user" = t.customer AND u."at" BETWEEN t.created_at - {2 * W} AND t.created_at + {2 * W}'


@catalog.add("time_proximity_of_own_invoices", with_views(
    f"""SELECT u."user" AS "user", t.id AS invoice, u."at" AS "at", {_DIFF} AS diff, {_DIFF} <= {W} AS in_window, {_CONF} AS confidence,
    printf('%.2f', 1.0::DOUBLE + CAST(0.5 AS DOUBLE) * {_CONF}) AS score_text FROM {_NEAR}""", "usages", "invs"))
def time_proximity_of_own_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tv.link_inputs(spark, sf_dir, test_hasher(spark))
    own = data.invs.select(F.col("customer").alias("user"), F.col("id").alias("invoice"), "created_at")
    pairs = window_join(data.usages.select("user", "at"), own, "at", "created_at", 2 * W, on=["user"])
    diff = F.abs(F.col("at") - F.col("created_at"))
    conf = temporal_confidence(diff, W)
    return pairs.select("user", "invoice", "at", diff.alias("diff"), within(F.col("at"), F.col("created_at"), W).alias("in_window"),
                        conf.alias("confidence"), two_decimals(F.lit(1.0) + F.lit(0.5) * conf).alias("score_text"))
