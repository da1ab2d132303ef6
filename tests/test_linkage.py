import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from edgeloom import schemas
from edgeloom.catalog import linking
from edgeloom.functions.keyed_hash import KeyedHash
from edgeloom.operators.combine import best_proof, combine, evidence_of, merged, scored_keys, scored_rows
from edgeloom.operators.matchers import LinkInputs, View, part
from edgeloom.operators.stats import proof_figures
from edgeloom.operators.validate import InvalidInput, check_inputs
from edgeloom.plans import linkage
from edgeloom.plans.linkage import Ensemble, run
from edgeloom.recipe import PASSTHROUGH, EXACT, SKU, TEMPORAL, Recipe
from edgeloom.session import RELEASE_CONF, shuffles_released

COLUMNS = ["from", "to", "kind", "confidence", "at", "notes", "proof"]


def rows(edges):
    return sorted(tuple(r) for r in edges.select(*COLUMNS).collect())


def check(found, expected):
    assert len(found) == len(expected)
    for got, want in zip(found, sorted(expected)):
        assert got[:3] + got[4:] == want[:3] + want[4:]
        assert got[3] == pytest.approx(want[3], abs=1e-12)


@pytest.fixture(scope="module")
def hasher(spark):
    return KeyedHash(spark, fx.MATCHER_SALT)


def test_matcher_fixture_exact_edges(spark, stage, hasher):
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(), hasher)
    raw = ensemble.raw_edges(inputs)
    per = {r[0]: r[1] for r in raw.groupBy("recipe").count().collect()}
    assert per == {f"{EXACT}/v1": 9, f"{TEMPORAL}/v1": 12, f"{SKU}/v1": 8}
    assert raw.select("from", "to", "kind").distinct().count() == 13
    assert all(len(r.proof) == 64 for r in raw.select("proof").collect())
    check(rows(ensemble.run(inputs, stage)), fx.MATCHER_EDGES)


@pytest.mark.parametrize("route", ["by_sku", "by_time"])
@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_routes_and_salting_give_the_same_edges(spark, stage, hasher, route, hot_rows):
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(), hasher, hot_rows=hot_rows)
    evidence = ensemble.deciding_evidence(ensemble.view(inputs, stage), stage, route)
    check(rows(combine(evidence, ensemble.recipe, hasher, stage, ensemble.names)), fx.MATCHER_EDGES)


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_full_evidence_and_raw_edges_combine_alike(spark, stage, hasher, hot_rows):
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(), hasher, hot_rows=hot_rows)
    full = combine(ensemble.evidence(View.compact(inputs, ensemble.hot_rows)), ensemble.recipe, hasher, stage, ensemble.names)
    check(rows(full), fx.MATCHER_EDGES)
    raw = combine(merged(evidence_of(ensemble.raw_edges(inputs))), ensemble.recipe, hasher, stage, ensemble.names, given=True)
    check(rows(raw), fx.MATCHER_EDGES)


def test_streamed_proofs_equal_text_proofs(spark, stage, hasher):
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(), hasher)
    evidence = ensemble.deciding_evidence(ensemble.view(inputs, stage), stage)
    check(rows(combine(evidence, ensemble.recipe, hasher, stage, ensemble.names, text_proofs=2)), fx.MATCHER_EDGES)


def test_run_order_is_best_first(spark, stage, hasher):
    edges = Ensemble.default(Recipe(), hasher).run(fx.matcher_inputs(spark), stage).collect()
    assert [(-r["confidence"], r["from"], r["to"], r["kind"]) for r in edges] == sorted((-r["confidence"], r["from"], r["to"], r["kind"]) for r in edges)


def test_threshold_above_reach_accepts_nothing(spark, stage, hasher):
    recipe = Recipe(weights={TEMPORAL: 0.5}, threshold=1.5, checked=False)
    full = Ensemble.default(recipe, hasher)
    assert combine(full.evidence(View.compact(fx.matcher_inputs(spark))), recipe, hasher, stage, [TEMPORAL]).count() == 0


@pytest.mark.parametrize("recipe", [
    Recipe(), Recipe(threshold=0.2), Recipe(threshold=0.0), Recipe(threshold=0.64), Recipe(threshold=0.9),
    Recipe(weights={TEMPORAL: 1.0, SKU: 1.0}, threshold=1.0), Recipe(window_sec=0), Recipe(weights={EXACT: 0.3, TEMPORAL: 0.9, SKU: 0.5}),
])
def test_deciding_evidence_never_changes_the_result(spark, stage, hasher, recipe):
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(recipe, hasher)
    pruned = combine(ensemble.deciding_evidence(ensemble.view(inputs, stage), stage), recipe, hasher, stage, ensemble.names)
    plain = combine(ensemble.evidence(View.compact(inputs, ensemble.hot_rows)), recipe, hasher, stage, ensemble.names)
    assert rows(pruned) == rows(plain)


def test_pipeline_fixture(spark, stage):
    ensemble = Ensemble.default(Recipe(), KeyedHash(spark, fx.PIPELINE_SALT))
    seen = []
    result = run(fx.pipeline_inputs(spark), ensemble, stage, export=lambda df: seen.append(df.count()))
    found = sorted((r["to"], r["at"], r["notes"][-12:], r["proof"]) for r in result.edges.collect())
    assert found == sorted(fx.PIPELINE_EDGES)
    assert seen == [6]
    assert result.stats.first().asDict() == {
        "usage_events": 2, "subscriptions": 2, "invoices": 2, "raw_edges": 18, "accepted_edges": 6, "exported_edges": 6,
        "high_confidence": 6, "medium_confidence": 0, "low_confidence": 0,
    }
    assert {r[0]: r[1] for r in result.matcher_stats.collect()} == {EXACT: 6, TEMPORAL: 8, SKU: 4}
    assert {tuple(r["meta"]) for r in result.edges.collect()} == {("link-edge/v1", "strict")}


def test_empty_inputs(spark, stage, hasher):
    result = run(fx.inputs(spark, [], [], []), Ensemble.default(Recipe(), hasher), stage)
    assert result.edges.count() == 0
    assert set(result.stats.first()) == {0}
    assert {r[0]: r[1] for r in result.matcher_stats.collect()} == {EXACT: 0, TEMPORAL: 0, SKU: 0}


@pytest.mark.parametrize("change, message", [
    (lambda u, s, i: None, None),
    (lambda u, s, i: u.append(("user_123", "f", fx.P1, fx.T)), "user_not_synthetic"),
    (lambda u, s, i: s.append(("sub_1234567890abcdef", fx.A, [], [], fx.T, "active")), "id_not_synthetic"),
    (lambda u, s, i: s.append((fx.S1, fx.A, ["price_raw"], [], fx.T, "active")), "price_not_synthetic"),
    (lambda u, s, i: s.append((fx.S1, fx.A, [], ["prod_raw"], fx.T, "active")), "product_not_synthetic"),
    (lambda u, s, i: i.append((fx.I1, "cus_rawcustomerid", "", 1, "usd", "paid", fx.T, True)), "customer_not_synthetic"),
    (lambda u, s, i: i.append((fx.I1, fx.A, "sub_raw", 1, "usd", "paid", fx.T, True)), "subscription_not_synthetic"),
    (lambda u, s, i: u.append((fx.A, "f", fx.P1, 0)), "at_not_positive"),
])
def test_validation(spark, change, message):
    u, s, i = [(fx.A, "f", "", fx.T)], [(fx.S1, fx.A, [fx.P1], [], fx.T, "active")], [(fx.I1, fx.A, "", 1, "usd", "paid", fx.T, True)]
    change(u, s, i)
    inputs = fx.inputs(spark, u, s, i)
    if message is None:
        assert check_inputs(inputs) is inputs
        return
    with pytest.raises(InvalidInput, match=message):
        check_inputs(inputs)
    kept = check_inputs(inputs, "quarantine")
    assert kept.usages.count() + kept.subs.count() + kept.invs.count() == 3


RAW_ITEMS = [
    (("sub_RAW", fx.A, fx.T, fx.P1, "price"), "subscription_not_synthetic"),
    ((fx.S1, "cus_RAW", fx.T, fx.P1, "price"), "customer_not_synthetic"),
    ((fx.S1, fx.A, fx.T, "price_RAW", "price"), "item_not_synthetic"),
    ((fx.S2, fx.A, fx.T, fx.P1, "price"), "subscription_not_valid"),
]


@pytest.mark.parametrize("item, reason", RAW_ITEMS)
def test_flat_items_cannot_carry_raw_ids(spark, stage, hasher, item, reason):
    """An item's own subscription and customer are checked, and it must belong to a valid subscription."""
    base = fx.inputs(spark, [(fx.A, "f", fx.P1, fx.T)], [(fx.S1, fx.A, [], [], fx.T, "active"), (fx.S2, "cus_RAW", [], [], fx.T, "active")], [])
    items = spark.createDataFrame([(fx.S1, fx.A, fx.T, fx.P1, "price"), item], "sub_id string, customer string, created_at long, item_id string, item_kind string")
    inputs = replace(base, items=items)
    with pytest.raises(InvalidInput, match=reason):
        run(inputs, Ensemble.default(Recipe(), hasher), stage)
    result = run(inputs, Ensemble.default(Recipe(), hasher), stage.__class__(spark), on_invalid="quarantine")
    assert sorted((r.relation, r.reason) for r in result.rejects.collect()) == sorted([("items", reason), ("subs", "customer_not_synthetic")])
    assert all(r["to"].startswith("syn_") and r["from"].startswith("syn_") and r["to"] != fx.S2 for r in result.edges.collect())


def test_passthrough_keeps_raw_ids_but_refuses_empty_ones(spark, stage, hasher):
    inputs = fx.inputs(spark, [("cus_1", "f", "", fx.T), ("", "f", "", fx.T)], [("sub_1", "cus_1", [], [], fx.T, "active"), ("", "cus_1", [], [], fx.T, "active")], [("in_1", None, "", 1, "usd", "paid", fx.T, True)])
    result = run(inputs, Ensemble.default(Recipe(), hasher, PASSTHROUGH), stage, on_invalid="quarantine")
    assert {(r["from"], r["to"]) for r in result.edges.collect()} == {("cus_1", "sub_1")}
    assert sorted((r.relation, r.reason) for r in result.rejects.collect()) == [("invs", "customer_empty"), ("subs", "id_empty"), ("usages", "user_empty")]


def test_repeated_price_and_both_lists(spark, stage, hasher):
    inputs = fx.inputs(spark, [(fx.A, "f", fx.P1, fx.T)], [(fx.S1, fx.A, [fx.P1, fx.P1], [fx.P1], fx.T + 5000, "active")], [])
    raw = Ensemble.default(Recipe(), hasher).raw_edges(inputs)
    found = {(r["recipe"], r["kind"]): r["count"] for r in raw.groupBy("recipe", "kind").count().collect()}
    assert found == {
        (f"{EXACT}/v1", "user->subscription"): 1, (f"{EXACT}/v1", "user->price"): 2, (f"{EXACT}/v1", "user->product"): 1,
        (f"{SKU}/v1", "user->subscription"): 3, (f"{SKU}/v1", "user->price"): 3,
    }
    ensemble = Ensemble.default(Recipe(), hasher)
    compact = combine(ensemble.deciding_evidence(ensemble.view(inputs, stage), stage), Recipe(), hasher, stage, ensemble.names)
    direct = combine(evidence_of(raw), Recipe(), hasher, stage, ensemble.names, given=True)
    assert rows(compact) == rows(direct)


def test_window_edge_is_inclusive_with_zero_confidence(spark, hasher):
    inputs = fx.inputs(spark, [(fx.A, "f", "", fx.T + 3600), (fx.A, "f", "", fx.T + 3601)], [(fx.S1, fx.B, [], [], fx.T, "active")], [])
    raw = Ensemble.default(Recipe(), hasher).raw_edges(inputs).collect()
    assert [(r["confidence"], r["at"]) for r in raw] == [(0.0, fx.T + 3600)]


def test_custom_matcher_joins_the_ensemble(spark, stage, hasher):
    class Everyone:
        name = "everyone"

        def evidence(self, view: View):
            return view.by_sku.select("user").distinct().select(
                F.col("user").alias("from"), F.lit("syn_sub_all").alias("to"), F.lit("user->subscription").alias("kind"),
                F.lit("everyone").alias("matcher"), F.lit(0.5).alias("confidence"), part(F.lit("everyone|x"), F.lit(1).cast("bigint")).alias("parts"),
                F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("at"), F.lit("all").alias("note"))

    base = Ensemble.default(Recipe(), hasher)
    recipe = Recipe(weights={"everyone": 2.0}, threshold=1.0)
    ensemble = Ensemble(recipe, hasher, (*base.matchers, Everyone()))
    edges = ensemble.run(fx.matcher_inputs(spark), stage).collect()
    assert len(edges) == 4 and {e["notes"] for e in edges} == {"all (score=1.00)"}


@pytest.mark.parametrize("repeated", [False, True], ids=["single ids", "a repeated id"])
def test_proof_figures_equal_merged_evidence(spark, stage, hasher, repeated):
    """Usage before and after a target at one distance, whose rows share a proof; seconds without events, other users, the window's edge."""
    t = 1_700_000_000
    usages = [("syn_cust_1", "api", "syn_price_1", t + d) for d in (-3600, -3601, -60, -60, 0, 60, 61, 3600, 3700)] + [("syn_cust_2", "api", "syn_price_2", t + d) for d in (-61, 60, 62)]
    subs = [(f"syn_sub_{i}", "syn_cust_1", ["syn_price_1"], [], t + d, "active") for i, d in enumerate((0, 0, 1, -30, 7300))]
    invs = [(f"syn_inv_{i}", "syn_cust_2", "", 1, "usd", "paid", t + d, True) for i, d in enumerate((0, 61))]
    if repeated:
        invs += [("syn_inv_0", "syn_cust_2", "", 1, "usd", "paid", t + 1, True)]
    inputs = LinkInputs(*(spark.createDataFrame(r, s) for r, s in ((usages, schemas.USAGE), (subs, schemas.SUBSCRIPTION_LITE), (invs, schemas.INVOICE_LITE))))
    ensemble = Ensemble.default(Recipe(), hasher)
    raw = ensemble.raw_edges(inputs).groupBy(F.substring_index("recipe", "/", 1).alias("matcher"), "kind").agg(
        F.count(F.lit(1)), F.count_distinct("proof"), F.min("proof"), F.max("proof"), F.max("at"))
    view = ensemble.view(inputs, stage)
    found = proof_figures(view, ensemble.matchers, hasher)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, raw.collect()))
    assert any(r.edges > r.proofs for r in found.where("matcher LIKE 'temporal%'").collect())
    if not repeated:  # no pair near in time is shuffled: rows are grouped by the proof's text for the other matchers only
        plan = proof_figures(view, [m for m in ensemble.matchers if m.name == TEMPORAL], hasher)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [from" not in plan


def near_inputs(spark, repeated):
    """Users with one and with several seconds around a target, keys of time alone and of time with others, a repeated id."""
    t = 1_700_000_000
    usages = [("syn_cust_1", "api", "syn_price_1", t + d) for d in (-3600, -3601, -60, -60, 60, 3500)] + [("syn_cust_2", "api", "syn_price_2", t + 40), ("syn_cust_3", "api", "syn_price_9", t + 9000)]
    subs = [(f"syn_sub_{i}", f"syn_cust_{1 + i % 2}", [f"syn_price_{1 + i % 3}"], [], t + d, "active") for i, d in enumerate((0, 1, -30, 3661, 7300, 90_000))]
    invs = [("syn_inv_0", "syn_cust_2", "", 1, "usd", "paid", t, True), ("syn_inv_1", "syn_cust_7", "", 1, "usd", "paid", t + 61, True)]
    if repeated:
        invs += [("syn_inv_1", "syn_cust_7", "", 1, "usd", "paid", t + 3000, True)]
    return LinkInputs(*(spark.createDataFrame(r, s) for r, s in ((usages, schemas.USAGE), (subs, schemas.SUBSCRIPTION_LITE), (invs, schemas.INVOICE_LITE))))


@pytest.mark.parametrize("repeated", [False, True], ids=["single ids", "a repeated id"])
@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_candidates_score_as_all_evidence(spark, stage, hasher, hot_rows, repeated):
    ensemble = Ensemble.default(Recipe(), hasher, hot_rows=hot_rows)
    view = ensemble.view(near_inputs(spark, repeated), stage)
    grouped, alone = ensemble.candidates(view, stage)
    scored = scored_rows(alone, ensemble.recipe, ensemble.names)
    assert "Aggregate" not in scored._jdf.queryExecution().optimizedPlan().toString()  # pairs near in time are not grouped
    few = alone.rdd.getNumPartitions()  # partitions of few rows make many pairs, so they must not be merged
    assert few >= 4 * 4 * spark.sparkContext.defaultParallelism
    assert alone.where("n > 1").count() and grouped.where(f"matcher = '{TEMPORAL}'").count()
    want = scored_keys(ensemble.evidence(view), ensemble.recipe, ensemble.names).collect()
    got = scored_keys(grouped, ensemble.recipe, ensemble.names).unionByName(scored).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_candidates_of_empty_inputs(spark, stage, hasher):
    inputs = near_inputs(spark, False)
    ensemble, none = Ensemble.default(Recipe(), hasher), {n: getattr(inputs, n).limit(0) for n in ("usages", "subs", "invs")}
    grouped, alone = ensemble.candidates(ensemble.view(LinkInputs(**none), stage), stage)
    assert grouped.isEmpty() and alone.isEmpty()


@pytest.mark.parametrize("repeated", [False, True], ids=["single ids", "a repeated id"])
def test_best_single_proof_of_candidates_is_that_of_raw_edges(spark, stage, hasher, monkeypatch, repeated):
    inputs = near_inputs(spark, repeated)
    monkeypatch.setattr(linking, "compact", lambda *_: (ensemble.view(inputs, stage), ensemble, stage))
    ensemble = Ensemble.default(Recipe(), hasher)
    want = best_proof(ensemble.raw_edges(inputs))
    found = linking.best_single_proof(spark, "")
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [from") == 1  # one pass over the other keys, none over pairs near in time


def test_best_proof(spark):
    edges = spark.createDataFrame([("a", "b", "k", 0.5, "p1"), ("a", "b", "k", 0.9, "p3"), ("a", "b", "k", 0.9, "p2")], "from string, to string, kind string, confidence double, proof string")
    assert tuple(best_proof(edges).first()) == ("a", "b", "k", "p2", 0.9)


def test_plan_shape_and_secrecy(spark, stage, hasher):
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(), hasher)
    for df in (ensemble.raw_edges(inputs), ensemble.deciding_evidence(ensemble.view(inputs, stage), stage)):
        text = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text and "Python" not in text
        block = fx.MATCHER_SALT.ljust(64, b"\0")
        for pad in (0x36, 0x5C):
            assert bytes(b ^ pad for b in block).hex()[:24] not in text.lower()


def test_stored_views_hold_only_what_is_read(spark, stage):
    inputs = fx.matcher_inputs(spark)
    used = {r["sku"] for r in inputs.usages.select("sku").collect()}
    everything = {r["sku"] for r in inputs.index().select("sku").collect()}
    view = View.compact(inputs).stored(stage)
    assert {r["sku"] for r in view.index.select("sku").collect()} == everything & used
    few = stage.__class__(spark)
    View.raw(inputs).stored(few, ("by_sku", "invs"))
    assert sorted(f.getPath().getName() for f in few._files(few.root).listStatus(few._path(few.root))) == ["by_sku", "invs"]


@pytest.mark.parametrize("span", [1, 1024])
def test_pairs_are_kept_by_lists_of_active_buckets(spark, stage, hasher, monkeypatch, span):
    monkeypatch.setattr(linkage, "SPAN", span)
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(), hasher)
    pairs = {route: linkage._sku_pairs_near_in_time(ensemble.view(inputs, stage.__class__(spark)), 1000, route) for route in ("by_sku", "by_time")}
    assert "LeftSemi" not in pairs["by_sku"]._jdf.queryExecution().optimizedPlan().toString()
    found = {route: sorted((r["user"], r["sku"], r["id"]) for r in df.collect()) for route, df in pairs.items()}
    assert found["by_sku"] == found["by_time"] != []


def test_time_alone_takes_no_part_where_it_is_not_enough(spark, stage, hasher):
    """At 0.5 SKU alone is enough and time alone (0.3) is not."""
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(threshold=0.5), hasher)
    evidence = ensemble.deciding_evidence(ensemble.view(inputs, stage), stage)
    met = evidence.groupBy("from", "to", "kind").agg(F.collect_set("matcher").alias("by")).collect()
    assert met and all(r["by"] != [TEMPORAL] for r in met)


def test_tables_without_rows_are_not_joined(spark, stage, hasher):
    """Without subscriptions there is no SKU to look for: no list of active buckets, no SKU pair, and the invoices linked as ever."""
    inputs, ensemble = fx.matcher_inputs(spark), Ensemble.default(Recipe(), hasher)
    bare = replace(inputs, subs=inputs.subs.where(F.lit(False)))
    found = ensemble.link(ensemble.view(bare, stage), stage)
    staged = {f.getPath().getName() for f in stage._files(stage.root).listStatus(stage._path(stage.root))}
    assert not staged & {"active", "active_skus", "sku_pairs", "sku_keys"}
    check(rows(found), [e for e in fx.MATCHER_EDGES if e[2] == "user->invoice"])
    none = stage.__class__(spark)
    assert ensemble.link(ensemble.view(replace(inputs, usages=inputs.usages.where(F.lit(False))), none), none).count() == 0


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffle_files(spark, stage):
    before = _shuffle_files(spark)
    kept = stage.table(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(100):  # they are removed in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before and kept.count() == 7


@pytest.mark.parametrize("own", [None, "false"])
def test_release_of_shuffles_ends_with_the_last_write(spark, own):
    spark.conf.unset(RELEASE_CONF)
    before = spark.conf.get(RELEASE_CONF, None)
    if own is not None:
        spark.conf.set(RELEASE_CONF, own)
    try:
        with shuffles_released(spark):
            with shuffles_released(spark):
                pass
            assert spark.conf.get(RELEASE_CONF) == "true"
        assert spark.conf.get(RELEASE_CONF, None) == (own or before)
    finally:
        spark.conf.unset(RELEASE_CONF)


def test_a_run_keeps_its_edges_and_what_was_there(spark, stage, hasher):
    stage.table(spark.range(3), "mine")
    edges = Ensemble.default(Recipe(), hasher).run(fx.matcher_inputs(spark), stage)
    assert stage.names() == {"mine", "edges"}
    check(rows(edges), fx.MATCHER_EDGES)


def test_deciding_evidence_is_stored_part_by_part(spark, stage, hasher):
    ensemble = Ensemble.default(Recipe(), hasher)
    evidence = ensemble.deciding_evidence(ensemble.view(fx.matcher_inputs(spark), stage), stage)
    plan = evidence._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_index_of_skus_holds_any_kind_of_item(spark):
    """Only a range of ids is looked at before the join: products that usage names stay, and items beside the named ones go."""
    inputs = fx.matcher_inputs(spark)
    named = lambda *skus: {r.sku for r in inputs.index(spark.createDataFrame([(s,) for s in skus], "sku string")).collect()}
    assert named("syn_prod_prod111111") == {"syn_prod_prod111111"}
    assert named(fx.P1, "syn_prod_prod222222", "syn_zzz", None) == {fx.P1, "syn_prod_prod222222"}
    assert named("syn_price_p1") == set() and named() == set()
    products = inputs.index(spark.createDataFrame([(fx.P1,)], "sku string"))
    assert "min(sku" in products._jdf.queryExecution().optimizedPlan().toString()


def test_proof_figures_sort_no_signed_rows(spark, stage, hasher):
    ensemble = Ensemble.default(Recipe(), hasher)
    figures = proof_figures(ensemble.view(fx.matcher_inputs(spark), stage), ensemble.matchers, hasher)
    plan = figures._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[matcher" not in plan and "SortAggregate(key=[kind" not in plan and "ObjectHashAggregate(keys=[matcher" in plan
    empty = proof_figures(ensemble.view(replace(fx.matcher_inputs(spark), usages=spark.createDataFrame([], schemas.USAGE)), type(stage)(spark)), ensemble.matchers, hasher)
    assert empty.count() == 0
