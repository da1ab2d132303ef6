import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from edgeloom import schemas
from edgeloom.functions.keyed_hash import KeyedHash
from edgeloom.operators import audit, fleet, quarantine, retention
from edgeloom.operators import deliveries as dl
from edgeloom.operators import sanitize as sz
from edgeloom.operators.rangejoin import count_within, window_join
from edgeloom.operators.skew import balanced_join, cells, may_be_hot, previous_in_order
from edgeloom.plans.billing_export import billing_stream, check_sources
from edgeloom.recipe import Privacy, RetryPolicy, SettingsError
from edgeloom.sinks import export as ex
from edgeloom.sources import billing
from edgeloom.sources.usage import normalised, or_fallback

SALT = b"test_salt_for_synthetic_ids"


def at(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


@pytest.fixture(scope="module")
def raw_subs(spark):
    person = Row(id="cus_test456", email="someone@example.com", name="Some One")
    item = Row(price=Row(id="price_test789", product=Row(id="prod_testABC")), quantity=2)
    bare = Row(price=None, quantity=1)
    return spark.createDataFrame(
        [("sub_test123", person, "active", 1609459200, [item, item, bare]), ("", person, "active", 1, []), ("sub_x", None, "active", 1, None)], schemas.RAW_SUBSCRIPTION)


@pytest.fixture(scope="module")
def raw_invs(spark):
    person = Row(id="cus_test456", email="someone@example.com", name="Some One")
    lines = [Row(subscription=None), Row(subscription=Row(id="")), Row(subscription=Row(id="sub_test789")), Row(subscription=Row(id="sub_other"))]
    return spark.createDataFrame(
        [("in_test123", person, 10000, "usd", "paid", 1609459200, lines), ("in_2", person, 5, "usd", "open", 2, None)], schemas.RAW_INVOICE)


def test_sanitized_subscription(spark, raw_subs):
    hasher = KeyedHash(spark, SALT)
    out = sz.sanitize_subscriptions(raw_subs, hasher)
    assert out.columns == ["id", "customer", "status", "items", "created_at"]
    full = ("syn_price_ce02bc753b6ec674", "syn_prod_78d74faf20a5589d", 2)
    row = out.collect()
    assert [(r.id, r.customer, r.status, [tuple(i) for i in r["items"]], r.created_at) for r in row] == [
        ("syn_sub_658dc700aeef1687", "syn_cust_9f804cf8cddf8807", "active", [full, full, ("", "", 1)], 1609459200)]
    lite = sz.subscription_lite(out).first()
    assert (lite.price_ids, lite.product_ids) == ([full[0]] * 2, [full[1]] * 2)
    assert {r.reason for r in sz.split_raw(raw_subs)[1].collect()} == {"empty_id", "empty_customer"}
    other = sz.sanitize_subscriptions(raw_subs, KeyedHash(spark, b"another salt")).first()
    assert other.id != row[0].id
    kept = sz.sanitize_subscriptions(raw_subs, hasher, "passthrough").first()
    assert (kept.id, kept["items"][0].price_id) == ("sub_test123", "price_test789")


def test_sanitized_invoice(spark, raw_invs):
    rows = sz.invoice_lite(sz.sanitize_invoices(raw_invs, KeyedHash(spark, SALT))).orderBy("total").collect()
    assert (rows[0].subscription, rows[0].paid, rows[0].status) == ("", False, "open")
    assert tuple(rows[1]) == ("syn_inv_e48f85a4775fe21e", "syn_cust_9f804cf8cddf8807", "syn_sub_c9ac88980e3f82de", 10000, "usd", "paid", 1609459200, True)
    white = sz.whitelist_invoices(raw_invs).orderBy("total").collect()
    assert [(r.id, r.customer, r.subscription) for r in white] == [("in_2", "cus_test456", ""), ("in_test123", "cus_test456", "")]
    assert sz.whitelist_subscriptions(raw_invs.sparkSession.createDataFrame([], schemas.RAW_SUBSCRIPTION)).columns == ["id", "customer", "status", "items", "created_at"]


def test_billing_stream_has_no_personal_data(spark, raw_subs, raw_invs):
    check_sources(raw_subs, raw_invs)
    records = billing_stream(raw_subs, raw_invs, KeyedHash(spark, SALT))
    assert audit.leaks(records).first().asDict() == {"records": 3, "personal_fields": 0, "email_addresses": 0, "raw_ids": 0, "not_synthetic": 0}
    raw = raw_invs.select(F.to_json(F.struct("*")).alias("payload"))
    assert audit.leaks(raw).first().asDict() == {"records": 2, "personal_fields": 2, "email_addresses": 2, "raw_ids": 2, "not_synthetic": 2}


def test_a_payload_is_parsed_once_and_patterns_run_on_suspects_only(spark):
    from edgeloom.catalog import queues

    plan = queues.billing_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and "get_json_object" not in plan  # once for each half of the union
    payloads = ['{"id":"syn_sub_1","customer":"syn_cust_1"}', '{"id":"syn_sub_1","email" :null}', '{"id":"cus_1"}', '{"cus_1":"syn_x"}', '{"id":"syn_1","m":"a@b.co"}', '{"id":"syn_1","m":"@"}', None]
    frame = audit.leaks(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    assert tuple(frame.first()) == (7, 1, 1, 1, 1) and frame._jdf.queryExecution().optimizedPlan().toString().count("_suspect") >= 3


def test_source_filters(spark, raw_subs, raw_invs, tmp_path):
    assert billing.raw_subscriptions(raw_subs, "cus_none").count() == 0
    assert billing.raw_subscriptions(raw_subs, "cus_test456", 1).count() == 1
    assert [r.id for r in billing.raw_invoices(raw_invs, subscription="sub_other").collect()] == ["in_test123"]
    assert billing.subscriptions(raw_subs).count() == 3 and billing.invoices(raw_invs, 1).count() == 1 and billing.probe(raw_subs) == 3
    raw_invs.write.parquet(str(tmp_path / "i"))
    stored = billing.read(spark, str(tmp_path / "i"), schemas.RAW_INVOICE)
    plan = billing.raw_invoices(stored, "cus_a").select("id")._jdf.queryExecution().toString()
    assert "EqualTo(customer.id,cus_a)" in plan and "email" not in plan.split("ReadSchema")[-1]
    assert [r.id for r in billing.created_between(stored, 3, None).collect()] == ["in_test123"]
    assert [r.id for r in billing.resumed(stored, stored.where("created = 2")).collect()] == ["in_test123"]
    assert billing.resumed(stored, stored.where("false")).count() == 2


def test_usage_helpers(spark):
    empty = spark.createDataFrame([], "user string, feature string, sku string, at long")
    assert or_fallback(empty, 1000).first().at == 400
    some = spark.createDataFrame([("u", "f", "s", 1)], empty.schema)
    assert or_fallback(some, 1000).count() == 1
    raw = spark.createDataFrame([("o", "f", "t", '{"plan":"a","Email":"x","auth_token":"y"}')], "org string, feature string, start string, attrs string")
    row = normalised(raw, "org", "feature", "start", "attrs").first()
    assert row.attrs == {"plan": "a"} and len(row.event_id) == 64


# ---------------------------------------------------------------- joins


@pytest.mark.parametrize("window", [0, 1, 7, 60])
def test_window_join_and_count_against_brute_force(spark, window):
    import random

    rnd = random.Random(window)
    left = [(i, rnd.randint(-300, 300)) for i in range(80)]
    right = [(i, rnd.choice([5, rnd.randint(-300, 300)])) for i in range(90)]
    ldf, rdf = spark.createDataFrame(left, "l long, at long"), spark.createDataFrame(right, "r long, c long")
    want = sorted((a, b) for a, x in left for b, y in right if window > 0 and abs(x - y) <= window)
    for hot, sizes in ((None, None), (3, None), (3, (80, 90)), (3, (90, 80)), (1, (3, 1))):
        pairs = window_join(ldf, rdf, "at", "c", window, left_by=["l"], right_by=["r"], hot_rows=hot, sizes=sizes)
        assert sorted((p.l, p.r) for p in pairs.collect()) == want
    assert count_within(ldf.withColumn("n", F.lit(2)), rdf, "at", "c", window).first().pairs == 2 * len(want)


def sided(spark, n, hot, name):
    key = F.when(F.col("id") < hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    return spark.range(n).select(key.alias("k"), F.col("id").alias(name)).unionByName(spark.createDataFrame([(None, -1)], f"k string, {name} long"))


@pytest.mark.parametrize("left_hot, right_hot, grid", [(600, 3, (6, 1)), (3, 600, (1, 6)), (500, 700, (5, 7)), (3, 3, None)])
def test_balanced_join_splits_the_heavy_side_or_both(spark, stage, left_hot, right_hot, grid):
    left, right = sided(spark, left_hot + 20, left_hot, "l"), sided(spark, right_hot + 20, right_hot, "r")
    assert [(r.k, (r._rows, r._columns)) for r in cells(left, right, ["k"], 100).collect()] == ([("hot", grid)] if grid else [])
    for sizes in (None, (left_hot + 20, right_hot + 20)):
        pairs = balanced_join(left, right, ["k"], ["l"], ["r"], 100, stage, sizes)
        assert pairs.columns == ["k", "l", "r"]
        assert pairs.exceptAll(left.join(right, "k")).isEmpty() and pairs.count() == left.join(right, "k").count()


def test_crowded_keys_are_cut_by_their_pairs(spark):
    """1,100 x 1,000 rows of one key fit 10,000 rows a side, but not the pairs a task of ten rows may form."""
    left, right = sided(spark, 1100, 1100, "l"), sided(spark, 1000, 1000, "r")
    assert cells(left, right, ["k"], 10_000).isEmpty()
    assert [(r._rows, r._columns) for r in cells(left, right, ["k"], 1_050).collect()] == [(2, 1)]
    assert may_be_hot(1, 1_001, 1_000) and may_be_hot(1_000, 1_000, 999) and not may_be_hot(1_000, 1_000, 1_000)


def test_cells_share_a_heavy_key_evenly(spark, stage):
    left, right = sided(spark, 4000, 4000, "l"), sided(spark, 2000, 2000, "r")
    pairs = balanced_join(left, right, ["k"], ["l"], ["r"], 500, stage)
    rows, columns = 8, 4
    cell = pairs.groupBy(F.pmod(F.xxhash64("l"), F.lit(rows)), F.pmod(F.xxhash64("r"), F.lit(columns))).count()
    seen = [r["count"] for r in cell.collect()]
    assert len(seen) == rows * columns and sum(seen) == 8_000_000 and max(seen) < 2 * min(seen)


def test_previous_in_order_is_lag(spark):
    rows = [("a", t) for t in (1, 2, 50, 51, 400, 401, 402)] + [("b", 7), ("b", 900)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = sorted((r.k, r.t, r.p) for r in previous_in_order(df, "k", "t", 10, "p").collect())
    assert got == [("a", 1, None), ("a", 2, 1), ("a", 50, 2), ("a", 51, 50), ("a", 400, 51), ("a", 401, 400), ("a", 402, 401), ("b", 7, None), ("b", 900, 7)]


# ---------------------------------------------------------------- deliveries

BODY = '{"id":"evt_test","type":"invoice.created","created":1700000000,"data":{"object":{"id":"in_test"}}}'
SIG = "1bedb042d1f0a8be6556f10a1e3a2424d5291f61122a1e39afb6811941e18368"
T0 = 1700000000


def deliver(spark, rows, rules=dl.DeliveryRules(), seen=None):
    data = [(i, body, header, remote, at(when)) for i, (body, header, remote, when) in enumerate(rows)]
    out = dl.classified(spark.createDataFrame(data, schemas.DELIVERY), KeyedHash(spark, b"whsec_test123"), rules, seen)
    return [(r.outcome, r.detail) for r in out.orderBy("delivery_id").collect()]


def test_deliveries(spark):
    good = f"t={T0},v1={SIG}"
    rows = [
        (BODY, good, "1.2.3.4:5", T0), (BODY, f"t={T0},v1={SIG[:-1]}0", "x", T0), (BODY, "", "x", T0), (BODY, None, "x", T0), (BODY, good, "x", T0 + 301),
        (BODY, good, "x", T0 - 301), (BODY, good, "x", T0 + 300), (BODY, f"t=abc,t={T0},v1={SIG}", "x", T0), (BODY, f"v1={SIG}", "x", T0), (BODY, f"t={T0}", "x", T0),
        (BODY, f"t=1, t=+{T0} , v0=a, v1=bad, v1={SIG}", "x", T0 + 1), (BODY, f"t=99999999999999999999,v1={SIG}", "x", T0), (BODY, f"t=9223372036854775807,v1={SIG}", "x", T0),
        (None, good, "x", T0), (BODY + " " * dl.DeliveryRules().max_body_bytes, good, "x", T0),
    ]
    assert deliver(spark, rows) == [
        ("accepted", None), ("rejected", "signature_mismatch"), ("rejected", "missing_header"), ("rejected", "missing_header"), ("rejected", "outside_skew"),
        ("rejected", "outside_skew"), ("duplicate", None), ("rejected", "invalid_timestamp"), ("rejected", "missing_timestamp"), ("rejected", "missing_signature"),
        ("duplicate", None), ("rejected", "invalid_timestamp"), ("rejected", "outside_skew"), ("rejected", "signature_mismatch"), ("rejected", "body_too_large"),
    ]
    seen = spark.createDataFrame([("evt_test",)], "event_id string")
    assert deliver(spark, rows[:1], seen=seen) == [("duplicate", None)]


def test_only_one_json_object_with_text_ids_is_sound(spark):
    sound = ['{"id":"a"}', ' {"ID":"a", "x":"} {\\" ["}\n', '{"id":"a","data":{"object":{"id":"b"}},"list":[{"k":[1]}]}', '{"id":null}', '{}']
    broken = ["{'id':'a'}", '{"id":"a"} trailing', '{"id":"a"}{"id":"b"}', '{"id":5}', '{"id":"a"', '[{"id":"a"}]', '"id"', "", '{"id":"a","type":7}']
    rows = spark.createDataFrame([(b,) for b in sound + broken], "body string")
    event = dl.parse_event(F.col("body"))
    bad = rows.select("body", (event.isNull() | event["_corrupt"].isNotNull() | dl.leftover(F.col("body")) | dl.wrong_types(F.col("body"))).alias("bad"), event["id"].alias("id"))
    got = {r.body: r for r in bad.collect()}
    assert [b for b in sound if got[b].bad] == [] and [b for b in broken if not got[b].bad] == []
    assert got[sound[1]].id == "a"


def test_what_follows_the_first_object_is_found_at_any_depth(spark):
    """Also where closing brackets come before what opens again, and below the depth that one pattern tells."""
    deep = '{"a":' * 12 + "{}" + "}" * 12
    sound, broken = [deep, '{"a":[[[]],{}]} \n'], ['{"id":"a"}]{}', '{"id":"a"}}{"b":{}}', deep + deep, deep + "]{}", deep + " x}"]
    rows = spark.createDataFrame([(b,) for b in sound + broken], "body string").select(dl.leftover(F.col("body")).alias("bad"))
    assert [r.bad for r in rows.collect()] == [False] * len(sound) + [True] * len(broken)


def test_names_in_any_case_are_rewritten_and_others_left(spark):
    bodies = ['{"ID" : "a","Data":{"OBJECT":{"iD":"b"}}}', '{"id":"a","Name":"ID","IDs":1}', None]
    got = spark.createDataFrame([(b,) for b in bodies], "body string").select(dl.plain_names(F.col("body")).alias("b")).collect()
    assert [r.b for r in got] == ['{"id" : "a","data":{"object":{"id":"b"}}}', bodies[1], None]


def test_deliveries_of_one_row_group_are_checked_on_all_cores(spark, tmp_path):
    from edgeloom.catalog import intake

    spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id) AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = intake.classified(spark, str(tmp_path))
    assert found.count() == 458
    assert len([f for f in found.inputFiles() if "/checked/" in f]) >= 2 * spark.sparkContext.defaultParallelism


def test_types_count_at_the_top_level_only(spark):
    bodies = ['{"data":{"object":{"id":7}},"id":"evt_1","type":"x"}', '{"id":"evt_1","type":"x","data":{"type":3}}', '{"ID":"evt_1","type":null}', "{}", '{"id":7,"type":"x"}', '{"a":{"id":"x"},"id":[1],"type":"x"}', '{"id":"a","Type":{}}']
    found = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").select("i", dl.wrong_types(F.col("body")).alias("bad")).orderBy("i")
    assert [r.bad for r in found.collect()] == [False, False, False, False, True, True, True]


def test_delivery_metadata_and_ranges(spark):
    rules = dl.DeliveryRules(allowed_ranges=("192.168.1.0/24", "10.0.0.0/8"))
    data = [(1, BODY, f"t={T0},v1={SIG}", "192.168.1.100:12345", at(T0)), (2, BODY, f"t={T0},v1={SIG}", "172.16.0.1:12345", at(T0))]
    rows = dl.checked(spark.createDataFrame(data, schemas.DELIVERY), KeyedHash(spark, b"whsec_test123"), rules).orderBy("delivery_id").collect()
    assert (rows[0].event_id, rows[0].type, rows[0].object_id, rows[0].created, rows[0].route, rows[0].supported) == ("evt_test", "invoice.created", "in_test", at(T0), "invoice", True)
    assert (rows[1].reason, rows[1].event_id) == ("ip_not_allowed", None)


def test_routes(spark):
    types = [*dl.SUPPORTED_TYPES, "customer.created", "invoice.voided"]
    rows = spark.createDataFrame([(t,) for t in types], "t string").select("t", F.col("t").isin(*dl.SUPPORTED_TYPES).alias("ok"), dl.route(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == ["invoice"] * 4 + ["subscription"] * 3 + ["charge"] * 2 + [None, "invoice"] and sum(r.ok for r in rows) == 9


# ---------------------------------------------------------------- queues


def queue(spark, n, stream="edges"):
    return spark.range(1, n + 1).select(F.lit(stream).alias("stream"), F.col("id").alias("offset"), F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("payload"))


def test_retention(spark):
    newest = retention.drop_oldest(queue(spark, 10), max_events=5)
    assert sorted(r.offset for r in newest.where("status = 'kept'").collect()) == [6, 7, 8, 9, 10] and newest.where("status = 'dropped'").count() == 5
    assert retention.drop_oldest(queue(spark, 10), max_bytes=1500).where("status = 'kept'").count() == 3
    assert retention.drop_oldest(queue(spark, 10)).where("status = 'kept'").count() == 10
    first = retention.reject_new(queue(spark, 6), max_events=5)
    assert [r.offset for r in first.where("status = 'rejected'").collect()] == [6]


def test_positions_over_slices(spark):
    df = queue(spark, 23).unionByName(queue(spark, 7, "billing")).where("offset % 5 <> 0")
    for r in retention.positions(df, "stream", "offset", slice_rows=4).collect():
        assert r.position == r.offset - r.offset // 5


def test_read_and_commit(spark):
    rows = queue(spark, 10)
    marks = spark.createDataFrame([("edges", 5), ("edges", 3)], "stream string, offset long")
    assert [r.offset for r in retention.oldest(rows, 5).collect()] == [1, 2, 3, 4, 5]
    assert retention.uncommitted(rows, marks).count() == 5 and retention.uncommitted(rows, marks.where("false")).count() == 10


def test_framing(spark):
    lines = retention.framed(queue(spark, 7), 3).orderBy("batch").collect()
    assert [r.records for r in lines] == [3, 3, 1] and json.loads(lines[1].line) == [{"id": 4}, {"id": 5}, {"id": 6}]


def test_quarantine(spark):
    rejects = spark.createDataFrame([("a", "edges", "r1", at(10)), ("b", "billing", "r2", at(20)), ("c", "dlq", "r3", at(30))], "e string, s string, r string, t timestamp")
    entries = quarantine.quarantined(rejects, F.col("e"), F.col("s"), F.col("r"), F.col("t"))
    assert sorted(r.original_event for r in entries.collect()) == ["a", "b"]
    again = quarantine.quarantined(rejects.where("e = 'a'"), F.col("e"), F.col("s"), F.lit("r9"), F.timestamp_seconds(F.lit(50)), F.lit("boom"), F.lit(503))
    merged = {r.original_event: r for r in quarantine.merged_attempts(entries.unionByName(again)).collect()}
    assert (merged["a"].attempt_count, merged["a"].reason, merged["a"].http_status_code, merged["a"].first_attempt_at, merged["a"].last_attempt_at) == (2, "r9", 503, at(10), at(50))
    kept, removed = quarantine.purged(entries, F.timestamp_seconds(F.lit(20)))
    assert [r.original_event for r in kept.collect()] == ["b"] and removed.first().removed == 1
    assert quarantine.purged(entries)[0].count() == 0
    sent, stays = quarantine.reprocessed(entries, F.col("reason") == "r1")
    assert [tuple(r) for r in sent.collect()] == [("edges", "a")] and stays.count() == 1
    assert [r.original_event for r in quarantine.listed(entries, 1).collect()] == ["a"]


def test_every_sanitiser_parts_what_it_cannot_use(spark):
    hasher = KeyedHash(spark, b"salt-of-this-test")
    usage = spark.createDataFrame([("cus_1", "f", "price_1", 5), ("", "f", "price_1", 5), (None, "f", None, 5), ("cus_2", "f", None, None)], schemas.USAGE)
    assert sz.sanitize_usage(usage, hasher).count() == 1
    refused = quarantine.rejected_rows(usage, sz.USAGE, F.lit(T0).cast("timestamp"))
    assert sorted(r.reason for r in refused.collect()) == ["empty_user", "empty_user", "missing_time"] and refused.columns == quarantine.COLUMNS
    headers = spark.createDataFrame([("sub_1", "cus_1", 5, "active"), ("", "cus_1", 5, "active"), ("sub_3", None, 5, "active")], "id string, customer string, created_at long, status string")
    lines = spark.createDataFrame([("sub_1", "price_1", None), ("sub_1", None, ""), (None, "price_1", "prod_1"), ("sub_3", "price_1", "prod_1")], "id string, price string, product string")
    assert sz.sanitize_subscription_headers(headers, hasher).count() == 1
    assert [r.item_kind for r in sz.sanitize_items(headers, lines, hasher).collect()] == ["price"]
    by_reason = lambda df, relation: sorted(r.reason for r in sz.split_raw(df, relation)[1].collect())
    assert by_reason(headers, sz.HEADERS) == ["empty_customer", "empty_id"] and by_reason(lines, sz.LINES) == ["empty_id", "no_item"]


def test_exhausted_batches_are_quarantined_with_their_status(spark, stage, tmp_path):
    log = str(tmp_path / "calls")
    open(log, "w").close()
    settings = ex.ExportSettings("http", base_url="https://x", routes={"edges": "/e"}, batch_size=2, retry=RetryPolicy(max_attempts=3))
    records = spark.range(10).coalesce(1).select(F.col("id").alias("offset"), F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("payload"))
    done = ex.export(records, "edges", settings, Privacy(b"s"), stage, "run", endpoint(log), wait=lambda seconds: None)
    kept = quarantine.Quarantine(str(tmp_path / "quarantine"))
    for _ in range(2):  # a repetition replaces itself
        kept.put(quarantine.failed_batches(done.failed, F.lit(T0).cast("timestamp")), "http", "run")
    found = {json.loads(r.original_event)[0]["id"]: (r.http_status_code, r.attempt_count, r.source) for r in kept.entries(spark).collect()}
    assert found == {4: (422, 1, "http"), 6: (0, 3, "http"), 8: (500, 3, "http")}


def test_fleet(spark):
    base = {"organization_id": "o", "version": "1", "uptime_seconds": 1, "mode": "m", "queue_depth": 1, "dlq_size": 0, "dropped_count": 0, "retry_count": 0, "last_flush_ts": 0}
    rows = [dict(base, agent_id="a", ts=t, queue_depth=d, dropped_count=c) for t, d, c in ((600, 20000, 1), (700, 10001, 2), (1200, 5, 2), (90000, 5, 2))]
    beats = spark.createDataFrame(rows, schemas.HEARTBEAT)
    assert fleet.latest(beats).first().ts == 90000
    assert [tuple(r) for r in fleet.gaps(beats, 100).orderBy("ts").collect()] == [("a", 700, 1200, 500), ("a", 1200, 90000, 88800)]
    alerts = {r.window_start: r for r in fleet.window_alerts(beats).collect()}
    assert alerts[600].depth_high and alerts[600].drops_rising and not alerts[1200].depth_high and not alerts[1200].drops_rising


# ---------------------------------------------------------------- exports


def test_guardrail():
    strict, raw = Privacy(b"s"), Privacy(b"", "passthrough", trusted_endpoints=("https://api.example.org",))
    free = Privacy(b"", "passthrough", allow_passthrough_export=True)
    for privacy, mode, url in ((strict, "http", "https://x"), (strict, "both", "https://x"), (raw, "file", ""), (raw, "http", "https://api.example.org"),
                               (raw, "both", "https://api.example.org/"), (free, "http", "https://x"), (free, "both", "https://x")):
        ex.guard_passthrough(privacy, mode, url)
    for mode in ("http", "both"):
        with pytest.raises(SettingsError):
            ex.guard_passthrough(raw, mode, "https://x")


def test_routing_checks():
    with pytest.raises(SettingsError):
        ex.ExportSettings("ftp")
    settings = ex.ExportSettings("both", paths={"edges": "/x", "billing": "/y"}, routes={"edges": "/e"})
    settings.check_stream("edges")
    for stream in ("billing", "usage", "nope", "dlq"):
        with pytest.raises(SettingsError):
            settings.check_stream(stream)


def endpoint(log):
    """Answers by the batch's first record: 0 is taken, 1 needs a second try, 2 is refused, 3 is unreachable, 4 stays broken."""

    def transport(url, headers, body):
        with open(log, "a") as f:
            f.write(json.dumps([url, headers, len(json.loads(body))]) + "\n")
        first = json.loads(body)[0]["id"] // 2
        tries = sum(json.loads(line)[1]["Idempotency-Key"] == headers["Idempotency-Key"] for line in open(log))
        if first == 3:
            raise ConnectionError("down")
        return {0: 200, 1: 503 if tries == 1 else 204, 2: 422}.get(first, 500)

    return transport


def test_export_to_both_sinks(spark, stage, tmp_path, monkeypatch):
    log, monkey_token = tmp_path / "log", "tok"
    monkeypatch.setenv("EXPORT_TOKEN", monkey_token)
    settings = ex.ExportSettings("both", paths={"edges": str(tmp_path / "edges")}, base_url="https://h", routes={"edges": "/e"}, token_env="EXPORT_TOKEN", batch_size=2, retry=RetryPolicy(3))
    records = spark.range(10).coalesce(1).select(F.col("id").alias("offset"), F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("payload"))
    result = ex.export(records, "edges", settings, Privacy(b"s"), stage, "run1", endpoint(str(log)), wait=lambda s: None)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "edges")).collect()]
    assert sorted(x["id"] for line in lines for x in line) == list(range(10)) and {len(line) for line in lines} == {2}
    failed = {r.batch: (r.attempts, r.http_status_code, r.error_message) for r in result.failed.collect()}
    assert failed == {2: (1, 422, "http 422"), 3: (3, 0, "ConnectionError"), 4: (3, 500, "http 500")}
    sent = [json.loads(line) for line in open(log)]
    assert {s[0] for s in sent} == {"https://h/e"} and {s[1]["Authorization"] for s in sent} == {"Bearer tok"} and len({s[1]["Idempotency-Key"] for s in sent}) == 5
    assert (result.file_error, result.http_error) == ("", "")


def test_file_trouble_does_not_stop_http(spark, stage, tmp_path):
    (tmp_path / "plain").write_text("in the way")
    settings = ex.ExportSettings("both", paths={"edges": str(tmp_path / "plain" / "x")}, base_url="https://h", routes={"edges": "/e"})
    records = spark.range(2).select(F.col("id").alias("offset"), F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("payload"))
    result = ex.export(records, "edges", settings, Privacy(b"s"), stage, "run2", endpoint(str(tmp_path / "log")))
    assert result.file_error and not result.http_error and result.failed.count() == 0


def test_exported_lines_read_back(spark):
    lines = spark.createDataFrame([('[{"kind":"a"},{"kind":"b"}]',), ('{"kind":"a"}',)], "value string")
    assert {r.kind: r.records for r in audit.edges_by_kind(audit.exported_records(lines)).collect()} == {"a": 2, "b": 1}


def test_a_rise_over_a_window_edge_shows_in_sliding_windows(spark):
    beats = spark.createDataFrame([("a", 590, 1, 0, 5), ("a", 610, 1, 0, 9)], "agent_id string, ts long, queue_depth int, dlq_size int, dropped_count long")
    rising = lambda slide: {r.window_start: r.drops_rising for r in fleet.window_alerts(beats, 600, slide).collect()}
    assert rising(None) == {0: False, 600: False}
    assert rising(300) == {0: False, 300: True, 600: False}
