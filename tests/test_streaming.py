import time
import uuid

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from edgeloom import schemas
from edgeloom.functions.keyed_hash import KeyedHash, mac_base64
from edgeloom.operators.combine import combine
from edgeloom.operators.deliveries import classified, verified_messages
from edgeloom.operators.matchers import ExactMatcher, LinkInputs, TemporalMatcher, View
from edgeloom.plans.linkage import Ensemble
from edgeloom.recipe import EXACT, TEMPORAL, Recipe
from edgeloom.streaming import fleet, linkage, sinks, webhook
from edgeloom.streaming.tables import LiveTable
from test_linkage import rows
from test_operators import BODY, SIG, T0, at

ONCE = {"availableNow": True}


def stream(spark, path, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def test_an_event_id_is_handled_once_and_for_good(spark, tmp_path):
    """Runs from one checkpoint: a repeat after any time is refused, also after a restart; batch and stream give equal rows."""
    landed, hasher = str(tmp_path / "landed"), KeyedHash(spark, b"whsec_test123")
    rules = webhook.DeliveryRules(max_skew=10**9)
    good, bad = f"t={T0},v1={SIG}", f"t={T0},v1=00"
    seen = []

    def land(*deliveries):
        spark.createDataFrame(list(deliveries), schemas.DELIVERY).coalesce(1).write.mode("append").parquet(landed)

    def run():
        intake = webhook.DeliveryIntake(str(tmp_path / "out"), hasher, rules, lambda events, number: seen.append((number, events.count())), shards=4, fan=2)
        sinks.start(stream(spark, landed, schemas.DELIVERY), intake, str(tmp_path / "cp"), ONCE).awaitTermination()
        return sorted((r.delivery_id, r.outcome) for r in intake.deliveries(spark).collect()), intake.rejects(spark).count(), intake

    land((1, BODY, good, "x", at(T0)), (2, BODY, bad, "x", at(T0)))
    assert run()[:2] == run()[:2] == ([(1, "accepted"), (2, "rejected")], 1)
    for i in range(3, 8):  # months later, and one that is older than all before it
        land((i, BODY, good, "x", at(T0 + 9_000_000 * (i - 4))))
    outcomes, refused, intake = run()
    assert (outcomes[2:], refused, seen) == ([(i, "duplicate") for i in range(3, 8)], 1, [(0, 1), *((i, 0) for i in range(1, 6))])
    batch = classified(spark.read.schema(schemas.DELIVERY).parquet(landed).where("delivery_id <> 3"), hasher, rules)
    assert sorted((r.delivery_id, r.outcome) for r in batch.collect()) == [o for o in outcomes if o[0] != 3]
    last = spark.read.schema(schemas.DELIVERY).parquet(landed).where("delivery_id = 7")
    intake(last, 5)  # a replay replaces what its first try wrote
    assert sorted((r.delivery_id, r.outcome) for r in intake.deliveries(spark).collect()) == outcomes


def test_landed_halves_have_a_file_for_each_core(spark, tmp_path):
    from edgeloom.catalog import streams

    one_file = spark.range(1000).selectExpr("id AS k").coalesce(1)
    cores, taken = 6, []
    context = type("Context", (), {"defaultParallelism": cores})()
    session = type("Session", (), {"sparkContext": context, "readStream": spark.readStream})()
    streams._fed(session, str(tmp_path), {"rows": one_file}, lambda rows: rows, lambda batch, number: taken.append(batch.count()))
    assert sum(taken) == 1000 and len(list((tmp_path / "landing" / "rows").glob("*.parquet"))) == 2 * cores


def test_messages_of_a_stream_are_judged_as_in_batch(spark, tmp_path):
    """Several micro-batches with a restart in between: a nonce is spent for its time, and before its signature is checked."""
    hasher, landed = KeyedHash(spark, b"key-of-the-test"), str(tmp_path / "landed")
    schema = "message_id long, nonce string, ts long, body string, signature string, received_at timestamp"

    def message(i, nonce, sign=True, wait=0):
        row = spark.createDataFrame([(i, nonce, T0 + wait, "b", None, at(T0 + wait))], schema)
        right = mac_base64(F.concat_ws("|", F.col("ts").cast("string"), "nonce", "body"))
        return hasher.with_columns(row, {"signature": right if sign else F.lit("AAAA")})

    def judged(ttl=3600):
        intake = webhook.MessageIntake(str(tmp_path / "out"), hasher, 300, ttl, shards=4, fan=2)
        sinks.start(stream(spark, landed, schema), intake, str(tmp_path / "cp"), ONCE).awaitTermination()
        return {r.message_id: r.reason for r in intake.messages(spark).collect()}

    for m in (message(1, "a", sign=False), message(2, "b")):
        m.coalesce(1).write.mode("append").parquet(landed)
    assert judged() == {1: "signature_mismatch", 2: None}
    for m in (message(3, "a", wait=5), message(4, "b", wait=3600), message(5, "c", wait=3601), message(6, "b", wait=3601), message(7, "b", wait=7000), message(8, "a", wait=9000)):
        m.coalesce(1).write.mode("append").parquet(landed)
    found = judged()
    batch = verified_messages(spark.read.schema(schema).parquet(landed), hasher)
    assert found == judged() == {r.message_id: r.reason for r in batch.collect()}
    assert found == {1: "signature_mismatch", 2: None, 3: "replayed", 4: "replayed", 5: None, 6: None, 7: "replayed", 8: None}


def test_events_meet_the_newest_version_of_their_object(spark, tmp_path):
    versions = [("in_1", 1, "open"), ("in_2", 1, "open")]
    target = webhook.CanonicalObjects(str(tmp_path / "out"), lambda: spark.createDataFrame(versions, "id string, version long, status string"))
    events = spark.createDataFrame([("e1", "in_1"), ("e2", "in_9")], "event_id string, object_id string")
    target(events, 0)
    versions.append(("in_1", 2, "paid"))
    target(events, 1)
    found = {(r.micro_batch, r.event_id): r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(0, "e1"): "open", (0, "e2"): None, (1, "e1"): "paid", (1, "e2"): None}


def test_live_table_reads_what_its_keys_need(spark, tmp_path):
    """Twenty batches, each of one key: folders stay few, and what a batch reads does not grow with the history of other keys."""
    total = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    table = LiveTable(str(tmp_path / "t"), "k STRING, n BIGINT", "k", total, shards=16, fan=3)
    opened = []
    for batch in range(20):
        rows = spark.createDataFrame([(f"key{batch}", 1)] * 50 + [("often", 1)], "k STRING, n BIGINT")
        table.put(rows, batch)
        table.put(rows, batch)  # replayed
        found = table.read(spark, batch, rows.where("k <> 'often'"))
        plan = found._jdf.queryExecution().executedPlan()
        assert [tuple(r) for r in found.collect()] == [(f"key{batch}", 50)]
        opened.append(plan.toString().count("PartitionFilters: [isnotnull(shard") or plan.toString().count("(shard"))
        assert len(list((tmp_path / "t").glob("span=*"))) <= 12
    assert all(opened)
    assert {r.k: r.n for r in table.read(spark).collect()} == {"often": 20, **{f"key{b}": 50 for b in range(20)}}
    shards = lambda batch: sum(f.stat().st_size for f in (tmp_path / "t").glob(f"span=*/shard={batch}/*.parquet"))
    assert max(map(shards, range(16))) < 0.6 * sum(map(shards, range(16)))


def far_apart(spark):
    """Usage and billing rows up to a year apart: owners, users of a named SKU near in time, and others."""
    day, users = 86_400, [f"syn_cust_{i:016x}" for i in range(6)]
    usages = [(users[i % 6], "api", f"syn_price_{i % 4:016x}", T0 + day * (37 * i % 365)) for i in range(40)]
    usages += [(users[1], "api", "syn_price_" + "0" * 15 + "2", T0 + 600), (users[2], "api", "syn_price_" + "0" * 15 + "3", T0 + 200 * day)]
    subs = [(f"syn_sub_{i:016x}", users[(i * 5) % 6], [f"syn_price_{i % 4:016x}"] * (1 + i % 2), [f"syn_prod_{i % 2:016x}"], T0 + day * (83 * i % 365) + 300, "active") for i in range(12)]
    invs = [(f"syn_inv_{i:016x}", users[(i * 7) % 6], "", 100, "usd", "paid", T0 + day * (111 * i % 365) + 900, True) for i in range(9)]
    return LinkInputs(*(spark.createDataFrame(r, s) for r, s in ((usages, schemas.USAGE), (subs, schemas.SUBSCRIPTION_LITE), (invs, schemas.INVOICE_LITE))))


@pytest.mark.parametrize("recipe", [Recipe(), Recipe(threshold=0.5)], ids=["pruned", "all evidence"])
def test_live_links_equal_batch_links(spark, stage, tmp_path, recipe):
    """Rows far apart and out of order over several micro-batches, with a restart: the links are those of one batch run."""
    hasher, inputs, root = KeyedHash(spark, fx.MATCHER_SALT), far_apart(spark), f"{stage.root}/{uuid.uuid4().hex}"
    ensemble = Ensemble.default(recipe, hasher)
    tables = {"usages": inputs.usages, "subs": inputs.subs, "invs": inputs.invs}
    for run in (0, 1):
        for name, df in tables.items():
            part = df.where(F.pmod(F.xxhash64(*df.columns), F.lit(2)) == run)
            part.repartition(2).write.mode("append").parquet(str(tmp_path / name))
        read = {name: stream(spark, str(tmp_path / name), df.schema, 1 if run else 2) for name, df in tables.items()}
        live = linkage.LiveLinks(root, ensemble, shards=3, fan=2)
        sinks.start(linkage.link_rows(**read), live, f"{root}/cp", ONCE).awaitTermination()
    batch = ensemble.link(ensemble.view(inputs, stage), stage)
    assert rows(live.current(spark)) == rows(batch) and {r["kind"] for r in batch.collect()} >= {"user->subscription", "user->invoice", "user->price"}


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_pairs_near_in_time_are_listed_from_the_kept_sides(spark, stage, tmp_path, hot_rows):
    """Usage and invoices out of order over three batches, one of them replayed: the pairs of a batch run, repeats counted, and neither
    a pair nor a row of state is kept."""
    users, landed = [f"syn_cust_{i:016x}" for i in range(3)], str(tmp_path / "landed")
    used = spark.createDataFrame([(users[i % 3], "api", "syn_price_" + "0" * 16, T0 + 700 * (i % 14)) for i in range(30)] + [(users[0], "api", "", T0 - 3600)], schemas.USAGE)
    invs = spark.createDataFrame([(f"syn_inv_{i:016x}", users[0], "", 1, "usd", "paid", T0 + 2500 * i, True) for i in range(5)], schemas.INVOICE_LITE)
    rows_in = linkage.link_rows(used, None, invs)
    rows_in.repartition(3).write.parquet(landed)
    live, seen = linkage.LiveTimes(str(tmp_path / "times"), TemporalMatcher(3600), shards=3, fan=2, hot_rows=hot_rows), []

    def kept(rows, number):
        seen.append(number)
        live(rows, number)
        live(rows, number)

    sinks.start(stream(spark, landed, rows_in.schema), kept, str(tmp_path / "cp"), ONCE).awaitTermination()
    found = live.evidence(spark, stage, schemas.USER_INVOICE)
    batch = TemporalMatcher(3600).invoices(View.compact(LinkInputs(used, spark.createDataFrame([], schemas.SUBSCRIPTION_LITE), invs)))
    listed = lambda df: sorted((r["from"], r["to"], r["note"], r["n"], r["at"], r["confidence"]) for r in df.collect())
    assert seen == [0, 1, 2] and listed(found) == listed(batch) and sum(r["n"] for r in batch.collect()) > 60
    assert not (tmp_path / "cp" / "state").exists()
    assert live.by_time.read(spark).count() <= 31 and live.targets[linkage.INVOICE].read(spark).count() == 5


def test_incremental_combine_over_stream_joins(spark, stage, tmp_path):
    """Evidence of two stream joins; the touched keys are combined again each time, and a replayed batch replaces itself."""
    hasher, recipe, inputs = KeyedHash(spark, fx.MATCHER_SALT), Recipe(), fx.matcher_inputs(spark)
    for name, df in (("usages", inputs.usages), ("invs", inputs.invs)):
        df.repartition(2).write.parquet(str(tmp_path / name))
    usages, invs = stream(spark, str(tmp_path / "usages"), schemas.USAGE), stream(spark, str(tmp_path / "invs"), schemas.INVOICE_LITE)
    evidence = linkage.exact_evidence(usages, invs, ExactMatcher(), schemas.USER_INVOICE).unionByName(linkage.temporal_evidence(usages, invs, TemporalMatcher(3600), schemas.USER_INVOICE))
    root = f"{stage.root}/{uuid.uuid4().hex}"
    target = linkage.IncrementalCombine(recipe, hasher, [EXACT, TEMPORAL], f"{root}/evidence", f"{root}/edges", shards=4)
    batches = []

    def kept(rows, number):
        batches.append((stage.table(rows, f"batch-{number}"), number))
        target(batches[-1][0], number)

    sinks.start(evidence, kept, f"{root}/cp", ONCE).awaitTermination()
    view = View.compact(inputs)
    plain = ExactMatcher().invoices(view).unionByName(TemporalMatcher(3600).invoices(view))
    batch = combine(plain, recipe, hasher, stage, Ensemble.default(recipe, hasher).names)
    assert rows(target.current(spark)) == rows(batch) and len(rows(batch)) == 2
    target(*batches[-1])
    assert rows(target.current(spark)) == rows(batch)


def test_framed_stream_replay_overwrites(spark, tmp_path):
    sink = sinks.FramedFiles(str(tmp_path / "out"), "billing", batch_size=2)
    records = spark.range(5).select(F.concat(F.lit('{"id":'), "id", F.lit("}")).alias("payload"))
    sink(records, 0)
    sink(records, 0)
    sink(records, 1)
    assert spark.read.text(str(tmp_path / "out")).count() == 6


def test_silences_are_told_when_they_begin_and_end(spark, tmp_path):
    """Rows in no order within the delay, two files a run, a restart between the runs, an agent that falls silent for good."""
    first = [("a", 1000), ("b", 990), ("a", 1010)], [("a", 1005), ("b", 1030), ("c", 1020)]
    second = [("b", 1100), ("b", 1060), ("c", 1085)], [("c", 1130), ("b", 1131), ("b", None), (None, 1)]
    told = []
    for run in (first, second):
        for beats in run:
            spark.createDataFrame(beats, "agent_id string, ts long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(1.1)  # files are taken by the second they were landed in
        beats = spark.readStream.schema("agent_id string, ts long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = sinks.start(fleet.silences(beats, interval=20, delay=30), sinks.BatchTables(f"{tmp_path}/out"), f"{tmp_path}/checkpoint", {"availableNow": True})
        query.awaitTermination()
        stored = spark.read.schema(fleet.SILENCE).parquet(f"{tmp_path}/out")
        told.append([tuple(r) for r in stored.select("agent_id", "previous_ts", "ts", "silent_seconds").collect()])
    assert told[0] == []  # the clock stands at 1000
    # At 1101 b's heartbeat of 1030 is followed within the limit of 40 seconds; a and c are not.
    assert sorted(told[1], key=str) == sorted([("a", 1010, None, None), ("c", 1020, None, None), ("c", 1020, 1085, 65)], key=str)
