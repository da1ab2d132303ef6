"""Checks on signed deliveries and messages. Each is an expression over the row, so the same code runs
on tables and on streams, and time is compared with the row's arrival, never with the clock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed_hash import KeyedHash, mac, mac_base64
from ..functions.net import address_columns, in_ranges
from ..schemas import BILLING_EVENT

DEFAULT_MAX_SKEW = 300
REJECTED, DUPLICATE, IGNORED, ACCEPTED = "rejected", "duplicate", "ignored", "accepted"

# The event types that are processed.
SUPPORTED_TYPES = (
    "invoice.created",
    "invoice.finalized",
    "invoice.payment_succeeded",
    "invoice.payment_failed",
    "customer.subscription.created",
    "customer.subscription.updated",
    "customer.subscription.deleted",
    "charge.succeeded",
    "charge.refunded",
)


@dataclass(frozen=True)
class DeliveryRules:
    max_skew: int = DEFAULT_MAX_SKEW
    max_body_bytes: int = 1_048_576
    allowed_ranges: tuple[str, ...] = ()


def _fields(header: Column) -> Column:
    """The header's ``name=value`` pairs, in order."""
    pairs = F.transform(F.split(header, ","), lambda p: F.split(F.trim(p), "=", 2))
    return F.filter(pairs, lambda kv: F.size(kv) == 2)


def _values(name: str, pairs: Column) -> Column:
    return F.transform(F.filter(pairs, lambda kv: kv[0] == name), lambda kv: kv[1])


def outside_skew(arrived: Column, seconds: Column, max_skew: int) -> Column:
    """Whether the arrival is more than ``max_skew`` away from ``seconds``, to the microsecond."""
    bounded = F.greatest(F.lit(-(10**12)), F.least(F.lit(10**12), seconds))
    return F.abs(F.unix_micros(arrived) - bounded * 1_000_000) > max_skew * 1_000_000


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def with_signature_error(df: DataFrame, hasher: KeyedHash, max_skew: int, alias: str) -> DataFrame:
    """Adds why a signature header is refused, null if it stands. Of repeated fields the last one counts.
    Reads body, signature_header and received_at. Each reading of the header is its own column, so none
    is evaluated twice."""
    header = F.coalesce("signature_header", F.lit(""))
    number = lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    pairs = F.col("_pairs")
    read = df.withColumn("_pairs", _fields(header))
    read = read.withColumns({"_times": F.transform(_values("t", pairs), number), "_given": F.coalesce(_last(_values("v1", pairs)), F.lit(""))}).drop("_pairs")
    read = read.withColumn("_stamp", F.coalesce(_last(F.col("_times")), F.lit(0).cast("bigint")))
    read = hasher.with_columns(read, {"_expected": mac(F.concat(F.col("_stamp").cast("string"), F.lit("."), "body"))})
    error = (
        F.when(header == "", "missing_header")
        .when(F.exists("_times", lambda t: t.isNull()), "invalid_timestamp")
        .when(F.col("_stamp") == 0, "missing_timestamp")
        .when(F.col("_given") == "", "missing_signature")
        .when(outside_skew(F.col("received_at"), F.col("_stamp"), max_skew), "outside_skew")
        .when(F.col("_given") != F.col("_expected"), "signature_mismatch")
    )
    return read.withColumn(alias, error).drop("_times", "_given", "_stamp", "_expected")


_NAMES = ("id", "type", "created", "data", "object")
_NAMED = "|".join(_NAMES)


def plain_names(body: Column) -> Column:
    """The names of an event's fields in lower case. Only a body that has one in another case is rewritten."""
    plain = body
    for name in _NAMES:
        plain = F.regexp_replace(plain, rf'(?i)"{name}"(\s*:)', f'"{name}"$1')
    return F.when(body.rlike(rf'"(?!(?:{_NAMED})")(?i:{_NAMED})"\s*:'), plain).otherwise(body)


def parse_event(body: Column) -> Column:
    """The event's fields; names are read in any case. Single quotes are refused."""
    return _event(plain_names(body))


def _event(plain: Column) -> Column:
    return F.from_json(plain, BILLING_EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})


def _balanced(depth: int) -> str:
    """A pattern of one pair of braces with at most ``depth`` levels, which takes no step back."""
    pattern = r"\{\}"
    for _ in range(depth - 1):
        pattern = rf"\{{(?:{pattern})*+\}}"
    return pattern


def leftover(body: Column) -> Column:
    """Whether anything but white space follows the first JSON object."""
    return _leftover(_bare(body))


def _bare(body: Column) -> Column:
    """The body with every text emptied."""
    return F.regexp_replace(body, r'(?s)"(?:[^"\\]|\\.)*+"', '""')


def _leftover(bare: Column) -> Column:
    shape = F.translate(F.regexp_replace(bare, r"[^{}\[\]]", ""), "[]", "{}")
    # Depth after every bracket; the first zero must be the last bracket, and nothing but space may follow it. Most bodies are so
    # shallow that a pattern tells; the others are walked.
    steps = F.transform(F.split(shape, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ended")),
        lambda acc, step: F.struct((acc["depth"] + step).alias("depth"), (acc["ended"] + F.when((step == -1) & (acc["depth"] <= 1), 1).otherwise(0)).alias("ended")),
    )
    whole = F.when(shape.rlike(rf"^{_balanced(8)}\z"), True).otherwise(walk["ended"] == 1)
    return ~F.coalesce(bare.rlike(r"^\s*\{") & bare.rlike(r"\}\s*\z") & whole, F.lit(False))


def wrong_types(body: Column) -> Column:
    """Whether the event's own id or type is there but no text. Fields of nested objects do not count; of repeated fields the last
    one does, as in parsing."""
    return _wrong_types(F.try_parse_json(plain_names(body)))


def _wrong_types(top: Column) -> Column:
    kind = lambda name: F.schema_of_variant(F.try_variant_get(top, f"$.{name}", "variant"))
    bad = lambda name: ~F.coalesce(kind(name), F.lit("VOID")).isin("STRING", "VOID")
    return bad("id") | bad("type")


def route(kind: Column) -> Column:
    """Where an event goes: by the prefix of its type. Charge events are accepted and need nothing done."""
    return (
        F.when(kind.startswith("invoice."), "invoice")
        .when(kind.startswith("customer.subscription."), "subscription")
        .when(kind.startswith("charge."), "charge")
    )


def checked(deliveries: DataFrame, hasher: KeyedHash, rules: DeliveryRules) -> DataFrame:
    """Each delivery with the reason it is refused (null if it stands) and its event's metadata."""
    placed = address_columns(deliveries.withColumn("body", F.coalesce("body", F.lit(""))), "remote_addr")
    signed = with_signature_error(placed, hasher, rules.max_skew, "_signature")
    early = F.when(~in_ranges(list(rules.allowed_ranges)), "ip_not_allowed").when(F.octet_length("body") > rules.max_body_bytes, "body_too_large")
    read = signed.withColumns({"_plain": plain_names(F.col("body")), "_bare": _bare(F.col("body"))})  # each reading of the body once
    parsed = read.withColumns({"_event": _event(F.col("_plain")), "_top": F.try_parse_json("_plain")})
    broken = F.when(F.col("_event").isNull() | F.col("_event._corrupt").isNotNull() | _leftover(F.col("_bare")) | _wrong_types(F.col("_top")), "json_parse_error")
    # One flat coalesce: filters on `detail` are pushed down as expressions, so it must not nest.
    parsed = parsed.withColumn("detail", F.coalesce(early, F.col("_signature"), broken))
    detail = F.col("detail")
    reason = F.when(detail.isin("ip_not_allowed", "json_parse_error"), detail).when(detail.isNotNull(), "signature_invalid")
    text_of = lambda name: F.when(detail.isNull(), F.coalesce(F.col(name), F.lit("")))
    named = parsed.select(
        "delivery_id", "body", "signature_header", "remote_addr", "received_at", reason.alias("reason"), "detail",
        text_of("_event.id").alias("event_id"), text_of("_event.type").alias("type"), text_of("_event.data.object.id").alias("object_id"),
        F.when(detail.isNull(), F.timestamp_seconds(F.coalesce("_event.created", F.lit(0)))).alias("created"),
    )
    return named.withColumns({"supported": F.col("type").isin(*SUPPORTED_TYPES), "route": route(F.col("type"))})


def first_per_key(df: DataFrame, key: str, row_id: str, order: list[str], counts: Column) -> DataFrame:
    """Ids of the rows that come first for their key among those that count. The minimum is pre-aggregated
    before the shuffle, so a key repeated in a third of all rows never gathers in one task."""
    firsts = df.groupBy(key).agg(F.min(F.when(counts, F.struct(*order, row_id))).alias("_first")).where(F.col("_first").isNotNull())
    return firsts.select(F.col(f"_first.{row_id}").alias(row_id), key)


def outcome(first: Column) -> Column:
    """What becomes of a checked delivery; ``first`` is null unless it is the first of its event."""
    return F.when(F.col("detail").isNotNull(), REJECTED).when(first.isNull(), DUPLICATE).when(F.col("supported"), ACCEPTED).otherwise(IGNORED)


def classified(deliveries: DataFrame, hasher: KeyedHash, rules: DeliveryRules, seen: DataFrame | None = None, stage=None) -> DataFrame:
    """Adds ``outcome``: rejected, duplicate, ignored or accepted. ``seen`` holds event ids of earlier runs.

    The first delivery of each event is found by event id and joined back by the unique delivery id. With a ``stage`` the checked
    rows are stored, so that no body is hashed and parsed for each of the two.
    """
    rows = checked(deliveries, hasher, rules)
    if stage is not None:
        rows = stage.table(rows, "checked")
    firsts = first_per_key(rows, "event_id", "delivery_id", ["received_at"], F.col("detail").isNull())
    if seen is not None:
        firsts = firsts.join(seen.select("event_id"), "event_id", "left_anti")
    marked = rows.join(firsts.select("delivery_id", F.lit(True).alias("_first")), "delivery_id", "left")
    return marked.withColumn("outcome", outcome(F.col("_first"))).drop("_first")


def delivery_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("deliveries"))


def canonical(events: DataFrame, billing: DataFrame) -> DataFrame:
    """Each accepted event beside the stored object it names; only the id of the event is trusted."""
    return events.join(billing, F.col("object_id") == F.col("id"), "left")


def message_error(max_skew: int, nonce_seen: Column) -> Column:
    """Why a signed raw-body message is refused: HMAC over ``ts|nonce|body``, base64. Needs the key column."""
    expected = mac_base64(F.concat_ws("|", F.col("ts").cast("string"), F.col("nonce"), F.col("body")))
    return (
        F.when(F.coalesce("signature", F.lit("")) == "", "missing_signature")
        .when(outside_skew(F.col("received_at"), F.col("ts"), max_skew), "outside_skew")
        .when(nonce_seen, "replayed")
        .when(F.col("signature") != expected, "signature_mismatch")
    )


def spending(live: DataFrame, ttl: int, spent: DataFrame | None = None) -> DataFrame:
    """(nonce, message_id, ts, place) of the messages that spend their nonce: the first with it, and each later one that arrives
    more than ``ttl`` seconds after the time stated by the message that spent it before. ``spent`` holds the (nonce, ts) of
    the last ones of earlier runs.

    Only the first arrival of each second can spend a nonce, so the chain walked per nonce is at most one
    entry per second however often the nonce is replayed.
    """
    second = F.floor(F.unix_micros("received_at") / 1_000_000)
    order = F.struct("received_at", "message_id")
    firsts = live.groupBy("nonce", second.alias("s")).agg(F.min_by("message_id", order).alias("id"), F.min_by("ts", order).alias("ts"))
    chains = firsts.groupBy("nonce").agg(F.sort_array(F.collect_list(F.struct("s", "id", "ts"))).alias("chain"))
    before = F.lit(None).cast("bigint")
    if spent is not None:
        chains = chains.join(spent.select("nonce", F.col("ts").alias("_before")), "nonce", "left")
        before = F.col("_before")
    start = F.struct(before.alias("ts"), F.array().cast("array<struct<id:bigint,ts:bigint>>").alias("found"))
    step = lambda acc, m: F.when(
        acc["ts"].isNull() | (m["s"] - acc["ts"] > ttl), F.struct(m["ts"].alias("ts"), F.concat(acc["found"], F.array(F.struct(m["id"].alias("id"), m["ts"].alias("ts")))).alias("found"))
    ).otherwise(acc)
    walked = chains.select("nonce", F.posexplode(F.aggregate("chain", start, step, lambda acc: acc["found"])).alias("place", "_m"))
    return walked.select("nonce", F.col("_m.id").alias("message_id"), F.col("_m.ts").alias("ts"), "place")


def verified_messages(messages: DataFrame, hasher: KeyedHash, max_skew: int = DEFAULT_MAX_SKEW, ttl: int = 3600) -> DataFrame:
    """Adds ``reason``. The nonce of a signed message inside the skew window can be used once per ``ttl``."""
    stale = (F.coalesce("signature", F.lit("")) == "") | outside_skew(F.col("received_at"), F.col("ts"), max_skew)
    spends = spending(messages.where(~stale), ttl).select("message_id", F.lit(True).alias("_spends"))
    marked = messages.join(spends, "message_id", "left")
    return hasher.with_columns(marked, {"reason": message_error(max_skew, F.col("_spends").isNull())}).drop("_spends")
