"""The delivery stream: check, de-duplicate, route; and signed messages.

Both targets look every key up in a stored table (`LiveTable`), so a repeat is recognised whenever it comes and also after a
restart, and no row is ever late. A batch run over the same rows (`operators.deliveries`) gives the same rows, as long as
deliveries of one event, or messages of one nonce, are landed in the order of their arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed_hash import KeyedHash
from ..operators.deliveries import ACCEPTED, DeliveryRules, canonical, checked, first_per_key, message_error, outcome, outside_skew, spending
from ..operators.quarantine import Quarantine, quarantined
from ..session import Stage
from .tables import FAN, SHARDS, LiveTable


def rejects(rows: DataFrame) -> DataFrame:
    """Refused deliveries as quarantine rows."""
    bad = rows.where(F.col("detail").isNotNull())
    return quarantined(bad, F.col("body"), F.lit("billing"), F.col("reason"), F.col("received_at"), F.col("detail"))


class DeliveryIntake:
    """A micro-batch sink for webhook deliveries.

    Each delivery is checked once and stored with its ``outcome`` (rejected, duplicate, ignored or accepted) under ``deliveries``;
    refused ones also as quarantine rows in ``quarantine``. The ids of handled events are kept for good, by hash of the id; a
    batch looks its own ids up there. ``on_events`` receives the accepted deliveries of the batch, stored, and its number.
    """

    def __init__(self, root: str, hasher: KeyedHash, rules: DeliveryRules, on_events: Callable[[DataFrame, int], None] | None = None, shards: int = SHARDS, fan: int = FAN):
        self.root, self.hasher, self.rules, self.on_events = root.rstrip("/"), hasher, rules, on_events
        self.quarantine = Quarantine(f"{self.root}/quarantine")
        self.handled = LiveTable(f"{self.root}/handled", "event_id STRING", "event_id", DataFrame.distinct, shards, fan)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stage = Stage(spark)
        try:
            rows = stage.table(checked(batch, self.hasher, self.rules), "checked")
            good = rows.where(F.col("detail").isNull())
            firsts = stage.table(first_per_key(good, "event_id", "delivery_id", ["received_at"], F.lit(True)), "firsts")
            earlier = self.handled.read(spark, number - 1, firsts)
            fresh = stage.table(firsts.join(earlier, "event_id", "left_anti"), "fresh")
            self.handled.put(fresh, number)
            marked = rows.join(fresh.select("delivery_id", F.lit(True).alias("_first")), "delivery_id", "left")
            folder = f"{self.root}/deliveries/micro_batch={number}"
            marked.withColumn("outcome", outcome(F.col("_first"))).drop("_first").write.mode("overwrite").parquet(folder)
            self.quarantine.put(rejects(rows), "intake", number)
            if self.on_events:
                self.on_events(spark.read.parquet(folder).where(F.col("outcome") == ACCEPTED), number)
        finally:
            stage.clear()

    def deliveries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/deliveries").drop("micro_batch")

    def rejects(self, spark: SparkSession) -> DataFrame:
        return self.quarantine.entries(spark)


class CanonicalObjects:
    """A target for accepted deliveries: each beside the newest stored version of the object it names.

    ``stored`` is asked for the billing objects as they are when a batch runs; they carry ``id`` and ``version``, of which the
    highest counts. Only the ids of the batch are looked for, before versions are compared.
    """

    def __init__(self, root: str, stored: Callable[[], DataFrame]):
        self.root, self.stored = root.rstrip("/"), stored

    def __call__(self, events: DataFrame, number: int) -> None:
        asked = events.select(F.col("object_id").alias("id")).distinct()
        versions = self.stored().join(asked, "id", "left_semi")
        fields = [c for c in versions.columns if c != "id"]
        newest = versions.groupBy("id").agg(F.max_by(F.struct(*fields), "version").alias("_v")).select("id", "_v.*")
        canonical(events, newest).write.mode("overwrite").parquet(f"{self.root}/micro_batch={number}")


class MessageIntake:
    """A micro-batch sink for signed messages, with a stored table of spent nonces.

    A message in the skew window spends its nonce for ``ttl`` seconds before its signature is checked, as in batch
    (`verified_messages`), so a wrong signature followed by a right one with the same nonce gives none. Every message is stored
    with its ``reason`` (null if it stands) under ``messages``.
    """

    def __init__(self, root: str, hasher: KeyedHash, max_skew: int, ttl: int = 3600, shards: int = SHARDS, fan: int = FAN):
        self.root, self.hasher, self.max_skew, self.ttl = root.rstrip("/"), hasher, max_skew, ttl
        newest = lambda rows: rows.groupBy("nonce").agg(F.max_by("ts", "turn").alias("ts"), F.max("turn").alias("turn"))
        self.spent = LiveTable(f"{self.root}/spent", "nonce STRING, ts BIGINT, turn BIGINT", "nonce", newest, shards, fan)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stage = Stage(spark)
        try:
            rows = stage.table(batch, "rows")
            live = rows.where((F.coalesce("signature", F.lit("")) != "") & ~outside_skew(F.col("received_at"), F.col("ts"), self.max_skew))
            spends = stage.table(spending(live, self.ttl, self.spent.read(spark, number - 1, live)), "spends")
            self.spent.put(spends.groupBy("nonce").agg(F.max_by("ts", "place").alias("ts")).withColumn("turn", F.lit(number).cast("bigint")), number)
            marked = rows.join(spends.select("message_id", F.lit(True).alias("_spends")), "message_id", "left")
            signed = self.hasher.with_columns(marked, {"reason": message_error(self.max_skew, F.col("_spends").isNull())}).drop("_spends")
            signed.write.mode("overwrite").parquet(f"{self.root}/messages/micro_batch={number}")
        finally:
            stage.clear()

    def messages(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/messages").drop("micro_batch")
