"""Session defaults and durable staging of intermediate tables."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
RELEASE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_releasing: Counter[int] = Counter()
_before: dict[int, str | None] = {}
_releasing_lock = threading.Lock()

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "edgeloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder, because there the driver and the executors share one disk.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="edgeloom-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def side_by_side(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """Run independent driver steps at once; their results in the order given."""
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        return [future.result() for future in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over all cores by a hash, before costly work on each: a file may have fewer splits than there are cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside remove their shuffle files when they end; else those stay until the driver happens to collect its garbage.

    Only for writes: a frame that is collected twice reads the same shuffle files again, so the setting is given back at the end.
    Writes may run side by side in one session: the first one sets it and the last one gives it back."""
    session = spark._jsparkSession.hashCode()
    with _releasing_lock:
        if not _releasing[session]:
            _before[session] = spark.conf.get(RELEASE_CONF, None)
            spark.conf.set(RELEASE_CONF, "true")
        _releasing[session] += 1
    try:
        yield
    finally:
        with _releasing_lock:
            _releasing[session] -= 1
            if not _releasing[session]:
                before = _before.pop(session)
                spark.conf.unset(RELEASE_CONF) if before is None else spark.conf.set(RELEASE_CONF, before)


class Stage:
    """Writes intermediate tables once, so later reads neither recompute them nor depend on the
    executors that made them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
        self._files(self.root).deleteOnExit(self._path(self.root))  # what nobody cleared goes with the driver

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffles_released(self.spark):
            df.write.mode("errorifexists").parquet(path, compression="zstd")  # hashed ids are hex: half the bytes of the default
        return self.spark.read.schema(df.schema).parquet(path)

    def tables(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Stage independent tables side by side, so small writes do not leave the cluster idle."""
        return dict(zip(frames, side_by_side(self.spark, *[partial(self.table, df, name) for name, df in frames.items()])))

    def drop(self, *names: str) -> None:
        """Remove staged tables that nothing will read any more."""
        for name in names:
            self._files(self.root).delete(self._path(f"{self.root}/{name}"), True)

    def names(self) -> set[str]:
        """The tables staged so far."""
        files = self._files(self.root)
        return {s.getPath().getName() for s in files.listStatus(self._path(self.root))} if files.exists(self._path(self.root)) else set()

    def clear(self) -> None:
        """Remove the staged tables; call it once the results built on them have been written."""
        self._files(self.root).delete(self._path(self.root), True)
