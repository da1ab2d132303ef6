"""URL verdicts: rules first, then logistic regression on hashed character n-grams of host and path.

The labelled URL table is small by contract (``labelled_urls`` is the one that ships: host names of either kind under neutral
sites and paths). A larger one is reduced to a bounded, repeatable sample per verdict (by hash order, found by a distributed top-k)
before it reaches the driver, where the regression is trained in numpy. The weights, one per bucket, are broadcast. Rules
are a short list of literals; the longest that fits wins.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the
regression on empty text. Without labelled rows every url is allowed; with labels of one kind all get that one. Repeated
urls get equal verdicts. Columns ``host``, ``path``, ``rule``, ``verdict`` and ``score`` are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, char_ngrams, table

ALLOW, BLOCK = "allow", "block"
# Fixed values: (host, path, verdict) of the rules.
RULES = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))

# Words of host names that a reader would block, and of ordinary ones.
BAD_WORDS = (
    "adult", "adult-x", "ads", "ads-track", "betting", "bets", "casino", "casino-win", "cheap-meds", "cheap-pills", "clickbait", "escort", "fake-shop", "free-bets", "free-money",
    "gambling", "hot-cams", "jackpot", "lottery-win", "malware", "payday-loan", "phishing", "pills", "poker", "popup-ads", "porn", "scam", "slots", "spam", "spam-farm", "link-farm",
    "track", "tracker", "viagra", "warez", "win-prize", "xxx", "xxx-tube",
)
GOOD_WORDS = (
    "archive", "art", "books", "bridge", "building", "camping", "cycling", "city", "cooking", "culture", "docs", "energy", "example", "farmers", "film", "forest", "forum", "garden", "guide", "health", "history", "house",
    "journal", "language", "library", "maps", "market", "math", "museum", "music", "nature", "news", "ocean", "painting", "paper", "photo", "physics", "poetry", "radio", "reading", "recipes", "river", "school",
    "science", "sports", "station", "stories", "street", "theatre", "thing", "thunder", "tools", "travel", "university", "village", "weather", "wiki", "winter", "world", "writing",
)
SITES = ("{}.example.com", "www.{}.example.net", "m.{}.example.org", "blog.{}.example.com", "{}.example.org", "{}.example.net")
PATHS = ("/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/", "/en/{}/")

BUCKETS, SIZES = 1 << 16, (3, 4, 5)
#: Labelled urls of each verdict that training sees at most.
SAMPLE = 4000
EPOCHS, RATE, RIDGE = 12, 0.5, 1e-6
CHUNK = 4096


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def _choose(rules: Sequence[tuple[str, str, str]], pick) -> Column:
    """``pick(rule)`` of the longest rule that fits."""
    fits = [
        F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.lit(pick((host, path, verdict))))
        for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that a url is to be blocked."""
        total = np.zeros(len(hosts))
        for at in range(0, len(hosts), CHUNK):
            part = slice(at, at + CHUNK)
            owner, bucket = features(hosts[part], paths[part])
            n = len(hosts[part])
            counts = np.maximum(np.bincount(owner, minlength=n), 1)
            total[part] = np.bincount(owner, self.weights[bucket], n) / np.sqrt(counts)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram; host and path have bounds of their own and are hashed apart."""
    found = [
        *char_ngrams([f"^{h}$".encode() for h in hosts], SIZES, BUCKETS, seed=1),
        *char_ngrams([f"^{p}$".encode() for p in paths], SIZES, BUCKETS, seed=2),
    ]
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))


def train(hosts: list[str], paths: list[str], blocked: np.ndarray, seed: int = 5) -> UrlModel:
    """Adagrad on the log loss; allowed urls weigh twice as much, so that a url like none of the table is allowed."""
    model = UrlModel(np.zeros(BUCKETS), 0.0)
    if not len(blocked) or blocked.all() or not blocked.any():
        model.bias = 30.0 if len(blocked) and blocked.all() else -30.0
        return model
    owner, bucket = features(hosts, paths)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    begins = np.searchsorted(owner, np.arange(len(hosts) + 1))
    weight = np.where(blocked, 0.5 / blocked.mean(), 1.0 / (1 - blocked.mean()))
    rng, seen, bias_seen = np.random.default_rng(seed), np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(hosts))
        for at in range(0, len(hosts), 64):
            rows = shuffled[at : at + 64]
            parts = [bucket[begins[r] : begins[r + 1]] for r in rows]
            sizes = np.array([len(p) for p in parts])
            ids, local = np.concatenate(parts), np.repeat(np.arange(len(rows)), sizes)
            scale = 1 / np.sqrt(np.maximum(sizes, 1))
            total = np.bincount(local, model.weights[ids], len(rows)) * scale + model.bias
            wrong = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - blocked[rows]) * weight[rows] / len(rows)
            touched, where = np.unique(ids, return_inverse=True)
            grad = np.bincount(where, (wrong * scale)[local]) + RIDGE * model.weights[touched]
            seen[touched] += grad**2
            model.weights[touched] -= RATE * grad / np.sqrt(seen[touched])
            bias_seen += wrong.sum() ** 2
            model.bias -= RATE * wrong.sum() / np.sqrt(bias_seen)
    return model


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, verdict): every word under every site, with paths that say nothing about the verdict."""
    rows = [
        (f"https://{site.format(word)}{PATHS[(i + k) % len(PATHS)].format((i * 997 + k * 131) % 9973)}", verdict)
        for verdict, words in ((BLOCK, BAD_WORDS), (ALLOW, GOOD_WORDS)) for i, word in enumerate(words) for k, site in enumerate(SITES)
    ]
    return spark.createDataFrame(rows, "url string, verdict string")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """A model from (url, verdict), using at most ``sample`` distinct urls of each verdict."""
    host, path = host_path(F.col("url"))
    distinct = labelled.select(host.alias("host"), path.alias("path"), "verdict").distinct()
    rows = [r for verdict in (ALLOW, BLOCK) for r in distinct.where(F.col("verdict") == verdict).orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample).collect()]
    return train([r["host"] for r in rows], [r["path"] for r in rows], np.array([r["verdict"] == BLOCK for r in rows], bool))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and the rule's ``verdict`` (both null where none fits)."""
    host, path = host_path(F.col("url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    return parsed.select("*", _choose(rules, lambda r: r[0] + r[1]).alias("rule"), _choose(rules, lambda r: r[2]).alias("verdict"))


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the model's probability of a block)."""
    frame = ruled(pages, rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*frame.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    scored = frame.mapInArrow(run, schema)
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_urls(spark))).drop("url")
