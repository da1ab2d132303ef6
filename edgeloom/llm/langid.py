"""Language identification by a byte convolutional network.

Filters of several widths run over the raw UTF-8 bytes of fixed-length windows, are max-pooled over the window and feed a
softmax. A filter on one-hot bytes is a sum of table rows, one per offset, so the network is applied by looking up rows
for pairs of bytes. It is trained in numpy on windows of a bounded sample of labelled documents; whole texts are
predicted: the class probabilities of all windows of a text are averaged, weighted by the bytes they hold.

Every language that labels a text with a letter is learned. The sample draws about ``per_language`` documents of each language, and
``excerpts`` windows of each and one from its first letter on; over ``FULL_SAMPLE`` languages fewer of each, down to ``LEAST``, in more steps.
That bounds what the driver sees for each language. Training is repeatable (rows are ordered by a hash and the generator is seeded).

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without any labelled row that has a letter all texts
are ``und`` with score 0. Repeated rows get equal results. Other columns pass through, except the added ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, table, uniform

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANGUAGE, EXCERPTS, STEPS, BATCH, RATE = 400, 3, 500, 96, 0.02
#: Languages of which the full sample is drawn; beyond it, documents drawn of each at least.
FULL_SAMPLE, LEAST = 400, 40
CHUNK = 64
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


@dataclass
class ByteNetwork:
    """``tables[w][k]``: 256 x FILTERS, what byte at offset k adds to filters of width w; then a linear layer."""

    labels: list[str]
    tables: dict[int, np.ndarray]
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> ByteNetwork:
        features = FILTERS * len(WIDTHS)
        tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        return cls(labels, tables, np.zeros(features, np.float32), rng.normal(0, 0.1, (features, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def pool(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled responses and the place of each maximum."""
        best, places = [], []
        for w, table_ in self.tables.items():
            n = windows.shape[1] - w + 1
            response = sum(table_[k][windows[:, k : k + n]] for k in range(w))
            at = response.argmax(1)
            places.append(at)
            best.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        return np.concatenate(best, 1), np.concatenate(places, 1)

    def train(self, windows: np.ndarray, classes: np.ndarray, rng: np.random.Generator, steps: int) -> None:
        """Adam on the cross entropy of random batches, every class drawn alike often."""
        groups = [np.flatnonzero(classes == c) for c in range(len(self.labels))]
        params = [*self.tables.values(), self.shift, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            chosen = np.array([rng.choice(groups[c]) for c in rng.integers(0, len(groups), BATCH)])
            x = windows[chosen]
            pooled, places = self.pool(x)
            hidden = np.maximum(pooled + self.shift, 0)
            wrong = _softmax(hidden @ self.dense + self.bias)
            wrong[np.arange(BATCH), classes[chosen]] -= 1
            wrong /= BATCH
            back = (wrong @ self.dense.T) * (hidden > 0)
            grads = []
            for i, (w, table_) in enumerate(self.tables.items()):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                grad = np.zeros_like(table_)
                for k in range(w):
                    bytes_ = np.take_along_axis(x, places[:, part] + k, 1)
                    np.add.at(grad[k], (bytes_, np.arange(FILTERS)[None, :]), back[:, part])
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ wrong, wrong.sum(0)]
            pace = RATE * (1 - (step - 1) / steps)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


class Reader:
    """Applies a network: one row per pair of bytes holds what the pair adds to all filters that start there."""

    def __init__(self, net: ByteNetwork):
        self.net = net
        pairs = [(t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS) for t in net.tables.values()]
        self.pairs = np.ascontiguousarray(np.concatenate(pairs, 1))
        self.third, self.tail = net.tables[3][2], (net.tables[4][2][:, None, :] + net.tables[4][3][None, :, :]).reshape(65536, FILTERS)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), CHUNK):
            x = windows[at : at + CHUNK]
            pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            rows = self.pairs[pair]
            two = rows[:, :, :FILTERS].max(1)
            three = (rows[:, :-1, FILTERS : 2 * FILTERS] + self.third[x[:, 2:]]).max(1)
            four = (rows[:, :-2, 2 * FILTERS :] + self.tail[pair[:, 2:]]).max(1)
            hidden = np.maximum(np.concatenate((two, three, four), 1) + self.net.shift, 0)
            out.append(_softmax(hidden @ self.net.dense + self.net.bias))
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            data = [texts[i].encode() for i in part]
            windows, owner, weight = cut(data)
            sums = np.zeros((len(part), len(self.net.labels)))
            for lo in range(0, len(windows), 64 * CHUNK):
                piece = slice(lo, lo + 64 * CHUNK)
                np.add.at(sums, owner[piece], self.probabilities(windows[piece]) * weight[piece, None])
            sums /= sums.sum(1, keepdims=True)
            for i, best, score in zip(part, sums.argmax(1).tolist(), sums.max(1).tolist()):
                labels[i], scores[i] = self.net.labels[best], min(1.0, score)
        return labels, scores


def cut(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in windows of fixed length, the last of each text padded with 0; the text and the bytes of each."""
    sizes = np.array([len(d) for d in data])
    counts = np.maximum(1, -(-sizes // WINDOW))
    padded = b"".join(d.ljust(c * WINDOW, b"\0") for d, c in zip(data, counts.tolist()))
    owner = np.repeat(np.arange(len(data)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), owner, np.minimum(sizes[owner] - inside * WINDOW, WINDOW).astype(np.float64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, excerpts: int = EXCERPTS, steps: int = STEPS, seed: int = 7) -> ByteNetwork | None:
    """A network from (doc_id, text, lang); None if nothing is labelled. Takes a bounded sample to the driver."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    wider = max(1.0, languages / FULL_SAMPLE)
    drawn = max(per_language / wider, min(per_language, LEAST))
    # Windows start anywhere in the text, at its first part at least once.
    starts = F.array(F.lit(0), *[(uniform("doc_id", "text", F.lit(k)) * F.greatest(F.length("text") - WINDOW, F.lit(0))).cast("int") for k in range(1, excerpts)])
    first = F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{WINDOW - 1}}}", 0)
    rows = (
        usable.join(F.broadcast(counts), "lang").where(uniform("doc_id", F.lit("sample")) * F.col("n") < drawn)
        .select("doc_id", "lang", F.concat(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(WINDOW))), F.array(first)).alias("parts")).collect()
    )
    rows.sort(key=lambda r: (str(r["doc_id"]), r["parts"]))
    excerpts_of = [(part.encode()[:WINDOW].ljust(WINDOW, b"\0"), r["lang"]) for r in rows for part in dict.fromkeys(r["parts"]) if LETTER.search(part)]
    labels = sorted({lang for _, lang in excerpts_of})
    if not labels:
        return None
    index = {lang: i for i, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    net = ByteNetwork.fresh(labels, rng)
    if len(labels) > 1:
        net.train(np.frombuffer(b"".join(s for s, _ in excerpts_of), np.uint8).reshape(-1, WINDOW), np.array([index[lang] for _, lang in excerpts_of]), rng, round(steps * wider))
    return net


def identify(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if net is None:
        return docs.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            labels, scores = reader.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), net).drop("text")
