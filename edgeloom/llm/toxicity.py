"""Toxicity by a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is the sum of a hashed word embedding and of the mean of its hashed character n-gram embeddings (whole words,
with marks at both ends). Two gated recurrent layers read a window of words in both directions; attention pools their
states; a logistic unit scores the window. A text is cut into overlapping windows, all of them are scored, and the text
gets the highest score. Everything is numpy; tasks look up the input of each distinct word of a batch once.

Training takes a bounded sample to the driver: about ``toxic_docs`` and ``clean_docs`` labelled documents, and of each ``train_words`` words at most. As a label is the document's, a toxic document is represented, step by step, by its
currently most suspicious window, a clean one by a random one and its most suspicious one in turn. A fifth of the sample is kept apart and sets the scale
and shift of the final score, since the highest of many windows runs higher than one.

Defined results: null and empty texts are one window without words; their score is the network's for no input (low). Without
labelled rows, or with labels of one kind, all scores are the share of label 1. Repeated rows get equal scores. Columns
``score`` and ``predicted`` are replaced if the input has them; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import char_ngrams, held_out, split_words, table, uniform

WORDS, STRIDE = 48, 32
WIDTH, STATE = 12, 8
WORD_ROWS, CHAR_ROWS, CHAR_SIZES = 1 << 18, 1 << 17, (3, 4, 5)
TOXIC_DOCS, CLEAN_DOCS, TRAIN_WORDS, STEPS, BATCH, RATE = 1200, 3000, 800, 400, 256, 0.02
#: Adagrad on the embeddings; the floor keeps faint gradients of chance words from moving them.
EMBED_RATE, EMBED_FLOOR = 0.2, 1e-3
THRESHOLD = 0.3
#: Windows scored at once; words embedded at once.
CHUNK, WORD_CHUNK = 1024, 8192


#: Stripped from both ends of a word.
MARKS = b".,;:!?()[]{}|\"'*#$%&<>-_/\\"
#: Rows of the embeddings learn only from words and n-grams of so many sampled documents; chance words keep no memory of a label.
LEAST_WORD, LEAST_GRAM = 3, 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the word table per word; word and row of the character table per n-gram)."""
    marked = [b"<" + (w.lower().strip(MARKS) or w) + b">" for w in words]
    whole = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    if len(words):
        place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 1099511628211, np.uint64))
        codes = np.add.reduceat((data + np.uint64(1)) * powers[place], np.cumsum(lengths) - lengths)
        codes ^= codes >> np.uint64(31)
        codes *= np.uint64(0x94D049BB133111EB)
        whole = ((codes ^ codes >> np.uint64(29)) % np.uint64(WORD_ROWS)).astype(np.int64)
    grams = list(char_ngrams(marked, CHAR_SIZES, CHAR_ROWS, seed=3))
    owner = np.concatenate([g[0] for g in grams] or [np.zeros(0, np.int64)])
    rows = np.concatenate([g[1] for g in grams] or [np.zeros(0, np.int64)])
    return whole, owner, rows


@dataclass
class Network:
    """``chars``, ``words``: embeddings. Per direction: input and state weights of the three gates, and shifts. ``look``: attention."""

    prior: float
    scale: float = 1.0
    shift: float = 0.0
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, prior: float, rng: np.random.Generator) -> Network:
        def draw(scale: float, *shape: int) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        p = {"words": draw(0.01, WORD_ROWS, WIDTH), "chars": draw(0.01, CHAR_ROWS, WIDTH)}
        for way in "fb":
            p |= {f"{way}_in": draw(WIDTH**-0.5, WIDTH, 3 * STATE), f"{way}_state": draw(STATE**-0.5, STATE, 3 * STATE), f"{way}_shift": np.zeros(3 * STATE, np.float32)}
        p |= {"mix": draw(0.3, 2 * STATE, STATE), "look": draw(0.5, STATE), "out": draw(0.3, 2 * STATE), "bias": np.zeros(1, np.float32)}
        return cls(prior, p=p)

    def embed(self, inputs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        whole, owner, rows = inputs
        total = self.p["words"][whole]
        if len(owner):
            order = np.argsort(owner, kind="stable")
            owner, rows = owner[order], rows[order]
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            counts = np.diff(np.concatenate((heads, [len(owner)]))).astype(np.float32)
            total[owner[heads]] += np.add.reduceat(self.p["chars"][rows], heads, axis=0) / counts[:, None]
        return total

    # One direction over steps in the given order. ``seen`` is 0 where a window has no word: the state stays.
    def _run(self, way: str, given: np.ndarray, seen: np.ndarray, steps: range, keep: bool):
        n, state, weights = given.shape[1], np.zeros((given.shape[1], STATE), np.float32), self.p[f"{way}_state"]
        states, trace = np.zeros((given.shape[0], n, STATE), np.float32), []
        for t in steps:
            inner = state @ weights
            gates = given[t, :, : 2 * STATE] + inner[:, : 2 * STATE]
            np.negative(gates, out=gates)
            np.exp(np.minimum(gates, 30, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            reset, stay = gates[:, :STATE], gates[:, STATE:]
            fresh = np.tanh(given[t, :, 2 * STATE :] + reset * inner[:, 2 * STATE :])
            move = (1 - stay) * seen[t]
            new = state + move * (fresh - state)
            if keep:
                trace.append((t, state, inner, reset, stay, fresh, move))
            state = states[t] = new
        return states, trace

    def forward(self, inputs: np.ndarray, seen: np.ndarray, keep: bool = False):
        """Logits of windows from inputs already multiplied: {way: steps x windows x gates}; ``seen``: steps x windows x 1."""
        steps = seen.shape[0]
        ahead, trace_f = self._run("f", inputs["f"], seen, range(steps), keep)
        back, trace_b = self._run("b", inputs["b"], seen, range(steps - 1, -1, -1), keep)
        both = np.concatenate((ahead, back), 2)
        hidden = np.tanh(both @ self.p["mix"])
        look = np.where(seen[:, :, 0] > 0, hidden @ self.p["look"], -1e4)
        look -= look.max(0)
        weight = np.exp(look)
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, both)
        return pooled @ self.p["out"] + self.p["bias"][0], (both, hidden, weight, pooled, trace_f, trace_b)

    def gates(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates of both directions."""
        return {way: words @ self.p[f"{way}_in"] + self.p[f"{way}_shift"] for way in "fb"}

    def word_gates(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
        """``gates`` of many words, embedded part by part."""
        made = [self.gates(self.embed(part)) for part in parts] or [{way: np.zeros((1, 3 * STATE), np.float32) for way in "fb"}]
        return {way: np.concatenate([m[way] for m in made]) for way in "fb"}

    def backward(self, wrong: np.ndarray, seen: np.ndarray, kept) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the shared weights, and of the gate inputs, from the gradient of the logits."""
        both, hidden, weight, pooled, trace_f, trace_b = kept
        g = {"bias": np.array([wrong.sum()], np.float32), "out": pooled.T @ wrong}
        d_pool = wrong[:, None] * self.p["out"]
        d_both = weight[:, :, None] * d_pool
        d_weight = np.einsum("tnk,nk->tn", both, d_pool)
        d_look = weight * (d_weight - (weight * d_weight).sum(0))
        g["look"] = np.einsum("tnk,tn->k", hidden, d_look)
        d_hidden = d_look[:, :, None] * self.p["look"] * (1 - hidden**2)
        g["mix"] = np.einsum("tni,tnj->ij", both, d_hidden)
        d_both += d_hidden @ self.p["mix"].T
        given = {}
        for way, trace, part in (("f", trace_f, slice(0, STATE)), ("b", trace_b, slice(STATE, 2 * STATE))):
            weights, d_in = self.p[f"{way}_state"], np.zeros((*seen.shape[:2], 3 * STATE), np.float32)
            d_weights, d_state = np.zeros_like(weights), np.zeros((seen.shape[1], STATE), np.float32)
            for t, before, inner, reset, stay, fresh, move in reversed(trace):
                d_new = d_state + d_both[t, :, part]
                d_fresh = d_new * move * (1 - fresh**2)
                d_stay = -d_new * seen[t] * (fresh - before) * stay * (1 - stay)
                d_reset = d_fresh * inner[:, 2 * STATE :] * reset * (1 - reset)
                d_in[t] = np.concatenate((d_reset, d_stay, d_fresh), 1)
                d_inner = np.concatenate((d_reset, d_stay, d_fresh * reset), 1)
                d_weights += before.T @ d_inner
                d_state = d_new * (1 - move) + d_inner @ weights.T
            g[f"{way}_state"], given[way] = d_weights, d_in
        return g, given


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all overlapping windows of texts with so many words; a text without words has one."""
    per = 1 + np.maximum(0, -(-(counts - WORDS) // STRIDE))
    owner = np.repeat(np.arange(len(counts)), per)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * STRIDE


def _gather(tokens: np.ndarray, begins: np.ndarray, counts: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, steps x windows, and where there is a word."""
    place = first[None, :] + np.arange(WORDS)[:, None]
    seen = place < counts[owner][None, :]
    at = np.where(seen, begins[owner][None, :] + place, 0)
    return (tokens[at] if len(tokens) else np.zeros_like(at)), seen


class Scorer:
    def __init__(self, net: Network):
        self.net = net

    def score(self, texts: pa.Array, raw: bool = False) -> np.ndarray:
        """The score of each text, from its highest window; ``raw``: that window's logit."""
        distinct, tokens, counts = split_words(texts)
        vocabulary = [w.encode() for w in distinct]
        inputs = self.net.word_gates(word_inputs(vocabulary[at : at + WORD_CHUNK]) for at in range(0, len(vocabulary), WORD_CHUNK))
        begins = np.cumsum(counts) - counts
        owner, first = windows_of(counts)
        best = np.full(len(counts), -np.inf)
        for at in range(0, len(owner), CHUNK):
            part = slice(at, at + CHUNK)
            ids, seen = _gather(tokens, begins, counts, owner[part], first[part])
            steps = max(1, int(seen.sum(0).max(initial=0)))
            mask = seen[:steps, :, None].astype(np.float32)
            logits, _ = self.net.forward({way: table_[ids[:steps]] for way, table_ in inputs.items()}, mask)
            np.maximum.at(best, owner[part], logits)
        return best if raw else _sigmoid(self.net.scale * best + self.net.shift)


def train(texts: list[str], toxic: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
    """Adam on the log loss, Adagrad for embedding rows where they were used; a quarter of every batch is toxic."""
    net = Network.fresh(float(toxic.mean()) if len(toxic) else 0.0, np.random.default_rng(seed))
    if not len(toxic) or toxic.all() or not toxic.any():
        net.p["out"][:] = 0
        net.p["bias"][0] = np.log(max(net.prior, 1e-6) / max(1 - net.prior, 1e-6))
        return net
    rng = np.random.default_rng(seed + 1)
    spare = rng.random(len(texts)) < 0.2
    if len(np.unique(toxic[~spare])) == 2:
        spare_texts, spare_toxic = [t for t, s in zip(texts, spare) if s], toxic[spare]
        texts, toxic = [t for t, s in zip(texts, spare) if not s], toxic[~spare]
    else:
        spare_texts, spare_toxic = texts, toxic
    split = [t.encode().split() for t in texts]
    known: dict[bytes, int] = {}
    tokens = np.array([known.setdefault(w, len(known)) for words in split for w in words], np.int64)
    counts = np.array([len(w) for w in split], np.int64)
    begins = np.cumsum(counts) - counts
    del split
    names = list(known)
    parts = [_sorted_inputs(names[at : at + WORD_CHUNK]) for at in range(0, len(names), WORD_CHUNK)]
    whole, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    spans = np.cumsum(np.concatenate(([0], *[p[1] for p in parts])))
    del names, known, parts
    # In how many documents each word occurs, and (words counted apart) each n-gram.
    seen_in = np.bincount(np.unique(np.repeat(np.arange(len(counts)), counts) * len(whole) + tokens) % len(whole), minlength=len(whole))
    learns = {"words": np.zeros(WORD_ROWS, bool), "chars": np.bincount(rows, np.repeat(seen_in, np.diff(spans)), CHAR_ROWS) >= LEAST_GRAM}
    learns["words"][whole[seen_in >= LEAST_WORD]] = True
    win_owner, win_first = windows_of(counts)
    heads = np.searchsorted(win_owner, np.arange(len(counts) + 1))
    suspicion = rng.random(len(win_owner))
    groups = [np.flatnonzero(toxic == label) for label in (0, 1)]
    first = {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("words", "chars")}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(g, n) for g, n in zip(groups, (BATCH - BATCH // 4, BATCH // 4))])
        label = toxic[docs].astype(np.float32)
        chosen = []
        for d, positive in zip(docs, label):
            lo, hi = heads[d], heads[d + 1]
            by_chance = rng.random() < (0.1 if positive else 0.4)
            chosen.append(rng.integers(lo, hi) if by_chance else lo + int(suspicion[lo:hi].argmax()))
        chosen = np.array(chosen)
        ids, seen = _gather(tokens, begins, counts, win_owner[chosen], win_first[chosen])
        mask = seen[:, :, None].astype(np.float32)
        used, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape)
        sizes = spans[used + 1] - spans[used]
        gram_owner = np.repeat(np.arange(len(used)), sizes)
        gram_of = np.arange(len(gram_owner)) + np.repeat(spans[used] - (np.cumsum(sizes) - sizes), sizes)
        embedded = net.embed((whole[used], gram_owner, rows[gram_of]))
        gates = net.gates(embedded)
        logits, kept = net.forward({way: t[local] for way, t in gates.items()}, mask, keep=True)
        suspicion[chosen] = logits
        wrong = ((_sigmoid(logits) - label) / len(docs)).astype(np.float32)
        grads, given = net.backward(wrong, mask, kept)
        d_words = np.zeros_like(embedded)
        for way in "fb":
            d_gate = _summed(local.ravel(), (given[way] * mask).reshape(-1, 3 * STATE))[1]
            grads[f"{way}_in"], grads[f"{way}_shift"] = embedded.T @ d_gate, d_gate.sum(0)
            d_words += d_gate @ net.p[f"{way}_in"].T
        pace = RATE * (1 - (step - 1) / steps)
        n_grams = np.maximum(spans[used + 1] - spans[used], 1).astype(np.float32)
        sparse = {"words": _summed(whole[used], d_words), "chars": _summed(rows[gram_of], d_words[gram_owner] / n_grams[gram_owner][:, None])}
        for name, (at, grad) in sparse.items():
            at, grad = at[learns[name][at]], grad[learns[name][at]]
            second[name][at] += grad * grad
            net.p[name][at] -= EMBED_RATE * grad / (np.sqrt(second[name][at]) + EMBED_FLOOR)
        for name, grad in grads.items():
            first[name] += 0.1 * (grad - first[name])
            second[name] += 0.01 * (grad * grad - second[name])
            net.p[name] -= pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
        if step % 100 == 0 and step < steps:  # look again for the suspicious windows of every document
            all_gates = net.word_gates(_slices(whole, spans, rows))
            for at in range(0, len(win_owner), CHUNK):
                part = slice(at, at + CHUNK)
                ids, seen = _gather(tokens, begins, counts, win_owner[part], win_first[part])
                suspicion[part], _ = net.forward({way: t[ids] for way, t in all_gates.items()}, seen[:, :, None].astype(np.float32))
    if len(np.unique(spare_toxic)) == 2:
        logits = [Scorer(net).score(pa.array(spare_texts[at : at + 100], pa.large_string()), raw=True) for at in range(0, len(spare_texts), 100)]
        net.scale, net.shift = _calibrate(np.concatenate(logits), spare_toxic)
    return net


def _sorted_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, its number of n-grams, the n-grams' rows, word by word)."""
    whole, owner, rows = word_inputs(words)
    return whole.astype(np.int32), np.bincount(owner, minlength=len(words)), rows[np.argsort(owner, kind="stable")].astype(np.int32)


def _slices(whole: np.ndarray, spans: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for lo in range(0, len(whole), WORD_CHUNK):
        hi = min(lo + WORD_CHUNK, len(whole))
        yield whole[lo:hi], np.repeat(np.arange(hi - lo), np.diff(spans[lo : hi + 1])), rows[spans[lo] : spans[hi]]


def _calibrate(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale (positive) and shift by Newton steps on the ridge-penalised log loss."""
    centre, spread = logits.mean(), logits.std() + 1e-6
    x = np.stack(((logits - centre) / spread, np.ones(len(logits))), 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        chance = _sigmoid(x @ w)
        slope = x.T @ (chance - toxic) / len(x) + 1e-4 * w * (1, 0)
        w -= np.linalg.solve((x.T * (chance * (1 - chance))) @ x / len(x) + np.diag((1e-4, 1e-6)), slope)
    scale = max(float(w[0] / spread), 1e-3)
    # Where the labels come apart, the threshold goes midway between the ends of their bulks.
    clean_end, toxic_end = np.quantile(logits[toxic == 0], 0.98), np.quantile(logits[toxic == 1], 0.02)
    if clean_end < toxic_end:
        return scale, float(np.log(THRESHOLD / (1 - THRESHOLD)) - scale * (clean_end + toxic_end) / 2)
    return scale, float(w[1] - scale * centre)


def _summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[heads], np.add.reduceat(grads[order], heads, axis=0)


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, train_words: int = TRAIN_WORDS, steps: int = STEPS) -> Network:
    """A network from documents (doc_id, text) and labels (doc_id, toxic). A document with several labels counts as their maximum.

    Labels are sampled before the join, so the joined side holds about ``toxic_docs + clean_docs`` rows at any size of the tables.
    Training sees the first ``train_words`` words of a sampled document; scoring always sees all.
    """
    judged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in judged.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    share = F.when(F.col("toxic") == 1, toxic_docs / max(counts.get(1, 0), 1)).when(F.col("toxic") == 0, clean_docs / max(counts.get(0, 0), 1)).otherwise(0.0)
    sample = judged.where(uniform("doc_id", F.lit("toxicity")) < share)
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, train_words)
    rows = docs.where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.array_join(words, " ").alias("text")).collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["text"]))
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.int64), steps)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted``."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                scores = scorer.score(part.column("text").cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def fitted(spark: SparkSession, sf_dir: str) -> Network:
    """The network that the query and the pipeline use: labels of held-out rows are never seen."""
    learn = ~held_out(F.col("doc_id"))
    return fit(table(spark, sf_dir, "documents").select("doc_id", "text").where(learn), table(spark, sf_dir, "labels").select("doc_id", "toxic").where(learn))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(docs, fitted(spark, sf_dir)).drop("text")
