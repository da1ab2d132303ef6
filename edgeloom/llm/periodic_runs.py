"""Periodic runs of words, by block convolution at dyadic scales.

A run is a stretch with smallest period q that repeats it at least ``REPEATS`` times and has ``SHORTEST`` words, extended as far
as its period holds. At scale B = 1, 2, 4, ... the words are cut into blocks of B. A block lies at distance d = B .. 2B - 1 from
an equal stretch exactly where the sum of squared differences of their word numbers is zero; these sums come for all distances at
once from a convolution, computed without rounding by a number-theoretic transform modulo a prime. Every run of period d holds a
row of whole blocks that each have such an occurrence d further on, so rows of that length seed an extension, word by word, to
both sides. (A sum that is only divisible by the prime is found out there.) A stretch is kept if no divisor of d is a period too.

Texts of a slice are laid end to end, parted by numbers that occur once, so short texts share convolutions. A block takes part
only if each of its words occurs again within 2B - 1 words, as it must, and if no run of an earlier scale covers all it can reach.
Work is n log n transforms for n words, plus the length of stretches found.

Defined results: a null or empty text has no words and no runs. Texts are searched whole; repeated rows each for itself. Columns
named as an output are replaced, all others pass through. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices, split_words, table

REPEATS, SHORTEST = 4, 6
#: 15 * 2**27 + 1, with the generator 31 of its units: transforms of up to 2**27 numbers.
PRIME, GENERATOR = 2_013_265_921, 31
#: Numbers that are transformed together.
TOGETHER = 1 << 17

_P = np.uint64(PRIME)
_LOW = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)
_MINUS_INVERSE = np.uint64((-pow(PRIME, -1, 1 << 32)) % (1 << 32))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b / 2**32 modulo the prime (Montgomery), for factors below it."""
    t = a * b
    m = t & _LOW
    m *= _MINUS_INVERSE
    m &= _LOW
    m *= _P
    t += m
    t >>= _SHIFT
    return _reduced(t)


def _reduced(t: np.ndarray) -> np.ndarray:
    """Numbers below twice the prime to numbers below it."""
    t -= _P * (t >= _P)
    return t


def _scaled(values: list[int]) -> np.ndarray:
    """Factors for ``_times``, which takes 2**32 out again."""
    return np.array([(v << 32) % PRIME for v in values], np.uint64)


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size / 2 - 1 of a root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    powers = np.ones(max(1, size // 2), np.uint64)
    done = 1
    while done < len(powers):  # doubled by one product each time
        step = np.uint64(pow(root, done, PRIME))
        powers[done : 2 * done] = powers[:done] * step % _P
        done *= 2
    return (powers << _SHIFT) % _P


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform along the first axis (its length a power of two), in natural order, without scaling."""
    size, width = rows.shape
    stride, half = 1, size // 2
    while half:
        flat = rows.reshape(2, half * stride * width)
        low, high = flat
        root = np.repeat(_roots(2 * half, inverse), stride * width)
        out = np.empty((half, 2, stride * width), np.uint64)
        out[:, 0] = _reduced(low + high).reshape(half, -1)
        out[:, 1] = _times(_reduced(low + (_P - high)), root).reshape(half, -1)
        rows = out.reshape(size, width)
        stride, half = 2 * stride, half // 2
    return rows


def squared_differences(codes: np.ndarray, squares: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """For each block start, modulo the prime: the sum of squared differences to the stretch at distance block .. 2 block - 1.

    ``squares`` holds the sums of squares before each place. Both end at least 3 * block after the last start.
    """
    size = 2 * block
    own = np.zeros((size, len(starts)), np.uint64)
    own[:block] = codes[starts[None, :] + np.arange(block)[:, None]]
    window = codes[starts[None, :] + block + np.arange(size)[:, None]]
    mixed = _times(transform(window), _times(transform(own, True), _scaled([1 << 32])))
    products = _times(transform(mixed, True)[:block], _scaled([pow(size, -1, PRIME)]))
    shifts = starts[None, :] + block + np.arange(block)[:, None]
    fixed = (squares[starts + block] - squares[starts])[None, :] + squares[shifts + block] - squares[shifts]
    return (fixed % PRIME + 2 * (PRIME - products.astype(np.int64))) % PRIME


def _next_distance(codes: np.ndarray) -> np.ndarray:
    """Distance to the next occurrence of the same number, huge if there is none."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), np.iinfo(np.int64).max)
    same = codes[order[1:]] == codes[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _reach(codes: np.ndarray, at: int, shift: int, step: int) -> int:
    """How many places from ``at`` on, in steps of 1 or -1, equal the place ``shift`` further on."""
    done, size = 0, 64
    while True:
        if step > 0:
            lo, hi = at + done, min(at + done + size, len(codes) - shift)
            differs = codes[lo:hi] != codes[lo + shift : hi + shift]
        else:
            lo, hi = max(0, at - done - size + 1), at - done + 1
            differs = (codes[lo:hi] != codes[lo + shift : hi + shift])[::-1]
        if not len(differs):
            return done
        if differs.any():
            return done + int(differs.argmax())
        done, size = done + len(differs), 2 * size


def _prime_factors(n: int) -> list[int]:
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return found + [n] * (n > 1)


def find_runs(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a row of numbers from 0, of which none is longer than ``longest``."""
    n = len(codes)
    runs: list[tuple[int, int, int]] = []
    repeats = _next_distance(codes)
    block, largest = 1, 1
    while block * REPEATS <= longest:
        largest, block = block, 2 * block
    padded = np.concatenate((codes, np.full(3 * largest, codes.max(initial=0) + 1))).astype(np.uint64)
    squares = np.concatenate(([0], np.cumsum((padded * padded % _P).astype(np.int64))))
    covered = np.zeros(n, np.int64)  # from each place on, up to where a run of an earlier scale holds
    block, waits = 1, repeats
    while block <= largest:
        waits = waits[: len(waits) // 2 * 2].reshape(-1, 2).max(1) if block > 1 else waits
        fits = waits <= 2 * block - 1
        starts = np.arange(len(fits)) * block
        fits &= covered[starts] < np.minimum(starts + 3 * block, n)
        fits &= np.concatenate((fits[1:], [False])) | np.concatenate(([False], fits[:-1]))  # a run holds two blocks or more in a row
        before = len(runs)
        seeds = [_seeds(padded, squares, part, block) for part in _parts(starts[fits], block)]
        if seeds:
            at, shift = (np.concatenate(x) for x in zip(*seeds))
            inside = covered[at] >= at + block + shift
            _extend(codes, at[~inside], shift[~inside], block, runs)
        for start, length, _ in runs[before:]:
            covered[start : start + length] = np.maximum(covered[start : start + length], start + length)
        block *= 2
    return sorted(runs)


def _parts(starts: np.ndarray, block: int) -> Iterator[np.ndarray]:
    step = max(1, TOGETHER // (2 * block))
    for lo in range(0, len(starts), step):
        yield starts[lo : lo + step]


def _seeds(codes: np.ndarray, squares: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of zero-mismatch occurrences."""
    shift, which = np.nonzero(squared_differences(codes, squares, starts, block) == 0)
    return starts[which], shift + block


def _extend(codes: np.ndarray, at: np.ndarray, shift: np.ndarray, block: int, runs: list[tuple[int, int, int]]) -> None:
    """Rows of seeds at one distance, extended to both sides; the stretches that are runs are added."""
    order = np.lexsort((at, shift))
    at, shift = at[order], shift[order]
    first = np.concatenate(([True], (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + block)))[: len(at)]
    heads = np.flatnonzero(first)
    in_row = np.diff(np.concatenate((heads, [len(at)])))
    needed = ((REPEATS - 1) * shift[heads] - block + 1) // block  # whole blocks that a shortest run of this period holds
    for start, d in zip(at[heads][in_row >= needed].tolist(), shift[heads][in_row >= needed].tolist()):
        ahead = _reach(codes, start, d, 1)
        if ahead < block:  # zero only modulo the prime
            continue
        lo = start - _reach(codes, start - 1, d, -1) if start else 0
        length = start + ahead + d - lo
        if length < max(SHORTEST, REPEATS * d):
            continue
        hi = lo + length
        if any(np.array_equal(codes[lo : hi - d // r], codes[lo + d // r : hi]) for r in _prime_factors(d)):
            continue
        runs.append((lo, length, d))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Output columns: what each is made of, from a document's runs (start, length, period) and the words that are kept.
OUTPUTS: dict[str, tuple[T.DataType, pa.DataType, Callable]] = {
    "n_runs": (T.LongType(), pa.int64(), lambda runs, best, kept: len(runs)),
    "start": (T.LongType(), pa.int64(), lambda runs, best, kept: best and best[0]),
    "length": (T.LongType(), pa.int64(), lambda runs, best, kept: best and best[1]),
    "period": (T.LongType(), pa.int64(), lambda runs, best, kept: best and best[2]),
    "exponent_milli": (T.LongType(), pa.int64(), lambda runs, best, kept: best and 1000 * best[1] // best[2]),
    "runs": (T.ArrayType(T.ArrayType(T.LongType())), pa.list_(pa.list_(pa.int64())), lambda runs, best, kept: runs),
    "collapsed": (T.StringType(), pa.string(), lambda runs, best, kept: kept),
    "runs_sha256": (T.StringType(), pa.string(), lambda runs, best, kept: _digest("".join(f"{s},{n},{q}\n" for s, n, q in runs))),
    "collapsed_sha256": (T.StringType(), pa.string(), lambda runs, best, kept: _digest(kept)),
}


def _document_runs(codes: np.ndarray, counts: np.ndarray, ranks: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, from their word numbers end to end."""
    ends = np.cumsum(counts)
    laid = np.insert(codes.astype(np.int64), ends, ranks + np.arange(len(counts)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    starts = ends - counts + np.arange(len(counts))
    for start, length, period in find_runs(laid, int(counts.max(initial=0))):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        found[doc].append((start - int(starts[doc]), length, period))
    return found


def _kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Places of the words that no run repeats; None if that is all."""
    if not runs:
        return None
    kept = np.ones(count, bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return np.flatnonzero(kept)


Rewrite = Callable[[list, np.ndarray], list]


def periodic_runs(docs: DataFrame, outputs: tuple[str, ...] = ("n_runs", "runs", "collapsed"), rewrite: Rewrite | None = None, key: str = "doc_id") -> DataFrame:
    """The documents without ``text``, with the chosen outputs (keys of ``OUTPUTS``): all runs, the longest one (ties: smallest start,
    then period), and the text collapsed to the words that no run contains after its first period, joined by one space.

    ``rewrite`` may rearrange words before the search: from the values of ``key`` and the numbers of words it makes, for each
    document, the places to take its words from (None: as they are).
    """
    kept_columns = [c for c in docs.columns if c != "text" and c not in outputs]
    schema = T.StructType([docs.schema[c] for c in kept_columns] + [T.StructField(n, OUTPUTS[n][0]) for n in outputs])
    needs_words = any(n.startswith("collapsed") for n in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, size=2 << 20)):
            words, codes, counts = split_words(batch.column("text"))
            bounds = np.concatenate(([0], np.cumsum(counts)))
            if rewrite:
                places = rewrite(batch.column(key).to_pylist(), counts)
                codes = np.concatenate([codes[lo:hi] if p is None else codes[lo + p] for p, lo, hi in zip(places, bounds, bounds[1:])] or [codes])
            found = _document_runs(codes, counts, len(words))
            spelled = np.array(words, object) if needs_words else None
            made: list[list] = [[] for _ in outputs]
            for runs, lo, hi in zip(found, bounds, bounds[1:]):
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                text = ""
                if needs_words:
                    own, kept = codes[lo:hi], _kept_words(hi - lo, runs)
                    text = " ".join(spelled[own if kept is None else own[kept]].tolist()) if hi > lo else ""
                for name, into in zip(outputs, made):
                    into.append(OUTPUTS[name][2](runs, best, text))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept_columns] + [pa.array(v, OUTPUTS[n][1]) for n, v in zip(outputs, made)], names=[*kept_columns, *outputs])

    return docs.withColumn("text", docs["text"].cast("string")).mapInArrow(run, schema)


def planted(ids: list, counts: np.ndarray) -> list:
    """Repeats planted by document id: of every tenth hash, the words from some place on repeat a first stretch."""
    out = []
    for i, n in zip(ids, counts.tolist()):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 or not n:
            out.append(None)
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at = np.arange(n)
        out.append(np.where(at < a, at, a + (at - a) % p))
    return out


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, and digests of them and of its collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return periodic_runs(docs, outputs, planted)
