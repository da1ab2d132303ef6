import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from edgeloom.llm.periodic_runs import PRIME, find_runs, op13_periodic_runs, periodic_runs, squared_differences

from .helpers import LONG, corpus

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """Every period, every stretch that keeps it; those whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(start, start + length - r)) for r in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out)


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds, words = rng.randrange(90), rng.choice([1, 2, 2, 3, 5]), []
        while len(words) < n:
            if rng.random() < 0.4:
                unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
                words += unit * rng.randrange(1, 7) + unit[: rng.randrange(len(unit) + 1)]
            else:
                words.append(rng.randrange(kinds + 3))
        words = words[:n]
        assert find_runs(np.array(words, np.int64), n) == brute(words), words


@pytest.mark.parametrize("block", [1, 2, 8, 64])
def test_convolution_is_exact(block):
    rng = np.random.default_rng(block)
    codes = rng.integers(0, 1 << 20, 12 * block + 3).astype(np.uint64)
    squares = np.concatenate(([0], np.cumsum((codes * codes % np.uint64(PRIME)).astype(np.int64))))
    starts = np.arange(0, 9 * block, block)
    found = squared_differences(codes, squares, starts, block)
    plain = [int(c) for c in codes]
    for k, s in enumerate(starts.tolist()):
        for d in range(block, 2 * block):
            assert found[d - block, k] == sum((plain[s + j] - plain[s + d + j]) ** 2 for j in range(block)) % PRIME


def test_repeats_of_hostile_texts_take_no_quadratic_time():
    rng = np.random.default_rng(2)
    n = 120_000
    assert find_runs(np.zeros(n, np.int64), n) == [(0, n, 1)]
    unit = rng.integers(0, 9, n // 6)
    assert max(find_runs(np.tile(unit, 6), n), key=lambda r: r[1]) == (0, len(unit) * 6, len(unit))
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    assert find_runs(np.array(b[:n]), n) == []  # no power of four in it


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \x0b\x0c\r ", "one", "a a a a a a", "a a a a a", "x " * 7 + "y " * 9, "a b " * 4, "a b a b a b a b a b a b", "A a " * 5]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randrange(120))) for _ in range(150)]
    texts += ["\n".join([" ".join(rng.choice("abcdefgh") for _ in range(13))] * 5) + " end" for _ in range(10)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (-7, "a a a a a a a"), (10**15, "b b b b b b b b")]
    corpus(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op13_periodic_runs(spark, str(tmp_path)).collect()
    fields = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[f] for f in fields) for r in out), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)


def test_real_outputs_and_clashing_columns(spark):
    docs = corpus(spark, [(1, "go  go go\ngo go go stop"), (None, None), (2, LONG + " " + "tick tock " * 30_000)]).selectExpr("*", "'x' AS runs", "1 AS codes")
    rows = {r.doc_id: r for r in periodic_runs(docs, ("n_runs", "runs", "collapsed")).collect()}
    assert (rows[1].runs, rows[1].collapsed, rows[1].codes) == ([[0, 6, 1]], "go stop", 1)
    assert (rows[None].n_runs, rows[None].runs, rows[None].collapsed) == (0, [], "")
    assert [60_000, 60_000, 2] in rows[2].runs and [0, 60_000, 977] in rows[2].runs


def test_no_rows(spark):
    assert periodic_runs(corpus(spark, [])).count() == 0
