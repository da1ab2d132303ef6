import hashlib
import math
import random

from edgeloom.llm.vector_codes import bounds, compress

VECTORS = "vec_id long, embedding array<float>, label string"


def brute(rows, positions=8, entries=16, rounds=6):
    """All parts in lists, one vector length at a time, in Python integers."""
    usable = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for _, v, _ in usable}:
        own = [(i, [min(max(math.floor(4096 * x), -(1 << 62)), 1 << 62) for x in v], label) for i, v, label in usable if len(v) == width]
        own.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        spans = bounds(width, positions)
        books = [[r[1][lo:hi] for r in own[:entries]] for lo, hi in spans]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

        def nearest():
            return [[min(range(len(b)), key=lambda e: (far(v[lo:hi], b[e]), e)) for (lo, hi), b in zip(spans, books)] for _, v, _ in own]

        for _ in range(rounds):
            codes = nearest()
            for p, (lo, hi) in enumerate(spans):
                for e in range(len(books[p])):
                    members = [v[lo:hi] for (_, v, _), c in zip(own, codes) if c[p] == e]
                    if members:
                        books[p][e] = [sum(x) // len(members) for x in zip(*members)]
        digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
        for (i, v, label), code in zip(own, nearest()):
            error = sum(far(v[lo:hi], b[c]) for (lo, hi), b, c in zip(spans, books, code))
            out.append([i, label, "".join(f"{c:02x}" for c in code), min(error, (1 << 63) - 1), digest])
    totals = {}
    for _, label, _, error, _ in out:
        totals[label] = min(totals.get(label, 0) + error, (1 << 63) - 1)
    return sorted(((i, label, code, error, totals[label], digest) for i, label, code, error, digest in out), key=repr)


def coded(spark, stage, rows):
    found = compress(spark.createDataFrame(rows, VECTORS).repartition(3), stage)
    return sorted((tuple(r) for r in found.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def exact(rows):
    """Components as the 32-bit floats that are stored."""
    import numpy as np

    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_against_brute_force(spark, stage):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 5]], rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(i, rows[7][1], "hot") for i in range(200, 260)]  # copies
    rows += [(7, rows[7][1], "hot"), (7, rows[8][1], "a"), (None, rows[3][1], "a")]
    rows += [(300, None, "a"), (301, [0.1] * 15 + [None], "a"), (302, [float("nan")] * 16, "a"), (303, [float("inf")] + [0.0] * 15, "a"), (304, [0.0] * 16, "a")]
    rows += [(400 + i, [rng.random() for _ in range(11)], "other length") for i in range(9)] + [(500, [], "none")]
    rows = exact(rows)
    assert coded(spark, stage, rows) == brute(rows)


def test_large_components(spark, stage):
    rng = random.Random(6)
    rows = exact([(i, [rng.choice([1e-3, 1.0, 1e5, 3e9, 3e38]) * rng.uniform(-1, 1) for _ in range(8)], "a") for i in range(40)])
    assert coded(spark, stage, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark, stage):
    empty = compress(spark.createDataFrame([], VECTORS), stage)
    assert empty.count() == 0 and empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    df = spark.createDataFrame([(1, [0.5] * 8, "a"), (2, [0.25] * 8, "a")], VECTORS).selectExpr("*", "'x' AS code", "1 AS row", "2 AS kind", "3 AS position", "4 AS width")
    assert [(r.vec_id, r.code, r.error) for r in compress(df, stage.__class__(spark)).orderBy("vec_id").collect()] == [(1, "00" * 8, 0), (2, "01" * 8, 0)]


def test_only_parts_that_change_their_entry_are_shuffled(spark, stage):
    """Rows at rest stay in the files of their owner: of the later rounds only few parts move."""
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.01) for c in centres[i % 16]], "a") for i in range(400)]
    compress(spark.createDataFrame(rows, VECTORS), stage).count()
    last = spark.read.parquet(f"{stage.root}/looked_up_6").groupBy("kind").count().collect()
    counts = {r["kind"]: r["count"] for r in last}
    assert counts.get("move", 0) < 0.1 * counts["stay"]
