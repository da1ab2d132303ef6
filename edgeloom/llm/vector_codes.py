"""Vector codes: each of a vector's equal parts is replaced by the index of an entry of its position's codebook.

Codebooks are fitted to all vectors by Lloyd's rounds in integers. The parts live with their owners: rows are partitioned by
(position, entry, salt) and written there. In a round the owners' sums give the new entries, every owner looks up the nearest
entry of its members where they lie, and only the parts whose entry changed are shuffled to their new owner; all others stay in
files of their old one. Sums are taken by an owner while it holds its rows, so no pass is made for them. The salt, from the
row's number, splits an entry that many parts share over ``SALTS`` owners, more when there are more than ``OWNED`` rows for each.
The driver holds the codebooks (positions x entries, whatever the rows) and nothing else.

Defined results: vectors that are null or hold null or non-finite components are dropped. Vectors of different lengths have
codebooks of their own; one of zero length or of a length that the number of positions does not divide is cut like
``numpy.array_split`` cuts it. Integers are exact; beyond 2**62 they, and errors beyond 2**63 - 1, stand at that bound. With fewer
vectors than entries a codebook has as many entries as vectors. Repeated rows are coded each for itself; null ids come last.
Columns other than the id, the vector and the label are not read, so none can clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import Stage

from .common import table

POSITIONS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Owners of an entry, and the rows of a position for each of them at most.
SALTS, OWNED = 16, 500_000
LARGEST = 1 << 62

#: A row is a part (``kind`` stay or move) or, with ``kind`` sum, what an owner's parts of an entry sum up to.
ROW = "kind string, width int, position int, entry int, row long, part array<long>, sums array<decimal(38,0)>, members long"
FIELDS = [f.split()[0] for f in ROW.split(", ")]


@dataclass(frozen=True)
class Codebooks:
    """Entries by (vector length, position): Python integers, so that sums and digests are exact."""

    entries: dict[tuple[int, int], tuple[tuple[int, ...], ...]]

    def nearest(self, width: int, position: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, ties to the lower, and the squared distance."""
        book = self.entries[width, position]
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        top = max(int(np.abs(parts).max(initial=0)), max(abs(v) for entry in book for v in entry))
        if parts.shape[1] * 4 * top * top < 1 << 53:  # every number below is then exact in double precision
            x, c = parts.astype(np.float64), np.array(book, np.float64)
            far = (x * x).sum(1, keepdims=True) - 2 * (x @ c.T) + (c * c).sum(1)
        else:
            x, c = parts.astype(object), np.array(book, object)
            far = ((x[:, None, :] - c[None]) ** 2).sum(2)
        best = far.argmin(1)
        found = far[np.arange(len(parts)), best]
        return best, np.array([min(int(v), (1 << 63) - 1) for v in found], np.int64) if found.dtype == object else found.astype(np.int64)

    def updated(self, sums: dict[tuple[int, int, int], tuple[list[int], int]]) -> Codebooks:
        """Each entry becomes the floor of its parts' mean; one without parts stays."""
        mean = lambda key, old: tuple(v // sums[key][1] for v in sums[key][0]) if key in sums else old
        return Codebooks({(w, p): tuple(mean((w, p, e), old) for e, old in enumerate(book)) for (w, p), book in self.entries.items()})

    def digest(self, width: int) -> str:
        numbers = [v for (w, _), book in sorted(self.entries.items()) if w == width for entry in book for v in entry]
        return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def bounds(width: int, positions: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end."""
    cuts = np.cumsum([0, *(len(p) for p in np.array_split(np.arange(width), positions))]).tolist()
    return list(zip(cuts, cuts[1:]))


def integers(embedding: Column) -> Column:
    """Components as integers, down to the next 1/``SCALE``."""
    return F.transform(embedding, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))).cast("long"))


def _finite(embedding: Column) -> Column:
    return F.coalesce(~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


class _Sums:
    """What the parts an owner holds sum up to, by entry."""

    def __init__(self):
        self.found: dict[tuple[int, int, int], list] = {}

    def add(self, width: int, position: int, entries: np.ndarray, parts: np.ndarray) -> None:
        small = not parts.size or int(np.abs(parts).max()) < 1 << 40
        for e in np.unique(entries).tolist():
            own = parts[entries == e]
            total = own.sum(0).tolist() if small else own.astype(object).sum(0).tolist()
            held = self.found.setdefault((width, position, e), [[0] * parts.shape[1], 0])
            held[0] = [a + int(b) for a, b in zip(held[0], total)]
            held[1] += len(own)

    def batch(self) -> pa.RecordBatch:
        from decimal import Decimal

        keys = list(self.found)
        sums = [[Decimal(v) for v in self.found[k][0]] for k in keys]
        return _rows("sum", [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], sums=sums, members=[self.found[k][1] for k in keys])


_TYPES = {"kind": pa.string(), "width": pa.int32(), "position": pa.int32(), "entry": pa.int32(), "row": pa.int64(), "part": pa.list_(pa.int64()), "sums": pa.list_(pa.decimal128(38, 0)), "members": pa.int64()}


def _rows(kind: str | pa.Array, width, position, entry, **more) -> pa.RecordBatch:
    n = len(entry)
    given = {"kind": pa.array([kind] * n, pa.string()) if isinstance(kind, str) else kind, "width": width, "position": position, "entry": entry} | more
    arrays = [given[f] if isinstance(given.get(f), pa.Array) else pa.array(given[f], _TYPES[f]) if f in given else pa.nulls(n, _TYPES[f]) for f in FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=FIELDS)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows of a batch by (vector length, position)."""
    width, position = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "position"))
    code = width * (1 << 16) + position
    for key in np.unique(code).tolist():
        yield key >> 16, key & 0xFFFF, np.flatnonzero(code == key)


def _looked_up(parts: DataFrame, books) -> DataFrame:
    """Members with the nearest entry of the new codebooks: ``move`` if it is another one; and sums of those that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for width, position, at in _by_part(batch):
                own = batch.take(pa.array(at))
                matrix = _matrix(own.column("part"))
                best, _ = books.value.nearest(width, position, matrix)
                before = np.array(own.column("entry").fill_null(-1))
                stays = best == before
                sums.add(width, position, best[stays], matrix[stays])
                kind = pa.array(np.where(stays, "stay", "move"), pa.string())
                yield _rows(kind, own.column("width"), own.column("position"), best, row=own.column("row"), part=own.column("part"))
        yield sums.batch()

    return parts.mapInArrow(run, ROW)


def _arrived(moves: DataFrame) -> DataFrame:
    """Parts at their new owner, with sums of what arrived there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for width, position, at in _by_part(batch):
                own = batch.take(pa.array(at))
                sums.add(width, position, np.array(own.column("entry")), _matrix(own.column("part")))
                yield _rows("stay", *(own.column(c) for c in ("width", "position", "entry")), row=own.column("row"), part=own.column("part"))
        yield sums.batch()

    return moves.mapInArrow(run, ROW)


def _errors(parts: DataFrame, books) -> DataFrame:
    """(row, position, entry, error) under the final codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, position, at in _by_part(batch):
                own = batch.take(pa.array(at))
                best, far = books.value.nearest(width, position, _matrix(own.column("part")))
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("position"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["row", "position", "entry", "error"])

    return parts.mapInArrow(run, "row long, position int, entry int, error long")


class _Members:
    """The parts in their owners' files: those that stayed in the last round and those that arrived in it."""

    def __init__(self, stage: Stage, salts: int):
        self.stage, self.salts, self.held, self.turn = stage, salts, [], 0

    def _written(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = f"{self.stage.root}/{name}"
        df.write.partitionBy("kind").parquet(path)
        return name, self.stage.spark.read.schema(ROW).parquet(path)

    def parts(self) -> DataFrame:
        out = self.held[0][1].where("kind = 'stay'")
        for _, more in self.held[1:]:
            out = out.unionByName(more.where("kind = 'stay'"))
        return out

    def assign(self, parts: DataFrame, books) -> dict[tuple[int, int, int], tuple[list[int], int]]:
        """Looks every member up where it lies and lets those that change their entry migrate; gives the owners' sums."""
        self.turn += 1
        looked_up = self._written(_looked_up(parts, books), f"looked_up_{self.turn}")
        moves = looked_up[1].where("kind = 'move'").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(self.salts)))
        arrived = self._written(_arrived(moves.repartition("position", "entry", "salt", "width").drop("salt")), f"arrived_{self.turn}")
        before, self.held = [name for name, _ in self.held], [looked_up, arrived]
        self.stage.drop(*before)
        both = looked_up[1].where("kind = 'sum'").unionByName(arrived[1].where("kind = 'sum'"))
        each = both.select("width", "position", "entry", "members", F.posexplode_outer("sums").alias("place", "value"))
        totals = each.groupBy("width", "position", "entry", "place").agg(F.sum("value").alias("value"), F.sum("members").alias("members"))
        found: dict[tuple[int, int, int], tuple[list[int], int]] = {}
        for r in totals.orderBy("width", "position", "entry", "place").collect():  # as many as the codebooks have components
            sums, _ = found.setdefault((r.width, r.position, r.entry), ([], r.members))
            if r.place is not None:
                sums.append(int(r.value))
        return found


def compress(vectors: DataFrame, stage: Stage, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of the rows whose vector is usable.

    ``code`` has two hex digits for each part. ``error`` is the squared distance between a vector's integers and its entries.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", integers(F.col("embedding")).alias("whole"), F.monotonically_increasing_id().alias("row")).where(_finite(F.col("embedding")))
    rows = stage.table(rows.withColumn("width", F.size("whole")), "rows")
    widths = [(r.width, r.n) for r in rows.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect()]
    if not widths:
        return rows.select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    first, cut = {}, F.lit(None).cast("array<struct<position:int,part:array<bigint>>>")
    for width, _ in widths:
        chosen = rows.where(F.col("width") == width).orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).collect()
        spans = bounds(width, positions)
        first |= {(width, p): tuple(tuple(r.whole[lo:hi]) for r in chosen) for p, (lo, hi) in enumerate(spans)}
        own = F.array(*[F.struct(F.lit(p).alias("position"), F.slice("whole", lo + 1, hi - lo).alias("part")) for p, (lo, hi) in enumerate(spans)])
        cut = F.when(F.col("width") == width, own).otherwise(cut)
    parts = rows.select("width", "row", F.inline(cut)).withColumns({"kind": F.lit("stay"), "entry": F.lit(None).cast("int"), "sums": F.lit(None).cast("array<decimal(38,0)>"), "members": F.lit(None).cast("long")}).select(*FIELDS)

    books = Codebooks(first)
    members = _Members(stage, max(SALTS, -(-max(n for _, n in widths) // OWNED)))
    for turn in range(rounds):
        given = spark.sparkContext.broadcast(books)  # positions x entries, for each vector length
        books = books.updated(members.assign(parts if turn == 0 else members.parts(), given))
    errors = _errors(members.parts() if rounds else parts, spark.sparkContext.broadcast(books))
    digit = F.lpad(F.lower(F.hex("entry")), 2, "0")
    coded = errors.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", digit.alias("digits")))), lambda s: s["digits"]), "").alias("code"), _capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
    digests = F.lit("")
    for width, _ in widths:
        digests = F.when(F.col("width") == width, books.digest(width)).otherwise(digests)
    coded = stage.table(rows.select("row", "vec_id", "label", digests.alias("codebooks_sha256")).join(coded, "row"), "coded")
    labels = coded.groupBy(F.col("label").alias("__label")).agg(_capped(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    labels = stage.table(labels, "labels")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def _capped(total: Column) -> Column:
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every usable vector."""
    return compress(table(spark, sf_dir, "embeddings"), Stage(spark)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same rounds, each with all parts, as common table expressions."""
    dim = "CAST(len(ints) / 8 AS BIGINT)"
    ctes = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS ints
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT vec_id, p, ints[p * {dim} + 1 : (p + 1) * {dim}] AS part FROM kept, range(8) t(p))",
        """book0 AS MATERIALIZED (SELECT p, e, part FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 16) USING (vec_id))""",
    ]
    near = "list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for turn in range(ROUNDS + 1):
        ctes.append(f"""assigned{turn} AS MATERIALIZED (SELECT x.vec_id, x.p, any_value(x.part) AS part, min({{'d': CAST({near} AS BIGINT), 'e': b.e}}) AS m
        FROM parts x JOIN book{turn} b ON x.p = b.p GROUP BY x.vec_id, x.p)""")
        if turn < ROUNDS:
            ctes.append(f"""mean{turn} AS MATERIALIZED (SELECT p, e, list(v ORDER BY i) AS part FROM (SELECT p, m.e AS e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS v
            FROM assigned{turn}, range(1, 1 + (SELECT max(len(part)) FROM parts)) t(i) GROUP BY p, m.e, i) GROUP BY p, e)""")
            ctes.append(f"book{turn + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.part, b.part) AS part FROM book{turn} b LEFT JOIN mean{turn} n ON b.p = n.p AND b.e = n.e)")
    ctes.append(f"""coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM assigned{ROUNDS} GROUP BY vec_id)""")
    ctes.append(f"""digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})""")
    return f"""WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest"""


SQL = _sql()
