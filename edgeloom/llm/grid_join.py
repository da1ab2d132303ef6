"""Near-duplicate vectors by epsilon grid order.

Cosine >= t between unit vectors is distance <= eps = sqrt(2 - 2t). Vectors are projected on leading principal directions, the
projections cut into grid cells of side eps, and all vectors sorted by label and cell (one range partitioning). The sorted
sequence is cut into blocks, and blocks into a tree of sequence intervals with bounding boxes in the projections. The join starts
from the whole sequence of each label against itself and goes down the tree: a pair of intervals whose boxes are farther apart
than eps is skipped, any other is replaced by the pairs of its parts, until blocks meet blocks. Two blocks are compared in
double precision; they yield a count per vector and the edges of a spanning forest, never their pairs.

Exact copies (same label, same components) are one representative with a number of copies; so neither many copies
nor a large label meet in one task.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without a label or id, link with nothing: 0
links, component of their own, kept. Rows repeated with one id count as so many vectors. Vectors of different lengths do not link.
Columns ``n_links``, ``component_id`` and ``kept`` are new; others are not passed on. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import Stage

from .common import table
from .components import components
from .shingle_join import forest
from .vectors import groups, stacked, units, usable

THRESHOLD = 0.93
#: Principal directions in the boxes, of which the first so many make the grid cells.
DIRECTIONS, CELLS = 12, 6
BLOCK, FAN_BITS = 512, 4
#: Projections are rounded; this much is added to eps before a pair of intervals is skipped.
SLACK = 1e-5


def principal(reps: DataFrame, most: int = DIRECTIONS) -> np.ndarray:
    """Leading eigenvectors of the second moments, as rows; the moments are summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column("embedding"))
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = reps.select("embedding").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    side = 1 + max((r["i"] for r in cells), default=-1)
    moments = np.zeros((side, side))
    for r in cells:
        moments[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh(moments)[1][:, ::-1].T[:most] if side else np.zeros((0, 0))


def ordered_blocks(reps: DataFrame, directions: np.ndarray, eps: float) -> DataFrame:
    """(label, task, block, rep, copies, vector, p0, p1, ...): rows in grid order with the block they fall into."""
    d = len(directions)
    shared = reps.sparkSession.sparkContext.broadcast(directions)
    names = [f"p{k}" for k in range(d)]
    cells = [f"c{k}" for k in range(min(CELLS, d))]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(batch.num_rows, -1)
                along = units(batch.column("embedding")) @ shared.value.T
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("rep"), batch.column("copies"), pa.array([r.tobytes() for r in raw], pa.binary()), *(pa.array(a) for a in along.T),
                     *(pa.array(np.floor(a / eps).astype(np.int32)) for a in along.T[: len(cells)])],
                    names=["label", "rep", "copies", "vector", *names, *cells],
                )

    base = f"label {reps.schema['label'].dataType.simpleString()}, rep long, copies long, vector binary, " + ", ".join(f"{n} double" for n in names)
    order = ["label", *cells, "rep"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, inside, block = TaskContext.get().partitionId(), None, 0, -1
        for batch in batches:
            numbers = []
            for label in batch.column("label").to_pylist():
                if label != last or inside == BLOCK:
                    block, inside, last = block + 1, 0, label
                inside += 1
                numbers.append(block)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "rep", "copies", "vector", *names)), pa.array(np.full(batch.num_rows, task), pa.int64()), pa.array(numbers, pa.int64())],
                names=["label", "rep", "copies", "vector", *names, "task", "block"],
            )

    placed = reps.mapInArrow(project, base + ", " + ", ".join(f"{c} int" for c in cells))
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, base + ", task long, block long")


def interval_levels(blocks: DataFrame, stage: Stage, d: int) -> list[DataFrame]:
    """Boxes (label, node, parent, l0.., h0..) of intervals, blocks first; each level joins up to 16 neighbours of the one below.

    A node is (task, block) packed into one number, shifted: first the blocks of a range partition, then the partitions.
    """
    node = F.shiftleft(F.col("task"), 32) + F.col("block")
    sums = lambda prefix: [f(f"{prefix[i]}{k}").alias(f"{'lh'[i]}{k}") for k in range(d) for i, f in ((0, F.min), (1, F.max))]
    levels = [stage.table(blocks.groupBy("label", node.alias("node")).agg(*sums("pp")), "boxes_0")]
    tall = levels[0].agg(F.max(F.col("node").bitwiseAND((1 << 32) - 1)).alias("b"), F.max(F.shiftright("node", 32)).alias("t")).first()
    steps = (["block"] * -(-int(tall["b"] or 0).bit_length() // FAN_BITS) + ["task"] * -(-int(tall["t"] or 0).bit_length() // FAN_BITS)) if tall["b"] is not None else []
    for height, kind in enumerate(steps, 1):
        low, high = F.col("node").bitwiseAND((1 << 32) - 1), F.shiftright("node", 32)
        up = F.shiftleft(high, 32) + F.shiftright(low, FAN_BITS) if kind == "block" else F.shiftleft(F.shiftright(high, FAN_BITS), 32) + low
        levels[-1] = levels[-1].withColumn("parent", up)
        levels.append(stage.table(levels[-1].groupBy("label", F.col("parent").alias("node")).agg(*sums("lh")), f"boxes_{height}"))
    return levels


def block_pairs(levels: list[DataFrame], stage: Stage, d: int, eps: float) -> DataFrame:
    """(label, a, b): blocks that the descent from the roots could not prove distant; a <= b."""
    pairs = levels[-1].select("label", F.col("node").alias("a"), F.col("node").alias("b"))
    for height in range(len(levels) - 2, -1, -1):
        def side(s: str, height: int = height) -> DataFrame:
            return levels[height].select("label", F.col("parent").alias(s), F.col("node").alias(f"n{s}"), *[F.col(f"{e}{k}").alias(f"{s}{e}{k}") for k in range(d) for e in "lh"])

        gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"al{k}") - F.col(f"bh{k}"), F.col(f"bl{k}") - F.col(f"ah{k}")), 2) for k in range(d)), F.lit(0.0))
        parts = pairs.join(side("a"), ["label", "a"]).join(side("b"), ["label", "b"]).where((F.col("na") <= F.col("nb")) | (F.col("a") != F.col("b")))
        pairs = stage.table(parts.where(gap <= (eps + SLACK) ** 2).select("label", F.col("na").alias("a"), F.col("nb").alias("b")), f"pairs_{height}")
    return pairs


def compare_blocks(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(rep, other, links): counts of linked vectors, and forest edges."""
    node = F.shiftleft(F.col("task"), 32) + F.col("block")
    rows = blocks.select("label", node.alias("node"), "rep", "copies", "vector")
    left = pairs.select("label", F.col("a").alias("node"), "a", "b", F.lit(0).alias("side"))
    right = pairs.where("a <> b").select("label", F.col("b").alias("node"), "a", "b", F.lit(1).alias("side"))
    dealt = left.unionAll(right).join(rows, ["label", "node"]).select("label", "a", "b", "side", "rep", "copies", "vector").repartition("label", "a", "b").sortWithinPartitions("label", "a", "b", "side", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groups(batches, ["label", "a", "b"]):
            x = stacked(part.column("vector"), "<f8")
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            side, reps, copies = (part.column(c).to_numpy() for c in ("side", "rep", "copies"))
            n = int((side == 0).sum())
            if n == len(side):
                linked = np.triu(x @ x.T >= threshold, 1)
            else:
                linked = np.zeros((n, len(side)), bool)
                linked[:, n:] = x[:n] @ x[n:].T >= threshold
            at = np.argwhere(linked)
            if not len(at):
                continue
            counts = linked.T @ copies[:n].astype(np.float64)
            counts[:n] += linked @ copies.astype(np.float64)
            full, edges = np.flatnonzero(counts), forest(at, len(side))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((reps[full], reps[[a for a, _ in edges]])), pa.int64()), pa.array([None] * len(full) + reps[[b for _, b in edges]].tolist(), pa.int64()),
                 pa.array(np.concatenate((np.rint(counts[full]).astype(np.int64), np.zeros(len(edges), np.int64))), pa.int64())],
                names=["rep", "other", "links"],
            )

    return dealt.mapInArrow(run, "rep long, other long, links long")


def near_vectors(embeddings: DataFrame, stage: Stage, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).alias("takes_part"))
    members = rows.where("takes_part")
    reps = stage.table(members.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "reps")
    found = []
    for length in [r["d"] for r in reps.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]:
        own = reps.where(F.size("embedding") == length)
        sub = Stage(stage.spark)
        directions = principal(own)
        d = len(directions)
        blocks = sub.table(ordered_blocks(own, directions, eps), "blocks")
        found.append(stage.table(compare_blocks(blocks, block_pairs(interval_levels(blocks, sub, d), sub, d, eps), threshold), f"compared_{length}"))
        sub.clear()
    alone = rows.where("not takes_part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not found:
        return alone.withColumn("kept", F.lit(True))
    compared = found[0]
    for more in found[1:]:
        compared = compared.unionAll(more)
    linked = components(compared.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), stage)
    classes = stage.table(
        reps.join(compared.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "embedding", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "classes",
    )
    joined = members.select("vec_id", "label", "embedding").join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return joined.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label."""
    return near_vectors(table(spark, sf_dir, "embeddings"), Stage(spark))


SQL = """
WITH valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach AS (
  WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON l.a = w.b) SELECT a, min(b) AS least FROM walk GROUP BY a
),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(r.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN reach r ON r.a = e.vec_id
"""
