"""Approximate nearest neighbours by cosine: a neighbour graph from NN-descent, searched greedily.

The graph starts from the nearest vectors within the leaves of a few random-projection trees, whose splits are fitted on a
bounded sample. NN-descent rounds then join the lists of neighbours with the vectors, so that every vector's neighbours
(and those it is a neighbour of) meet as one group; each compares its members and proposes better neighbours to them. All
vectors are in the graph. A query starts at its own neighbours and walks the graph: each hop joins the best nodes not yet
followed with their neighbours, which are stored with their vectors and partitioned by node, and keeps the best ``BEAM``
nodes seen, until all of them have been followed. The nearest of these are scored exactly on the original vectors.

Nearness in lists is minus half the squared distance of unit vectors, that is cosine - 1, taken in double precision from
vectors in single precision: it stays exact in proportion where vectors lie so close that their cosines agree in the first digits.

Bounds: a group holds ``DEGREE`` neighbours and about ``DEGREE`` reverse ones (chosen by chance where there are more, as in
NN-descent; the search is measured against brute force in the tests); leaves hold ``LEAF`` vectors at most, larger ones are split by hash.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as do rows without an
id. Rows repeated with one id count once, with the smallest vector. Vectors of different lengths have no cosine, so each length is
searched for itself. Ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.session import Stage

from .common import table, uniform
from .vectors import flat_lists, groups, stacked, unit_rows, units, usable

DEGREE, TREES, LEAF, ROUNDS = 24, 8, 1024, 2
#: Vectors the trees are fitted on, and levels that have splits of their own per node.
SAMPLE, OWN_SPLITS = 8192, 8
BEAM, FOLLOW, MOST_HOPS, FINAL = 320, 64, 16, 16
LIST_SCHEMA = "vec_id long, ids array<long>, sims array<float>"


def closeness(x: np.ndarray) -> np.ndarray:
    """Minus half the squared distance of every two rows."""
    x = x.astype(np.float64)
    half = (x * x).sum(1) / 2
    return np.minimum(x @ x.T - half[:, None] - half[None, :], 0)


def fit_trees(vectors: DataFrame, n: int, seed: int = 3) -> dict[int, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """For each length of vectors in the sample, tree and level: a direction, and the cut of each node (one cut for all nodes in deep levels)."""
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / (0.8 * LEAF)))))
    by_length: dict[int, list[np.ndarray]] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("unit").collect() if depth else []:
        by_length.setdefault(len(r["unit"]) // 4, []).append(np.frombuffer(r["unit"], "<f4"))
    return {length: _trees(np.stack(rows), depth, seed) for length, rows in by_length.items()}


def _trees(x: np.ndarray, depth: int, seed: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    rng, trees = np.random.default_rng(seed), []
    for _ in range(TREES):
        node, levels = np.zeros(len(x), np.int64), []
        for level in range(depth):
            direction = rng.normal(size=x.shape[1]).astype(np.float32)
            along = x @ direction
            whole = float(np.median(along))
            cuts = np.full(1 << level, whole, np.float32) if level < OWN_SPLITS else np.array([whole], np.float32)
            if level < OWN_SPLITS:
                for i in np.unique(node):
                    cuts[i] = np.median(along[node == i])
            levels.append((direction, cuts))
            node = 2 * node + (along > cuts[node if level < OWN_SPLITS else np.zeros_like(node)])
        trees.append(levels)
    return trees


def _leaf(trees, x: np.ndarray) -> Iterator[np.ndarray]:
    for levels in trees:
        node = np.zeros(len(x), np.int64)
        for level, (direction, cuts) in enumerate(levels):
            node = 2 * node + (x @ direction > cuts[node if len(cuts) > 1 or level == 0 else np.zeros_like(node)])
        yield node


def _best(ids: np.ndarray, sims: np.ndarray, own: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest distinct ids but its own; ties to the smaller id."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    first = first[ids[first] != own][:most]
    return ids[first], sims[first]


def leaf_lists(vectors: DataFrame, stage: Stage, n: int) -> DataFrame:
    """Neighbour lists of every vector within its leaf of each tree."""
    trees = vectors.sparkSession.sparkContext.broadcast(fit_trees(vectors, n))
    unfitted: list = [[] for _ in range(TREES if n > LEAF else 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column("unit")).to_numpy() // 4
            for length in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == length))
                for t, leaf in enumerate(_leaf(trees.value.get(length, unfitted), stacked(rows.column("unit"), "<f4"))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.num_rows, length), pa.int32()), pa.array(np.full(rows.num_rows, t), pa.int32()), pa.array(leaf), rows.column("vec_id"), rows.column("unit")],
                        names=["length", "tree", "leaf", "vec_id", "unit"],
                    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["length", "tree", "leaf", "part"]):
            ids, x = rows.column("vec_id").to_numpy(), stacked(rows.column("unit"), "<f4")
            sims = closeness(x)
            np.fill_diagonal(sims, -np.inf)
            at = np.argsort(-sims, axis=1, kind="stable")[:, : min(DEGREE, len(ids) - 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), flat_lists(list(ids[at]), pa.int64()), flat_lists(list(np.take_along_axis(sims, at, 1)), pa.float32())], names=["vec_id", "ids", "sims"]
            )

    placed = vectors.select("vec_id", "unit").mapInArrow(place, "length int, tree int, leaf long, vec_id long, unit binary")
    sizes = stage.table(placed.groupBy("length", "tree", "leaf").agg(F.count("*").alias("size")), "leaf_sizes")
    part = F.pmod(F.xxhash64("vec_id", "tree"), F.ceil(F.col("size") / LEAF)).cast("int")
    leaf = ["length", "tree", "leaf", "part"]
    dealt = placed.join(sizes, leaf[:3]).select(*leaf[:3], part.alias("part"), "vec_id", "unit").repartition(*leaf).sortWithinPartitions(*leaf, "vec_id")
    return dealt.mapInArrow(near, LIST_SCHEMA)


def merged(lists: DataFrame) -> DataFrame:
    """One list per vector, of the nearest proposed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sims = [], [], []
        for (key,), rows in groups(batches, ["vec_id"]):
            rows = rows.combine_chunks()
            best = _best(rows.column("ids").combine_chunks().flatten().to_numpy(), rows.column("sims").combine_chunks().flatten().to_numpy(), key, DEGREE)
            keys.append(key)
            ids.append(best[0])
            sims.append(best[1])
            if len(keys) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat_lists(ids, pa.int64()), flat_lists(sims, pa.float32())], names=["vec_id", "ids", "sims"])
                keys, ids, sims = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat_lists(ids, pa.int64()), flat_lists(sims, pa.float32())], names=["vec_id", "ids", "sims"])

    return lists.repartition("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, LIST_SCHEMA)


def descend(graph: DataFrame, vectors: DataFrame, stage: Stage, turn: int) -> DataFrame:
    """One NN-descent round."""
    edges = stage.table(graph.select(F.col("vec_id").alias("v"), F.explode("ids").alias("u")), f"edges_{turn}")
    degrees = stage.table(edges.groupBy("u").agg(F.count("*").alias("degree")), f"degrees_{turn}")
    reverse = edges.join(degrees, "u").where(uniform("u", "v", F.lit(turn)) * F.col("degree") < DEGREE).select(F.col("u").alias("group"), F.col("v").alias("member"))
    members = stage.table(edges.select(F.col("v").alias("group"), F.col("u").alias("member")).unionAll(reverse).distinct(), f"groups_{turn}")
    farthest = graph.select(F.col("vec_id").alias("member"), F.when(F.size("sims") < DEGREE, F.lit(float("-inf"))).otherwise(F.array_min("sims")).cast("float").alias("worst"))
    state = stage.table(vectors.select(F.col("vec_id").alias("member"), "unit").join(farthest, "member"), f"state_{turn}")
    rows = members.join(state, "member").repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, sims = [], [], []
        for _, part in groups(batches, ["group"]):
            names, x, worst = part.column("member").to_numpy(), stacked(part.column("unit"), "<f4"), part.column("worst").to_numpy()
            near = closeness(x).astype(np.float32)
            np.fill_diagonal(near, -np.inf)
            better = near > worst[:, None]
            for i in np.flatnonzero(better.any(1)).tolist():
                at = np.flatnonzero(better[i])
                keys.append(names[i])
                ids.append(names[at])
                sims.append(near[i, at])
            if len(keys) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat_lists(ids, pa.int64()), flat_lists(sims, pa.float32())], names=["vec_id", "ids", "sims"])
                keys, ids, sims = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat_lists(ids, pa.int64()), flat_lists(sims, pa.float32())], names=["vec_id", "ids", "sims"])

    return stage.table(merged(graph.unionAll(rows.mapInArrow(run, LIST_SCHEMA))), f"graph_{turn}")


def build_graph(vectors: DataFrame, stage: Stage, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, ids, sims) for every vector of (vec_id, unit)."""
    n = vectors.count()
    graph = stage.table(merged(leaf_lists(vectors, stage, n).unionAll(vectors.select("vec_id", F.expr("cast(array() as array<long>)").alias("ids"), F.expr("cast(array() as array<float>)").alias("sims")))), "graph_0")
    if n <= LEAF:  # one leaf held everything
        return graph
    for turn in range(1, rounds + 1):
        graph = descend(graph, vectors, stage, turn)
        stage.drop(f"edges_{turn}", f"degrees_{turn}", f"groups_{turn}", f"state_{turn}", f"graph_{turn - 1}")
    return graph


def search(queries: DataFrame, vectors: DataFrame, graph: DataFrame, stage: Stage) -> DataFrame:
    """(query_id, ids, sims): the nodes nearest to each query that a greedy walk from its own neighbours meets.

    ``queries``: (vec_id, unit), nodes of the graph themselves.
    """
    width = max(12, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = stage.table(
        graph.select("vec_id", F.posexplode("ids").alias("place", "member")).join(vectors.select(F.col("vec_id").alias("member"), "unit"), "member")
        .groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("place", "member", "unit"))).alias("near"))
        .select(F.col("vec_id").alias("node"), F.col("near.member").alias("near_ids"), F.col("near.unit").alias("near_units")),
        "nodes",
    ).repartition(width, "node").persist(StorageLevel.DISK_ONLY)
    beams = stage.table(
        queries.select(F.col("vec_id").alias("query_id"), "unit").join(graph.withColumnRenamed("vec_id", "query_id"), "query_id")
        .select("query_id", "unit", "ids", "sims", F.transform("ids", lambda i: F.lit(False)).alias("followed")),
        "beams_0",
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sims, keys = [], [], batch.column("query_id")
            for query, near_ids, near, least in zip(batch.column("unit").to_pylist(), batch.column("near_ids").to_pylist(), batch.column("near_units").to_pylist(), batch.column("least").to_pylist()):
                own = np.frombuffer(query, "<f4").astype(np.float64)
                apart = np.frombuffer(b"".join(near), "<f4").reshape(len(near), len(own)) - own
                s = (-0.5 * (apart * apart).sum(1)).astype(np.float32)
                good = np.flatnonzero(s >= least)
                ids.append(np.array(near_ids, np.int64)[good])
                sims.append(s[good])
            yield pa.RecordBatch.from_arrays([keys, flat_lists(ids, pa.int64()), flat_lists(sims, pa.float32())], names=["query_id", "ids", "sims"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (query,), rows in groups(batches, ["query_id"]):
            own = rows.filter(pc.is_valid(rows.column("unit"))).to_pylist()[0]
            known = dict(zip(own["ids"], own["followed"]))
            rank = np.lexsort((own["ids"], -np.array(own["sims"], np.float32)))
            for i in [i for i in rank.tolist() if not own["followed"][i]][:FOLLOW]:
                known[own["ids"][i]] = True
            rows = rows.combine_chunks()
            ids, sims = _best(rows.column("ids").combine_chunks().flatten().to_numpy(), rows.column("sims").combine_chunks().flatten().to_numpy(), query, BEAM)
            yield pa.RecordBatch.from_arrays(
                [pa.array([query], pa.int64()), pa.array([own["unit"]], pa.binary()), flat_lists([ids], pa.int64()), flat_lists([sims], pa.float32()), flat_lists([np.array([known.get(i, False) for i in ids.tolist()], bool)], pa.bool_())],
                names=["query_id", "unit", "ids", "sims", "followed"],
            )

    for hop in range(1, MOST_HOPS + 1):
        open_ = F.slice(F.array_sort(F.filter(F.arrays_zip(F.transform("sims", lambda s: -s).alias("s"), F.col("ids").alias("i"), F.col("followed").alias("f")), lambda z: ~z["f"])), 1, FOLLOW)
        least = F.when(F.size("ids") < BEAM, F.lit(float("-inf"))).otherwise(F.array_min("sims")).cast("float")
        frontier = beams.select("query_id", "unit", least.alias("least"), F.explode(open_).alias("next")).select("query_id", "unit", "least", F.col("next.i").alias("node"))
        found = frontier.repartition(width, "node").join(nodes, "node").select("query_id", "unit", "least", "near_ids", "near_units").mapInArrow(step, "query_id long, ids array<long>, sims array<float>")
        both = beams.unionAll(found.select("query_id", F.lit(None).cast("binary").alias("unit"), "ids", "sims", F.lit(None).cast("array<boolean>").alias("followed")))
        beams = stage.table(both.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(gather, beams.schema), f"beams_{hop}")
        stage.drop(f"beams_{hop - 1}")
        if beams.where(F.exists("followed", lambda f: ~f)).isEmpty():
            break
    nodes.unpersist()
    return beams.select("query_id", "ids", "sims")


def nearest(embeddings: DataFrame, is_query, stage: Stage, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``is_query`` holds."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = stage.table(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    vectors = stage.table(unit_rows(rows, ["vec_id"]), "units")
    graph = build_graph(vectors, stage)
    queries = vectors.where(is_query)
    found = search(queries, vectors, graph, stage)
    # More than k are scored exactly, as the walk ranks by rounded vectors.
    picked = F.slice(F.array_sort(F.arrays_zip(F.transform("sims", lambda s: -s).alias("s"), F.col("ids").alias("i"))), 1, max(FINAL, 3 * k))
    pairs = found.select("query_id", F.explode(picked).alias("p")).select("query_id", F.col("p.i").alias("vec_id"))
    joined = (
        pairs.join(rows, "vec_id").withColumnRenamed("embedding", "a")
        .join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("b")), "query_id").select("query_id", "vec_id", "a", "b")
    )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("a").value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == length))
                score = np.clip((units(rows.column("a")) * units(rows.column("b"))).sum(1), -1, 1)
                yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    scored = joined.mapInArrow(exact, "query_id long, vec_id long, score double")
    best = scored.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "n")).select("query_id", (F.col("place") + 1).alias("rank"), "n.vec_id", "n.score")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Stage(spark))
