"""Similarity join of texts on the Jaccard similarity of their word n-grams, by chosen paths.

Every text is a set of hashed word n-grams. Sets that are equal form a class, and only one representative of a class is compared.
Each set is embedded as min-hash tokens; two sets share a token with their similarity as the chance. The search is repeated: a
repetition starts from a token of its own, and sets that share it fall into one bucket; buckets that are still large are split again
on one or (a quarter of the time, so that paths of similar pairs do not die out) two more tokens, chosen by the bucket from those
that the repetition has for this depth. A bucket ends when it is small, or when splitting hardly shrinks it, because its sets are near copies of each other. Ended buckets
are compared by brute force on the full sets, in blocks, so a large group is spread over many tasks.

A pair that meets in several buckets is counted in the first of them only, which is known from the buckets of its two sets.
So each compared block yields one count per set and the edges of a spanning forest, never its pairs. Exact copies and
near copies thus cost rows in proportion to their number. Components are found from the forests.

Words are separated by ASCII white space and compared as they are. A text of fewer words than an n-gram is one n-gram.
Defined results: texts without words (null, empty, white space) and rows without an id link with nothing and stay. Repeated rows
are copies; rows of one id with different texts are versions of one document, whose component is that of them all; ``kept`` is true for all rows that have the smallest id. ``n_links``, ``component_id`` and ``kept`` are replaced if the
input has them; all other columns are ignored by the join and pass through ``drop_near_copies``.

Recall: no two repetitions share a token, so their misses are independent. ``survival`` computes exactly with which chance a pair at the
threshold still shares a bucket of one repetition at each depth (branching by 1/t keeps the expected number of shared paths at t), and
``repetitions`` is the least number of them with which the chance to meet reaches ``RECALL`` = 0.999 at the last depth, and so at every
depth: 18 for 0.8. Buckets that end earlier, and more similar pairs, do better. Deep tokens are one byte; that they agree by chance only
adds pairs to compare. Similarities are computed on 64-bit hashes of whole n-gram sets.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.session import Stage

from .common import split_words, table
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: Chance with which a pair at the threshold meets, whatever the depth of its buckets.
RECALL = 0.999
#: Buckets up to this size are compared; one that keeps this share of its parent is compared as it is; and so are all at the last depth.
SMALL, STUBBORN, DEPTH = 48, 0.75, 8
#: Every repetition has so many tokens of its own for every depth, so that no path splits on a token twice.
PER_DEPTH = 3
#: Sets in a block of a large bucket; columns of the comparison matrix at a time.
BLOCK, COLUMNS = 768, 4096
#: So many times, on the average, a set may lie on disk to be compared.
COPIES = 4
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def branching(threshold: float) -> float:
    """The chance of a second path that keeps the expected number of shared paths of a pair at the threshold."""
    return min(1.0, 1 / threshold - 1)


def survival(similarity: float, branch: float, depth: int = DEPTH) -> list[float]:
    """The chance that a pair shares a bucket of one repetition, at each depth from 1.

    The shared buckets of a depth choose among the same ``PER_DEPTH`` tokens, which is taken into account: over every choice of the
    tokens that agree, the buckets that follow from each shared bucket are independent.
    """
    shared, out = np.array([1 - similarity, similarity]), [similarity]
    for _ in range(1, depth):
        following = np.zeros(2 * len(shared) - 1)
        for agree in itertools.product((0, 1), repeat=PER_DEPTH):
            chance = similarity ** sum(agree) * (1 - similarity) ** (PER_DEPTH - sum(agree))
            one = sum(agree) / PER_DEPTH
            two = np.bincount([agree[k] + agree[(k + 1) % PER_DEPTH] for k in range(PER_DEPTH)], minlength=3) / PER_DEPTH
            each, total = (1 - branch) * np.array([1 - one, one, 0]) + branch * two, np.ones(1)
            for p in shared:
                following[: len(total)] += chance * p * total
                total = np.convolve(total, each)
        shared = following
        out.append(float(1 - shared[0]))
    return out


@lru_cache
def repetitions(threshold: float) -> int:
    """The least number of repetitions with which a pair at the threshold meets with chance ``RECALL`` at every depth."""
    missed = 1 - min(survival(threshold, branching(threshold)))
    return 1 if missed <= 1 - RECALL else math.ceil(math.log(1 - RECALL) / math.log(missed))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; empty for a text without words."""
    vocabulary, tokens, counts = split_words(texts)
    hashed = pd.util.hash_array(np.array(vocabulary, object), categorize=False) if vocabulary else np.zeros(0, np.uint64)
    given = hashed[tokens]
    ends = np.cumsum(counts)
    rolled = given.copy()
    for k in range(1, min(words, len(given))):
        rolled[: len(given) - k] = rolled[: len(given) - k] * _PRIME + given[k:]
    rolled = _mixed(rolled)
    sets = []
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= words:
            sets.append(np.unique(rolled[end - count : end - words + 1]))
        elif count:
            powers = np.cumprod(np.full(count, _PRIME))
            sets.append(_mixed(np.array([(given[end - count : end] * powers).sum() + np.uint64(count)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


def sketch(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, set_id, tokens, deep) of the documents that have an id and a word: the first token of every repetition, and those of
    the further depths, depth by depth and in it repetition by repetition."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("set_id", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("deep", T.ArrayType(T.ByteType()))])
    roots = repetitions(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(roots * (1 + (DEPTH - 1) * PER_DEPTH))
        first, further = factors[:roots], (factors[roots:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column("text"), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                flat = np.concatenate([sets[i] for i in full])
                heads = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
                tokens = np.stack([np.minimum.reduceat(flat * f, heads) for f in first], 1) >> np.uint64(32)
                half = (flat >> np.uint64(32)).astype(np.uint32)
                deep = np.stack([np.minimum.reduceat(half * f, heads).astype(np.uint8) for f in further], 1)
                ids = [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in full]
                lists = [_lists(tokens.astype(np.uint32).view(np.int32), pa.int32()), _lists(deep.view(np.int8), pa.int8())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(full)), pa.array(ids, pa.binary()), *lists], names=["doc_id", "set_id", "tokens", "deep"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _key(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def split_buckets(reps: DataFrame, stage: Stage, threshold: float = THRESHOLD) -> DataFrame:
    """(bucket, rep, dense): the ended buckets with two sets or more; dense ones ended large. ``reps``: (rep, tokens, deep)."""
    roots, branch = repetitions(threshold), branching(threshold)
    open_ = reps.select("rep", F.posexplode("tokens").alias("root", "token")).select("rep", F.col("root").cast("byte").alias("root") if roots < 128 else "root", _key("root", "token").alias("bucket"), F.lit(None).cast("long").alias("parent_size"))
    ended = []
    for depth in range(1, DEPTH + 1):
        rows = stage.table(open_, f"paths_{depth}")
        sizes = stage.table(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), f"sizes_{depth}")
        sized = rows.join(sizes, "bucket")
        end = (F.col("size") <= SMALL) | (F.coalesce(F.col("size") >= STUBBORN * F.col("parent_size"), F.lit(False))) | F.lit(depth == DEPTH)
        ended.append(sized.where(end).select("bucket", "rep", (F.col("size") > SMALL).alias("dense")))
        # Whether any bucket stays open is read off the sizes where they decide alone.
        if depth == DEPTH or sizes.where(F.col("size") > SMALL).isEmpty():
            break
        # Only the tokens of this depth move.
        given = reps.select("rep", F.slice("deep", (depth - 1) * roots * PER_DEPTH + 1, roots * PER_DEPTH).alias("given"))
        at = lambda k: F.col("root") * PER_DEPTH + F.pmod(F.xxhash64("bucket") + k, F.lit(PER_DEPTH)).cast("int")
        more = F.pmod(F.xxhash64("bucket", F.lit("branch")), F.lit(1000)) < int(1000 * branch)
        path = lambda k: F.struct(_key("bucket", F.lit(k), F.element_at("given", at(k) + 1)).alias("bucket"))
        open_ = (
            sized.where(~end).join(given, "rep")
            .select("rep", "root", F.col("size").alias("parent_size"), F.explode(F.when(more, F.array(path(1), path(2))).otherwise(F.array(path(1)))).alias("next"))
            .select("rep", "root", "next.bucket", "parent_size")
        )
    found = ended[0]
    for more_rows in ended[1:]:
        found = found.unionAll(more_rows)
    return found


def distinct_buckets(buckets: DataFrame, stage: Stage) -> DataFrame:
    """Of buckets with the same members, one: (bucket, rep, size).

    Every root leads a group of near copies to a dense bucket of nearly the same members. Those are joined first: a dense bucket
    takes the smallest name of any dense bucket that one of its members is in, so what met in one of them still meets.
    """
    ended = stage.table(buckets.distinct(), "ended")
    dense = ended.where("dense").select("bucket", "rep")
    least = dense.groupBy("rep").agg(F.min("bucket").alias("least"))
    names = stage.table(dense.join(least, "rep").groupBy("bucket").agg(F.min("least").alias("name")), "dense_names")
    rows = stage.table(ended.where("not dense").select("bucket", "rep").unionAll(dense.join(names, "bucket").select(F.col("name").alias("bucket"), "rep").distinct()), "buckets")
    print_ = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("s"))
    kept = stage.table(print_.groupBy("size", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "bucket_sizes")
    return rows.join(kept, "bucket")


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many elements each of the first ``left`` sets shares with each of all sets."""
    sizes = np.array([len(s) for s in sets])
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    total = np.zeros((left, len(sets)), np.float32)
    if not len(flat):
        return total
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return total
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1
    for low in range(0, int(column[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, (low, low + COLUMNS))
        grid = np.zeros((len(sets), int(column[hi - 1]) - low + 1), np.float32)
        grid[owner[lo:hi], column[lo:hi] - low] = 1
        total += grid[:left] @ grid.T
    return total


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (member, smallest member) of the components of index pairs."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(i, root(i)) for i in range(n) if root(i) != i]


def compare(bucket: int, first: list[dict], second: list[dict], threshold: float) -> Iterator[tuple[int, int | None, int]]:
    """(rep, None, copies it links with) and (rep, other, 0) of a block, or of two blocks, of a bucket."""
    members, left = first + second, len(first)
    sets = [np.frombuffer(m["grams"], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    common = overlaps(sets, left)
    # In whole numbers where it counts: shared / union >= threshold.
    linked = common >= threshold * (sizes[:left, None] + sizes[None, :] - common) - 1e-6
    if second:
        linked[:, :left] = False
    else:
        linked &= np.triu(np.ones_like(linked), 1)
    at = np.argwhere(linked)
    if not len(at):
        return
    edges = forest(at, len(members))
    # Pairs that met in an earlier bucket are counted there.
    earlier = overlaps([m["buckets"][m["buckets"] < bucket].view(np.uint64) for m in members], left)
    linked &= earlier == 0
    copies = np.array([m["copies"] for m in members], np.int64)
    counts = linked.astype(np.float64).T @ copies[:left]
    counts[:left] += linked.astype(np.float64) @ copies
    reps = [m["rep"] for m in members]
    for i in np.flatnonzero(counts).tolist():
        yield reps[i], None, int(round(counts[i]))
    for a, b in edges:
        yield reps[a], reps[b], 0


def with_cells(sets: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """The sets with ``cells``: the (bucket, i, j, second) of the blocks and pairs of blocks they are compared in, of one of ``parts`` shares
    of them; sets that have none there are left out. places: the (bucket, size) that the set is in, in order."""

    def of(place: Column) -> Column:
        blocks = F.ceil(place["size"] / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("rep", F.lit("block")), blocks).cast("int")
        return F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(
            place["bucket"].alias("bucket"), F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), (own > other).alias("second")))

    cells = F.flatten(F.transform("places", of))
    if parts > 1:
        cells = F.filter(cells, lambda c: F.pmod(F.xxhash64(c["bucket"], c["i"], c["j"], F.lit("part")), F.lit(parts)) == part)
    found = sets.withColumn("cells", cells)
    return found.where(F.size("cells") > 0) if parts > 1 else found


def compare_buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, other, links) from sets (rep, copies, places, cells, grams)."""
    rows = (
        sets.select("rep", "copies", "grams", F.col("places.bucket").alias("buckets"), F.inline("cells"))
        .select("bucket", "rep", "i", "j", "second", "copies", "grams", "buckets")
        .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    )
    schema = "rep long, other long, links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key, members) -> list[tuple]:
            first, second = [m for m in members if not m["second"]], [m for m in members if m["second"]]
            if key[1] != key[2] and not (first and second):
                return []
            return list(compare(key[0], first, second, threshold))

        key, members, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                row["buckets"] = np.array(row["buckets"], np.int64)
                now = (row["bucket"], row["i"], row["j"])
                if now != key and members:
                    out += made(key, members)
                    members = []
                    if len(out) > 10_000:
                        yield _records(out)
                        out = []
                key = now
                members.append(row)
        if members:
            out += made(key, members)
        yield _records(out)

    return rows.mapInArrow(run, schema)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "other", "links"])


def gram_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The other columns and ``grams`` for ``text``."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                grams = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(grams, pa.binary())], names=[*kept, "grams"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("grams", T.BinaryType())]))


def near_copies(docs: DataFrame, stage: Stage, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(doc_id, n_links, component_id, kept) of every row: links with other rows of similarity ``threshold`` or more."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stage.table(sketch(docs, words, threshold), "sketches")
    reps = stage.table(sketches.groupBy("set_id").agg(F.min(F.struct("doc_id", "tokens", "deep")).alias("m"), F.count("*").alias("copies")).select("set_id", F.col("m.doc_id").alias("rep"), "copies", F.col("m.tokens").alias("tokens"), F.col("m.deep").alias("deep")), "reps")
    # The tokens are needed no longer than the buckets take to be split.
    sets_of = stage.table(sketches.select("doc_id", "set_id"), "sets_of")
    stage.drop("sketches")
    buckets = stage.table(distinct_buckets(split_buckets(reps.select("rep", "tokens", "deep"), stage, threshold), stage), "members")
    reps_of = stage.table(reps.select("set_id", "rep", "copies"), "reps_of")
    stage.drop("reps", "buckets", "ended", *[f"paths_{d}" for d in range(1, DEPTH + 1)])
    places = buckets.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("bucket", "size"))).alias("places"))
    wanted = reps_of.join(places, "rep").select(F.col("rep").alias("doc_id"), "copies", "set_id", "places")
    # A repeated id may stand for several texts; the set tells which one is meant.
    texts = docs.where("doc_id is not null").join(wanted, "doc_id").groupBy("doc_id", "set_id").agg(F.max("copies").alias("copies"), F.max("text").alias("text"), F.first("places").alias("places"))
    # Stored, so that what the join shuffled is gone before the blocks are dealt.
    texts = stage.table(texts.select(F.col("doc_id").alias("rep"), "copies", "places", "text"), "texts")
    stage.drop("members", "bucket_sizes", "dense_names", *[f"sizes_{d}" for d in range(1, DEPTH + 1)])
    # A set of a large bucket moves once for each of its blocks. The blocks are dealt in shares, so that few copies of a set lie on disk at a time.
    parts = max(1, math.ceil(texts.agg(F.sum(F.aggregate("places", F.lit(0.0), lambda total, p: total + F.ceil(p["size"] / BLOCK))) / F.count("*") / COPIES).first()[0] or 0))
    shares = [stage.table(compare_buckets(gram_sets(with_cells(texts, part, parts), words), threshold), f"compared_{part}") for part in range(parts)]
    compared = reduce(DataFrame.unionAll, shares)
    stage.drop("texts")
    found = components(compared.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")), stage)
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = stage.table(
        reps_of.join(links, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_id", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "classes",
    )
    linked = sets_of.join(classes, "set_id").select("doc_id", "n_links", "component_id")
    alone = docs.where("doc_id is null or text is null or length(btrim(text, ' \\t\\n\\u000b\\f\\r')) = 0").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, stage: Stage, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The documents without those that have a smaller id in their component."""
    gone = near_copies(docs, stage, threshold, words).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all documents."""
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark))
