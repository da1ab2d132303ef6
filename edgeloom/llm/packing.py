"""Packing tokenised documents into sequences of bounded length, by hierarchical residual packing.

``token_pieces`` turns texts into pieces of at most ``capacity`` tokens. ``pack`` places pieces in sequences: every task takes
its own rows in chunks and packs each chunk best fit, largest first. Sequences with a residual of at most ``capacity // SLACK``
are finished. The others become items of their own size for the next level of the tree: they are dealt to nodes of about ``NODE``
of them, packed best fit again, and so on until one node has held all that are left, or until a level over several nodes saves
less than ``LEAST_GAIN`` of what it was given (then residuals are too small for any of the rest). A level only writes where its
sequences went, so what moves is three numbers an underfull sequence; pieces follow by joins at the end, each sequence at most
``capacity`` of them.

A tokeniser must drop white space, so that a text's ids are those of its words one after another; distinct words of a slice are
then encoded once. Any other raises ValueError. The file's path is a parameter.

Defined results: a null or empty text holds the end token alone. Texts are tokenised whole; only those longer than ``capacity``
are cut. Repeated rows are packed each for itself. Columns named as an output are replaced, all others pass through. An empty
table gives no rows. Lengths are at least 1 and at most ``capacity``; others raise ValueError.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.session import Stage

from .common import slices, split_words, table

CAPACITY = 4096
END = 1
#: Sequences with a residual of this part of the capacity, or less, are finished.
SLACK = 256
#: Items that are packed together in one go by a task.
CHUNK = 65_536
#: Underfull sequences that meet in a node of the tree.
NODE = 8_192
LEAST_GAIN = 0.001
#: A private character that parts words while they are encoded together.
MARK = "\ue000"
#: Marks that are tried as words of their own beside letters.
MARKS = ',.;:!?()[]"$&#%*=+-/~^@'
#: Words up to this length are kept in a worker's memo, of up to so many bytes in each of two generations.
SHORT, MEMO_BYTES, ENTRY_BYTES = 40, 96 << 20, 170

PIECE = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids of texts by way of their distinct words.

    New words are encoded many at a time, with a mark between them; a memo bounded in bytes holds the ids of short words. When it is
    full it becomes the older generation, from which words that are met again are taken over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole, *parts = self._alone([" \t a1'd \n\n b\r\nC,  d ", "a1'd", "b", "C,", "d"])
        if whole != b"".join(parts):
            raise ValueError("the tokeniser must drop white space")
        self.mark = np.frombuffer(self._alone([MARK])[0], np.uint32)
        together = lambda *parts: self._alone(["".join(parts)])[0] == b"".join(self._alone(list(parts)))
        self.marks = "".join(m for m in MARKS if together("ab", m) and together(m, "ab") and together("ab", m + m))
        self.lowers = len(set(self._alone(["Abc", "ABC", "abc"]))) == 1
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words without the mark, from one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        n = len(self.mark)
        found = np.ones(max(0, len(ids) - n + 1), bool)
        for k, part in enumerate(self.mark):
            found &= ids[k : k + len(found)] == part
        at = np.flatnonzero(found)
        if not n or len(at) != len(words) - 1:  # the mark is no token of its own here
            return self._alone(words)
        data = ids.tobytes()
        return [data[4 * lo : 4 * hi] for lo, hi in zip([0, *(at + n).tolist()], [*at.tolist(), len(ids)])]

    def _parts(self, word: str) -> tuple[str, ...]:
        """The word, or its letters and the marks around them, whose ids follow one another."""
        if word.isalpha():
            return (word.lower(),) if self.lowers and word.isascii() else (word,)
        stem = word.rstrip(self.marks)
        bare = stem.lstrip(self.marks)
        if not bare.isalpha():
            return (word,)
        letters = bare.lower() if self.lowers and bare.isascii() else bare
        return tuple(filter(None, (stem[: len(stem) - len(bare)], letters, word[len(stem) :])))

    def _encoded(self, words: list[str]) -> list[bytes]:
        memo, older = self.memo, self.older
        out: list[bytes | None] = [memo.get(w) for w in words]
        split: list[tuple[int, tuple[str, ...]]] = []
        parts: dict[str, bytes | None] = {}
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                own = (word,) if word in older else self._parts(word)
                split.append((i, own))
                for part in own:
                    if part not in parts:
                        found = memo.get(part)
                        parts[part] = older.get(part) if found is None else found
        plain = [p for p, ids in parts.items() if ids is None and MARK not in p]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            parts.update(zip(some, self._together(some)))
        marked = [p for p, ids in parts.items() if ids is None]
        parts.update(zip(marked, self._alone(marked)))
        for i, own in split:
            out[i] = parts[own[0]] if len(own) == 1 else b"".join([parts[p] for p in own])
        new = {p: ids for p, ids in parts.items() if len(p) <= SHORT and p not in memo} | {words[i]: out[i] for i, own in split if len(words[i]) <= SHORT}
        memo.update(new)
        self.held += ENTRY_BYTES * len(new) + sum(map(len, new.values()))
        if self.held > MEMO_BYTES:
            self.memo, self.older, self.held = {}, memo, 0
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        words, codes, counts = split_words(texts)
        encoded = self._encoded(words)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        vocabulary = np.frombuffer(b"".join(encoded), np.uint32)
        starts = np.cumsum(sizes) - sizes
        per_place = sizes[codes]
        bounds = np.concatenate(([0], np.cumsum(per_place)))
        source = np.repeat(starts[codes] - bounds[:-1], per_place) + np.arange(bounds[-1])
        places = np.concatenate(([0], np.cumsum(counts)))
        return vocabulary[source], np.diff(bounds[places])


_WORD_IDS: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """The worker's tokeniser."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The documents without ``text``, one row per piece: ``piece`` from 0, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32`` over the ids as little-endian 32-bit integers and, if wanted, the ``ids``. ``end`` closes every document."""
    added = [f.name for f in T._parse_datatype_string(PIECE)] + ["ids"] * with_ids
    kept = [c for c in docs.columns if c != "text" and c not in added]
    schema = T.StructType([docs.schema[c] for c in kept] + list(T._parse_datatype_string(PIECE + ", ids array<int>" * with_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_ids(path)
        for batch in (part for whole in batches for part in slices(whole, rows=10_000, size=16 << 20)):
            words, counts = tokens(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(words, ends, end).astype("<u4")
            sizes = counts + 1
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = (np.cumsum(sizes) - sizes)[doc] + start
            crc = np.fromiter((zlib.crc32(ids[lo : lo + n]) for lo, n in zip(at.tolist(), length.tolist())), np.int64, len(doc))
            columns = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate((at, [len(ids)])), pa.int32()), pa.array(ids.astype(np.int32))))
            owner = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(owner) for c in kept] + columns, names=[*kept, *added])

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest first, each to the fullest bin that has room: the bin and the place in it of every item, and the bins' fills."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    open_by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    residuals = 0  # bit r is set if a bin with residual r is open
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = residuals >> size
        if fitting:
            residual = size + (fitting & -fitting).bit_length() - 1
            chosen = open_by_residual[residual].pop()
            if not open_by_residual[residual]:
                residuals ^= 1 << residual
        else:
            residual, chosen = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += size
        left = residual - size
        if left:
            open_by_residual[left].append(chosen)
            residuals |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _placed(items: DataFrame, size: str, capacity: int, level: int, names: tuple[str, str, str]) -> DataFrame:
    """Each task's rows, packed chunk by chunk: adds the sequence, the place in it and, on the first row of a sequence, its fill."""
    kept = [c for c in items.columns if c not in names]
    schema = T.StructType([items.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        made = 0

        def packed(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            whole = pa.Table.from_batches(rows)
            sizes = whole.column(size).to_numpy().astype(np.int64)
            if len(sizes) and not 1 <= sizes.min() <= sizes.max() <= capacity:
                raise ValueError(f"a length is not between 1 and {capacity}")
            bins, offsets, fills = best_fit(sizes, capacity)
            sequence = (level << 56) + (partition << 34) + made + bins
            made += len(fills)
            fill = pa.array(fills[bins], pa.int64(), mask=offsets > 0)
            new = [pa.array(sequence, pa.int64()), pa.array(offsets, pa.int64()), fill]
            yield from pa.Table.from_arrays([*(whole.column(c) for c in kept), *new], names=[*kept, *names]).to_batches(max_chunksize=10_000)

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, CHUNK - n)
                held.append(part)
                at, n = at + part.num_rows, n + part.num_rows
                if n == CHUNK:
                    yield from packed(held)
                    held, n = [], 0
        if n:
            yield from packed(held)

    return items.mapInArrow(run, schema)


def pack(pieces: DataFrame, stage: Stage, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """The pieces, each with the ``sequence_id`` it goes to and its ``offset`` there; offsets of a sequence leave no gap."""
    names = ("sequence_id", "offset", "__fill")
    placed = stage.table(_placed(pieces, length, capacity, 0, names), "placed_0")
    underfull = lambda df: df.where(F.col("__fill") < capacity - capacity // SLACK)
    left, level, moves = underfull(placed).select(F.col("sequence_id").alias("item"), F.col("__fill").alias("size")), 0, []
    while (n := left.count()) > 1:
        level += 1
        nodes = -(-n // NODE)
        dealt = left.repartition(1) if nodes == 1 else left.repartition(nodes, F.xxhash64("item", F.lit(level)))
        moves.append(stage.table(_placed(dealt, "size", capacity, level, ("into", "at", "fill")), f"moved_{level}"))
        heads = moves[-1].where("fill is not null")
        if nodes == 1 or n - heads.count() < LEAST_GAIN * n:
            break
        left = heads.where(F.col("fill") < capacity - capacity // SLACK).select(F.col("into").alias("item"), F.col("fill").alias("size"))
    placed = placed.drop("__fill")
    if not moves:
        return placed
    return _followed(placed, stage.table(reduce(_joined, reversed([m.select("item", "into", "at") for m in moves])), "moved"))


def _joined(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Where the items of a level end, (item, into, at), given where those of the level after it do."""
    on = later.select(F.col("item").alias("into"), F.col("into").alias("__into"), F.col("at").alias("__at"))
    return earlier.join(on, "into", "left").select("item", F.coalesce("__into", "into").alias("into"), (F.col("at") + F.coalesce("__at", F.lit(0))).alias("at"))


def _followed(placed: DataFrame, moved: DataFrame) -> DataFrame:
    on = moved.select(F.col("item").alias("sequence_id"), F.col("into").alias("__into"), F.col("at").alias("__at"))
    rest = [c for c in placed.columns if c not in ("sequence_id", "offset")]
    return placed.join(on, "sequence_id", "left").select(
        *rest, F.coalesce("__into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("__at", F.lit(0))).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that hold their ``ids``: the sequences themselves."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and place of every piece of every document."""
    stage = Stage(spark)
    pieces = stage.table(token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer()), "pieces")
    return pack(pieces, stage).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
