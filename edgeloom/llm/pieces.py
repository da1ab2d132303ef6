"""SentencePiece encoding and decoding that keeps the place of every piece in the original text.

A text is normalised by taking, at each position, the longest prefix that the model's compiled character map (a double-array
trie with a pool of replacements) holds; every byte written is recorded with the byte it came from. Pieces are formed on the
normalised text by pair merging, and their bounds are projected through that record to byte spans of the original.
Pieces never cross certain boundaries (before a word's space mark, say, if no piece of the vocabulary does), so merging
runs once per distinct short segment; a memo bounded in bytes holds the pieces of segments already met by the worker.

The model file is a parameter. It is read on the driver; executors get its parsed tables (its size bounds the broadcast).
Supported are BPE models with spaces as prefixes and without user-defined or unused pieces; others raise ValueError.

Defined results: a null text counts as empty, and an empty text encodes to the begin and end ids alone. Texts are
encoded whole. Columns named as an output are replaced; others pass through. Repeated rows are encoded each for itself.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bytes in a generation of a worker's memo of segments; two are held.
MEMO_BYTES = 56 << 20
#: What an entry of the memo takes besides the bytes of its key and value.
ENTRY_BYTES = 200
#: Segments up to this length are merged by plain search, longer ones with a queue.
SHORT = 40
NEVER = float("-inf")
UNKNOWN_SURFACE = " ⁇ "


class CharacterMap:
    """Longest-prefix lookup in a compiled character map."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]
        self.memo: dict[int, str] = {}

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that starts at a byte, and the key's length."""
        units, found = self.units, None
        node = self._children(units[0])
        for length, byte in enumerate(data[at:at + 512], 1):
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            has_value = units[node] >> 8 & 1
            node ^= self._children(units[node])
            if has_value:
                found = units[node] & 0x7FFFFFFF, length
        if found is None:
            return None
        start = found[0]
        return self.pool[start : self.pool.index(b"\0", start)], found[1]

    @staticmethod
    def _children(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool
    byte_fallback: bool
    begin: int
    end: int
    unknown: int

    @classmethod
    def read(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with space prefixes and without user-defined or unused pieces are supported")
        norm, spec = model.normalizer_spec, model.trainer_spec
        return cls(
            tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), tuple(p.type for p in model.pieces),
            norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces, spec.byte_fallback, spec.bos_id, spec.eos_id, spec.unk_id,
        )


class Normaliser:
    """Text to normalised bytes, with the original byte at which each of them starts (and the end, last)."""

    def __init__(self, model: PieceModel):
        self.map = CharacterMap(model.charsmap) if model.charsmap else None
        self.dummy, self.trim = model.dummy_prefix, model.trim_spaces
        self.space = SPACE.encode() if model.escape_spaces else b" "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode("utf-8", "replace")
        if not data:
            return b"", np.zeros(1, np.int32)
        return self._plain(data) if self.map is None and not self.trim else self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        lead = self.space if self.dummy else b""
        widths = np.where(np.frombuffer(data, np.uint8) == 32, len(self.space), 1)
        starts = np.repeat(np.arange(len(data), dtype=np.int32), widths)
        return lead + data.replace(b" ", self.space), np.concatenate((np.zeros(len(lead), np.int32), starts, np.array([len(data)], np.int32)))

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(data, at) if self.map else None
        if found:
            return found
        first = data[at]
        width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return data[at : at + width], width

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, starts, at = bytearray(), [], 0
        while self.trim and at < len(data):
            written, width = self._prefix(data, at)
            if written != b" ":
                break
            at += width
        if at == len(data):
            return b"", np.array([at], np.int32)
        if self.dummy:
            out += self.space
            starts += [at] * len(self.space)
        after_space = self.trim
        while at < len(data):
            written, width = self._prefix(data, at)
            if after_space:
                written = written.lstrip(b" ")
            if written:
                escaped = written.replace(b" ", self.space)
                out += escaped
                starts += [at] * len(escaped)
                after_space = self.trim and written.endswith(b" ")
            at += width
        while self.trim and out.endswith(self.space):
            at = starts[len(out) - len(self.space)]
            del out[-len(self.space):], starts[-len(self.space):]
        return bytes(out), np.array([*starts, at], np.int32)


class PieceCodec:
    """Encodes and decodes one text at a time; made once per Python worker."""

    def __init__(self, model: PieceModel):
        self.model, self.normalise = model, Normaliser(model)
        self.ids = {p: i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds)) if kind == NORMAL}
        self.scores = {p: model.scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds)) if kind == BYTE}
        self.surface = [self._surface(p, kind) for p, kind in zip(model.pieces, model.kinds)]
        self.segments = re.compile(self._boundaries())
        self.memo = _Memo(self._encode_segment)

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return (UNKNOWN_SURFACE if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def _boundaries(self) -> str:
        """A pattern whose matches no piece of the vocabulary can cross."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return r"(?s).+"
        if any("\n" in p for p in self.ids if len(p) > 1):
            return rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"

    def _merge(self, segment: str) -> list[str]:
        parts, score = list(segment), self.scores.get
        if len(parts) > SHORT:
            return self._merge_long(parts)
        gains = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) != NEVER:
            i = gains.index(best)
            merged = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + merged, NEVER)
            if i < len(gains):
                gains[i] = score(merged + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges in n log n: best pair first, leftmost among equals; entries of changed parts are skipped."""
        n, score, queue = len(parts), self.scores.get, []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (s := score(parts[left] + parts[right])) is not None:
                heapq.heappush(queue, (-s, left, right, len(parts[left]), len(parts[right])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, left_size, right_size = heapq.heappop(queue)
            if len(parts[left]) != left_size or len(parts[right]) != right_size or after[left] != right:
                continue
            parts[left] += parts[right]
            parts[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def _encode_segment(self, segment: str) -> bytes:
        """(id, normalised bytes) of each piece, as pairs of 32-bit integers."""
        found = []
        for part in self._merge(segment):
            known = self.ids.get(part)
            raw = part.encode()
            if known is not None:
                found += (known, len(raw))
            elif self.model.byte_fallback:
                for byte in raw:
                    found += (self.byte_ids[byte], 1)
            else:
                found += (self.model.unknown, len(raw))
        return np.array(found, "<u4").tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end ids around them; for each, its byte span in the original text."""
        normal, starts = self.normalise(text)
        pairs = np.frombuffer(b"".join(map(self.memo.__getitem__, self.segments.findall(normal.decode()))), "<u4").reshape(-1, 2)
        ids, bounds = pairs[:, 0], np.concatenate(([0], np.cumsum(pairs[:, 1], dtype=np.int64)))
        first, last = bounds[:-1], bounds[1:]
        if not self.model.byte_fallback and len(ids):  # a run of unknown pieces is one
            heads = np.flatnonzero(~((ids == self.model.unknown) & (np.concatenate(([-1], ids[:-1].astype(np.int64))) == self.model.unknown)))
            ids, first, last = ids[heads], first[heads], np.concatenate((first[heads][1:], last[-1:]))
        size = starts[-1:]
        return (
            np.concatenate(([self.model.begin], ids, [self.model.end])).astype("<u4"),
            np.concatenate(([0], starts[first], size)).astype(np.int32),
            np.concatenate(([0], starts[last], size)).astype(np.int32),
        )

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are no UTF-8 become U+FFFD each."""
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        if self.model.dummy_prefix or self.model.trim_spaces:
            lead = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
            if lead is not None and self.model.pieces[lead].startswith(SPACE):
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", data.decode("utf-8", "surrogateescape"))


class _Memo(dict):
    """Values by key, those of short keys kept up to ``MEMO_BYTES``. When full, it becomes the older generation, from which keys that are met again are taken over."""

    def __init__(self, make):
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        if len(key) > SHORT:
            return self.make(key)
        if self.held >= MEMO_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.held += ENTRY_BYTES + 2 * len(key) + len(value)
        return value


_CODECS: dict[int, PieceCodec] = {}


def _codec(model) -> PieceCodec:
    """The worker's codec of a broadcast model."""
    key = model.value.__hash__()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model.value)
    return _CODECS[key]


#: Output columns: what each is made of, from ids, spans and the function that decodes.
OUTPUTS = {
    "n_tokens": (T.LongType(), lambda ids, begins, ends, decoded: len(ids)),
    "ids": (T.ArrayType(T.IntegerType()), lambda ids, begins, ends, decoded: ids.astype(np.int32)),
    "begins": (T.ArrayType(T.IntegerType()), lambda ids, begins, ends, decoded: begins),
    "ends": (T.ArrayType(T.IntegerType()), lambda ids, begins, ends, decoded: ends),
    "decoded": (T.StringType(), lambda ids, begins, ends, decoded: decoded),
    "ids_sha256": (T.StringType(), lambda ids, begins, ends, decoded: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": (T.StringType(), lambda ids, begins, ends, decoded: hashlib.sha256(decoded.encode()).hexdigest()),
    "covered": (T.LongType(), lambda ids, begins, ends, decoded: int(np.maximum(ends[1:-1] - np.maximum.accumulate(np.concatenate(([0], ends[1:-2]))), 0).sum()) if len(ids) > 2 else 0),
}


def encode_documents(docs: DataFrame, model_path: str, outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """The documents without ``text``, with the chosen outputs (keys of ``OUTPUTS``).

    ``covered`` counts the bytes of the original text that the pieces' spans cover.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.read(model_path))
    kept = [c for c in docs.columns if c != "text" and c not in outputs]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, OUTPUTS[name][0]) for name in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in (part for whole in batches for part in slices(whole)):
            made: list[list] = [[] for _ in outputs]
            for value in batch.column("text"):
                ids, begins, ends = codec.encode(value.as_py() or "")
                decoded = codec.decode(ids.tolist())
                for name, into in zip(outputs, made):
                    into.append(OUTPUTS[name][1](ids, begins, ends, decoded))
            types = [pa.list_(pa.int32()) if isinstance(OUTPUTS[n][0], T.ArrayType) else pa.int64() if isinstance(OUTPUTS[n][0], T.LongType) else pa.string() for n in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(made, types)], names=[*kept, *outputs])

    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, default_model(), ("n_tokens", "ids_sha256", "decoded_sha256", "covered"))
