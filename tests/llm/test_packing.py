import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm.packing import best_fit, default_tokenizer, op11_best_fit_packing, pack, sequences, token_pieces

from .helpers import LONG, corpus

ODD = [None, "", " \n\t ", "don't STOP  we'll go", "<|endoftext|>a <|startoftext|>", "é é ́x", "日本語の文　テスト", "12345 ½ ② a_b--c", "İstanbul ΣΑΣ Σ", "x" * 5000, "👍🏽 naïve​word", "\x85\x1c\x1d end", "a\ue000b \ue000 c \ue000\ue000", "\u0301 \u0301a e \u0301", "(Abc), \"ÉT\" $$x## don't. 's' a'b; --A- x\u0301. ,\u0301a é\u0301,"]


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return [e.ids + [1] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def whole(rows, capacity):
    """Every sequence is filled from 0 without a gap and holds no more than it may."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_ids_and_pieces_are_the_library_s(spark, stage):
    rng = random.Random(3)
    letters = "abcXYZ éß'’.,-_0123 \n\t  　日ΣΩ"
    texts = [*ODD, LONG, *("".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300))]
    docs = corpus(spark, list(enumerate(texts)))
    rows = token_pieces(docs, default_tokenizer(), 64, with_ids=True).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(found[r.doc_id]) == 64 * r.piece and r.length == len(r.ids) <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        found[r.doc_id] += r.ids
    assert [found[i] for i in range(len(texts))] == library_ids(texts)


def test_sequences_hold_every_piece(spark, stage):
    texts = [None, "", "a b c", LONG, "a b c", "one two three four five six seven"] * 3
    pieces = token_pieces(corpus(spark, list(enumerate(texts))), default_tokenizer(), 128, with_ids=True)
    rows = pack(stage.table(pieces, "pieces"), stage, 128)
    placed = rows.collect()
    whole(placed, 128)
    made = {r.sequence_id: r.ids for r in sequences(rows).collect()}
    back = defaultdict(list)
    for r in sorted(placed, key=lambda r: (r.doc_id, r.piece)):
        assert made[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        back[r.doc_id] += r.ids
    assert [back[i] for i in range(len(texts))] == library_ids(texts)


def plain_best_fit(sizes, capacity):
    """Search of all open bins for the fullest that has room."""
    fills = []
    for size in sorted(sizes, reverse=True):
        fitting = [i for i, f in enumerate(fills) if f + size <= capacity]
        if fitting:
            fills[max(fitting, key=lambda i: fills[i])] += size
        else:
            fills.append(size)
    return sorted(fills)


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_best_fit_against_plain_search(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 5, 300):
        sizes = rng.integers(1, capacity + 1, n)
        bins, offsets, fills = best_fit(sizes, capacity)
        assert sorted(fills.tolist()) == plain_best_fit(sizes.tolist(), capacity)
        assert np.array_equal(np.bincount(bins, sizes, len(fills)).astype(int), fills) and (offsets < capacity).all()


def test_levels_merge_what_partitions_leave(spark, stage, monkeypatch):
    """Many partitions with few rows each: their underfull sequences meet, over several levels."""
    monkeypatch.setattr("edgeloom.llm.packing.NODE", 20)
    items = spark.range(3000, numPartitions=60).select("id", (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"), F.lit("x").alias("offset"), F.lit(1).alias("into"), F.lit(2).alias("item"))
    rows = pack(stage.table(items, "items"), stage, 100).collect()
    total = sum(r.length for r in rows)
    assert len(rows) == 3000 and rows[0].into == 1 and rows[0].item == 2
    assert whole(rows, 100) <= 1.03 * -(-total // 100)


def test_residuals_too_small_for_any_of_the_rest(spark, stage, monkeypatch):
    monkeypatch.setattr("edgeloom.llm.packing.NODE", 20)
    items = spark.range(500, numPartitions=8).select("id", F.lit(60).cast("long").alias("length"))
    rows = pack(stage.table(items, "items"), stage, 100).collect()
    assert whole(rows, 100) == 500


def test_a_length_out_of_range_is_refused(spark, stage):
    with pytest.raises(Exception, match="not between"):
        pack(spark.range(1).withColumn("length", F.lit(101)), stage, 100)


def test_empty_table_and_clashing_columns(spark, stage):
    assert pack(token_pieces(corpus(spark, []), default_tokenizer()), stage).count() == 0
    docs = corpus(spark, [(1, "a"), (None, None)]).selectExpr("*", "'x' AS piece", "1 AS sequence_id", "2 AS __fill", "3 AS at")
    rows = pack(token_pieces(docs, default_tokenizer()), stage.__class__(spark)).collect()
    assert sorted((r.piece, r.length, r["at"]) for r in rows) == [(0, 1, 3), (0, 2, 3)]


def test_query_fills_sequences(spark):
    rows = op11_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert whole(rows, 4096) == -(-sum(r.length for r in rows) // 4096)
