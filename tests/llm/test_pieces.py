import dataclasses
import random

import pytest

from edgeloom.llm.pieces import PieceCodec, PieceModel, Normaliser, default_model, encode_documents

from .helpers import LONG, corpus

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return PieceModel.read(default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def texts(alphabet, n, seed=1, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_ids_spans_and_round_trip(model, library):
    codec = PieceCodec(model)
    cases = texts("ab  \n▁é漢😀<s>0x.\t\r\x00 ‍", 1500) + texts("the ingon.\n", 300, longest=300) + ["", " ", "▁", "</s>", "a" * 500, "ab" * 400, LONG]
    for text in cases:
        ids, begins, ends = codec.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text[:50]
        assert codec.decode(ids.tolist()) == library.decode(ids.tolist())
        data = text.encode()
        # Spans run through the text without gaps; a piece's bytes are those of its span, once spaces are marks.
        assert begins[0] == 0 and ends[-1] == len(data)
        for i, (piece, lo, hi) in enumerate(zip(ids.tolist()[1:-1], begins[1:-1].tolist(), ends[1:-1].tolist())):
            if model.kinds[piece] == 1:
                surface = model.pieces[piece].encode()
                span = data[lo:hi].replace(b" ", "▁".encode())
                assert surface == span or (i == 0 and surface == "▁".encode() + span)


def test_decode_of_any_ids(model, library):
    codec, rng = PieceCodec(model), random.Random(3)
    for _ in range(1500):
        ids = [rng.choice((rng.randrange(300), rng.randrange(32000))) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("dummy,trim", [(True, True), (False, False), (True, False), (False, True)])
def test_normalisation_by_a_compiled_map(model, dummy, trim):
    from sentencepiece import sentencepiece_model_pb2 as proto

    theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=trim)
    spec = proto.ModelProto()
    spec.ParseFromString(theirs.serialized_model_proto())
    ours = Normaliser(dataclasses.replace(model, charsmap=spec.normalizer_spec.precompiled_charsmap, dummy_prefix=dummy, trim_spaces=trim))
    for text in texts("aB  \n▁éÉ漢ｶﾞ😀ﬁ①㌔\t　㍿ﷺİﬃ éÅ", 1500, seed=2):
        normal, starts = ours(text)
        want, offsets = theirs.normalize(text, with_offsets=True)
        assert normal.decode() == want and len(starts) == len(normal) + 1
        heads = [i for i, b in enumerate(normal) if b & 0xC0 != 0x80]
        assert [len(text.encode()[: starts[i]].decode()) for i in heads] == list(offsets)[: len(heads)]


def test_documents(spark, library):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "x"), (1, "Hello  world\n"), (4, LONG)]
    docs = corpus(spark, rows).selectExpr("*", "'old' AS ids", "5 AS begin")
    got = encode_documents(docs, default_model()).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids), r.decoded, r.begin) for r in got) == sorted((i or -1, tuple(library.encode(t or "", add_bos=True, add_eos=True)), t or "", 5) for i, t in rows)
    assert encode_documents(corpus(spark, []), default_model()).count() == 0
