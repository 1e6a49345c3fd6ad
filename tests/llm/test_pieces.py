import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as protobuf

from dbgauge.llm.pieces import MODEL, Encoder, decode_ids, encode_texts, load_model, op13_sentencepiece

PATH = public_tokenizers.path(MODEL)
PARTS = [*"ab  \n\té日▁ﬁ①Ａ　x.\x00\U0001f600ｶﾞ́Å", "<s>", "</s>", "<unk>", "<0x41>", "the ", " of", "Straße", "​", "﻿", "한국"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(count, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(25))) for _ in range(count)]


def changed(**spec):
    """The public model with other rules of normalisation."""
    proto = protobuf.ModelProto()
    proto.ParseFromString(load_model(PATH))
    rule = spec.pop("rule", None)
    if rule:
        compiled = protobuf.ModelProto()
        compiled.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = compiled.normalizer_spec.precompiled_charsmap
    if spec.pop("behind", False):
        proto.trainer_spec.treat_whitespace_as_suffix = True
    for piece in spec.pop("user_defined", []):
        at = next(p for p in proto.pieces if p.piece == piece)
        at.type = 4
    for name, value in spec.items():
        setattr(proto.normalizer_spec, name, value)
    return proto.SerializeToString()


VARIANTS = [
    {},
    {"rule": "nmt_nfkc", "remove_extra_whitespaces": True},
    {"rule": "nmt_nfkc_cf", "remove_extra_whitespaces": False},
    {"rule": "nfkc", "remove_extra_whitespaces": True, "add_dummy_prefix": False},
    {"rule": "nfkc", "remove_extra_whitespaces": True, "behind": True},
    {"remove_extra_whitespaces": True, "escape_whitespaces": False},
    {"rule": "nmt_nfkc", "remove_extra_whitespaces": True, "user_defined": ["the", "Str", "日"]},
]


@pytest.mark.parametrize("variant", VARIANTS, ids=str)
def test_ids_and_alignment_equal_the_library(variant):
    model = changed(**dict(variant))
    encoder, library = Encoder(model), SentencePieceProcessor(model_proto=model)
    for text in [*texts(1500), "", " ", "   ", "a", " a ", "\n", "é" * 5000, "a b" * 5000]:
        ids, edges = encoder.encode(text)
        ids = ids.tolist()
        assert ids == library.encode(text) + [library.eos_id()], text
        assert encoder.decode(ids) == library.decode(ids)
        assert len(edges) == len(ids) + 1 and (edges[1:] >= edges[:-1]).all() and edges[-1] <= len(text.encode())
        normal, offsets = library.normalize(text, with_offsets=True)
        aligned = encoder.normalise(text)
        assert aligned.text.decode() == normal, text
        if "user_defined" not in variant:  # the library has the place of the whole piece for each of its bytes
            assert [len(text.encode()[:place].decode()) for place in _starts(aligned)] == list(offsets), text


def _starts(aligned):
    """The source of the first byte of each code point, and that of the end."""
    return [s for b, s in zip(aligned.text, aligned.source.tolist()) if b & 0xC0 != 0x80] + aligned.source[-1:].tolist()


def test_spans_are_the_bytes_of_the_pieces():
    encoder = Encoder(load_model(PATH))
    for text in texts(500, 2):
        raw = text.encode()
        ids, edges = encoder.encode(text)
        spans = [raw[a:b] for a, b in zip(edges, edges[1:])]
        assert b"".join(spans) == raw and spans[-1] == b""
        for id_, span in zip(ids[1:].tolist(), spans[1:]):
            piece = encoder.decoder.id_to_piece(id_)
            if encoder.decoder.is_byte(id_):
                assert span == bytes([int(piece[3:5], 16)])
            elif not encoder.decoder.is_control(id_) and "▁".encode() not in span:
                assert span.decode() == piece.replace("▁", " ")


SCHEMA = "doc_id bigint, text string, ids int, edges string, extra string"
ROWS = [(1, "Hello  world"), (2, None), (3, ""), (4, "日本\x00語"), (5, "word " * 100_000), (None, "x"), (1, "Hello  world")]


def test_edges(spark):
    library = SentencePieceProcessor(model_file=PATH)
    documents = spark.createDataFrame([(*r, 1, "old", "kept") for r in ROWS], SCHEMA)
    made = decode_ids(encode_texts(documents, PATH), PATH).collect()
    got = sorted(((str(r.doc_id), list(r.ids), r.decoded, r.extra) for r in made), key=str)
    assert got == sorted([(str(i), library.encode(t or "") + [2], library.decode(library.encode(t or "") + [2]), "kept") for i, t in ROWS], key=str)
    assert next(list(r.edges) for r in made if r.doc_id == 2) == [0, 0]
    assert encode_texts(documents.limit(0), PATH).count() == 0
    lists = spark.createDataFrame([(1, [3, 400, 2]), (2, None), (3, []), (4, [2])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode_ids(lists, PATH).collect()} == {1: library.decode([3, 400, 2]), 2: "", 3: "", 4: ""}
    with pytest.raises(FileNotFoundError):
        encode_texts(documents, "/no/such/model")


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    library = SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in docs:
        ids = library.encode(text or "") + [library.eos_id()]
        want[doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op13_sentencepiece(spark, sf).collect()}
    assert got == want and len(got) == len(docs)
