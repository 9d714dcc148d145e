"""SentencePiece encoding against the library, and spans against the text."""

import hashlib

import numpy as np
import sentencepiece
from conftest import SF
from text_cases import ODD, odd_documents, table

from kolekta.llm import pieces

STRANGE = ["", " ", "  hello   world ", "ﬁne ① Ａ　Ｂ", "é ½ ㌔ Ⅷ ｶﾞ", "a\tb\r\nc", "​zero﻿width", "nul\x00nul",
           "👩‍👩‍👧 日本語 ▁ x", "…  ..", "á̧ x", " 　 lead", "trail 　", "İstanbul ß", "<s> </s> <unk> <0x41>", "y" * 3000]


def with_normaliser(rule, **flags):
    """The default model with another normaliser."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags).serialized_model_proto()
    spec = next(v for n, v, _ in pieces._fields(proto) if n == 3)
    rest = b"".join(raw for n, _, raw in pieces._fields(pieces.default_model()) if n != 3)
    return rest + bytes([26]) + pieces._varint(len(spec)) + spec


def check(model, texts):
    codec, library = pieces.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t, (ids, begins, ends) in zip(texts, codec.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert codec.decode([ids.tolist()])[0] == library.decode(ids.tolist())
        n = len(t.encode())
        assert (begins <= ends).all() and (begins[1:] >= begins[:-1]).all() and 0 <= begins[0] and ends[-1] <= n
        yield t, ids, begins, ends, library


def test_default_model_spans_cover_the_text():
    for t, ids, begins, ends, _ in check(pieces.default_model(), STRANGE + [t or "" for _, t in ODD]):
        assert b"".join(t.encode()[a:b] for a, b in zip(begins, ends)) == t.encode()


def test_compiled_character_maps():
    for rule in ("nmt_nfkc", "nfkc_cf"):
        for flags in ({"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True},
                      {"add_dummy_prefix": False, "remove_extra_whitespaces": False, "escape_whitespaces": True}):
            for t, ids, begins, ends, library in check(with_normaliser(rule, **flags), STRANGE):
                for i, a, b in zip(ids.tolist(), begins, ends):  # a plain piece stands in the text as it is
                    word = library.id_to_piece(i).replace("▁", " ")
                    if word.isascii() and word.isalpha() and word.islower() and t.isascii():
                        assert word in t.encode()[a:b].decode().lower()


def test_general_normaliser_equals_fast_path():
    codec = pieces.Codec(pieces.default_model())
    for t in STRANGE:
        (a, x), (b, y) = codec.normalise(t.encode()), codec._normalise(t.encode())
        assert a == b and len(x) == len(a) + 1 and (x[-1] == y[-1]) and (np.diff(x) >= 0).all()


def test_query_equals_library(spark):
    import public_tokenizers
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in pieces.query(spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = pieces.encode(docs).collect()
    assert len(rows) == 12 and set(docs.columns) < set(rows[0].asDict())
    for r in rows:
        assert r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends) and r.decoded == (r.text or "").replace("▁", " ")
    assert pieces.encode(docs.limit(0)).count() == 0


def test_new_columns_keep_off_taken_names(spark):
    docs = spark.createDataFrame([(1, "some words", "mine", 7)], "doc_id long, text string, ids string, N_tokens int")
    rows = pieces.encode(docs)
    assert rows.columns == [*docs.columns, "n_tokens_", "ids_", "begins", "ends", "decoded"]
    r = rows.first()
    assert (r.ids, r["N_tokens"], r.decoded) == ("mine", 7, "some words") and r.n_tokens_ == len(r.ids_) > 2
