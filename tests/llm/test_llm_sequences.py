"""Sequence files: contents against the library, random access, edge rows."""

import zlib

import numpy as np
from conftest import SF
from text_cases import ODD, odd_documents, table
from tokenizers import Tokenizer

from kolekta.llm import sequences


def library_rows(rows):
    """(doc_id, start, n_tokens, crc32) by encoding whole texts in order."""
    tokenizer, start = Tokenizer.from_str(sequences.default_tokenizer()), 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        yield i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        start += len(ids)


def test_query_equals_library(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in sequences.query(spark, SF).collect())
    assert got == [r[:4] for r in library_rows(rows)]


def test_odd_rows_and_random_access(spark, scratch, monkeypatch):
    monkeypatch.setattr(sequences, "REMEMBERED", 20)
    docs, folder = odd_documents(spark).repartition(3), f"{scratch}/seq"
    manifest = sequences.write_sequences(docs, folder, length=16, shard_bytes=2000)
    assert manifest.count() > 3
    got = [tuple(r) for r in sequences.read_documents(manifest, folder).collect()]
    want = list(library_rows(ODD))
    assert sorted(got, key=lambda r: r[1]) == [r[:4] for r in want]
    stream = [i for *_, ids in want for i in ids]
    for r in manifest.collect():
        shard = sequences.ShardReader(folder, r.shard)
        own = stream[r.start:r.start + r.n_tokens]
        assert shard.tokens(0, r.n_tokens).tolist() == own
        for row in (0, 3, (r.n_tokens - 1) // 16):
            tokens, mask = shard.sequence(min(row, (r.n_tokens - 1) // 16))
            at = min(row, (r.n_tokens - 1) // 16) * 16
            assert len(tokens) == len(mask) == 16 and tokens[mask].tolist() == own[at:at + 16]
            assert not tokens.flags.owndata and not mask.flags.owndata  # views of the file
    again = sequences.write_sequences(docs, folder, length=16, shard_bytes=2000)  # a second run puts the same files there
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))


def test_empty_table(spark, scratch):
    manifest = sequences.write_sequences(odd_documents(spark).limit(0), f"{scratch}/none")
    assert manifest.count() == 0 and sequences.read_documents(manifest, f"{scratch}/none").count() == 0


def test_words_with_capitals_and_marks_have_the_ids_of_the_library():
    tokenizer, codec = Tokenizer.from_str(sequences.default_tokenizer()), sequences.WordCodec(sequences.default_tokenizer())
    texts = ["Word word, WORD. word. wOrD! don't DON'T. a,b c; <|ENDOFTEXT|> X<|endoftext|>. 's 'S, J\u030cx Stra\u00dfe. 12. 1, .. , A.", "", "word;"]
    ids, sizes = codec.encode([t.encode() for t in texts])
    assert ids.tolist() == [i for t in texts for i in tokenizer.encode(t, add_special_tokens=False).ids]
    assert sizes.sum() == len(ids) and sizes[1] == 0 and b"word" in codec.place and codec.tails


def test_words_of_letters_reach_the_model_alone(monkeypatch):
    tokenizer, codec = Tokenizer.from_str(sequences.default_tokenizer()), sequences.WordCodec(sequences.default_tokenizer())
    encoded, encode = [], codec._encode
    monkeypatch.setattr(codec, "_encode", lambda words: (encoded.extend(words), encode(words)))
    texts = ["blesh### THBLEND,!! \u00f6tzen, en\u00dfachge. \u00c4RGER", "\u00c0\u00de\u00df\u00ff!? blesh"]
    odd = ["J\u030cx blesh### a\u00d7b a\u00f7. caf\u00e9's it's, it'S! (x) x\u0301, \u00e9\u0301. \u0130X <|endoftext|>, <|EndOfText|>, a<|endoftext|>b",
           "\u00aa\u00ba. a\u00a0b \u0085c a\u200bb \u03a3\u03a3. o\u0308. A\u030a, a,,,,b ,,,, x,,,, y-- z... it'd;;"]
    for part, known in ((texts, True), (odd, False)):
        ids, sizes = codec.encode([t.encode() for t in part])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
        assert not known or sorted(encoded) == [b"!?", b"###", b",", b",!!", b"."]


def test_tokenizers_that_keep_white_space_are_refused():
    import public_tokenizers
    import pytest
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="white space"):
        sequences.WordCodec(f.read())


def test_shards_of_keys():
    firsts = np.array([sequences.LEAST, 3, 3, 3, 9]), np.array([5, 1, 4, 8, 0])
    ids = np.array([sequences.LEAST, 2, 3, 3, 3, 3, 3, 9, 10])
    hashes = np.array([5, 9, 0, 1, 5, 8, 9, -1, 0])
    keys = sorted(zip(*firsts))
    want = [max(0, sum(k <= x for k in keys) - 1) for x in zip(ids.tolist(), hashes.tolist())]
    assert sequences.shard_of(ids, hashes, *firsts).tolist() == want
