"""Phrase collocations against SQL on the documents and plain counting on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from oracle_compare import compare, duck
from text_cases import odd_documents

from kolekta.llm import phrases


def plain(rows, max_words=3, least=10, top=2000, percent=50):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i:i + m]) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    often = {p: f for p, f in counts.items() if len(p) > 2 and f >= least}
    out = []
    for p, a in often.items():
        lang, w = p[0], p[1:]
        if any(100 * f >= percent * a and len(q) > len(p) and q[0] == lang
               and any(q[i:i + len(w)] == w for i in range(1, len(q) - len(w) + 1)) for q, f in often.items()):
            continue
        score, k = min((1000000 * a * a // (counts[p[:k + 1]] * counts[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), counts[p[:k + 1]], counts[(lang, *w[k:])]))
    out.sort()
    rank, rows = Counter(), []
    for lang, score, a, phrase, l_, r in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, l_, r, totals[lang], -score))
    return rows


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'x' as phrase", "1 as a", "2 as block")
    return sorted(map(tuple, phrases.collocations(df.repartition(6), **how).collect()))


def texts(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a\x1cb", "é", "ÉT", "日本", "don't", "x|y"] + [f"w{i}" for i in range(25)]
    return [(draw.choice(["en", "fr", None, "und", "a b", ""]),
             "".join(draw.choice(words[:draw.choice([4, 9, 34])]) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "\x0b"])
                     for _ in range(draw.randrange(60)))) for _ in range(n)]


def test_query_equals_sql(spark):
    r = compare(spark, duck(SF), SF, "op12", phrases.query, phrases.SQL)
    assert r["status"] == "ok" and r["rows"] > 1000, r


@pytest.mark.parametrize("small", [False, True])
def test_awkward_texts(spark, monkeypatch, small):
    """With small tiles, blocks and buckets every path runs: dense and sparse tiles, several rounds of merging."""
    if small:
        for name, value in (("TILE", 4), ("DENSE", 3), ("FAN_IN", 2), ("BUCKET_CODES", 50), ("BLOCK_TOKENS", 160), ("CHUNK_TOKENS", 50),
                            ("COUNT_CODES", 100), ("HELD_CODES", 40)):
            monkeypatch.setattr(phrases, name, value)
    rows = texts(1, 150) + [("en", None), (None, ""), ("en", " .\t"), ("en", "long run " * 400)]
    assert got(spark, rows) == sorted(plain(rows))


def test_limits_ties_and_longer_phrases(spark):
    rows = texts(2, 60) + texts(2, 60)
    assert got(spark, rows, max_words=5, least=4, top=7) == sorted(plain(rows, 5, 4, 7))
    assert got(spark, rows, max_words=2) == sorted(plain(rows, 2))


def test_empty_and_odd_documents(spark):
    docs = odd_documents(spark)
    assert phrases.collocations(docs.limit(0)).count() == 0
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == sorted(plain(rows))


def test_tiles_count_exactly(monkeypatch):
    monkeypatch.setattr(phrases, "TILE", 8)
    monkeypatch.setattr(phrases, "DENSE", 6)
    draw = np.random.default_rng(3)
    codes = (draw.zipf(1.3, 5000) % 900).astype(np.int64) << 32 | (draw.zipf(1.3, 5000) % 900).astype(np.int64)
    times = draw.integers(1, 5, 5000)
    want = Counter()
    for c, n in zip(codes.tolist(), times.tolist()):
        want[c] += n
    found = phrases.merge_codes(codes, times)
    assert dict(zip(*(x.tolist() for x in found))) == want and (np.diff(found[0]) > 0).all()
    alone = phrases.merge_codes(codes)
    assert dict(zip(*(x.tolist() for x in alone))) == Counter(codes.tolist())
    assert [len(x) for x in phrases.merge_codes(codes[:0])] == [0, 0]
