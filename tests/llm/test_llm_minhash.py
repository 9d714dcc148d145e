"""Circulant MinHash against SQL over all pairs and brute force on awkward rows."""

import random

import numpy as np
import pytest
from conftest import SF
from oracle_compare import compare, duck
from text_cases import ODD, odd_documents

from kolekta.llm import minhash


def plain_set(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c
                                for c in text or "").split(" ") if w]
    return {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_groups(rows, percent=85):
    """[(doc_id, size, component)] by comparing all with all."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(str, map(tuple, minhash.minhash_groups(df).collect())))


def test_query_equals_sql(spark):
    r = compare(spark, duck(SF), SF, "op11", minhash.query, minhash.SQL)
    assert r["status"] == "ok", r


def test_odd_rows(spark):
    odd = odd_documents(spark)
    found = sorted(str(tuple(r)) for r in minhash.minhash_groups(odd).collect())
    assert found == sorted(map(str, plain_groups(ODD)))
    assert minhash.minhash_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1 << 20, 200])
def test_near_copies_chains_and_repeated_ids(spark, monkeypatch, tile):
    """Groups of near copies about the threshold, with tiles whole and cut into many groups."""
    monkeypatch.setattr(minhash, "TILE_SHINGLES", tile)
    draw, rows = random.Random(3), []
    for g in range(5):
        base = [f"w{draw.randrange(5000)}" for _ in range(60)]
        for _ in range(25):
            words = list(base)
            for _ in range(draw.randrange(6)):
                words[draw.randrange(60)] = f"x{draw.randrange(5000)}"
            rows.append((draw.randrange(90), " ".join(words)))  # ids repeat with other texts
            if draw.random() < 0.3:
                base = words
    assert got(spark, rows) == sorted(map(str, plain_groups(rows)))


def test_ids_that_many_texts_share(spark):
    """One id, and null, with many texts: every text meets its own set."""
    draw = random.Random(4)
    base = [[f"w{draw.randrange(900)}" for _ in range(40)] for _ in range(20)]
    rows = [(i, " ".join([*b[:39], f"x{k}"])) for b in base for k in range(3) for i in (7, None, 7)]
    assert got(spark, rows) == sorted(map(str, plain_groups(rows)))


def test_signature_estimates_the_similarity():
    draw = np.random.default_rng(1)
    shared = draw.integers(0, 1 << 63, 800, np.uint64)
    a, b = (np.unique(np.concatenate([shared, draw.integers(0, 1 << 63, 100, np.uint64)])) for _ in range(2))
    equal = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(equal - 0.8) < 0.04
    assert np.array_equal(minhash.signature(a, 2000), minhash.signature(a[::-1].copy(), 2000))


def test_tile_links_what_reaches_the_threshold():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 8, 16, 60)]  # neighbours: 92 of 108
    found = minhash.link_sets(sets, [], np.arange(4), 85)
    assert sorted(map(tuple, map(sorted, found))) == [(0, 1), (1, 2)]
    assert minhash.link_sets(sets, [], np.array([0, 0, 0, 3]), 85) == []
