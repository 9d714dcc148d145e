"""SimHash against brute force: fingerprints, links, components, deduplication."""

import random

import pytest
import xxhash
from conftest import SF
from text_cases import ODD, odd_documents, table

from kolekta.llm import simhash
from kolekta.llm.components import components


def plain_fingerprint(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace(
            "\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        words += [w] if w else []
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, bits):
    """{fingerprint: root} by comparing all with all."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {f: find(f) for f in fps}


def plain_groups(rows, bits=2):
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_components([f for _, f in fp], bits)
    least = {}
    for i, f in fp:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return [(i, f"{f:016x}", least.get(roots[f])) for i, f in fp]


def test_query_equals_brute_force(spark):
    got = sorted(tuple(r) for r in simhash.query(spark, SF).collect())
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = sorted(plain_groups(rows))
    assert got == want
    assert any(i != c for i, _, c in want)


def test_odd_rows(spark):
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id)
           for r in simhash.simhash_groups(odd_documents(spark)).collect()]
    key = str
    assert sorted(got, key=key) == sorted(plain_groups(ODD), key=key)
    assert simhash.simhash_groups(odd_documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("tile_rows, visitor_rows", [(4096, 16384), (3, 4)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, tile_rows, visitor_rows):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile_rows)
    monkeypatch.setattr(simhash, "VISITOR_ROWS", visitor_rows)
    draw = random.Random(5)
    fps = [draw.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1, 3, 7]
    for f in list(fps[:12]):  # chains and clusters about some of them
        for _ in range(15):
            f ^= 1 << draw.randrange(64)
            fps.append(f)
            fps.append(f ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2).collect()
    got = {r.u: r.root for r in components(spark.createDataFrame(found or [], "u long, v long")).collect()}
    want = plain_components(fps, 2)
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(want[f], set()).add(s)
    back = {}
    for s in signed:
        back.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, back.values()))


def test_components_of_chain_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = odd_documents(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    firsts = {c for i, _, c in plain_groups(ODD) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(firsts) and ids.count(None) == 1


def test_repeated_ids_of_unlike_texts_lose_nothing(spark):
    t, u, v, w = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white pink",
                  "up down left right in out")
    near = t.replace("alpha beta", "Alpha Beta")
    cases = [
        ([(1, t), (5, t), (5, u), (7, v)], [(1, t), (5, u), (7, v)]),
        ([(5, t), (5, u), (5, u), (9, u), (9, w)], [(5, t), (5, u), (9, w)]),
        ([(3, near), (3, t), (2, v), (2, v), (None, t), (None, t)], [(2, v), (3, near), (None, t), (None, t)]),
    ]
    for rows, want in cases:
        docs = spark.createDataFrame([(i, x, "a", "b", "c") for i, x in rows],
                                     "doc_id long, text string, fp string, kept_id string, place string").repartition(3)
        got = simhash.deduplicate(docs)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
