"""String tiling against a plain statement of it; planted passages."""

import random

import numpy as np
from conftest import SF
from text_cases import odd_documents, table

from kolekta.llm import decontaminate as d


def plain_tiling(doc, item, width):
    """Words of item covered: mark the longest unmarked common run, again and again."""
    in_doc, in_item, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = None
        for t in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while (i + n < len(doc) and t + n < len(item) and doc[i + n] == item[t + n]
                       and not in_doc[i + n] and not in_item[t + n]):
                    n += 1
                if n >= width and (best is None or n > best[0]):
                    best = (n, t, i)
        if best is None:
            return covered
        n, t, i = best
        in_doc[i:i + n] = [True] * n
        in_item[t:t + n] = [True] * n
        covered += n


def test_tiling_equals_plain_statement():
    draw = random.Random(2)
    for _ in range(150):
        doc = [draw.randrange(1, 4) for _ in range(draw.randrange(0, 40))]
        item = [draw.randrange(1, 4) for _ in range(draw.randrange(1, 16))]
        if draw.random() < 0.5:
            doc += item[len(item) // 2:] + [9] + item[:len(item) // 2]
        width = 3
        seeds = [(i, t) for i in range(len(doc) - 2) for t in range(len(item) - 2) if doc[i:i + 3] == item[t:t + 3]]
        seeds.append((0, 0)) if len(doc) >= 3 <= len(item) else None  # no seed: the words decide
        assert d.tile(np.array(doc), np.array(item), seeds, width) == plain_tiling(doc, item, width)


def test_karp_rabin_windows():
    ids = np.array([3, 1, 4, 1, 5, 9, 2, 6])
    want = [sum(int(v) * pow(d._BASE, 2 - k) for k, v in enumerate(ids[i:i + 3])) % (1 << 64) for i in range(6)]
    assert d.window_hashes(ids, 3).tolist() == want and len(d.window_hashes(ids, 9)) == 0


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in d.query(spark, SF).collect()}
    items = [(r.item_id, d.plain_words(r.text.encode())) for r in table(spark, SF, "benchmark").collect()]
    grams = {}
    for i, w in items:
        for k in range(len(w) - 4):
            grams.setdefault(tuple(w[k:k + 5]), set()).add(i)
    words = dict(items)
    for r in table(spark, SF, "documents").collect():
        w = d.plain_words(r.text.encode())
        near = set().union(*(grams.get(tuple(w[k:k + 5]), ()) for k in range(len(w) - 4)))
        best = max(((plain_tiling(w, words[i], 5) / len(words[i]), -i) for i in near), default=(0.0, None))
        assert (got[r.doc_id].coverage, got[r.doc_id].item_id) == (best[0], None if best[1] is None else -best[1])
        assert got[r.doc_id].contaminated == (best[0] >= 0.5)
    assert any(r.contaminated for r in got.values())


def test_reordered_and_edited_passages_and_shards(spark):
    item = " ".join(f"w{k}" for k in range(40))
    half = " ".join(f"w{k}" for k in range(20, 40)) + " between " + " ".join(f"w{k}" for k in range(20))
    edited = " ".join("XX" if k in (11, 30) else f"W{k}," for k in range(40))
    docs = spark.createDataFrame([(1, "before " + half), (2, edited), (3, "w1 w2 w3 w4 w9"), (4, "tiny item"), (5, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(8, item), (9, "Tiny item!"), (9, "Tiny item!"), (10, None), (11, ""), (None, item)],
                                  "item_id long, text string")
    want = {1: (8, 1.0, True), 2: (8, 0.95, True), 3: (None, 0.0, False), 4: (9, 1.0, True), 5: (None, 0.0, False)}
    for size in (d.SHARD_BYTES, 20):
        rows = d.with_coverage(docs, bench, "coverage", "item_id", shard_bytes=size).collect()
        assert {r.doc_id: (r.item_id, r.coverage, r.coverage >= d.COVERAGE) for r in rows} == want
    assert {r.doc_id for r in d.keep_clean(docs, bench).collect()} == {3, 5}


def test_odd_rows(spark):
    docs, bench = odd_documents(spark), table(spark, SF, "benchmark")
    kept = d.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 12
    assert d.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert d.contamination(docs.limit(0), bench).count() == 0


def test_a_notice_that_many_items_share_is_not_paired_with_its_places():
    """4,000 items with one notice and a text that repeats it 1,000 times: a second or so, not a minute."""
    import time
    notice = "all of this is shared"
    items = [(i, f"own{i} words{i} here{i} and{i} there{i} more{i} {notice} tail{i}".encode()) for i in range(4000)]
    tests = d.Tests(items)
    start = time.perf_counter()
    got = tests.covered([(f"{notice} " * 1000).encode(), items[17][1], b"nothing"])
    assert got == [(5 / 12, 0), (1.0, 17), (0.0, None)] and time.perf_counter() - start < 5


def test_the_best_item_equals_tiling_every_item():
    draw = random.Random(7)
    words = [f"w{k}" for k in range(6)]
    for _ in range(60):
        items = [(draw.randrange(50), " ".join(draw.choice(words) for _ in range(draw.randrange(1, 14)))) for _ in range(12)]
        items = sorted({i: t for i, t in items}.items())
        texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(0, 50))) for _ in range(4)] + [items[0][1]]
        got = d.Tests([(i, t.encode()) for i, t in items], 3).covered([t.encode() for t in texts])
        for text, found in zip(texts, got):
            doc = text.split()
            covers = [(-plain_tiling(doc, t.split(), min(3, len(t.split()))) / len(t.split()), i) for i, t in items]
            best = min(c for c in [*covers, (0.0, None)] if c[0] < 0 or c[1] is None) if any(c[0] < 0 for c in covers) else (0.0, None)
            assert found == (-best[0], best[1])
