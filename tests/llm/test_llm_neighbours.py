"""Nearest neighbours: recall, exact scores, copies and ties against brute force."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F
from text_cases import table

from kolekta.llm import neighbours


def brute(rows, is_query, k=5):
    """{query: [(vec_id, score)]} over valid rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in np.flatnonzero([is_query(i) for i in ids]):
        cos = (x * x[q]).sum(1) / (norm * norm[q])
        order = [j for j in np.lexsort((ids, -np.round(cos, 12))) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(cos[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_query_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    want, got = brute(rows, lambda i: i % 50 == 0), answers(neighbours.query(spark, SF))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {q: dict(brute(rows, lambda i: i == q, len(rows))[q]) for q in list(got)[:4]}
    assert all(abs(s - exact[q][i]) < 1e-12 for q in exact for i, s in got[q])


def test_recall_of_a_larger_graph_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 700)
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 24))
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(neighbours.nearest(df, F.col("vec_id") % 50 == 0)), brute(rows, lambda i: i % 50 == 0)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_copies_ties_and_invalid_rows(spark):
    base = [[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, -2.0]]
    rows = [(i, base[0]) for i in range(30, 60)] + [(7, base[1]), (100, base[2]), (3, base[3]), (50, base[0]), (200, base[2])]
    bad = [(None, base[0]), (300, None), (350, []), (400, [0.0, 0.0, 0.0]), (450, [1.0, None, 0.0]),
           (500, [float("nan"), 1.0, 0.0]), (550, [float("inf"), 1.0, 0.0]), (600, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "r") for i, v in rows + bad], "vec_id long, embedding array<double>, rank string")
    got = answers(neighbours.nearest(df, F.col("vec_id") % 50 == 0))
    want = brute(sorted({(i, tuple(v)) for i, v in rows}), lambda i: i % 50 == 0)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert [i for i, _ in got[50]] == [30, 31, 32, 33, 34]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(50, [1.0, 2.0])], schema)
    two = spark.createDataFrame([(50, [1.0, 2.0]), (51, [2.0, 1.0])], schema)
    every = F.col("vec_id") % 50 == 0
    assert neighbours.nearest(one.limit(0), every).count() == 0 and neighbours.nearest(one, every).count() == 0
    assert answers(neighbours.nearest(two, every)) == {50: [(51, 0.7999999999999998)]} or len(answers(neighbours.nearest(two, every))[50]) == 1
