"""Toxicity: FTRL against a plain statement of it, held-out accuracy, edge rows."""

import math

import numpy as np
from text_cases import fold, odd_documents, table

from kolekta.llm import toxicity


def plain_ftrl(rows, bits, epochs, alpha, beta, l1, l2):
    z, n = {}, {}
    bias = 1 << bits

    def weight(i):
        strength = 0.0 if i == bias else l1
        zi = z.get(i, 0.0)
        if abs(zi) <= strength:
            return 0.0
        return -(zi - math.copysign(strength, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for y, idx in rows:
            idx = [*idx, bias]
            w = {i: weight(i) for i in idx}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in idx:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_ftrl_equals_plain_statement():
    rng = np.random.default_rng(3)
    rows = [(int(y), np.unique(rng.integers(0, 64, 9))) for y in rng.integers(0, 2, 80)]
    bias, index, value = toxicity.ftrl(rows, 6, 2, 0.5, 1.0, 0.4, 0.1)
    want = plain_ftrl([(y, i.tolist()) for y, i in rows], 6, 2, 0.5, 1.0, 0.4, 0.1)
    assert math.isclose(bias, want.pop(64))
    assert index.tolist() == sorted(want) and np.allclose(value, [want[i] for i in sorted(want)])
    assert len(want) < 64  # L1 leaves some at zero


def test_features_are_words_pairs_and_skips():
    doc, index = toxicity.features([b"A b, c", b"", b"a b c"])
    a, c = (sorted(index[doc == k].tolist()) for k in (0, 2))
    assert a == c and len(a) == 6 and not (doc == 1).any()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    assert len(got) == table(spark, sf, "documents").count()
    assert all(r.held_out == (fold(i, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.toxic, got[r.doc_id]) for r in table(spark, sf, "labels").collect() if r.toxic is not None and fold(r.doc_id, 4) == 2]
    hits = sum(y == p.predicted for y, p in held)
    caught = [p.predicted for y, p in held if y]
    assert hits / len(held) > 0.95 and sum(caught) / len(caught) > 0.75


def test_odd_rows_and_no_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0, 0), (6, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    w = toxicity.train(docs, labels)
    rows = toxicity.with_score(docs.select("doc_id", "text"), w).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    none = toxicity.train(docs, labels.limit(0))
    assert none.bias is None and {r.score for r in toxicity.with_score(docs.select("doc_id", "text"), none).collect()} == {0.0}
    kept = toxicity.keep_civil(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 12
    assert toxicity.with_score(docs.limit(0), none, "score_").count() == 0
