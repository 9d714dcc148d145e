"""Language-model scores: counts and base scores against brute force, proper probabilities, learning."""

import math
from collections import Counter

import numpy as np
from conftest import SF
from text_cases import ODD, fold, odd_documents, table

from kolekta.llm import langmodel as lm


def plain_base(rows, train):
    counts = Counter()
    for _, t in train:
        counts.update([*lm.lower_words((t or "").encode()), b""])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words = [*lm.lower_words((t or "").encode()), b""]
        yield (i, len(words), sum(counts[w] > 0 for w in words), n,
               sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))


def test_query_counts_and_base_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm.query(spark, SF).collect()}
    assert len(got) == len(rows)
    for i, n, known, total, base in plain_base(rows, [r for r in rows if fold(r[0], 7) != 2]):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 7) == 2, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one_and_training_helps(spark):
    texts = [(i, " ".join(["aa bb", "cc dd"][(i + k) % 2] for k in range(60))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.train(docs)
    untrained = lm.train(docs, rounds=0)
    total = 0.0
    words = lm.Words([w.encode() for w, _ in model.frequent])
    numbers, sizes = words.numbers([[b"aa", b"bb"]])
    p = np.exp(lm.log_softmax(model.weights, lm.history(words.past[numbers], sizes)))
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    for c in range(lm.CLASSES):  # within a class: its words and one unknown word
        own = [n for w, n in model.frequent if words.classes[words.rank[w.encode()]] == c]
        share = 1.0 if c < lm.HEADS and own else model.unknown[c] + sum((1 - model.unknown[c]) * n / model.class_total[c] for n in own)
        total += share * p[0, c] if own else p[0, c]
    assert math.isclose(total, 1, rel_tol=1e-4)
    after, before = (sum(r.score for r in lm.score(docs, m).collect()) for m in (model, untrained))
    assert after > 0.7 * before  # scores are negative


def test_rare_words_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 3)
    docs = odd_documents(spark)
    train = [r for r in ODD if r[0] is None or r[0] % 2]
    model = lm.train(docs.where("doc_id is null or doc_id % 2 <> 0"))
    model.frequent = model.frequent[:max(lm.HEADS, 3)]  # the rest is met in the join
    got = sorted((tuple(r)[:4] + (r.base_score, r.score) for r in lm.score(docs, model).collect()), key=str)
    want = sorted(plain_base(ODD, train), key=str)
    assert len(got) == len(want) == 12
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and g[5] < 0
    empty = lm.train(docs.limit(0))
    assert empty.total == 0 and lm.score(docs, empty).count() == 12 and lm.score(docs.limit(0), model).count() == 0


def test_both_words_before_are_seen_together(spark):
    # The third word follows from the two before together (as exclusive-or does) and from neither alone.
    texts = [(i, " ".join(f"{'ab'[x]} {'cd'[y]} {'ef'[x ^ y]}" for k in range(60) for x, y in [((i * 7 + k) % 4 // 2, (i * 5 + k * 3) % 2)]))
             for i in range(60)]
    model = lm.train(spark.createDataFrame(texts, "doc_id long, text string"))
    words = lm.Words([w.encode() for w, _ in model.frequent])
    numbers, sizes = words.numbers([[b"a", b"c", b"e"], [b"a", b"d", b"f"], [b"b", b"c", b"f"], [b"b", b"d", b"e"]])
    bits = len(model.weights).bit_length() - 1
    rows, classes = lm.history(words.past[numbers], sizes, bits), words.classes[numbers]
    p = np.exp(lm.log_softmax(model.weights, rows))[np.arange(len(numbers)), classes]
    assert p[2::4].min() > 0.6
    assert np.allclose(np.log(p), lm.log_chosen(model.weights, rows, classes), atol=1e-4)


def test_histories_tell_all_frequent_words_apart_and_the_table_grows():
    words = lm.Words([b"%d" % i for i in range(lm.FREQUENT)])
    assert len(np.unique(words.past[:lm.FREQUENT])) == lm.FREQUENT
    assert [lm.row_bits(n) for n in (0, 100, 20_000, 65_536, 5_000_000)] == [14, 14, 16, 17, 17]
    rows = lm.history(words.past[np.arange(lm.FREQUENT)], np.array([lm.FREQUENT]), lm.row_bits(lm.FREQUENT))
    assert len(rows) == 3 and rows.max() >= 1 << 16 and len(np.unique(rows[0])) > 0.7 * lm.FREQUENT
