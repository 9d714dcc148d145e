"""Kneser-Ney against a plain statement of it; thresholds and decisions."""

import math
from collections import Counter

import numpy as np
from conftest import SF
from text_cases import odd_documents, table

from kolekta.llm import quality
from kolekta.llm.quality import UNITS


def plain_kneser_ney(texts, order):
    """{n-gram tuple: probability} function by the textbook recursion."""
    counts = {order: Counter()}
    for t in texts:
        u = [0] * (order - 1) + quality.units(t).tolist()
        for i in range(order - 1, len(u)):
            counts[order][tuple(u[i - order + 1:i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(k[1:] for k in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        discount[n] = [0] + [min(max(0, k - (k + 1) * y * m[k + 1] / m[k]) if m[k] else 0, k) for k in (1, 2, 3)]
    totals, left = {}, {}
    for n, c in counts.items():
        totals[n], left[n] = Counter(), Counter()
        for k, v in c.items():
            totals[n][k[:-1]] += v
            left[n][k[:-1]] += discount[n][min(v, 3)]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / UNITS
        total = totals[n][gram[:-1]]
        if not total:
            return p(gram[1:])
        c = counts[n][gram]
        return max(c - discount[n][min(c, 3)], 0) / total + left[n][gram[:-1]] / total * p(gram[1:])

    return p


def test_model_equals_textbook_and_sums_to_one(spark):
    texts = ["the cat sat on the mat.", "The cat, the cat ate 42 rats!", "a dog", "", "zz zz zz top"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = quality.count_ngrams(docs, 3)
    table3 = quality.log_table(*quality.kneser_ney(counts, 3), 3)
    p = plain_kneser_ney([t.encode() for t in texts], 3)
    assert np.allclose((10.0 ** table3.astype(float)).reshape(-1, UNITS).sum(1), 1, atol=1e-4)
    rng = np.random.default_rng(1)
    for key in [*rng.integers(0, UNITS ** 3, 300).tolist(), *(r.key for r in counts.collect())]:
        gram = (key // UNITS ** 2, key // UNITS % UNITS, key % UNITS)
        assert math.isclose(10 ** float(table3[key]), p(gram), rel_tol=1e-4)


def test_units():
    assert quality.units(b"") .tolist() == []
    assert quality.units(b"ab A9.\n\x01 x").tolist() == [2, 3, 0, 28, 29, 30, 0, 25]
    assert quality.units(b"go go go").tolist() == [8, 16, 39, 39]


def test_rejects_low_quality_and_keeps_trusted(spark):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    labels = [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect() if r.quality is not None]
    assert len(got) == table(spark, SF, "documents").count()
    good, bad = ([got[i].keep for i, q in labels if q == k] for k in (1, 0))
    assert sum(good) / len(good) > 0.99 and 1 - sum(bad) / len(bad) > 0.95


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == 12 and all(r.perplexity > 0 for r in rows)
    kept = quality.keep_fluent(docs, labels)
    assert kept.columns == docs.columns and {1, 2, 3, 4} <= {r.doc_id for r in kept.collect()}
    assert quality.keep_fluent(docs, labels.limit(0)).count() == 12
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_query_equals_brute_force(spark):
    """Perplexity, the score that is judged, the thresholds and the decision, from plain counting over all trusted texts."""
    docs = {r.doc_id: r for r in table(spark, SF, "documents").select("doc_id", "lang", "text").collect()}
    labels = {}
    for r in table(spark, SF, "labels").collect():
        labels.setdefault(r.doc_id, []).append(r.quality)
    trusted = [i for i, q in labels.items() if i in docs and min(q) == 1]
    order = quality.ORDER
    p, memo = plain_kneser_ney([docs[i].text.encode() for i in trusted], order), {}

    def price(text):
        u = [0] * (order - 1) + quality.units(text.encode()).tolist()
        total = 0.0
        for k in range(order - 1, len(u)):
            gram = tuple(u[k - order + 1:k + 1])
            if gram not in memo:
                memo[gram] = -math.log10(max(p(gram), quality.LEAST_P))
            total += memo[gram]
        return total, len(u) - order + 1

    prices = {i: price(r.text) for i, r in docs.items()}
    mean = sum(prices[i][0] for i in trusted) / sum(prices[i][1] for i in trusted)
    judged = {i: (t + quality.PRIOR_UNITS * mean) / (n + quality.PRIOR_UNITS) for i, (t, n) in prices.items()}

    def limit(ids):
        values = sorted(judged[i] for i in ids)
        return math.ceil(values[math.ceil(quality.QUANTILE * len(values)) - 1] / 0.001) * 0.001 + quality.MARGIN

    of_lang = {}
    for i in trusted:
        of_lang.setdefault(docs[i].lang, []).append(i)
    limits = {k: limit(v if len(v) >= quality.LEAST_TRUSTED else trusted) for k, v in of_lang.items()}
    for r in quality.query(spark, SF).collect():
        want = limits.get(r.lang, limit(trusted))
        assert math.isclose(math.log10(r.perplexity), prices[r.doc_id][0] / prices[r.doc_id][1], rel_tol=1e-4)
        assert math.isclose(math.log10(r.judged), judged[r.doc_id], rel_tol=1e-4)
        assert abs(math.log10(r.threshold) - want) < 0.0015
        assert r.keep == (judged[r.doc_id] <= want) or abs(judged[r.doc_id] - want) < 0.0015


def test_pipeline_goes_by_words_too(spark):
    """Words in an order never seen, which characters cannot tell (all words begin and end alike), do not stay."""
    rng = np.random.default_rng(3)
    words = ["a" + "".join(rng.choice(list("bcdefghij"), 5)) + "aa" for _ in range(50)]
    rows = [(i, "en", " ".join(words[(i * 7 + k) % 50] for k in range(60))) for i in range(100)]
    rows.append((1000, "en", " ".join(words[-k % 50] for k in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    by = {r.doc_id: r for r in quality.judge_words(docs, labels).collect()}
    assert by[1000].keep and not by[1000].word_keep and all(by[i].keep and by[i].word_keep for i in range(100))
    kept = quality.keep_fluent(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(100))
    assert {r.doc_id for r in quality.judge(docs, labels).where("keep").collect()} == set(range(100))
