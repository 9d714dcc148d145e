"""The model of words against a plain statement of Kneser-Ney; what the query makes of its prices."""

import math
from collections import Counter

from conftest import SF
from text_cases import fold, odd_documents, table

from kolekta.llm import quality, wordmodel


def plain_price(trained):
    """The price of a text by the textbook recursion over words."""
    def sequence(text):
        w = (text or "").encode().lower().split()
        return [b"\1", b"\1", *w, b"\2"] if w else []

    counts = {3: Counter()}
    for t in trained:
        s = sequence(t)
        counts[3].update(zip(s, s[1:], s[2:]))
    for n in (2, 1):
        counts[n] = Counter(k[1:] for k in counts[n + 1])
    discount, totals, left = {}, {}, {}
    for n, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        discount[n] = [0] + [min(max(0, k - (k + 1) * y * m[k + 1] / m[k]) if m[k] else 0, k) for k in (1, 2, 3)]
        totals[n], left[n] = Counter(), Counter()
        for k, v in c.items():
            totals[n][k[:-1]] += v
            left[n][k[:-1]] += discount[n][min(v, 3)]

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        total = totals[n][gram[:-1]]
        if not total:
            return p(gram[1:])
        c = counts[n][gram]
        return (max(c - discount[n][min(c, 3)], 0) / total
                + max(left[n][gram[:-1]] / total, wordmodel.LEAST_LEFT) * p(gram[1:]))

    def price(text):
        s = sequence(text)
        return -sum(math.log10(p(g)) for g in zip(s, s[1:], s[2:])), max(len(s) - 2, 0)

    return price


def priced(spark, texts, trained):
    """{text: (price, units)} by the sharded joins."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr(
        "*", "xxhash64(coalesce(text, '')) as text_hash")
    rows = wordmodel.log_prices(docs, spark.createDataFrame([(t,) for t in trained], "text string"))
    return {r.text: (r.price, r.n_units) for r in docs.select("text", "text_hash").distinct().join(rows, "text_hash").collect()}


def test_prices_equal_the_textbook(spark):
    trained = ["the cat sat on the mat", "The cat, the cat ate the rat the rat", "a dog a dog a dog", "", None, "é É the cat"]
    texts = [*trained, "the cat", "the cat", "unheard words only", "a dog sat on the mat the cat", " \t\x0b ", "the " * 3000]
    price = plain_price(trained)
    got = priced(spark, texts, trained)
    assert set(got) == set(texts)
    for t in texts:
        assert got[t][1] == price(t)[1] and math.isclose(got[t][0], price(t)[0], rel_tol=1e-9, abs_tol=1e-9)


def test_frequent_ngrams_are_dealt_by_block(spark):
    texts = [f"the cat {i} sat" for i in range(400)] + ["the cat sat on the mat"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("*", "xxhash64(text) as text_hash")
    frequent, more = wordmodel.frequent_keys(docs, 8)
    assert frequent and 0 < more <= 8
    trained = ["the cat sat", "the cat sat on a mat", "the dog 7 sat"]
    price, got = plain_price(trained), priced(spark, texts, trained)
    assert all(math.isclose(got[t][0], price(t)[0], rel_tol=1e-9) for t in texts)


def test_nothing_trained_is_uniform(spark):
    assert set(priced(spark, ["a b", ""], []).values()) == {(0.0, 3), (0.0, 0)}
    assert priced(spark, [], ["a b"]) == {}


def test_tells_word_order_apart(spark):
    """The characters see one word's border at a time, the words' model the order of words."""
    straight, mixed, other = "big red dogs run home at night", "red night dogs home at big run", "small dogs run away at noon"
    trained = [straight, straight, other]
    got = priced(spark, [straight, mixed], trained)
    assert got[straight][0] + 2 < got[mixed][0]


def test_query_equals_brute_force_by_words(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang", "text").collect()
    labels = {}
    for r in table(spark, SF, "labels").collect():
        labels.setdefault(r.doc_id, []).append(r.quality)
    trusted = [r for r in docs if r.doc_id in labels and min(labels[r.doc_id]) == 1]
    price = plain_price([r.text for r in trusted if fold(r.doc_id, quality.WORD_FOLDS)])
    trusted = [r for r in trusted if not fold(r.doc_id, quality.WORD_FOLDS)]
    prices = {r.doc_id: price(r.text) for r in docs}
    mean = sum(prices[r.doc_id][0] for r in trusted) / sum(prices[r.doc_id][1] for r in trusted)
    judged = {i: (t + quality.PRIOR_WORDS * mean) / (n + quality.PRIOR_WORDS) for i, (t, n) in prices.items()}

    def limit(rows):
        values = sorted(judged[r.doc_id] for r in rows)
        return math.ceil(values[math.ceil(quality.QUANTILE * len(values)) - 1] / 0.001) * 0.001 + quality.MARGIN

    of_lang = {}
    for r in trusted:
        of_lang.setdefault(r.lang, []).append(r)
    limits = {k: limit(v if len(v) >= quality.LEAST_TRUSTED else trusted) for k, v in of_lang.items()}
    got = quality.query(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = limits.get(r.lang, limit(trusted))
        assert math.isclose(math.log10(r.word_perplexity), prices[r.doc_id][0] / prices[r.doc_id][1], rel_tol=1e-9)
        assert math.isclose(math.log10(r.word_judged), judged[r.doc_id], rel_tol=1e-9)
        assert abs(math.log10(r.word_threshold) - want) < 0.0015
        assert r.word_keep == (judged[r.doc_id] <= want) or abs(judged[r.doc_id] - want) < 0.0015


def test_odd_rows_by_words(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge_words(docs, labels).collect()
    assert len(rows) == 12 and all(r.word_perplexity > 0 for r in rows)
    assert {1, 2, 3, 4} <= {r.doc_id for r in rows if r.word_keep}
    assert all(r.word_keep for r in quality.judge_words(docs, labels.limit(0)).collect())
    assert quality.judge_words(docs.limit(0), labels).count() == 0


def test_rounds_equal_the_textbook(spark):
    """Whatever the number of rounds the prices are the same; a pair is asked for in the rounds of both its words."""
    trained = ["the cat sat on the mat", "The cat, the cat ate the rat the rat", "a dog a dog a dog", "", None, "é É the cat"]
    texts = [*trained, "the cat", "unheard words only", "a dog sat on the mat the cat", " \t\x0b ", "the " * 3000]
    price = plain_price(trained)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("*", "xxhash64(coalesce(text, '')) as text_hash")
    rows = wordmodel.log_prices(docs, spark.createDataFrame([(t,) for t in trained], "text string"), rounds=4)
    got = {r.text: (r.price, r.n_units) for r in docs.distinct().join(rows, "text_hash").collect()}
    assert set(got) == set(texts)
    assert all(got[t][1] == price(t)[1] and math.isclose(got[t][0], price(t)[0], rel_tol=1e-9, abs_tol=1e-9) for t in texts)
    assert [wordmodel.rounds_of(n) for n in (0, 8 << 20, 9 << 20, 1 << 40)] == [1, 1, 2, wordmodel.ROUNDS]


def test_a_round_asks_for_its_part(spark):
    """All rounds together ask for each word and trigram once and for a pair once or twice; stores leave the session's settings as they were."""
    from kolekta.llm.common import Stored
    s, at = wordmodel.sequences([b"a b c d e f g h", b"", b"b a"], wordmodel.word_hashes())
    whole = Counter(wordmodel.asked_keys(s, at)[0].tolist())
    parts = sum((Counter(wordmodel.asked_keys(s, at, r, 4)[0].tolist()) for r in range(4)), Counter())
    assert set(parts) == set(whole) and all(whole[k] <= n <= 2 * whole[k] for k, n in parts.items())
    assert all(len(wordmodel.asked_keys(s, at, r, 4)[0]) < sum(whole.values()) for r in range(4))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    assert Stored(spark.range(100).groupBy("id").count(), "clean", clean=True).df.count() == 100 and spark.conf.get(key) == before
