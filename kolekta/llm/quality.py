"""Quality: perplexity under an interpolated modified Kneser-Ney n-gram model
of trusted text, thresholded by language-specific quantiles.

The units are those of a reduced alphabet: letters in lower case, one unit
for any capital, digit or symbol class, four for the bytes of other letters,
and one for a word that repeats the word before it (so repetition has a
price). With it a model of order n has at most 40**n n-grams, whatever the
input, which bounds the count tables.

The query and the pipeline price every text by words too (``wordmodel``), whose n-grams
have no such bound: there the documents meet the counts in sharded joins. In the
pipeline a document stays if both models keep it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kolekta.llm import wordmodel
from kolekta.llm.common import byte_texts, fold, fresh, read_table, stored, with_text_columns

UNITS = 40
ORDER = 4
_REPEAT = b"\x01"
#: A document is rejected above this quantile of trusted documents of its language, plus the margin (log10 a unit).
QUANTILE, MARGIN = 0.999, 0.05
#: Units at the mean price added to each document, so that short texts vary less.
PRIOR_UNITS = 50
#: The same for the model of words.
PRIOR_WORDS = 10
#: The words' model leaves out the trusted rows whose crc32(doc_id as text) is divisible by this; they give its thresholds.
WORD_FOLDS = 5
#: Least probability of a unit; a training text so small that nothing is discounted leaves none to unseen ones.
LEAST_P = 1e-12
#: Trusted documents that a language needs for its own threshold.
LEAST_TRUSTED = 50
#: Trusted ids that tasks hold at once (8 bytes each).
BROADCAST_IDS = 1_000_000


def _unit_table() -> bytes:
    t = bytearray([33] * 256)
    for c in range(256):
        if c >= 0xC0:
            t[c] = 34
        elif c >= 0x80:
            t[c] = 35 + (c >> 4 & 3)
        elif chr(c).islower():
            t[c] = 2 + c - ord("a")
        elif chr(c).isupper():
            t[c] = 28
        elif chr(c).isdigit():
            t[c] = 29
    for chars, unit in ((b" ", 0), (b".", 30), (b",", 31), (b";:'\"()-", 32), (_REPEAT, 39)):
        for c in chars:
            t[c] = unit
    return bytes(t)


UNIT_OF = _unit_table()


def units(text: bytes):
    """Units of a text, runs of white space being one space."""
    import operator

    import numpy as np
    w = text.replace(_REPEAT, b" ").split()
    if any(map(operator.eq, w, w[1:])):
        w[1:] = [_REPEAT if a == b else b for a, b in zip(w, w[1:])]
    return np.frombuffer(b" ".join(w).replace(b" " + _REPEAT, _REPEAT).translate(UNIT_OF), np.uint8)


def ngram_keys(u, order: int = ORDER):
    """The n-gram ending at each unit, as a number in base UNITS; spaces stand before the text."""
    import numpy as np
    p = np.concatenate([np.zeros(order - 1, np.uint8), u]).astype(np.int64)
    k = p[:len(u)]
    for j in range(1, order):
        k = k * UNITS + p[j:j + len(u)]
    return k


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, c): how often each n-gram occurs in ``texts(text)``; each task sums its own first."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        total = np.zeros(UNITS ** order, np.int64)
        for b in batches:
            for t in byte_texts(b.column(0)):
                keys, n = np.unique(ngram_keys(units(t), order), return_counts=True)
                total[keys] += n
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["key", "c"])

    return texts.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    return discounts(counts.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first())


def discounts(n) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(max(0.0, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.0), float(k)) for k in (1, 2, 3)]


def kneser_ney(counts: DataFrame, order: int = ORDER):
    """(seen, back): DataFrames of the interpolated modified Kneser-Ney model.

    ``seen(n, key, p)``: the probability of each n-gram seen, of every order
    n; ``back(n, context, g)``: the weight that its context leaves to the
    next lower order. The lower orders count distinct left neighbours. Count
    tables are dealt by n-gram or context key and joined by it.
    """
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = (tables[n + 1].groupBy((F.col("key") % UNITS ** n).alias("key"))
                     .agg(F.count("*").alias("c")))
    seen, back, lower = [], [], None
    for n in range(1, order + 1):
        d = _discounts(tables[n])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = tables[n].select("key", "c", off.alias("d"), F.floor(F.col("key") / UNITS).alias("context"))
        ctx = t.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("g"))
        p = t.join(ctx, "context").select("key", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "g")
        if lower is None:
            p = p.select("key", (F.col("own") + F.col("g") / UNITS).alias("p"))
        else:
            p = (p.withColumn("suffix", F.col("key") % UNITS ** (n - 1))
                 .join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix")
                 .select("key", (F.col("own") + F.col("g") * F.col("q")).alias("p")))
        lower = stored(p, f"order{n}")
        seen.append(lower.select(F.lit(n).alias("n"), "key", "p"))
        back.append(ctx.select(F.lit(n).alias("n"), "context", "g"))
    return reduce(DataFrame.unionByName, seen), stored(reduce(DataFrame.unionByName, back), "back")


def log_table(seen: DataFrame, back: DataFrame, order: int = ORDER):
    """log10 probability of every n-gram of the order as one array of
    UNITS**order numbers (10 MB at order 4): the seen ones as they are, the
    others by the weights of their contexts. Empty counts give a uniform model."""
    import numpy as np
    ps, gs = seen.toPandas(), back.toPandas()
    p = np.full(1, 1 / UNITS)
    for n in range(1, order + 1):
        g = np.ones(UNITS ** (n - 1))
        own = gs[gs.n == n]
        g[own.context.to_numpy(np.int64)] = own.g.to_numpy(float)
        p = np.repeat(g, UNITS) * np.tile(p, UNITS)
        own = ps[ps.n == n]
        p[own.key.to_numpy(np.int64)] = own.p.to_numpy(float)
    return np.log10(np.maximum(p, LEAST_P)).astype(np.float32)


class Model:
    """The n-gram table and the mean price of a unit of trusted text."""

    def __init__(self, table, order: int = ORDER, mean: float = 0.0):
        self.table, self.order, self.mean = table, order, mean

    def price(self, text: bytes) -> tuple[float, int]:
        """(-log10 of the text's probability, its units)."""
        u = units(text)
        return (-float(self.table[ngram_keys(u, self.order)].sum(dtype="float64")) if len(u) else 0.0), len(u)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels are all of quality 1; null ids and labels take no part."""
    return (labels.where("doc_id is not null and quality is not null")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("least"))
            .where("least = 1").select("doc_id"))


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, lang, text)`` whose ids are trusted, written once for counting and for the thresholds.

    Up to BROADCAST_IDS ids are broadcast, so that texts stay where they are; more meet them in a join by id."""
    ids = stored(trusted_ids(labels), "trusted_ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stored(docs.join(ids, "doc_id", "left_semi"), "trusted")


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """The model of all texts of ``trusted``; tasks count their own first, so at most UNITS**order counts leave each."""
    counts = stored(count_ngrams(trusted, order), "ngrams")
    model = Model(log_table(*kneser_ney(counts, order), order), order)
    prices = counts.select("key", "c").toPandas()
    n = int(prices.c.sum())
    model.mean = float(-(model.table[prices.key.to_numpy("int64")] * prices.c.to_numpy("float64")).sum() / n) if n else 0.0
    return model


def with_score(docs: DataFrame, model: Model, name: str = "log_perplexity", own: str | None = None) -> DataFrame:
    """``docs`` with ``name``, the score of its texts, and ``own``, log10 of the model's own perplexity (not shrunk)."""
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.order, model.mean))

    def compute(texts):
        import numpy as np
        m = Model(*held.value)
        total, n = np.array([m.price(t) for t in texts], float).reshape(-1, 2).T
        scores = [(total + PRIOR_UNITS * m.mean) / (n + PRIOR_UNITS)]
        return scores + ([np.where(n > 0, total / np.maximum(n, 1), m.mean)] if own else [])

    return with_text_columns(docs, {name: "double"} | ({own: "double"} if own else {}), compute)


def thresholds(scores: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, threshold) from the scores of all trusted rows, ``scores(lang, log_perplexity)``.

    The quantile of each language is read off a histogram in steps of
    0.001, so it is exact to that step and no value list is gathered. The
    row of null language holds that of all trusted rows, for languages
    with fewer than LEAST_TRUSTED of them.
    """
    step = 0.001
    bins = stored(scores.groupBy("lang", F.ceil(F.col("log_perplexity") / step).alias("bin"))
                  .agg(F.count("*").alias("n")), "perplexities")
    every = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n")
    bins = bins.where("lang is not null").unionByName(every)
    w = Window.partitionBy("lang")
    reached = bins.select("lang", "bin", F.sum("n").over(w.orderBy("bin")).alias("below"), F.sum("n").over(w).alias("all"))
    return (reached.where((F.col("below") >= quantile * F.col("all"))
                          & (F.col("lang").isNull() | (F.col("all") >= LEAST_TRUSTED)))
            .groupBy("lang").agg((F.min("bin") * step + margin).alias("threshold")))


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return trusted_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), labels)


def _with_limit(scored: DataFrame, scores: DataFrame, limit: str) -> DataFrame:
    """``scored`` with ``limit``, the threshold of its language or that of all, from ``scores`` of trusted rows."""
    limits = stored(thresholds(scores), "thresholds")
    key = fresh(scored.columns, "of_lang")
    of_lang = limits.where("lang is not null").select(F.col("lang").alias(key), F.col("threshold").alias(limit))
    found = limits.where("lang is null").first()  # one number
    fallback = F.lit(found["threshold"] if found else float("inf"))
    return (scored.join(of_lang, F.col("lang") == F.col(key), "left").drop(key)
            .withColumn(limit, F.coalesce(F.col(limit), fallback)))


def _judged(docs: DataFrame, trusted: DataFrame, own: str | None = None) -> tuple[DataFrame, str, str]:
    """docs with score and threshold columns (and ``own``, see ``with_score``), and the names of the two."""
    model = train(trusted)
    name, limit = fresh(docs.columns, "log_perplexity"), fresh(docs.columns, "threshold")
    scores = with_score(trusted, model).select("lang", "log_perplexity")
    return _with_limit(with_score(docs, model, name, own), scores, limit), name, limit


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge_words``, keep being the decision of the pipeline: a document stays if the characters and the words keep it."""
    return judge_words(docs, labels).withColumn("keep", F.col("keep") & F.col("word_keep"))


def _decided(docs: DataFrame, trusted: DataFrame, *more: str) -> DataFrame:
    """(doc_id, lang, perplexity, judged, threshold, keep, ``more``) of every row by characters.

    perplexity is the model's own; judged, which the threshold is compared
    with, is drawn towards the mean of trusted text for short texts. A text of null or no words has that
    mean. Languages without enough trusted documents, null too, take the
    threshold of all; without trusted documents everything is kept.
    """
    rows, score, limit = _judged(docs, trusted, "own")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.pow(F.lit(10.0), "own").alias("perplexity"),
                       F.pow(F.lit(10.0), score).alias("judged"), F.pow(F.lit(10.0), limit).alias("threshold"),
                       (F.col(score) <= F.col(limit)).alias("keep"), *more)


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _word_scores(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((text_hash, log_perplexity, own) of each text of ``docs(text_hash, text)`` by words, (lang, log_perplexity) that give thresholds).

    Words price the texts that taught them far below others, so a fifth of the trusted rows (see WORD_FOLDS) is not
    counted and gives mean and thresholds; without any such row those counted do."""
    held = fold(F.col("doc_id"), WORD_FOLDS) == 0
    prices = wordmodel.log_prices(docs, trusted.where(~held))
    known = trusted.select("lang", _text_hash().alias("text_hash"), held.alias("held"))
    known = stored(known.join(prices, "text_hash"), "word_trusted")
    if not known.where("held").isEmpty():
        known = known.where("held")
    price, n = known.agg(F.sum("price"), F.sum("n_units")).first()
    mean = price / n if n else 0.0
    score = ((F.col("price") + PRIOR_WORDS * mean) / (F.col("n_units") + PRIOR_WORDS)).alias("log_perplexity")
    own = F.when(F.col("n_units") > 0, F.col("price") / F.col("n_units")).otherwise(mean)
    return prices.select("text_hash", score, own.alias("own")), known.select("lang", score)


def judge_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The decision by characters (see ``_decided``) and the same by words: word_perplexity, word_judged, word_threshold
    and word_keep. keep is that of the characters alone."""
    docs = docs.select("doc_id", "text", "lang", _text_hash().alias("text_hash"))
    trusted = _trusted(docs, labels)
    scores, known = _word_scores(docs, trusted)
    rows = _with_limit(_decided(docs, trusted, "text_hash").join(scores, "text_hash", "left"), known, "limit")
    return rows.select(*(c for c in rows.columns if c not in ("text_hash", "log_perplexity", "own", "limit")),
                       F.pow(F.lit(10.0), "own").alias("word_perplexity"),
                       F.pow(F.lit(10.0), "log_perplexity").alias("word_judged"),
                       F.pow(F.lit(10.0), "limit").alias("word_threshold"),
                       (F.col("log_perplexity") <= F.col("limit")).alias("word_keep"))


def keep_fluent(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns."""
    trusted = _trusted(docs, labels)
    by_text = docs.select(_text_hash().alias("text_hash"), "text")
    scores, known = _word_scores(by_text, trusted)
    rows, score, limit = _judged(docs, trusted)
    rows = rows.where(F.col(score) <= F.col(limit)).select(*docs.columns)
    # texts of those kept by characters meet their scores by words
    key, by_words = fresh(docs.columns, "text_hash"), fresh(docs.columns, "log_perplexity")
    limit = fresh([*docs.columns, by_words], "threshold")
    scores = scores.select(F.col("text_hash").alias(key), F.col("log_perplexity").alias(by_words))
    rows = _with_limit(rows.withColumn(key, _text_hash()).join(scores, key), known, limit)
    return rows.where(F.col(by_words) <= F.col(limit)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: perplexity, threshold and decision of every document, by characters and by words."""
    return judge_words(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
