"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and
skip-grams."""

from __future__ import annotations

from dataclasses import astuple, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kolekta.llm.common import fold, fresh, plain_words, read_table, sample_ids, with_text_columns

BITS = 20
#: Documents of the training sample (of the labelled rows outside the held-out fold).
TRAIN_DOCS = 16384
HELD_OUT_MODULUS, HELD_OUT_FOLD = 4, 2
THRESHOLD = 0.3
EPOCHS = 8
#: FTRL-proximal: rate, its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 3


@dataclass(frozen=True)
class Weights:
    """A sparse linear model: at most 2**bits (index, value) pairs and a bias."""
    bias: float | None = None
    index: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    bits: int = BITS


def features(texts: list[bytes], bits: int = BITS):
    """(document, index) arrays of the hashed features of some texts: words,
    pairs of neighbours, and pairs with one word between them."""
    import numpy as np
    from xxhash import xxh64_intdigest
    words = [plain_words(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    doc = np.repeat(np.arange(len(words)), sizes)
    h = np.fromiter((xxh64_intdigest(w) for ws in words for w in ws), np.uint64, int(sizes.sum()))
    shift, docs, out = np.uint64(64 - bits), [doc], [h >> np.uint64(64 - bits)]
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = (h[:-gap] * np.uint64(odd)) ^ (h[gap:] + np.uint64(gap))
            out.append(((pair * np.uint64(0x9E3779B97F4A7C15)) >> shift)[same])
            docs.append(doc[gap:][same])
    return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def ftrl(rows, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
         l1: float = L1, l2: float = L2):
    """Weights of [(label, distinct indices)] by FTRL-proximal, one document at a time.

    Each coordinate has its own rate alpha / (beta + sqrt(sum of squared
    gradients)); a coordinate whose |z| stays within l1 is exactly zero. The
    bias is the last coordinate and carries no L1.
    """
    import numpy as np
    bias = 1 << bits
    z, n, strength = np.zeros(bias + 1), np.zeros(bias + 1), np.full(bias + 1, l1)
    strength[bias] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= strength[i], 0.0,
                        -(z[i] - np.sign(z[i]) * strength[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for y, i in rows:
            i = np.append(i, bias)
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    kept = np.flatnonzero(w[:-1])
    return float(w[-1]), kept, w[kept]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, bits: int = BITS) -> Weights:
    """Fit on at most ``limit`` labelled documents outside the held-out fold.

    The sample is that of the smallest id hashes. Tasks hash its documents;
    the indices (bounded by the sample) meet in one task that drops rare
    ones and runs FTRL. Rows
    with a null id or label take no part; of several labels of an id the
    largest counts, of several texts of an id that of the smallest hash. Without training rows
    the weights are empty and every score is 0.
    """
    known = (labels.where("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
             .where(fold(F.col("doc_id"), HELD_OUT_MODULUS) != HELD_OUT_FOLD))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(sample_ids(known, limit), "doc_id"))
    one_text = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")   # each task passes on one row of an id
    rows = rows.withColumn("r", F.row_number().over(one_text)).where("r = 1").drop("r")

    def hashed(texts):
        import numpy as np
        doc, index = features(texts, bits)
        out = [b""] * len(texts)
        both = np.unique(doc << bits | index)
        for part in np.split(both, np.flatnonzero(np.diff(both >> bits)) + 1):
            if len(part):
                out[int(part[0] >> bits)] = (part & ((1 << bits) - 1)).astype("<i4").tobytes()
        return [out]

    def fit(batches):
        import numpy as np
        import pyarrow as pa
        got = [(y, np.frombuffer(i, "<i4")) for b in batches
               for y, i in zip(b.column("y").to_pylist(), b.column("hashed").to_pylist())]
        if got:
            often = np.bincount(np.concatenate([i for _, i in got]), minlength=1 << bits) >= LEAST_DOCS
            got = [(y, i[often[i]]) for y, i in got]
            bias, index, value = ftrl(got, bits)
            yield pa.RecordBatch.from_pylist([{"bias": bias, "i": index.astype("<i4").tobytes(),
                                               "v": value.astype("<f8").tobytes()}])

    one = (with_text_columns(rows, {"hashed": "binary"}, hashed).select("doc_id", "y", "hashed")
           .repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id")
           .mapInArrow(fit, "bias double, i binary, v binary").collect())
    if not one:
        return Weights(bits=bits)
    import numpy as np
    return Weights(one[0].bias, np.frombuffer(one[0].i, "<i4").tolist(),
                   np.frombuffer(one[0].v, "<f8").tolist(), bits)


def scorer(weights: Weights):
    """texts -> scores from 0 to 1: each distinct feature of a document counts once."""
    held: list = []

    def score(texts):
        import numpy as np
        if weights.bias is None:
            return np.zeros(len(texts))
        if not held:
            held.append(np.zeros(1 << weights.bits))
            held[0][weights.index] = weights.value
        w = held[0]
        doc, index = features(texts, weights.bits)
        hit = w[index] != 0
        both = np.unique(doc[hit] << weights.bits | index[hit])
        total = weights.bias + np.bincount(both >> weights.bits, w[both & ((1 << weights.bits) - 1)], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
    return score


def with_score(docs: DataFrame, weights: Weights, name: str = "score") -> DataFrame:
    """``docs`` and the toxicity score of each text. The weights, at most
    2**bits pairs, go to the tasks as a broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(astuple(weights))
    made: list = []  # of the task

    def compute(texts):
        if not made:
            made.append(scorer(Weights(*held.value)))
        return [made[0](texts)]

    return with_text_columns(docs, {name: "double"}, compute)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: doc_id, held_out, score, predicted of every document.

    Null and empty texts get the score of no feature; a null doc_id is not held out."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    scored = with_score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    name = fresh(docs.columns, "score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) < threshold).drop(name)
