"""Language-model scores: a hashed maximum-entropy model with a class-factored
softmax.

p(word | history) = p(class | history) * p(word | class). The class softmax
has a bias and hashed features of the history: the word before (bigram), the
word two before (skip) and both together (trigram). It is trained on every token of
the training fold by gradient steps in rounds; between rounds the weights of
all tasks are averaged, row by row, over the tokens that touched the row.
The word softmax has the unigram feature alone, so its weights are the
logarithms of counts over the training fold: known words share 1 - u, and
one unknown word gets u, the share of words seen once (Good-Turing).

The most frequent words (HEADS, the end of a text among them) are classes of
their own; all others fall into classes by a hash of their last two bytes,
which any word has, known or not.

Counts of all words grow with the corpus and are never broadcast: only those
of the FREQUENT most frequent words are. Those of the others meet the
documents in a join by word. The table of hashed features grows with the
words that a history tells apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import Stored, blocks, byte_texts, fold, lower_words, read_table, stored

CLASSES, HEADS = 64, 40
#: Words whose counts and history numbers tasks hold.
FREQUENT = 1 << 16
#: Words that a history tells apart; others stand there as their class.
HISTORY = FREQUENT
#: Least rows (2**ROW_BITS) of the hashed feature table; it has ROWS_A_WORD, rounded up to a power of
#: two, for each word that a history tells apart: 2**17 rows of CLASSES weights (34 MB) at most.
ROW_BITS, ROWS_A_WORD = 14, 2
ROUNDS = 4
#: Training tokens for each task that trains: at least TASK_TOKENS, and ROW_TOKENS a row of the table,
#: so that the weights it sends do not outgrow its text.
TASK_TOKENS, ROW_TOKENS = 8_000_000, 128
#: Rows of the table that tasks send together.
PIECE = 1 << 12
STEP_TOKENS, RATE = 4096, 0.5
#: Tokens scored at once, few enough for a core's cache.
SCORE_TOKENS = 1024
#: Bytes of text whose words are numbered at once, in training and scoring.
TEXT_BYTES = 1 << 20
MODULUS, HELD_OUT = 7, 2
#: Distinct words that a counting task holds before it passes them on.
COUNTED = 400_000
END = b""


def suffix_class(word: bytes) -> int:
    """Class of a word that is not a head, from its last two bytes."""
    return HEADS + (word[-1] * 31 + (word[-2] * 7 if len(word) > 1 else 0)) % (CLASSES - HEADS)


class Words:
    """Numbers of words: rank for the frequent ones, FREQUENT + class for others."""

    def __init__(self, frequent: list[bytes]):
        import numpy as np
        self.rank = {w: i for i, w in enumerate(frequent)}
        self.classes = np.array([i if i < HEADS else suffix_class(w) for i, w in enumerate(frequent)], np.int64)
        if len(frequent) < FREQUENT:
            self.classes = np.concatenate([self.classes, np.full(FREQUENT - len(frequent), HEADS)])
        self.classes = np.concatenate([self.classes, np.arange(CLASSES)])
        numbers = np.arange(FREQUENT + CLASSES)
        self.past = np.where(numbers < HISTORY, numbers, FREQUENT + self.classes)

    def numbers(self, words: list[list[bytes]]):
        """(number of each token, tokens of each text); an end follows each text's words."""
        import itertools

        import numpy as np
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat: list[bytes] = []
        for ws in words:
            flat += ws
            flat.append(END)
        out = np.fromiter(map(self.rank.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        rare = np.flatnonzero(out < 0)
        out[rare] = [FREQUENT + suffix_class(flat[k]) if flat[k] else FREQUENT for k in rare.tolist()]
        return out, sizes


def row_bits(distinct: int) -> int:
    """Bits of a feature row in a model of ``distinct`` counted words."""
    return max(ROW_BITS, (ROWS_A_WORD * min(distinct, HISTORY) - 1).bit_length())


def history(numbers, sizes, bits: int = ROW_BITS):
    """(3, tokens) hashed feature rows: the word before (bigram), the word two before (skip), both (trigram).

    ``numbers``: the words as a history tells them apart; ``bits``: of a row."""
    import numpy as np
    start = np.zeros(len(numbers), bool)
    start[np.cumsum(sizes) - sizes] = True
    second = np.zeros(len(numbers), bool)
    second[1:] = start[:-1]
    second &= ~start
    none = np.int64(FREQUENT + CLASSES)
    one, two = np.roll(numbers, 1), np.roll(numbers, 2)
    one[start] = none
    two[start | second] = none
    one, two = one.astype(np.uint64), two.astype(np.uint64)
    shift = np.uint64(64 - bits)
    a, b = one * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(0xC2B2AE3D27D4EB4F)
    both = (a ^ (b >> np.uint64(7))) * np.uint64(0xD6E8FEB86659FD93)
    rows = np.stack([a >> shift, (b * np.uint64(3)) >> shift, both >> shift]).astype(np.int64)
    return np.maximum(rows, 1)  # row 0 is the bias


def logits(weights, rows):
    """Sums of the weight rows of each token's features and the bias, held where exp stays finite."""
    import numpy as np
    x = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        x += weights.take(r, axis=0)
    x += weights[0]
    return np.clip(x, -60, 60, out=x)


def log_softmax(weights, rows):
    """Log probabilities of the classes for each token."""
    import numpy as np
    x = logits(weights, rows)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


def log_chosen(weights, rows, classes):
    """Log probability of the class of each token, ``log_softmax`` at ``classes``."""
    import numpy as np
    x = logits(weights, rows)
    own = x[np.arange(len(x)), classes]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(CLASSES, np.float32))


def train_block(weights, squares, touched, rows, classes) -> None:
    """One gradient step on a block of tokens, with a rate for each row (AdaGrad)."""
    import numpy as np
    g = logits(weights, rows)
    np.exp(g, out=g)
    g /= (g @ np.ones(CLASSES, np.float32))[:, None]
    g[np.arange(len(classes)), classes] -= 1.0
    total = g.sum(0)
    squares[0] += np.square(total).mean()
    weights[0] -= RATE * 0.1 * total / np.sqrt(squares[0] + 1.0)
    touched[0] += len(classes)
    place = np.arange(len(classes))
    for r in rows:
        s = np.sort(r << 32 | place)  # by row, then place: plain numbers sort faster than an order of them
        s, order = s >> 32, s & 0xFFFFFFFF
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        which, n = s[first], np.diff(np.r_[first, len(s)])
        # Sums of the tokens of a row: the k-th tokens of all rows at once while many rows have one, then row by row.
        sums, k, left = g.take(order[first], axis=0), 1, np.flatnonzero(n > 1)
        while len(left) > 64:
            sums[left] += g.take(order[first[left] + k], axis=0)
            k += 1
            left = left[n[left] > k]
        for i in left.tolist():
            sums[i] += g.take(order[first[i] + k:first[i] + n[i]], axis=0).sum(0)
        of_row = squares[which] + np.einsum("ij,ij->i", sums, sums) / CLASSES
        squares[which] = of_row
        sums *= (RATE / np.sqrt(of_row + 1.0))[:, None]
        weights[which] -= sums
        touched[which] += n


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of ``docs(text)``, the end of each text as the empty word. Tasks sum their own first."""
    def run(batches):
        import collections

        import pyarrow as pa

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()),
                                               pa.array(list(found.values()), pa.int64())], ["word", "n"])

        found = collections.Counter()
        for b in batches:
            for t in byte_texts(b.column(0)):
                found.update(lower_words(t))
                found[END] += 1
                if len(found) > COUNTED:
                    yield out(found)
                    found = collections.Counter()
        if found:
            yield out(found)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _class_column():
    """SQL form of the class of a word."""
    w = F.encode("word", "UTF-8")
    last = F.conv(F.hex(F.substring(w, -1, 1)), 16, 10).cast("int")
    before = F.when(F.octet_length("word") > 1, F.conv(F.hex(F.substring(w, -2, 1)), 16, 10).cast("int") * 7).otherwise(0)
    return F.when(F.col("word") == "", F.lit(HEADS)).otherwise(F.lit(HEADS) + (last * 31 + before) % (CLASSES - HEADS))


class Model:
    """What training gives: counts (a DataFrame of word, c, class), their sums, the frequent words and the weights."""

    def __init__(self, counts, total, distinct, frequent, class_total, unknown, weights):
        self.counts, self.total, self.distinct, self.frequent = counts, total, distinct, frequent
        self.class_total, self.unknown, self.weights = class_total, unknown, weights


def train(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """Train on all rows of ``docs(doc_id, text)``; null texts are empty.

    The tables that reach the driver have fixed bounds: FREQUENT words, sums
    for CLASSES classes, ROWS_A_WORD weight rows for each of HISTORY words.
    """
    import numpy as np
    spark = docs.sparkSession
    counts = stored(count_words(docs), "words")
    # Written first: a collected limit would send the first rows of every task to the driver.
    frequent = stored(counts.orderBy(F.col("word") != "", F.desc("c"), "word").limit(FREQUENT), "frequent")
    top = sorted(((r[0], r[1]) for r in frequent.collect()), key=lambda x: (x[0] != "", -x[1], x[0]))
    heads = [w for w, _ in top[:HEADS]]
    counts = counts.withColumn("class", F.when(F.col("word").isin(heads), F.lit(-1)).otherwise(_class_column()))
    total, distinct = 0, 0
    class_total, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for cls, n, types, singles in (counts.groupBy("class").agg(
            F.sum("c"), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).collect()):
        total, distinct = total + n, distinct + types
        if cls >= 0:
            class_total[cls], once[cls] = n, singles
    for i, (_, c) in enumerate(top[:HEADS]):
        class_total[i] = c
    unknown = (once + 0.5) / (class_total + 1.0)
    unknown[:len(heads)] = 0.0
    weights = np.zeros((1 << row_bits(distinct), CLASSES), np.float32)
    weights[0] = np.log((class_total + 0.1) / (class_total + 0.1).sum())
    frequent = [w.encode() for w, _ in top]
    tasks = max(1, -(-total // max(TASK_TOKENS, ROW_TOKENS * len(weights))))
    for k in range(rounds if total else 0):
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(rounds)) == k)
        weights = _round(spark, part.select("text").coalesce(tasks), tasks, frequent, weights)
    return Model(counts, total, distinct, top, class_total, unknown, weights)


def _round(spark, texts: DataFrame, tasks: int, frequent: list[bytes], weights):
    """Weights after each of ``tasks`` tasks at most has trained on its texts, averaged by row over the tokens that touched it.

    The array is changed in place: the driver holds the table once, and gets a partition of new rows at a time."""
    import numpy as np
    held = spark.sparkContext.broadcast((frequent, weights))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        words, w = Words(held.value[0]), held.value[1].copy()
        squares, touched = np.zeros(len(w), np.float32), np.zeros(len(w), np.int64)
        bits = len(w).bit_length() - 1
        for b in batches:
            all_texts = byte_texts(b.column(0))
            for i, k in blocks(all_texts, TEXT_BYTES):
                numbers, sizes = words.numbers([lower_words(t) for t in all_texts[i:k]])
                rows, classes = history(words.past[numbers], sizes, bits), words.classes[numbers]
                for a in range(0, len(numbers), STEP_TOKENS):
                    train_block(w, squares, touched, rows[:, a:a + STEP_TOKENS], classes[a:a + STEP_TOKENS])
        for p in range(0, len(w), PIECE):
            n = touched[p:p + PIECE]
            if n.any():
                yield pa.RecordBatch.from_pylist([{"piece": p, "n": n.astype("<f8").tobytes(),
                                                   "w": (w[p:p + PIECE] * n[:, None]).astype("<f4").tobytes()}],
                                                 pa.schema([("piece", pa.int64()), ("n", pa.binary()), ("w", pa.binary())]))

    def add(key, table):
        import numpy as np
        import pyarrow as pa
        n = w = 0
        for a, b in zip(table.column("n"), table.column("w")):
            n = n + np.frombuffer(a.as_buffer(), "<f8")
            w = w + np.frombuffer(b.as_buffer(), "<f4").astype("<f8")
        return pa.table({"piece": [key[0].as_py()], "n": [n.tobytes()], "w": [w.astype("<f4").tobytes()]})

    schema = "piece long, n binary, w binary"
    found = texts.mapInArrow(run, schema)
    if tasks > 16:  # sums of a few tasks first, then of those, so that no task gathers the weights of all
        found = (found.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(16)))
                 .groupBy("piece", "some").applyInArrow(add, schema))
    found = found.groupBy("piece").applyInArrow(add, schema)
    for r in found.toLocalIterator():
        n, w = np.frombuffer(r.n, "<f8"), np.frombuffer(r.w, "<f4").reshape(-1, CLASSES)
        hit = n > 0
        weights[r.piece:r.piece + PIECE][hit] = w[hit] / n[hit, None]
    held.destroy()  # also the driver's blocks: one table less a round
    return weights


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``.

    score: log10 probability of the text under the model; base_score: that
    of add-one unigrams; n_known: tokens seen in training. Null and empty
    texts are one end. Repeated rows come back repeated.
    """
    import numpy as np
    spark = docs.sparkSession
    n, v = model.total, model.distinct
    held = spark.sparkContext.broadcast((
        [w.encode() for w, _ in model.frequent], np.array([c for _, c in model.frequent], float),
        model.class_total, model.unknown, model.weights))

    def run(batches):
        import collections

        import numpy as np
        import pyarrow as pa
        frequent, c, class_total, unknown, weights = held.value
        words, bits = Words(frequent), len(weights).bit_length() - 1
        own = np.zeros(FREQUENT + CLASSES)
        cls = words.classes[:len(c)]
        own[:len(c)] = np.log10((1 - unknown[cls]) * c / class_total[cls])
        own[:min(HEADS, len(c))] = 0.0
        base = np.zeros(FREQUENT + CLASSES)
        base[:len(c)] = np.log10((c + 1) / (n + v + 1))
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()),
                            ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                            ("rare", pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())])))])
        for b in batches:
            texts = byte_texts(b.column(2))
            for i, k in blocks(texts, TEXT_BYTES):
                tokens = [lower_words(t) for t in texts[i:k]]
                numbers, sizes = words.numbers(tokens)
                rows, classes = history(words.past[numbers], sizes, bits), words.classes[numbers]
                lp = np.empty(len(numbers))
                for a in range(0, len(numbers), SCORE_TOKENS):
                    z = slice(a, a + SCORE_TOKENS)
                    lp[z] = log_chosen(weights, rows[:, z], classes[z])
                first = np.cumsum(sizes) - sizes
                rare = [collections.Counter(w for w in ws if w not in words.rank) for ws in tokens]
                ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array([w for c in rare for w in c], pa.string()),
                     pa.array([n for c in rare for n in c.values()], pa.int64())], ["word", "tf"]))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, k - i), b.column(1).slice(i, k - i), pa.array(sizes),
                    pa.array(np.add.reduceat((numbers < FREQUENT).astype(np.int64), first)),
                    pa.array(np.add.reduceat(base[numbers], first)),
                    pa.array(np.add.reduceat(lp / np.log(10) + own[numbers], first)),
                    rare], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_tokens long, n_known long, base_score double, score double,"
             "rare array<struct<word:string,tf:long>>")
    rows = stored(rows, "scored")
    rare = rows.select("doc_id", "text_hash", F.explode("rare").alias("r")).select("doc_id", "text_hash", "r.word", "r.tf")
    classes = spark.createDataFrame([(i, float(model.class_total[i]), float(model.unknown[i])) for i in range(HEADS, CLASSES)],
                                    "class int, class_total double, unknown double")
    counts = model.counts.where("class >= 0").select("word", "c")
    met = rare.join(counts, "word", "left").withColumn("class", _class_column()).join(F.broadcast(classes), "class")
    share = F.when(F.col("c").isNull(), F.col("unknown")).otherwise((1 - F.col("unknown")) * F.col("c") / F.col("class_total"))
    sums = met.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.sum("tf").alias("tf"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("base"),
        F.sum(F.col("tf") * F.log10(share)).alias("own"))
    slim = rows.select("doc_id", "text_hash", "n_tokens", "n_known", "base_score", "score",
                       F.aggregate("rare", F.lit(0).cast("long"), lambda a, x: a + x["tf"]).alias("rare_tokens"))
    # A row's share of the sums: repeated rows of a document were summed together.
    one = F.coalesce(F.col("rare_tokens") / F.col("tf"), F.lit(0.0))
    return (slim.join(sums, slim.doc_id.eqNullSafe(sums.id) & (slim.text_hash == sums.hash), "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce(F.round(F.col("known") * one), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce(F.col("base") * one, F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("own") * one, F.lit(0.0))).alias("score")))


def held_out(doc_id):
    return F.coalesce(fold(doc_id, MODULUS) == HELD_OUT, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: scores of all documents under a model of those outside the held-out fold (null ids train)."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = score(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                       "base_score", "score")
