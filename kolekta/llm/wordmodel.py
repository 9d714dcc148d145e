"""Word n-grams: interpolated modified Kneser-Ney of order 3, its counts
dealt by n-gram and met by the n-grams of the documents in sharded joins.

The probability of a text falls into a sum over its n-grams: a word has its
log probability, and each longer n-gram seen, and each context seen, has what
it changes in the price of its shorter one. So a document needs no more than
the weights of its n-grams, each from the shard that holds it; n-grams never
seen have none.

The n-grams are met in rounds, by the words in their middle: counts and
contexts of one round need no other's, only the discounts and the words'
own probabilities are of all. So the tables, requests and shuffles of one
round alone are on disk at a time, besides the counts and the texts as
numbers, which are split into words only once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kolekta.llm.common import BLOCK_BYTES, Stored, blocks, byte_texts, give_back, lower_words, text_blocks, with_text_columns

#: Word hashes that stand before a text (twice) and after it; 0 stands for no word in a shorter n-gram.
BEGIN, END = 1, 2
#: Least weight that a context leaves to shorter ones; a training text so small that nothing is discounted leaves none.
LEAST_LEFT = 1e-12
#: Bytes of requests in a shard, about, and how many a byte of text makes.
SHARD_BYTES, REQUEST_BYTES = 32 << 20, 5
CODED = "texts binary, counts binary, words binary, codes binary"
#: Rounds at most (a power of two), and the bytes of text from which there is one more.
ROUNDS, ROUND_BYTES = 16, 8 << 20
#: Rows that tell the frequent n-grams, and how often one of these stands there at least.
SOME_ROWS, LEAST_SEEN = 2_000, 50
#: Hashes of words that a task remembers, and weights that it deals at once.
REMEMBERED, WEIGHT_ROWS = 500_000, 1_000_000


def word_hashes():
    """A dictionary that hashes words (64 bits of BLAKE2) when first asked for them."""
    import hashlib

    class Hashes(dict):
        def __missing__(self, word):
            if len(self) >= REMEMBERED:
                self.clear()
            h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            return h

    return Hashes()


def placed(hashes, n):
    """(s, at): the hashes of the words of texts, ``n`` in each, between two BEGIN and an END if it has any, and the text of each."""
    import numpy as np
    held = np.flatnonzero(n)
    n = n[held]
    at = np.repeat(held, n + 3)
    s = np.full(len(at), BEGIN, np.uint64)
    s[np.cumsum(n + 3) - 1] = END
    s[np.arange(n.sum()) + np.repeat(3 * np.arange(len(n)) + 2, n)] = hashes
    return s, at


def sequences(texts: list[bytes], hashes):
    """``placed`` for texts."""
    import numpy as np
    words = [lower_words(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    return placed(np.fromiter((hashes[x] for w in words for x in w), np.uint64, int(n.sum())), n)


def coded(docs: DataFrame) -> DataFrame:
    """(texts, counts, words, codes): blocks of ``docs(text_hash, text)`` as blobs of their text hashes, the words
    in each, the hashes of the distinct words and the place there of each word (its low bytes first)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        hashes = word_hashes()
        for b in batches:
            for i, k, texts in text_blocks(b.column(1), BLOCK_BYTES):
                place: dict = {}
                words = [lower_words(t) for t in texts]
                n = np.array([len(w) for w in words], np.uint32)
                codes = np.fromiter((place.setdefault(x, len(place)) for w in words for x in w), np.uint32, int(n.sum()))
                blobs = (b.column(0).slice(i, k - i).to_numpy(zero_copy_only=False), n,
                         np.fromiter((hashes[x] for x in place), np.uint64, len(place)), codes.view(np.uint8).reshape(-1, 4).T)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs],
                                                 ["texts", "counts", "words", "codes"])
        give_back()

    return docs.select("text_hash", "text").mapInArrow(run, CODED)


def decoded(batches):
    """(text hashes, s, at) of each block of ``coded``; see ``placed``."""
    import numpy as np
    for b in batches:
        for row in range(b.num_rows):
            texts, n, words, codes = (np.frombuffer(b.column(j)[row].as_py(), kind)
                                      for j, kind in enumerate((np.int64, np.uint32, np.uint64, np.uint8)))
            codes = np.ascontiguousarray(codes.reshape(4, -1).T).view(np.uint32).ravel()
            yield texts, *placed(words[codes], n.astype(np.int64))


def keys(u, v, w):
    """64-bit keys of n-grams given by the hashes of their words."""
    import numpy as np

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    step = np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(mix(u + step) + v) + w)


def in_round(words, part: int, rounds: int):
    """Which of the hashes belong to round ``part``; ``rounds`` is a power of two."""
    import numpy as np
    return words & np.uint64(rounds - 1) == np.uint64(part)


def count_trigrams(blocks: DataFrame, part: int = 0, rounds: int = 1) -> DataFrame:
    """(u, v, w, c): how often each trigram of the round occurs in ``coded`` blocks, dealt by its context; tasks sum blocks first."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for _, s, at in decoded(batches):
            p = np.flatnonzero((at[2:] == at[:-2]) & in_round(s[1:-1], part, rounds)) if len(s) else np.zeros(0, np.int64)
            _, first, c = np.unique(keys(s[p], s[p + 1], s[p + 2]), return_index=True, return_counts=True)
            p = p[first]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(s[p + j].view(np.int64)) for j in range(3)), pa.array(c.astype(np.int64))], ["u", "v", "w", "c"])
        give_back()

    rows = blocks.mapInArrow(run, "u long, v long, w long, c long")
    return rows.repartition("u", "v").groupBy("u", "v", "w").agg(F.sum("c").alias("c"))


def _discount(n):
    """The discount of each count c, from the counts of counts."""
    from kolekta.llm.quality import discounts
    d = discounts(n)
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _left(d, total):
    return F.greatest(d / total, F.lit(LEAST_LEFT))


def _counts_of_counts():
    return [F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]


class Counts:
    """Trigram counts of ``texts(text)``, a table a round, and what all rounds share: the discounts of
    trigrams and pairs, the words' probabilities ``words(w, p1)`` and ``unseen``, that of a word never seen."""

    def __init__(self, texts: DataFrame, rounds: int = 1):
        blocks = Stored(coded(texts.select(F.lit(0).cast("long").alias("text_hash"), "text")), "trained", compression="zstd")
        self.trigrams = [Stored(count_trigrams(blocks.df, r, rounds), "trigrams", clean=True) for r in range(rounds)]
        blocks.drop()
        every = reduce(DataFrame.unionByName, [t.df for t in self.trigrams])
        self.d3 = _discount(every.agg(*_counts_of_counts()).first())
        # each word: the pairs that end with it, and how many of them have each of the least counts
        n = [f"n{k}" for k in (1, 2, 3, 4)]
        self.kept = one = Stored(_pair_counts(every).groupBy("w").agg(F.count("*").alias("m"), *_counts_of_counts())
                                 .withColumnRenamed("m", "c"), "words", clean=True)
        self.d2 = _discount(one.df.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in n]).first())
        t = one.df.select("w", "c").withColumn("d", _discount(one.df.select("c").agg(*_counts_of_counts()).first()))
        n, total, d = t.agg(F.count("*"), F.sum("c"), F.sum("d")).first()
        self.unseen = max(d / total, LEAST_LEFT) / (n + 1) if n else 1.0
        self.words = t.select("w", ((F.col("c") - F.col("d")) / F.lit(float(total or 1)) + self.unseen).alias("p1"))


def _pair_counts(trigrams: DataFrame) -> DataFrame:
    return trigrams.groupBy("v", "w").agg(F.count("*").alias("c"))


def weights(counts: Counts, part: int = 0, rounds: int = 1) -> tuple[list[DataFrame], list[Stored]]:
    """([tables (u, v, w, weight)], what they are read from) of a round of the model.

    Shorter n-grams and contexts have 0 before them; a key that comes as both adds up. The round has
    the pairs and trigrams whose context ends, and the words and contexts that end, with its words."""
    three, words = counts.trigrams[part], counts.words
    # pairs: what a context leaves, and each pair's probability
    own = _pair_counts(three.df).withColumn("d", counts.d2)
    left2 = Stored(own.groupBy("v").agg(F.sum("c").alias("total"), F.sum("d").alias("d"))
                   .select("v", "total", _left(F.col("d"), F.col("total")).alias("g")), "left2", clean=True)
    p2 = (own.join(left2.df, "v").join(words, "w")
          .select("v", "w", ((F.col("c") - F.col("d")) / F.col("total") + F.col("g") * F.col("p1")).alias("p2"),
                  (F.col("g") * F.col("p1")).alias("lower")))
    pairs = Stored(p2, "pairs", clean=True)
    # trigrams: dealt by context once, then met by their pairs
    by = Window.partitionBy("u", "v")
    own = (three.df.withColumn("d", counts.d3).repartition("u", "v")
           .select("u", "v", "w", "c", "d", F.sum("c").over(by).alias("total"), F.sum("d").over(by).alias("left"),
                   F.row_number().over(by.orderBy("w")).alias("first"))
           .withColumn("g", _left(F.col("left"), F.col("total"))))
    met = own.join(pairs.df.select("v", "w", "p2"), ["v", "w"]).withColumn("lower", F.col("g") * F.col("p2"))
    none = F.lit(0).cast("long")
    weight = F.log10(((F.col("c") - F.col("d")) / F.col("total") + F.col("lower")) / F.col("lower"))

    def gram(u, v, w, x):
        return F.struct(u.alias("u"), v.alias("v"), w.alias("w"), x.alias("weight"))

    # one row of each context gives the weight of the context as well
    u, v, w = (F.col(n) for n in "uvw")
    long, context = gram(u, v, w, weight), gram(none, u, v, F.log10("g"))
    words = words.where(F.pmod("w", F.lit(rounds)) == part)
    tables = [met.select(F.inline(F.when(F.col("first") == 1, F.array(long, context)).otherwise(F.array(long)))),
              pairs.df.select(none.alias("u"), "v", "w", F.log10(F.col("p2") / F.col("lower")).alias("weight")),
              left2.df.select(none.alias("u"), none.alias("v"), F.col("v").alias("w"), F.log10("g").alias("weight")),
              words.select(none.alias("u"), none.alias("v"), "w", F.log10(F.col("p1") / counts.unseen).alias("weight"))]
    return tables, [left2, pairs]


def dealt_weights(tables: list[DataFrame], shards: int, frequent: list[int], more: int) -> DataFrame:
    """(shard, keys, weights): blobs of the keys of n-grams and their weights; each of ``more`` shards has the ``frequent`` ones."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        hot = np.array(frequent, np.uint64)

        def blobs(parts):
            k, x = (np.concatenate(a) for a in zip(*parts))
            shard = (k % np.uint64(shards)).astype(np.int32)
            if more:
                own = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k)
                shard = np.concatenate([shard, np.repeat(np.arange(shards, shards + more, dtype=np.int32), len(own))])
                k, x = (np.concatenate([a, np.tile(a[own], more)]) for a in (k, x))
            order = np.argsort(shard, kind="stable")
            k, x = k[order], x[order]
            names, first = np.unique(shard[order], return_index=True)
            cuts = [*first.tolist(), len(k)]
            return pa.RecordBatch.from_arrays(
                [pa.array(names), *(pa.array([a[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for a in (k, x))],
                ["shard", "keys", "weights"])

        parts, size = [], 0
        for b in batches:
            u, v, w = (b.column(j).to_numpy().view(np.uint64) for j in range(3))
            parts.append((keys(u, v, w), b.column(3).to_numpy()))
            size += b.num_rows
            if size >= WEIGHT_ROWS:
                yield blobs(parts)
                parts, size = [], 0
        if size:
            yield blobs(parts)

    return reduce(DataFrame.unionByName, tables).mapInArrow(run, "shard int, keys binary, weights binary")


def asked_keys(s, at, part: int = 0, rounds: int = 1):
    """(keys, text of each) of a round, for what ``placed`` gives: from its second BEGIN on each place asks for its word, its pair and, behind it, its trigram.

    A word is asked for in its round, a trigram in that of its middle; a pair in those of both its words, one for its
    probability and one for what it leaves as a context (see ``weights``)."""
    import numpy as np
    p = np.flatnonzero(at[1:] == at[:-1]) + 1
    last, context = in_round(s[p], part, rounds), in_round(s[p - 1], part, rounds)
    inner = p[context & (p >= 2)]
    inner = inner[at[inner] == at[inner - 2]]
    word, pair = p[last], p[last | context]
    none = np.zeros(1, np.uint64)
    return (np.concatenate([keys(none, none, s[word]), keys(none, s[pair - 1], s[pair]), keys(s[inner - 2], s[inner - 1], s[inner])]),
            np.concatenate([at[word], at[pair], at[inner]]))


def frequent_keys(docs: DataFrame, shards: int) -> tuple[list[int], int]:
    """(sorted keys, shards for them): n-grams that are a fourth of a shard by themselves in some rows, and their part of all.

    What some rows say only settles where requests are met, not what comes of them."""
    n = docs.count()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        hashes = word_hashes()
        for b in batches:
            texts = byte_texts(b.column(0))
            for i, j in blocks(texts):
                k, c = np.unique(asked_keys(*sequences(texts[i:j], hashes))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "c"])

    some = docs.select("text").sample(min(1.0, SOME_ROWS / max(n, 1)), seed=1)
    counts = Stored(some.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "some_keys")
    total = counts.df.agg(F.sum("c")).first()[0] or 0
    # at most 4 * shards keys have a share of this size
    rows = counts.df.where(F.col("c") > max(total / (4 * shards), LEAST_SEEN)).collect()
    counts.drop()
    return sorted(r.key % (1 << 64) for r in rows), math.ceil(shards * sum(r.c for r in rows) / max(total, 1))


def requests(blocks: DataFrame, shards: int, frequent: list[int], more: int, part: int = 0, rounds: int = 1) -> DataFrame:
    """(shard, texts, counts, keys): the round's n-grams of ``coded`` blocks dealt by key, as blobs of a block of texts.

    ``frequent`` keys go to one of ``more`` further shards, by block."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        hot = np.array(frequent, np.uint64)
        for ids, s, at in decoded(batches):
            k, text = asked_keys(s, at, part, rounds)
            if not len(k):
                continue
            shard = (k % np.uint64(shards)).astype(np.int64)
            if more:
                place = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
                shard[hot[place] == k] = shards + int(ids[0]) % more
            order = np.lexsort((text, shard))
            k, text, shard = k[order], text[order], shard[order]
            names, first = np.unique(shard, return_index=True)
            rows = [[], [], []]
            for a, z in zip(first, [*first[1:], len(k)]):
                which, count = np.unique(text[a:z], return_counts=True)
                for row, x in zip(rows, (ids[which], count.astype(np.uint32), k[a:z])):
                    row.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)],
                                             ["shard", "texts", "counts", "keys"])
        give_back()

    return blocks.mapInArrow(run, "shard int, texts binary, counts binary, keys binary")


def _met(asked, held):
    """Sums of the weights of one shard's requests, by text."""
    import numpy as np
    import pyarrow as pa

    def joined(column, kind):
        return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist())])

    k, x = joined(held["keys"], np.uint64), joined(held["weights"], np.float64)
    order = np.argsort(k)
    k, x = k[order], x[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]))
    k, x = k[first], (np.add.reduceat(x, first) if len(first) else x)
    texts, totals = [np.zeros(0, np.int64)], [np.zeros(0)]
    for t, c, a in zip(*(asked[n].to_pylist() for n in ("texts", "counts", "keys"))):
        a, c = np.frombuffer(a, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64)
        texts.append(np.frombuffer(t, np.int64))
        if not len(k):
            totals.append(np.zeros(len(c)))
            continue
        at = np.minimum(np.searchsorted(k, a), len(k) - 1)
        totals.append(np.add.reduceat(np.where(k[at] == a, x[at], 0.0), np.cumsum(c) - c))
    found = pa.table({"text_hash": np.concatenate(texts), "total": np.concatenate(totals)})
    give_back()
    return found


def with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with n_units: the words of its text and one end, 0 without words."""
    return with_text_columns(docs, {"n_units": "long"}, lambda texts: [[(n + 1 if n else 0) for n in map(len, map(bytes.split, texts))]])


def rounds_of(size: int) -> int:
    """Rounds for ``size`` bytes of text: a power of two, ROUNDS at most."""
    return min(ROUNDS, 1 << max(0, math.ceil(math.log2(max(size, 1) / ROUND_BYTES))))


def log_prices(docs: DataFrame, trained: DataFrame, rounds: int | None = None) -> DataFrame:
    """(text_hash, price, n_units) of each distinct text of ``docs(text_hash, text)``: -log10 of its probability
    under the model of ``trained(text)``, and its units. Texts without words have price 0 and no units."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = rounds or rounds_of(size)
    counts = Counts(trained, rounds)
    shards = max(8, math.ceil(size * REQUEST_BYTES / SHARD_BYTES / rounds))
    frequent, more = frequent_keys(docs, shards * rounds)
    blocks, sums = Stored(coded(docs), "coded", compression="zstd"), []
    for r in range(rounds):
        tables, kept = weights(counts, r, rounds)
        asked, held = requests(blocks.df, shards, frequent, more, r, rounds), dealt_weights(tables, shards, frequent, more)
        met = asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_met, "text_hash long, total double")
        sums.append(Stored(met.groupBy("text_hash").agg(F.sum("total").alias("total")), "word_sums", clean=True))
        for table in (*kept, counts.trigrams[r]):
            table.drop()
    blocks.drop()
    total = reduce(DataFrame.unionByName, [s.df for s in sums]).groupBy("text_hash").agg(F.sum("total").alias("total"))
    # equal texts ask once a row, so their sums are shared by the rows
    units = with_words(docs.select("text_hash", "text")).groupBy("text_hash").agg(
        F.first("n_units").alias("n_units"), F.count("*").alias("rows"))
    prices = Stored(units.join(total, "text_hash", "left").select(
        "text_hash", (-(F.coalesce("total", F.lit(0.0)) / F.col("rows") + math.log10(counts.unseen) * F.col("n_units"))).alias("price"),
        "n_units"), "word_prices", clean=True)
    for table in (*sums, counts.kept):
        table.drop()
    return prices.df
