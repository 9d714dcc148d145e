"""Phrase collocations: contiguous phrases counted exactly and scored by their weakest cut.

Words that occur often enough are numbered by frequency. The pairs of
neighbouring numbers fall into square tiles of the pair table. A tile with many
entries is a dense array that ``bincount`` addresses directly; the entries
of all other tiles are kept as sorted (code, count) lists. Frequent pairs are
numbered by frequency in turn and paired with the word that follows, which
counts phrases of three words in the same way, and so on.

Texts become number streams by block: a task gives the words of its texts
numbers of its own, and a join with the table of frequent words, of any size,
gives the numbers by frequency. Pairs get theirs by exchanging packed codes.
Partial counts are merged by tile, at most FAN_IN at a time, so the tile of the
most frequent words is no task's whole work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import Stored, arrow_bytes, byte_texts, give_back, key_runs, read_table, stored
from kolekta.llm.scans import running, union

MAX_WORDS = 3
#: Least occurrences of a candidate.
LEAST = 10
#: Phrases reported for each language.
TOP = 2000
#: Side of a tile (a power of two), and the entries from which it is dense.
TILE = 1 << 10
DENSE = TILE * TILE // 32
#: A block, whose words are numbered together, ends at so many tokens or distinct words; its tokens
#: come in chunks, which end with a text.
BLOCK_TOKENS, BLOCK_WORDS, CHUNK_TOKENS = 4_000_000, 250_000, 250_000
#: Codes that a task counts at once, and distinct codes that it holds before it passes them on.
COUNT_CODES, HELD_CODES = 500_000, 1_000_000
#: Bytes of a row group of chunks and of packed codes, and of what a worker gets at once of them.
ROW_GROUP, BATCH = 16 << 20, 8 << 20
#: Partial counts of a tile that one task merges.
FAN_IN = 64
#: Codes of a bucket, about.
BUCKET_CODES = 1_000_000

SKIP, BREAK = 0, 1
TOO_MANY = "more than 2**31 frequent words or phrases of one length"
#: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
PLAIN = bytes(c | 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def number_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs(lang, text)``: (block, n_tokens, tokens, keys, counts, langs, lang_counts).

    tokens are chunks of 32-bit numbers: 1 at the end of a piece, else 2 and
    more for the place in keys ("word lang"); counts and lang_counts are of words."""
    def run(batches):
        import itertools
        from collections import defaultdict

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 24

        def fresh_numbers():
            return itertools.count(2).__next__, {}, [[]], 0, 0, defaultdict(int)

        def out():
            chunks = [np.concatenate(c) for c in held if c]
            n = sum(len(d) for d in words.values()) - 2 * len(words)
            keys = [b""] * n
            for lang, d in words.items():
                tail = b" " + lang
                for w, i in d.items():
                    if i > BREAK:
                        keys[i - 2] = w + tail
            counts = sum(np.bincount(c, minlength=n + 2) for c in chunks)[2:]
            one = lambda x, t: pa.array([x], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([size]), one([c.tobytes() for c in chunks], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(keys, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(counts.astype(np.int64))),
                 one([k.decode() for k in per_lang], pa.string()), one(list(per_lang.values()), pa.int64())],
                ["block", "n_tokens", "tokens", "keys", "counts", "langs", "lang_counts"])

        number, words, held, size, filled, per_lang = fresh_numbers()
        end = np.array([BREAK], np.int32)
        for b in batches:
            langs = byte_texts(b.column(0).fill_null("und"))
            for lang, text in zip(langs, byte_texts(b.column(1))):
                parts = text.translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
                if lang not in words:
                    words[lang] = defaultdict(number, {b"": SKIP, b"\n": BREAK})
                ids = np.fromiter(map(words[lang].__getitem__, parts), np.int32, len(parts))
                ids = ids[ids != SKIP]
                per_lang[lang] += int((ids > BREAK).sum())
                if filled >= CHUNK_TOKENS:
                    held.append([])
                    filled = 0
                held[-1] += [ids, end]
                size += len(ids) + 1
                filled += len(ids) + 1
                if size >= BLOCK_TOKENS or sum(map(len, words.values())) >= BLOCK_WORDS:
                    yield out()
                    number, words, held, size, filled, per_lang = fresh_numbers()
                    block += 1
        if size:
            yield out()
        del words, held
        give_back()

    return docs.select(F.col("lang").cast("string"), "text").mapInArrow(
        run, "block long, n_tokens long, tokens array<binary>, keys array<string>, counts array<long>, langs array<string>, "
             "lang_counts array<long>")


def ranked(table: DataFrame, order: list[str]) -> DataFrame:
    """``table`` with ``id``: its place from 0 by falling ``f``, then ``order``."""
    table = stored(table.withColumns({"falling": -F.col("f"), "one": F.lit(1).cast("long")}), "table")
    placed = running(table, None, ["falling", *order], sums=["one"])
    return placed.withColumn("id", F.col("run_one") - 1).drop("falling", "one", "run_one")


def word_streams(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, words, grams): for each chunk, now a block by itself, the ids of
    its tokens as 32-bit numbers, -1 for ends of pieces and rarer words; null
    grams are the words themselves."""
    numbers = (blocks.select("block", F.posexplode("keys").alias("at", "key"))
               .join(vocabulary.select("key", "id"), "key").select(F.col("block").alias("of"), "at", "id"))

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa
        chunks = [np.frombuffer(c.as_buffer(), np.int32) for c in left.column("tokens")]
        at, ids = right.column("at").to_numpy(), right.column("id").to_numpy()
        if len(ids) and ids.max() >> 31:
            raise OverflowError(TOO_MANY)
        table = np.full(max(BREAK, *(int(c.max()) for c in chunks)) + 1, -1, np.int32)
        table[at + 2] = ids
        words = pa.array([table[c].tobytes() for c in chunks], pa.binary())
        names = pa.array([(b << 16) + k for b, k in zip(left.column("block").to_pylist(), left.column("chunk").to_pylist())], pa.int64())
        return pa.table({"block": names, "words": words, "grams": pa.nulls(len(words), pa.binary())})

    return (blocks.select("block", F.posexplode("tokens").alias("chunk", "tokens")).groupBy("block").cogroup(numbers.groupBy("of"))
            .applyInArrow(run, "block long, words binary, grams binary"))


def _codes(words, grams, size: int):
    """(left << 32 | right) for every phrase of ``size`` words of a stream
    (Arrow binaries) whose parts have ids, and their places."""
    import numpy as np
    words, grams = (np.frombuffer((x if x.is_valid else words).as_buffer(), np.int32) for x in (words, grams))
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right = grams[:n], words[size - 1:]
    at = np.flatnonzero((left >= 0) & (right >= 0))
    return left[at].astype(np.int64) << 32 | right[at], at


def merge_codes(codes, counts=None):
    """Sorted distinct codes and their summed counts (one each, if none are given), by tiles."""
    import numpy as np
    left, right = codes >> 32, codes & 0xFFFFFFFF
    side, bits = 64, TILE.bit_length() - 1
    tiles = np.where((left >> bits < side) & (right >> bits < side), (left >> bits) * side + (right >> bits), side * side)
    many = np.flatnonzero(np.bincount(tiles, minlength=side * side + 1)[:-1] >= DENSE)
    found, sparse = [], np.ones(len(codes), bool)
    for t in many:  # dense tiles: the cell is the address
        own = tiles == t
        cell = (left[own] & (TILE - 1)) << bits | (right[own] & (TILE - 1))
        # Weighted sums are exact: a double holds integers to 2**53.
        dense = np.bincount(cell, None if counts is None else counts[own], TILE * TILE).astype(np.int64)
        hit = np.flatnonzero(dense)
        found.append(((hit >> bits) + (t // side << bits) << 32 | (hit & (TILE - 1)) + (t % side << bits), dense[hit]))
        sparse &= ~own
    if sparse.any():  # all others: sorted coordinates
        rest = codes[sparse]
        if counts is None:
            found.append(np.unique(rest, return_counts=True))
        else:
            order = np.argsort(rest, kind="stable")
            rest = rest[order]
            first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
            found.append((rest[first], np.add.reduceat(counts[sparse][order], first)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(codes, kind="stable")
    return codes[order], counts[order]


def _mixed(x):
    import numpy as np
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)


def _packed(codes, counts, part: int, buckets: int):
    """Batches of (bucket, part, codes, counts), a row for each bucket of tiles."""
    import numpy as np
    import pyarrow as pa
    bits = TILE.bit_length() - 1
    bucket = (_mixed((codes >> (32 + bits) << 32) | ((codes & 0xFFFFFFFF) >> bits)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, codes, counts = bucket[order], codes[order], counts[order]
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else []
    for k in range(0, len(cuts) - 1, 256):
        spans = list(zip(cuts[k:k + 256], cuts[k + 1:k + 257]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[a]) for a, _ in spans]), pa.array([part] * len(spans)),
             pa.array([codes[a:z].tobytes() for a, z in spans], pa.binary()),
             pa.array([counts[a:z].tobytes() for a, z in spans], pa.binary())], ["bucket", "part", "codes", "counts"])


PACKED = "bucket long, part long, codes binary, counts binary"


def count_phrases(streams: DataFrame, size: int, least: int, buckets: int) -> DataFrame:
    """(left, right, f): every phrase of ``size`` words that occurs ``least``
    times or more, as the id of its first size - 1 words and that of its last."""
    def count(batches):
        import numpy as np
        from pyspark import TaskContext
        part, raw, n_raw, held = TaskContext.get().partitionId(), [], 0, None

        def merged():
            codes, counts = merge_codes(np.concatenate(raw))
            if held is None:
                return codes, counts
            return merge_codes(np.concatenate([held[0], codes]), np.concatenate([held[1], counts]))

        for b in batches:
            for row in zip(b.column(1), b.column(2)):
                raw.append(_codes(*row, size)[0])
                n_raw += len(raw[-1])
                if n_raw >= COUNT_CODES:
                    held, raw, n_raw = merged(), [], 0
                    if len(held[0]) >= HELD_CODES:
                        yield from _packed(*held, part, buckets)
                        held = None
        if raw:
            held = merged()
        if held is not None:
            yield from _packed(*held, part, buckets)
        held = None
        give_back()

    def merge(last: bool):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            for (part, bucket), rows in key_runs(batches, 2):
                held, raw, n_raw = [np.empty(0, np.int64)] * 2, [], 0
                for r in [x for b in rows for x in zip(b.column(2), b.column(3))] + [None]:
                    if r is not None:
                        raw.append([np.frombuffer(x.as_buffer(), np.int64) for x in r])
                        n_raw += len(raw[-1][0])
                    if raw and (r is None or n_raw >= COUNT_CODES):
                        held = merge_codes(*(np.concatenate(x) for x in zip(held, *raw)))
                        raw, n_raw = [], 0
                codes, counts = held
                if last:
                    often = counts >= least
                    codes, counts = codes[often], counts[often]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(counts)], ["left", "right", "f"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket]), pa.array([part]), pa.array([codes.tobytes()], pa.binary()),
                         pa.array([counts.tobytes()], pa.binary())], ["bucket", "part", "codes", "counts"])
        return run

    held = Stored(streams.select("block", "words", "grams").mapInArrow(count, PACKED), "partial", ROW_GROUP)
    packed = held.df
    parts = packed.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    while True:
        last = parts <= FAN_IN
        group = F.lit(0).cast("long") if last else F.floor(F.col("part") / FAN_IN)
        rows = packed.select(group.alias("part"), "bucket", "codes", "counts")
        dealt = rows.repartition("part", "bucket").sortWithinPartitions("part", "bucket")
        if last:
            found = stored(dealt.mapInArrow(merge(True), "left long, right long, f long"), "counted")
            held.drop()
            return found
        before, held = held, Stored(dealt.mapInArrow(merge(False), PACKED), "partial", ROW_GROUP)
        before.drop()
        packed, parts = held.df, -(-parts // FAN_IN)


def phrase_streams(streams: DataFrame, phrases: DataFrame, size: int, buckets: int) -> DataFrame:
    """``streams`` with ``grams`` now the ids of ``phrases(id, left, right)`` of ``size`` words, -1 elsewhere."""
    def ask(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            for block, *row in zip(*b.columns):
                codes = np.unique(_codes(*row, size)[0])
                bucket = (_mixed(codes) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, codes = bucket[order], codes[order]
                cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(codes) else [0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts[:-1]] if len(codes) else [], pa.int64()), pa.array([block.as_py()] * (len(cuts) - 1), pa.int64()),
                     pa.array([codes[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())], ["bucket", "block", "codes"])

    def name(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            codes = b.column(0).to_numpy() << 32 | b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array((_mixed(codes) % np.uint64(buckets)).astype(np.int64)), pa.array(codes), b.column(2)],
                ["bucket", "code", "id"])

    def answer(key, asks, names):
        import numpy as np
        import pyarrow as pa
        code, ids = names.column("code").to_numpy(), names.column("id").to_numpy()
        order = np.argsort(code)
        code, ids = code[order], ids[order]
        out = []
        for block, codes in zip(asks.column("block").to_pylist(), asks.column("codes")):
            c = np.frombuffer(codes.as_buffer(), np.int64)
            at = np.minimum(np.searchsorted(code, c), len(code) - 1) if len(code) else np.zeros(len(c), np.int64)
            hit = code[at] == c if len(code) else np.zeros(len(c), bool)
            if hit.any():
                out.append((block, c[hit].tobytes(), ids[at[hit]].tobytes()))
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"block": pa.array(cols[0], pa.int64()), "codes": pa.array(cols[1], pa.binary()),
                         "ids": pa.array(cols[2], pa.binary())})

    def place(key, stream, names):
        import numpy as np
        import pyarrow as pa
        pairs = [np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in names.column(c).to_pylist())])
                 for c in ("codes", "ids")]
        order = np.argsort(pairs[0])
        code, ids = pairs[0][order], pairs[1][order]
        codes, at = _codes(stream.column("words")[0], stream.column("grams")[0], size)
        if len(ids) and ids.max() >> 31:
            raise OverflowError(TOO_MANY)
        new = np.full(len(stream.column("words")[0].as_buffer()) // 4, -1, np.int32)
        if len(code):
            found = np.minimum(np.searchsorted(code, codes), len(code) - 1)
            hit = code[found] == codes
            new[at[hit]] = ids[found[hit]]
        return pa.table({"block": stream.column("block"), "words": stream.column("words"),
                         "grams": pa.array([new.tobytes()], pa.binary())})

    streams = streams.select("block", "words", "grams")
    asks = streams.mapInArrow(ask, "bucket long, block long, codes binary")
    names = phrases.select("left", "right", "id").mapInArrow(name, "bucket long, code long, id long")
    answers = asks.groupBy("bucket").cogroup(names.groupBy("bucket")).applyInArrow(
        answer, "block long, codes binary, ids binary")
    return streams.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        place, "block long, words binary, grams binary")


def count_table(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, totals): phrases(words, f) has every phrase of 1 to
    ``max_words`` words that occurs ``least`` times or more in a language, as
    the ids of its words; vocabulary(id, word, lang, f); totals(lang, n)."""
    with arrow_bytes(docs.sparkSession, BATCH):
        return _count_table(docs, max_words, least)


def _count_table(docs: DataFrame, max_words: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    numbered = Stored(number_blocks(docs), "blocks", ROW_GROUP)
    blocks = numbered.df
    totals = stored(blocks.select(F.explode(F.arrays_zip("langs", "lang_counts")).alias("x")).groupBy(
        F.col("x.langs").alias("lang")).agg(F.sum("x.lang_counts").alias("n")), "totals")
    counted = blocks.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy(
        F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("f")).where(F.col("f") >= least)
    vocabulary = stored(ranked(counted, ["key"]), "vocabulary")
    # A key is a word, a space and the language.
    named = vocabulary.selectExpr("id", "substring_index(key, ' ', 1) as word", "substr(key, instr(key, ' ') + 1) as lang", "f")
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = max(64, -(-tokens // BUCKET_CODES))
    streams = Stored(word_streams(blocks, vocabulary), "streams", ROW_GROUP)
    numbered.drop()   # tables of the size of the corpus go as soon as the next one is there
    tables = [vocabulary.select(F.array("id").alias("words"), "id", "f")]
    for size in range(2, max_words + 1):
        phrases = stored(ranked(count_phrases(streams.df, size, least, buckets), ["left", "right"]), "phrases")
        before = tables[-1].select(F.col("id").alias("left"), F.col("words").alias("head"))
        tables.append(stored(phrases.join(before, "left").select(
            F.concat("head", F.array("right")).alias("words"), "id", "f"), "phrases"))
        old = streams
        if size < max_words:
            streams = Stored(phrase_streams(old.df, phrases, size, buckets), "streams", ROW_GROUP)
        old.drop()
    return union([t.select("words", "f") for t in tables]), named, totals


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP,
                 covered_percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of ``docs(lang, text)``.

    Texts (null: empty) are split at ``[.,;:!?`` and line ends ``]``, then at
    spaces and tabs; A-Z become lower case; a null lang is "und". A candidate
    has 2 to ``max_words`` words and a >= ``least`` occurrences. Its score is
    the least floor(1000000 * a * a / (l * r)) over its cuts (l and r count
    the two parts; of equal cuts the first counts). A candidate inside a
    longer one that has ``covered_percent`` of its occurrences or more is
    left out. Ties go by a, then by the phrase's bytes. A repeated row counts
    again; other columns are ignored; an empty table gives no rows.
    """
    phrases, vocabulary, totals = count_table(docs, max_words, least)
    phrases = stored(phrases, "counted")
    long = phrases.where(F.size("words") > 1)
    # Longer candidates name what they cover.
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> "
                   "transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    covers = (long.where(F.size("words") > 2).select(F.explode(inner).alias("words"), F.col("f").alias("longer"))
              .groupBy("words").agg(F.max("longer").alias("longer")))
    kept = long.join(covers, "words", "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("f"))).select("words", F.col("f").alias("a"))
    cuts = kept.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k")).selectExpr(
        "words", "a", "k", "slice(words, 1, k) as first", "slice(words, k + 1, size(words) - k) as rest")
    part = phrases.withColumnRenamed("words", "part")
    cuts = (cuts.join(part.withColumnsRenamed({"part": "first", "f": "l"}), "first")
            .join(part.withColumnsRenamed({"part": "rest", "f": "r"}), "rest"))
    whole = "cast({} as decimal(38, 0))"
    scored = cuts.withColumn("score", F.expr(
        f"(1000000 * {whole.format('a')} * a) div ({whole.format('l')} * r)").cast("long"))
    best = stored(scored.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
                  .withColumn("phrase_id", F.monotonically_increasing_id()), "scored")
    spelled = (best.select("phrase_id", F.posexplode("words").alias("at", "id")).join(vocabulary, "id")
               .groupBy("phrase_id").agg(F.min("lang").alias("lang"), F.expr(
                   "concat_ws(' ', transform(array_sort(collect_list(struct(at, word))), x -> x.word))").alias("phrase")))
    listed = stored(best.join(spelled, "phrase_id").selectExpr(
        "lang", "phrase", "a", "c.l as l", "c.r as r", "c.score as score", "-c.score as falling", "-a as fewer", "1L as one"),
        "listed")
    # Places by a sort over all rows: a language with most phrases is dealt over many tasks.
    placed = stored(running(listed, None, ["lang", "falling", "fewer", "phrase"], sums=["one"]), "placed")
    starts = placed.groupBy("lang").agg(F.min("run_one").alias("start"))
    return (placed.join(starts, "lang").join(totals, "lang").withColumn("rank", F.col("run_one") - F.col("start") + 1)
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the 2,000 best phrases of two and three words of each language of all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = r"""
with pieces as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece
  from (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                       'abcdefghijklmnopqrstuvwxyz') as text from documents)),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w)) as n from words group by lang),
grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from words, (values (1), (2), (3)) as sizes(m) where len(w) >= m),
counted as (select lang, m, phrase, count(*) as f, string_split(phrase, ' ') as w from grams group by lang, m, phrase),
candidates as (select * from counted where m > 1 and f >= 10),
covers as (
  select lang, phrase, max(f) as longer from (
    select lang, f, array_to_string(w[1:2], ' ') as phrase from candidates where m = 3
    union all select lang, f, array_to_string(w[2:3], ' ') from candidates where m = 3) group by lang, phrase),
kept as (
  select c.* from candidates c left join covers v using (lang, phrase)
  where not coalesce(c.m = 2 and 100 * v.longer >= 50 * c.f, false)),
cuts as (
  select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f) as score
  from kept c, (values (1), (2)) as cut(k), counted l, counted r
  where k < c.m and l.lang = c.lang and r.lang = c.lang
    and l.phrase = array_to_string(c.w[1:k], ' ') and r.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as o from cuts),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest where o = 1)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from placed join totals using (lang) where rank <= 2000
"""
