"""Token counts: the exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kolekta.llm.common import blocks, byte_texts, read_table, stored

#: Lengths of one part of the histogram; suffix sums run within parts, then over them.
PART = 1024


def default_ranks() -> tuple[str, list[tuple[bytes, int]]]:
    """(pattern, ranks) of the 50k byte-level vocabulary."""
    import base64

    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return public_tokenizers.PATTERN, [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def histogram(docs: DataFrame, ranks: tuple[str, list[tuple[bytes, int]]] | None = None) -> DataFrame:
    """(n_tokens, docs): how many whole texts have each encoded length.

    Tasks count the lengths of their own texts first, so what is shuffled
    grows with the number of distinct lengths. Null text counts as empty
    (length 0); repeated rows count each; no rows give no lengths.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks or default_ranks())

    def count(batches):
        import collections

        import pyarrow as pa
        import tiktoken
        pattern, pairs = held.value
        codec = tiktoken.Encoding("held", pat_str=pattern, mergeable_ranks=dict(pairs), special_tokens={})
        found = collections.Counter()
        for b in batches:
            texts = byte_texts(b.column(0))
            for i, k in blocks(texts):
                found.update(len(codec.encode_ordinary(t.decode())) for t in texts[i:k])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                         ["n_tokens", "docs"])

    return (docs.select("text").mapInArrow(count, "n_tokens long, docs long")
            .groupBy("n_tokens").agg(F.sum("docs").alias("docs")))


def limits(lengths: DataFrame) -> DataFrame:
    """For every length of ``histogram`` as a context limit:

    n_tokens (the limit), docs (of just that length), docs_within and
    tokens_within (documents no longer, and their tokens), docs_beyond and
    tokens_beyond, total_truncated (tokens if longer documents are cut to
    the limit) and share_within (the quantile at which the limit stands).

    Suffix sums run inside parts of PART lengths and over the parts' sums,
    so no window holds more than a part. Between two neighbouring lengths
    every figure but total_truncated stays; that grows by docs_beyond a token.
    """
    part = F.floor(F.col("n_tokens") / PART).alias("part")
    rows = lengths.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), part)
    sums = rows.groupBy("part").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each PART lengths
    every = Window.partitionBy()
    sums = sums.select("part", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"),
                       F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"),
                       F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    longer = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, "part").select(
        "n_tokens", "docs", "all_docs", "all_tokens",
        (F.col("d") + F.coalesce(F.sum("docs").over(longer), F.lit(0))).alias("docs_beyond"),
        (F.col("t") + F.coalesce(F.sum("tokens").over(longer), F.lit(0))).alias("tokens_beyond"))
    return rows.selectExpr(
        "n_tokens", "docs", "all_docs - docs_beyond as docs_within", "all_tokens - tokens_beyond as tokens_within",
        "docs_beyond", "tokens_beyond", "all_tokens - tokens_beyond + n_tokens * docs_beyond as total_truncated",
        "(all_docs - docs_beyond) / all_docs as share_within")


def total_truncated(table: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to ``limit`` (0 for an empty table), from ``limits``."""
    at = table.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).limit(1)
    row = at.select("total_truncated", "docs_beyond", "n_tokens").first()
    if row:
        return row[0] + (limit - row[2]) * row[1]
    return limit * (table.agg(F.sum("docs")).first()[0] or 0)


def quantile(table: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents do not exceed; null for an empty table."""
    return table.where(F.col("share_within") >= share).agg(F.min("n_tokens")).first()[0]


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the histogram of all documents and its figures for every limit."""
    # Stored, since its figures are used twice: the texts are encoded once.
    return limits(stored(histogram(read_table(spark, sf_dir, "documents")), "lengths"))
