"""The corpus pipeline: documents in, clean encoded documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next one's docs.

All stages take null and empty texts (as empty), texts of any length, null
doc_ids, repeated rows, extra columns of any name (they pass through all but
the last) and empty tables (which give empty ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kolekta.llm import decontaminate, pieces, quality, simhash, toxicity
from kolekta.llm.common import read_table, stored


def fluent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the perplexity thresholds of their language, by characters and by words.

    An empty text is judged as the mean of trusted text; a null or rare language
    takes the threshold of all. Repeated rows share their fate; a score equal to the threshold stays."""
    return quality.keep_fluent(docs, read_table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold (a score equal to it goes).

    An empty text has the score of the model's bias; repeated rows share their fate."""
    return toxicity.keep_civil(docs, read_table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each SimHash component.

    Texts without words are one component. Of rows that repeat that id within the
    component one stays, that of the least fingerprint and text; an id with unlike
    texts stands for each of their components; rows of null doc_id all stay."""
    return simhash.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words no benchmark item is covered to the threshold (a coverage equal to it goes).

    Empty texts stay; repeated rows share their fate; null ids and texts of items take no part."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids with their byte spans, and whether decoding gives the text back.

    An empty text has the begin and end ids alone; every row comes back, repeated ones too."""
    rows = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return rows.selectExpr("doc_id", "lang", "source", "n_tokens", "ids", "begins", "ends",
                           "decoded <=> coalesce(text, '') as round_trip")


STAGES = [
    ("quality", fluent),
    ("toxicity", civil),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

#: SQL expresses neither the trained models nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
