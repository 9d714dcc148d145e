"""Small tables for the tests: awkward rows, and plain-Python helpers."""

import zlib

ODD = [
    (1, "The quick brown fox jumps over the lazy dog. And then it rests for a while."),
    (2, None), (3, ""), (4, " \t\n\x0b "), (5, "word"), (6, "two words"),
    (7, "Ünïcode ÀÉ 日本語 👩‍👩‍👧 ▁ <|endoftext|> don't   x　y"),
    (8, "long " * 30000), (9, "x" * 20000),
    (1, "The quick brown fox jumps over the lazy dog. And then it rests for a while."),
    (None, "no id here, but a text of some words"), (-5, "X<|ENDOFTEXT|>Y <|startoftext|> \u0130X E\u0301LAN CAN'T can't \u212a WORD. word"),
]


def odd_documents(spark, rows=ODD):
    """documents with nulls, empty and long texts, a repeated row, and columns whose names clash."""
    names = ("score, fingerprint, component_id, coverage, item_id, log_perplexity, threshold, tiled, word, rank, q, p")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{n.strip()} string" for n in names.split(","))
    extra = ("e",) * len(names.split(","))
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None, None) + extra for i, t in rows], schema)


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
