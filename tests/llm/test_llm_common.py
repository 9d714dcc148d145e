"""Helpers of the text operators."""

import pyarrow as pa

from kolekta.llm.common import COLUMN_BYTES, text_blocks, with_text_columns


def test_text_blocks_cover_the_column_in_order():
    texts = ["a" * 30, None, "", "é" * 20, "b" * 200, "c"]
    column = pa.array(texts, pa.string())
    for most in (1, 32, 64, 10_000):
        got = list(text_blocks(column, most))
        assert [i for i, _, _ in got] == [0, *(k for _, k, _ in got[:-1])] and got[-1][1] == len(texts)
        assert [t for _, _, part in got for t in part] == [(t or "").encode() for t in texts]
        assert all(sum(map(len, part[:-1])) < most for _, _, part in got)
    assert list(text_blocks(pa.array([], pa.string()))) == []


def test_columns_are_made_of_a_megabyte_at_once(spark):
    """A worker holds the columns of about COLUMN_BYTES of text, however many rows a batch has."""
    docs = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('words ', 2000) as text")
    rows = with_text_columns(docs, {"n": "long", "held": "long"}, lambda t: [list(map(len, t)), [sum(map(len, t))] * len(t)]).collect()
    assert [r.id for r in rows] == list(range(300)) and all(r.n == 12000 for r in rows)
    assert 12000 < max(r.held for r in rows) <= COLUMN_BYTES + 12000
