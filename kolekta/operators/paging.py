"""Detail-table paging and display heads.

``detail_page`` plans as TakeOrderedAndProject(limit, offset): each task keeps
its own top ``offset + size`` rows, so there is no global sort of the table.
For deep pages use ``page_after`` (keyset paging), whose cost does not grow
with the page number. The page count comes from a scalar subquery, executed
once and inlined, not a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta import vocab


def page_count(df: DataFrame, size: int = vocab.PAGE_SIZE) -> F.Column:
    """``max(1, ceil(n / size))`` as a scalar subquery column."""
    return df.select(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(size))).cast("bigint")).scalar()


def detail_page(df: DataFrame, page: int = 1, size: int = vocab.PAGE_SIZE, key: str = "invoice_id",
                columns: tuple[str, ...] = vocab.DETAIL_COLUMNS, records: int | None = None) -> DataFrame:
    """Page ``page`` (1-based) of the display columns, in key order, with the
    page number and the page count. ``records``: the number of rows if it is
    known (the mart has it), so that the table is not counted for it."""
    rows = df.orderBy(key).offset((page - 1) * size).limit(size)
    pages = page_count(df, size) if records is None else F.lit(max(1, -(-records // size))).cast("bigint")
    return rows.select(key, *columns, F.lit(page).cast("bigint").alias("page"), pages.alias("pages"))


def page_after(df: DataFrame, last_key: str | None, size: int = vocab.PAGE_SIZE, key: str = "invoice_id",
               columns: tuple[str, ...] = vocab.DETAIL_COLUMNS) -> DataFrame:
    """Keyset page: the ``size`` rows after ``last_key`` in key order."""
    rows = df if last_key is None else df.where(F.col(key) > F.lit(last_key))
    return rows.orderBy(key).limit(size).select(key, *columns)


def table_head(df: DataFrame, n: int = vocab.TABLE_HEAD, order: tuple[str, ...] | None = None) -> DataFrame:
    """The first ``n`` rows in a fixed order (the primary key by default)."""
    order = order or (df.columns[0],)
    return df.orderBy(*order).limit(n)
