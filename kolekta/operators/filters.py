"""Predicates: dashboard filters, flow drill-downs and the detail-table search.

Every function returns a lazy, filtered DataFrame; Catalyst pushes the
equality predicates into the Parquet scan (and prunes ``report_month``
partitions when the fact table is stored partitioned by month).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import is_home, sql_str

FILTER_COLUMNS = (("month", "report_month"), ("segment", "pengelolaan"), ("region", "region"))


def active(value: str | None) -> bool:
    """``None``, ``""`` and ``"ALL"`` mean "no predicate"."""
    return bool(value) and value != "ALL"


def filter_predicates(month: str | None = None, segment: str | None = None,
                      region: str | None = None) -> list[Column]:
    given = {"month": month, "segment": segment, "region": region}
    return [F.col(col) == F.lit(given[key]) for key, col in FILTER_COLUMNS if active(given[key])]


def filter_invoices(inv: DataFrame, month: str | None = None, segment: str | None = None,
                    region: str | None = None) -> DataFrame:
    """Month / segment / region equality, ANDed; exact and case-sensitive."""
    for p in filter_predicates(month, segment, region):
        inv = inv.where(p)
    return inv


def active_filters(month: str | None = None, segment: str | None = None,
                   region: str | None = None) -> dict[str, str]:
    return {"month": month or "ALL", "segment": segment or "ALL", "region": region or "ALL"}


# --- drill-down -------------------------------------------------------------

def _equals(column: str):
    """Equality is plain: null never matches."""
    return lambda value, home: F.col(column) == F.lit(value)


def _layak(value=None, home=None) -> Column:
    return F.col("status_tagih") == F.lit(vocab.LAYAK)


def _at_home(value, home) -> Column:
    """``lower(trim(region)) == home``; a null region is not home."""
    return is_home("region", home)


def _all(*tests):
    return lambda value, home: reduce(and_, (t(value, home) for t in tests))


def _not(test):
    return lambda value, home: ~test(value, home)


# Node of the flow chart -> predicate of (value, home).
DRILLS = {
    "status": _equals("status_tagih"),
    "home": _all(_layak, _at_home),
    "regional": _all(_layak, _not(_at_home)),
    "home_invoice": _all(_layak, _at_home, _equals("status_invoice")),
    "category": _equals("invoice_status"),
    "region": _all(_layak, _not(_at_home), _equals("region")),
    "aging": _equals("aging_category"),
}


def drill_predicate(kind: str, value: str | None = None, home: str = vocab.HOME_REGION) -> Column:
    """Predicate of one flow-chart node."""
    if kind not in DRILLS:
        raise ValueError(f"unknown drill-down type: {kind!r}")
    return DRILLS[kind](value, home)


def drilldown(inv: DataFrame, kind: str, value: str | None = None, home: str = vocab.HOME_REGION) -> DataFrame:
    return inv.where(drill_predicate(kind, value, home))


# --- search -------------------------------------------------------------------

def search_sql(q: str, columns: tuple[str, ...] = vocab.SEARCH_COLUMNS) -> str:
    """The search predicate for one needle, as SQL text."""
    needle = sql_str(q.lower())
    return " OR ".join(f"contains(lower(coalesce({c}, '')), {needle})" for c in columns)


def search_invoices(inv: DataFrame, q: str | None, columns: tuple[str, ...] = vocab.SEARCH_COLUMNS) -> DataFrame:
    """Case-insensitive literal substring over the searchable columns (null as '');
    an empty query returns every row."""
    return inv.where(F.expr(search_sql(q, columns))) if q else inv


def distinct_values(inv: DataFrame, col: str, drop_blank: bool = False) -> DataFrame:
    """Distinct non-null values of one column, ascending (a dropdown list)."""
    v = F.col(col)
    cond = v.isNotNull() & (v != F.lit("")) if drop_blank else v.isNotNull()
    return inv.select(v.alias("value")).where(cond).distinct().orderBy("value")


BASE_COLUMNS = ("invoice_id", "aging_category", "status_tagih", "region", "invoice_status", "nilai_m", "uic",
                "due_date", "action_plan")


def base_projection(inv: DataFrame, columns: tuple[str, ...] = BASE_COLUMNS) -> DataFrame:
    """The nine-column detail feed, cleaned: null amount -> 0, null text -> ''."""
    from kolekta.operators.quality import clean_invoices
    return clean_invoices(inv.select(*columns))
