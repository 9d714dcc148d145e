"""SQL fragments for the DuckDB cross-check of every registered query.

The oracle restates each operator's semantics in plain SQL over the same
stand-in views (FIXTURES.md section 3), so an independent engine checks the
Spark plans. Vocabulary lists are spliced in from ``kolekta.vocab``.
"""

from __future__ import annotations

from kolekta import vocab
from kolekta.schemas import INVOICE
from kolekta.sources.fixtures import INFLOW_SQL, INVOICE_SQL, METRICS_SQL, TOP_CUSTOMERS_SQL, TREND_SQL, sql_for_duckdb

FACT_COLS = tuple(INVOICE.names)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def S(cond: str | None = None, amt: str = "nilai_m") -> str:
    return f"coalesce(sum({amt if cond is None else f'case when {cond} then {amt} end'}), 0)"


def M(x: str, n: int = 4) -> str:
    return f"cast(round({x}, {n}) as double)"


def PCT(num: str, den: str, positive_only: bool = True) -> str:
    op = ">" if positive_only else "<>"
    return f"case when cast({den} as double) {op} 0 then round(cast({num} as double) / cast({den} as double) * 100, 2) else 0.0 end"


def ST(v: str) -> str:
    return f"status_tagih = {q(v)}"


HOME = f"coalesce(lower(trim(region)) = {q(vocab.HOME_REGION)}, false)"
KEEP = f"status_tagih is distinct from {q(vocab.TIDAK_LAYAK)}"
# The stand-in labels are a month's name and a year; written out here, apart from the library's rule.
_MONTHS = ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November",
           "Desember")
MONTH_ORD = ("cast(cast(split_part(report_month, ' ', 2) as integer) * 12 + list_position(["
             + ", ".join(f"'{m}'" for m in _MONTHS) + "], split_part(report_month, ' ', 1)) as integer)")

WITH_INV = "with ar_invoice as (" + sql_for_duckdb(INVOICE_SQL) + ")"
TREND = sql_for_duckdb(TREND_SQL)
METRICS = sql_for_duckdb(METRICS_SQL)
INFLOW = sql_for_duckdb(INFLOW_SQL)
TOP_CUST = sql_for_duckdb(TOP_CUSTOMERS_SQL)


def fact_select(src: str = "ar_invoice") -> str:
    cols = ", ".join("cast(nilai_m as double) as nilai_m" if c == "nilai_m" else c for c in FACT_COLS)
    return f"select {cols} from {src}"


def where(*conds: str) -> str:
    conds = [c for c in conds if c]
    return (" where " + " and ".join(conds)) if conds else ""


def filters_sql(month=None, segment=None, region=None) -> str:
    parts = []
    for val, col in ((month, "report_month"), (segment, "pengelolaan"), (region, "region")):
        if val and val != "ALL":
            parts.append(f"{col} = {q(val)}")
    return " and ".join(parts)
