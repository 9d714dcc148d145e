"""Explicit schemas of the five receivables tables, and ``conform`` for the
older table layouts (missing columns become typed nulls)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DecimalType, IntegerType, LongType, StringType, StructField,
                               StructType)

S, AMOUNT, MONEY, PCT = StringType(), DecimalType(18, 6), DecimalType(18, 2), DecimalType(8, 2)

INVOICE = StructType([
    StructField("invoice_id", S, False),
    StructField("customer_name", S), StructField("aging_category", S), StructField("status_tagih", S),
    StructField("region", S), StructField("invoice_status", S), StructField("nilai_m", AMOUNT),
    StructField("uic", S), StructField("due_date", S), StructField("action_plan", S),
    StructField("above_credit_limit", IntegerType()), StructField("report_month", S),
    StructField("pengelolaan", S), StructField("bp_num", S), StructField("nipnas", S), StructField("witel", S),
    StructField("satker", S), StructField("reg", S), StructField("status_invoice", S),
])
INVOICE_OPTIONAL = (StructField("invoice_date", DateType()),)

TOP_CUSTOMERS = StructType([
    StructField("customer_name", S, False), StructField("report_month", S, False),
    StructField("balance", MONEY), StructField("within_due", MONEY), StructField("over_due", MONEY),
    StructField("overdue_pct", PCT), StructField("due_invoices", LongType()),
    StructField("above_credit_limit", IntegerType()),
])
CASH_INFLOW = StructType([
    StructField("month_label", S, False), StructField("sort_order", IntegerType()),
    StructField("actual_receipts", MONEY), StructField("estimated_receipts", MONEY),
    StructField("forecasted_receipts", MONEY),
])
TREND_T13M = StructType([
    StructField("month_label", S, False), StructField("sort_order", IntegerType()),
    StructField("within_due", MONEY), StructField("over_due", MONEY), StructField("credit_sales", MONEY),
])
METRICS_HISTORY = StructType([
    StructField("month_label", S, False), StructField("sort_order", IntegerType()),
    StructField("overdue_pct", PCT), StructField("dso", PCT),
])

# Allow-listed tables: name -> (schema, primary key, partition column).
TABLES = {
    # The invoice id carries no year, so the month is part of the key.
    "ar_segmen_ers_tbl": (INVOICE, ("invoice_id", "report_month"), "report_month"),
    "ar_cash_inflow_forecast_tbl": (CASH_INFLOW, ("month_label",), None),
    "ar_trend_t13m_tbl": (TREND_T13M, ("month_label",), None),
    "ar_metrics_history_tbl": (METRICS_HISTORY, ("month_label",), None),
    "ar_top_customers_tbl": (TOP_CUSTOMERS, ("customer_name", "report_month"), "report_month"),
}

# Values of columns that an inserted row does not supply.
DEFAULTS = {"ar_segmen_ers_tbl": {"above_credit_limit": 0}, "ar_top_customers_tbl": {"above_credit_limit": 0}}


def table_spec(name: str):
    key = name.lower()
    if key not in TABLES:
        raise ValueError(f"invalid table name: {name!r}")
    return TABLES[key]


def lower_cols(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def normalise_headers(df: DataFrame, case: str | None = None) -> DataFrame:
    """Trim header names (and optionally upper/lower-case them)."""
    names = [c.strip() for c in df.columns]
    if case == "upper":
        names = [c.upper() for c in names]
    elif case == "lower":
        names = [c.lower() for c in names]
    return df.toDF(*names)


def conform(df: DataFrame, schema: StructType = INVOICE) -> DataFrame:
    """Project any table variant onto the canonical schema: lower-case names,
    cast known columns, add missing ones as typed nulls, keep optional extras."""
    df = lower_cols(df)
    cols = [(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields]
    extras = [F.col(f.name).cast(f.dataType).alias(f.name) for f in INVOICE_OPTIONAL
              if schema is INVOICE and f.name in df.columns]
    return df.select(*cols, *extras)
