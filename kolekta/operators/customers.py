"""Customer roll-up (the import's per customer-and-month table), the top-N
over-due list and the over-due band.

The roll-up groups on (customer, month): a high-cardinality key, shuffled once
after map-side partial aggregation, so a customer holding a third of all rows
still reaches the reducer as one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import sql_str, strip_sql, sum_if
from kolekta.operators.filters import active

AMT = "nilai_m"


def customer_rollup(inv: DataFrame) -> DataFrame:
    """Per (customer, month): balance, within-due, over-due (any aging other
    than ``Within Due``) in millions (x1000, round 2), the count of over-due
    rows and the clamped over-due percent. Blank customer names are dropped."""
    within = f"aging_category = {sql_str(vocab.WITHIN_DUE)}"
    over = f"NOT (aging_category <=> {sql_str(vocab.WITHIN_DUE)})"
    f = inv.where(F.expr(f"coalesce({strip_sql('customer_name')}, '') <> ''"))
    # The names are cut to the table's width first: two that are equal then are one customer.
    f = f.withColumns({"customer_name": F.substring("customer_name", 1, 100), "report_month": F.substring("report_month", 1, 20)})
    g = f.groupBy("customer_name", "report_month").agg(
        sum_if().alias("_b"), sum_if(within).alias("_w"), sum_if(over).alias("_o"),
        F.expr(f"count(CASE WHEN {over} THEN 1 END)").alias("due_invoices"))
    pct = "CASE WHEN _b > 0 THEN cast(_o as double) / cast(_b as double) * 100 ELSE 0.0 END"
    return g.selectExpr(
        "customer_name", "report_month",
        "cast(round(_b * 1000, 2) as double) AS balance", "cast(round(_w * 1000, 2) as double) AS within_due",
        "cast(round(_o * 1000, 2) as double) AS over_due", f"round(greatest(0.0, least(100.0, {pct})), 2) AS overdue_pct",
        "cast(due_invoices as bigint) AS due_invoices", "cast(0 as int) AS above_credit_limit")


def top_customers(cust: DataFrame, month: str | None = None, n: int = vocab.TOP_CUSTOMERS) -> DataFrame:
    """Top ``n`` by over-due, largest first with nulls first (Oracle's DESC
    default), ties broken by name and month. Planned as a per-partition top-n
    (TakeOrderedAndProject), so no global sort of the table; the rank window
    then sees only ``n`` rows."""
    if active(month):
        cust = cust.where(F.col("report_month") == F.lit(month))
    order = [F.col("over_due").desc_nulls_first(), F.col("customer_name").asc(), F.col("report_month").asc()]
    top = cust.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def customer_band(cust: DataFrame, hi: float = vocab.BAND_HIGH, mid: float = vocab.BAND_MEDIUM) -> DataFrame:
    """Over-due band: above ``hi`` high, above ``mid`` medium, else low."""
    p = F.col("overdue_pct")
    band = F.when(p > hi, "high").when(p > mid, "medium").otherwise("low")
    return cust.select("customer_name", "report_month", "overdue_pct", band.alias("band"))
