"""Month-level history: per-month totals, stacked series, month lists, and the
small pre-computed series tables (trend, cash inflow, metric sparklines).

Windows here run only on already-aggregated rows (one per month, or the
metric table's dozen rows), never on fact rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import money_sql, month_ord, total
from kolekta.operators.filters import filter_invoices
from kolekta.operators.summary import AMT, long_rows, status_sums


def history_trend(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Per report month (null month dropped): total and the three status sums,
    plus the calendar ordinal of the month label."""
    f = filter_invoices(inv, month, segment, region).where(F.col("report_month").isNotNull())
    g = f.groupBy("report_month").agg(*status_sums())
    return g.select("report_month", month_ord("report_month").alias("month_ord"),
                    *[F.expr(f"{money_sql(src)} AS {dst}") for src, dst in
                      (("_total", "total_m"), ("_layak", "layak_m"), ("_tidak", "tidak_layak_m"),
                       ("_bermasalah", "bermasalah_m"))])


STACK_SERIES = ((1, "layak_m", vocab.LAYAK), (2, "bermasalah_m", vocab.BERMASALAH), (3, "tidak_layak_m", vocab.TIDAK_LAYAK))


def history_stack(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Stacked-bar geometry per month: each series' value and its [y0, y1)
    offsets, stacking collectible, problematic, uncollectible."""
    f = filter_invoices(inv, month, segment, region).where(F.col("report_month").isNotNull())
    a = F.col(AMT)
    g = f.groupBy("report_month").agg(
        *[F.round(total(a, F.col("status_tagih") == F.lit(st)), 4).alias(name) for _, name, st in STACK_SERIES])
    rows = [(F.col("report_month"), o, name, F.col(name)) for o, name, _ in STACK_SERIES]
    long = long_rows(g, rows, ("report_month", "_o", "series", "_v"))
    w = Window.partitionBy("report_month").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y1 = F.sum("_v").over(w)
    return long.select("report_month", "series", F.col("_v").cast("double").alias("v"),
                       (y1 - F.col("_v")).cast("double").alias("y0"), y1.cast("double").alias("y1"))


def distinct_months(inv: DataFrame, chronological: bool = False) -> DataFrame:
    """Months present, numbered: lexical descending (the dropdown's order) or
    calendar ascending. The numbering window sees one row per month."""
    m = inv.select("report_month").where(F.col("report_month").isNotNull()).distinct()
    if chronological:
        m = m.withColumn("month_ord", month_ord("report_month"))
        w = Window.orderBy(F.col("month_ord").asc_nulls_last(), F.col("report_month").asc())
        return m.select(F.row_number().over(w).cast("bigint").alias("ord"), "report_month", "month_ord")
    w = Window.orderBy(F.col("report_month").desc())
    return m.select(F.row_number().over(w).cast("bigint").alias("ord"), "report_month")


def ordered(series: DataFrame, key: str = "sort_order") -> DataFrame:
    """A pre-computed series table (a dozen display months) in its display order."""
    return series.orderBy(key)


def sparkline(metrics: DataFrame) -> DataFrame:
    """One row of arrays (overdue_pct[], dso[], months[]) in ``sort_order``.
    The metric table is a bounded series (one row per displayed month)."""
    s = F.array_sort(F.collect_list(F.struct("sort_order", "month_label", "overdue_pct", "dso")))
    g = metrics.agg(s.alias("_s"))
    return g.select(F.transform("_s", lambda x: x["overdue_pct"]).alias("overdue_pct"),
                    F.transform("_s", lambda x: x["dso"]).alias("dso"),
                    F.transform("_s", lambda x: x["month_label"]).alias("months"))


def sparkline_rows(metrics: DataFrame) -> DataFrame:
    """The sparkline arrays exploded back with their 1-based position."""
    z = sparkline(metrics).select(F.posexplode(F.arrays_zip("months", "overdue_pct", "dso")).alias("pos", "z"))
    return z.select((F.col("pos") + 1).cast("int").alias("ord"), F.col("z.months").alias("month_label"),
                    F.col("z.overdue_pct").alias("overdue_pct"), F.col("z.dso").alias("dso"))


def sparkline_scaled(metrics: DataFrame, col: str = "overdue_pct") -> DataFrame:
    """Min-max scaling of one metric to [0, 1]; a flat series divides by 1."""
    w = Window.partitionBy()
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    return metrics.select("sort_order", F.col(col).cast("double").alias("v"),
                          F.round((F.col(col) - lo) / rng, 6).alias("scaled"))
