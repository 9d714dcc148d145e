"""KPIs and breakdowns of the invoice fact table.

Design: every KPI is a conditional sum inside ONE global ``agg`` (partial
aggregation per task, one tiny exchange of a single row per task), so the
whole summary costs one scan however many measures it has. The breakdowns
group on low-cardinality dimension columns (segment, region, category,
month) and the account pivot on (account, customer, month); all combine
map-side before the shuffle, which also neutralises a hot key.
Amounts stay ``decimal`` until the final ``round``, then leave as ``double``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import money, money_sql, month_ord, not_equal_ns, pct_sql, safe_pct, sql_str, sum_if, total
from kolekta.operators.filters import active, filter_invoices

AMT = "nilai_m"


def _status(v: str) -> Column:
    return F.col("status_tagih") == F.lit(v)


def _is(col: str, v: str) -> str:
    return f"{col} = {sql_str(v)}"


def long_rows(df: DataFrame, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """Turn one wide row into a few long rows (``inline`` of an array of
    structs -- a Generate in the same stage, no shuffle). ``rows`` holds tuples
    of Column/literal values, one tuple per output row."""
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    structs = [F.struct(*[lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return df.select(F.inline(F.array(*structs)))


def long_rows_sql(df: DataFrame, rows: list[tuple[str, ...]], names: tuple[str, ...]) -> DataFrame:
    """``long_rows`` with each value given as SQL text (one JVM call in all)."""
    structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for v, n in zip(r, names)) + ")" for r in rows)
    return df.selectExpr(f"inline(array({structs}))")


def status_sums() -> list[Column]:
    return [sum_if().alias("_total"), sum_if(_is("status_tagih", vocab.LAYAK)).alias("_layak"),
            sum_if(_is("status_tagih", vocab.TIDAK_LAYAK)).alias("_tidak"),
            sum_if(_is("status_tagih", vocab.BERMASALAH)).alias("_bermasalah")]


# --- AGG-1..3, AGG-22 -------------------------------------------------------

def kpi_summary(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Headline KPIs: status totals (round 4), over-due, its share, the constant
    DSO and the row count (null amounts included)."""
    g = filter_invoices(inv, month, segment, region).agg(*status_sums(), F.count(F.lit(1)).alias("total_records"))
    over = "(_tidak + _bermasalah)"
    return g.selectExpr(
        f"{money_sql('_total')} AS total_ar_m", f"{money_sql('_layak')} AS total_layak_tagih_m",
        f"{money_sql('_tidak')} AS total_tidak_layak_m", f"{money_sql('_bermasalah')} AS total_bermasalah_m",
        f"{money_sql(over)} AS over_due_m", f"{pct_sql(over, '_total')} AS overdue_pct",
        f"cast({vocab.DSO_CONSTANT} as int) AS dso", "cast(total_records as bigint) AS total_records")


def minimal_summary(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """The short summary: total, collectible, uncollectible (round 2) and the row count."""
    g = filter_invoices(inv, month, segment, region).agg(*status_sums(), F.count(F.lit(1)).alias("_n"))
    return g.select(money("_total", 2).alias("total_ar_m"), money("_layak", 2).alias("total_layak_tagih_m"),
                    money("_tidak", 2).alias("total_tidak_layak_m"), F.col("_n").cast("bigint").alias("total_records"))


def kpi_by_aging(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Alternative KPI: current = aging ``Within Due``, past due = any other
    (null aging counts as past due)."""
    a = F.col(AMT)
    within = F.col("aging_category") == F.lit(vocab.WITHIN_DUE)
    g = filter_invoices(inv, month, segment, region).agg(
        total(a).alias("_t"), total(a, within).alias("_w"),
        total(a, not_equal_ns("aging_category", vocab.WITHIN_DUE)).alias("_p"))
    return g.select(money("_t").alias("total_ar_m"), money("_w").alias("within_due_m"),
                    money("_p").alias("past_due_m"))


def kpi_shares(inv: DataFrame, month=None, segment=None, region=None,
               statuses: tuple[str, ...] = vocab.STATUSES) -> DataFrame:
    """Each status's amount and its share of the total (0 unless total > 0);
    one row per status, always present."""
    a = F.col(AMT)
    g = filter_invoices(inv, month, segment, region).agg(
        total(a).alias("_t"), *[total(a, _status(s)).alias(f"_s{i}") for i, s in enumerate(statuses)])
    rows = [(sql_str(s), money_sql(f"_s{i}"), pct_sql(f"_s{i}", "_t")) for i, s in enumerate(statuses)]
    return long_rows_sql(g, rows, ("status_tagih", "v", "pct_of_total"))


def critical_aging(inv: DataFrame, month=None, segment=None, region=None,
                   bucket: str = vocab.AGING_BUCKETS[-1]) -> DataFrame:
    """Amount in the oldest aging bucket and its share of the total."""
    a = F.col(AMT)
    g = filter_invoices(inv, month, segment, region).agg(
        total(a).alias("_t"), total(a, F.col("aging_category") == F.lit(bucket)).alias("_c"))
    return g.select(money("_c").alias("critical_m"), safe_pct("_c", "_t").alias("pct_of_total"))


# --- AGG-4 ------------------------------------------------------------------

def as_of(inv: DataFrame, month=None) -> DataFrame:
    """The month the numbers are "as of": the filter month when given, else
    the latest month present (by calendar order); null on an empty table."""
    if active(month):
        return inv.where(F.col("report_month") == F.lit(month)).agg(
            F.lit(month).alias("as_of_date"))
    # Distinct months first (partially aggregated), so the label parse runs
    # once per month rather than once per row.
    months = inv.select("report_month").where(F.col("report_month").isNotNull()).distinct()
    return months.agg(F.max_by("report_month", month_ord("report_month")).alias("as_of_date"))


# --- AGG-6/7, WIN-2 ---------------------------------------------------------

def group_sums(inv: DataFrame, key: str, value: str = "v", cond: Column | None = None) -> DataFrame:
    """Sum of the amount per non-null key (pandas groupby drops null keys),
    rounded to 4 decimals."""
    f = inv.where(F.col(key).isNotNull())
    if cond is not None:
        f = f.where(cond)
    return f.groupBy(key).agg(F.expr(f"{money_sql('coalesce(sum(cast(nilai_m as decimal(38,6))), 0)')} AS {value}"))


def segment_breakdown(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    return group_sums(filter_invoices(inv, month, segment, region), "pengelolaan")


def largest_segment(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Segment with the largest rounded sum; ties go to the smallest key; ``-`` when empty."""
    g = segment_breakdown(inv, month, segment, region)
    best = F.min_by("pengelolaan", F.struct(-F.col("v"), F.col("pengelolaan")))
    return g.agg(F.coalesce(best, F.lit("-")).alias("largest_segment"))


def segment_rank(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Positive segments ranked by amount, with percent of the largest (the
    denominator is at least 1). The window runs on the aggregated rows only
    (one per segment)."""
    g = segment_breakdown(inv, month, segment, region).where(F.col("v") > 0)
    w = Window.orderBy(F.col("v").desc(), F.col("pengelolaan").asc())
    top = F.greatest(F.max("v").over(Window.partitionBy()), F.lit(1.0))
    return g.select(F.row_number().over(w).cast("bigint").alias("rank"), "pengelolaan", "v",
                    F.round(F.col("v") / top * 100, 2).alias("pct_of_max"))


# --- AGG-8 ------------------------------------------------------------------

def age_analysis(inv: DataFrame, month=None, segment=None, region=None,
                 layout: tuple = vocab.AGE_ANALYSIS) -> DataFrame:
    """Eight fixed labels (3 status sums, 5 aging sums), always present."""
    g = filter_invoices(inv, month, segment, region).agg(
        *[sum_if(_is(col, val)).alias(f"_a{o}") for o, _, col, val in layout])
    return long_rows_sql(g, [(str(o), sql_str(lbl), money_sql(f"_a{o}")) for o, lbl, _, _ in layout],
                         ("ord", "label", "v"))


# --- AGG-9 ------------------------------------------------------------------

def category_breakdown(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Sum per invoice category, zero and negative sums included."""
    return group_sums(filter_invoices(inv, month, segment, region), "invoice_status")


# --- AGG-10, AGG-23, WIN-1, WIN-3 -------------------------------------------

def _region_share(f: DataFrame) -> DataFrame:
    g = f.where(F.col("region").isNotNull()).groupBy("region").agg(total(F.col(AMT)).alias("_s"))
    # Share of all non-null regions, negatives included, taken before the v > 0 filter.
    g = g.withColumn("_tot", F.sum("_s").over(Window.partitionBy()))
    return g.where(F.col("_s") > 0).selectExpr(
        "region", f"{money_sql('_s')} AS value", f"{pct_sql('_s', '_tot', positive_only=False)} AS percentage")


def region_breakup(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    return _region_share(filter_invoices(inv, month, segment, region))


def region_overdue(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Region breakup of over-due amounts only (aging other than ``Within Due``)."""
    f = filter_invoices(inv, month, segment, region)
    return _region_share(f.where(not_equal_ns("aging_category", vocab.WITHIN_DUE)))


def region_cumshare(inv: DataFrame, month=None, segment=None, region=None) -> DataFrame:
    """Donut slices: running share of the region values, in region order
    (total 0 is treated as 1)."""
    f = filter_invoices(inv, month, segment, region).where(F.col("region").isNotNull())
    g = f.groupBy("region").agg(total(F.col(AMT)).alias("_s")).where(F.col("_s") > 0)
    g = g.withColumn("_v", F.round("_s", 4))
    tot = F.sum("_v").over(Window.partitionBy())
    run = F.sum("_v").over(Window.orderBy("region").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    den = F.when(tot == 0, F.lit(1)).otherwise(tot).cast("double")
    return g.select("region", F.col("_v").cast("double").alias("value"),
                    F.round((run - F.col("_v")).cast("double") / den, 6).alias("start_share"),
                    F.round(run.cast("double") / den, 6).alias("end_share"))


# --- AGG-26 -----------------------------------------------------------------

def stack_by(inv: DataFrame, col: str, month=None, segment=None, region=None) -> DataFrame:
    """Amount per value of ``col`` split by collection status (stacked bars)."""
    a = F.col(AMT)
    f = filter_invoices(inv, month, segment, region).where(F.col(col).isNotNull())
    return f.groupBy(F.col(col).alias("key")).agg(
        money(total(a, _status(vocab.LAYAK))).alias("layak_m"),
        money(total(a, _status(vocab.BERMASALAH))).alias("bermasalah_m"),
        money(total(a, _status(vocab.TIDAK_LAYAK))).alias("tidak_layak_m"))


# --- AGG-29 -----------------------------------------------------------------

def category_column(cat: str) -> str:
    return "cat_" + "".join(ch if ch.isalnum() else "_" for ch in cat.lower())


def account_totals(inv: DataFrame, month=None, segment=None, region=None,
                   categories: tuple[str, ...] = vocab.CATEGORIES) -> DataFrame:
    """Per account and month: one column per category, the invoiced amount and
    the total (a pivot with a fixed value list, written as conditional sums)."""
    a = F.col(AMT)
    f = filter_invoices(inv, month, segment, region)
    cat = F.col("invoice_status")
    return f.groupBy("bp_num", "customer_name", "report_month").agg(
        *[money(total(a, cat == F.lit(c))).alias(category_column(c)) for c in categories],
        money(total(a, F.col("status_invoice") == F.lit(vocab.SUDAH_INVOICE))).alias("sudah_invoice_m"),
        money(total(a)).alias("total_m"))
