"""Edge rows: null/blank/untrimmed regions, null status, null/zero/negative
amounts, unknown categories, ties, empty tables, month labels, amount text."""

from conftest import invoices
from pyspark.sql import functions as F

from kolekta.functions import amount_sql, month_ord
from kolekta.operators import customers, filters, flow, history, summary

EDGE = [
    ("A1", "Within Due", "AR LAYAK TAGIH", " Jakarta ", "SUDAH INVOICE", 10.0),
    ("A2", "0-30 Days", "AR LAYAK TAGIH", "JAKARTA", "KONTRAK", 5.0),
    ("A3", "0-30 Days", "AR BERMASALAH", "jakarta", "KONTRAK", 2.0),
    ("A4", ">90 Days", "AR TIDAK LAYAK TAGIH", "JAKARTA", "KONTRAK", 7.0),
    ("A5", "31-60 Days", None, "EUROPE", "TERMYN", 3.0),
    ("A6", "61-90 Days", "AR LAYAK TAGIH", None, "CHECKER", 4.0),
    ("A7", "61-90 Days", "AR LAYAK TAGIH", "", "UNKNOWN CAT", 1.0),
    ("A8", "Within Due", "AR BERMASALAH", "ASIA", "KOREKSI", -6.0),
    ("A9", "Within Due", "AR LAYAK TAGIH", "ASIA", "KOREKSI", None),
    ("A10", "Within Due", "AR LAYAK TAGIH", "EUROPE", "BAST/BAPP", 0.0),
]


def test_kpis_count_null_amounts_and_skip_them(spark):
    r = summary.kpi_summary(invoices(spark, EDGE)).first()
    assert r.total_records == 10
    assert r.total_ar_m == 26.0
    assert r.total_layak_tagih_m == 20.0          # 10 + 5 + 4 + 1 + 0 (null skipped)
    assert r.total_bermasalah_m == -4.0           # null status is in no status sum
    assert r.over_due_m == 3.0


def test_flow_split_is_null_safe_and_trims_home(spark):
    df = invoices(spark, EDGE)
    lv = flow.flow_levels(df).first()
    # keep-set = status other than uncollectible, null status included.
    assert lv.home_total_m == 17.0                # A1 + A2 + A3 (trimmed, any case)
    assert lv.regional_total_m == 3.0 + 4.0 + 1.0 - 6.0 + 0.0   # A5 (null status), A6 (null region), A7, A8, A10
    assert lv.home_total_m + lv.regional_total_m == lv.total_m - lv.tidak_layak_m
    cats = {r.category: r.v for r in flow.flow_categories(df).collect()}
    assert cats == {"SUDAH INVOICE": 10.0, "KONTRAK": 7.0}
    regional = {r.region: r.v for r in flow.flow_regional(df).collect()}
    assert regional == {"EUROPE": 3.0, "": 1.0}   # null region counted in the total only; negative ASIA dropped


def test_region_breakup_share_uses_all_regions_before_filter(spark):
    rows = {r.region: (r.value, r.percentage) for r in summary.region_breakup(invoices(spark, EDGE)).collect()}
    assert None not in rows and "ASIA" not in rows
    total = 10 + 5 + 2 + 7 + 3 + 1 - 6 + 0        # non-null regions, negative included
    assert rows["EUROPE"] == (3.0, round(3 / total * 100, 2))


def test_drilldowns(spark):
    df = invoices(spark, EDGE)
    ids = lambda d: sorted(r.invoice_id for r in d.collect())
    assert ids(filters.drilldown(df, "status", "AR BERMASALAH")) == ["A3", "A8"]
    assert ids(filters.drilldown(df, "home")) == ["A1", "A2"]
    assert ids(filters.drilldown(df, "regional")) == ["A10", "A6", "A7", "A9"]
    assert ids(filters.drilldown(df, "region", "EUROPE")) == ["A10"]
    assert ids(filters.drilldown(df, "category", "KONTRAK")) == ["A2", "A3", "A4"]


def test_search_is_literal_and_case_insensitive(spark):
    df = invoices(spark, EDGE)
    assert filters.search_invoices(df, "jakarta").count() == 4
    assert filters.search_invoices(df, "%").count() == 0          # no LIKE wildcards
    assert filters.search_invoices(df, "").count() == 10


def test_filters_all_means_none(spark):
    df = invoices(spark, EDGE)
    assert filters.filter_invoices(df, "ALL", "", None).count() == 10
    assert filters.filter_invoices(df, region="EUROPE").count() == 2


def test_largest_segment_tie_and_empty(spark):
    rows = [("S1", None, None, None, None, 5.0), ("S2", None, None, None, None, 5.0)]
    df = invoices(spark, rows).withColumn("pengelolaan", F.when(F.col("invoice_id") == "S1", "TWS").otherwise("MIS"))
    assert summary.largest_segment(df).first().largest_segment == "MIS"
    assert summary.largest_segment(df.limit(0)).first().largest_segment == "-"


def test_empty_table(spark):
    df = invoices(spark, EDGE).limit(0)
    r = summary.kpi_summary(df).first()
    assert (r.total_ar_m, r.overdue_pct, r.total_records) == (0.0, 0.0, 0)
    assert summary.as_of(df).first().as_of_date is None
    assert summary.age_analysis(df).count() == 8


def test_month_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["Agustus 2026", "JUNI 2026", "May 2020", "May 19", "garbage", None]], "m string")
    got = [r.o for r in df.select(month_ord("m").alias("o")).collect()]
    assert got == [2026 * 12 + 8, 2026 * 12 + 6, 2020 * 12 + 5, 2019 * 12 + 5, None, None]
    inv = invoices(spark, [("M1", None, None, None, None, 1.0), ("M2", None, None, None, None, 1.0),
                           ("M3", None, None, None, None, 1.0)])
    inv = inv.withColumn("report_month", F.element_at(F.array(F.lit("Juni 2026"), F.lit("Juli 2026"),
                                                             F.lit("Agustus 2026")),
                                                     F.substring("invoice_id", 2, 1).cast("int")))
    lexical = [r.report_month for r in history.distinct_months(inv).orderBy("ord").collect()]
    chrono = [r.report_month for r in history.distinct_months(inv, True).orderBy("ord").collect()]
    assert lexical == ["Juni 2026", "Juli 2026", "Agustus 2026"]   # lexical desc puts Juni first
    assert chrono == ["Juni 2026", "Juli 2026", "Agustus 2026"]
    assert summary.as_of(inv).first().as_of_date == "Agustus 2026"


def test_amount_text(spark):
    cases = {" 12 ": 12.0, "1e3": 1000.0, "abc": None, "": None, "NaN": None, "inf": None, "-inf": None, "0": 0.0, "-5.5": -5.5,
             None: None, "12d": None, "3f": None, "0x1p3": None, "1_000": 1000.0, "_1": None, "1e25": None, ".5": 0.5, "7.": 7.0}
    df = spark.createDataFrame([(x,) for x in cases], "raw string")
    got = [None if r.v is None else float(r.v) for r in df.select(F.expr(amount_sql("raw")).alias("v")).collect()]
    assert got == list(cases.values())


def test_top_customers_nulls_first(spark):
    cust = spark.createDataFrame([("a", "M", 5.0, 1.0), ("b", "M", None, 2.0), ("c", "M", 9.0, 99.0)],
                                 "customer_name string, report_month string, over_due double, overdue_pct double")
    top = customers.top_customers(cust, n=2).orderBy("rank").collect()
    assert [r.customer_name for r in top] == ["b", "c"] and [r.rank for r in top] == [1, 2]
    bands = {r.customer_name: r.band for r in customers.customer_band(cust).collect()}
    assert bands == {"a": "low", "b": "low", "c": "high"}


def test_customer_rollup_drops_blank_names_and_clamps(spark):
    rows = [("C1", "Within Due", None, None, None, 2.0), ("C2", "0-30 Days", None, None, None, 3.0),
            ("C3", "0-30 Days", None, None, None, 1.0)]
    df = invoices(spark, rows).withColumn(
        "customer_name", F.when(F.col("invoice_id") == "C3", F.lit("  ")).otherwise(F.lit("X"))
    ).withColumn("report_month", F.lit("Juni 2026"))
    r = customers.customer_rollup(df).collect()
    assert len(r) == 1
    assert (r[0].balance, r[0].within_due, r[0].over_due, r[0].due_invoices, r[0].overdue_pct) == (5000.0, 2000.0, 3000.0, 1, 60.0)
