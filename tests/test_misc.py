"""Sources, scalar helpers, paging, series helpers and the short projections."""

import os

from conftest import invoices
from pyspark.sql import functions as F

from kolekta import schemas
from kolekta.functions import ora_date
from kolekta.operators import filters, history, paging, summary
from kolekta.sources.catalog import read_snapshots, read_wide


def test_csv_sheet_headers_trimmed_and_snapshots(spark, scratch):
    a, b = os.path.join(scratch, "a.csv"), os.path.join(scratch, "b.csv")
    with open(a, "w") as fh:
        fh.write(" NAME , CA ,k_0_0\nX,1,100\n")
    with open(b, "w") as fh:
        fh.write("NAME,CA\nY,2\n")
    df = read_wide(spark, a)
    assert df.columns == ["NAME", "CA", "k_0_0"]
    snap = read_snapshots(spark, [("OI 202607", a), ("OI 202606", b)], fmt="csv")
    got = sorted((r.NAME, r.sheet, r.sheet_pos, r.k_0_0) for r in snap.collect())
    assert got == [("X", "OI 202607", 0, "100"), ("Y", "OI 202606", 1, None)]
    assert schemas.normalise_headers(df, "lower").columns == ["name", "ca", "k_0_0"]


def test_ora_date_and_lower_cols(spark):
    df = spark.createDataFrame([("01-JAN-20",), ("15-Aug-26",)], "D string")
    assert [str(r.d) for r in schemas.lower_cols(df).select(ora_date("d").alias("d")).collect()] == ["2020-01-01", "2026-08-15"]


def test_keyset_paging_and_head(spark):
    df = invoices(spark, [(f"K{i:02d}", None, None, None, None, float(i)) for i in range(30)])
    p2 = paging.detail_page(df, 2, size=25).collect()
    assert [r.invoice_id for r in p2] == [f"K{i:02d}" for i in range(25, 30)] and p2[0].pages == 2
    assert [r.invoice_id for r in paging.page_after(df, "K24", 25).collect()] == [f"K{i:02d}" for i in range(25, 30)]
    assert paging.detail_page(df.limit(0), 1).count() == 0
    assert [r.invoice_id for r in paging.table_head(df, 3, ("invoice_id",)).collect()] == ["K00", "K01", "K02"]


def test_sparkline_scaled_flat_series(spark):
    m = spark.createDataFrame([("a", 1, 5.0, 50.0), ("b", 2, 5.0, 51.0)], "month_label string, sort_order int, overdue_pct double, dso double")
    assert [r.scaled for r in history.sparkline_scaled(m).orderBy("sort_order").collect()] == [0.0, 0.0]
    s = history.sparkline(m).first()
    assert list(s.months) == ["a", "b"] and list(s.dso) == [50.0, 51.0]


def test_cumshare_and_stack_offsets(spark):
    rows = [("R1", None, "AR LAYAK TAGIH", "A", None, 1.0), ("R2", None, "AR BERMASALAH", "B", None, 3.0),
            ("R3", None, "AR TIDAK LAYAK TAGIH", "A", None, 2.0)]
    df = invoices(spark, rows).withColumn("report_month", F.lit("Juni 2026"))
    cum = summary.region_cumshare(df).orderBy("region").collect()
    assert [(r.region, r.start_share, r.end_share) for r in cum] == [("A", 0.0, 0.5), ("B", 0.5, 1.0)]
    st = {r.series: (r.v, r.y0, r.y1) for r in history.history_stack(df).collect()}
    assert st == {"layak_m": (1.0, 0.0, 1.0), "bermasalah_m": (3.0, 1.0, 4.0), "tidak_layak_m": (2.0, 4.0, 6.0)}


def test_base_projection_and_minimal_summary(spark):
    df = invoices(spark, [("B1", None, "AR LAYAK TAGIH", None, None, None), ("B2", "0-30 Days", None, "X", None, 1.005)])
    base = {r.invoice_id: r for r in filters.base_projection(df).collect()}
    assert base["B1"].nilai_m == 0 and base["B1"].region == "" and len(base["B1"]) == 9
    m = summary.minimal_summary(df).first()
    assert (m.total_ar_m, m.total_layak_tagih_m, m.total_records) == (1.01, 0.0, 2)
