"""Hand-checked totals on a small data set of our own: home rows in several
spellings, known and unknown categories, a tie, nulls, a negative amount."""

from conftest import invoices
from kolekta.operators import flow, summary

# (id, aging, status, region, category, amount)
ROWS = [
    ("A1", "Within Due", "AR LAYAK TAGIH", "Jakarta", "SUDAH INVOICE", 4.00),
    ("A2", "0-30 Days", "AR LAYAK TAGIH", " JAKARTA ", "KONTRAK", 2.50),
    ("A3", "31-60 Days", "AR BERMASALAH", "jakarta", "KONTRAK", 1.25),
    ("A4", ">90 Days", "AR TIDAK LAYAK TAGIH", "Jakarta", "TERMYN", 8.00),
    ("A5", "61-90 Days", "AR BERMASALAH", "Lembang", "CHECKER", 3.00),
    ("A6", "Within Due", "AR LAYAK TAGIH", "Tegal", "SUDAH INVOICE", 3.00),
    ("A7", "0-30 Days", "AR LAYAK TAGIH", None, "KOREKSI", 0.75),
    ("A8", None, None, "Jakarta", "SOMETHING ELSE", 0.50),
    ("A9", "Within Due", "AR LAYAK TAGIH", "Jakarta", "SUDAH INVOICE", None),
    ("B1", "31-60 Days", "AR BERMASALAH", "Tegal", "REKON/SLG", -1.00),
]


def test_kpis(spark):
    r = summary.kpi_summary(invoices(spark, ROWS)).first()
    assert r.total_ar_m == 22.00
    assert (r.total_layak_tagih_m, r.total_bermasalah_m, r.total_tidak_layak_m) == (10.25, 3.25, 8.00)
    assert (r.over_due_m, r.overdue_pct, r.dso, r.total_records) == (11.25, 51.14, 60, 10)


def test_age_analysis(spark):
    rows = {r.label: r.v for r in summary.age_analysis(invoices(spark, ROWS)).collect()}
    assert rows == {"AR Layak Tagih": 10.25, "AR Bermasalah": 3.25, "AR Tidak Layak Tagih": 8.0, "Within Due": 7.0,
                    "Over Due 0-30 Days": 3.25, "Over Due 31-60 Days": 0.25, "Over Due 61-90 Days": 3.0, "Due Over 90 Days": 8.0}


def test_flow(spark):
    df = invoices(spark, ROWS)
    lv = flow.flow_levels(df).first()
    # Home without the uncollectible row: 4 + 2.5 + 1.25 + 0.5; the rest: 3 + 3 + 0.75 - 1.
    assert (lv.home_total_m, lv.regional_total_m) == (8.25, 5.75)
    assert (lv.sudah_invoice_m, lv.belum_invoice_m) == (4.0, 3.75)
    assert {r.category: r.v for r in flow.flow_categories(df).collect()} == {"SUDAH INVOICE": 4.0, "KONTRAK": 3.75}
    assert {r.region: r.v for r in flow.flow_regional(df).collect()} == {"Lembang": 3.0, "Tegal": 2.0}
    plan = [(r.kategori, r.nilai_m) for r in flow.action_plan(df).orderBy("ord").collect()]
    assert plan == [("AR TIDAK LAYAK TAGIH", 8.0), ("REGIONAL", 5.75), ("SUDAH INVOICE", 4.0), ("KONTRAK", 3.75)]


def test_region_shares_with_a_tie(spark):
    rows = {r.region: (r.value, r.percentage) for r in summary.region_breakup(invoices(spark, ROWS + [
        ("B2", None, "AR LAYAK TAGIH", "Lembang", None, -1.00)])).collect()}
    assert rows["Lembang"] == rows["Tegal"] == (2.0, 9.88)   # of 20.25: rows without a region do not count
