"""Benchmark: headline receivables queries at one scale factor.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1):

1. ``materialize`` (reported by table): build the invoice fact table from the
   driver's tables and write it the way production stores it -- Parquet
   partitioned by ``report_month``, as a new table version -- plus the customer
   table, the landed sheet rows and the mart.
2. Headline queries read that table through the catalog (so month filters
   prune partitions and projections prune columns) and are timed one by one
   (best of ``$BENCH_REPEAT`` runs, after one warm-up query), the stored
   upsert and the mart refresh of one month among them.

Prints ONE JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: sec}, "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kolekta.session import build_session, scratch_path  # noqa: E402


def _timed(action, repeat: int) -> float:
    best = None
    for _ in range(repeat):
        t0 = time.perf_counter()
        action()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(f"local[{cpus}]", cpus, app="kolekta-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})

    from pyspark.sql import functions as F

    from kolekta.operators import cubes, customers, filters, flow, history, ingest, mutations, paging, summary
    from kolekta.plans import indexes, marts, tables
    from kolekta.plans.payload import dashboard_payload
    from kolekta.sources.catalog import TableCatalog
    from kolekta.sources.fixtures import Fixtures

    fx = Fixtures(spark, sf_dir)
    root = scratch_path(spark, "bench")
    timings: dict[str, float] = {}

    cat = TableCatalog.at(spark, root)
    stored = tables.StoredTables(spark, root)
    materialize: dict[str, float] = {}

    def landed(name, action):
        t0 = time.perf_counter()
        action()
        materialize[name] = round(time.perf_counter() - t0, 3)

    def store(name, df):
        landed(name, lambda: stored.refresh(name, df))

    store("ar_segmen_ers_tbl", fx.invoices())
    store("ar_top_customers_tbl", customers.customer_rollup(cat.read_table("ar_segmen_ers_tbl")))
    store("ar_cash_inflow_forecast_tbl", fx.cash_inflow())
    store("ar_trend_t13m_tbl", fx.trend_t13m())
    store("ar_metrics_history_tbl", fx.metrics_history())
    # Open-item sheets arrive as landed files; the import starts there.
    landed("landing_open_items", lambda: fx.open_item_wide().write.parquet(f"{root}/landing/open_items"))
    landed("ranks", lambda: indexes.build_ranks(cat.read_table("ar_segmen_ers_tbl"), f"{root}/ranks"))
    landed("mart", lambda: marts.refresh_mart(spark, cat.read_table("ar_segmen_ers_tbl"), f"{root}/mart"))

    inv = cat.read_table("ar_segmen_ers_tbl")
    cust = cat.read_table("ar_top_customers_tbl")
    months = [r["report_month"] for r in history.distinct_months(inv).limit(1).collect()]
    month = months[0] if months else None
    upd = inv.where(F.col("invoice_id").endswith("0")).withColumn("nilai_m", F.col("nilai_m") + 1)
    key = cat.primary_key("ar_segmen_ers_tbl")
    mart = marts.read_mart(spark, f"{root}/mart")
    in_month = upd.where(F.col("report_month") == F.lit(month)).select(*key, "nilai_m")

    def refresh_month():
        marts.refresh_mart(spark, stored.read("ar_segmen_ers_tbl"), f"{root}/mart", [month])

    def collect(df_fn):
        return lambda: df_fn().collect()

    def noop(df_fn):
        return lambda: df_fn().write.format("noop").mode("overwrite").save()

    wide, header = spark.read.parquet(f"{root}/landing/open_items"), fx.open_item_header()
    headline = {
        "kpi_summary": collect(lambda: summary.kpi_summary(inv)),
        "kpi_month_segment": collect(lambda: summary.kpi_summary(inv, month=month, segment="BUILDING")),
        "flow_levels": collect(lambda: flow.flow_levels(inv)),
        "action_plan": collect(lambda: flow.action_plan(inv)),
        "segment_breakdown": collect(lambda: summary.segment_breakdown(inv)),
        "region_breakup": collect(lambda: summary.region_breakup(inv)),
        "age_analysis": collect(lambda: summary.age_analysis(inv)),
        "history_trend": collect(lambda: history.history_trend(inv)),
        "kpi_cube": collect(lambda: cubes.kpi_cube(inv)),
        "customer_rollup": noop(lambda: customers.customer_rollup(inv)),
        "top_customers": collect(lambda: customers.top_customers(cust)),
        "search_invoices": noop(lambda: filters.search_invoices(inv, "12")),
        "detail_page": collect(lambda: paging.detail_page(filters.drilldown(inv, "status", "AR BERMASALAH"), 3)),
        "table_upsert": noop(lambda: mutations.upsert_rows(inv, upd, key)),
        "import_open_items": noop(lambda: ingest.import_open_items(wide, header)),
        "dashboard_payload": collect(lambda: dashboard_payload(
            inv, cust, cat.read_table("ar_cash_inflow_forecast_tbl"), cat.read_table("ar_trend_t13m_tbl"),
            cat.read_table("ar_metrics_history_tbl"))),
        "dashboard_payload_mart": collect(lambda: dashboard_payload(
            mart, cust, cat.read_table("ar_cash_inflow_forecast_tbl"), cat.read_table("ar_trend_t13m_tbl"),
            cat.read_table("ar_metrics_history_tbl"))),
        "kpi_cube_mart": collect(lambda: cubes.kpi_cube(mart)),
        "ranked_page_deep": collect(lambda: indexes.ranked_page(inv, f"{root}/ranks", 4000)),
        "mart_kpi": collect(lambda: marts.mart_kpi(mart)),
        "mart_flow_levels": collect(lambda: flow.flow_levels(mart)),
        "stored_upsert_month": lambda: stored.upsert("ar_segmen_ers_tbl", in_month),
        "mart_refresh_month": refresh_month,
    }
    if "--explain" in sys.argv:   # print the physical plans instead of timing
        plans = {"kpi_month_segment": lambda: summary.kpi_summary(inv, month=month, segment="BUILDING"),
                 "flow_levels": lambda: flow.flow_levels(inv), "action_plan": lambda: flow.action_plan(inv),
                 "region_breakup": lambda: summary.region_breakup(inv), "kpi_cube": lambda: cubes.kpi_cube(inv),
                 "customer_rollup": lambda: customers.customer_rollup(inv),
                 "top_customers": lambda: customers.top_customers(cust),
                 "detail_page": lambda: paging.detail_page(filters.drilldown(inv, "status", "AR BERMASALAH"), 3),
                 "table_upsert": lambda: mutations.upsert_rows(inv, upd, key),
                 "import_open_items": lambda: ingest.import_open_items(wide, header),
                 "dashboard_payload": lambda: dashboard_payload(
                     inv, cust, cat.read_table("ar_cash_inflow_forecast_tbl"), cat.read_table("ar_trend_t13m_tbl"),
                     cat.read_table("ar_metrics_history_tbl"))}
        for name, fn in plans.items():
            print(f"\n## {name}\n\n```")
            fn().explain()
            print("```")
        return
    summary.kpi_summary(inv).collect()   # warm-up (JIT, file listing cache)
    for name, action in headline.items():
        timings[name] = _timed(action, repeat)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "receivables_headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "materialize_sec": round(sum(materialize.values()), 3),
        "materialize": materialize,
        "fact_rows": inv.count(),
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
