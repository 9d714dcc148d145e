"""Plan-shape tests: the scale properties the design relies on, checked on
the physical plans over a month-partitioned fact table."""

import os
import re

import pytest
from conftest import SF

from kolekta import schemas
from kolekta.operators import cubes, filters, flow, paging, summary
from kolekta.plans import tables
from kolekta.plans.payload import dashboard_payload
from kolekta.sources.catalog import TableCatalog
from kolekta.sources.fixtures import Fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    fx = Fixtures(spark, SF)
    for name, df in (("ar_segmen_ers_tbl", fx.invoices()), ("ar_top_customers_tbl", fx.top_customers()),
                     ("ar_cash_inflow_forecast_tbl", fx.cash_inflow()), ("ar_trend_t13m_tbl", fx.trend_t13m()),
                     ("ar_metrics_history_tbl", fx.metrics_history())):
        schema, _, part = schemas.TABLES[name]
        tables.refresh(schemas.conform(df, schema), os.path.join(root, name), part)
    return TableCatalog.at(spark, root)


def test_filters_reach_the_scan(stored):
    inv = stored.read_table("ar_segmen_ers_tbl")
    p = plan(summary.kpi_summary(inv, month="Juni 1998", segment="BUILDING"))
    assert "PartitionFilters: [isnotnull(report_month" in p and "(report_month" in p
    assert "EqualTo(pengelolaan,BUILDING)" in p
    read = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(re.findall(r"(\w+):", read)) == {"status_tagih", "nilai_m", "pengelolaan"}


def test_flow_is_one_partial_aggregate_and_one_tiny_exchange(stored):
    p = plan(flow.flow_levels(stored.read_table("ar_segmen_ers_tbl")))
    assert p.count("Exchange") == 1 and "Exchange SinglePartition" in p
    assert "partial_sum" in p and p.count("FileScan parquet") == 1


def test_cube_expands_a_pre_aggregate(stored):
    p = plan(cubes.kpi_cube(stored.read_table("ar_segmen_ers_tbl")))
    expand = p.index("Expand")
    # the pre-aggregate (with its own exchange) sits below the Expand
    assert "HashAggregate(keys=[report_month" in p[expand:] and "Exchange hashpartitioning" in p[expand:]


def test_payload_scans_the_fact_table_once(stored):
    inv = stored.read_table("ar_segmen_ers_tbl")
    df = dashboard_payload(inv, stored.read_table("ar_top_customers_tbl"),
                           stored.read_table("ar_cash_inflow_forecast_tbl"), stored.read_table("ar_trend_t13m_tbl"),
                           stored.read_table("ar_metrics_history_tbl"))
    p = plan(df)
    scans = [line for line in p.splitlines() if "FileScan parquet" in line and "ar_segmen_ers_tbl" in line]
    assert len(scans) == 1
    assert "Subquery" not in p and "Join" not in p


def test_paging_is_a_per_task_top_n(stored):
    inv = stored.read_table("ar_segmen_ers_tbl")
    p = plan(paging.detail_page(filters.drilldown(inv, "status", "AR BERMASALAH"), 3))
    assert "TakeOrderedAndProject(limit=75, offset=50" in p
    assert "Exchange rangepartitioning" not in p
    known = plan(paging.detail_page(filters.drilldown(inv, "status", "AR BERMASALAH"), 3, records=60))
    assert known.count("FileScan parquet") == 1


def test_import_leaves_the_wide_rows_where_they_are(spark, tmp_path_factory):
    """The list of sheets is what is broadcast; the wide table has no exchange; each amount is parsed once."""
    from kolekta.operators import ingest
    fx = Fixtures(spark, SF)
    path = str(tmp_path_factory.mktemp("wide"))
    fx.open_item_wide().repartition(6).write.mode("overwrite").parquet(path)
    facts = ingest.import_open_items(spark.read.parquet(path), fx.open_item_header())
    p = plan(facts)
    assert "BuildRight" in p and "BuildLeft" not in p
    # The only exchanges stand below the broadcast of the chosen sheets (their distinct names).
    before = p[:p.index("BroadcastExchange")]
    assert "Exchange" not in before.replace("BroadcastExchange", "")
    assert facts.rdd.getNumPartitions() > 1
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("try_cast(") == 1   # each amount is parsed once
