"""Clustered rows, the trigram index and the rank index against plain scans."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

from kolekta import schemas, vocab
from kolekta.operators.filters import search_invoices
from kolekta.operators.paging import detail_page
from kolekta.plans import indexes, tables
from kolekta.sources.fixtures import Fixtures


@pytest.fixture(scope="module")
def inv(spark):
    return schemas.conform(Fixtures(spark, SF).invoices()).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def share_read(path, column, value):
    """Share of the rows in row groups whose statistics allow the value."""
    read = total = 0
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            total += meta.row_group(g).num_rows
            if s is None or not s.has_min_max or s.min <= value <= s.max:
                read += meta.row_group(g).num_rows
    return read / total


def test_clustered_rows_let_filters_skip(spark, scratch, inv):
    month = inv.withColumn("report_month", F.lit("Juni 2026"))
    plain, clustered = os.path.join(scratch, "p"), os.path.join(scratch, "c")
    tables.write_version(month.repartition(16), plain, "report_month")
    indexes.write_clustered(month, clustered, tasks=96)
    table = tables.read_current(spark, clustered, schemas.INVOICE)
    assert rows(table) == rows(month)
    for column, value in (("region", "EUROPE"), ("pengelolaan", "BUILDING"), ("status_tagih", "AR LAYAK TAGIH")):
        assert share_read(plain, column, value) == 1.0
        assert share_read(clustered, column, value) < 0.55
        assert rows(table.where(F.col(column) == value)) == rows(month.where(F.col(column) == value))
    plan = table.where("region = 'EUROPE'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region,EUROPE)" in plan
    # A keyed change of a clustered table is an ordinary one.
    tables.delete_partitions(spark, clustered, month.limit(5).select("invoice_id", "report_month"))
    assert tables.read_current(spark, clustered, schemas.INVOICE).count() == month.count() - 5
    assert indexes.write_clustered(month.limit(0), os.path.join(scratch, "none"))


@pytest.mark.parametrize("needle", ["R#00000001", "building", "ab", "", None, "%_", "zzz nothing", "O'Neil\\", "Ümläut", "  jak"])
def test_indexed_search_finds_what_the_scan_finds(spark, tmp_path_factory, inv, needle):
    odd = inv.limit(3).withColumns({"invoice_id": F.concat(F.lit("ODD"), "invoice_id"), "customer_name": F.lit("x O'Neil\\ ÜMLÄUT %_ y"),
                                    "report_month": F.lit(None).cast("string")})
    table = inv.unionByName(odd)
    path = _index(spark, tmp_path_factory, table)
    assert rows(indexes.indexed_search(table, path, needle)) == rows(search_invoices(table, needle))


def test_postings_are_lists_by_segment_and_shuffle_rows_alone(spark, inv, monkeypatch):
    monkeypatch.setattr(indexes, "SEGMENT", 5)
    table = inv.limit(900).unionByName(inv.limit(3).withColumns({
        "invoice_id": F.lit(None).cast("string"), "report_month": F.lit(None).cast("string"), "customer_name": F.lit("Ü\U0001f600x")}))
    made = indexes.postings(table)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RebalancePartitions" in plan[plan.index("MapInArrow"):]
    lists = made.collect()
    got, keys = set(), {(r.report_month, r.segment): r["keys"] for r in lists if r.gram == ""}
    for r in lists:
        assert r.gram == "" or (len(r.gram) == 3 and list(r.places) == sorted(set(r.places)))
        got |= {(r.report_month, r.gram, keys[r.report_month, r.segment][k]) for k in r.places}
    want = set()
    for r in table.collect():
        for text in (r[c] for c in vocab.SEARCH_COLUMNS):
            low = (text or "").lower()
            want |= {(r.report_month, low[i:i + 3], r.invoice_id) for i in range(len(low) - 2)}
    assert got == want and sum(map(len, keys.values())) == 903 and max(map(len, keys.values())) <= 5
    assert len(keys) > len({m for m, _ in keys}) and indexes.postings(table.limit(0)).count() == 0


_built = {}


def _index(spark, factory, table):
    if "path" not in _built:
        _built["path"] = str(factory.mktemp("postings"))
        indexes.build_search(table, _built["path"])
    return _built["path"]


def test_only_candidates_reach_the_literal_check(spark, scratch, inv):
    stored, index = os.path.join(scratch, "t"), os.path.join(scratch, "i")
    tables.write_version(inv, stored, "report_month")
    table = tables.read_current(spark, stored, schemas.INVOICE)
    indexes.build_search(table, index)
    plan = indexes.indexed_search(table, index, "building")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "Contains" in plan[:plan.index("\n", join)] and "Contains" not in plan[plan.index("\n", join):]   # at the join or above
    # After a change of one month its postings are made anew.
    change = inv.where("report_month = 'Juni 1998'").limit(1).withColumn("customer_name", F.lit("Brand new name"))
    tables.upsert_partitions(spark, stored, change)
    table = tables.read_current(spark, stored, schemas.INVOICE)
    indexes.build_search(table, index, ["Juni 1998"])
    assert [r.customer_name for r in indexes.indexed_search(table, index, "brand NEW").collect()] == ["Brand new name"]
    assert rows(indexes.indexed_search(table, index, "europe")) == rows(search_invoices(table, "europe"))


def test_pages_by_rank_are_the_pages_by_offset(spark, scratch, inv):
    path = os.path.join(scratch, "r")
    table = inv.unionByName(inv.limit(2).withColumn("invoice_id", F.lit(None).cast("string"))).cache()
    indexes.build_ranks(table, path, ranges=7)
    last = -(-table.count() // 25)
    for page in (2, 3, 300, last - 1, last, last + 1):
        got, want = indexes.ranked_page(table, path, page), detail_page(table, page)
        assert [r.invoice_id for r in got.collect()] == [r.invoice_id for r in want.collect()]
        assert page > last or got.first().pages == last
    assert indexes.ranked_page(table, path, 1).count() == 25
    plan = indexes.ranked_page(table, path, 300)._jdf.queryExecution().optimizedPlan().toString()
    assert "invoice_id#" in plan and ">= INV-" in plan and "<= INV-" in plan     # a key range, not the table
    empty = os.path.join(scratch, "e")
    indexes.build_ranks(inv.limit(0), empty)
    assert indexes.ranked_page(inv.limit(0), empty, 1).count() == 0
