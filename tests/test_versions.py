"""Versions: two writers of one table, the change feed, maintained marts and cubes, history, widening schemas."""

import itertools
import os
import time

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from kolekta import schemas
from kolekta.operators import cubes, mutations
from kolekta.plans import marts, tables, versions
from kolekta.sources.fixtures import Fixtures

PK = ["invoice_id", "report_month"]
JUNE, JULY = "Juni 2026", "Juli 2026"


def facts(spark, rows):
    """(id, month, amount[, region]) as invoices."""
    rows = [(i, m, None if v is None else str(v), (r[3] if len(r) > 3 else "A")) for r in rows for i, m, v in [r[:3]]]
    df = spark.createDataFrame(rows, "invoice_id string, report_month string, nilai_m string, region string")
    return schemas.conform(df.withColumns({"status_tagih": F.lit("AR LAYAK TAGIH"), "pengelolaan": F.lit("S")}))


def got(df):
    return sorted((r.invoice_id, r.report_month, None if r.nilai_m is None else float(r.nilai_m)) for r in df.collect())


def race(monkeypatch, name, other):
    """Let ``other()`` commit once while the next change is between its read and its commit."""
    real, done = getattr(tables, name), []

    def slow(*a, **k):
        out = real(*a, **k)
        if not done:
            done.append(1)
            other()
        return out
    monkeypatch.setattr(tables, name, slow)


@pytest.mark.parametrize("operation", ["upsert", "append", "update", "delete"])
@pytest.mark.parametrize("month", [JUNE, JULY])
def test_two_overlapping_changes_both_stand(spark, scratch, monkeypatch, operation, month):
    path = os.path.join(scratch, "t")
    tables.upsert_partitions(spark, path, facts(spark, [("a", JUNE, 1), ("b", JUNE, 2), ("c", JULY, 3)]))
    jobs = []
    real = tables.stage
    monkeypatch.setattr(tables, "stage", lambda *a: (jobs.append(1), real(*a))[1])
    other = {"k": facts(spark, [("a" if month == JUNE else "c", month, 99), ("x", month, 5)])}
    # The other writer commits while the change checks its keys.
    race(monkeypatch, f"{operation}_rows", lambda: tables.upsert_partitions(spark, path, other["k"], feed=False))
    want = {("a", JUNE): 1.0, ("b", JUNE): 2.0, ("c", JULY): 3.0}
    want.update({(r[0], r[1]): r[2] for r in got(other["k"])})
    if operation == "upsert":
        tables.upsert_partitions(spark, path, facts(spark, [("b", JUNE, 7), ("n", JUNE, 8)]))
        want.update({("b", JUNE): 7.0, ("n", JUNE): 8.0})
    elif operation == "append":
        tables.append_partitions(spark, path, facts(spark, [("n", JUNE, 8)]))
        want[("n", JUNE)] = 8.0
    elif operation == "update":
        tables.update_partitions(spark, path, facts(spark, [("b", JUNE, 7)]))
        want[("b", JUNE)] = 7.0
    else:
        tables.delete_partitions(spark, path, facts(spark, [("b", JUNE, 0)]))
        del want[("b", JUNE)]
    assert {(i, m): v for i, m, v in got(versions.read_current(spark, path))} == want
    assert len(jobs) == (3 if month == JUNE else 2)   # other months: no job runs again
    left = [n for n in os.listdir(path) if n.startswith("v=")]
    assert len(left) == len(versions.versions(spark, path)) == 4   # the folder of the lost run is gone


def test_append_of_a_key_that_another_writer_brings_raises(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "t")
    tables.upsert_partitions(spark, path, facts(spark, [("a", JUNE, 1)]))
    race(monkeypatch, "append_rows", lambda: tables.upsert_partitions(spark, path, facts(spark, [("n", JUNE, 5)])))
    with pytest.raises(mutations.DuplicateKeyError):
        tables.append_partitions(spark, path, facts(spark, [("n", JUNE, 8)]))
    assert got(versions.read_current(spark, path)) == [("a", JUNE, 1.0), ("n", JUNE, 5.0)]


def test_tables_without_partitions_and_whole_refreshes(spark, scratch, monkeypatch):
    store, name = tables.StoredTables(spark, scratch), "AR_TREND_T13M_TBL"
    rows = lambda *x: spark.createDataFrame(x, "month_label string, sort_order int")
    store.refresh(name, rows(("a", 1)))
    race(monkeypatch, "upsert_rows", lambda: store.upsert(name, rows(("b", 2))))
    store.upsert(name, rows(("c", 3)))
    assert sorted(r.month_label for r in store.read(name).collect()) == ["a", "b", "c"]
    with pytest.raises(tables.ConcurrentWriteError):
        store.refresh(name, rows(("z", 1)), expected=store.version(name) - 1)
    store.refresh(name, rows(("z", 1)), expected=store.version(name))
    assert [r.month_label for r in store.read(name).collect()] == ["z"]


def test_a_pointer_is_created_once(spark, scratch):
    path = os.path.join(scratch, "p", "000001.json")
    assert versions.put_new(spark, path, b"one") and not versions.put_new(spark, path, b"two")
    assert open(path, "rb").read() == b"one" and os.listdir(os.path.dirname(path)) == ["000001.json"]


def test_two_writers_that_create_a_table(spark, scratch, monkeypatch):
    path = os.path.join(scratch, "t")
    race(monkeypatch, "upsert_rows", lambda: tables.upsert_partitions(spark, path, facts(spark, [("a", JUNE, 1)])))
    tables.upsert_partitions(spark, path, facts(spark, [("b", JUNE, 2)]))
    assert got(versions.read_current(spark, path)) == [("a", JUNE, 1.0), ("b", JUNE, 2.0)]


STEPS = [
    lambda s, t: tables.upsert_partitions(s, t, facts(s, [("a", JUNE, 1), ("b", JUNE, None), ("c", JULY, 3, "B")]), feed=True),
    lambda s, t: tables.update_partitions(s, t, facts(s, [("a", JUNE, 5, "C"), ("zz", JUNE, 1)]), feed=True),
    lambda s, t: tables.append_partitions(s, t, facts(s, [("d", "Mei 2026", -2), ("e", JULY, 0, None)]), feed=True),
    lambda s, t: tables.delete_partitions(s, t, facts(s, [("c", JULY, 0), ("b", JUNE, 0)]), feed=True),
    lambda s, t: (tables.delete_partitions(s, t, facts(s, [("a", JUNE, 0)]), feed=True),      # a move between months
                  tables.upsert_partitions(s, t, facts(s, [("a", JULY, 5, "C"), ("e", JULY, 4)]), feed=True)),
]


def test_marts_and_cubes_follow_the_feed(spark, scratch):
    path, mart, cube = (os.path.join(scratch, n) for n in "tmc")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    for step in STEPS:
        step(spark, path)
        marts.maintain_mart(spark, path, mart)
        kept = marts.maintain_cube(spark, path, cube)
        table = versions.read_current(spark, path, schemas.INVOICE)
        assert order(marts.read_mart(spark, mart)) == order(marts.mart_rows(table))
        assert order(kept) == order(cubes.kpi_cube(table)) == order(cubes.kpi_cube(marts.read_mart(spark, mart)))
    before = versions.versions(spark, mart)
    marts.maintain_mart(spark, path, mart)              # nothing new: no commit
    assert versions.versions(spark, mart) == before
    versions.write_version(facts(spark, [("q", JUNE, 9)]), path, "report_month", replace=[JUNE])   # a commit without feed
    marts.maintain_mart(spark, path, mart)
    assert order(marts.read_mart(spark, mart)) == order(marts.mart_rows(versions.read_current(spark, path, schemas.INVOICE)))


def test_maintenance_reads_no_facts(spark, scratch):
    path, mart = os.path.join(scratch, "t"), os.path.join(scratch, "m")
    STEPS[0](spark, path)
    STEPS[1](spark, path)
    delta = marts.signed_mart(spark, path, 1, versions.versions(spark, path)[-1])
    assert delta.inputFiles() and all("/_feeds/" in f for f in delta.inputFiles())
    marts.maintain_mart(spark, path, mart)
    versions.expire(spark, path, keep=1)                # what it stands for is gone: computed anew, still right
    STEPS[2](spark, path)
    marts.maintain_mart(spark, path, mart)
    assert marts.read_mart(spark, mart).agg(F.sum("records")).first()[0] == versions.read_current(spark, path).count()


def test_changes_between_versions(spark, scratch):
    path = os.path.join(scratch, "t")
    for step in STEPS:
        step(spark, path)
    found = versions.versions(spark, path)
    for start, end in itertools.combinations([0, *found], 2):
        old = versions.read_current(spark, path, schemas.INVOICE, version=start) if start else spark.createDataFrame([], schemas.INVOICE)
        new = versions.read_current(spark, path, schemas.INVOICE, version=end)
        feed = versions.table_changes(spark, path, start, end, PK, schemas.INVOICE)
        assert got(versions.apply_changes(old, feed, PK)) == got(new)
        kinds = {(r.invoice_id, r.report_month, r.change_type) for r in feed.collect()}
        a, b = {x[:2] for x in got(old)}, {x[:2] for x in got(new)}
        assert {k[:2] for k in kinds if k[2] == "insert"} == b - a and {k[:2] for k in kinds if k[2] == "delete"} == a - b
    pruned = versions.table_changes(spark, path, found[-2], found[-1], PK, schemas.INVOICE)
    assert not any("Mei" in f for f in pruned.inputFiles())   # months whose folders are the same are not read


def test_history_by_time(spark, scratch):
    store, name = tables.StoredTables(spark, scratch), "AR_SEGMEN_ERS_TBL"
    store.refresh(name, facts(spark, [("a", JUNE, 1)]), facts={"file": "june.csv"})
    first = versions.read_pointer(spark, store.path(name))["committed_at"]
    time.sleep(0.01)
    for k in range(3):
        store.upsert(name, facts(spark, [("a", JUNE, 10 + k)]))
    past = store.read(name, as_of=first)
    assert got(past) == [("a", JUNE, 1.0)] and got(store.read(name, version=2)) == [("a", JUNE, 10.0)]
    assert versions.version_as_of(spark, store.path(name), first - 1) is None
    assert store.read(name, as_of=first - 1).count() == 0
    log = store.history(name).orderBy("version").collect()
    assert [(r.version, r.parent, r.operation) for r in log] == [
        (1, None, "refresh"), (2, 1, "upsert"), (3, 2, "upsert"), (4, 3, "upsert")] and "june.csv" in log[0].facts
    versions.expire(spark, store.path(name), keep=1, since=log[1].committed_at)
    assert versions.versions(spark, store.path(name)) == [2, 3, 4] and got(store.read(name, version=2)) == [("a", JUNE, 10.0)]
    versions.expire(spark, store.path(name), keep=1)
    assert versions.versions(spark, store.path(name)) == [4] and got(store.read(name)) == [("a", JUNE, 12.0)]
    with pytest.raises(ValueError):
        store.read(name, version=2)


def test_layouts_of_the_fact_table_in_one_table(spark, scratch):
    """Three layouts, one after the other: a column is added, numbers become wider; narrower ones raise."""
    path = os.path.join(scratch, "t")
    a = spark.createDataFrame([("a", JUNE, 1, 7)], "invoice_id string, report_month string, amount int, flag int")
    a = a.withColumn("amount", F.col("amount").cast("decimal(9,2)"))
    b = a.withColumns({"invoice_id": F.lit("b"), "report_month": F.lit(JULY), "amount": F.lit("2.345678").cast("decimal(18,6)"),
                       "flag": F.lit(8).cast("long")})
    c = b.withColumns({"invoice_id": F.lit("c"), "witel": F.lit("W"), "report_month": F.lit("Mei 2026")})
    for df, month in ((a, JUNE), (b, JULY), (c, "Mei 2026")):
        versions.write_version(df, path, "report_month", replace=[month])
    rows = versions.read_current(spark, path)
    assert rows.schema["amount"].dataType == DecimalType(18, 6) and rows.schema["flag"].dataType == LongType()
    assert sorted((r.invoice_id, float(r.amount), r.flag, r.witel) for r in rows.collect()) == [
        ("a", 1.0, 7, None), ("b", 2.345678, 8, None), ("c", 2.345678, 8, "W")]
    with pytest.raises(versions.SchemaError):
        versions.write_version(a, path, "report_month", replace=[JUNE])
    assert len(versions.versions(spark, path)) == 3
    assert versions.read_current(spark, path, version=1).columns[:4] == ["invoice_id", "report_month", "amount", "flag"]


def test_widening_rules():
    d = DecimalType
    assert versions.wider(IntegerType(), LongType()) == LongType()
    assert versions.wider(d(18, 6), d(18, 2)) is None and versions.wider(d(38, 6), d(18, 6)) == d(38, 6)
    assert versions.wider(IntegerType(), d(18, 6)) == d(18, 6) and versions.wider(LongType(), d(18, 6)) is None
    assert versions.wider(StringType(), LongType()) is None
    old = StructType([StructField("a", IntegerType())])
    assert versions.evolved(old, StructType([StructField("A", LongType()), StructField("b", StringType())])).simpleString() == \
        "struct<a:bigint,b:string>"


def test_cube_of_the_mart_is_the_cube_of_the_facts(spark, scratch):
    inv = Fixtures(spark, SF).invoices()
    path = os.path.join(scratch, "m")
    marts.refresh_mart(spark, inv, path)
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(cubes.kpi_cube(marts.read_mart(spark, path))) == order(cubes.kpi_cube(inv))


