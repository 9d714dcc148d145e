"""Sheet import, validation, keyed changes, table writes, the folder stream,
the incremental mart and the payload's consistency with the operators."""

import os

import pytest
from conftest import SF, invoices
from pyspark.sql import functions as F

from kolekta import schemas
from kolekta.operators import cubes, ingest, mutations, quality, summary
from kolekta.plans import tables
from kolekta.sources.fixtures import Fixtures


def _header(spark, labels):
    rows = [(i, f"c{i}", lab) for i, lab in enumerate(labels)]
    return spark.createDataFrame(rows, "idx int, name string, label string")


def test_column_map_ranges(spark):
    # NAME col, KONTRAK with 7 columns (7th ignored), short TERMYN range (3), unknown label, repeated KONTRAK.
    labels = [None, "KONTRAK", None, None, None, None, None, None, " TERMYN ", None, None, "TOTAL", None,
              "CHECKER", None]
    cm = {(r.position, r.category, r.offset) for r in ingest.column_map(_header(spark, labels)).collect()}
    assert {p for p, c, _ in cm if c == "KONTRAK"} == {1, 2, 3, 4, 5, 6}
    assert {(p, o) for p, c, o in cm if c == "TERMYN"} == {(8, 0), (9, 1), (10, 2)}
    assert {p for p, c, _ in cm if c == "CHECKER"} == {13, 14}
    assert not any(c == "TOTAL" for _, c, _ in cm)
    labels2 = [None, "KONTRAK", None, "KONTRAK", None]
    cm2 = {(r.position, r.offset) for r in ingest.column_map(_header(spark, labels2)).collect()}
    assert cm2 == {(3, 0), (4, 1)}                 # a repeated label: its last range wins


def test_select_sheets_first_wins_and_unknown_skipped(spark):
    wide = spark.createDataFrame([(1, "OI 202607", 4), (2, "Update Nilai AR (Tio Juli)", 3), (3, "Rekap", 0),
                                  (4, "OI 202606", 5), (5, "OI 202606", 5)], "row_idx long, sheet string, sheet_pos int")
    got = {(r.row_idx, r.report_month) for r in ingest.select_sheets(wide).collect()}
    assert got == {(2, "Juli 2026"), (4, "Juni 2026"), (5, "Juni 2026")}


def test_unpivot_counts_nonzero_numeric_cells(spark):
    fx = Fixtures(spark, SF)
    wide, header = fx.open_item_wide(), fx.open_item_header()
    cells = ingest.coerce_amount(ingest.unpivot_cells(wide, ingest.column_map(header)))
    kept = wide.where("row_idx % 97 not between 1 and 6")      # one real cell per row, but for the oddities
    assert cells.count() == kept.count()
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Join")
    assert "+- Expand" not in cells._jdf.queryExecution().executedPlan().toString()   # no copy for empty cells
    assert joins(cells) == joins(wide)                                                # no lookup of positions
    imported = ingest.import_open_items(wide, header)
    assert imported.select("invoice_id", "report_month").distinct().count() == imported.count()
    assert imported.where("nilai_m is null").count() == 0
    assert set(imported.columns) == {f.name for f in schemas.INVOICE.fields}


def test_each_sheet_has_its_own_header(spark):
    wide = spark.createDataFrame([(0, "OI 202606", 1, "5000000", "7000000"), (0, "OI 202607", 0, "1000000", None)],
                                 "row_idx long, sheet string, sheet_pos int, `Aging.1` string, `b` string")
    header = spark.createDataFrame([("OI 202606", 0, "Aging.1", "KONTRAK"), ("OI 202606", 1, "b", None),
                                    ("OI 202607", 0, "Aging.1", "TERMYN"), ("OI 202607", 1, "b", "CHECKER")],
                                   "sheet string, idx int, name string, label string")
    got = {(r.report_month, r.invoice_status, r.aging_category, float(r.nilai_m))
           for r in ingest.import_open_items(wide, header).collect()}
    b = {k: a for k, _, a, _ in __import__("kolekta.vocab").vocab.BRACKETS}
    assert got == {("Juni 2026", "KONTRAK", b[0], 0.005), ("Juni 2026", "KONTRAK", b[1], 0.007), ("Juli 2026", "TERMYN", b[0], 0.001)}


def test_too_large_amounts_are_rejected_with_a_reason(spark):
    wide = spark.createDataFrame([(0, "OI 202606", 1, "1e25"), (1, "OI 202606", 1, "12d"), (2, "OI 202606", 1, " 2e9 ")],
                                 "row_idx long, sheet string, sheet_pos int, a string")
    header = spark.createDataFrame([(0, "a", "KONTRAK")], "idx int, name string, label string")
    assert [float(r.nilai_m) for r in ingest.import_open_items(wide, header).collect()] == [2.0]
    assert [(r.row_idx, r.raw, r.reasons) for r in ingest.import_rejects(wide, header).collect()] == [(0, "1e25", "amount_overflow")]


def test_clean_file_keeps_large_amounts(spark):
    raw = spark.createDataFrame([("1", "1e13"), ("2", "abc"), ("3", None), ("4", " 1.5 "), ("5", "9" * 40), ("6", "12d")],
                                "invoice_id string, nilai_m string")
    got = {r.invoice_id: r.nilai_m for r in quality.clean_file(raw).collect()}
    assert {k: None if v is None else float(v) for k, v in got.items()} == {"1": 1e13, "2": 0, "3": 0, "4": 1.5, "5": None, "6": 0}
    checked = quality.clean_file(raw).withColumn("status_tagih", F.lit("AR LAYAK TAGIH"))
    assert {r.invoice_id: r.reasons for r in quality.validate(checked, amount="nilai_m").collect()}["5"] == "bad_amount"


def test_validate_reasons(spark):
    df = invoices(spark, [("X1", None, "AR LAYAK TAGIH", None, None, 1.0), ("X1", None, "AR LAYAK TAGIH", None, None, 2.0),
                          (None, None, "AR BERMASALAH", None, None, 1.0), ("X2", None, "WRONG", None, None, 1.0),
                          ("X3", None, "AR LAYAK TAGIH", None, None, 1.0)])
    got = sorted((r.invoice_id or "", r.reasons, r.is_valid) for r in quality.validate(df).collect())
    assert got == [("", "missing_id", False), ("X1", "duplicate_id", False), ("X1", "duplicate_id", False),
                   ("X2", "bad_status", False), ("X3", "", True)]
    good, bad = quality.split_valid(df)
    assert good.count() == 1 and bad.count() == 4
    two_years = df.where("invoice_id = 'X3'").withColumn("report_month", F.explode(F.array(F.lit("Juni 2026"), F.lit("Juni 2027"))))
    assert quality.validate(two_years).where("is_valid").count() == 2


def test_mutations(spark):
    t = invoices(spark, [("K1", None, None, "A", None, 1.0), ("K2", None, None, "B", None, 2.0)])
    ch = spark.createDataFrame([("K1", None), ("K9", "Z")], "INVOICE_ID string, REGION string")
    up = {r.invoice_id: r.region for r in mutations.update_rows(t, ch, "invoice_id").collect()}
    assert up == {"K1": None, "K2": "B"}                        # set to null; unknown key ignored
    with pytest.raises(ValueError):
        mutations.update_rows(t, ch.select("INVOICE_ID"), "invoice_id")
    with pytest.raises(ValueError):
        mutations.update_rows(t, ch.withColumn("bogus", F.lit(1)), "invoice_id")
    assert mutations.delete_rows(t, ch.select("INVOICE_ID"), "invoice_id").count() == 1
    new = spark.createDataFrame([("K2",)], "invoice_id string")
    for bad in (new, new.union(new).withColumn("invoice_id", F.lit("K7")), new.withColumn("invoice_id", F.lit(None).cast("string"))):
        with pytest.raises(mutations.DuplicateKeyError):
            mutations.append_rows(t, bad, "invoice_id")
    twin = ch.union(ch)
    with pytest.raises(mutations.DuplicateKeyError):
        mutations.update_rows(t, twin, "invoice_id")
    with pytest.raises(mutations.DuplicateKeyError):
        mutations.upsert_rows(t, twin, "invoice_id")
    src = invoices(spark, [("K2", None, None, "C", None, 5.0), ("K3", None, None, "D", None, 6.0)])
    once = mutations.upsert_rows(t, src, "invoice_id")
    twice = mutations.upsert_rows(once, src, "invoice_id")
    key = lambda d: sorted((r.invoice_id, r.region, float(r.nilai_m)) for r in d.collect())
    assert key(once) == key(twice) == [("K1", "A", 1.0), ("K2", "C", 5.0), ("K3", "D", 6.0)]
    part = spark.createDataFrame([("K2", 9.0), ("K4", 4.0)], "invoice_id string, nilai_m double")
    merged = {r.invoice_id: (r.region, float(r.nilai_m), r.above_credit_limit)
              for r in mutations.upsert_rows(t, part, "invoice_id", defaults={"above_credit_limit": 0}).collect()}
    assert merged == {"K1": ("A", 1.0, None), "K2": ("B", 9.0, None), "K4": (None, 4.0, 0)}   # columns not supplied stay


def _facts(spark, rows):
    """(id, month, region, amount) rows in the fact schema."""
    return schemas.conform(spark.createDataFrame(rows, "invoice_id string, report_month string, region string, nilai_m double"))


def _got(df):
    return sorted((r.invoice_id, r.report_month, r.region, float(r.nilai_m)) for r in df.collect())


def test_refresh_then_changes_in_one_layout(spark, scratch):
    store, name = tables.StoredTables(spark, scratch), "AR_SEGMEN_ERS_TBL"
    tables.create_tables(spark, scratch)
    assert store.read(name).count() == 0
    store.upsert(name, _facts(spark, [("K1", "Juni 2026", "A", 1.0)]))                       # create, then upsert
    out = store.upsert(name, _facts(spark, [("K1", "Juni 2027", "B", 2.0)]))                 # the same id a year later
    assert _got(out) == [("K1", "Juni 2026", "A", 1.0), ("K1", "Juni 2027", "B", 2.0)]
    store.refresh(name, _facts(spark, [("K1", "Juni 2026", "A", 1.0), ("K2", "Juli 2026", "B", 2.0), ("K3", None, "C", 3.0)]))
    store.upsert(name, _facts(spark, [("K2", "Juli 2026", "Z", 5.0)]))                       # refresh, then upsert
    store.update(name, spark.createDataFrame([("K1", "Juni 2026", "Y")], "INVOICE_ID string, REPORT_MONTH string, REGION string"))
    assert sorted((r.invoice_id, r.region) for r in store.read(name).collect()) == [("K1", "Y"), ("K2", "Z"), ("K3", "C")]
    left = store.delete(name, spark.createDataFrame([("K2", "Juli 2026"), ("K9", "Mei 2026")], "invoice_id string, report_month string"))
    assert sorted(r.invoice_id for r in left.collect()) == ["K1", "K3"]
    with pytest.raises(mutations.DuplicateKeyError):
        store.append(name, _facts(spark, [("K1", "Juni 2026", "A", 1.0)]))
    store.append(name, spark.createDataFrame([("K4", "Juni 2026")], "invoice_id string, report_month string"))
    assert store.read(name).where("invoice_id = 'K4'").first().above_credit_limit == 0
    with pytest.raises(ValueError):
        store.read("USERS")


def test_table_of_two_key_columns_and_without_partitions(spark, scratch):
    store = tables.StoredTables(spark, scratch)
    cust = spark.createDataFrame([("X", "Juni 2026", 1.0), ("X", "Juli 2026", 2.0)], "customer_name string, report_month string, balance double")
    store.upsert("AR_TOP_CUSTOMERS_TBL", cust)
    store.delete("AR_TOP_CUSTOMERS_TBL", cust.where("balance = 1"))
    assert [r.report_month for r in store.read("AR_TOP_CUSTOMERS_TBL").collect()] == ["Juli 2026"]
    months = spark.createDataFrame([("a", 1), ("b", 2)], "month_label string, sort_order int")
    store.upsert("AR_TREND_T13M_TBL", months)
    store.update("AR_TREND_T13M_TBL", months.where("sort_order = 2").withColumn("sort_order", F.lit(9)))
    store.delete("AR_TREND_T13M_TBL", months.where("sort_order = 1"))
    assert [(r.month_label, r.sort_order) for r in store.read("AR_TREND_T13M_TBL").collect()] == [("b", 9)]


def test_readers_keep_their_version_and_old_ones_expire(spark, scratch):
    path = os.path.join(scratch, "t")
    tables.upsert_partitions(spark, path, _facts(spark, [("K1", "Juni 2026", "A", 1.0), ("K2", "Juli 2026", "B", 2.0)]))
    before = tables.read_current(spark, path, schemas.INVOICE)
    for k in range(3):
        tables.upsert_partitions(spark, path, _facts(spark, [("K1", "Juni 2026", "A", float(k))]))
    assert _got(before)[0][3] == 1.0                                          # the files of its version still stand
    folders = lambda: sum("part-" in f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    many = folders()
    tables.expire(spark, path, keep=1)
    assert folders() < many and len(tables.versions(spark, path)) == 1
    assert _got(tables.read_current(spark, path, schemas.INVOICE)) == [("K1", "Juni 2026", "A", 2.0), ("K2", "Juli 2026", "B", 2.0)]


def test_a_second_writer_of_a_version_is_refused(spark, scratch):
    path = os.path.join(scratch, "t")
    tables.write_version(_facts(spark, [("K1", "Juni 2026", "A", 1.0)]), path, "report_month")
    with pytest.raises(tables.ConcurrentWriteError):
        tables.write_version(_facts(spark, [("K2", "Juni 2026", "A", 1.0)]), path, "report_month", expected=0)


def test_first_batch_without_rows(spark, scratch):
    path = os.path.join(scratch, "t")
    assert tables.upsert_partitions(spark, path, _facts(spark, []).limit(0)).count() == 0
    assert tables.upsert_partitions(spark, path, _facts(spark, [("K1", "Juni 2026", "A", 1.0)])).count() == 1


def test_export_is_byte_for_byte_that_of_the_dashboard(spark, scratch):
    """Against an independent rendering by the json module."""
    import glob
    import json
    rows = [("c", "x,y\n\"q\" \\n \\", 1.5, 7), ("a", None, None, None), (" b ", "\x0b\x1f\x00é\u2028", -0.25, -3),
            ("d", "", 100.0, 0), ("e", "\\u000B", 0.0, 12), ("f", "\r\n\t\b\f", 1234567.125, 2 ** 40)]
    df = spark.createDataFrame(rows, "x string, y string, z double, n long").withColumn("d", F.col("z").cast("decimal(18,6)"))
    path = tables.export_csv(df.repartition(4), scratch, "Juni 2026", "ALL", "2026-12-02")
    assert path.endswith("AR_Data_Juni_2026_ALL_2026-12-02")
    text = lambda v: json.dumps("" if v is None else v, ensure_ascii=False)
    number = lambda v: '""' if v is None else repr(v)[:-2] if repr(v).endswith(".0") else repr(v)
    want = "x,y,z,n,d\n" + "".join(
        ",".join([text(x), text(y), number(z), number(n), number(z)]) + "\n" for x, y, z, n in sorted(rows))
    got = b"".join(open(f, "rb").read() for k in (0, 1) for f in sorted(glob.glob(f"{path}/part={k}/part-*")))
    assert got == want.encode()
    back = tables.read_export(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.fillna("", ["x", "y"]).collect(), key=lambda r: r.x)
    assert tables.export_csv(df.limit(0), scratch) is None


def test_create_tables_and_load_log(spark, scratch):
    made = tables.create_tables(spark, scratch)
    assert set(made) == set(schemas.TABLES)
    log = tables.load_log(invoices(spark, [("K1", None, None, None, None, 1.0)]).withColumn("report_month", F.lit("Juni 2026")),
                          os.path.join(scratch, "log"))
    assert [(r.report_month, r.records) for r in log.collect()] == [("Juni 2026", 1)]


def test_cube_all_equals_kpi(spark):
    inv = Fixtures(spark, SF).invoices()
    k = summary.kpi_summary(inv).first()
    c = cubes.kpi_cube(inv).where("month = 'ALL' and segment = 'ALL' and region = 'ALL'").first()
    assert (c.total_ar_m, c.layak_m, c.n) == (k.total_ar_m, k.total_layak_tagih_m, k.total_records)


def test_mart_answers_like_the_fact_table(spark, scratch):
    from kolekta.operators import flow
    from kolekta.plans.marts import mart_kpi, read_mart, refresh_mart
    from kolekta.plans.payload import dashboard_payload, payload_values
    fx = Fixtures(spark, SF)
    inv = fx.invoices()
    path = os.path.join(scratch, "mart")
    refresh_mart(spark, inv, path)
    mart = read_mart(spark, path)
    month = inv.select("report_month").first()[0]
    for args in ({}, {"month": month, "segment": "BUILDING"}):
        k, m = summary.kpi_summary(inv, **args).first(), mart_kpi(mart, **args).first()
        assert (m.total_ar_m, m.layak_m, m.n) == (k.total_ar_m, k.total_layak_tagih_m, k.total_records)
    assert flow.flow_levels(mart).first() == flow.flow_levels(inv).first()
    rest = (fx.top_customers(), fx.cash_inflow(), fx.trend_t13m(), fx.metrics_history())
    rows = lambda facts: sorted(map(tuple, payload_values(dashboard_payload(facts, *rest)).collect()), key=str)
    assert rows(mart) == rows(inv)
    plan = flow.flow_levels(mart)._jdf.queryExecution().executedPlan().toString()
    assert "mart" in plan and "orders" not in plan                      # the fact table is not read


def test_mart_follows_moves_between_months(spark, scratch):
    from kolekta.plans.marts import mart_kpi, read_mart, refresh_mart
    path, mart = os.path.join(scratch, "t"), os.path.join(scratch, "mart")
    one = _facts(spark, [("K1", "Juni 2026", "A", 2.0)])
    refresh_mart(spark, tables.upsert_partitions(spark, path, one), mart)
    tables.upsert_partitions(spark, path, one.withColumn("report_month", F.lit("Juli 2026")))
    table = tables.delete_partitions(spark, path, one)
    refresh_mart(spark, table, mart, ["Juni 2026", "Juli 2026"])
    row = mart_kpi(read_mart(spark, mart)).first()
    assert (row.total_ar_m, row.n) == (2.0, 1)


def _stream(spark, scratch, name, batches, header, mart=None):
    """Run the folder stream over frames that land one after the other; the table and its folder."""
    from kolekta.streaming.folder_ingest import stream_ingest
    root = os.path.join(scratch, name)
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{root}/landing")
        t = stream_ingest(spark, f"{root}/landing", f"{root}/table", f"{root}/ckpt", header, b.schema, mart_path=mart, files_per_batch=1)
    return t, f"{root}/table"


def test_stream_does_not_depend_on_batches(spark, scratch):
    schema = "row_idx long, sheet string, sheet_pos int, CA string, a string"
    header = spark.createDataFrame([(0, "CA", None), (1, "a", "KONTRAK")], "idx int, name string, label string")
    early = spark.createDataFrame([(0, "Update Nilai AR (Tio Juli)", 1, "1", "1e9"), (1, "Update Nilai AR (Tio Juli)", 1, "2", "2e9")], schema)
    late = spark.createDataFrame([(0, "OI 202607", 3, "1", "7e9"), (9, "OI 202607", 3, "3", "8e9"), (2, "OI 202607", 3, "3", "1e25")], schema)
    june = spark.createDataFrame([(0, "OI 202606", 4, "1", "3e9"), (1, "Rekap", 0, "1", "5e9")], schema)
    want = _got(_stream(spark, scratch, "one", [early.union(late).union(june)], header)[0])
    assert [round(r[3], 3) for r in want] == [1.0, 2.0, 3.0] or len(want) == 3
    for k, order in enumerate(([early, late, june], [late, june, early], [june, late, early.limit(1), early])):
        mart = os.path.join(scratch, f"mart{k}")
        table, path = _stream(spark, scratch, f"many{k}", order, header, mart)
        assert _got(table) == want
        from kolekta.plans.marts import mart_kpi, read_mart
        assert mart_kpi(read_mart(spark, mart)).first().n == 3
    rejects = spark.read.parquet(f"{path}_rejects")
    assert {r.reasons for r in rejects.collect()} <= {"amount_overflow"}
    assert spark.read.parquet(f"{path}_log").agg(F.sum("records")).first()[0] >= 3


def test_import_of_a_batch_is_dealt_to_all_tasks(spark, scratch, monkeypatch):
    """A landed file of one row group is read by one task, which must not import all of it."""
    from kolekta.streaming import folder_ingest
    plans = []

    def import_cells(batch, *args, **kw):
        plans.append(batch._jdf.queryExecution().optimizedPlan().toString())
        return ingest.import_cells(batch, *args, **kw)

    monkeypatch.setattr(folder_ingest, "import_cells", import_cells)
    header = spark.createDataFrame([(0, "CA", None), (1, "a", "KONTRAK")], "idx int, name string, label string")
    rows = spark.createDataFrame([(k, "OI 202607", 3, str(k), "1e9") for k in range(50)],
                                 "row_idx long, sheet string, sheet_pos int, CA string, a string")
    assert _stream(spark, scratch, "dealt", [rows], header)[0].count() == 50
    assert plans and all(p.startswith("RepartitionByExpression [sheet") for p in plans)


def test_stream_of_repeated_keys_in_any_order_and_grouping(spark, scratch):
    """Files of one sheet that hold the same rows: every order and grouping of them gives one table."""
    import itertools
    from kolekta.streaming.folder_ingest import merge_batch
    schema = "row_idx long, sheet string, sheet_pos int, CA string, a string, land_file string"
    header = spark.createDataFrame([(0, "CA", None), (1, "a", "KONTRAK")], "idx int, name string, label string")
    july, first = "OI 202607", "Update Nilai AR (Tio Juli)"
    files = {
        "f1": [(0, july, 3, "1", "1e9", "f1"), (1, july, 3, "2", "2e9", "f1")],
        "f2": [(0, july, 3, "1", "5e9", "f2"), (7, july, 3, "9", "6e9", "f2"), (7, july, 3, "9", "7e9", "f2")],  # a key twice
        "f3": [(1, july, 3, "2", "8e9", "f3"), (7, july, 3, "9", "9e9", "f3")],
        "g": [(0, first, 1, "1", "4e9", "g")],
    }
    def table(groups, name):
        path = os.path.join(scratch, name)
        for k, g in enumerate(groups):
            merge_batch(spark, spark.createDataFrame([r for f in g for r in files[f]], schema), header, path, k)
        return _got(tables.read_current(spark, path, schemas.INVOICE))
    three = table([["f1", "f2", "f3"]], "all")
    assert [round(r[3], 1) for r in sorted(three)] == [5.0, 8.0, 9.0]
    for k, order in enumerate(itertools.permutations(["f1", "f2", "f3"])):
        assert table([[f] for f in order], f"p{k}") == three
    assert table([["f3", "f1"], ["f2"]], "q") == three and table([["f2"], ["f1", "f3"], ["f1"]], "r") == three
    taken = table([["f1", "g", "f2", "f3"]], "t")
    assert len(taken) == 1 and taken == table([["f1"], ["f2", "f3"], ["g"]], "u") == table([["g"], ["f3"], ["f1", "f2"]], "v")


def test_stream_keeps_a_change_that_overlaps_a_batch(spark, scratch, monkeypatch):
    from kolekta.streaming import folder_ingest
    schema = "row_idx long, sheet string, sheet_pos int, CA string, a string"
    header = spark.createDataFrame([(0, "CA", None), (1, "a", "KONTRAK")], "idx int, name string, label string")
    batch = lambda i, v: spark.createDataFrame([(i, "OI 202607", 3, "1", v)], schema)
    path = os.path.join(scratch, "t")
    folder_ingest.merge_batch(spark, batch(0, "1e9"), header, path, 0)
    real, done = folder_ingest.merge_latest, []

    def slow(*a, **k):
        if not done:
            done.append(1)
            tables.upsert_partitions(spark, path, _facts(spark, [("K9", "Juli 2026", "A", 5.0)]))
        return real(*a, **k)
    monkeypatch.setattr(folder_ingest, "merge_latest", slow)
    folder_ingest.merge_batch(spark, batch(4, "3e9"), header, path, 1)
    assert sorted(r[3] for r in _got(tables.read_current(spark, path, schemas.INVOICE))) == [1.0, 3.0, 5.0]
    assert folder_ingest.claims(tables.read_pointer(spark, path)) == {"Juli 2026": (3, "OI 202607")}
    whole = tables.read_current(spark, path)   # a keyed change keeps the column that the stream added
    assert sorted((float(r.nilai_m), r.land_file) for r in whole.collect()) == [(1.0, ""), (3.0, ""), (5.0, None)]


def test_stream_replays_harmlessly(spark, scratch):
    from kolekta.streaming.folder_ingest import merge_batch
    fx = Fixtures(spark, SF)
    wide, header = fx.open_item_wide(), fx.open_item_header()
    path = os.path.join(scratch, "table")
    for _ in range(2):
        merge_batch(spark, wide, header, path, 7)
    table = tables.read_current(spark, path, schemas.INVOICE)
    assert table.count() == ingest.import_open_items(wide, header).count()
    over = ingest.import_rejects(wide, header).count()
    assert spark.read.parquet(f"{path}_rejects").count() == over > 0
    nothing = os.path.join(scratch, "none")
    merge_batch(spark, wide.limit(0), header, nothing, 0)                  # a first batch without rows
    assert tables.read_current(spark, nothing, schemas.INVOICE).count() == 0


def test_predicates_cover_every_row_once(spark):
    from kolekta.sources.catalog import covering_predicates
    df = spark.createDataFrame([("Juni 2026",), ("Juli 2026",), ("O'x",), ("Mei 2020",), (None,)], "report_month string")
    for months in ([], ["Juni 2026", "O'x", "Juni 2026"], ["nothing"]):
        parts = [df.where(p) for p in covering_predicates("report_month", months)]
        assert sum(p.count() for p in parts) == 5
        assert sorted(str(r[0]) for p in parts for r in p.collect()) == sorted(str(r[0]) for r in df.collect())


def test_landed_sheet_to_facts(spark, scratch):
    from kolekta.sources.catalog import read_workbook
    paths = []
    for k, (labels, cells) in enumerate(((",,KONTRAK,,TERMYN,", "1000000,,5e9,"), (",,TERMYN,,KONTRAK,", "1000000,,5e9,x"))):
        paths.append((("OI 202606", "OI 202607")[k], os.path.join(scratch, f"s{k}.csv")))
        with open(paths[-1][1], "w") as f:
            f.write(f"{labels}\nskip,me,,,,\n NAME ,CA,Aging,Aging2,Aging,\n\"A\nB\",77,{cells}\nC,88,,,,\n")
    wide, header = read_workbook(spark, paths)
    assert sorted((r.sheet, r.row_idx, r.NAME) for r in wide.collect()) == [
        ("OI 202606", 0, "A\nB"), ("OI 202606", 1, "C"), ("OI 202607", 0, "A\nB"), ("OI 202607", 1, "C")]
    got = {(r.invoice_id, r.report_month, r.invoice_status, float(r.nilai_m)) for r in ingest.import_open_items(wide, header).collect()}
    assert got == {("JUN77-KONT-0-0", "Juni 2026", "KONTRAK", 0.001), ("JUN77-TERM-0-0", "Juni 2026", "TERMYN", 5.0),
                   ("JUL77-TERM-0-0", "Juli 2026", "TERMYN", 0.001), ("JUL77-KONT-0-0", "Juli 2026", "KONTRAK", 5.0)}


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_rows_are_numbered_alike_in_any_splits(spark, scratch, ends):
    """Empty lines count, quoted cells may hold line ends, and the splits do not matter."""
    import random
    from kolekta.sources.catalog import read_sheet
    draw, lines, want, n = random.Random(8), [",,KONTRAK", "a title", " NAME ,CA, Aging "], [], 0
    for k in range(400):
        kind = draw.randrange(8)
        if kind == 0:
            lines.append("")
            want.append((n, None, None, None))
        elif kind == 1:
            lines.append(f'"A ""{k}""{ends}second, line{ends}{ends}",{k},"5{k}"')
            want.append((n, f'A "{k}"{ends}second, line{ends}{ends}', str(k), f"5{k}"))
        else:
            lines.append(f"name{k},,{k}" if kind < 5 else f"short{k}")
            want.append((n, f"name{k}", None, str(k)) if kind < 5 else (n, f"short{k}", None, None))
        n += 1
    path = os.path.join(scratch, "sheet.csv")
    with open(path, "w", newline="") as f:
        f.write(ends.join(lines) + ends)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("134217728", "700", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            wide, header = read_sheet(spark, path, "OI 202606", 0)
            assert sorted((r.row_idx, r.NAME, r.CA, r.Aging) for r in wide.collect()) == want
            assert [(r.name, r.label) for r in header.orderBy("idx").collect()] == [("NAME", None), ("CA", None), ("Aging", "KONTRAK")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_files_of_a_sheet_follow_each_other_by_name(spark, scratch):
    """A sheet in several files is one run of records, also where a quoted cell goes on in the next file."""
    from kolekta.sources.catalog import read_sheet
    for name, quoted in (("plain", False), ("quoted", True)):
        folder = os.path.join(scratch, name)
        os.makedirs(folder)
        for file, text in (("part-1", "a0,1\n\n"), ("part-0", ",KONTRAK\na title\nNAME,Aging\n"),
                           ("part-2", 'a2,"3\n' if quoted else "a2,3\n"), ("part-3", '4"\na3,5\n' if quoted else "a3,5\n")):
            with open(os.path.join(folder, file), "w") as f:
                f.write(text)
        wide, _ = read_sheet(spark, folder, "OI 202606", 0)
        assert sorted((r.row_idx, r.NAME, r.Aging) for r in wide.collect()) == [
            (0, "a0", "1"), (1, None, None), (2, "a2", "3\n4" if quoted else "3"), (3, "a3", "5")]


def test_customers_of_one_cut_name_are_one(spark):
    from kolekta.operators.customers import customer_rollup
    df = invoices(spark, [("K1", "Within Due", None, None, None, 1.0), ("K2", "Within Due", None, None, None, 2.0)])
    df = df.withColumn("customer_name", F.concat(F.lit("x" * 100), "invoice_id")).withColumn("report_month", F.lit("Juni 2026"))
    assert [(r.customer_name, r.balance) for r in customer_rollup(df).collect()] == [("x" * 100, 3000.0)]


def test_payload_matches_operators(spark):
    from kolekta.operators import flow
    from kolekta.plans.payload import dashboard_payload
    fx = Fixtures(spark, SF)
    inv = fx.invoices()
    p = dashboard_payload(inv, fx.top_customers(), fx.cash_inflow(), fx.trend_t13m(), fx.metrics_history()).first()
    k = summary.kpi_summary(inv).first()
    s = p.summary
    assert (s.total_ar_m, s.over_due_m, s.overdue_pct, s.total_records) == (k.total_ar_m, k.over_due_m, k.overdue_pct, k.total_records)
    assert s.largest_segment == summary.largest_segment(inv).first().largest_segment
    assert dict(p.charts.segment_breakdown) == {r.pengelolaan: r.v for r in summary.segment_breakdown(inv).collect()}
    assert [(r.region, r.value, r.percentage) for r in p.charts.region_breakup] == \
        sorted((r.region, r.value, r.percentage) for r in summary.region_breakup(inv).collect())
    assert [(r.ord, r.kategori, r.nilai_m) for r in p.action_plan] == \
        [(r.ord, r.kategori, r.nilai_m) for r in flow.action_plan(inv).collect()]
    assert p.charts.ar_flow.jakarta.total_m == flow.flow_levels(inv).first().home_total_m
    assert set(p.charts.history_trend) == {r[0] for r in inv.select("report_month").distinct().collect()}
    assert dict(p.charts.ar_flow.regional.breakdown) == {r.region: r.v for r in flow.flow_regional(inv).collect()}
    assert len(p.top_customers) == 20 and len(p.charts.sparkline_months) == 12
    import json
    from kolekta.plans.payload import payload_json
    doc = json.loads(payload_json(dashboard_payload(inv, fx.top_customers(), fx.cash_inflow(), fx.trend_t13m(),
                                                    fx.metrics_history())).first().json)
    assert set(doc) == {"summary", "charts", "action_plan", "top_customers"}
    assert doc["summary"]["active_filters"] == {"month": "ALL", "segment": "ALL", "region": "ALL"}
