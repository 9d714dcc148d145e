"""Registered queries for the sheet import, data quality, keyed table changes,
the table catalog, the payload and the folder stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kolekta import schemas, vocab
from kolekta.functions.scalar import ora_date
from kolekta.operators import ingest, mutations, quality, summary
from kolekta.plans import indexes, marts, tables
from kolekta.plans.oracle_sql import FACT_COLS, M, S, ST, TOP_CUST, WITH_INV, fact_select, in_list, q
from kolekta.plans.payload import dashboard_payload, payload_values
from kolekta.plans.registry import ORACLE, inv, out, register
from kolekta.session import scratch_path
from kolekta.sources.catalog import CSV_CELLS, TableCatalog, read_snapshots, read_workbook
from kolekta.sources.fixtures import Fixtures

# --- sheet import -------------------------------------------------------------

_SHEETS = [s for s, _ in vocab.SHEET_MONTHS] + ["Rekap"]   # stand-in: sheet of a row = its key mod 7
_SHEET_VALUES = ", ".join(f"({q(s)}, {i})" for i, s in enumerate(_SHEETS))
_DIM_VALUES = ", ".join(f"({q(s)}, {q(m)})" for s, m in vocab.SHEET_MONTHS)
# On odd sheets the categories stand three places further on.
_CAT_NAME = f"case (o_orderkey % 8 + 3 * ((o_orderkey % {len(_SHEETS)}) % 2)) % 8 " + " ".join(f"when {i} then {q(c)}" for i, c in enumerate(vocab.CATEGORIES)) + " end"
_AGING = "case bracket " + " ".join(f"when {b} then {q(a)}" for b, _, a, _ in vocab.BRACKETS) + " end"
_STATUS = "case bracket " + " ".join(f"when {b} then {q(s)}" for b, _, _, s in vocab.BRACKETS) + " end"
_TXT = ("concat(case when o_orderkey % 89 = 0 then '-' else '' end, "
        "cast(cast(o_totalprice * 1000000 as decimal(20,2)) as varchar))")

# Rows of the open-item sheet as the importer must see them, straight from orders.
_BASE = f"""with b as (
 select o_orderkey as row_idx, o_orderkey % {len(_SHEETS)} as sheet_pos, {_CAT_NAME} as category,
  o_custkey % 6 as bracket, 10 + (o_orderkey % 8) * 6 + (o_custkey % 6) as pos,
  case when o_orderkey % 97 between 1 and 6 then null else cast({_TXT} as decimal(24,2)) end as v,
  round(cast({_TXT} as decimal(24,2)) * cast('0.000000001' as decimal(10,9)), 6) as amt,
  nullif(substr(trim(c_name), 1, 100), '') as customer_name,
  nullif(substr(trim(cast(o_custkey as varchar)), 1, 30), '') as ca,
  nullif(substr(trim(cast(c_custkey as varchar)), 1, 30), '') as bp_num,
  nullif(substr(trim('N' || cast(c_custkey as varchar)), 1, 30), '') as nipnas,
  nullif(substr(trim(case when o_custkey % 13 = 0 then '  ' else c_mktsegment end), 1, 10), '') as pengelolaan,
  coalesce(nullif(substr(trim(case when o_custkey % 13 = 0 then '  ' else c_mktsegment end), 1, 50), ''), {q(vocab.UIC_DEFAULT)}) as uic,
  nullif(substr(trim(case when r_name = 'ASIA' then ' Jakarta ' else r_name end), 1, 50), '') as region,
  nullif(substr(trim(n_name), 1, 50), '') as witel,
  nullif(substr(trim(o_orderpriority), 1, 100), '') as satker,
  nullif(substr(trim('R' || cast(n_regionkey as varchar)), 1, 50), '') as reg,
  coalesce(nullif(substr(trim(case when o_orderkey % 5 = 0 then 'Follow up' end), 1, 200), ''), {q(vocab.ACTION_DEFAULT)}) as action_plan
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
sheets as (select * from (values {_SHEET_VALUES}) t(sheet, sheet_pos)),
dim as (select * from (values {_DIM_VALUES}) t(sheet, report_month)),
chosen as (select sheet, sheet_pos, report_month from (
  select s.sheet, s.sheet_pos, d.report_month, row_number() over (partition by d.report_month order by s.sheet_pos, s.sheet) as rn
  from sheets s join dim d on s.sheet = d.sheet where s.sheet_pos in (select distinct sheet_pos from b)) x where rn = 1),
sel as (select b.*, c.sheet, c.report_month from b join chosen c on b.sheet_pos = c.sheet_pos),
imp as (select substr(upper(substr(report_month, 1, 3)) || substr(coalesce(ca, ''), 1, 8) || '-' || substr(category, 1, 4)
  || '-' || cast(bracket as varchar) || '-' || cast(row_idx as varchar), 1, 50) as invoice_id,
  customer_name, {_AGING} as aging_category, {_STATUS} as status_tagih, region, substr(category, 1, 50) as invoice_status,
  cast(amt as decimal(18,6)) as nilai_m, uic, substr(report_month, 1, 30) as due_date, action_plan,
  cast(0 as integer) as above_credit_limit, substr(report_month, 1, 20) as report_month, pengelolaan, bp_num, nipnas,
  witel, satker, reg,
  case when category in {in_list(vocab.SUDAH_CATS)} then {q(vocab.SUDAH_INVOICE)} else {q(vocab.BELUM_INVOICE)} end as status_invoice
 from sel where v is not null and v <> 0)"""


def _fx(spark, sf):
    return Fixtures(spark, sf)


def _imported(spark, sf):
    fx = _fx(spark, sf)
    return ingest.import_open_items(fx.open_item_wide(), fx.open_item_header())


def _cells(spark, sf):
    fx = _fx(spark, sf)
    return ingest.coerce_amount(ingest.unpivot_cells(fx.open_item_wide(), ingest.column_map(fx.open_item_header())))


@register("sheet_select", f"{_BASE} select row_idx, sheet, report_month from sel")
def _sheet_select(spark, sf):
    return ingest.select_sheets(_fx(spark, sf).open_item_wide()).select("row_idx", "sheet", "report_month")


@register("coerce_amount", f"{_BASE} select row_idx, cast(pos as integer) as pos, cast(v as double) as v from b where v is not null and v <> 0")
def _coerce_amount(spark, sf):
    return _cells(spark, sf).select("row_idx", F.col("pos").cast("int").alias("pos"), F.col("v").cast("double").alias("v"))


@register("classify_aging", f"""{_BASE} select row_idx, cast(bracket as integer) as bracket, {_AGING} as aging_category,
 {_STATUS} as status_tagih from b where v is not null and v <> 0""")
def _classify_aging(spark, sf):
    return ingest.classify_aging(_cells(spark, sf)).select(
        "row_idx", F.col("bracket").cast("int").alias("bracket"), "aging_category", "status_tagih")


@register("classify_invoice", f"""{_BASE} select row_idx, category,
 case when category in {in_list(vocab.SUDAH_CATS)} then {q(vocab.SUDAH_INVOICE)} else {q(vocab.BELUM_INVOICE)} end as status_invoice
 from b where v is not null and v <> 0""")
def _classify_invoice(spark, sf):
    return ingest.classify_invoice(_cells(spark, sf)).select("row_idx", "category", "status_invoice")


_IDENT = ("customer_name", "ca", "bp_num", "nipnas", "pengelolaan", "region", "witel", "satker", "reg", "uic", "action_plan")


@register("identity_columns", f"{_BASE} select row_idx, {', '.join(_IDENT)} from b")
def _identity_columns(spark, sf):
    return ingest.identity_columns(_fx(spark, sf).open_item_wide()).select("row_idx", *_IDENT)


@register("invoice_key", f"{_BASE} select invoice_id, report_month, invoice_status from imp")
def _invoice_key(spark, sf):
    return _imported(spark, sf).select("invoice_id", "report_month", "invoice_status")


@register("unpivot_open_items", f"{_BASE} " + fact_select("imp"))
def _unpivot_open_items(spark, sf):
    return out(_imported(spark, sf))


@register("import_report", f"{_BASE} select report_month, cast(count(*) as bigint) as records from imp group by report_month")
def _import_report(spark, sf):
    return ingest.import_report(_imported(spark, sf))


#: An empty line follows so many rows of a landed sheet.
_EMPTY_AFTER = 40
_PLACE = f"row_number() over (partition by o_orderkey % {len(_SHEETS)} order by o_orderkey) - 1"
_LANDED = _BASE.replace("o_orderkey as row_idx", f"({_PLACE}) + ({_PLACE}) // {_EMPTY_AFTER} as row_idx")


#: Source numbers whose rows of a sheet are put in order together.
_LANDED_RANGE = 100_000


def land_sheets(fx, root: str, sheets: list[str]) -> list[tuple[str, str]]:
    """Write the stand-in sheets as CSV, cells as they stand: labels, a title, untidy names, the rows
    in order, an empty line now and then; [(sheet, path)] in workbook order.

    A sheet is a folder of files that follow each other by name. Places are counted within ranges of the
    source number and over the ranges, so that no task orders or writes a whole sheet."""
    header = {(r["sheet"], r["idx"]): (r["name"], r["label"]) for r in fx.open_item_header().collect()}
    names = [header[sheets[0], k][0] for k in range(len(header) // len(sheets))]
    at = F.expr("array_position(array(" + ", ".join(map(q, sheets)) + "), sheet) - 1").cast("int")
    wide = fx.open_item_wide().where(F.col("sheet").isin(sheets)).withColumns(
        {"at": at, "range": F.floor(F.col("row_idx") / _LANDED_RANGE)})
    before = Window.partitionBy("at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = wide.groupBy("at", "range").agg(F.count("*").alias("n")).select(
        "at", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("at", "range").orderBy("row_idx"))
    rows = (wide.select("at", "range", "row_idx", F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]), CSV_CELLS).alias("line"))
            .withColumn("own", own).join(ranges, ["at", "range"]).withColumn("place", F.col("before") + F.col("own")))
    empty = F.when(F.col("place") % _EMPTY_AFTER == 0, F.array(F.col("line"), F.lit(""))).otherwise(F.array("line"))
    rows = rows.select("at", "place", F.posexplode(empty).alias("k", "value"))
    top = []
    for pos, sheet in enumerate(sheets):
        labels = ",".join(header[sheet, k][1] or "" for k in range(len(names)))
        top += [(pos, -3, 0, labels), (pos, -2, 0, "Open items,,"), (pos, -1, 0, ",".join(f" {n} " for n in names))]
    top = fx.spark.createDataFrame(top, "at int, place long, k int, value string")
    lines = top.unionByName(rows).repartitionByRange("at", "place", "k").sortWithinPartitions("at", "place", "k")
    lines.select("at", "value").write.partitionBy("at").text(root)
    return [(sheet, f"{root}/at={pos}") for pos, sheet in enumerate(sheets)]


@register("landed_import", f"{_LANDED} " + fact_select("imp"))
def _landed_import(spark, sf):
    """Landed CSV sheets to facts: rows are numbered as they stand in the file, empty lines included."""
    sheets = land_sheets(_fx(spark, sf), scratch_path(spark, "landed"), _SHEETS)
    wide, header = read_workbook(spark, sheets)
    return out(ingest.import_open_items(wide, header))


# --- data quality -------------------------------------------------------------

@register("clean_invoices", f"{WITH_INV} select " + ", ".join(
    "cast(coalesce(nilai_m, 0) as double) as nilai_m" if c == "nilai_m" else
    ("above_credit_limit" if c == "above_credit_limit" else f"coalesce({c}, '') as {c}") for c in FACT_COLS)
    + " from ar_invoice")
def _clean_invoices(spark, sf):
    return out(quality.clean_invoices(inv(spark, sf)))


def _file(spark, sf):
    """A landed invoice file: every amount as text."""
    return inv(spark, sf).withColumn("nilai_m", F.col("nilai_m").cast("string"))


@register("clean_file", f"{WITH_INV} select " + ", ".join(
    {"nilai_m": "cast(coalesce(nilai_m, 0) as double) as nilai_m",
     "aging_category": f"coalesce(aging_category, {q(vocab.CLEAN_AGING_DEFAULT)}) as aging_category",
     "status_tagih": f"coalesce(status_tagih, {q(vocab.CLEAN_STATUS_DEFAULT)}) as status_tagih"}.get(c, c)
    for c in FACT_COLS) + " from ar_invoice")
def _clean_file(spark, sf):
    return out(quality.clean_file(_file(spark, sf)))


def _dirty_file(spark, sf):
    """Stand-in upload with repeated ids (the negative-amount rows twice) and
    rows whose id is missing (the null-amount rows)."""
    i = inv(spark, sf)
    return (i.unionByName(i.where(F.col("nilai_m") < 0))
             .unionByName(i.where(F.col("nilai_m").isNull()).withColumn("invoice_id", F.lit(None).cast("string"))))


@register("validate_invoices", f"""{WITH_INV}, f as (select invoice_id, status_tagih, report_month from ar_invoice
 union all select invoice_id, status_tagih, report_month from ar_invoice where nilai_m < 0
 union all select cast(null as varchar), status_tagih, report_month from ar_invoice where nilai_m is null),
d as (select invoice_id, report_month from f where invoice_id is not null group by invoice_id, report_month having count(*) > 1),
r as (select f.invoice_id, concat_ws(',',
  case when f.invoice_id is null or trim(f.invoice_id) = '' then 'missing_id' end,
  case when d.invoice_id is not null then 'duplicate_id' end,
  case when coalesce(f.status_tagih in {in_list(vocab.STATUSES)}, false) then null else 'bad_status' end) as reasons
 from f left join d on f.invoice_id = d.invoice_id and f.report_month is not distinct from d.report_month)
select invoice_id, reasons, reasons = '' as is_valid from r""")
def _validate_invoices(spark, sf):
    return quality.validate(_dirty_file(spark, sf))


# --- table catalog and keyed changes -----------------------------------------

def _catalog(spark, sf) -> TableCatalog:
    fx = _fx(spark, sf)
    return TableCatalog({"ar_segmen_ers_tbl": fx.invoices, "ar_top_customers_tbl": fx.top_customers,
                         "ar_cash_inflow_forecast_tbl": fx.cash_inflow, "ar_trend_t13m_tbl": fx.trend_t13m,
                         "ar_metrics_history_tbl": fx.metrics_history})


@register("table_read", f"select * from ({TOP_CUST}) t")
def _table_read(spark, sf):
    return _catalog(spark, sf).read_table("AR_TOP_CUSTOMERS_TBL")


_K = "cast(substr(invoice_id, 5) as bigint)"
_KEY = ("invoice_id", "report_month")
_SUPPLIED = _KEY + ("nilai_m", "action_plan")


def _sql_rows(given: dict[str, str], rest: str | None = None) -> str:
    """Fact columns by name: as given, else as ``rest`` says (null by default)."""
    types = {"above_credit_limit": "integer", "nilai_m": "decimal(18,6)"}
    return ", ".join(f"{given[c]} as {c}" if c in given else c if rest == "own" else
                     f"cast(null as {types.get(c, 'varchar')}) as {c}" for c in FACT_COLS)


# New rows supply four columns; the others are null, but for the credit-limit flag, which defaults to 0.
_NEW_SQL = "select " + _sql_rows({"invoice_id": "invoice_id || '-N'", "report_month": "report_month", "nilai_m": "nilai_m",
                                  "action_plan": "'New'", "above_credit_limit": "0"}) + f" from ar_invoice where {_K} % 100 = 0"
# Changes supply the same four; a matched row keeps the rest.
_UPD_SQL = "select " + _sql_rows({"nilai_m": f"case when {_K} % 10 = 0 then nilai_m + 1 else nilai_m end",
                                  "action_plan": f"case when {_K} % 10 = 0 then 'Revised' else action_plan end"},
                                 "own") + " from ar_invoice"


def _key():
    return F.substring("invoice_id", 5, 100).try_cast("bigint")


def _new_rows(i):
    return (i.where(_key() % 100 == 0).withColumns({"invoice_id": F.concat("invoice_id", F.lit("-N")), "action_plan": F.lit("New")})
            .select(*_SUPPLIED))


def _updates(i):
    return (i.where(_key() % 10 == 0).withColumns({"nilai_m": F.col("nilai_m") + 1, "action_plan": F.lit("Revised")})
            .select(*_SUPPLIED))


_DEFAULTS = schemas.DEFAULTS["ar_segmen_ers_tbl"]
_APPENDED = f"{WITH_INV}, t as (select * from ar_invoice union all {_NEW_SQL}) {fact_select('t')}"
_UPDATED = f"{WITH_INV}, t as ({_UPD_SQL}) {fact_select('t')}"
_DELETED = f"{WITH_INV} {fact_select()} where not ({_K} % 7 = 0)"
_UPSERTED = f"{WITH_INV}, t as ({_UPD_SQL} union all {_NEW_SQL}) {fact_select('t')}"


@register("table_append", _APPENDED)
def _table_append(spark, sf):
    i = inv(spark, sf)
    return out(mutations.append_rows(i, _new_rows(i), _KEY, defaults=_DEFAULTS))


@register("table_update", _UPDATED)
def _table_update(spark, sf):
    i = inv(spark, sf)
    return out(mutations.update_rows(i, _updates(i), _KEY))


@register("table_delete", _DELETED)
def _table_delete(spark, sf):
    i = inv(spark, sf)
    return out(mutations.delete_rows(i, i.where(_key() % 7 == 0).select(*_KEY), _KEY))


@register("table_upsert", _UPSERTED)
def _table_upsert(spark, sf):
    i = inv(spark, sf)
    return out(mutations.upsert_rows(i, _updates(i).unionByName(_new_rows(i)), _KEY, defaults=_DEFAULTS))


# --- stored tables: the same changes, written and read again ---------------------

_FACTS = "AR_SEGMEN_ERS_TBL"


def _stored(spark, sf) -> tables.StoredTables:
    store = tables.StoredTables(spark, scratch_path(spark, "stored"))
    store.refresh(_FACTS, inv(spark, sf))
    return store


@register("stored_refresh", f"{WITH_INV} {fact_select()}")
def _stored_refresh(spark, sf):
    """Written twice: readers see the second version alone."""
    store = _stored(spark, sf)
    return out(store.refresh(_FACTS, store.read(_FACTS)))


@register("stored_append", _APPENDED)
def _stored_append(spark, sf):
    store = _stored(spark, sf)
    return out(store.append(_FACTS, _new_rows(inv(spark, sf))))


@register("stored_update", _UPDATED)
def _stored_update(spark, sf):
    store = _stored(spark, sf)
    return out(store.update(_FACTS, _updates(inv(spark, sf))))


@register("stored_delete", _DELETED)
def _stored_delete(spark, sf):
    store = _stored(spark, sf)
    return out(store.delete(_FACTS, inv(spark, sf).where(_key() % 7 == 0).select(*_KEY)))


@register("stored_upsert", _UPSERTED)
def _stored_upsert(spark, sf):
    """Twice the same MERGE equals once."""
    store, i = _stored(spark, sf), inv(spark, sf)
    changes = _updates(i).unionByName(_new_rows(i))
    store.upsert(_FACTS, changes)
    return out(store.upsert(_FACTS, changes))


_PLAN_TEXT = 'call "A"\\B,\n then\r\n\twrite'
_PLAN_SQL = "'" + _PLAN_TEXT.replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\t", "' || chr(9) || '") + "'"


@register("csv_round_trip", f"""{WITH_INV}, t as (select {_sql_rows({
    "action_plan": f"case when {_K} % 50 = 0 then {_PLAN_SQL} else action_plan end",
    "region": "coalesce(region, '')", "status_tagih": "coalesce(status_tagih, '')"}, "own")} from ar_invoice) {fact_select('t')}""")
def _csv_round_trip(spark, sf):
    """Texts with quotes, backslashes and line ends among them; null texts come back empty."""
    i = schemas.conform(inv(spark, sf))
    i = i.withColumn("action_plan", F.when(_key() % 50 == 0, F.lit(_PLAN_TEXT)).otherwise(F.col("action_plan")))
    path = tables.export_csv(i, scratch_path(spark, "csv"))
    return out(tables.read_export(spark, path, i.schema))


@register("load_log", f"{_BASE} select report_month, cast(count(*) as bigint) as records from imp group by report_month")
def _load_log(spark, sf):
    log = tables.load_log(_imported(spark, sf), scratch_path(spark, "log"))
    return log.select("report_month", "records")


# --- versions: overlapping writers, changes, history, layouts ------------------------

@register("stored_interleaved", f"""{WITH_INV}, t as (select {_sql_rows({
    "nilai_m": f"case when {_K} % 10 = 0 then nilai_m + 1 else nilai_m end",
    "action_plan": f"case when {_K} % 10 = 0 then 'Revised' else action_plan end",
    "witel": f"case when {_K} % 10 = 3 then 'W' else witel end"}, "own")} from ar_invoice union all {_NEW_SQL}) {fact_select('t')}""")
def _stored_interleaved(spark, sf):
    """Another writer commits while an upsert is under way: both changes stand."""
    store, i, done = _stored(spark, sf), inv(spark, sf), []
    other = i.where(_key() % 10 == 3).select(*_KEY, F.lit("W").alias("witel"))

    def mutate(old, changes):
        if not done:
            done.append(store.update(_FACTS, other))
        return mutations.upsert_rows(old, changes, _KEY, defaults=_DEFAULTS)

    tables.change(spark, store.path(_FACTS), _updates(i).unionByName(_new_rows(i)), mutate, list(_KEY), "report_month", schemas.INVOICE)
    return out(store.read(_FACTS))


_CHANGED = f"case when {_K} % 10 = 0 then nilai_m + 1 else nilai_m end"


@register("table_changes", f"""{WITH_INV}, n as ({_NEW_SQL}), t as (
 select 'delete' as change_type, * from ar_invoice where {_K} % 7 = 0
 union all select 'update_before', * from ar_invoice where {_K} % 7 <> 0 and {_K} % 10 = 0
 union all select 'update_after', * from ({_UPD_SQL}) u where {_K} % 7 <> 0 and {_K} % 10 = 0
 union all select 'insert', * from n)
 select change_type, {', '.join("cast(nilai_m as double) as nilai_m" if c == "nilai_m" else c for c in FACT_COLS)} from t""")
def _table_changes(spark, sf):
    """The net change between two versions, an upsert and a delete apart."""
    store, i = _stored(spark, sf), inv(spark, sf)
    store.upsert(_FACTS, _updates(i).unionByName(_new_rows(i)))
    store.delete(_FACTS, i.where(_key() % 7 == 0).select(*_KEY))
    return out(store.changes(_FACTS, 1, 3))


@register("changes_applied", f"""{WITH_INV}, t as (select * from ({_UPD_SQL}) u where not ({_K} % 7 = 0)
 union all select * from ({_NEW_SQL}) n) {fact_select('t')}""")
def _changes_applied(spark, sf):
    """The change feed applied to the old version gives the new one."""
    from kolekta.plans.versions import apply_changes
    store, i = _stored(spark, sf), inv(spark, sf)
    store.upsert(_FACTS, _updates(i).unionByName(_new_rows(i)))
    store.delete(_FACTS, i.where(_key() % 7 == 0).select(*_KEY))
    return out(apply_changes(store.read(_FACTS, version=1), store.changes(_FACTS, 1), list(_KEY)))


@register("kpi_as_of_load", f"""{WITH_INV}, t as ({_UPD_SQL} union all {_NEW_SQL})
 select cast(1 as integer) as load, {M(S())} as total_ar_m, cast(count(*) as bigint) as n from ar_invoice
 union all select 2, {M(S())}, cast(count(*) as bigint) from t""")
def _kpi_as_of_load(spark, sf):
    """KPI at the moment of each past load, after the last of them."""
    from kolekta.plans.versions import read_pointer
    store, i = _stored(spark, sf), inv(spark, sf)
    store.upsert(_FACTS, _updates(i).unionByName(_new_rows(i)))
    store.delete(_FACTS, i.select(*_KEY))
    loads = []
    for load in (1, 2):
        moment = read_pointer(spark, store.path(_FACTS), load)["committed_at"]
        kpi = summary.kpi_summary(store.read(_FACTS, as_of=moment))
        loads.append(kpi.select(F.lit(load).alias("load"), "total_ar_m", F.col("total_records").alias("n")))
    return loads[0].unionByName(loads[1])


@register("stored_layouts", f"""{WITH_INV} select invoice_id, report_month,
 cast(case when contains(report_month, 'Mei') then nilai_m else round(nilai_m, 2) end as double) as nilai_m,
 cast(above_credit_limit as bigint) as above_credit_limit,
 case when contains(report_month, 'Mei') then witel end as witel from ar_invoice""")
def _stored_layouts(spark, sf):
    """Three layouts of the fact table in one stored table: narrow, wider numbers, one more column."""
    from kolekta.plans.versions import read_current, write_version
    path, i = scratch_path(spark, "layouts"), inv(spark, sf)
    narrow = i.select("invoice_id", "report_month", F.round("nilai_m", 2).cast("decimal(12,2)").alias("nilai_m"), "above_credit_limit")
    wide = narrow.withColumns({"nilai_m": F.col("nilai_m").cast("decimal(18,6)"), "above_credit_limit": F.col("above_credit_limit").cast("long")})
    full = i.select("invoice_id", "report_month", "nilai_m", F.col("above_credit_limit").cast("long").alias("above_credit_limit"), "witel")
    june, may = F.col("report_month").contains("Juni"), F.col("report_month").contains("Mei")
    for rows, where in ((narrow, june), (wide, ~june & ~may), (full, may)):
        months = [r[0] for r in i.where(where).select("report_month").distinct().collect()]
        write_version(rows.where(where), path, "report_month", replace=months)
    return out(read_current(spark, path))


@register("created_tables", f"{WITH_INV} {fact_select()}")
def _created_tables(spark, sf):
    """The five tables are created empty with their schemas; facts are appended to theirs."""
    root = scratch_path(spark, "created")
    tables.create_tables(spark, root)
    return out(tables.StoredTables(spark, root).append(_FACTS, inv(spark, sf)))


# --- indexes ----------------------------------------------------------------------

@register("clustered_filter", f"{WITH_INV} {fact_select()} where region = 'EUROPE' and pengelolaan = 'BUILDING'")
def _clustered_filter(spark, sf):
    path = scratch_path(spark, "clustered")
    indexes.write_clustered(schemas.conform(inv(spark, sf)), path)
    return out(tables.read_current(spark, path, schemas.INVOICE).where("region = 'EUROPE' and pengelolaan = 'BUILDING'"))


_SEARCHED = " or ".join(f"contains(lower(coalesce({c}, '')), 'r#00000001')" for c in vocab.SEARCH_COLUMNS)


@register("indexed_search", f"{WITH_INV} {fact_select()} where {_SEARCHED}")
def _indexed_search(spark, sf):
    path, i = scratch_path(spark, "postings"), inv(spark, sf)
    indexes.build_search(i, path)
    return out(indexes.indexed_search(i, path, "R#00000001"))


@register("ranked_page", f"""{WITH_INV}, c as (select greatest(1, cast(ceil(count(*) / {vocab.PAGE_SIZE}.0) as bigint)) as pages from ar_invoice)
 select invoice_id, {', '.join("cast(nilai_m as double) as nilai_m" if c == "nilai_m" else c for c in vocab.DETAIL_COLUMNS)},
 cast(40 as bigint) as page, pages from (select * from ar_invoice order by invoice_id limit {vocab.PAGE_SIZE} offset {39 * vocab.PAGE_SIZE}) t, c""")
def _ranked_page(spark, sf):
    """Page 40, from the key ranges that it touches alone."""
    path, i = scratch_path(spark, "ranks"), inv(spark, sf)
    indexes.build_ranks(i, path)
    return out(indexes.ranked_page(i, path, 40))


# --- landed layouts ------------------------------------------------------------------

@register("conform_layout", f"""{WITH_INV} select invoice_id, customer_name, report_month, cast(nilai_m as double) as nilai_m,
 cast(null as varchar) as witel, cast(null as integer) as above_credit_limit from ar_invoice""")
def _conform_layout(spark, sf):
    """An older layout: untidy upper-case headers, text amounts, columns missing."""
    old = inv(spark, sf).select(F.col("invoice_id").alias(" INVOICE_ID "), F.col("customer_name").alias("CUSTOMER_NAME "),
                                F.col("report_month").alias("Report_Month"), F.col("nilai_m").cast("string").alias(" NILAI_M"))
    return out(schemas.conform(schemas.normalise_headers(old, "lower")).select(
        "invoice_id", "customer_name", "report_month", "nilai_m", "witel", "above_credit_limit"))


@register("ora_dates", "select o_orderkey, cast(o_orderdate as date) as d from orders")
def _ora_dates(spark, sf):
    orders = _fx(spark, sf).table("orders")
    return orders.select("o_orderkey", ora_date(F.date_format("o_orderdate", "dd-MMM-yy")).alias("d")).withColumn(
        "d", F.when(F.year("d") >= 2090, F.add_months("d", -1200)).otherwise(F.col("d")))


@register("snapshots", f"""select {q(_SHEETS[0])} as sheet, cast(0 as integer) as sheet_pos, cast(o_orderkey as bigint) as row_idx,
 cast(o_totalprice as double) as a, cast(null as varchar) as b from orders where o_orderkey % 2 = 0
 union all select {q(_SHEETS[1])}, 1, o_orderkey, null, o_orderstatus from orders where o_orderkey % 2 = 1""")
def _snapshots(spark, sf):
    """Landed sheets of other columns as one frame, in workbook order."""
    orders, root = _fx(spark, sf).table("orders"), scratch_path(spark, "snapshots")
    even = orders.where("o_orderkey % 2 = 0").selectExpr("cast(o_orderkey as bigint) as ` row_idx`", "cast(o_totalprice as double) as `a `")
    odd = orders.where("o_orderkey % 2 = 1").selectExpr("cast(o_orderkey as bigint) as row_idx", "o_orderstatus as b")
    even.write.parquet(f"{root}/0")
    odd.write.parquet(f"{root}/1")
    return read_snapshots(spark, [(_SHEETS[0], f"{root}/0"), (_SHEETS[1], f"{root}/1")])


# --- the six-dimension mart ------------------------------------------------------

def _moved_mart(spark, sf):
    """The mart after a change of the stored table, refreshed for the touched months only."""
    store = _stored(spark, sf)
    path = scratch_path(spark, "mart")
    marts.refresh_mart(spark, store.read(_FACTS), path)
    i = inv(spark, sf)
    changes = _updates(i).unionByName(_new_rows(i)).where(F.col("report_month").contains("Ju"))
    months = [r[0] for r in changes.select("report_month").distinct().collect()]
    marts.refresh_mart(spark, store.upsert(_FACTS, changes), path, months)
    return marts.read_mart(spark, path)


_MOVED = f"""{WITH_INV}, ch as (select {_sql_rows({
    "nilai_m": f"case when {_K} % 10 = 0 and contains(report_month, 'Ju') then nilai_m + 1 else nilai_m end",
    "action_plan": "action_plan"}, "own")} from ar_invoice
 union all select * from ({_NEW_SQL}) n where contains(report_month, 'Ju'))"""


@register("mart_kpi", f"""{_MOVED} select {M(S())} as total_ar_m, {M(S(ST(vocab.LAYAK)))} as layak_m,
 {M(S(ST(vocab.TIDAK_LAYAK)))} as tidak_layak_m, {M(S(ST(vocab.BERMASALAH)))} as bermasalah_m, cast(count(*) as bigint) as n
 from ch""")
def _mart_kpi(spark, sf):
    return marts.mart_kpi(_moved_mart(spark, sf))


@register("mart_segments", f"""{_MOVED} select pengelolaan, {M(S())} as v from ch
 where pengelolaan is not null group by pengelolaan""")
def _mart_segments(spark, sf):
    """A fact-table operator over the mart."""
    return summary.segment_breakdown(_moved_mart(spark, sf))


def _followed(spark, sf, maintain):
    """A mart or cube that follows the stored table through two changes by its feed."""
    store, path = tables.StoredTables(spark, scratch_path(spark, "fed"), feed=True), scratch_path(spark, "follower")
    i = inv(spark, sf)
    store.refresh(_FACTS, i)
    maintain(spark, store.path(_FACTS), path)
    store.upsert(_FACTS, _updates(i).unionByName(_new_rows(i)))
    store.delete(_FACTS, i.where(_key() % 7 == 0).select(*_KEY))
    return maintain(spark, store.path(_FACTS), path), path


_FOLLOWED = f"""{WITH_INV}, t as (select * from ({_UPD_SQL}) u where not ({_K} % 7 = 0) union all select * from ({_NEW_SQL}) n)"""


@register("mart_incremental", f"""{_FOLLOWED} select {', '.join(marts.KEYS)}, cast(coalesce(sum(nilai_m), 0) as double) as nilai_m,
 cast(count(*) as bigint) as records from t group by {', '.join(marts.KEYS)}""")
def _mart_incremental(spark, sf):
    return out(marts.read_mart(spark, _followed(spark, sf, marts.maintain_mart)[1]))


@register("cube_incremental", f"""{_FOLLOWED}
select case when grouping(report_month) = 1 then 'ALL' else report_month end as month,
 case when grouping(pengelolaan) = 1 then 'ALL' else pengelolaan end as segment,
 case when grouping(region) = 1 then 'ALL' else region end as region,
 {M(S())} as total_ar_m, {M(S(ST(vocab.LAYAK)))} as layak_m, {M(S(ST(vocab.TIDAK_LAYAK)))} as tidak_layak_m,
 {M(S(ST(vocab.BERMASALAH)))} as bermasalah_m, cast(count(*) as bigint) as n
from t group by cube (report_month, pengelolaan, region)""")
def _cube_incremental(spark, sf):
    return _followed(spark, sf, marts.maintain_cube)[0]


# --- payload and stream ------------------------------------------------------------

def _leaves(name: str, path: str, numbers: tuple = (), texts: tuple = ()) -> list[str]:
    """(path, num, txt) rows of the columns of a registered query's SQL; ``path`` is an SQL expression."""
    return ([f"select {path} || '{c}' as path, cast({c} as double) as num, cast(null as varchar) as txt from ({ORACLE[name]}) t" for c in numbers]
            + [f"select {path} || '{c}' as path, null as num, cast({c} as varchar) as txt from ({ORACLE[name]}) t" for c in texts])


def _keyed(name: str, path: str, key: str, value: str) -> str:
    return f"select '{path}.' || {key} as path, cast({value} as double) as num, cast(null as varchar) as txt from ({ORACLE[name]}) t"


def _payload_sql() -> str:
    flow = "charts.ar_flow"
    parts = _leaves("kpi_summary", "'summary.'", ("total_ar_m", "total_layak_tagih_m", "total_tidak_layak_m", "total_bermasalah_m",
                                                  "over_due_m", "overdue_pct", "dso", "total_records"))
    parts += _leaves("largest_segment", "'summary.'", (), ("largest_segment",)) + _leaves("as_of", "'summary.'", (), ("as_of_date",))
    parts += [f"select 'summary.active_filters.{n}' as path, null as num, 'ALL' as txt" for n in ("month", "segment", "region")]
    parts += _leaves("flow_levels", f"'{flow}.'", ("total_m", "tidak_layak_m", "layak_tagih_m", "bermasalah_m"))
    parts += [f"select '{flow}.{p}' as path, {c} as num, null as txt from ({ORACLE['flow_levels']}) t" for p, c in (
        ("jakarta.total_m", "home_total_m"), ("jakarta.sudah_invoice_m", "sudah_invoice_m"),
        ("jakarta.belum_invoice_m", "belum_invoice_m"), ("regional.total_m", "regional_total_m"))]
    parts += [_keyed("age_analysis", "charts.age_analysis", "label", "v"), _keyed("segment_breakdown", "charts.segment_breakdown", "pengelolaan", "v"),
              _keyed("category_breakdown", "charts.category_breakdown", "invoice_status", "v"),
              _keyed("flow_categories", f"{flow}.jakarta.categories", "category", "v"),
              _keyed("flow_regional", f"{flow}.regional.breakdown", "region", "v")]
    parts += _leaves("region_breakup", "'charts.region_breakup.' || region || '.'", ("value", "percentage"))
    parts += _leaves("history_trend", "'charts.history_trend.' || report_month || '.'", ("total_m", "layak_m", "tidak_layak_m", "bermasalah_m"))
    parts += _leaves("cash_inflow", "'charts.cash_inflow.' || sort_order || '.'",
                     ("actual_receipts", "estimated_receipts", "forecasted_receipts"), ("month_label",))
    parts += _leaves("trend_t13m", "'charts.trend_t13m.' || sort_order || '.'", ("within_due", "over_due", "credit_sales"), ("month_label",))
    parts += [f"select 'charts.sparkline_{n}.' || ord as path, {num} as num, {txt} as txt from ({ORACLE['sparkline']}) t"
              for n, num, txt in (("overdue_pct", "overdue_pct", "null"), ("dso", "dso", "null"), ("months", "null", "month_label"))]
    parts += _leaves("action_plan", "'action_plan.' || kategori || '.'", ("ord", "nilai_m"), ("uic", "tindak_lanjut", "due_date"))
    parts += _leaves("top_customers", "'top_customers.' || rank || '.'",
                     ("balance", "within_due", "over_due", "overdue_pct", "due_invoices", "above_credit_limit"), ("customer_name", "report_month"))
    return "\nunion all\n".join(parts)


@register("dashboard_payload", _payload_sql())
def _dashboard_payload(spark, sf):
    """The nested payload, flattened to one row for each leaf."""
    fx = _fx(spark, sf)
    return payload_values(dashboard_payload(fx.invoices(), fx.top_customers(), fx.cash_inflow(), fx.trend_t13m(),
                                            fx.metrics_history()))


_CORRECTED = _BASE.replace("case when o_orderkey % 5 = 0 then 'Follow up' end", "case when o_orderkey % 50 = 0 then 'Corrected' when o_orderkey % 5 = 0 then 'Follow up' end")


#: Bytes of a row group of a landed Parquet file: what one task reads of it.
LANDED_GROUP = 8 << 20


@register("stream_ingest", f"{_CORRECTED} " + fact_select("imp"))
def _stream_ingest(spark, sf):
    """Land the wide sheet rows as several files and a correction of some rows,
    then run the folder stream over them, a file a batch, into a fresh invoice
    table; the correction's keys are in two files, and its name is the greater."""
    from kolekta.plans.versions import _fs, _names
    from kolekta.streaming.folder_ingest import stream_ingest
    fx = _fx(spark, sf)
    wide = fx.open_item_wide()
    root = scratch_path(spark, "stream_ingest")
    landing = f"{root}/landing"
    wide.where("row_idx % 50 = 0").withColumn("UNLOCK", F.lit("Corrected")).coalesce(1).write.parquet(f"{root}/correction")
    fs, folder, jvm = _fs(spark, landing)
    fs.mkdirs(folder)
    part = next(n for n in _names(spark, f"{root}/correction") if n.endswith(".parquet"))
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{root}/correction/{part}"), jvm.org.apache.hadoop.fs.Path(f"{landing}/zz-{part}"))
    wide.repartition(3, "sheet").write.option("parquet.block.size", LANDED_GROUP).mode("append").parquet(landing)
    return out(stream_ingest(spark, landing, f"{root}/table", f"{root}/_checkpoint", fx.open_item_header(),
                             spark.read.parquet(landing).schema, files_per_batch=1))
