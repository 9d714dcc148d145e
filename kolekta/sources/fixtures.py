"""Stand-in inputs built from the driver's TPC-H-ish tables (orders, customer,
nation, region), as agreed in FIXTURES.md section 3.

These views only give rows in the schemas the jobs expect; none of the
library's work happens here. The SQL text is shared by both engines: Spark
binds DataFrames into the ``{orders}``-style placeholders, the DuckDB oracle
substitutes the plain table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kolekta import vocab

BASE_TABLES = ("orders", "customer", "nation", "region")

_MONTH_NAME = (
    "case extract(month from o_orderdate) when 1 then 'Januari' when 2 then 'Februari' when 3 then 'Maret' "
    "when 4 then 'April' when 5 then 'Mei' when 6 then 'Juni' when 7 then 'Juli' when 8 then 'Agustus' "
    "when 9 then 'September' when 10 then 'Oktober' when 11 then 'November' when 12 then 'Desember' end"
)
_MONTH_LABEL = f"concat({_MONTH_NAME}, ' ', cast(extract(year from o_orderdate) as string))"

INVOICE_SQL = f"""
select concat('INV-', cast(o_orderkey as string)) as invoice_id, c_name as customer_name,
 case o_orderkey % 6 when 0 then 'Within Due' when 1 then '0-30 Days' when 2 then '31-60 Days' when 3 then '61-90 Days' else '>90 Days' end as aging_category,
 case when o_orderkey % 103 = 0 then null when o_orderkey % 6 = 0 then 'AR LAYAK TAGIH' when o_orderkey % 6 in (4,5) then 'AR TIDAK LAYAK TAGIH' else 'AR BERMASALAH' end as status_tagih,
 case when r_name = 'ASIA' then ' Jakarta ' when r_name = 'AFRICA' then null else r_name end as region,
 case o_custkey % 8 when 0 then 'SUDAH INVOICE' when 1 then 'KONTRAK' when 2 then 'BAST/BAPP' when 3 then 'REKON/SLG' when 4 then 'TERMYN' when 5 then 'PROSES IDENTIFIKASI' when 6 then 'KOREKSI' else 'CHECKER' end as invoice_status,
 case when o_orderkey % 97 = 0 then null when o_orderkey % 101 = 0 then cast(0 as decimal(18,6)) when o_orderkey % 89 = 0 then -cast(o_totalprice/1000 as decimal(18,6)) else cast(o_totalprice/1000 as decimal(18,6)) end as nilai_m,
 c_mktsegment as uic,
 {_MONTH_LABEL} as due_date,
 'Normal collection' as action_plan, 0 as above_credit_limit,
 {_MONTH_LABEL} as report_month,
 c_mktsegment as pengelolaan, cast(c_custkey as string) as bp_num, concat('N', cast(c_custkey as string)) as nipnas,
 n_name as witel, o_orderpriority as satker, concat('R', cast(n_regionkey as string)) as reg,
 case when o_custkey % 8 = 0 then 'SUDAH INVOICE' else 'BELUM INVOICE' end as status_invoice
from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey
"""


def _series_sql(n: int, cols: str, inner: str) -> str:
    return (f"select * from (select cast(m as string) as month_label, row_number() over (order by m) - (count(*) over () - {n}) as sort_order, "
            f"{cols} from ({inner}) g) t where sort_order >= 1")


_M = "extract(year from o_orderdate)*12 + extract(month from o_orderdate)"
_AMT = "cast(o_totalprice/1000 as decimal(18,6))"

TREND_SQL = _series_sql(13, "within_due, over_due, credit_sales", f"""
 select {_M} as m,
  cast(coalesce(sum(case when o_orderkey % 6 = 0 then {_AMT} end), 0) as double) as within_due,
  cast(coalesce(sum(case when o_orderkey % 6 <> 0 then {_AMT} end), 0) as double) as over_due,
  cast(sum({_AMT}) as double) as credit_sales
 from {{orders}} group by 1""")

METRICS_SQL = _series_sql(12, "overdue_pct, dso", f"""
 select {_M} as m,
  cast(round(100.0 * count(case when o_orderkey % 6 <> 0 then 1 end) / count(*), 1) as double) as overdue_pct,
  cast(50 + count(*) % 13 as double) as dso
 from {{orders}} group by 1""")

INFLOW_SQL = _series_sql(10, "actual_receipts, estimated_receipts, forecasted_receipts", f"""
 select {_M} as m,
  cast(coalesce(sum(case when o_orderstatus = 'F' then {_AMT} end), 0) as double) as actual_receipts,
  cast(coalesce(sum(case when o_orderstatus = 'O' then {_AMT} end), 0) as double) as estimated_receipts,
  cast(coalesce(sum(case when o_orderstatus = 'P' then {_AMT} end), 0) as double) as forecasted_receipts
 from {{orders}} group by 1""")

# Customer snapshot table: roll-up of the invoice view, over_due forced null for some rows.
TOP_CUSTOMERS_SQL = """
select customer_name, report_month, cast(round(coalesce(sum(nilai_m), 0) * 1000, 2) as double) as balance,
 cast(round(coalesce(sum(case when aging_category = 'Within Due' then nilai_m end), 0) * 1000, 2) as double) as within_due,
 case when max(cast(bp_num as bigint)) % 211 = 0 then null else cast(round(coalesce(sum(case when aging_category <> 'Within Due' then nilai_m end), 0) * 1000, 2) as double) end as over_due,
 cast(case when coalesce(sum(nilai_m), 0) > 0 then round(least(100.0, greatest(0.0, cast(coalesce(sum(case when aging_category <> 'Within Due' then nilai_m end), 0) as double) / cast(sum(nilai_m) as double) * 100)), 2) else 0.0 end as double) as overdue_pct,
 count(case when aging_category <> 'Within Due' then 1 end) as due_invoices, 0 as above_credit_limit
from ({invoice}) ar_invoice group by customer_name, report_month
"""


# Sheet columns in sheet order (the landed file also carries row_idx, sheet, sheet_pos).
OPEN_ITEM_IDENTITY = ("NAME", "CA", "BP NUM", "NIPNAS", "PENGELOLAAN", "AREA", "WITEL", "SATKER", "REG", "UNLOCK")
# The bracket headers repeat under every category, so the sheet's reader numbers them (".1", ".2", ...).
_BRACKET_NAMES = tuple(f"Aging {label}" for label in ("0-3 Bln", "4-6 Bln", "7-12 Bln", "13-18 Bln", "19-24 Bln", ">24 Bln"))


def cell_name(i: int, j: int) -> str:
    return _BRACKET_NAMES[j] + (f".{i}" if i else "")


OPEN_ITEM_CELLS = tuple(cell_name(i, j) for i in range(8) for j in range(6))
OPEN_ITEM_COLUMNS = OPEN_ITEM_IDENTITY + OPEN_ITEM_CELLS + ("GRAND TOTAL",)
_SHEETS = tuple(s for s, _ in vocab.SHEET_MONTHS) + ("Rekap",)


def _cell_sql(i: int, j: int) -> str:
    extra = {0: (1, "n/a"), 1: (2, "0"), 2: (3, "NaN")}.get(j)
    other = f" when _ki = {(i + extra[0]) % 8} then '{extra[1]}'" if extra else ""
    return f"case when _ki = {i} and _cj = {j} then _amt{other} end as `{cell_name(i, j)}`"


def category_shift(sheet_pos: int) -> int:
    """Categories stand in another order on every other sheet."""
    return 3 * (sheet_pos % 2)


# Cells that hold no number a float reader takes, and one too large to store.
AMOUNT_ODDITIES = {1: "12d", 2: "3f", 3: "0x1p3", 4: "1e25", 5: "  ", 6: "NaN"}
_ODD = " ".join(f"when o_orderkey % 97 = {k} then '{v}'" for k, v in AMOUNT_ODDITIES.items())


OPEN_ITEM_WIDE_SQL = f"""
select row_idx, element_at(array({', '.join(repr(s) for s in _SHEETS)}), sheet_pos + 1) as sheet, sheet_pos,
 c_name as `NAME`, cast(o_custkey as string) as `CA`, cast(c_custkey as string) as `BP NUM`,
 concat('N', cast(c_custkey as string)) as `NIPNAS`,
 case when o_custkey % 13 = 0 then '  ' else c_mktsegment end as `PENGELOLAAN`,
 case when r_name = 'ASIA' then ' Jakarta ' else r_name end as `AREA`, n_name as `WITEL`, o_orderpriority as `SATKER`,
 concat('R', cast(n_regionkey as string)) as `REG`, case when o_orderkey % 5 = 0 then 'Follow up' end as `UNLOCK`,
 {', '.join(_cell_sql(i, j) for i in range(8) for j in range(6))},
 cast(o_totalprice as string) as `GRAND TOTAL`
from (select *, o_orderkey as row_idx, cast(o_orderkey % {len(_SHEETS)} as int) as sheet_pos,
  o_orderkey % 8 as _ki, o_custkey % 6 as _cj,
  case {_ODD} else concat(case when o_orderkey % 89 = 0 then '-' else '' end, cast(cast(o_totalprice * 1000000 as decimal(20,2)) as string)) end as _amt
 from {{orders}} join {{customer}} on o_custkey = c_custkey join {{nation}} on c_nationkey = n_nationkey
 join {{region}} on n_regionkey = r_regionkey) b
"""


def sql_for_duckdb(template: str) -> str:
    """Fixture SQL with the plain table names DuckDB has registered."""
    names = {t: t for t in BASE_TABLES}
    names["invoice"] = INVOICE_SQL.format(**names)
    return template.format(**names)


class Fixtures:
    """Lazily built stand-in DataFrames for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, template: str, **extra) -> DataFrame:
        kw = {t: self.table(t) for t in BASE_TABLES if "{" + t + "}" in template}
        kw.update(extra)
        return self.spark.sql(template, **kw)

    # --- FIXTURES 3.1 ---------------------------------------------------
    def invoices(self) -> DataFrame:
        return self._sql(INVOICE_SQL)

    # --- FIXTURES 3.3 ---------------------------------------------------
    def trend_t13m(self) -> DataFrame:
        return self._sql(TREND_SQL)

    def metrics_history(self) -> DataFrame:
        return self._sql(METRICS_SQL)

    def cash_inflow(self) -> DataFrame:
        return self._sql(INFLOW_SQL)

    # --- FIXTURES 3.4 ---------------------------------------------------
    def top_customers(self) -> DataFrame:
        return self.spark.sql(TOP_CUSTOMERS_SQL.replace("({invoice})", "{invoice}"), invoice=self.invoices())

    # --- FIXTURES 3.2: wide open-item sheet rows ------------------------
    def open_item_wide(self) -> DataFrame:
        """Wide sheet rows: identity columns named as on the sheet, 48 amount
        columns (one for each category and bracket) held as text, a trailing non-category
        column, and the sheet each row was landed from."""
        return self._sql(OPEN_ITEM_WIDE_SQL)

    def open_item_header(self) -> DataFrame:
        """Row 0 of each sheet: category labels over the amount columns, as
        (sheet, idx, name, label) -- metadata, one row per sheet column."""
        rows = []
        for pos, sheet in enumerate(_SHEETS):
            for idx, name in enumerate(OPEN_ITEM_COLUMNS):
                label = None
                if name in OPEN_ITEM_CELLS and OPEN_ITEM_CELLS.index(name) % 6 == 0:
                    label = vocab.CATEGORIES[(OPEN_ITEM_CELLS.index(name) // 6 + category_shift(pos)) % 8]
                elif name == "GRAND TOTAL":
                    label = "GRAND TOTAL"
                rows.append((sheet, idx, name, label))
        return self.spark.createDataFrame(rows, "sheet string, idx int, name string, label string")
