"""Wide monthly open-item sheets -> invoice fact rows.

A landed sheet is a wide DataFrame: identity columns named as on the sheet
(NAME, CA, BP NUM, ...), then per invoice category up to six amount columns
(one per aging bracket) kept as text, plus the persisted source row number
``row_idx`` and the ``sheet`` it came from. Row 0 of a sheet (category
labels over the amount columns) is metadata, given as a small
(sheet, idx, name, label) DataFrame: columns shift between periods, so each
sheet has its own. A header without ``sheet`` holds for all sheets.

Only the column map is read on the driver (at most 48 rows a sheet), to build
the unpivot's expression; data rows never leave the executors. Identity
columns are worked out once a wide row; then an array of the row's cells,
without the empty ones, is inlined, so no row is copied for an empty cell and
positions need no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import amount_sql, is_number_sql, safe_str_sql, sql_str, strip, values_frame

# --- ING-2/3 ------------------------------------------------------------------

def column_map(header: DataFrame, valid: tuple[str, ...] = vocab.CATEGORIES,
               per_category: int = vocab.BRACKETS_PER_CATEGORY) -> DataFrame:
    """([sheet,] position, name, category, offset) of every amount column.

    A non-null row-0 label opens a range that runs to the next label or the
    end of the sheet; the first ``per_category`` columns of a range are aging
    brackets 0..5, the rest are ignored. Unknown labels are skipped; when a
    label repeats, its last range wins. Runs on the header rows only, each
    sheet's by themselves."""
    by = ["sheet"] if "sheet" in header.columns else []
    w = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = header.select(
        *by, "idx", "name",
        F.last(F.when(F.col("label").isNotNull(), F.col("idx")), ignorenulls=True).over(w).alias("_start"),
        F.last(F.when(F.col("label").isNotNull(), strip("label")), ignorenulls=True).over(w).alias("category"))
    h = h.where(F.col("category").isin(*valid))
    h = h.withColumn("_last", F.max("_start").over(Window.partitionBy(*by, "category")))
    off = (F.col("idx") - F.col("_start")).cast("int")
    return (h.where((F.col("_start") == F.col("_last")) & (off < per_category))
             .select(*by, F.col("idx").alias("position"), "name", "category", off.alias("offset")))


# --- SRC-7, ING-1, WIN-8 ------------------------------------------------------

def sheet_dim(spark, sheets: tuple = vocab.SHEET_MONTHS) -> DataFrame:
    return values_frame(spark, sheets, ("sheet", "report_month"))


def chosen_sheets(present: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """(sheet, sheet_pos, report_month): of the known sheets in ``present(sheet,
    sheet_pos)``, the first in workbook order for each report month."""
    if dim is None:
        dim = sheet_dim(present.sparkSession)
    known = present.select("sheet", "sheet_pos").distinct().join(dim, "sheet")
    first = Window.partitionBy("report_month").orderBy("sheet_pos", "sheet")
    return (known.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
                 .select("sheet", "sheet_pos", "report_month"))


def select_sheets(wide: DataFrame, dim: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """Keep rows of known sheets only, and per report month only the first
    sheet in workbook order (``sheet_pos``); adds ``report_month``.

    The choice is made at sheet grain: from ``present`` (a manifest of the
    landed sheets), or from the distinct sheets of the rows -- a sheet that
    failed to land has no rows and claims nothing. The list has at most one
    sheet for each month of the sheet dimension, so it is what is broadcast;
    the wide rows stay where they are."""
    chosen = chosen_sheets(wide if present is None else present, dim)
    return wide.join(F.broadcast(chosen.select("sheet", "report_month")), "sheet")


# --- ING-4/5 -----------------------------------------------------------------

def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _cells_sql(layout: list[tuple]) -> str:
    """Array of a row's amount cells for one sheet layout."""
    return "array(" + ", ".join(
        f"named_struct('pos', {pos}, 'category', {sql_str(cat)}, 'bracket', {off}, 'raw', cast({_quoted(name)} as string))"
        for pos, name, cat, off in layout) + ")"


def unpivot_cells(wide: DataFrame, colmap: DataFrame, keep: tuple[str, ...] = (), parse: bool = False) -> DataFrame:
    """One row per non-null amount cell: (row_idx, *keep, pos, category, bracket, raw).

    Sheets of one layout share an expression; rows of sheets without a
    layout, and columns that the frame lacks, give no cells. With ``parse``
    there is ``v`` too, the cell's amount, and only cells that hold a number
    but zero come (``v`` is null where it is too large to store); each cell
    is parsed once, before the rows are made."""
    layouts: dict[str | None, list] = {}
    for r in colmap.collect():   # metadata: at most 48 rows a sheet
        if r["name"] in wide.columns:
            layouts.setdefault(r["sheet"] if "sheet" in colmap.columns else None, []).append(
                (r["position"], r["name"], r["category"], r["offset"]))
    shared: dict[tuple, list] = {}
    for sheet, layout in layouts.items():
        shared.setdefault(tuple(sorted(layout)), []).append(sheet)
    if not shared:
        cells = "cast(array() as array<struct<pos:int,category:string,bracket:int,raw:string>>)"
    elif "sheet" in colmap.columns:
        cells = "CASE " + " ".join(
            f"WHEN sheet IN ({', '.join(map(sql_str, sorted(sheets)))}) THEN {_cells_sql(list(layout))}"
            for layout, sheets in shared.items()) + " END"
    else:
        cells = _cells_sql(list(next(iter(shared))))
    names = "pos, category, bracket, raw"
    cells = f"filter({cells}, c -> c.raw IS NOT NULL)"
    if parse:
        names += ", v"
        fields = ", ".join(f"'{n}', c.{n}" for n in names.split(", ")[:4])
        cells = (f"filter(transform({cells}, c -> named_struct({fields}, 'v', {amount_sql('c.raw')})), "
                 f"c -> coalesce(c.v <> 0, {is_number_sql('c.raw')}))")
    # The outer form: for the other Spark adds a filter on the array's size, which would parse every cell once more.
    return wide.selectExpr("row_idx", *map(_quoted, keep), f"inline_outer({cells}) AS ({names})").where("pos IS NOT NULL")


def coerce_amount(cells: DataFrame) -> DataFrame:
    """Numeric cells only: text (also with type suffixes or hexadecimal), blanks,
    NaN, infinities and exact zeros are dropped, negatives kept. Adds ``v``,
    the exact decimal that all later figures come from. Numbers too large for
    it are left out here; ``overflowing_cells`` lists them."""
    return cells.withColumn("v", F.expr(amount_sql("raw"))).where(F.col("v") != 0)


def overflowing_cells(cells: DataFrame) -> DataFrame:
    """Cells that hold a number too large to store, with the reason."""
    return (cells.where(F.expr(f"{is_number_sql('raw')} AND {amount_sql('raw')} IS NULL"))
                 .withColumn("reasons", F.lit("amount_overflow")))


def scale_to_billions(amount: str = "v") -> F.Column:
    """Rupiah -> billions, ``round(v / 1e9, 6)``, on the exact decimal."""
    return F.expr(f"cast(round({amount} / 1000000000, 6) as decimal(18,6))")


# --- ING-7/8 -----------------------------------------------------------------

def bracket_dim(spark, brackets: tuple = vocab.BRACKETS) -> DataFrame:
    return values_frame(spark, [(b, a, s) for b, _, a, s in brackets], ("bracket", "aging_category", "status_tagih"))


def classify_aging(df: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Aging bracket -> (aging bucket, collection status), a broadcast lookup
    of the fixed six-row bracket table."""
    if dim is None:   # six rows of the program: a local relation, which Spark broadcasts
        dim = bracket_dim(df.sparkSession)
    return df.join(dim, "bracket", "left")


def classify_invoice(df: DataFrame, sudah: tuple[str, ...] = vocab.SUDAH_CATS) -> DataFrame:
    in_list = ", ".join(sql_str(c) for c in sudah)
    return df.withColumn("status_invoice", F.expr(
        f"CASE WHEN category IN ({in_list}) THEN {sql_str(vocab.SUDAH_INVOICE)} ELSE {sql_str(vocab.BELUM_INVOICE)} END"))


# --- ING-9/10/11 -------------------------------------------------------------

def identity_columns(df: DataFrame, spec: tuple = vocab.IDENTITY_COLUMNS) -> DataFrame:
    """Sheet identity columns -> fact columns: trimmed, cut to their maximum
    length, blank as null; ``uic`` falls back to ERS and ``action_plan`` to
    normal collection. One projection, written as SQL text."""
    def src(name):
        return "`" + name + "`" if name in df.columns else "cast(NULL as string)"
    made = {fact: safe_str_sql(src(sheet), n) for sheet, fact, n in spec}
    made["uic"] = safe_str_sql(src("PENGELOLAAN"), vocab.UIC_MAX, vocab.UIC_DEFAULT)
    made["action_plan"] = safe_str_sql(src("UNLOCK"), vocab.ACTION_MAX, vocab.ACTION_DEFAULT)
    kept = ["`" + c + "`" for c in df.columns if c.lower() not in made]   # names are case-insensitive
    return df.selectExpr(*kept, *[f"{v} AS {k}" for k, v in made.items()])


def with_invoice_key(df: DataFrame, month: str = "report_month") -> DataFrame:
    """``upper(left(month,3)) || left(ca,8) || '-' || left(category,4) || '-' ||
    bracket || '-' || row_idx``, cut to 50. ``row_idx`` is the persisted source
    row number, so ids are stable across reruns and upserts stay idempotent."""
    return df.withColumn("invoice_id", F.expr(
        f"substring(concat(upper(substring({month}, 1, 3)), substring(coalesce(ca, ''), 1, 8), '-', "
        f"substring(category, 1, 4), '-', cast(bracket as string), '-', cast(row_idx as string)), 1, 50)"))


def import_cells(wide: DataFrame, header: DataFrame, sheets: DataFrame | None = None,
                 valid: tuple[str, ...] = vocab.CATEGORIES, present: DataFrame | None = None,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """The number cells of the chosen sheets with their amounts and the row's
    identity columns (and ``keep``); ``import_facts`` and ``import_oversized``
    divide them."""
    rows = identity_columns(select_sheets(wide, sheets, present))
    made = tuple(fact for _, fact, _ in vocab.IDENTITY_COLUMNS) + ("uic", "action_plan")
    return unpivot_cells(rows, column_map(header, valid), ("report_month", "sheet") + made + keep, parse=True)


def import_facts(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scale and classify the amounts of ``import_cells`` and add the key."""
    cells = cells.where("v IS NOT NULL").withColumn("nilai_m", scale_to_billions())
    facts = with_invoice_key(classify_invoice(classify_aging(cells)))
    return facts.selectExpr(
        "invoice_id", "customer_name", "aging_category", "status_tagih", "region",
        "substring(category, 1, 50) AS invoice_status", "nilai_m", "uic",
        "substring(report_month, 1, 30) AS due_date", "action_plan", "cast(0 as int) AS above_credit_limit",
        "substring(report_month, 1, 20) AS report_month", "pengelolaan", "bp_num", "nipnas", "witel", "satker", "reg",
        "status_invoice", *keep)


def import_oversized(cells: DataFrame) -> DataFrame:
    """(sheet, report_month, row_idx, pos, category, bracket, raw, reasons) of the numbers too large to store."""
    return cells.where("v IS NULL").select("sheet", "report_month", "row_idx", "pos", "category", "bracket", "raw",
                                           F.lit("amount_overflow").alias("reasons"))


def import_open_items(wide: DataFrame, header: DataFrame, sheets: DataFrame | None = None,
                      valid: tuple[str, ...] = vocab.CATEGORIES, present: DataFrame | None = None) -> DataFrame:
    """The whole sheet import: pick sheets, derive identity columns, unpivot
    amount cells, coerce and scale amounts, classify, and add the key."""
    return import_facts(import_cells(wide, header, sheets, valid, present))


def import_rejects(wide: DataFrame, header: DataFrame, sheets: DataFrame | None = None,
                   valid: tuple[str, ...] = vocab.CATEGORIES, present: DataFrame | None = None) -> DataFrame:
    """The cells that the import leaves out though they hold a number (see ``import_oversized``)."""
    return import_oversized(import_cells(wide, header, sheets, valid, present))


def import_report(inv: DataFrame) -> DataFrame:
    """Records per report month."""
    return inv.groupBy("report_month").agg(F.count(F.lit(1)).cast("bigint").alias("records"))
