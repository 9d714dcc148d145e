"""Table access: the five allow-listed receivables tables and the raw sheet reader.

``TableCatalog`` maps a table name to a loader. ``TableCatalog.at(spark, root)``
reads Parquet under a root folder (the fact table partitioned by
``report_month``, so month filters prune partitions); tests and the query
registry build one from the fixture views instead.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolekta import schemas
from kolekta.operators.filters import filter_invoices


class TableCatalog:
    def __init__(self, loaders: dict[str, Callable[[], DataFrame]]):
        self._loaders = {k.lower(): v for k, v in loaders.items()}

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> "TableCatalog":
        from kolekta.plans.tables import read_current  # local import: plans depend on sources

        def loader(name):
            schema = schemas.TABLES[name][0]
            return lambda: read_current(spark, f"{root.rstrip('/')}/{name}", schema)
        return cls({name: loader(name) for name in schemas.TABLES})

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, properties: dict, months: list[str] | None = None) -> "TableCatalog":
        """Tables read over JDBC (the dashboard's original store). Filters on the
        returned DataFrames are pushed into the database's WHERE clause. For the
        fact table, ``months`` splits the read into parallel partitions, one
        connection each; a last one reads every other row."""
        def loader(name):
            def load():
                table = name.upper()
                if name == "ar_segmen_ers_tbl" and months:
                    return spark.read.jdbc(url, table, predicates=covering_predicates("REPORT_MONTH", months),
                                           properties=properties)
                return spark.read.jdbc(url, table, properties=properties)
            return load
        return cls({name: loader(name) for name in schemas.TABLES})

    def read_table(self, name: str) -> DataFrame:
        """Whole table, lower-case columns; unknown names raise ``ValueError``."""
        schemas.table_spec(name)
        key = name.lower()
        if key not in self._loaders:
            raise ValueError(f"table not available: {name!r}")
        return schemas.lower_cols(self._loaders[key]())

    def primary_key(self, name: str) -> tuple[str, ...]:
        return schemas.table_spec(name)[1]

    def invoices(self, month=None, segment=None, region=None) -> DataFrame:
        """Scan of the fact table with the dashboard filters pushed down."""
        return filter_invoices(self.read_table("ar_segmen_ers_tbl"), month, segment, region)


def read_wide(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A landed sheet (CSV with a header row, every column text; or Parquet),
    header names trimmed."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        df = spark.read.parquet(path)
    return schemas.normalise_headers(df)


def covering_predicates(column: str, values: list[str]) -> list[str]:
    """WHERE fragments that take every row exactly once: one for each value,
    and one for null and all other values."""
    values = sorted({v for v in values if v is not None})
    quoted = ["'" + v.replace("'", "''") + "'" for v in values]
    if not quoted:
        return ["1 = 1"]
    return [f"{column} = {q}" for q in quoted] + [f"({column} IS NULL OR {column} NOT IN ({', '.join(quoted)}))"]


LABEL_ROW, NAME_ROW = 0, 2
#: How a landed sheet writes its cells: a quotation mark within quotes is doubled, white space stands as it is.
CSV_CELLS = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _numbered(names: list) -> list[str]:
    """Trimmed column names; one that repeats gets ".1", ".2", ...; an empty one its position."""
    seen: dict[str, int] = {}
    out = []
    for k, n in enumerate(names):
        n = str(n).strip() if n is not None and str(n).strip() else f"Unnamed: {k}"
        out.append(n if n not in seen else f"{n}.{seen[n]}")
        seen[n] = seen.get(n, 0) + 1
    return out


def sheet_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, text): the records of a landed CSV file, numbered from 0.

    A record is a line, or several that a quoted cell joins; empty lines are
    records too. Lines end with a line feed, or with a return and a line feed.
    Files of a folder follow each other by name. Spark reads them in splits. Each counts its lines and quotation
    marks; running totals of the splits, a row each on the driver, tell where a split
    stands in the file and whether it starts within a quoted cell.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = sorted(lines.groupBy("file", "start").agg(F.sum(marks).alias("m")).collect(), key=lambda r: (r["file"], r["start"]))
    files = {f: k << 44 for k, f in enumerate(sorted({r["file"] for r in splits}))}   # a file's splits lie below 2**44
    odd, inside = 0, {}
    for r in splits:
        inside[files[r["file"]] + r["start"]] = odd
        odd = (odd + r["m"]) % 2
    if len(files) > 1:
        known = F.create_map(*[F.lit(x) for pair in files.items() for x in pair])
        lines = lines.withColumn("start", F.col("start") + F.element_at(known, F.col("file")))
    lines = lines.select("start", "value")

    def number(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        seen: dict[int, tuple[int, int]] = {}   # a task may hold several splits
        for b in batches:
            starts = b.column(0).to_numpy()
            found = pc.count_substring(b.column(1), '"').to_numpy(zero_copy_only=False).astype(np.int64)
            record, line, goes_on = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64), np.empty(len(starts), bool)
            for s in np.unique(starts).tolist():
                own = np.flatnonzero(starts == s)
                records, n, before = seen.get(s, (0, 0, inside[s]))
                total = before + np.cumsum(found[own])
                goes_on[own] = (total - found[own]) % 2 == 1
                record[own] = records + np.cumsum(~goes_on[own]) - 1
                line[own] = n + np.arange(len(own))
                seen[s] = (int(record[own[-1]]) + 1, n + len(own), int(total[-1]) % 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(record), pa.array(line), pa.array(goes_on), b.column(1)],
                                             ["start", "record", "line", "goes_on", "value"])

    numbered = lines.mapInArrow(number, "start long, record long, line long, goes_on boolean, value string")
    before, table = 0, []
    counted = numbered.groupBy("start").agg(F.count(F.when(~F.col("goes_on"), 1)).alias("n"), F.count("*").alias("lines")).collect()
    for r in sorted(counted, key=lambda r: r["start"]):
        table.append((r["start"], before))
        before += r["n"]
    table = spark.createDataFrame(table, "start long, before long")
    placed = numbered.join(F.broadcast(table), "start").withColumn("record", F.col("record") + F.col("before"))
    if before == sum(r["lines"] for r in counted):   # every line is a record: nothing to join, so no shuffle of the texts
        return placed.select("record", F.regexp_replace("value", r"\r\z", "").alias("text"))
    # Lines that a quoted cell joins to a record, as many as a cell has, in the order of the file.
    rest = placed.where("goes_on").groupBy("record").agg(F.sort_array(F.collect_list(F.struct("start", "line", "value"))).alias("rest"))
    text = F.concat_ws("\n", "value", F.transform(F.coalesce("rest", F.array()), lambda x: x["value"]))
    return (placed.where("not goes_on").join(rest, "record", "left")
            .select("record", F.regexp_replace(text, r"\r\z", "").alias("text")))


def read_sheet(spark: SparkSession, path: str, sheet: str, sheet_pos: int) -> tuple[DataFrame, DataFrame]:
    """(wide, header) of one landed sheet: a CSV file of the cells as they stand.

    The first record holds the category labels, the third the column names,
    all below it the data, empty lines included. ``wide`` has them as text
    with ``row_idx`` (from 0, the record's place below the names), ``sheet``
    and ``sheet_pos``; ``header`` is (sheet, idx, name, label). Only the three
    top records reach the driver; a row's number does not depend on the splits."""
    records = sheet_records(spark, path)
    top = {r["record"]: next(csv.reader(io.StringIO(r["text"].lstrip("\ufeff"), newline="")), [])
           for r in records.where(F.col("record") <= NAME_ROW).collect()}
    labels, names = top.get(LABEL_ROW, []), _numbered(top.get(NAME_ROW, []))
    labels = [(labels[k] if k < len(labels) and labels[k].strip() else None) for k in range(len(names))]
    header = spark.createDataFrame([(sheet, k, n, lab) for k, (n, lab) in enumerate(zip(names, labels))],
                                   "sheet string, idx int, name string, label string")
    ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = records.where(F.col("record") > NAME_ROW).select(
        F.from_csv("text", ddl, CSV_CELLS).alias("cells"), (F.col("record") - (NAME_ROW + 1)).alias("row_idx"))
    return (rows.select("cells.*", "row_idx", F.lit(sheet).alias("sheet"), F.lit(sheet_pos).alias("sheet_pos")), header)


def read_workbook(spark: SparkSession, sheets: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(wide, header) of the landed sheets [(name, path)] in workbook order; a column that a sheet lacks is null."""
    found = [read_sheet(spark, path, name, pos) for pos, (name, path) in enumerate(sheets)]
    wide, header = found[0]
    for w, h in found[1:]:
        wide, header = wide.unionByName(w, allowMissingColumns=True), header.unionByName(h)
    return wide, header


def read_snapshots(spark: SparkSession, sheets: list[tuple[str, str]], fmt: str = "parquet") -> DataFrame:
    """Landed sheets of one workbook, in workbook order, as one frame with
    ``sheet`` and ``sheet_pos``: each file is read lazily and the frames are
    appended by column name (a sheet missing a column gets nulls)."""
    frames = [read_wide(spark, path, fmt).withColumn("sheet", F.lit(name)).withColumn("sheet_pos", F.lit(pos))
              for pos, (name, path) in enumerate(sheets)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
