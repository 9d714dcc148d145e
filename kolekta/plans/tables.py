"""Stored tables: keyed changes on versioned tables, CSV export, load log.

``kolekta.plans.versions`` keeps the versions; here each keyed change pins the
version it reads, rewrites the partitions of its change set and commits. If
another writer changed one of them meanwhile, it runs again from their version;
otherwise both changes stand.

A keyed change on a partitioned table whose key holds the partition column
reads and writes only the partitions of the change. The partition column
must have few distinct values (months): their list is kept in the pointer.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType, StructType

from kolekta import schemas
from kolekta.operators.ingest import import_report
from kolekta.operators.mutations import append_rows, delete_rows, keys_of, update_rows, upsert_rows
from kolekta.plans.versions import (ConcurrentWriteError, Conflict, difference, expire, history, keep_feed, publish, read_current,  # noqa: F401
                                    read_pointer, read_version, rebalanced, remove, schema_of, stage, table_changes, versions,
                                    write_version)

#: Runs of a change against other writers of the same partitions before it gives up.
ATTEMPTS = 20


def refresh(df: DataFrame, table_dir: str, partition_by: str | None = None) -> str:
    """Full refresh of a table (replaces delete-all-then-insert, atomically)."""
    return write_version(df, table_dir, partition_by)


def _touched(changes: DataFrame, part: str) -> list:
    """Partition values of a change set (a few months)."""
    return [r[0] for r in changes.select(part).distinct().collect()]


def _images(old: DataFrame, new: DataFrame, changes: DataFrame, pk: list[str]) -> DataFrame:
    """The rows of the change set's keys before and after, as ``table_changes`` gives them."""
    keys = changes.select(*pk)
    return difference(old.join(keys, pk, "left_semi"), new.join(keys, pk, "left_semi"), pk)


def change(spark: SparkSession, path: str, changes: DataFrame, mutate, pk, part: str | None, schema: StructType,
           operation: str = "change", facts: dict | None = None, feed: bool = False) -> dict | None:
    """Apply ``mutate(rows, changes)`` to the partitions of the change set, or
    to the whole table if it has none, and commit the result; the new
    pointer, or the old one where nothing is touched.

    ``facts`` go into the pointer; ``feed`` keeps the rows taken out and put in."""
    pk = keys_of(pk)
    changes = changes.toDF(*[c.lower() for c in changes.columns])
    if part is not None and part not in pk:
        raise ValueError(f"the key of a partitioned table holds its partition column {part!r}")
    touched = None if part is None else _touched(changes, part)
    pinned = read_pointer(spark, path)
    if touched == []:
        return pinned
    for _ in range(ATTEMPTS):
        # Columns that the table has beyond the schema (a later layout's, the stream's file) stay.
        more = [f for f in (schema_of(pinned).fields if pinned else []) if f.name not in schema.names]
        old = read_version(spark, path, pinned, StructType([*schema.fields, *more]), touched)
        made = stage(mutate(old, changes).select(*old.columns), path, pinned, part)
        new_pointer = {"folders": made["folders"], "whole": made["name"]}
        kept = keep_feed(_images(old.select(*schema.names), read_version(spark, path, new_pointer, schema), changes, pk), path) if feed else None
        try:
            return publish(spark, path, pinned, made, part, touched if part else [None], operation, facts, kept)
        except Conflict as lost:
            remove(spark, f"{path.rstrip('/')}/{made['name']}")
            if kept:
                remove(spark, f"{path.rstrip('/')}/{kept}")
            pinned = lost.now
    raise ConcurrentWriteError(f"{path}: {ATTEMPTS} runs lost against other writers")


INVOICE_KEY = schemas.TABLES["ar_segmen_ers_tbl"][1]


def _created(spark: SparkSession, path: str, schema: StructType, part: str | None) -> None:
    """The table empty, unless it is there; of two that create it, one does."""
    if read_pointer(spark, path) is None:
        try:
            write_version(spark.createDataFrame([], schema), path, part, operation="create", expected=0)
        except ConcurrentWriteError:
            pass


def upsert_partitions(spark: SparkSession, path: str, source: DataFrame, pk=INVOICE_KEY, part: str | None = "report_month",
                      schema: StructType = schemas.INVOICE, defaults: dict | None = None, **how) -> DataFrame:
    """MERGE into a stored table (created on first use, also by no rows)."""
    _created(spark, path, schema, part)
    change(spark, path, source, lambda old, s: upsert_rows(old, s, pk, defaults=defaults), pk, part, schema, "upsert", **how)
    return read_current(spark, path, schema)


def append_partitions(spark: SparkSession, path: str, new: DataFrame, pk=INVOICE_KEY, part: str | None = "report_month",
                      schema: StructType = schemas.INVOICE, defaults: dict | None = None, **how) -> DataFrame:
    """Insert rows of new keys into a stored table."""
    change(spark, path, new, lambda old, n: append_rows(old, n, pk, defaults=defaults), pk, part, schema, "append", **how)
    return read_current(spark, path, schema)


def update_partitions(spark: SparkSession, path: str, changes: DataFrame, cols: list[str] | None = None, pk=INVOICE_KEY,
                      part: str | None = "report_month", schema: StructType = schemas.INVOICE, **how) -> DataFrame:
    """Update by key in a stored table."""
    change(spark, path, changes, lambda old, ch: update_rows(old, ch, pk, cols), pk, part, schema, "update", **how)
    return read_current(spark, path, schema)


def delete_partitions(spark: SparkSession, path: str, keys: DataFrame, pk=INVOICE_KEY, part: str | None = "report_month",
                      schema: StructType = schemas.INVOICE, **how) -> DataFrame:
    """Delete by key from a stored table."""
    change(spark, path, keys, lambda old, k: delete_rows(old, k, pk), pk, part, schema, "delete", **how)
    return read_current(spark, path, schema)


class StoredTables:
    """The allow-listed tables under a root folder, read and changed by name.

    ``feed``: every keyed change keeps the rows it took out and put in, for
    tables that are maintained from them."""

    def __init__(self, spark: SparkSession, root: str, feed: bool = False):
        self.spark, self.root, self.feed = spark, root.rstrip("/"), feed

    def _spec(self, name: str):
        schema, pk, part = schemas.table_spec(name)
        return f"{self.root}/{name.lower()}", schema, pk, part

    def path(self, name: str) -> str:
        return self._spec(name)[0]

    def read(self, name: str, version: int | None = None, as_of: _dt.datetime | int | None = None) -> DataFrame:
        """The table now, at a version, or at a moment."""
        path, schema, _, _ = self._spec(name)
        return read_current(self.spark, path, schema, version=version, as_of=as_of)

    def version(self, name: str) -> int:
        """The newest version; 0 before the first."""
        now = read_pointer(self.spark, self.path(name))
        return now["version"] if now else 0

    def changes(self, name: str, start: int, end: int | None = None) -> DataFrame:
        """What turns version ``start`` into ``end`` (see ``table_changes``)."""
        path, schema, pk, _ = self._spec(name)
        return table_changes(self.spark, path, start, end, keys_of(pk), schema)

    def history(self, name: str) -> DataFrame:
        return history(self.spark, self.path(name))

    def refresh(self, name: str, rows: DataFrame, facts: dict | None = None, expected: int | None = None) -> DataFrame:
        path, schema, _, part = self._spec(name)
        write_version(schemas.conform(rows, schema), path, part, facts=facts, expected=expected)
        return self.read(name)

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        path, schema, pk, part = self._spec(name)
        return append_partitions(self.spark, path, rows, pk, part, schema, schemas.DEFAULTS.get(name.lower()), feed=self.feed)

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        path, schema, pk, part = self._spec(name)
        return upsert_partitions(self.spark, path, rows, pk, part, schema, schemas.DEFAULTS.get(name.lower()), feed=self.feed)

    def update(self, name: str, rows: DataFrame, cols: list[str] | None = None) -> DataFrame:
        path, schema, pk, part = self._spec(name)
        return update_partitions(self.spark, path, rows, cols, pk, part, schema, feed=self.feed)

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        path, schema, pk, part = self._spec(name)
        return delete_partitions(self.spark, path, keys, pk, part, schema, feed=self.feed)


def create_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """Create the five tables empty (version 1) with their explicit schemas."""
    return {name: write_version(spark.createDataFrame([], schema), f"{root.rstrip('/')}/{name}", part)
            for name, (schema, _, part) in schemas.TABLES.items()}


# --- CSV export ------------------------------------------------------------------

#: Characters that a quoted text escapes, and how: fixed values of the JSON text format.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _quoted_text(c: str) -> F.Column:
    """A text as a quoted JSON string; null as the empty one."""
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = text
    for raw, escaped in _ESCAPES.items():   # the backslash first
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for code in range(32):
        if chr(code) not in _ESCAPES:
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike("[\\x00-\\x1f]"), rare).otherwise(out), F.lit('"'))


def _plain_number(c: str, kind) -> F.Column:
    """A number in its shortest plain form; null as the empty quoted text."""
    value = F.col(c)
    if isinstance(kind, (DoubleType, FloatType)):
        value = value.cast("decimal(38,12)")
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(value == 0, F.lit("0")).otherwise(text), F.lit('""'))


def csv_lines(df: DataFrame) -> DataFrame:
    """(value): a line for each row, every text quoted, no number quoted, null as ``""``."""
    cells = [_plain_number(f.name, f.dataType) if isinstance(f.dataType, NumericType) else _quoted_text(f.name)
             for f in df.schema.fields]
    return df.select(F.concat_ws(",", *cells).alias("value"))


def export_csv(df: DataFrame, out_dir: str, month: str | None = None, segment: str | None = None,
               date: str | None = None, order: tuple[str, ...] | None = None) -> str | None:
    """CSV export as the dashboard downloads it, in the folder ``AR_Data_{month}_{segment}_{date}``.

    A header of plain names, then one line for each row in the order of
    ``order`` (the first column by default): texts are quoted with JSON's
    escapes, so line ends stay within a line; numbers stand as they are; null
    is ``""``. The files of the folders ``part=0`` (the header) and ``part=1``, in the order of
    their names, make up the file; its last line ends with a line feed too. Empty input writes nothing."""
    if df.isEmpty():
        return None
    date = date or _dt.date.today().isoformat()
    name = f"AR_Data_{month or 'ALL'}_{segment or 'ALL'}_{date}".replace("/", "-").replace(" ", "_")
    out = f"{out_dir.rstrip('/')}/{name}"
    keys = [F.col(c) for c in (order or df.columns[:1])]
    header = df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(f"{out}/part=0")
    csv_lines(df.orderBy(*keys)).write.mode("overwrite").text(f"{out}/part=1")
    return out


def read_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of an exported file with ``schema``; texts that were null come back empty, numbers null."""
    lines = spark.read.text(f"{path}/part=1")
    cells = lines.select(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>").alias("c"))
    return cells.select(*[(F.col("c")[k] if isinstance(f.dataType, StringType) else
                           F.nullif(F.col("c")[k], F.lit(""))).cast(f.dataType).alias(f.name)
                          for k, f in enumerate(schema.fields)])


def load_log(inv: DataFrame, log_dir: str) -> DataFrame:
    """Append one audit row per report month loaded (rows, load time)."""
    log = import_report(inv).withColumn("loaded_at", F.current_timestamp())
    log.write.mode("append").parquet(log_dir)
    return inv.sparkSession.read.parquet(log_dir)
