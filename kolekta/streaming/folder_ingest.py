"""Drop-folder ingest with Structured Streaming.

``stream_ingest`` watches a folder of landed sheet files (Parquet). For each
micro-batch it imports the sheets, validates, and merges the facts into the
stored invoice table, month by month.

The table does not depend on the order of the files or on how they fall into
batches, since every rule looks at what a row is, not at when it came:

* A month belongs to the first sheet, in workbook order, that has landed for
  it. The table's pointer keeps these claims. An earlier sheet that lands
  later replaces the month; rows of a later sheet are left out.
* A key is checked within its file: a file that holds a key twice loses both rows.
* Of one key in several files of the sheet, the file of the greatest name
  wins. Each stored row keeps its file's name (``land_file``).

Facts and claims are one commit. A batch that runs again after a failure does
the same again: rejects and the load log are written under the batch's number.
Rejects and log tell what each batch met, so they do follow the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kolekta import schemas
from kolekta.operators.ingest import chosen_sheets, import_cells, import_facts, import_oversized, import_report
from kolekta.operators.quality import split_valid
from kolekta.plans.marts import refresh_mart
from kolekta.plans.tables import ATTEMPTS, INVOICE_KEY
from kolekta.plans.versions import (ConcurrentWriteError, Conflict, publish, read_current, read_pointer, read_version, remove,
                                    stage, write_version)
from kolekta.session import scratch_path

FILE = "land_file"
#: The invoice table as the stream stores it: with the file that each row came from.
LANDED = StructType([*schemas.INVOICE.fields, StructField(FILE, StringType())])
_CLAIM = "claim "


def merge_latest(table: DataFrame, new: DataFrame, pk=INVOICE_KEY, sequence: str = FILE) -> DataFrame:
    """MERGE by a sequence: of the rows of one key, in the table or new, that of
    the greatest ``sequence`` stays (null is least; an equal one is replaced).

    The result is the same for every order and grouping of the new rows."""
    names = table.columns
    latest = new.groupBy(*pk).agg(F.max_by(F.struct(*names), F.coalesce(sequence, F.lit(""))).alias("new"))
    old = table.select(*pk, F.struct(*names).alias("old"))
    wins = F.col("old").isNull() | (F.coalesce(f"new.{sequence}", F.lit("")) >= F.coalesce(f"old.{sequence}", F.lit("")))
    row = F.when(F.col("new").isNotNull() & wins, F.col("new")).otherwise(F.col("old"))
    return old.join(latest, list(pk), "full_outer").select(row.alias("row")).select("row.*")


def claims(pointer: dict | None) -> dict[str, tuple]:
    """{month: (sheet_pos, sheet)} that a table's pointer keeps."""
    return {k[len(_CLAIM):]: tuple(v) for k, v in (pointer["state"] if pointer else {}).items() if k.startswith(_CLAIM)}


def _commit(spark: SparkSession, path: str, facts: DataFrame, coming: dict, pinned: dict) -> tuple[list, dict]:
    """One attempt to merge the facts of the sheets that win their months; (touched months, new pointer)."""
    held = claims(pinned)
    won = {m: c for m, c in coming.items() if m not in held or c <= held[m]}
    if not won:
        return [], pinned
    taken_over = [m for m, c in won.items() if m in held and c < held[m]]
    mine = F.lit(False)
    for m, (_, sheet) in won.items():
        mine = mine | ((F.col("report_month") == m) & (F.col("sheet") == sheet))
    months = sorted(won)
    old = read_version(spark, path, pinned, LANDED, months).where(~F.col("report_month").isin(taken_over))
    rows = merge_latest(old, facts.where(mine).select(*LANDED.names))
    made = stage(rows, path, pinned, "report_month")
    try:
        return months, publish(spark, path, pinned, made, "report_month", months, "stream",
                               state={_CLAIM + m: list(c) for m, c in won.items()})
    except Conflict:
        remove(spark, f"{path}/{made['name']}")
        raise


def dealt(batch: DataFrame) -> DataFrame:
    """The rows of a batch dealt to all tasks by their place on the sheet: a landed file of a single
    row group, whatever its size, is read by one task, which would import all of it."""
    return batch.repartition(*[c for c in ("sheet", "row_idx") if c in batch.columns])


def merge_batch(spark: SparkSession, batch: DataFrame, header: DataFrame, table_path: str, epoch_id: int,
                sheets: DataFrame | None = None, mart_path: str | None = None) -> None:
    """Import one batch of wide sheet rows (with ``land_file``, if they have one) into the stored table.

    Beside the table: ``_rejects/epoch=N`` (rows that failed validation, cells
    too large to store) and ``_log/epoch=N`` (rows loaded per month)."""
    base = table_path.rstrip("/")
    if FILE not in batch.columns:
        batch = batch.withColumn(FILE, F.lit(""))
    if read_pointer(spark, base) is None:
        try:
            write_version(spark.createDataFrame([], LANDED), base, "report_month", operation="create", expected=0)
        except ConcurrentWriteError:
            pass
    # One row for each month: the first of the batch's sheets.
    coming = {r["report_month"]: (r["sheet_pos"], r["sheet"]) for r in chosen_sheets(batch, sheets).collect()}
    present = spark.createDataFrame([(s, p) for p, s in coming.values()], "sheet string, sheet_pos int")
    # The import runs once a batch: its cells are kept in the shared folder until they are merged.
    cells = import_cells(dealt(batch), header, sheets, present=present, keep=(FILE,))
    kept, checked = scratch_path(spark, "batch"), scratch_path(spark, "batch")
    cells.write.parquet(kept)
    cells = spark.read.schema(cells.schema).parquet(kept)
    good, bad = split_valid(import_facts(cells, keep=(FILE, "sheet")), amount="nilai_m", unit=FILE)
    schemas.conform(good, StructType([*LANDED.fields, StructField("sheet", StringType())])).write.parquet(checked)
    good = spark.read.schema(StructType([*LANDED.fields, StructField("sheet", StringType())])).parquet(checked)
    for _ in range(ATTEMPTS):
        pinned = read_pointer(spark, base)
        try:
            months, now = _commit(spark, base, good, coming, pinned)
            break
        except Conflict:
            continue
    else:
        raise ConcurrentWriteError(f"{base}: {ATTEMPTS} runs lost against other writers")
    out = bad.select("report_month", F.col("invoice_id").alias("source"), "reasons").unionByName(
        import_oversized(cells).select("report_month", F.concat_ws(":", "sheet", "row_idx", "pos", "raw").alias("source"), "reasons"))
    out.write.mode("overwrite").parquet(f"{base}_rejects/epoch={epoch_id}")
    (import_report(good.where(F.col("report_month").isin(months))).withColumn("loaded_at", F.current_timestamp())
     .write.mode("overwrite").parquet(f"{base}_log/epoch={epoch_id}"))
    if mart_path and months:
        refresh_mart(spark, read_version(spark, base, now, schemas.INVOICE), mart_path, months)
    remove(spark, kept)
    remove(spark, checked)


def stream_ingest(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_dir: str,
                  header: DataFrame, wide_schema: StructType, sheets: DataFrame | None = None,
                  mart_path: str | None = None, processing_time: str | None = None, files_per_batch: int | None = None):
    """Run the folder ingest. By default it processes what is there now and
    stops (``availableNow``), returning the table; with ``processing_time``
    (e.g. "15 seconds") it keeps running and the query handle is returned."""
    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        merge_batch(spark, batch, header, table_path, epoch_id, sheets, mart_path)

    reader = spark.readStream.schema(wide_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(landing_dir).select("*", F.col("_metadata.file_name").alias(FILE))
    w = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_dir)
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return read_current(spark, table_path, schemas.INVOICE)
