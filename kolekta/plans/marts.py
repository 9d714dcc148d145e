"""The dashboard mart: the fact table summed per combination of the six
dimensions that the dashboard reads, one partition for each report month.

Every KPI, flow, breakdown and payload figure is a sum or a row count under
conditions on these dimensions, so the mart answers them in place of the fact
table: its ``nilai_m`` is the sum of a combination, ``records`` its rows. Its
size is bounded by the product of the dimensions, not by the data. A refresh
recomputes the months that changed and commits them as a new version.

``maintain_mart`` and ``maintain_cube`` keep a mart, and the filter cube, in
step with a stored table without reading it: they add the signed changes that
its commits kept (rows taken out count against, rows put in count for) and drop
combinations that no row is left of. The pointer of the mart names the version
of the table that it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from kolekta import schemas, vocab
from kolekta.functions import money
from kolekta.operators.cubes import DIMS, SUMS, cube_rows, cube_sums
from kolekta.operators.filters import filter_invoices
from kolekta.plans.tables import INVOICE_KEY
from kolekta.plans.versions import read_current, read_pointer, signed_changes, versions, write_version

KEYS = ("report_month", "pengelolaan", "region", "invoice_status", "status_tagih", "aging_category")
MART = StructType([*[StructField(k, StringType()) for k in KEYS],
                   StructField("nilai_m", DecimalType(38, 6)), StructField("records", LongType())])


def mart_rows(inv: DataFrame) -> DataFrame:
    """Sum and row count per combination of the six dimensions (partial aggregation, one shuffle)."""
    return (inv.groupBy(*KEYS).agg(_summed(F.col("nilai_m")), F.count(F.lit(1)).alias("records")).select(*MART.names))


def _summed(amount) -> F.Column:
    """Exact sum; a combination whose amounts are all null has 0."""
    return F.coalesce(F.sum(amount.cast("decimal(38,6)")), F.lit(0)).cast("decimal(38,6)").alias("nilai_m")


def refresh_mart(spark: SparkSession, inv: DataFrame, mart_path: str, months: list | None = None) -> None:
    """Recompute the mart of ``months`` (all of them by default) and commit it.

    A month that has no rows left loses its partition."""
    if months is None or read_pointer(spark, mart_path) is None:
        write_version(mart_rows(inv), mart_path, "report_month")
        return
    named = [m for m in months if m is not None]
    touched = F.col("report_month").isin(named) if named else F.lit(False)
    if None in months:
        touched = touched | F.col("report_month").isNull()
    write_version(mart_rows(inv.where(touched)), mart_path, "report_month", replace=list(months))


def signed_mart(spark: SparkSession, table_path: str, start: int, end: int) -> DataFrame:
    """What the commits after version ``start`` of the invoice table up to ``end`` add to its mart (may be negative)."""
    rows = signed_changes(spark, table_path, start, end, list(INVOICE_KEY), schemas.INVOICE)
    return rows.groupBy(*KEYS).agg(_summed(F.col("nilai_m") * F.col("sign")), F.sum("sign").cast("long").alias("records")
                                   ).select(*MART.names)


def _seen(spark: SparkSession, table_path: str, path: str) -> tuple[int, int | None, int]:
    """(newest version of the table, the one that ``path`` stands for if it can be followed, version of ``path``)."""
    kept, own = versions(spark, table_path), read_pointer(spark, path)
    seen = own["facts"].get("source_version") if own else None
    newest = kept[-1] if kept else 0
    if seen is not None and seen != newest and not {seen, *range(seen + 1, newest + 1)} <= set(kept):
        seen = None   # versions between have expired
    return newest, seen, own["version"] if own else 0


def maintain_mart(spark: SparkSession, table_path: str, mart_path: str) -> None:
    """Bring the mart of a stored invoice table to the table's newest version.

    The first time, or where versions between have expired, it is computed
    anew. Raises if another writer commits the mart meanwhile."""
    newest, seen, own = _seen(spark, table_path, mart_path)
    facts = {"source_version": newest}
    if seen is None:
        rows = mart_rows(read_current(spark, table_path, schemas.INVOICE, version=newest or None))
        write_version(rows, mart_path, "report_month", operation="compute", facts=facts, expected=own)
    elif seen != newest:
        delta = signed_mart(spark, table_path, seen, newest)
        months = [r[0] for r in delta.select("report_month").distinct().collect()]
        old = read_current(spark, mart_path, MART, only=months)
        rows = (old.unionByName(delta).groupBy(*KEYS).agg(_summed(F.col("nilai_m")), F.sum("records").alias("records"))
                .where("records <> 0").select(*MART.names))
        write_version(rows, mart_path, "report_month", months, "maintain", facts, expected=own)


def maintain_cube(spark: SparkSession, table_path: str, cube_path: str) -> DataFrame:
    """Bring the stored filter cube of a stored invoice table to the table's newest version; the cube."""
    newest, seen, own = _seen(spark, table_path, cube_path)
    facts = {"source_version": newest}
    if seen is None:
        rows = cube_sums(read_current(spark, table_path, schemas.INVOICE, version=newest or None))
        write_version(rows, cube_path, operation="compute", facts=facts, expected=own)
    elif seen != newest:
        now = read_current(spark, cube_path)
        sums = [F.sum(n).cast("decimal(38,6)").alias(n) for n, _ in SUMS] + [F.sum("n").alias("n")]
        rows = (now.unionByName(cube_sums(signed_mart(spark, table_path, seen, newest))).groupBy("level", *DIMS).agg(*sums)
                .where("n <> 0"))
        write_version(rows.select(*now.columns), cube_path, operation="maintain", facts=facts, expected=own)
    return cube_rows(read_current(spark, cube_path))


def read_mart(spark: SparkSession, mart_path: str) -> DataFrame:
    """The whole mart; operators that sum ``nilai_m`` take it in place of the fact table."""
    return read_current(spark, mart_path, MART)


def mart_kpi(mart: DataFrame, month: str | None = None, segment: str | None = None, region: str | None = None) -> DataFrame:
    """KPI row for one filter triple, from the mart."""
    f = filter_invoices(mart, month, segment, region)
    total = lambda cond=None: money(F.coalesce(
        F.sum("nilai_m") if cond is None else F.sum(F.when(cond, F.col("nilai_m"))), F.lit(0)))
    status = lambda v: F.col("status_tagih") == F.lit(v)
    return f.agg(total().alias("total_ar_m"), total(status(vocab.LAYAK)).alias("layak_m"),
                 total(status(vocab.TIDAK_LAYAK)).alias("tidak_layak_m"), total(status(vocab.BERMASALAH)).alias("bermasalah_m"),
                 F.coalesce(F.sum("records"), F.lit(0)).cast("bigint").alias("n"))
