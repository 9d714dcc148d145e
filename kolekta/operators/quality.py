"""Cleaning and validation of incoming invoice rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kolekta import vocab
from kolekta.functions import amount_sql, is_number_sql, strip


def clean_invoices(inv: DataFrame, amount: str = "nilai_m") -> DataFrame:
    """Null amount -> 0, null text -> ''; other columns untouched."""
    cols = []
    for f in inv.schema.fields:
        c = F.col(f.name)
        if f.name == amount:
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, StringType):
            c = F.coalesce(c, F.lit(""))
        cols.append(c.alias(f.name))
    return inv.select(*cols)


def clean_file(raw: DataFrame, amount: str = "nilai_m", amount_type: str = "decimal(38,6)") -> DataFrame:
    """File cleaning before validation: unparsable amount -> 0, missing aging ->
    ``Within Due``, missing status -> collectible, id as text. A number too
    large for the amount type stays null, which validation rejects."""
    text = strip(amount)
    value = F.expr(amount_sql(amount, amount_type))
    numeric = F.coalesce(F.expr(is_number_sql(amount)), F.lit(False))
    out = raw.withColumn(amount, F.when(text.isNotNull() & numeric, value).otherwise(F.lit(0).cast(amount_type)))
    if "aging_category" in raw.columns:
        out = out.withColumn("aging_category", F.coalesce("aging_category", F.lit(vocab.CLEAN_AGING_DEFAULT)))
    if "status_tagih" in raw.columns:
        out = out.withColumn("status_tagih", F.coalesce("status_tagih", F.lit(vocab.CLEAN_STATUS_DEFAULT)))
    return out.withColumn("invoice_id", F.col("invoice_id").cast("string"))


REASONS = ("missing_id", "duplicate_id", "bad_status", "bad_amount")


def with_reasons(df: DataFrame, statuses: tuple[str, ...] = vocab.STATUSES, key: str = "invoice_id",
                 month: str = "report_month", amount: str | None = None, unit: str | None = None) -> DataFrame:
    """Input rows plus ``reasons`` (comma list of failed checks) and ``is_valid``.

    Checks: id present, id unique within its report month (and within its
    ``unit``, say a file, if that names a column), status in the allowed set, and, if ``amount`` names a column, that it is not null.
    Duplicates are found with a partially aggregated count per id and joined
    back (AQE splits a hot id on the large side) -- never a window that would
    put all copies of one id in one task."""
    ids = F.col(key)
    present = ids.isNotNull() & (F.coalesce(strip(key), F.lit("")) != F.lit(""))
    within = ([month] if month in df.columns else []) + ([unit] if unit else [])
    dups = (df.where(ids.isNotNull()).groupBy(key, *within).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") > 1).select(F.col(key).alias("_id"), *[F.col(c).alias(f"_in_{c}") for c in within],
                                             F.lit(True).alias("_dup")))
    same = (df[key] == dups["_id"])
    for c in within:
        same = same & df[c].eqNullSafe(dups[f"_in_{c}"])
    reasons = F.array_compact(F.array(
        F.when(~present, F.lit(REASONS[0])),
        F.when(F.coalesce(F.col("_dup"), F.lit(False)), F.lit(REASONS[1])),
        F.when(~F.coalesce(F.col("status_tagih").isin(*statuses), F.lit(False)), F.lit(REASONS[2])),
        F.when(F.col(amount).isNull() if amount else F.lit(False), F.lit(REASONS[3]))))
    return (df.join(dups, same, "left").withColumn("reasons", F.concat_ws(",", reasons))
              .withColumn("is_valid", F.size(reasons) == 0).drop("_dup", "_id", *[f"_in_{c}" for c in within]))


def validate(df: DataFrame, statuses: tuple[str, ...] = vocab.STATUSES, key: str = "invoice_id",
             amount: str | None = None) -> DataFrame:
    """One row per input row: (id, reasons, is_valid)."""
    return with_reasons(df, statuses, key, amount=amount).select(key, "reasons", "is_valid")


def split_valid(df: DataFrame, statuses: tuple[str, ...] = vocab.STATUSES, key: str = "invoice_id",
                amount: str | None = None, unit: str | None = None):
    """(good rows, rejected rows with reasons) -- both lazy."""
    v = with_reasons(df, statuses, key, amount=amount, unit=unit)
    return v.where("is_valid").drop("reasons", "is_valid"), v.where(~F.col("is_valid"))
