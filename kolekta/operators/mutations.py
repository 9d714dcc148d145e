"""Keyed table changes, expressed as DataFrame rewrites.

Plain Parquet tables have no MERGE, so each change is a pure function
``(table, changes) -> new table``; ``kolekta.plans.tables`` writes the result
as a new version and swaps it in. Joins are on the primary key (one column or
several): AQE turns them into broadcast joins when the change set is small at
runtime (its measured size, not a guess) and keeps a sort-merge join otherwise.

A change set must be unique on the key, without null keys. ``check=True`` (the
default) makes that sure with one aggregate over the change set, run eagerly;
pass ``check=False`` only for rows that were validated already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


class DuplicateKeyError(ValueError):
    pass


def keys_of(pk: str | list | tuple) -> list[str]:
    return [pk] if isinstance(pk, str) else list(pk)


def _lower_names(df: DataFrame) -> DataFrame:
    """Names of a change set are case-insensitive; the table's columns are lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def _check_columns(table: DataFrame, changes: DataFrame, pk: list[str]) -> None:
    unknown = set(changes.columns) - set(table.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    missing = set(pk) - set(changes.columns)
    if missing:
        raise ValueError(f"missing key columns: {sorted(missing)}")


def check_unique(changes: DataFrame, pk: str | list | tuple) -> None:
    """Raise unless the change set has no null key and no key twice."""
    pk = keys_of(pk)
    missing = " OR ".join(f"{k} IS NULL" for k in pk)
    bad = changes.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n")).where(f"_n > 1 OR {missing}").limit(1).collect()
    if bad:
        raise DuplicateKeyError(f"null or repeated key {pk} in the change set: {bad[0].asDict()}")


def _value(name: str, kind: DataType, supplied, defaults: dict) -> Column:
    """A column of an inserted row: as supplied, else its default, else null."""
    value = F.col(name) if name in supplied else F.lit(defaults.get(name))
    return value.cast(kind).alias(name)


def append_rows(table: DataFrame, new: DataFrame, pk: str | list | tuple, check: bool = True,
                defaults: dict | None = None) -> DataFrame:
    """Insert rows; a column not supplied takes its default, else null. A key
    that is repeated, null or in the table already raises."""
    pk, new = keys_of(pk), _lower_names(new)
    _check_columns(table, new, pk)
    if check:
        check_unique(new, pk)
        if new.select(*pk).join(table.select(*pk), pk, "left_semi").limit(1).count():
            raise DuplicateKeyError(f"key {pk} of appended rows is in the table already")
    return table.unionByName(new.select(*[_value(f.name, f.dataType, new.columns, defaults or {})
                                          for f in table.schema.fields]))


def update_rows(table: DataFrame, changes: DataFrame, pk: str | list | tuple, cols: list[str] | None = None,
                check: bool = True) -> DataFrame:
    """Update supplied columns of matching keys; the key itself never changes,
    zero matches is fine, and a change may set a value to null (a match flag
    decides, not ``coalesce``). An empty column list is an error."""
    pk, changes = keys_of(pk), _lower_names(changes)
    _check_columns(table, changes, pk)
    cols = [c for c in (cols or changes.columns) if c not in pk]
    if not cols:
        raise ValueError("nothing to update")
    if check:
        check_unique(changes, pk)
    ch = changes.select(*pk, *[F.col(c).alias(f"_new_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = table.join(ch, pk, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = [F.when(hit, F.col(f"_new_{f.name}").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
           if f.name in cols else F.col(f.name) for f in table.schema.fields]
    return j.select(*out)


def delete_rows(table: DataFrame, keys: DataFrame, pk: str | list | tuple) -> DataFrame:
    """Remove rows whose key is in ``keys``; zero matches is fine."""
    pk = keys_of(pk)
    return table.join(_lower_names(keys).select(*pk), pk, "left_anti")


def upsert_rows(table: DataFrame, source: DataFrame, pk: str | list | tuple, check: bool = True,
                defaults: dict | None = None) -> DataFrame:
    """MERGE: matched keys take the supplied columns and keep the others; new
    keys are inserted, columns not supplied taking their default, else null.
    Upserting twice equals once."""
    pk, source = keys_of(pk), _lower_names(source)
    _check_columns(table, source, pk)
    if check:
        check_unique(source, pk)
    has_values = set(source.columns) - set(pk)
    kept = update_rows(table, source, pk, check=False) if has_values else table
    new = source.join(table.select(*pk), pk, "left_anti")
    return kept.unionByName(new.select(*[_value(f.name, f.dataType, source.columns, defaults or {})
                                         for f in table.schema.fields]))
