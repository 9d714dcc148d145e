"""Versions of a stored table: a log of pointer files that name folders of rows.

* ``<table>/v=NNNNNN-id/[part=value/]*.parquet``: the rows that one write produced;
* ``<table>/_feeds/id/*.parquet``: the rows that a write took out and put in, where it kept them;
* ``<table>/_pointers/NNNNNN.json``: a version, as the list of folders that
  make it up (one for each partition value, or a single one), with its
  schema, its time, its operation and facts about the load.

A write pins the version that it read. It puts its rows into a new folder and
commits by creating the next pointer, which fails if that is there already.
Then somebody else committed first: if they changed other partitions, the
write commits on top of theirs, else ``Conflict`` says that the job must run
again from the newer version. Nothing that a reader can see is ever changed,
so there is no moment in between, and a failed job leaves no trace that is read.
"""

from __future__ import annotations

import datetime as _dt
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType,
                               StringType, StructField, StructType)

VERSION_PREFIX = "v="
_POINTERS, _FEEDS = "_pointers", "_feeds"
_NULL = "__HIVE_DEFAULT_PARTITION__"


class ConcurrentWriteError(RuntimeError):
    """Another writer was first, too often or against what the caller expected."""


class Conflict(ConcurrentWriteError):
    """Another writer changed what this job read; ``now`` is the pointer to start from."""

    def __init__(self, message: str, now: dict):
        super().__init__(message)
        self.now = now


class SchemaError(ValueError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def remove(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries (a driver-side listing of a few names)."""
    fs, p, _ = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, table_dir: str) -> list[int]:
    """Committed versions, oldest first."""
    names = _names(spark, f"{table_dir.rstrip('/')}/{_POINTERS}")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_pointer(spark: SparkSession, table_dir: str, version: int | None = None) -> dict | None:
    """The pointer of a version (the newest by default); None if nothing is committed.

    {"version", "parent", "committed_at" (ms), "operation", "facts", "schema",
    "partition_by", "folders": [[value, folder], ...], "whole": the one folder
    that holds all of the version, if one does, "feed": its kept changes,
    "state": entries that every version takes over from the one before, unless it sets them}"""
    if version is None:
        found = versions(spark, table_dir)
        if not found:
            return None
        version = found[-1]
    fs, p, jvm = _fs(spark, f"{table_dir.rstrip('/')}/{_POINTERS}/{version:06d}.json")
    if not fs.exists(p):
        raise ValueError(f"{table_dir} has no version {version}")
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Create the file ``path`` with ``data`` at once, if it is not there; whether this call did.

    A finished file takes its name by a rename that refuses to replace, or, on
    a local disk, where a rename replaces, by a hard link."""
    fs, final, jvm = _fs(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray(data))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(x.toUri().getPath()).toPath() for x in (final, temporary)))
            return True
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            final.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, final, options)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(temporary, False)


# --- schemas -----------------------------------------------------------------

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
#: Decimal digits that the whole-number types need.
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 20}


def wider(a: DataType, b: DataType) -> DataType | None:
    """The one of two types that holds all values of both, or None."""
    if a == b:
        return a
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        made = DecimalType(digits, scale) if digits <= 38 else None
        return made if made in (a, b) else None
    if {type(a), type(b)} == {FloatType, DoubleType}:
        return DoubleType()
    for whole, other in ((a, b), (b, a)):
        if isinstance(whole, _WHOLE) and isinstance(other, DecimalType):
            return other if other.precision - other.scale >= _DIGITS[type(whole)] else None
    return None


def evolved(old: StructType | None, new: StructType) -> StructType:
    """The schema of a table of schema ``old`` after rows of ``new`` came in:
    added columns go last, a type may become wider. Narrower or unrelated types raise;
    so rows that are still there stay readable."""
    if old is None:
        return new
    fields, coming = [], {f.name.lower(): f for f in new.fields}
    for f in old.fields:
        g = coming.pop(f.name.lower(), None)
        if g is not None and wider(f.dataType, g.dataType) != g.dataType:
            raise SchemaError(f"column {f.name}: {f.dataType.simpleString()} does not fit {g.dataType.simpleString()}")
        fields.append(StructField(f.name, g.dataType if g is not None else f.dataType, True))
    return StructType(fields + [StructField(f.name, f.dataType, True) for f in coming.values()])


def schema_of(pointer: dict) -> StructType:
    return StructType.fromJson(pointer["schema"])


# --- writing -------------------------------------------------------------------

def rebalanced(df: DataFrame, partition_by: str) -> DataFrame:
    """Cluster rows by the partition column before a partitioned write, so each
    task writes few folders; AQE sizes the tasks and splits a hot month."""
    return df.hint("rebalance", partition_by)


def stage(df: DataFrame, table_dir: str, pinned: dict | None, partition_by: str | None, dealt: bool = False,
          row_group: int | None = None) -> dict:
    """Write ``df`` to a new folder that no pointer names yet: {"folders", "name", "schema"}.

    ``dealt``: its rows are dealt and sorted as they are to lie; ``row_group``: bytes of a row group."""
    spark, root = df.sparkSession, table_dir.rstrip("/")
    name = f"{VERSION_PREFIX}{(pinned['version'] if pinned else 0) + 1:06d}-{uuid.uuid4().hex[:8]}"
    path = f"{root}/{name}"
    writer = (rebalanced(df, partition_by) if partition_by and not dealt else df).write.mode("errorifexists")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    folders = [[None, name]]
    if partition_by:
        fs, p, jvm = _fs(spark, path)
        unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        folders = [[None if n.endswith(f"={_NULL}") else unescape(n.split("=", 1)[1]), f"{name}/{n}"]
                   for n in names if n.startswith(f"{partition_by}=")]
    return {"folders": folders, "name": name, "schema": df.schema}


def changed_values(before: dict | None, after: dict | None) -> set:
    """Partition values whose folders differ between two versions."""
    a, b = ({(v, f) for v, f in (p or {"folders": []})["folders"]} for p in (before, after))
    return {v for v, _ in a ^ b}


def publish(spark: SparkSession, table_dir: str, pinned: dict | None, made: dict, partition_by: str | None,
            replace: list | None = None, operation: str = "write", facts: dict | None = None,
            feed: str | None = None, exact: bool = False, state: dict | None = None) -> dict:
    """Commit the staged rows ``made`` on top of ``pinned``; the new pointer.

    ``replace``: the partition values whose content they are; without it they
    are the whole table. If other versions came since ``pinned``, a change of
    other partitions and a whole table go on top of them; a change of the same
    ones raises ``Conflict``, as does any with ``exact``."""
    root, now = table_dir.rstrip("/"), pinned
    while True:
        folders, whole = made["folders"], made["name"]
        if partition_by and replace is not None and now:
            gone = set(replace) | {v for v, _ in folders}
            kept = [x for x in now["folders"] if x[0] not in gone]
            folders, whole = folders + kept, None if kept else whole
        pointer = {
            "version": (now["version"] if now else 0) + 1, "parent": now["version"] if now else None,
            "committed_at": max(int(time.time() * 1000), (now["committed_at"] if now else 0) + 1),
            "operation": operation, "facts": facts or {},
            "schema": evolved(schema_of(now) if now else None, made["schema"]).jsonValue(),
            "partition_by": partition_by, "folders": sorted(folders, key=str), "whole": whole, "feed": feed,
            "state": {**(now["state"] if now else {}), **(state or {})}}
        if put_new(spark, f"{root}/{_POINTERS}/{pointer['version']:06d}.json", json.dumps(pointer).encode()):
            return pointer
        latest = read_pointer(spark, root)
        touched = {v for v, _ in made["folders"]} | set(replace or ())
        if exact or (replace is not None and (not partition_by or changed_values(now, latest) & touched)):
            raise Conflict(f"{root}: version {pointer['version']} was committed by another writer", latest)
        now = latest


def write_version(df: DataFrame, table_dir: str, partition_by: str | None = None, replace: list | None = None,
                  operation: str = "refresh", facts: dict | None = None, expected: int | None = None) -> str:
    """Write ``df`` and commit it as the next version; the path of the folder written.

    ``replace`` lists the partition values whose content ``df`` is; all other
    partitions stay. Without it ``df`` is the whole table. ``expected``: the
    version that ``df`` was made from; raises if it is not the newest any more."""
    spark, root = df.sparkSession, table_dir.rstrip("/")
    pinned = read_pointer(spark, root)
    if expected is not None and (pinned["version"] if pinned else 0) != expected:
        raise ConcurrentWriteError(f"{root} is at version {pinned['version'] if pinned else 0}, not {expected}")
    if pinned:
        evolved(schema_of(pinned), df.schema)   # before the job, not after it
    made = stage(df, root, pinned, partition_by)
    publish(spark, root, pinned, made, partition_by, replace, operation, facts, exact=expected is not None)
    return f"{root}/{made['name']}"


# --- reading -------------------------------------------------------------------

def version_as_of(spark: SparkSession, table_dir: str, moment: _dt.datetime | int) -> int | None:
    """The version that was the newest at ``moment`` (a time, or milliseconds); None before the first."""
    ms = moment if isinstance(moment, int) else int(moment.timestamp() * 1000)
    before = None
    for v in versions(spark, table_dir):   # times rise with versions
        if read_pointer(spark, table_dir, v)["committed_at"] > ms:
            break
        before = v
    return before


def read_version(spark: SparkSession, table_dir: str, pointer: dict | None, schema: StructType | None = None,
                 only=None) -> DataFrame:
    """The rows of a pinned version (of partitioned tables, ``only`` some partition values).

    Its folders may have been written under older schemas: missing columns are
    null, narrower numbers are widened. ``schema`` asks for other columns."""
    root = table_dir.rstrip("/")
    if schema is None:
        if pointer is None:
            raise ValueError(f"no rows at {table_dir}, and no schema given")
        schema = schema_of(pointer)
    paths = [f"{root}/{f}" for v, f in (pointer or {"folders": []})["folders"] if only is None or v in only]
    if paths and only is None and pointer["whole"]:   # one folder to list, not one for each value
        paths = [f"{root}/{pointer['whole']}"]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", root).schema(schema).parquet(*paths).select(*schema.names)


def read_current(spark: SparkSession, table_dir: str, schema: StructType | None = None, only: list | None = None,
                 version: int | None = None, as_of: _dt.datetime | int | None = None) -> DataFrame:
    """The newest version, or a given one, or the one of a moment.

    With ``schema`` a table not yet written is empty; without it that raises."""
    if as_of is not None:
        version = version_as_of(spark, table_dir, as_of)
        if version is None:
            if schema is None:
                raise ValueError(f"{table_dir} was not written yet at {as_of}")
            return spark.createDataFrame([], schema)
    return read_version(spark, table_dir, read_pointer(spark, table_dir, version), schema, only)


def history(spark: SparkSession, table_dir: str) -> DataFrame:
    """(version, parent, committed_at, operation, facts): the versions that are kept, oldest first."""
    rows = []
    for v in versions(spark, table_dir):
        p = read_pointer(spark, table_dir, v)
        rows.append((v, p["parent"], p["committed_at"], p["operation"], json.dumps(p["facts"], sort_keys=True)))
    return spark.createDataFrame(rows, "version int, parent int, ms long, operation string, facts string").select(
        "version", "parent", F.timestamp_millis("ms").alias("committed_at"), "operation", "facts")


def expire(spark: SparkSession, table_dir: str, keep: int = 2, since: _dt.datetime | int | None = None) -> None:
    """Delete pointers but the newest ``keep``, and folders that no kept pointer names.

    ``since`` also keeps what answers questions about that moment and every later one. Run it when
    no write is under way: a folder is written before its pointer."""
    root = table_dir.rstrip("/")
    found = versions(spark, root)
    first = found[-keep:][0] if found else 0
    if since is not None:
        first = min(first, version_as_of(spark, root, since) or 0)
    kept, old = [v for v in found if v >= first], [v for v in found if v < first]
    pointers = [read_pointer(spark, root, v) for v in kept]
    used, feeds = {f for p in pointers for _, f in p["folders"]}, {p["feed"] for p in pointers}
    fs, p, jvm = _fs(spark, root)
    for v in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{_POINTERS}/{v:06d}.json"), False)
    for name in _names(spark, f"{root}/{_FEEDS}"):
        if f"{_FEEDS}/{name}" not in feeds:
            remove(spark, f"{root}/{_FEEDS}/{name}")
    for name in _names(spark, root):
        if not name.startswith(VERSION_PREFIX):
            continue
        here = {u for u in used if u.split("/")[0] == name}
        if not here:
            remove(spark, f"{root}/{name}")
        elif name not in here:
            for s in _names(spark, f"{root}/{name}"):
                if "=" in s and f"{name}/{s}" not in here:
                    remove(spark, f"{root}/{name}/{s}")


# --- changes between versions ------------------------------------------------------

CHANGE_TYPES = ("insert", "delete", "update_before", "update_after")


def difference(old: DataFrame, new: DataFrame, pk: list[str]) -> DataFrame:
    """(change_type, *columns): what turns ``old`` into ``new``, by key; equal
    rows are left out, a changed one comes with its before and after images."""
    names = new.columns
    a = old.select(F.struct(*[F.col(c) for c in names]).alias("before"), *[F.col(c).alias(f"_a_{c}") for c in pk])
    b = new.select(F.struct(*[F.col(c) for c in names]).alias("after"), *[F.col(c).alias(f"_b_{c}") for c in pk])
    same = F.lit(True)
    for c in pk:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    both = a.join(b, same, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return both.selectExpr(
        "inline(filter(array("
        "struct(if(after is null, 'delete', 'update_before') as change_type, before as image),"
        "struct(if(before is null, 'insert', 'update_after') as change_type, after as image)),"
        "x -> x.image is not null))").select("change_type", *[F.col("image")[c].alias(c) for c in names])


def table_changes(spark: SparkSession, table_dir: str, start: int, end: int | None, pk: list[str],
                  schema: StructType | None = None) -> DataFrame:
    """What turns version ``start`` (0: the empty table) into version ``end``
    (the newest by default). Only partitions whose folders differ are read."""
    after = read_pointer(spark, table_dir, end)
    before = read_pointer(spark, table_dir, start) if start else None
    schema = schema or schema_of(after)
    values = changed_values(before, after)
    return difference(read_version(spark, table_dir, before, schema, values),
                      read_version(spark, table_dir, after, schema, values), pk)


def apply_changes(table: DataFrame, changes: DataFrame, pk: list[str]) -> DataFrame:
    """``table`` after the ``difference`` rows ``changes``."""
    out = changes.where("change_type in ('delete', 'update_before')").select(*[F.col(c).alias(f"_{c}") for c in pk])
    gone = F.lit(True)
    for c in pk:
        gone = gone & table[c].eqNullSafe(out[f"_{c}"])
    return table.join(out, gone, "left_anti").unionByName(
        changes.where("change_type in ('insert', 'update_after')").select(*table.columns))


def keep_feed(rows: DataFrame, table_dir: str) -> str:
    """Write the changes of a commit beside the table; the folder's name for the pointer."""
    name = f"{_FEEDS}/{uuid.uuid4().hex}"
    rows.write.parquet(f"{table_dir.rstrip('/')}/{name}")
    return name


def signed_changes(spark: SparkSession, table_dir: str, start: int, end: int, pk: list[str],
                   schema: StructType) -> DataFrame:
    """(sign, *columns) of the commits after ``start`` up to ``end``: -1 for rows
    taken out, 1 for rows put in. Their sums turn sums over the one version
    into sums over the other. Kept feeds are read where every commit has one,
    which reads no table rows; else the two versions are compared."""
    feeds = [read_pointer(spark, table_dir, v)["feed"] for v in range(start + 1, end + 1)]
    if all(feeds) and feeds:
        kind = StructType([StructField("change_type", StringType()), *schema.fields])
        rows = spark.read.schema(kind).parquet(*[f"{table_dir.rstrip('/')}/{f}" for f in feeds])
    else:
        rows = table_changes(spark, table_dir, start, end, pk, schema)
    return rows.select(F.expr("if(change_type in ('insert', 'update_after'), 1, -1)").alias("sign"), *schema.names)
