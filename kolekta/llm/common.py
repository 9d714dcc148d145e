"""Shared helpers of the text operators: byte tokens, Arrow columns in tasks,
intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolekta.session import scratch_path

#: Bytes of text that a task works on at once, and those whose columns it makes at once.
BLOCK_BYTES, COLUMN_BYTES = 4 << 20, 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES):
    """(first, last) ranges of ``texts`` of about ``most`` bytes, one text at least."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def text_blocks(column, most: int = COLUMN_BYTES):
    """(first, last, texts) of ranges of an Arrow string column of about ``most`` bytes, one text at
    least; only the texts of one range are held apart from the column."""
    import pyarrow as pa
    import pyarrow.compute as pc
    column = column.cast(pa.binary())
    first, size = 0, 0
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i + 1 == len(sizes):
            yield first, i + 1, byte_texts(column.slice(first, i + 1 - first))
            first, size = i + 1, 0


def lower_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes with A-Z in lower case
    (bytes methods know ASCII only, so other letters stay as they are)."""
    return text.lower().split()


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; the fold of a row."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(modulus)


_kept: list = []


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of this job through the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster's clean-up
            return


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint root, removed when the job ends."""
    path = scratch_path(spark, name)
    _kept.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
    _kept[:] = [x for x in _kept if x[1] != path]


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within it, ``key`` of the session's configuration is ``value``."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Stored:
    """A DataFrame written once to the shared folder and read back, so that
    what follows neither recomputes it nor depends on an executor's disk."""

    def __init__(self, df: DataFrame, name: str, row_group: int | None = None, clean: bool = False, compression: str = "snappy"):
        """``row_group``: bytes that a reader takes at once, for tables of large values. ``clean``: the shuffle
        files of the write go when it ends, not when the driver happens to collect its garbage."""
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession, name)
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true") if clean else contextlib.nullcontext():
            write = df.write.option("compression", compression)
            (write.option("parquet.block.size", row_group) if row_group else write).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_folder(self.spark, self.path)


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    return Stored(df, name, row_group).df


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with underscores until no column has it (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text_columns(docs: DataFrame, added: dict[str, str], compute, text: str = "text") -> DataFrame:
    """``docs`` with more columns (name: Spark type) that tasks compute from its text.

    ``compute(texts)`` gets UTF-8 texts of a block (null: empty) and returns an
    array or list for each added column. All other columns pass through. The
    workers outlive the task, so they give back what it took.
    """
    from pyspark.sql.types import StructType
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in added.items())).fields])
    at, names = docs.columns.index(text), [*docs.columns, *added]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i, k, texts in text_blocks(b.column(at)):
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(i, k - i).columns, *(pa.array(x) for x in compute(texts))], names)
        give_back()

    return docs.mapInArrow(run, schema)


def worker_state(key: str, make):
    """``make()``, kept under ``key`` for as long as this Python worker lives,
    so that later tasks of the worker start with it."""
    import sys
    import types
    held = sys.modules.setdefault("kolekta_worker_state", types.ModuleType("kolekta_worker_state"))
    if not hasattr(held, key):
        setattr(held, key, make())
    return getattr(held, key)


def arrow_bytes(spark: SparkSession, most: int):
    """Within it, jobs pass ``most`` bytes at a time to Python (a row at least): for rows of some
    megabytes, several of which a worker would else hold at once."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def give_back() -> None:
    """Return this Python worker's freed memory to the system: workers live on
    between tasks, and an executor's memory is shared by all of them."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc has it
    if trim:
        trim(0)


#: ASCII bytes that are no letter or digit become spaces; A-Z become lower case.
PLAIN = bytes((c | 32) if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text without ASCII punctuation, A-Z in lower case."""
    return text.translate(PLAIN).split()


def sample_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``ids(doc_id, ...)``, those of the smallest hash of doc_id; fit to broadcast."""
    return F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def key_slices(batches, keys: int):
    """(key, record batch) for the rows of one key within one batch, in order.

    The key is the first ``keys`` columns (integers, never null); rows come sorted by them."""
    import numpy as np
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield tuple(int(c[a]) for c in cols), b.slice(a, z - a)


def key_runs(batches, keys: int):
    """(key, [record batches]) for all rows of each key; what ``key_slices`` gives, put together."""
    import itertools
    for key, parts in itertools.groupby(key_slices(batches, keys), lambda x: x[0]):
        yield key, [p for _, p in parts]
