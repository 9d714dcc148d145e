"""What a database's indexes were for, as stored tables: rows clustered for
filters, a trigram index for the search box, a rank index for deep pages."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import sql_str
from kolekta.operators.filters import search_invoices, search_sql
from kolekta.plans.versions import publish, read_current, read_pointer, stage

# Functions that run in tasks are pickled by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- clustering -------------------------------------------------------------------

CLUSTER_COLUMNS = ("pengelolaan", "region", "status_tagih")
#: Bits of a column's rank in the curve, so at most 2**8 ranks tell its values apart.
CURVE_BITS = 8
#: Bytes of a row group of a clustered table: what a filter skips or reads.
ROW_GROUP = 1 << 20


def curve_key(df: DataFrame, columns: tuple[str, ...] = CLUSTER_COLUMNS) -> F.Column:
    """Place of a row on a Z-order curve over the ranks of its values.

    The ranks come from the sorted distinct values of each column, which must be
    a vocabulary (segments, regions, statuses); null ranks first, and values
    beyond the bits of the curve share ranks with their neighbours."""
    key = F.lit(0).cast("long")
    for at, c in enumerate(columns):
        values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(1 << 16).collect()]
        shift = max(0, len(values).bit_length() - CURVE_BITS)
        ranks = ", ".join(f"{sql_str(str(v))}, {(k + 1) >> shift}" for k, v in enumerate(values))
        rank = f"coalesce(try_element_at(map({ranks}), cast(`{c}` as string)), 0)" if values else "0"
        for bit in range(CURVE_BITS):
            key = key.bitwiseOR(F.expr(f"shiftleft(cast(shiftright({rank}, {bit}) & 1 as bigint), {bit * len(columns) + at})"))
    return key


def write_clustered(df: DataFrame, table_dir: str, partition_by: str = "report_month",
                    columns: tuple[str, ...] = CLUSTER_COLUMNS, tasks: int | None = None) -> str:
    """Commit ``df`` as the next version with the rows of each partition in curve order.

    Rows are dealt by ranges of (partition, curve place, a hash), so a hot
    month is several sorted files; Parquet's own statistics then let a filter
    on any of the columns skip most row groups. Later keyed changes of a
    month rewrite it unsorted until the next clustered write."""
    spark = df.sparkSession
    z = curve_key(df, columns)
    dealt = df.withColumns({"_z": z, "_h": F.xxhash64(df.columns[0])})
    keys = [partition_by, "_z", "_h"]
    rows = dealt.repartitionByRange(tasks, *keys) if tasks else dealt.repartitionByRange(*keys)
    rows = rows.sortWithinPartitions(*keys).drop("_z", "_h")
    pinned = read_pointer(spark, table_dir)
    made = stage(rows, table_dir, pinned, partition_by, dealt=True, row_group=ROW_GROUP)
    publish(spark, table_dir, pinned, made, partition_by, operation="cluster")
    return f"{table_dir.rstrip('/')}/{made['name']}"


# --- search -----------------------------------------------------------------------

GRAM = 3
#: Rows of a segment of the postings; a row's place in it is a short.
SEGMENT = 1 << 14
#: Shuffled bytes of rows that a task makes postings of; their trigrams are far more than they are.
TASK_BYTES = 8 << 20


def _segment(columns: list):
    """(grams, bounds, places): the distinct trigrams of some rows in code point order; the rows that hold
    ``grams[k]`` in any of ``columns`` (Arrow strings) are ``places[bounds[k]:bounds[k + 1]]``, ascending.

    Each distinct value of a column is cut once."""
    import numpy as np
    cut = []
    for c in columns:
        d = c.dictionary_encode()
        values = d.dictionary.to_pylist()
        code = np.frombuffer("".join(values).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, values), np.int64, len(values))
        n = np.maximum(size - (GRAM - 1), 0)
        first = np.cumsum(n) - n
        at = np.repeat(np.cumsum(size) - size - first, n) + np.arange(int(n.sum()))
        rows = np.flatnonzero(d.indices.is_valid().to_numpy(zero_copy_only=False))
        value = d.indices.drop_null().to_numpy()
        gram = np.zeros(len(at), np.int64)
        for k in range(GRAM):
            gram = gram << 21 | code[at + k]
        cut.append((gram, rows, n[value], first[value]))
    grams, rank = np.unique(np.concatenate([g for g, *_ in cut]), return_inverse=True)
    found, before = [], 0
    for gram, rows, n, first in cut:
        at = np.repeat(before + first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found.append(rank[at] * SEGMENT + np.repeat(rows, n))
        before += len(gram)
    found = np.sort(np.concatenate(found))   # np.unique hashes, which takes many times as long on such numbers
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
    bounds = np.searchsorted(found, np.arange(len(grams) + 1) * SEGMENT)
    letters = np.stack([grams >> 21 * (GRAM - 1 - k) & (1 << 21) - 1 for k in range(GRAM)], 1)
    letters = letters.astype("<u4").tobytes().decode("utf-32-le")
    return [letters[k:k + GRAM] for k in range(0, len(letters), GRAM)], bounds, (found % SEGMENT).astype(np.int16)


def postings(inv: DataFrame, columns: tuple[str, ...] = vocab.SEARCH_COLUMNS, key: str = "invoice_id",
             month: str = "report_month") -> DataFrame:
    """(report_month, segment, gram, places, keys): the trigrams of the searchable columns, in lower case, and the rows that hold them.

    Rows are dealt by month, and a segment is at most SEGMENT rows of one: its row of the empty gram holds
    their keys, every other row the places, within those keys, of the rows with that gram. Only the rows are
    shuffled, not their trigrams; a month of any size is several segments."""
    texts = [F.lower(F.col(c).cast("string")).alias(f"_t{k}") for k, c in enumerate(columns)]
    rows = inv.select(F.col(month).alias("report_month"), F.col(key).cast("string").alias("_key"), *texts)
    rows = rows.hint("rebalance", "report_month").sortWithinPartitions("report_month")

    def run(batches):
        import itertools

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        def made(parts, number):
            t = pa.Table.from_batches(parts).combine_chunks()
            column = [t.column(k).combine_chunks() for k in range(t.num_columns)]
            grams, bounds, places = _segment(column[2:])
            size = len(grams) + 1
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(size, t.num_rows)]), pa.int32()), column[1])
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], bounds]), pa.int32()), pa.array(places))
            return pa.RecordBatch.from_arrays(
                [pa.array([column[0][0].as_py()] * size, pa.string()), pa.array(np.full(size, number, np.int64)),
                 pa.array(["", *grams], pa.string()), held, keys], ["report_month", "segment", "gram", "places", "keys"])

        number = itertools.count(TaskContext.get().partitionId() << 32)
        waiting, n, month_ = [], 0, None
        for b in batches:
            months = b.column(0).dictionary_encode(null_encoding="encode")
            values, change = months.dictionary.to_pylist(), months.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(change[1:] != change[:-1]) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if a < z and n and values[change[a]] != month_:
                    yield made(waiting, next(number))
                    waiting, n = [], 0
                while a < z:
                    taken = min(z - a, SEGMENT - n)
                    month_ = values[change[a]]
                    waiting.append(b.slice(a, taken))
                    a, n = a + taken, n + taken
                    if n == SEGMENT:
                        yield made(waiting, next(number))
                        waiting, n = [], 0
        if n:
            yield made(waiting, next(number))

    return rows.mapInArrow(run, "report_month string, segment long, gram string, places array<short>, keys array<string>")


def build_search(inv: DataFrame, path: str, months: list | None = None) -> None:
    """Write the postings (of some months only, after a change of those), sorted by trigram within a segment."""
    spark = inv.sparkSession
    rows = inv if months is None else inv.where(F.col("report_month").isin(months))
    rows = postings(rows).sortWithinPartitions("report_month", "segment", "gram")
    pinned = read_pointer(spark, path)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, str(TASK_BYTES))
    try:
        made = stage(rows, path, pinned, "report_month", dealt=True, row_group=ROW_GROUP)
    finally:
        spark.conf.set(size, before)
    publish(spark, path, pinned, made, "report_month", months if pinned else None, "index")


def indexed_search(inv: DataFrame, path: str, q: str | None) -> DataFrame:
    """The rows that ``search_invoices`` finds, by way of the postings under ``path``.

    Rows that hold every trigram of the needle are the candidates; only they
    reach the literal check. A needle shorter than a trigram has none and is
    looked for in every row."""
    needle = (q or "").lower()
    if len(needle) < GRAM:
        return search_invoices(inv, q)
    grams = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
    held = read_current(inv.sparkSession, path).where(F.col("gram").isin(["", *grams]))
    lists = held.groupBy("report_month", "segment").agg(
        F.collect_list(F.when(F.col("gram") != "", F.col("places"))).alias("lists"),
        F.max(F.when(F.col("gram") == "", F.col("keys"))).alias("keys")).where(F.size("lists") == len(grams))
    both = "aggregate(slice(lists, 2, size(lists)), lists[0], (a, b) -> array_intersect(a, b))"
    ids = lists.select("report_month", F.explode(F.expr(f"transform({both}, i -> keys[i])")).alias("id"))
    # A key that several rows share is one candidate, and all of its rows are checked.
    candidates = ids.groupBy("report_month", "id").agg(F.count("*").alias("_hits")).select(
        F.col("report_month").alias("_month"), F.col("id").alias("_id"), "_hits")
    same = inv["invoice_id"].eqNullSafe(F.col("_id")) & inv["report_month"].eqNullSafe(F.col("_month"))
    # The check names a column of the candidates, so it stays above the join: only they reach it.
    checked = f"CASE WHEN _hits > 0 THEN {search_sql(q)} ELSE false END"
    return inv.join(candidates, same).where(F.expr(checked)).select(*inv.columns)


# --- deep pages ---------------------------------------------------------------------

def build_ranks(df: DataFrame, path: str, key: str = "invoice_id", ranges: int | None = None) -> None:
    """Write the rank index of ``df``: for ranges of the key, the rows in each and in all before.

    One sort deals the rows by key; the index has a row a range, so that
    cutting a table of any size into pages needs no more than these counts."""
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("string").alias("k"))
    dealt = keys.repartitionByRange(ranges, "k") if ranges else keys.repartitionByRange("k")
    rows = dealt.groupBy(F.spark_partition_id().alias("range")).agg(
        F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).collect()   # a row a range
    before, out = 0, []
    for r in sorted(rows, key=lambda r: r["range"]):
        out.append((r["range"], r["low"], r["high"], r["n"], before))
        before += r["n"]
    made = spark.createDataFrame(out, "range int, low string, high string, n long, before long")
    pinned = read_pointer(spark, path)
    publish(spark, path, pinned, stage(made.coalesce(1), path, pinned, None), None, operation="index")


def ranked_page(df: DataFrame, path: str, page: int = 1, size: int = vocab.PAGE_SIZE, key: str = "invoice_id",
                columns: tuple[str, ...] = vocab.DETAIL_COLUMNS) -> DataFrame:
    """The page that ``detail_page`` gives, reading only the key ranges that it touches.

    The index under ``path`` must be of the same rows (of a string key)."""
    index = read_current(df.sparkSession, path)
    skip = (page - 1) * size
    touched = index.where((F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip)).agg(
        F.min("low"), F.max("high"), F.min("before")).first()
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    low, high, before = touched
    if before is None:
        within = F.lit(False)
    elif before == 0:   # null keys come first
        within = F.col(key).isNull() if high is None else F.col(key).isNull() | (F.col(key) <= high)
    else:
        within = (F.col(key) >= low) & (F.col(key) <= high)
    rows = df.where(within)
    rows = rows.orderBy(key).offset(skip - (before or 0)).limit(size)
    return rows.select(key, *columns, F.lit(page).cast("bigint").alias("page"),
                       F.lit(max(1, -(-total // size))).cast("bigint").alias("pages"))
