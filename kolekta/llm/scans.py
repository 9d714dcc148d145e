"""Running values over sorted rows, and sums along linked lists, for tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import Stored, fresh, stored

#: Elements of a linked list that one task contracts at once.
BLOCK = 1 << 20
#: Elements of a contracted list that one task sums to the end.
LAST = 1 << 17
#: A contraction that leaves more than this share of a list is followed by a random one.
SLOW = 0.6


def running(df: DataFrame, key: str | None, order: list[str], sums=(), xors=(), lag: str | None = None) -> DataFrame:
    """``df`` with ``run_x`` for each x of ``sums`` and ``xors`` (long columns,
    never null): the sum or exclusive-or over the rows of the same ``key`` up to
    this row by ``order``; with ``lag``, ``lag_x`` of the row before (null at the first).

    Rows are sorted by range, so a key with any share of the rows is dealt over
    many tasks. Each task runs over its own rows; the last values of each task,
    one row a task, are then carried over to the tasks that go on with its key.
    Without ``key`` all rows are one key. Ties of ``order`` come in any order.
    ``df`` is read twice; store it first if it is costly.
    """
    lanes, columns = [*sums, *xors], df.columns
    made = [f"run_{c}" for c in lanes] + ([f"lag_{lag}"] if lag else [])
    by = ([key] if key else []) + order
    part_, at_ = fresh(columns, "part"), fresh(columns, "at")
    schema = df.selectExpr("*", *(f"0L as {c}" for c in made), f"0 as {part_}", f"0L as {at_}").schema
    for f in schema.fields[len(columns):]:
        f.nullable = True
    n_sums, key_at = len(sums), columns.index(key) if key else None
    lane_at, lag_at = [columns.index(c) for c in lanes], columns.index(lag) if lag else None

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part, rows, last_key, carry, last = TaskContext.get().partitionId(), 0, None, [0] * len(lane_at), None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = b.column(key_at).to_numpy() if key_at is not None else np.zeros(n, np.int64)
            start = np.ones(n, bool)
            start[1:] = k[1:] != k[:-1]
            start[0] = last_key is None or last_key != k[0]
            head = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            out = []
            for i, at in enumerate(lane_at):
                v = b.column(at).to_numpy()
                if i < n_sums:
                    total = np.cumsum(v)
                    out.append(total - np.where(head >= 0, (total - v)[head], -carry[i]))
                else:
                    total = np.bitwise_xor.accumulate(v)
                    out.append(total ^ np.where(head >= 0, (total ^ v)[head], carry[i]))
            carry, last_key = [x[-1] for x in out], k[-1]
            arrays = [pa.array(x, pa.int64()) for x in out]
            if lag_at is not None:
                v = b.column(lag_at).to_numpy()
                arrays.append(pa.array(np.concatenate([[last or 0], v[:-1]]), pa.int64(), mask=start))
                last = v[-1]
            arrays += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n))]
            rows += n
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], schema.names)

    local = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), "runs")
    ends = local.groupBy(F.col(part_).alias("part")).agg(
        *([F.min(key).alias("first"), F.max(key).alias("last")] if key else [F.lit(0).alias("first"), F.lit(0).alias("last")]),
        *(F.max_by(f"run_{c}", at_).alias(c) for c in lanes), *([F.max_by(lag, at_).alias("before")] if lag else []))
    carried, now = [], None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row a task
        values = [r[c] for c in lanes]
        if now and now[0] == r["first"]:
            carried.append((r["part"], r["first"], *now[1], now[2]))
            if r["first"] == r["last"]:
                values = [v + w if i < n_sums else v ^ w for i, (v, w) in enumerate(zip(values, now[1]))]
        now = (r["last"], values, r["before"] if lag else None)
    names = [fresh(schema.names, f"carried_{i}") for i in range(len(lanes))]
    p, k, before = (fresh(schema.names, f"carried_{c}") for c in ("part", "key", "before"))
    table = df.sparkSession.createDataFrame(
        carried, f"{p} int, {k} long, " + "".join(f"{c} long, " for c in names) + f"{before} long")
    same = (F.col(part_) == F.col(p)) & ((F.col(key) == F.col(k)) if key else F.lit(True))
    joined = local.join(F.broadcast(table), same, "left")  # bounded by the number of tasks
    none = F.lit(0).cast("long")
    fixed = [(F.col(f"run_{c}") + F.coalesce(x, none) if i < n_sums else F.col(f"run_{c}").bitwiseXOR(F.coalesce(x, none)))
             .alias(f"run_{c}") for i, (c, x) in enumerate(zip(lanes, names))]
    if lag:
        fixed.append(F.when(F.col(at_) == 0, F.col(before)).otherwise(F.col(f"lag_{lag}")).alias(f"lag_{lag}"))
    return joined.select(*columns, *fixed)


def _contract(part: DataFrame, weights: list[str]) -> DataFrame:
    """(arc, after, *weights, head): within each partition, for every element
    the sums from it to the end of its chain there, and the element of another
    partition that follows; heads have no element before them there."""
    names = ["arc", "after", *weights, "head"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        order = np.argsort(t.column(0).to_numpy())
        arc = t.column(0).to_numpy()[order]
        succ = t.column(1).fill_null(-1).to_numpy()[order]
        w = [t.column(2 + i).to_numpy()[order] for i in range(len(weights))]
        at = np.minimum(np.searchsorted(arc, succ), len(arc) - 1)
        here = arc[at] == succ
        own = np.arange(len(arc))
        jump = np.where(here, at, own)
        sums = [np.where(here, x, 0) for x in w]
        for _ in range(64):
            on = jump[jump]
            if np.array_equal(on, jump):
                break
            sums, jump = [x + x[jump] for x in sums], on
        if here[jump].any():
            raise ValueError("the list has a circle")
        head = np.ones(len(arc), bool)
        head[at[here]] = False
        after = succ[jump]
        yield pa.RecordBatch.from_arrays(
            [pa.array(arc), pa.array(after, mask=after < 0), *(pa.array(x + y[jump]) for x, y in zip(sums, w)),
             pa.array(head)], names)

    return part.mapInArrow(run, "arc long, after long, " + "".join(f"{w} long, " for w in weights) + "head boolean")


def _mate(now: DataFrame, weights: list[str], round_: int) -> tuple[DataFrame, DataFrame]:
    """(shorter list, elements taken out): an element whose coin fell on 0 is
    taken out when that of the one before fell on 1, which takes over its sums and link."""
    def coin(c):
        return F.pmod(F.xxhash64(F.lit(round_), c), F.lit(2))

    before = now.where("succ is not null").select(F.col("succ").alias("arc"), F.col("arc").alias("pred"))
    out = now.join(before, "arc").where((coin(F.col("arc")) == 0) & (coin(F.col("pred")) == 1)).drop("pred")
    out = stored(out, "taken")
    rest = now.join(out.select("arc"), "arc", "left_anti").alias("a")
    b = out.alias("b")
    kept = rest.join(b, F.col("a.succ") == F.col("b.arc"), "left").select(
        "a.arc", F.when(F.col("b.arc").isNull(), F.col("a.succ")).otherwise(F.col("b.succ")).alias("succ"),
        *((F.col(f"a.{w}") + F.coalesce(F.col(f"b.{w}"), F.lit(0).cast("long"))).alias(w) for w in weights))
    return kept, out.withColumnRenamed("succ", "after")


def suffix_sums(links: DataFrame, weights: list[str]) -> DataFrame:
    """(arc, *weights): for each element of the lists ``links(arc, succ,
    *weights)``, all long, the sums from it to the end of its list.

    Ends have a null ``succ``; every element has at most one before it.
    Elements near in number are dealt to one task, which contracts their
    chains to heads; the heads form a shorter list, and so on until it fits
    one task of LAST elements. Where numbers say little about the order, so
    that chains hardly shrink, a round of random mating takes out about a
    quarter of the elements. The sums then go back the way they came.
    """
    now, levels, round_ = links.select("arc", "succ", *weights), [], 0
    now = Stored(now, "list").df
    n = now.count()
    while n > LAST:
        round_ += 1
        level = Stored(_contract(now.repartitionByRange(max(2, -(-n // BLOCK)), "arc"), weights), "contracted").df
        levels.append(level.where("not head").drop("head"))
        now, before = level.where("head").select("arc", F.col("after").alias("succ"), *weights), n
        n = now.count()
        if n > LAST and n > SLOW * before:
            now, taken = _mate(now, weights, round_)
            levels.append(taken)
            now = Stored(now, "list").df
            n = now.count()
    known = _contract(now.coalesce(1), weights).select("arc", *weights)  # LAST elements at most
    none = F.lit(0).cast("long")
    for level in reversed(levels):
        ends = known.select(F.col("arc").alias("after"), *(F.col(w).alias(f"_{w}") for w in weights))
        known = known.unionByName(level.join(ends, "after", "left").select(
            "arc", *((F.col(w) + F.coalesce(f"_{w}", none)).alias(w) for w in weights)))
        known = stored(known, "sums")
    return known


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
