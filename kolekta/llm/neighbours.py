"""Approximate nearest neighbours: an NN-descent graph and greedy graph search.

Rows of equal vectors are one node of the graph. Nodes are dealt into blocks
by a hash of their id. The graph starts from random projection trees and is
improved in rounds: every node's neighbours, and nodes it is a neighbour of,
are compared with each other, and what beats a node's worst neighbour joins
its list. A round is a few Spark joins: links and the vectors they need meet
in the block of the node between them, each vector once a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kolekta.llm.common import Stored, read_table, stored

#: Neighbours of a node, and links of a kind that a round looks at for a node.
NEIGHBOURS, SAMPLE = 40, 40
#: Starting trees, nodes of a leaf, nodes of a block.
TREES, LEAF, BLOCK = 3, 256, 8192
#: Rounds at most; they end when fewer than SETTLED of all links are new.
ROUNDS, SETTLED = 10, 0.01
#: Best nodes that a search keeps open, and its steps at most.
BEAM, STEPS = 128, 8
GRAPH = "id long, nbr array<long>, sim array<float>, new array<boolean>"
#: Entries of many nodes of one block in a row.
PACKED = "p int, ids array<long>, nbr array<long>, sim array<float>, new array<boolean>"


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding): distinct rows of a not-null id and a vector of the
    commonest length (the longer of equals), without null or non-finite
    components, and not zero; components as double."""
    good = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
        " and exists(embedding, x -> x <> 0)")
    size = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("embedding") == (size[0] if size else 0)).distinct()


def _matrix(column):
    """Rows of an Arrow column of packed vectors."""
    import numpy as np
    if not len(column):
        return np.zeros((0, 1), np.float32)
    return np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in column])


def _flat(column):
    """Elements of all lists of an Arrow column."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _best(ids, nbr, sim, most, flag=None):
    """The ``most`` best distinct neighbours of each id, best first (ties: smaller
    neighbour); of repeats that with the smallest flag."""
    import numpy as np
    flag = np.zeros(len(ids), bool) if flag is None else flag
    order = np.lexsort((flag, nbr, ids))
    ids, nbr, sim, flag = ids[order], nbr[order], sim[order], flag[order]
    once = np.r_[True, (ids[1:] != ids[:-1]) | (nbr[1:] != nbr[:-1])][:len(ids)]
    ids, nbr, sim, flag = ids[once], nbr[once], sim[once], flag[once]
    order = np.lexsort((nbr, -sim, ids))
    ids, nbr, sim, flag = ids[order], nbr[order], sim[order], flag[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][:len(ids)])
    rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    keep = rank < most
    return ids[keep], nbr[keep], sim[keep], flag[keep]


def _lists(name, ids, columns):
    """An Arrow table of one row for each id (sorted) with lists of its elements."""
    import numpy as np
    import pyarrow as pa
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][:len(ids)])
    offsets = pa.array(np.r_[first, len(ids)].astype(np.int32))
    return pa.table({name: pa.array(ids[first])} | {
        k: pa.ListArray.from_arrays(offsets, pa.array(v)) for k, v in columns.items()})


def _packed(home, ids, nbr, sim):
    """An Arrow table of one row for each block in ``home``, with its entries."""
    import numpy as np
    import pyarrow as pa
    order = np.argsort(home, kind="stable")
    home = home[order]
    first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]][:len(home)])
    offsets = pa.array(np.r_[first, len(home)].astype(np.int32))
    return pa.table({"p": pa.array(home[first].astype(np.int32))} | {
        k: pa.ListArray.from_arrays(offsets, pa.array(v[order])) for k, v in
        (("ids", ids), ("nbr", nbr), ("sim", sim.astype(np.float32)), ("new", np.ones(len(ids), bool)))})


def _entries(lists: DataFrame, blocks: int) -> DataFrame:
    """Rows of GRAPH as rows of PACKED."""
    return lists.select(_block("id", blocks).alias("p"), F.expr("array_repeat(id, size(nbr))").alias("ids"), "nbr", "sim", "new")


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _leaves(x, start, leaf, rng):
    """Index groups of at most ``leaf`` rows, by medians of random projections."""
    import numpy as np
    todo = [start]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        order = at[np.argsort(x[at] @ rng.standard_normal(x.shape[1]).astype(np.float32), kind="stable")]
        todo += [order[:len(at) // 2], order[len(at) // 2:]]


def _forest(nodes: DataFrame, blocks: int, k: int) -> DataFrame:
    """Lists of near nodes found together in leaves of random projection trees."""
    import functools

    def projected(batches, tree):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            x = _matrix(b.column(1))
            key = x @ np.random.default_rng(tree).standard_normal(x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key)], ["id", "x", "key"])

    def compared(batches, tree):
        import numpy as np
        import pyarrow as pa
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        got = got.sort_by("id")
        ids, x = got.column(0).to_numpy(), _matrix(got.column(1))
        for at in _leaves(x, np.arange(len(ids)), LEAF, np.random.default_rng(100 + tree)):
            if len(at) < 2:
                continue
            s = x[at] @ x[at].T
            np.fill_diagonal(s, -2)
            top = np.argsort(-s, axis=1)[:, :min(k, len(at) - 1)]
            near = np.take_along_axis(s, top, 1)
            offsets = pa.array((np.arange(len(at) + 1) * top.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.ListArray.from_arrays(offsets, pa.array(ids[at][top].ravel())),
                 pa.ListArray.from_arrays(offsets, pa.array(near.ravel().astype(np.float32))),
                 pa.ListArray.from_arrays(offsets, pa.array(np.ones(top.size, bool)))], ["id", "nbr", "sim", "new"])

    trees = [nodes.select("id", "x").mapInArrow(functools.partial(projected, tree=t), "id long, x binary, key double")
             .repartitionByRange(blocks, "key").select("id", "x").mapInArrow(functools.partial(compared, tree=t), GRAPH)
             for t in range(TREES)]
    return functools.reduce(DataFrame.unionByName, trees)


def _merged(entries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` entries of each id, as rows of GRAPH; an entry known before stays not new."""
    def merge(table):
        ids, nbr, sim, new = _best(*(_flat(table.column(c)) for c in ("ids", "nbr", "sim")), k, _flat(table.column("new")))
        return _lists("id", ids, {"nbr": nbr, "sim": sim, "new": new})

    return entries.groupBy("p").applyInArrow(merge, GRAPH)


def _compared(graph: DataFrame, nodes: DataFrame, blocks: int, k: int) -> DataFrame:
    """Entries (rows of PACKED) of nodes met as neighbours of a neighbour, better than the worst of their list."""
    links = graph.select("id", F.explode(F.arrays_zip("nbr", "new")).alias("l")).select("id", F.col("l.nbr").alias("nbr"), F.col("l.new").alias("new"))
    back = Window.partitionBy("nbr", "new").orderBy(F.xxhash64("id"), "id")  # Spark cuts each task's rows before the shuffle
    back = links.withColumn("r", F.row_number().over(back)).where(F.col("r") <= SAMPLE)
    edges = (links.select(F.col("id").alias("v"), F.col("nbr").alias("w"), "new")
             .unionByName(back.select(F.col("nbr").alias("v"), F.col("id").alias("w"), "new"))
             .withColumn("p", _block("v", blocks)))
    worst = graph.select("id", F.when(F.size("sim") < k, F.lit(-2.0)).otherwise(F.array_min("sim")).cast("float").alias("least"))
    held = nodes.join(worst, "id").select(_block("id", blocks).alias("home"), F.col("id").alias("node"), "x", "least")
    asked = edges.select("p", F.col("w").alias("node_id")).distinct().withColumn("s", _block("node_id", blocks))

    def send(left, right):
        """What one block sends to each that asks: its nodes' ids, vectors and worst similarities in one row."""
        import numpy as np
        import pyarrow as pa
        ids = right.column("node").to_numpy()
        by_id = np.argsort(ids)
        ids, x, least = ids[by_id], _matrix(right.column("x"))[by_id], right.column("least").to_numpy()[by_id]
        to, want = left.column("p").to_numpy(), np.searchsorted(ids, left.column("node_id").to_numpy())
        rows = []
        for p in np.unique(to):
            at = want[to == p]
            rows.append({"p": int(p), "home": right.column("home")[0].as_py(), "ids": ids[at], "xs": x[at].tobytes(), "least": least[at]})
        return pa.Table.from_pylist(rows, pa.schema([("p", pa.int32()), ("home", pa.int32()), ("ids", pa.list_(pa.int64())),
                                                     ("xs", pa.binary()), ("least", pa.list_(pa.float32()))]))

    sent = asked.groupBy("s").cogroup(held.groupBy("home")).applyInArrow(
        send, "p int, home int, ids array<long>, xs binary, least array<float>").withColumnRenamed("p", "block")

    def meet(left, right):
        import numpy as np
        known, worst = _flat(right.column("ids")), _flat(right.column("least"))
        home = np.repeat(right.column("home").to_numpy(), np.diff(right.column("ids").combine_chunks().offsets.to_numpy()))
        x = np.concatenate([np.frombuffer(b.as_buffer(), np.float32) for b in right.column("xs")]).reshape(len(known), -1)
        by_id = np.argsort(known)
        known, worst, home, x = known[by_id], worst[by_id], home[by_id], x[by_id]
        v, new = left.column("v").to_numpy(), left.column("new").to_numpy(zero_copy_only=False)
        w = np.searchsorted(known, left.column("w").to_numpy())
        order = np.lexsort((w, ~new, v))
        v, w, new = v[order], w[order], new[order]
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1], True][:len(v) + 1]) if len(v) else [0]
        found, waiting = [], 0
        for a, z in zip(cuts[:-1], cuts[1:]):
            fresh = np.unique(w[a:z][new[a:z]])
            if not len(fresh):
                continue
            every = np.concatenate([fresh, np.setdiff1d(w[a:z], fresh)])
            s = x[fresh] @ x[every].T
            i, j = np.nonzero(s > np.minimum(worst[fresh][:, None], worst[every][None, :]))
            i, j, s = fresh[i], every[j], s[i, j]
            for one, two in ((i, j), (j, i)):
                good = (s > worst[one]) & (one != two)
                found.append((one[good], two[good], s[good]))
                waiting += len(found[-1][0])
            if waiting > 2_000_000:
                found = [_best(*(np.concatenate(c) for c in zip(*found)), k)[:3]]
                waiting = len(found[0][0])
        ids, nbr, sim = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
        ids, nbr, sim, _ = _best(ids, nbr, sim, k)
        return _packed(home[ids], known[ids], known[nbr], sim)

    return edges.groupBy("p").cogroup(sent.groupBy("block")).applyInArrow(meet, PACKED)


def nn_descent(nodes: DataFrame, count: int, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(id, nbr, sim, new): up to ``k`` near nodes of each of ``nodes(id, x)``, best first.

    x: unit vectors as packed 32-bit floats; sim: their cosine.
    """
    blocks = max(1, -(-count // BLOCK))
    graph = Stored(_merged(_entries(_forest(nodes, blocks, k), blocks), k), "graph")
    for _ in range(rounds):
        old = graph.df.withColumn("new", F.transform("new", lambda x: F.lit(False)))
        after = Stored(_merged(_entries(old, blocks).unionByName(_compared(graph.df, nodes, blocks, k)), k), "graph")
        graph.drop()
        graph = after
        changed = graph.df.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0
        if changed <= SETTLED * k * count:
            break
    return graph.df


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, count: int, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """(id, nbr, sim): the ``beam`` best nodes that greedy search meets for each of ``queries(id)``.

    A search starts from the query's own place in the graph. At each step
    it opens all unopened of its best ``beam`` nodes: their neighbours are
    compared with the query in the blocks that hold their vectors. It ends
    when nothing is left to open, or after ``steps``.
    """
    blocks = max(1, -(-count // BLOCK))
    lists = graph.select("id", "nbr", "sim")
    vectors = nodes.join(queries, "id", "left_semi").select(F.col("id").alias("q"), F.col("x").alias("qx"))
    vectors = stored(vectors, "queries")
    start = lists.join(queries, "id", "left_semi").withColumn("new", F.transform("nbr", lambda x: F.lit(True)))
    state = Stored(_merged(_entries(start, blocks), beam), "search")
    own = nodes.select(_block("id", blocks).alias("block"), F.col("id").alias("member"), F.col("x").alias("mx"))

    def meet(left, right):
        import numpy as np
        import pyarrow.compute as pc
        is_query = left.column("nbr").is_null()
        asked, posed = left.filter(pc.invert(is_query)), left.filter(is_query)
        q_ids, ids = posed.column("q").to_numpy(), right.column("member").to_numpy()
        q_order, order = np.argsort(q_ids), np.argsort(ids)
        qx, x = _matrix(posed.column("x")), _matrix(right.column("mx"))
        q = q_order[np.searchsorted(q_ids, asked.column("q").to_numpy(), sorter=q_order)] if len(q_ids) else np.zeros(0, np.int64)
        n = order[np.searchsorted(ids, asked.column("nbr").to_numpy(), sorter=order)] if len(q) else q
        sim = np.concatenate([np.einsum("ij,ij->i", qx[q[a:a + 65536]], x[n[a:a + 65536]])
                              for a in range(0, len(q), 65536)] or [np.zeros(0, np.float32)])
        i, m, s, _ = _best(q_ids[q], ids[n], sim, beam)
        home = posed.column("home").to_numpy()[q_order][np.searchsorted(q_ids, i, sorter=q_order)] if len(i) else i
        return _packed(home, i, m, s)

    for _ in range(steps):
        opened = state.df.select(F.col("id").alias("q"), F.explode(F.filter(F.arrays_zip("nbr", "new"), lambda x: x["new"])).alias("c"))
        asked = (opened.select("q", F.col("c.nbr").alias("id")).join(lists, "id")
                 .select("q", F.explode("nbr").alias("nbr")).where("nbr <> q").distinct().withColumn("p", _block("nbr", blocks)))
        posed = asked.select("p", "q").distinct().join(vectors, "q")
        left = (asked.select("p", "q", "nbr", F.lit(None).cast("binary").alias("x"), F.lit(None).cast("int").alias("home"))
                .unionByName(posed.select("p", "q", F.lit(None).cast("long").alias("nbr"), F.col("qx").alias("x"),
                                          _block("q", blocks).alias("home"))))
        met = left.groupBy("p").cogroup(own.groupBy("block")).applyInArrow(meet, PACKED)
        old = state.df.withColumn("new", F.transform("new", lambda x: F.lit(False)))
        after = Stored(_merged(_entries(old, blocks).unionByName(met), beam), "search")
        state.drop()
        state = after
        if not state.df.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0]:
            break
    return state.df.select("id", "nbr", "sim")


def _cosines(pairs: DataFrame) -> DataFrame:
    """``pairs(id, nbr, a, b)`` with the cosine of the vectors a and b in double precision."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for t in batches:
            if not t.num_rows:
                continue
            a, b = (t.column(i).flatten().to_numpy().reshape(t.num_rows, -1) for i in (2, 3))
            # Scaled first, so that squares of very large or small components stay in range.
            a, b = (v / np.abs(v).max(1, keepdims=True) for v in (a, b))
            cos = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(cos)], ["id", "nbr", "score"])

    return pairs.mapInArrow(run, "id long, nbr long, score double")


def nearest(rows: DataFrame, query_rows, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows by cosine found for
    each row of ``rows(vec_id, embedding)`` for which the condition
    ``query_rows`` holds, nearest first, ties to the smaller vec_id.

    Rows of null ids or invalid vectors take no part (see valid_vectors), and
    rows that repeat id and vector count once. Copies of a vector are one
    node; of them the k + 1 smallest ids can be answers, which is exact. A
    query is compared with every other id, its own copies too; a query id with two
    vectors asks with both. An empty table, or one row, gives no answers.
    """
    good = stored(valid_vectors(rows), "vectors")
    copies = Window.partitionBy("embedding").orderBy("vec_id")  # Spark keeps k + 1 rows of each task's copies
    first = good.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    first = stored(first, "copies")
    # A node is named by the smallest id of its vector; where two vectors share that id, by a number below all ids.
    heads = stored(first.where("r = 1").select("vec_id", "embedding").withColumn("spare", F.monotonically_increasing_id()), "heads")
    shared = heads.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("shared"))
    least = heads.agg(F.min("vec_id")).first()[0] or 0
    heads = heads.join(shared, "vec_id", "left").select(
        F.when(F.col("shared"), F.lit(least - 1) - F.col("spare")).otherwise(F.col("vec_id")).alias("id"), "embedding")

    def unit(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            x = x / np.abs(x).max(1, keepdims=True)
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "x"])

    numbered = heads
    nodes = stored(numbered.mapInArrow(unit, "id long, x binary"), "nodes")
    count = nodes.count()
    member = first.join(heads.select("id", "embedding"), "embedding").select("id", "vec_id")
    asked = good.where(query_rows).join(heads, "embedding").select(F.col("vec_id").alias("query_id"), "id")
    asked = stored(asked, "asked")
    graph = nn_descent(nodes, count)
    met = search(graph, nodes, asked.select("id").distinct(), count)
    pairs = met.select("id", F.explode("nbr").alias("nbr")).unionByName(
        asked.select("id", F.col("id").alias("nbr")).distinct())
    pairs = (pairs.join(numbered.select("id", F.col("embedding").alias("a")), "id")
             .join(numbered.select(F.col("id").alias("nbr"), F.col("embedding").alias("b")), "nbr")
             .select("id", "nbr", "a", "b"))
    scored = _cosines(pairs)
    best = Window.partitionBy("id").orderBy(F.desc("score"), "nbr")
    scored = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    answers = (asked.join(scored, "id").select("query_id", F.col("nbr").alias("id"), "score").join(member, "id")
               .where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the 5 nearest rows of every row whose vec_id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
