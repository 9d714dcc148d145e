"""The prefix trie of conversations, with sums over its subtrees by an Euler tour.

Conversations are rebuilt (see ``rebuilt``) and every distinct sequence of
their first d turns is a node. A turn is a 128-bit hash of role and text; a
prefix is the exclusive-or of its turns' hashes with their depths mixed in,
so prefixes of one long conversation are running values that many tasks share.

The tour enters and leaves every node once: an enter arc and an exit arc a
node, each linked to the next. Summing weights along that list to its end
(``scans.suffix_sums``) gives every subtree as the difference of two arcs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import key_slices, read_table, stored
from kolekta.llm.scans import running, suffix_sums, union

#: A conversation borrows its first turns from that of the next smaller multiple of GROUP, fewer than MOST of them.
GROUP, MOST = 5, 9
#: Bytes of conversation numbers that a row of their list holds.
CHUNK_BYTES = 1 << 20
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, p, t1, t2, n_bytes): every turn with its place from 1, a 128-bit hash of role and text, and its bytes.

    Turns are ordered by turn, null first; equal ones by that hash. Null roles
    and texts are empty; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"))
    return running(rows, "conv", ["turn", "t1", "t2"], sums=["one"]).select(
        "conv", F.col("run_one").alias("p"), "t1", "t2", "n_bytes")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) after rebuilding ``turns``: rows (conv, depth, t1,
    t2, n_bytes, last) and conversations (conv, length).

    Conversation c is the first h turns of conversation c - c % GROUP (all if
    it has fewer, none if it is absent), then its own turns after its first h;
    h is the crc32 of its decimal number, modulo MOST.
    """
    sizes = placed.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", "n", (F.col("conv") - F.col("conv") % GROUP).alias("base"),
                         (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % MOST).alias("h"))
    bases = sizes.where(f"conv % {GROUP} = 0").select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = stored(convs.join(bases, "base", "left").selectExpr(
        "conv", "n", "base", "h", "least(h, coalesce(n_base, 0L)) as k"), "convs")
    own = placed.join(convs.select("conv", "n", "h", "k"), "conv").where("p > h").selectExpr(
        "conv", "k + p - h as depth", "t1", "t2", "n_bytes", "p = n as last")
    lent = (placed.where(f"conv % {GROUP} = 0 and p < {MOST}").withColumnRenamed("conv", "base")
            .join(convs, "base").where("p <= h").selectExpr(
                "conv", "p as depth", "t1", "t2", "n_bytes", "n <= h and p = k as last"))
    return own.unionByName(lent), convs.selectExpr("conv", "k + greatest(n - h, 0L) as length")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, s1, s2, sha): SHA-256 of the ascending comma-joined numbers of ``rows(depth, s1, s2, conv)`` a key.

    The numbers of one key are joined to pieces by many tasks; one task then hashes the pieces as a stream."""
    key = ["depth", "s1", "s2"]

    def join(batches):
        import pyarrow as pa
        now, first, held, size = None, None, [], 0

        def out():
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in (*now, first)), pa.array([b",".join(held)])], [*key, "first", "piece"])

        for k, b in key_slices(batches, 3):
            numbers = [str(x).encode() for x in b.column(3).to_pylist()]
            if held and (k != now or size > CHUNK_BYTES):
                yield out()
                held, size = [], 0
            if not held:
                now, first = k, b.column(3)[0].as_py()
            held += numbers
            size += sum(map(len, numbers))
        if held:
            yield out()

    def digest(batches):
        import hashlib

        import pyarrow as pa
        now, sha, found = None, None, []
        for k, b in key_slices(batches, 3):
            for piece in b.column(4).to_pylist():
                if k != now:
                    if sha:
                        found.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(piece)
                else:
                    sha.update(b",")
                    sha.update(piece)
            if len(found) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*found)], [*key, "sha"])
                found = []
        if sha:
            found.append((*now, sha.hexdigest()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*found)], [*key, "sha"])

    named = ", ".join(f"{c} long" for c in key)
    pieces = (rows.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
              .mapInArrow(join, f"{named}, first long, piece binary"))
    return (pieces.repartition(*key).sortWithinPartitions(*key, "first")
            .mapInArrow(digest, f"{named}, sha string"))


def tour(nodes: DataFrame, root: int) -> DataFrame:
    """(arc, succ): the Euler tour of the tree ``nodes(id, parent)``; arc 2 * id
    enters a node, arc 2 * id + 1 leaves it. Siblings come by id. The tour
    ends where it leaves ``root``."""
    child = nodes.where("parent is not null")
    placed = running(child.select("parent", "id"), "parent", ["id"], lag="id")
    down = placed.selectExpr("if(lag_id is null, 2 * parent, 2 * lag_id + 1) as arc", "2 * id as succ")
    up = child.groupBy("parent").agg(F.max("id").alias("id")).selectExpr("2 * id + 1 as arc", "2 * parent + 1 as succ")
    turn = (nodes.select("id").join(child.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
            .selectExpr("2 * id as arc", "2 * id + 1 as succ"))
    end = nodes.where(F.col("id") == root).selectExpr("2 * id + 1 as arc", "cast(null as long) as succ")
    return union([down, up, turn, end])


def subtree_sums(nodes: DataFrame, weights: list[str], root: int = 0) -> DataFrame:
    """(id, *weights): the sums over the subtree of each node of the tree ``nodes(id, parent, *weights)``."""
    none = [F.lit(0).cast("long").alias(w) for w in weights]
    arcs = tour(nodes, root).select("arc", "succ", *none).unionByName(
        nodes.select((F.col("id") * 2).alias("arc"), F.lit(None).cast("long").alias("succ"), *weights))
    arcs = arcs.groupBy("arc").agg(F.max("succ").alias("succ"), *(F.sum(w).alias(w) for w in weights))
    ends = suffix_sums(arcs, weights)
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    return ends.groupBy(F.shiftright("arc", 1).alias("id")).agg(*(F.sum(F.col(w) * sign).alias(w) for w in weights))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt ``conversations(conv_id, turn, role, text)``.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs
    (members), n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (over its subtree, (n_convs - 1) times the bytes of a node's
    last text) and ends_sha256 (of the members that end here). Null roles and
    texts are empty; null turns come first, equal turns in the order of a
    hash of role and text; a repeated row is a turn of its own; rows of null
    conv_id are left out; other columns are ignored. Without conversations
    there are no nodes, not even a root.
    """
    placed = stored(turns(conversations), "turns")
    rows, convs = rebuilt(placed)
    rows = stored(rows.withColumns({"g1": F.xxhash64("depth", "t1", "t2"), "g2": F.xxhash64("t2", F.lit(7), "depth", "t1")}),
                  "rebuilt")
    paths = running(rows.select("conv", "depth", "g1", "g2", "n_bytes", "last"), "conv", ["depth"], xors=["g1", "g2"])
    paths = stored(paths.selectExpr("conv", "depth", "run_g1 as s1", "run_g2 as s2", "run_g1 ^ g1 as p1",
                                    "run_g2 ^ g2 as p2", "n_bytes", "last"), "paths")
    least = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("conv is not null")
    root = least.selectExpr("0L as depth", "0L as s1", "0L as s2", "0L as p1", "0L as p2", "conv", "n_convs", "0L as n_bytes")
    nodes = paths.groupBy("depth", "s1", "s2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"))
    nodes = stored(nodes.unionByName(root).withColumn("one", F.lit(1).cast("long")), "nodes")
    # Numbers by first member and depth: a path that one conversation opens has neighbouring numbers. The root is 0.
    nodes = stored(running(nodes, None, ["conv", "depth"], sums=["one"]).selectExpr(
        "run_one - 1 as id", "depth", "s1", "s2", "p1", "p2", "conv", "n_convs", "n_bytes"), "nodes")
    top = nodes.where("id = 0").select("conv").collect()
    above = nodes.selectExpr("depth + 1 as depth", "s1 as p1", "s2 as p2", "id as parent", "conv as parent_conv_id")
    under_root = nodes.where("depth <= 1").withColumns({
        "parent": F.expr("if(depth = 0, null, 0L)"),
        "parent_conv_id": F.when(F.col("depth") == 1, F.lit(top[0][0] if top else None).cast("long"))})
    tree = stored(nodes.where("depth > 1").join(above, ["depth", "p1", "p2"]).unionByName(under_root), "tree")
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    tree = stored(tree.join(children, "id", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
        "leaf": F.expr("if(n_children is null, 1L, 0L)"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}), "tree")
    sums = subtree_sums(tree.select("id", "parent", "leaf", "saved"), ["leaf", "saved"])
    ended = paths.where("last").select("depth", "s1", "s2", "conv").unionByName(
        convs.where("length = 0").selectExpr("0L as depth", "0L as s1", "0L as s2", "conv"))
    return (tree.drop("leaf", "saved").join(sums, "id").join(_ends(ended), ["depth", "s1", "s2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256")))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the prefix trie of all rebuilt conversations, one row a node."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


SQL = r"""
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as p,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
sizes as (select c, count(*) as n from turns group by c),
hashed as (
  select c, n, c - c % 5 as b,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda t, z: xor(t >> 1, (t & 1) * 3988292384)))) % 9 as h
  from sizes),
convs as (
  select a.*, least(a.h, coalesce(s.n, 0)) as k from hashed a left join sizes s on s.c = a.b),
rebuilt as (
  select t.c, v.k + t.p - v.h as d, t.role, t.text from turns t join convs v using (c) where t.p > v.h
  union all select v.c, t.p, t.role, t.text from turns t join convs v on v.b = t.c where t.p <= v.h),
paths as (
  select c, d, octet_length(encode(text)) as bytes,
         sha256(array_to_string(list(sha256(octet_length(encode(role)) || ':' || role || text)) over (partition by c order by d), ',')) as key
  from rebuilt
  union all select c, 0, 0, '' from convs),
linked as (select *, lag(key) over (partition by c order by d) as above, max(d) over (partition by c) as ends from paths),
nodes as (
  select key, d, min(above) as above, min(c) as c, count(*) as n, min(bytes) as bytes,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = ends), '')) as ends_sha256
  from linked group by key, d),
children as (select above as key, count(*) as n_children from nodes where d > 0 group by above),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (key)),
sums as (
  select p.key, sum((n.n - 1) * n.bytes) as saved, count(*) filter (where n.n_children = 0) as leaves
  from full_nodes n join paths p on p.c = n.c and p.d <= n.d group by p.key)
select n.c as conv_id, n.d as depth, u.c as parent_conv_id, n.n as n_convs, n.n_children, s.leaves as n_leaves,
       s.saved::bigint as saved_tokens, n.ends_sha256
from full_nodes n join sums s using (key) left join full_nodes u on u.key = n.above
"""
