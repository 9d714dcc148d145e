"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard.

A document is its set of distinct word shingles (64-bit hashes). Circulant
MinHash takes two permutations of the ring of 2**32 positions: the first
scatters the shingles, the second, shifted by k, gives coordinate k of the
signature, so that no coordinate has a permutation of its own. Bands of a few
coordinates name buckets; what shares a bucket is compared on the full sets.

Equal sets are one node, however many documents have them. Two rounds of
comparisons find every link between nodes of a bucket without writing out
pairs. First the members of the buckets of a few bands are compared with the
least member of their bucket; in a group of near copies that links almost
all. Then every bucket whose members are not in one component yet is a tile
whose members are compared with each other, those of one component excepted.
Large tiles are cut into groups by the bytes of their sets, and every pair of
groups is compared, so that no task meets an unbounded one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import byte_texts, key_runs, lower_words, read_table, stored
from kolekta.llm.components import components

SHINGLE_WORDS = 3
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair at the least similarity shares no bucket with probability (1 - 0.85**5)**32 = 7e-9.
BANDS, ROWS = 32, 5
#: Bands whose buckets are compared with their least member first.
LEADING = 4
SEED = 42
#: Shingles of the sets that a task compares with each other at once.
TILE_SHINGLES = 1 << 20
#: Shingles whose coordinates are computed at once (few enough for a core's cache).
CHUNK = 1 << 10


def shingle_set(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED):
    """Sorted distinct 64-bit hashes of the word shingles of a text; fewer
    words than a shingle are one shingle, no words none."""
    import numpy as np
    from xxhash import xxh64_intdigest
    w = lower_words(text)
    n = len(w) - shingle_words + 1
    join = b" ".join
    if not w:
        return np.empty(0, np.uint64)
    if n <= 1:
        return np.array([xxh64_intdigest(join(w), seed)], np.uint64)
    return np.unique(np.fromiter(
        (xxh64_intdigest(join(s), seed) for s in zip(*(w[k:k + n] for k in range(shingle_words)))), np.uint64, n))


def _permuted(x, first: int, second: int):
    """A permutation of the 32-bit numbers (each step can be undone)."""
    import numpy as np
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles, coordinates: int):
    """Circulant MinHash of a set that is not empty: coordinate k is the least
    value of the second permutation at the scattered positions, moved by k."""
    import numpy as np
    ring = np.unique((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    at = _permuted(ring, 0x7FEB352D, 0x846CA68B)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None] * np.uint32(0x9E3779B1)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(at), CHUNK):
        np.minimum(least, _permuted(at[k:k + CHUNK] + shift, 0x85EBCA6B, 0xC2B2AE35).min(1), out=least)
    return least


def band_keys(signatures, bands: int, rows: int):
    """(documents, bands) signed 64-bit bucket names, the band's number mixed in."""
    import numpy as np
    s = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    for k in range(rows):
        key = (key ^ s[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, d1, d2, bands) of every row of ``docs(doc_id, text)``:
    the size of its set, a 128-bit digest of it, and its bucket names (none for an empty set)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        for b in batches:
            sets = [shingle_set(t, shingle_words) for t in byte_texts(b.column(2))]
            digest = np.array([np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(np.array([signature(sets[i], bands * rows) for i in full], np.uint32).reshape(
                len(full), bands * rows), bands, rows)
            counts = np.zeros(len(sets) + 1, np.int32)
            counts[1:][full] = bands
            named = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(digest[:, 0].copy()),
                 pa.array(digest[:, 1].copy()), named], ["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted(doc_id, text_hash, d1, d2, node)``, each from a document that has
    its set. The text's hash is part of the key, so that an id with many texts meets each of them once."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest
        for b in batches:
            d1, d2 = (b.column(i).to_numpy() for i in (2, 3))
            nodes, sets = [], []
            for i, t in enumerate(byte_texts(b.column(1))):
                s = shingle_set(t, shingle_words).tobytes()
                if np.array_equal(np.frombuffer(xxh3_128_digest(s), np.int64), (d1[i], d2[i])):
                    nodes.append(i)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(nodes, pa.int64())), pa.array(sets, pa.binary())],
                                             ["node", "shingles"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    same = named.doc_id.eqNullSafe(wanted.doc_id) & (named.text_hash == wanted.text_hash)
    found = named.join(wanted, same).select(
        named.doc_id, "text", "d1", "d2", "node").mapInArrow(run, "node long, shingles binary")
    return found.dropDuplicates(["node"])  # a repeated row gives its set again


def link_sets(home: list, visit: list, labels, percent: int):
    """(i, j) star links between the sets of a tile: ``home`` and ``visit`` are
    sorted arrays, ``labels`` the component of each, home first. Every home set
    is compared with all sets of another component."""
    import numpy as np
    sets, label = [*home, *visit], np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i, s in enumerate(home):
        able = (label != label[i]) & (100 * np.minimum(sizes, len(s)) >= percent * np.maximum(sizes, len(s)))
        if not able.any():
            continue
        first, last = np.searchsorted(flat, s), np.searchsorted(flat, s, side="right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero(able & (100 * common >= percent * (sizes + len(s) - common)))
        merged, first_of = np.unique(label[near], return_index=True)
        if len(merged):
            out += [(i, int(j)) for j in near[first_of]]
            label[np.isin(label, merged)] = label[i]
    return out


def _compare(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) found in ``tiles(tile, h, g, role, node, label)``: the home
    sets (role 0) of each (tile, h, g) against each other and its visitors (role 1)."""
    rows = (tiles.join(sets, "node").select("tile", "h", "g", "role", "node", "label", "shingles")
            .repartition("tile", "h", "g").sortWithinPartitions("tile", "h", "g", "role", "node"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for _, parts in key_runs(batches, 3):
            role, node, label = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (3, 4, 5))
            sets = [np.frombuffer(s.as_py(), np.uint64) for p in parts for s in p.column(6)]
            homes = int((role == 0).sum())
            found = link_sets(sets[:homes], sets[homes:], label, percent) if homes and len(sets) > 1 else []
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _groups(n, tile_shingles: int):
    return F.greatest(F.lit(1), F.ceil(n / tile_shingles))


def links(marks: DataFrame, sets: DataFrame, percent: int = PERCENT, leading: int = LEADING) -> DataFrame:
    """(u, v): links that join every two nodes of a bucket whose sets reach
    ``percent``, directly or through others. ``marks(band, key, node, n)``."""
    # Round 1: members of a leading band's bucket against its least member.
    few = marks.where(F.col("band") < leading)
    leads = few.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("m")).where("m > 1").select("key", "lead")
    pairs = stored(few.join(leads, "key").where("node <> lead").select("lead", "node", "n").distinct(), "pairs")
    plan = pairs.groupBy("lead").agg(_groups(F.sum("n"), TILE_SHINGLES).alias("gs"))
    away = pairs.join(plan, "lead").select(
        F.col("lead").alias("tile"), F.lit(0).cast("long").alias("h"), F.pmod(F.xxhash64("node"), F.col("gs")).alias("g"),
        F.lit(1).cast("byte").alias("role"), "node", F.col("node").alias("label"))
    home = plan.select(F.col("lead").alias("tile"), F.lit(0).cast("long").alias("h"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("gs") - 1)).alias("g"),
                       F.lit(0).cast("byte").alias("role"), F.col("lead").alias("node"), F.col("lead").alias("label"))
    first = stored(_compare(home.unionByName(away), sets, percent), "star_links")
    # Round 2: buckets that hold more than one component, each set of members once.
    roots = stored(components(first), "roots")
    labelled = (marks.join(roots, marks.node == roots.u, "left")
                .select("key", "node", "n", F.coalesce("root", "node").alias("label")))
    open_ = (labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count("*").alias("m"),
                                         F.bit_xor(F.xxhash64("node")).alias("members"), F.sum("n").alias("size"))
             .where("a < z"))
    tiles = stored(open_.groupBy("members", "m", "a", "z").agg(F.min("key").alias("key"), F.min("size").alias("size"))
                   .select("key", _groups(F.col("size"), TILE_SHINGLES).alias("hs")), "tiles")
    own = F.pmod(F.xxhash64("node"), F.col("hs"))
    member = labelled.join(tiles, "key").select(F.col("key").alias("tile"), "hs", own.alias("own"), "node", "label")
    # Group h visits the tasks (i, h) of the groups i before it; a group alone is the task (h, h).
    rest = member.select(
        "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hs") - 1)).alias("other"), "own", "node", "label").select(
        "tile", F.least("own", "other").alias("h"), F.greatest("own", "other").alias("g"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).cast("byte").alias("role"), "node", "label")
    return first.unionByName(_compare(rest, sets, percent))


def minhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT,
                   bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    Documents link when the Jaccard similarity of their full shingle sets is
    ``percent`` or more; a component is named by its smallest doc_id. Null and
    empty texts and those without words have no shingles and link with
    nothing: their component is their own id. Equal texts link, whatever
    their ids; repeated rows come back repeated. A null doc_id names no
    component unless all of it is null (then null). Other columns are
    ignored; an empty table gives no rows.
    """
    drawn = stored(sketches(docs, shingle_words, bands, rows), "sketches")
    slim = drawn.select("doc_id", "n_shingles", "d1", "d2")
    nodes = stored(drawn.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    marks = nodes.select(F.posexplode("bands").alias("band", "key"), "node", F.col("n"))
    shared = marks.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    marks = stored(marks.join(shared, "key").select("band", "key", "node", "n"), "marks")
    wanted = nodes.select("one.doc_id", "one.text_hash", "d1", "d2", "node").join(marks.select("node").distinct(), "node")
    sets = stored(_sets(docs, wanted, shingle_words), "sets")
    roots = components(stored(links(marks, sets, percent), "all_links"))
    named = nodes.join(roots, nodes.node == roots.u, "left").select(
        "d1", "d2", "doc_id", F.coalesce("root", "node").alias("root"))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "root").select("d1", "d2", "component_id")
    return (slim.join(names, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: doc_id, n_shingles, component_id, kept of every document."""
    return minhash_groups(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Shingles of every document, an inverted index of them, and a closure over the links.
SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from words),
parts as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
pairs as (
  select a.doc_id as u, b.doc_id as v from parts a join parts b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links as (select u, v from pairs union all select v, u from pairs),
reach as (select doc_id, doc_id as other from sets union select r.doc_id, l.v from reach r join links l on l.u = r.other)
select s.doc_id, len(s.s) as n_shingles, r.component_id, s.doc_id = r.component_id as kept
from sets s join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)
"""
