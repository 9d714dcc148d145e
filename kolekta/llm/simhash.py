"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared
exactly by tiles of equal population counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kolekta.llm.common import byte_texts, fresh, lower_words, read_table, stored, with_text_columns
from kolekta.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: A fingerprint is cut into so many equal bit fields; their population counts name its tile.
FIELDS = 4
#: Members of a tile, and visitors to it, that one task compares at once.
TILE_ROWS = 4096
VISITOR_ROWS = 16384


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text.

    Each shingle of ``shingle_words`` lower-cased words (repeats included;
    fewer words: all of them) votes with the bits of its XXH64; a bit is set
    when over half of the shingles set it. No words: 0.
    """
    import numpy as np
    from xxhash import xxh64_intdigest
    w = lower_words(text)
    n = len(w) - shingle_words + 1
    if not w:
        return 0
    if n <= 1:
        return xxh64_intdigest(b" ".join(w), seed)
    join = b" ".join
    h = np.fromiter((xxh64_intdigest(join(s), seed) for s in zip(*(w[k:k + n] for k in range(shingle_words)))),
                    np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(h[k:k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def signed(fps: list[int]):
    """Unsigned 64-bit numbers as Spark's longs."""
    import numpy as np
    return np.array(fps, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long. Null text counts as empty."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids, texts = b.column(0), byte_texts(b.column(1))
            fp = signed([fingerprint(t, shingle_words, seed) for t in texts])
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _tile_key(fp, fields: int):
    """Population counts of the bit fields, 8 bits each, as one long."""
    width = 64 // fields
    mask = F.lit((1 << width) - 1)
    return sum((F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(mask)).cast("long") * F.lit(1 << (8 * k))
                for k in range(fields)), F.lit(0).cast("long"))


def _offsets(fields: int, radius: int) -> list[int]:
    """Differences of tile keys whose counts differ by 1 to ``radius`` in all,
    one of each pair of opposite signs."""
    import itertools
    return sorted(sum(d << (8 * k) for k, d in enumerate(o))
                  for o in itertools.product(range(-radius, radius + 1), repeat=fields)
                  if 0 < sum(map(abs, o)) <= radius and next(d for d in reversed(o) if d) > 0)


def _link_tile(home, visit, radius: int):
    """Star links (fp, root) of the linked members of one tile and its visitors."""
    import numpy as np
    every = np.concatenate([home, visit])
    label = np.arange(len(every))
    step = max(1, (1 << 22) // max(1, len(every)))
    for a in range(0, len(home), step):
        near = np.bitwise_count(home[a:a + step, None] ^ every[None, :]) <= radius
        for i in np.flatnonzero(near.sum(1) > 1):
            labels = np.unique(label[near[i]])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, fields: int = FIELDS) -> DataFrame:
    """(u, v): links that join every two distinct fingerprints of ``fps(fp)``
    at ``max_bits`` differing bits or fewer, directly or through others.

    Two fingerprints differ in at least as many bits as the population counts
    of their bit fields do in all. So a fingerprint visits only the tiles
    whose counts lie within ``max_bits`` of its own; each tile's members are
    compared with its visitors by exclusive-or and bit count, all with all.
    A large tile is cut by hash into several member and visitor groups, and
    every pair of groups is compared, so no task meets an unbounded one. A
    pair of groups returns a spanning star of what it linked, not the pairs.
    """
    key = _tile_key(F.col("fp"), fields)
    fps = fps.select("fp", key.alias("tile"))
    sizes = fps.groupBy("tile").agg(F.count("*").alias("n"))
    shifts = F.array(*[F.lit(o).cast("long") for o in _offsets(fields, max_bits)])
    # Visitors are counted from the tile sizes, so that each tile knows its groups beforehand.
    guests = (sizes.select(F.explode(F.transform(shifts, lambda o: F.col("tile") + o)).alias("tile"), "n")
              .groupBy("tile").agg(F.sum("n").alias("guests")))
    plan = (sizes.join(guests, "tile", "left").select(
        "tile", F.ceil(F.col("n") / TILE_ROWS).alias("h"), F.col("n"),
        F.coalesce("guests", F.lit(0)).alias("guests"))
        .select("tile", "h", F.greatest(F.lit(1), F.ceil(
            (F.col("guests") + F.when(F.col("h") > 1, F.col("n")).otherwise(0)) / VISITOR_ROWS)).alias("g")))
    plan = stored(plan, "tiles")
    own_h, own_g = F.pmod(F.xxhash64("fp"), F.col("h")), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("g"))
    home = fps.join(plan, "tile").select(
        "tile", own_h.alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("g"),
        F.lit(0).cast("byte").alias("role"), "fp")
    away = (fps.select("fp", F.explode(F.transform(shifts, lambda o: F.col("tile") + o)).alias("tile"))
            .join(plan, "tile")
            .select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("h"),
                    own_g.alias("g"), F.lit(1).cast("byte").alias("role"), "fp"))
    # Members of other groups of the same large tile.
    across = (fps.join(plan.where("h > 1"), "tile").where(own_h < F.col("h") - 1)
              .select("tile", F.explode(F.sequence(own_h + 1, F.col("h") - 1)).alias("h"),
                      own_g.alias("g"), F.lit(1).cast("byte").alias("role"), "fp"))
    rows = home.unionByName(away).unionByName(across)
    ordered = rows.repartition("tile", "h", "g").sortWithinPartitions("tile", "h", "g", "role")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(key, parts):
            if key is None:
                return None
            fp = np.concatenate([p[1] for p in parts])
            role = np.concatenate([p[0] for p in parts])
            if len(fp) < 2 or not (role == 0).any():
                return None
            u, v = _link_tile(fp[role == 0].view(np.uint64), fp[role == 1].view(np.uint64), max_bits)
            return (u.view(np.int64), v.view(np.int64)) if len(u) else None

        key, parts, found = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            t, h, g, role, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                here = (t[a], h[a], g[a])
                if here != key:
                    found += [x] if (x := out(key, parts)) else []
                    key, parts = here, []
                parts.append((role[a:z], fp[a:z]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v"])
                found = []
        if x := out(key, parts):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["u", "v"])

    return ordered.mapInArrow(run, "u long, v long")


def _roots(docs: DataFrame, shingle_words: int, max_bits: int, seed: int) -> DataFrame:
    """(doc_id, fp, root) of every row: the least fingerprint of its component."""
    rows = stored(fingerprints(docs, shingle_words, seed), "fingerprints")
    nodes = stored(rows.select("fp").distinct(), "nodes")
    roots = components(links(nodes, max_bits))
    named = nodes.join(roots, nodes.fp == roots.u, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows.join(stored(named, "named"), "fp").select("doc_id", "fp", "root")


def simhash_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs(doc_id, text)``.

    Copies share a fingerprint and are one node, however many; nodes link at
    ``max_bits`` differing bits or fewer, and a component is named by its
    smallest doc_id. Null and empty texts have fingerprint 0 and link like
    any other. A null doc_id names no component unless it is alone (then
    null). Repeated rows come back repeated; other columns are ignored; an
    empty table gives no rows.
    """
    rows = stored(_roots(docs, shingle_words, max_bits, seed), "rooted")
    names = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "root").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each SimHash component, with the columns of ``docs``.

    It is the row of the smallest doc_id; if that id is repeated within the
    component, the one of the least fingerprint, then of the least text. An id with
    unlike texts stands for each of their components. Rows of null doc_id,
    which cannot be named, all stay; an empty table gives no rows.
    """
    rows = stored(_roots(docs, shingle_words, max_bits, SEED), "rooted").where("doc_id is not null")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select("k.doc_id", "k.fp")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    kept = stored(kept.join(repeated.withColumn("twice", F.lit(True)), "doc_id", "left"), "kept")
    key, fp = fresh(docs.columns, "kept_id"), fresh(docs.columns, "fp")
    same_id = F.col("doc_id").cast("long") == F.col(key)
    once = kept.where("twice is null").select(F.col("doc_id").alias(key))
    twice = kept.where("twice").select(F.col("doc_id").alias(key), F.col("fp").alias(fp))
    # Only rows of repeated ids are told apart by their texts, whose fingerprints are computed again.
    again = with_text_columns(docs.join(twice.select(key).distinct(), same_id, "left_semi"), {fp: "long"},
                              lambda texts: [signed([fingerprint(t, shingle_words) for t in texts])])
    place = fresh([*docs.columns, fp], "place")
    one = Window.partitionBy("doc_id", fp).orderBy("text")   # each task passes on one row of a group
    again = (again.join(twice.select(F.col(key), F.col(fp).alias(f"{fp}_")), same_id & (F.col(fp) == F.col(f"{fp}_")), "left_semi")
             .withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*docs.columns))
    return (docs.join(once, same_id, "left_semi").unionByName(again).unionByName(docs.where("doc_id is null")))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: doc_id, fingerprint (16 hex digits), component_id of every document."""
    return simhash_groups(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
