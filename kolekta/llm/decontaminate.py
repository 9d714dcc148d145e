"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MIN_WORDS words that a document shares with a benchmark
item; running Karp-Rabin hashes find them. Matches grow from seeds along
their diagonals; the longest that overlaps no tile becomes a tile, again
and again, so passages in another order are found as several tiles. A
document is contaminated if tiles cover COVERAGE of an item's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import fresh, plain_words, read_table, with_text_columns

MIN_WORDS = 5
COVERAGE = 0.5
#: Bytes of benchmark text that tasks hold at once; a larger benchmark takes a pass over the documents for each shard.
SHARD_BYTES = 16 << 20
_BASE = 0x100000001B3


def window_hashes(ids, width: int):
    """Karp-Rabin hash (modulo 2**64) of each run of ``width`` numbers."""
    import numpy as np
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(_BASE) + ids[k:k + n].astype(np.uint64)
    return h


def tile(doc, item, seeds, width: int) -> int:
    """Words of ``item`` that greedy string tiling covers with runs of ``doc``.

    ``seeds``: (document position, item position) pairs of equal runs of
    ``width`` words (others are dropped here by comparing the words). Of
    equally long matches the first in the item, then in the document, goes.
    """
    import heapq

    import numpy as np
    d, t = np.asarray(seeds, np.int64).reshape(-1, 2).T
    same = np.ones(len(d), bool)
    for k in range(width):
        same &= doc[d + k] == item[t + k]
    d, t = d[same], t[same]
    order = np.lexsort((d, d - t))
    d, t = d[order], t[order]
    first = np.flatnonzero(np.r_[True, (np.diff(d) != 1) | (np.diff(t) != 1)][:len(d)])
    runs = [(-(z - a + width - 1), int(t[a]), int(d[a])) for a, z in zip(first, [*first[1:], len(d)])]
    heapq.heapify(runs)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    while runs:
        minus, ti, di = heapq.heappop(runs)
        size = -minus
        free = ~(in_doc[di:di + size] | in_item[ti:ti + size])
        if free.all():
            in_doc[di:di + size] = in_item[ti:ti + size] = True
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if z - a >= width:
                heapq.heappush(runs, (a - z, ti + a, di + a))
    return int(in_item.sum())


class Tests:
    """Benchmark items as word numbers, and where each seed hash stands in them."""

    def __init__(self, items: list[tuple[int, bytes]], width: int = MIN_WORDS):
        import numpy as np
        self.numbers: dict[bytes, int] = {}
        self.ids, self.items, by_width = [], [], {}
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
            w = min(width, len(ids))
            by_width.setdefault(w, []).append((len(self.items), window_hashes(ids, w)))
            self.ids.append(item_id)
            self.items.append(ids)
        self.seeds = {}
        for w, found in by_width.items():
            h = np.concatenate([x for _, x in found])
            item = np.concatenate([np.full(len(x), k) for k, x in found])
            at = np.concatenate([np.arange(len(x)) for _, x in found])
            order = np.argsort(h, kind="stable")
            self.seeds[w] = h[order], item[order], at[order]

    def covered(self, texts: list[bytes]) -> list[tuple[float, int | None]]:
        """(largest coverage of an item, its id; the smaller id of equals) of each text."""
        import numpy as np
        words = [plain_words(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), np.int64, int(sizes.sum()))
        starts = np.r_[0, np.cumsum(sizes)]
        doc_of = np.repeat(np.arange(len(words)), sizes)
        unknown = np.r_[0, np.cumsum(ids == 0)]
        best: list[tuple[float, int | None]] = [(0.0, None)] * len(texts)
        for width, (h, item, at) in self.seeds.items():
            n = len(ids) - width + 1
            if n <= 0:
                continue
            pos = np.flatnonzero((unknown[width:] == unknown[:n]) & (doc_of[:n] == doc_of[width - 1:]))
            if not len(pos):
                continue
            own = np.zeros(len(pos), np.uint64)
            for k in range(width):
                own = own * np.uint64(_BASE) + ids[pos + k].astype(np.uint64)
            lo, hi = np.searchsorted(h, own), np.searchsorted(h, own, "right")
            met = hi > lo
            pos, lo, hi = pos[met], lo[met], hi[met]
            if not len(pos):
                continue
            # Equal seeds of a text are one group; its places in items are listed once, not for each place in the text.
            order = np.lexsort((pos, lo, doc_of[pos]))
            pos, lo, hi = pos[order], lo[order], hi[order]
            first = np.flatnonzero(np.r_[True, (np.diff(lo) != 0) | (np.diff(doc_of[pos]) != 0)])
            ends = np.r_[first[1:], len(pos)]
            many = (hi - lo)[first]
            group = np.repeat(np.arange(len(first)), many)
            place = np.repeat(lo[first] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            order = np.lexsort((at[place], item[place], doc_of[pos[first[group]]]))
            group, place = group[order], place[order]
            d, i, t = doc_of[pos[first[group]]], item[place], at[place]
            cuts = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(i) != 0)])
            # What an item's seeds could cover at most: the union of their runs.
            reach = np.full(len(t), width)
            reach[:-1] = np.where((np.diff(d) == 0) & (np.diff(i) == 0), np.minimum(width, np.diff(t)), width)
            lengths = np.array([len(self.items[k]) for k in i[cuts].tolist()])
            most = np.minimum(np.add.reduceat(reach, cuts), lengths) / lengths
            names = np.array([self.ids[k] for k in i[cuts].tolist()], np.int64)
            stops = np.r_[cuts[1:], len(d)]
            # The most promising items first; one that cannot beat the best found is not tiled.
            for c in np.lexsort((names, -most, d[cuts])).tolist():
                doc, it = int(d[cuts[c]]), int(i[cuts[c]])
                now = (-best[doc][0], best[doc][1] if best[doc][1] is not None else 1 << 63)
                if (-most[c], self.ids[it]) >= now:
                    continue
                own_groups, own_places = group[cuts[c]:stops[c]], t[cuts[c]:stops[c]]
                n = ends[own_groups] - first[own_groups]
                at_doc = np.repeat(first[own_groups] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                seeds = np.stack([pos[at_doc] - starts[doc], np.repeat(own_places, n)], 1)
                got = tile(ids[starts[doc]:starts[doc + 1]], self.items[it], seeds, width) / len(self.items[it])
                if (-got, self.ids[it]) < now:
                    best[doc] = got, self.ids[it]
        return best


def with_coverage(docs: DataFrame, benchmark: DataFrame, coverage: str, item: str,
                  width: int = MIN_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the largest share of a ``benchmark(item_id, text)`` item that tiles cover, and its item_id.

    The benchmark's size is read first. Up to ``shard_bytes`` it goes to the
    tasks as one broadcast; a larger one is cut by hash into shards below
    that, and the documents pass each in turn. No documents are shuffled.
    Null ids and texts of items take no part, repeated items count once;
    items shorter than ``width`` words match as a whole only.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    out = docs.withColumns({coverage: F.lit(0.0), item: F.lit(None).cast("long")})
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = sorted((r[0], r[1].encode()) for r in part.collect())
        held = docs.sparkSession.sparkContext.broadcast(rows)
        now, name = fresh(out.columns, "tiled"), fresh(out.columns, "tiled_item")

        def compute(texts, held=held, state={}):   # noqa: B006  (made once a task)
            import pyarrow as pa
            if "tests" not in state:
                state["tests"] = Tests(held.value, width)
            got = state["tests"].covered(texts)
            return [[c for c, _ in got], pa.array([i for _, i in got], pa.int64())]

        out = with_text_columns(out, {now: "double", name: "long"}, compute)
        better = (F.col(now) > F.col(coverage)) | ((F.col(now) == F.col(coverage)) & (F.col(name) < F.col(item)))
        out = out.withColumns({coverage: F.greatest(coverage, now),
                               item: F.when(better, F.col(name)).otherwise(F.col(item))}).drop(now, name)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, contaminated) of every row of ``docs(doc_id, text)``.

    item_id: the item most covered (the smallest of equals), null if none
    shares a seed. Null and empty texts are clean; repeated rows come back
    repeated; an empty benchmark finds nothing.
    """
    rows = with_coverage(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, "coverage", "item_id")
    return rows.select("doc_id", "item_id", "coverage", (F.col("coverage") >= COVERAGE).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    cover, item = fresh(docs.columns, "coverage"), fresh(docs.columns, "item_id")
    return with_coverage(docs, benchmark, cover, item).where(F.col(cover) < COVERAGE).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the benchmark item most covered, its coverage and the decision for every document."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
