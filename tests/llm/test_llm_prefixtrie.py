"""The prefix trie against SQL and a plain tree; list ranking against a walk; running values against itertools."""

import hashlib
import random
import zlib

import pytest
from conftest import SF
from oracle_compare import compare, duck

from kolekta.llm import prefixtrie, scans


def plain_trie(rows):
    """One tuple a node from (conv_id, turn, role, text) rows without ties."""
    own = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    members = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, d == len(whole)))
    out = []
    for node, ms in members.items():
        under = [n for n in members if n[:len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        ends = ",".join(str(c) for c in sorted(c for c, end in ms if end))
        out.append((min(ms)[0], len(node), min(members[node[:-1]])[0] if node else None, len(ms), len(kids),
                    sum(not any(m[:-1] == n for m in members if m) for n in under),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' as depth", "'y' as id", "'z' as p", "'w' as conv")
    return sorted(map(tuple, prefixtrie.prefix_trie(df).collect()), key=str)


def conversations(seed, n):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "", None, "a"]), draw.choice(["x", "yé", "", None, "zz"]))
            for c in draw.sample(range(3 * n), n) for t in [None, *range(draw.randrange(14))][draw.randrange(2):]]


def test_query_equals_sql(spark):
    r = compare(spark, duck(SF), SF, "op13", prefixtrie.query, prefixtrie.SQL)
    assert r["status"] == "ok" and r["rows"] > 100, r


def test_awkward_conversations(spark):
    """Null turns, roles and texts, absent bases, turnless and repeated conversations, a row without conv_id."""
    rows = conversations(1, 60) + [(None, 0, "user", "lost")]
    rows += [(c, t, "user", "again") for c in (1000, 1005, 1010) for t in range(12)]  # copies
    rows += [(2001, t, "user", "only own") for t in range(4)]                         # no base
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, []) == []


def test_one_conversation_with_most_rows_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 40)
    monkeypatch.setattr(scans, "LAST", 20)
    rows = conversations(2, 25) + [(10000, t, "user", f"t{t}") for t in range(400)]
    rows += [(10001, t, "user", f"t{t}") for t in range(399)]
    assert trie(spark, rows) == plain_trie(rows)


def test_ties_have_one_result(spark):
    rows = [(7, 1, "user", x) for x in "abca"] + [(7, 1, "user", "a")]
    got = [trie(spark, random.Random(k).sample(rows, len(rows))) for k in range(2)]
    assert got[0] == got[1] and sum(r[4] == 0 for r in got[0]) == 1


@pytest.mark.parametrize("scattered", [False, True])
def test_suffix_sums_of_lists(spark, monkeypatch, scattered):
    """Two lists, one of them dealt at random over the numbers, so that only mating shortens it."""
    monkeypatch.setattr(scans, "BLOCK", 30)
    monkeypatch.setattr(scans, "LAST", 25)
    order = list(range(0, 600, 2))
    if scattered:
        random.Random(4).shuffle(order)
    lists, want, rows = [order, [1, 3, 5]], {}, []
    for items in lists:
        total = 0
        for x in reversed(items):
            total += x
            want[x] = (len(items) - items.index(x), total)
        rows += [(x, y, 1, x) for x, y in zip(items, [*items[1:], None])]
    df = spark.createDataFrame(rows, "arc long, succ long, n long, w long")
    got = {r.arc: (r.n, r.w) for r in scans.suffix_sums(df, ["n", "w"]).collect()}
    assert got == want


def test_a_circle_raises(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "arc long, succ long, n long")
    with pytest.raises(Exception, match="circle"):
        scans.suffix_sums(df, ["n"]).collect()


def test_running_values(spark):
    draw = random.Random(6)
    rows = [(k, i, draw.randrange(-9, 9), draw.getrandbits(62)) for k, n in ((1, 300), (2, 1), (3, 40), (-4, 5)) for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v long, x long").repartition(8)
    got = {(r.k, r.i): (r.run_v, r.run_x, r.lag_i) for r in scans.running(df, "k", ["i"], ["v"], ["x"], "i").collect()}
    total, both = {}, {}
    for k, i, v, x in sorted(rows):
        total[k], both[k] = total.get(k, 0) + v, both.get(k, 0) ^ x
        assert got[k, i] == (total[k], both[k], i - 1 if i else None)
    whole = {r.v: r.run_one for r in scans.running(spark.range(500).selectExpr("id as v", "1L as one"), None, ["v"], ["one"]).collect()}
    assert whole == {i: i + 1 for i in range(500)}
    assert scans.running(df.limit(0), "k", ["i"], ["v"]).count() == 0
