"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta.llm.common import Stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours ``v``."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least one around it."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least(both), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _least(down)
    return (down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root): for each node with a link, the least node of its component.

    ``edges(u, v)`` of one orderable type. Large-star and small-star rounds;
    each round is a min per node and a join, so a hub is neither gathered
    into one task nor expanded to pairs. Rounds end when the table is the
    same twice; each is written to the shared folder. Null ends and loops
    are ignored; no links give no rows. Raises after ``rounds`` rounds.
    """
    def signature(s: Stored):
        return tuple(s.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = Stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "links")
    state = signature(now)
    for _ in range(rounds if state[0] else 0):
        after = Stored(_small_star(_large_star(now.df)), "links")
        now.drop()
        now, before, state = after, state, signature(after)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.df.select("u", F.col("v").alias("root"))
