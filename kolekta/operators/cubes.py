"""Pre-aggregated marts: the filter cube and the drill roll-up.

The dashboard cached one result per (month, segment, region) filter triple.
Here every triple, "ALL" included, is computed in one pass over the fact
table: the rows are first summed per (month, segment, region, status) --
partial aggregation, one shuffle -- and only those sums are expanded by
``cube`` and aggregated again (a second, small shuffle). ``grouping()`` tells
a rolled-up "ALL" from a real null value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import money, money_sql, sql_str, total
from kolekta.operators.filters import filter_invoices
from kolekta.operators.summary import AMT

ALL = "ALL"
#: Column of a mart that holds the fact rows of a combination; a fact table lacks it.
RECORDS = "records"


def pre_aggregate(inv: DataFrame, keys: list[str]) -> DataFrame:
    """Sum and count per combination of ``keys`` (plus status), partially
    aggregated map-side. Cubes and roll-ups then expand these few rows rather
    than every fact row: Spark expands before it aggregates, so a cube over
    three columns would otherwise multiply the input eightfold."""
    cols = list(dict.fromkeys(keys + ["status_tagih"]))
    rows = F.sum("records") if RECORDS in inv.columns else F.count(F.lit(1))
    return inv.groupBy(*cols).agg(F.sum(F.col(AMT).cast("decimal(38,6)")).alias("_s"), rows.alias("_n"))


DIMS = ("report_month", "pengelolaan", "region")
#: Exact sums of a cube row, and the status that each takes (None: all).
SUMS = (("total", None), ("layak", vocab.LAYAK), ("tidak_layak", vocab.TIDAK_LAYAK), ("bermasalah", vocab.BERMASALAH))


def cube_sums(rows: DataFrame) -> DataFrame:
    """(level, report_month, pengelolaan, region, exact sums, n) for every
    combination of the three dimensions; a bit of ``level`` is set where a
    dimension is rolled up. ``rows`` is a fact table, a mart, or signed
    changes of a mart: all columns but the first four add up."""
    sums = [F.expr("coalesce(sum(_s), cast(0 as decimal(38,6)))" if v is None else
                   f"coalesce(sum(CASE WHEN status_tagih = {sql_str(v)} THEN _s END), cast(0 as decimal(38,6)))")
            .cast("decimal(38,6)").alias(name) for name, v in SUMS]
    g = pre_aggregate(rows, list(DIMS)).cube(*DIMS).agg(F.grouping_id().cast("int").alias("level"), *sums,
                                                        F.expr("cast(sum(_n) as bigint) AS n"))
    return g.select("level", *DIMS, *[n for n, _ in SUMS], "n")


def cube_rows(sums: DataFrame) -> DataFrame:
    """The cube as the dashboard reads it, from its exact sums."""
    names = ("month", "segment", "region")
    return sums.selectExpr(
        *[f"if((level & {1 << (2 - i)}) <> 0, '{ALL}', {c}) AS {a}" for i, (c, a) in enumerate(zip(DIMS, names))],
        *[f"{money_sql(n)} AS {n}{'_ar_m' if n == 'total' else '_m'}" for n, _ in SUMS], "n")


def kpi_cube(inv: DataFrame) -> DataFrame:
    """KPI measures for every (month, segment, region) combination, each
    dimension either a value or ``ALL``; ``ALL/ALL/ALL`` equals the KPI row.
    ``inv`` is the fact table or its mart."""
    return cube_rows(cube_sums(inv))


def drill_rollup(inv: DataFrame, month=None, segment=None, region=None,
                 levels: tuple[str, ...] = ("status_tagih", "region", "invoice_status")) -> DataFrame:
    """Nested subtotals status -> region -> category; ``level`` is the depth
    (0 = grand total) and rolled-up columns read ``ALL``."""
    f = pre_aggregate(filter_invoices(inv, month, segment, region), list(levels))
    g = f.rollup(*levels).agg(*[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(levels)],
                              total(F.col("_s")).alias("_v"), F.sum("_n").alias("_n"))
    depth = sum((1 - F.col(f"_g{i}") for i in range(len(levels))), F.lit(0))
    cols = [F.when(F.col(f"_g{i}") == 1, F.lit(ALL)).otherwise(F.col(c)).alias(c) for i, c in enumerate(levels)]
    return g.select(depth.cast("int").alias("level"), *cols, money("_v").alias("v"),
                    F.col("_n").cast("bigint").alias("n"))
