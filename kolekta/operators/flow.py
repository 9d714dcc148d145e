"""The multi-level receivable flow and its action plan.

Level 1 splits the total by collection status; level 2 takes everything that
is *not* uncollectible (collectible, problematic and null status alike) and
splits it into the home region and the rest; level 3 splits the home part into
invoiced / not yet invoiced; level 4 is the home part per category.

All levels come out of one global ``agg`` of conditional sums: one scan and
one single-row exchange per task, whatever the number of nodes. Only the
regional breakdown (per region name) needs a group-by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import (is_home, is_home_sql, money, money_sql, not_equal_ns, pct_sql, sql_str, sum_if,
                               total, values_frame)
from kolekta.operators.filters import filter_invoices
from kolekta.operators.summary import AMT, long_rows_sql, status_sums


def _layak_set() -> Column:
    return not_equal_ns("status_tagih", vocab.TIDAK_LAYAK)


def flow_flags(df: DataFrame, home: str = vocab.HOME_REGION) -> DataFrame:
    """Project the columns the flow needs plus its two row flags, computed once
    per row (the conditional sums then only test booleans)."""
    return df.selectExpr(AMT, "status_tagih", "invoice_status",
                         f"NOT (status_tagih <=> {sql_str(vocab.TIDAK_LAYAK)}) AS _keep",
                         f"{is_home_sql('region', home)} AS _is_home")


def flow_sums(categories: tuple[str, ...] = vocab.CATEGORIES,
              sudah: tuple[str, ...] = vocab.SUDAH_CATS, belum: tuple[str, ...] = vocab.BELUM_CATS) -> list[Column]:
    """Conditional sums over ``flow_flags`` rows (SQL text: one JVM call each)."""
    home = "_keep AND _is_home"
    in_list = lambda vs: "(" + ", ".join(sql_str(v) for v in vs) + ")"
    return status_sums() + [
        sum_if(home).alias("_home"), sum_if("_keep AND NOT _is_home").alias("_regional"),
        sum_if(f"{home} AND invoice_status IN {in_list(sudah)}").alias("_sudah"),
        sum_if(f"{home} AND invoice_status IN {in_list(belum)}").alias("_belum"),
        *[sum_if(f"{home} AND invoice_status = {sql_str(c)}").alias(f"_c{i}") for i, c in enumerate(categories)],
    ]


def _flow_agg(inv, home, categories, month, segment, region) -> DataFrame:
    return flow_flags(filter_invoices(inv, month, segment, region), home).agg(*flow_sums(categories))


def flow_levels(inv: DataFrame, home: str = vocab.HOME_REGION, month=None, segment=None, region=None) -> DataFrame:
    g = _flow_agg(inv, home, vocab.CATEGORIES, month, segment, region)
    names = (("_total", "total_m"), ("_tidak", "tidak_layak_m"), ("_layak", "layak_tagih_m"),
             ("_bermasalah", "bermasalah_m"), ("_home", "home_total_m"), ("_regional", "regional_total_m"),
             ("_sudah", "sudah_invoice_m"), ("_belum", "belum_invoice_m"))
    return g.selectExpr(*[f"{money_sql(src)} AS {dst}" for src, dst in names])


def flow_categories(inv: DataFrame, home: str = vocab.HOME_REGION,
                    categories: tuple[str, ...] = vocab.CATEGORIES, month=None, segment=None, region=None) -> DataFrame:
    """Home-region amount per known category, positive ones only, in category order."""
    g = _flow_agg(inv, home, categories, month, segment, region)
    rows = [(str(i + 1), sql_str(c), f"_c{i}") for i, c in enumerate(categories)]
    return (long_rows_sql(g, rows, ("ord", "category", "_s"))
            .where("_s > 0").selectExpr("ord", "category", f"{money_sql('_s')} AS v"))


def flow_regional(inv: DataFrame, home: str = vocab.HOME_REGION, month=None, segment=None, region=None) -> DataFrame:
    """Non-home amount per raw region name, positive only. A null region counts
    in the regional total but has no row here."""
    f = filter_invoices(inv, month, segment, region)
    f = f.where(_layak_set() & ~is_home("region", home) & F.col("region").isNotNull())
    g = f.groupBy("region").agg(total(F.col(AMT)).alias("_s"))
    return g.where(F.col("_s") > 0).select("region", money("_s").alias("v"))


def flow_long(inv: DataFrame, home: str = vocab.HOME_REGION, month=None, segment=None, region=None,
              categories: tuple[str, ...] = vocab.CATEGORIES) -> DataFrame:
    """Every flow node as (level, node, v, pct_of_total); category nodes only
    when positive. Percent of the rounded total, 0 unless the total is > 0."""
    g = _flow_agg(inv, home, categories, month, segment, region)
    nodes = [(1, "TOTAL", "_total"), (2, vocab.TIDAK_LAYAK, "_tidak"), (2, vocab.LAYAK, "_layak"),
             (2, vocab.BERMASALAH, "_bermasalah"), (3, home.strip().upper(), "_home"), (3, "REGIONAL", "_regional"),
             (4, vocab.SUDAH_INVOICE, "_sudah"), (4, vocab.BELUM_INVOICE, "_belum")]
    rows = [(str(lvl), sql_str(node), f"round({c}, 4)", "round(_total, 4)") for lvl, node, c in nodes]
    rows += [("5", sql_str(c), f"CASE WHEN _c{i} > 0 THEN round(_c{i}, 4) END", "round(_total, 4)")
             for i, c in enumerate(categories)]
    long = long_rows_sql(g, rows, ("level", "node", "_v", "_t")).where("_v IS NOT NULL")
    return long.selectExpr("level", "node", "cast(_v as double) AS v", f"{pct_sql('_v', '_t')} AS pct_of_total")


def action_plan_dim(spark, plan: tuple = vocab.ACTION_PLAN) -> DataFrame:
    return values_frame(spark, plan, ("ord", "kategori", "uic", "tindak_lanjut", "due_date"))


def action_plan(inv: DataFrame, dim: DataFrame | None = None, home: str = vocab.HOME_REGION,
                month=None, segment=None, region=None, categories: tuple[str, ...] = vocab.CATEGORIES) -> DataFrame:
    """Action-plan rows whose amount is positive: the uncollectible total, the
    regional total and the home categories, joined to the
    plan dimension and kept in its order."""
    if dim is None:
        dim = action_plan_dim(inv.sparkSession)
    g = _flow_agg(inv, home, categories, month, segment, region)
    # Uncollectible compares its raw sum; the others compare the rounded
    # values the flow exposes (a category exists only when its raw sum is > 0).
    amounts = [(vocab.TIDAK_LAYAK, "_tidak"), ("REGIONAL", "round(_regional, 4)")]
    amounts += [(c, f"CASE WHEN _c{i} > 0 THEN round(_c{i}, 4) ELSE 0 END") for i, c in enumerate(categories)]
    rows = ", ".join(f"named_struct('kategori', {sql_str(k)}, '_v', cast({v} as decimal(38,6)))" for k, v in amounts)
    long = g.selectExpr(f"inline(array({rows}))").where("_v > 0")
    return (long.join(dim, "kategori")
            .selectExpr("ord", "kategori", f"{money_sql('_v')} AS nilai_m", "uic", "tindak_lanjut", "due_date")
            .orderBy("ord"))
