"""The nested dashboard payload as ONE row, from ONE scan of the fact table.

1. Pre-aggregate: the fact rows are summed per combination of the six
   dimensions the dashboard uses (month, segment, region, category, status,
   aging) -- partial aggregation per task, one shuffle. The number of groups
   is bounded by the product of those dimensions' sizes, not by the data.
2. One grouping-sets aggregate over those rows: a "flow" set keeping every
   column a global KPI tests, and one set each for segment, category, region,
   month and region within the regional flow -- each group with its total,
   three status sums and row count.
3. One global aggregate over those few hundred rows computes every KPI,
   flow node, aging bucket and home category as a conditional sum, and
   gathers each chart's rows (one per segment, category, region or month)
   with ``collect_list``.

Sums of decimal sums are exact, so the numbers equal the single-operator
ones. The customer top-N and the small pre-computed tables (cash inflow,
trend, sparkline metrics) are appended to the same frame, each part filling
its own column, and gathered by the same final aggregate -- one plan, no
joins and no subqueries. The detail rows are not embedded; they stay a DataFrame
(``filter_invoices`` + ``detail_page``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolekta import vocab
from kolekta.functions import is_home_sql, money_sql, month_ord_sql, pct_sql, sql_str
from kolekta.operators import customers, history
from kolekta.operators.filters import active, active_filters, filter_invoices

AMT = "nilai_m"
KEYS = ("report_month", "pengelolaan", "region", "invoice_status", "status_tagih", "aging_category")
# Grouping sets over the pre-aggregate: (name, grouping columns).
SETS = (("flow", ("status_tagih", "aging_category", "invoice_status", "_keep", "_is_home")),
        ("seg", ("pengelolaan",)), ("cat", ("invoice_status",)), ("reg", ("region",)),
        ("mon", ("report_month",)), ("rgf", ("_regional_region",)))
_MARK = {"flow": "aging_category", "seg": "pengelolaan", "reg": "region", "mon": "report_month",
         "rgf": "_regional_region"}


SPARKLINES = (("overdue_pct", "overdue_pct"), ("dso", "dso"), ("months", "month_label"))


def dashboard_rows(f: DataFrame, home: str = vocab.HOME_REGION) -> DataFrame:
    """Rows (dim, key, status, aging, category, keep, is_home, t, l, tl, b, n):
    amount, status sums and row count per group of each grouping set. One SQL
    statement over the filtered fact rows."""
    keys = ", ".join(KEYS)
    count = "sum(records)" if "records" in f.columns else "count(1)"   # the mart carries its row counts
    cols = list(dict.fromkeys(c for _, cs in SETS for c in cs))
    sets = ", ".join("(" + ", ".join(cs) + ")" for _, cs in SETS)
    st = lambda v: f"sum(CASE WHEN status_tagih = {sql_str(v)} THEN _s END)"
    name = "CASE " + " ".join(f"WHEN grouping({mark}) = 0 THEN '{n}'" for n, mark in _MARK.items()) + " ELSE 'cat' END"
    key = ("CASE WHEN dim = 'seg' THEN pengelolaan WHEN dim = 'cat' THEN invoice_status WHEN dim = 'reg' THEN region "
           "WHEN dim = 'mon' THEN report_month WHEN dim = 'rgf' THEN _regional_region END")
    return f.sparkSession.sql(f"""
        WITH pre AS (
          SELECT {keys}, sum(cast({AMT} AS decimal(38,6))) AS _s, {count} AS _n FROM {{f}} GROUP BY {keys}),
        flagged AS (
          SELECT *, NOT (status_tagih <=> {sql_str(vocab.TIDAK_LAYAK)}) AS _keep, {is_home_sql("region", home)} AS _is_home
          FROM pre),
        g AS (
          SELECT {", ".join(cols)}, {name} AS dim, sum(_s) AS t, {st(vocab.LAYAK)} AS l, {st(vocab.TIDAK_LAYAK)} AS tl,
                 {st(vocab.BERMASALAH)} AS b, sum(_n) AS n
          FROM (SELECT *, CASE WHEN _keep AND NOT _is_home THEN region END AS _regional_region FROM flagged)
          GROUP BY GROUPING SETS ({sets}))
        SELECT dim, {key} AS key, status_tagih, aging_category, invoice_status, _keep, _is_home, t, l, tl, b, n
        FROM g WHERE dim = 'flow' OR ({key}) IS NOT NULL""", f=f)


def _in(values) -> str:
    return "(" + ", ".join(sql_str(v) for v in values) + ")"


def _sum_sql(cond: str) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN t END), cast(0 as decimal(38,6)))"


def _rows_sql(cond: str, fields: str) -> str:
    return f"array_sort(collect_list(CASE WHEN {cond} THEN named_struct({fields}) END))"


def measure_sql() -> dict[str, str]:
    """Every global measure and chart list over the grouping-set rows, as SQL
    text (one expression per measure; built once, parsed by the JVM)."""
    flow, keep_home = "dim = 'flow'", "dim = 'flow' AND _keep AND _is_home"
    st = lambda v: f"{flow} AND status_tagih = {sql_str(v)}"
    m = {"_total": _sum_sql(flow), "_layak": _sum_sql(st(vocab.LAYAK)), "_tidak": _sum_sql(st(vocab.TIDAK_LAYAK)),
         "_bermasalah": _sum_sql(st(vocab.BERMASALAH)), "_home": _sum_sql(keep_home),
         "_regional": _sum_sql("dim = 'flow' AND _keep AND NOT _is_home"),
         "_sudah": _sum_sql(f"{keep_home} AND invoice_status IN {_in(vocab.SUDAH_CATS)}"),
         "_belum": _sum_sql(f"{keep_home} AND invoice_status IN {_in(vocab.BELUM_CATS)}"),
         "_count": "cast(coalesce(sum(CASE WHEN dim = 'flow' THEN n END), 0) as bigint)",
         "_reg_total": _sum_sql("dim = 'reg'"),
         "_seg": _rows_sql("dim = 'seg'", "'k', key, 'v', cast(round(t, 4) as double)"),
         "_best": "min(CASE WHEN dim = 'seg' THEN named_struct('nv', -round(t, 4), 'k', key) END)",
         "_cat": _rows_sql("dim = 'cat'", "'k', key, 'v', cast(round(t, 4) as double)"),
         "_reg": _rows_sql("dim = 'reg' AND t > 0", "'k', key, 't', t"),
         "_rgf": _rows_sql("dim = 'rgf' AND t > 0", "'k', key, 'v', cast(round(t, 4) as double)"),
         "_mon": _rows_sql("dim = 'mon'", "'m', key, 't', t, 'l', l, 'tl', tl, 'b', b")}
    m.update({f"_c{i}": _sum_sql(f"{keep_home} AND invoice_status = {sql_str(c)}") for i, c in enumerate(vocab.CATEGORIES)})
    m.update({f"_g{i}": _sum_sql(f"{flow} AND aging_category = {sql_str(b)}") for i, b in enumerate(vocab.AGING_BUCKETS)})
    return m


def dashboard_measures(rows: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """One row: every global measure plus each chart's (sorted) list (and any
    ``extra`` aggregates, as SQL text, over the same rows). The latest month
    is taken over the month rows, parsing each label once."""
    m = measure_sql()
    m.update(extra or {})
    o = month_ord_sql("key", "spark")
    m["_latest"] = f"max(CASE WHEN dim = 'mon' AND {o} IS NOT NULL THEN named_struct('o', {o}, 'm', key) END)"
    select = ", ".join(f"{v} AS {k}" for k, v in m.items()).replace("{", "{{").replace("}", "}}")
    return rows.sparkSession.sql("SELECT " + select + " FROM {rows}", rows=rows)   # braces escaped for the template


def _tagged(df: DataFrame, name: str, order: str) -> DataFrame:
    """One struct column ``name`` per row, its first field the sort key."""
    rest = [c for c in df.columns if c != order]
    return df.select(F.struct(order, *rest).alias(name))


def dashboard_payload(inv: DataFrame, cust: DataFrame, inflow: DataFrame, trend: DataFrame, metrics: DataFrame,
                      month=None, segment=None, region=None, home: str = vocab.HOME_REGION) -> DataFrame:
    f = filter_invoices(inv, month, segment, region)
    # All parts are appended into one frame (each fills only its own column)
    # and gathered by ONE global aggregate: one plan, no joins, no subqueries.
    parts = [_tagged(customers.top_customers(cust, month), "_top_row", "rank"),
             _tagged(inflow, "_inflow_row", "sort_order"), _tagged(trend, "_trend_row", "sort_order"),
             _tagged(metrics.select("sort_order", "month_label", "overdue_pct", "dso"), "_metric_row", "sort_order")]
    u = dashboard_rows(f, home)
    for p in parts:
        u = u.unionByName(p, allowMissingColumns=True)
    gather = lambda col: f"array_sort(collect_list({col}))"  # noqa: E731   (nulls are skipped)
    base = dashboard_measures(u, {"_top": gather("_top_row"), "_inflow": gather("_inflow_row"),
                                  "_trend": gather("_trend_row"), "_metrics": gather("_metric_row")})
    return base.selectExpr(*payload_sql(month, segment, region, home))


def payload_sql(month=None, segment=None, region=None, home: str = vocab.HOME_REGION) -> list[str]:
    """The nested payload built from the measures row, as SQL text."""
    over = "(_tidak + _bermasalah)"
    filters = active_filters(month, segment, region)
    as_of = sql_str(month) if active(month) else "_latest.m"
    summary = (
        f"named_struct('total_ar_m', {money_sql('_total')}, 'total_layak_tagih_m', {money_sql('_layak')}, "
        f"'total_tidak_layak_m', {money_sql('_tidak')}, 'total_bermasalah_m', {money_sql('_bermasalah')}, "
        f"'over_due_m', {money_sql(over)}, 'overdue_pct', {pct_sql(over, '_total')}, "
        f"'largest_segment', coalesce(_best.k, '-'), 'dso', {vocab.DSO_CONSTANT}, 'as_of_date', {as_of}, "
        f"'total_records', _count, 'active_filters', named_struct("
        + ", ".join(f"{sql_str(k)}, {sql_str(v)}" for k, v in filters.items()) + ")) AS summary")
    status_col = {vocab.LAYAK: "_layak", vocab.BERMASALAH: "_bermasalah", vocab.TIDAK_LAYAK: "_tidak"}
    age = ", ".join(f"{sql_str(lbl)}, {money_sql(status_col[val] if col == 'status_tagih' else '_g%d' % vocab.AGING_BUCKETS.index(val))}"
                    for _, lbl, col, val in vocab.AGE_ANALYSIS)
    cats = ", ".join(f"named_struct('k', {sql_str(c)}, 's', _c{i})" for i, c in enumerate(vocab.CATEGORIES))
    home_cats = f"map_from_entries(transform(filter(array({cats}), x -> x.s > 0), x -> struct(x.k, {money_sql('x.s')})))"
    ar_flow = (f"named_struct('total_m', {money_sql('_total')}, 'tidak_layak_m', {money_sql('_tidak')}, "
               f"'layak_tagih_m', {money_sql('_layak')}, 'bermasalah_m', {money_sql('_bermasalah')}, "
               f"'regional', named_struct('total_m', {money_sql('_regional')}, 'breakdown', map_from_entries(_rgf)), "
               f"{sql_str(home.lower().strip())}, named_struct('total_m', {money_sql('_home')}, "
               f"'sudah_invoice_m', {money_sql('_sudah')}, 'belum_invoice_m', {money_sql('_belum')}, "
               f"'categories', {home_cats}))")
    region_breakup = (f"transform(_reg, x -> named_struct('region', x.k, 'value', {money_sql('x.t')}, "
                      f"'percentage', {pct_sql('x.t', '_reg_total', '<>')}))")
    z = "cast(0 as decimal(38,6))"
    history_trend = (f"map_from_entries(transform(_mon, x -> struct(x.m, named_struct('total_m', {money_sql('x.t')}, "
                     f"'layak_m', {money_sql(f'coalesce(x.l, {z})')}, 'tidak_layak_m', {money_sql(f'coalesce(x.tl, {z})')}, "
                     f"'bermasalah_m', {money_sql(f'coalesce(x.b, {z})')}))))")
    sparklines = ", ".join(f"'sparkline_{name}', transform(_metrics, x -> x.{col})" for name, col in SPARKLINES)
    charts = (f"named_struct('age_analysis', map({age}), 'segment_breakdown', map_from_entries(_seg), "
              f"'category_breakdown', map_from_entries(_cat), 'region_breakup', {region_breakup}, "
              f"'ar_flow', {ar_flow}, 'history_trend', {history_trend}, 'cash_inflow', _inflow, "
              f"'trend_t13m', _trend, {sparklines}) AS charts")
    # Action plan: uncollectible compares its raw sum, the others the rounded
    # values the flow exposes (a category exists only when its raw sum is > 0).
    amounts = {vocab.TIDAK_LAYAK: "_tidak", "REGIONAL": "round(_regional, 4)"}
    amounts.update({c: f"CASE WHEN _c{i} > 0 THEN round(_c{i}, 4) ELSE 0 END" for i, c in enumerate(vocab.CATEGORIES)})
    plan = ", ".join(f"named_struct('ord', {o}, 'kategori', {sql_str(k)}, '_v', cast({amounts.get(k, '0')} as decimal(38,6)), "
                     f"'uic', {sql_str(u)}, 'tindak_lanjut', {sql_str(t)}, 'due_date', {sql_str(dd)})"
                     for o, k, u, t, dd in vocab.ACTION_PLAN)
    action_plan = (f"transform(filter(array({plan}), x -> x._v > 0), x -> named_struct('ord', x.ord, "
                   f"'kategori', x.kategori, 'nilai_m', {money_sql('x._v')}, 'uic', x.uic, 'tindak_lanjut', x.tindak_lanjut, "
                   f"'due_date', x.due_date)) AS action_plan")
    return [summary, charts, action_plan, "_top AS top_customers"]


def payload_json(payload: DataFrame) -> DataFrame:
    return payload.select(F.to_json(F.struct(*payload.columns)).alias("json"))


def _number(path: str, value: str) -> str:
    return f"struct({path} AS path, cast({value} AS double) AS num, cast(NULL AS string) AS txt)"


def _text(path: str, value: str) -> str:
    return f"struct({path} AS path, cast(NULL AS double) AS num, cast({value} AS string) AS txt)"


def payload_values(payload: DataFrame) -> DataFrame:
    """The payload as (path, num, txt) rows, one for each leaf, so that any
    engine can compare it. List entries are named by their key or place."""
    def fields(struct: str, names, path: str, make):
        return [make(f"concat({path}, '.{n}')", f"{struct}.{n}") for n in names]

    def mapped(column: str) -> str:
        return f"transform(map_entries({column}), e -> {_number(f"concat('{column}.', e.key)", 'e.value')})"

    def listed(column: str, key: str, numbers, texts=()) -> str:
        path = f"concat('{column}.', cast(e.{key} AS string))"
        return f"flatten(transform({column}, e -> array({', '.join(fields('e', numbers, path, _number) + fields('e', texts, path, _text))})))"

    types = {f.name: f.dataType for f in payload.schema["charts"].dataType["ar_flow"].dataType.fields}
    home = next(n for n in types if n not in ("regional",) and hasattr(types[n], "fields"))
    flow = "charts.ar_flow"
    scalars = (fields("summary", ("total_ar_m", "total_layak_tagih_m", "total_tidak_layak_m", "total_bermasalah_m", "over_due_m",
                                  "overdue_pct", "dso", "total_records"), "'summary'", _number)
               + fields("summary", ("largest_segment", "as_of_date"), "'summary'", _text)
               + fields("summary.active_filters", ("month", "segment", "region"), "'summary.active_filters'", _text)
               + fields(flow, ("total_m", "tidak_layak_m", "layak_tagih_m", "bermasalah_m"), f"'{flow}'", _number)
               + fields(f"{flow}.{home}", ("total_m", "sudah_invoice_m", "belum_invoice_m"), f"'{flow}.{home}'", _number)
               + fields(f"{flow}.regional", ("total_m",), f"'{flow}.regional'", _number))
    trend = ", ".join(_number(f"concat('charts.history_trend.', e.key, '.{n}')", f"e.value.{n}")
                      for n in ("total_m", "layak_m", "tidak_layak_m", "bermasalah_m"))
    sparks = [f"transform(charts.sparkline_{n}, (v, i) -> {make(f"concat('charts.sparkline_{n}.', cast(i + 1 AS string))", 'v')})"
              for (n, _), make in zip(SPARKLINES, (_number, _number, _text))]
    parts = [f"array({', '.join(scalars)})",
             *map(mapped, ("charts.age_analysis", "charts.segment_breakdown", "charts.category_breakdown",
                           f"{flow}.{home}.categories", f"{flow}.regional.breakdown")),
             listed("charts.region_breakup", "region", ("value", "percentage")),
             f"flatten(transform(map_entries(charts.history_trend), e -> array({trend})))",
             listed("charts.cash_inflow", "sort_order", ("actual_receipts", "estimated_receipts", "forecasted_receipts"), ("month_label",)),
             listed("charts.trend_t13m", "sort_order", ("within_due", "over_due", "credit_sales"), ("month_label",)),
             *sparks, listed("action_plan", "kategori", ("ord", "nilai_m"), ("uic", "tindak_lanjut", "due_date")),
             listed("top_customers", "rank", ("balance", "within_due", "over_due", "overdue_pct", "due_invoices", "above_credit_limit"),
                    ("customer_name", "report_month"))]
    return payload.selectExpr(f"inline(concat({', '.join(parts)}))")
