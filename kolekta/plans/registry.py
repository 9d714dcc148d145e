"""Registered queries: one per operator of the inventory, each a callable
``(spark, sf_dir) -> DataFrame`` over the stand-in views of the driver's
tables, paired with equivalent DuckDB SQL where SQL can express it.

Amount columns leave as ``double`` (rounded on the decimal first) so both
engines hash to the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from kolekta import vocab
from kolekta.operators import cubes, customers, filters, flow, history, paging, summary
from kolekta.plans.oracle_sql import (HOME, KEEP, M, MONTH_ORD, PCT, S, ST, TOP_CUST, WITH_INV, INFLOW, METRICS,
                                      TREND, fact_select, filters_sql, in_list, q, where)
from kolekta.sources.fixtures import Fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Filter values used by the filtered queries (present in every scale factor).
MONTH, SEGMENT, REGION = "Juni 1998", "BUILDING", "EUROPE"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def out(df: DataFrame) -> DataFrame:
    """Decimals leave as double."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def inv(spark, sf) -> DataFrame:
    return Fixtures(spark, sf).invoices()


# --- KPIs -------------------------------------------------------------------

_G4 = (f"select {S()} as _total, {S(ST(vocab.LAYAK))} as _layak, {S(ST(vocab.TIDAK_LAYAK))} as _tidak, "
       f"{S(ST(vocab.BERMASALAH))} as _bermasalah, count(*) as _n from ar_invoice")


@register("kpi_summary", f"""{WITH_INV}, g as ({_G4})
select {M('_total')} as total_ar_m, {M('_layak')} as total_layak_tagih_m, {M('_tidak')} as total_tidak_layak_m,
 {M('_bermasalah')} as total_bermasalah_m, {M('_tidak + _bermasalah')} as over_due_m,
 {PCT('_tidak + _bermasalah', '_total')} as overdue_pct, cast({vocab.DSO_CONSTANT} as integer) as dso,
 cast(_n as bigint) as total_records from g""")
def _kpi_summary(spark, sf):
    return summary.kpi_summary(inv(spark, sf))


@register("minimal_summary", f"""{WITH_INV}, g as ({_G4})
select {M('_total', 2)} as total_ar_m, {M('_layak', 2)} as total_layak_tagih_m, {M('_tidak', 2)} as total_tidak_layak_m,
 cast(_n as bigint) as total_records from g""")
def _minimal_summary(spark, sf):
    return summary.minimal_summary(inv(spark, sf))


@register("kpi_by_aging", f"""{WITH_INV}
select {M(S())} as total_ar_m, {M(S("aging_category = 'Within Due'"))} as within_due_m,
 {M(S("aging_category is distinct from 'Within Due'"))} as past_due_m from ar_invoice""")
def _kpi_by_aging(spark, sf):
    return summary.kpi_by_aging(inv(spark, sf))


@register("kpi_shares", f"""{WITH_INV}, g as ({_G4})
""" + "\nunion all\n".join(
    f"select {q(s)} as status_tagih, {M(c)} as v, {PCT(c, '_total')} as pct_of_total from g"
    for s, c in ((vocab.LAYAK, "_layak"), (vocab.BERMASALAH, "_bermasalah"), (vocab.TIDAK_LAYAK, "_tidak"))))
def _kpi_shares(spark, sf):
    return summary.kpi_shares(inv(spark, sf))


@register("kpi_cube", f"""{WITH_INV}
select case when grouping(report_month) = 1 then 'ALL' else report_month end as month,
 case when grouping(pengelolaan) = 1 then 'ALL' else pengelolaan end as segment,
 case when grouping(region) = 1 then 'ALL' else region end as region,
 {M(S())} as total_ar_m, {M(S(ST(vocab.LAYAK)))} as layak_m, {M(S(ST(vocab.TIDAK_LAYAK)))} as tidak_layak_m,
 {M(S(ST(vocab.BERMASALAH)))} as bermasalah_m, cast(count(*) as bigint) as n
from ar_invoice group by cube (report_month, pengelolaan, region)""")
def _kpi_cube(spark, sf):
    return cubes.kpi_cube(inv(spark, sf))


@register("as_of", f"""{WITH_INV}
select arg_max(report_month, {MONTH_ORD}) as as_of_date from ar_invoice""")
def _as_of(spark, sf):
    return summary.as_of(inv(spark, sf))


def _stack_sql(col: str) -> str:
    return f"""{WITH_INV}
select {col} as key, {M(S(ST(vocab.LAYAK)))} as layak_m, {M(S(ST(vocab.BERMASALAH)))} as bermasalah_m,
 {M(S(ST(vocab.TIDAK_LAYAK)))} as tidak_layak_m from ar_invoice where {col} is not null group by {col}"""


@register("stack_by_region", _stack_sql("region"))
def _stack_by_region(spark, sf):
    return summary.stack_by(inv(spark, sf), "region")


@register("stack_by_uic", _stack_sql("uic"))
def _stack_by_uic(spark, sf):
    return summary.stack_by(inv(spark, sf), "uic")


@register("critical_aging", f"""{WITH_INV}, g as (select {S()} as _t, {S("aging_category = '>90 Days'")} as _c from ar_invoice)
select {M('_c')} as critical_m, {PCT('_c', '_t')} as pct_of_total from g""")
def _critical_aging(spark, sf):
    return summary.critical_aging(inv(spark, sf))


@register("drill_rollup", f"""{WITH_INV}
select cast(3 - grouping(status_tagih) - grouping(region) - grouping(invoice_status) as integer) as level,
 case when grouping(status_tagih) = 1 then 'ALL' else status_tagih end as status_tagih,
 case when grouping(region) = 1 then 'ALL' else region end as region,
 case when grouping(invoice_status) = 1 then 'ALL' else invoice_status end as invoice_status,
 {M(S())} as v, cast(count(*) as bigint) as n
from ar_invoice group by rollup (status_tagih, region, invoice_status)""")
def _drill_rollup(spark, sf):
    return cubes.drill_rollup(inv(spark, sf))


@register("account_totals", f"""{WITH_INV}
select bp_num, customer_name, report_month, """ + ", ".join(
    f"{M(S(f'invoice_status = {q(c)}'))} as {summary.category_column(c)}" for c in vocab.CATEGORIES) + f""",
 {M(S("status_invoice = 'SUDAH INVOICE'"))} as sudah_invoice_m, {M(S())} as total_m
from ar_invoice group by bp_num, customer_name, report_month""")
def _account_totals(spark, sf):
    return summary.account_totals(inv(spark, sf))


# --- scans and filters ------------------------------------------------------

@register("scan_invoices", f"{WITH_INV} {fact_select()}{where(filters_sql(month=MONTH))}")
def _scan_invoices(spark, sf):
    return out(filters.filter_invoices(inv(spark, sf), month=MONTH))


@register("filter_invoices", f"{WITH_INV} {fact_select()}{where(filters_sql(MONTH, SEGMENT, REGION))}")
def _filter_invoices(spark, sf):
    return out(filters.filter_invoices(inv(spark, sf), MONTH, SEGMENT, REGION))


@register("base_projection", f"""{WITH_INV}
select invoice_id, coalesce(aging_category, '') as aging_category, coalesce(status_tagih, '') as status_tagih,
 coalesce(region, '') as region, coalesce(invoice_status, '') as invoice_status,
 cast(coalesce(nilai_m, 0) as double) as nilai_m, coalesce(uic, '') as uic, coalesce(due_date, '') as due_date,
 coalesce(action_plan, '') as action_plan from ar_invoice""")
def _base_projection(spark, sf):
    return out(filters.base_projection(inv(spark, sf)))


@register("filter_all", f"{WITH_INV} {fact_select()}")
def _filter_all(spark, sf):
    return out(filters.filter_invoices(inv(spark, sf), "ALL", "", None))


# --- breakdowns -------------------------------------------------------------

def _group_sql(key: str, value: str = "v", cond: str | None = None) -> str:
    return f"select {key}, {M(S())} as {value} from ar_invoice{where(f'{key} is not null', cond or '')} group by {key}"


@register("segment_breakdown", f"{WITH_INV} {_group_sql('pengelolaan')}")
def _segment_breakdown(spark, sf):
    return summary.segment_breakdown(inv(spark, sf))


@register("largest_segment", f"""{WITH_INV}, g as ({_group_sql('pengelolaan')})
select coalesce((select pengelolaan from g order by v desc, pengelolaan asc limit 1), '-') as largest_segment""")
def _largest_segment(spark, sf):
    return summary.largest_segment(inv(spark, sf))


@register("segment_rank", f"""{WITH_INV}, g as ({_group_sql('pengelolaan')})
select cast(row_number() over (order by v desc, pengelolaan asc) as bigint) as rank, pengelolaan, v,
 round(v / greatest(max(v) over (), 1.0) * 100, 2) as pct_of_max from g where v > 0""")
def _segment_rank(spark, sf):
    return summary.segment_rank(inv(spark, sf))


@register("age_analysis", f"""{WITH_INV}, g as (select """ + ", ".join(
    f"{S(f'{col} = {q(val)}')} as _a{o}" for o, _, col, val in vocab.AGE_ANALYSIS) + """ from ar_invoice)
""" + "\nunion all\n".join(
    f"select {o} as ord, {q(lbl)} as label, {M(f'_a{o}')} as v from g" for o, lbl, _, _ in vocab.AGE_ANALYSIS))
def _age_analysis(spark, sf):
    return summary.age_analysis(inv(spark, sf))


@register("category_breakdown", f"{WITH_INV} {_group_sql('invoice_status')}")
def _category_breakdown(spark, sf):
    return summary.category_breakdown(inv(spark, sf))


def _region_share_sql(cond: str | None = None) -> str:
    return f"""{WITH_INV}, g as (select region, {S()} as _s from ar_invoice{where('region is not null', cond or '')} group by region),
h as (select region, _s, sum(_s) over () as _tot from g)
select region, {M('_s')} as value, {PCT('_s', '_tot', positive_only=False)} as percentage from h where _s > 0"""


@register("region_breakup", _region_share_sql())
def _region_breakup(spark, sf):
    return summary.region_breakup(inv(spark, sf))


@register("region_overdue", _region_share_sql("aging_category is distinct from 'Within Due'"))
def _region_overdue(spark, sf):
    return summary.region_overdue(inv(spark, sf))


@register("region_cumshare", f"""{WITH_INV}, g as (select region, round({S()}, 4) as _v from ar_invoice
 where region is not null group by region having {S()} > 0),
h as (select region, _v, sum(_v) over (order by region rows between unbounded preceding and current row) as _run,
 sum(_v) over () as _tot from g)
select region, cast(_v as double) as value,
 round(cast(_run - _v as double) / cast(case when _tot = 0 then 1 else _tot end as double), 6) as start_share,
 round(cast(_run as double) / cast(case when _tot = 0 then 1 else _tot end as double), 6) as end_share from h""")
def _region_cumshare(spark, sf):
    return summary.region_cumshare(inv(spark, sf))


# --- flow ---------------------------------------------------------------------

_FLOW = (f"select {S()} as _total, {S(ST(vocab.TIDAK_LAYAK))} as _tidak, {S(ST(vocab.LAYAK))} as _layak, "
         f"{S(ST(vocab.BERMASALAH))} as _bermasalah, {S(f'{KEEP} and {HOME}')} as _home, "
         f"{S(f'{KEEP} and not {HOME}')} as _regional, "
         f"{S(f'{KEEP} and {HOME} and invoice_status in {in_list(vocab.SUDAH_CATS)}')} as _sudah, "
         f"{S(f'{KEEP} and {HOME} and invoice_status in {in_list(vocab.BELUM_CATS)}')} as _belum, "
         + ", ".join(f"{S(f'{KEEP} and {HOME} and invoice_status = {q(c)}')} as _c{i}"
                     for i, c in enumerate(vocab.CATEGORIES)) + " from ar_invoice")


@register("flow_levels", f"""{WITH_INV}, g as ({_FLOW})
select {M('_total')} as total_m, {M('_tidak')} as tidak_layak_m, {M('_layak')} as layak_tagih_m,
 {M('_bermasalah')} as bermasalah_m, {M('_home')} as home_total_m, {M('_regional')} as regional_total_m,
 {M('_sudah')} as sudah_invoice_m, {M('_belum')} as belum_invoice_m from g""")
def _flow_levels(spark, sf):
    return flow.flow_levels(inv(spark, sf))


@register("flow_categories", f"""{WITH_INV}, g as ({_FLOW}), l as (""" + "\nunion all\n".join(
    f"select {i + 1} as ord, {q(c)} as category, _c{i} as _s from g" for i, c in enumerate(vocab.CATEGORIES)) + f""")
select ord, category, {M('_s')} as v from l where _s > 0""")
def _flow_categories(spark, sf):
    return flow.flow_categories(inv(spark, sf))


@register("flow_regional", f"""{WITH_INV}
select region, {M('_s')} as v from (select region, {S()} as _s from ar_invoice
 where {KEEP} and not {HOME} and region is not null group by region) g where _s > 0""")
def _flow_regional(spark, sf):
    return flow.flow_regional(inv(spark, sf))


_FLOW_NODES = ([(1, "TOTAL", "_total"), (2, vocab.TIDAK_LAYAK, "_tidak"), (2, vocab.LAYAK, "_layak"),
                (2, vocab.BERMASALAH, "_bermasalah"), (3, vocab.HOME_REGION.upper(), "_home"),
                (3, "REGIONAL", "_regional"), (4, vocab.SUDAH_INVOICE, "_sudah"), (4, vocab.BELUM_INVOICE, "_belum")])


@register("flow_long", f"""{WITH_INV}, g as ({_FLOW}), l as (""" + "\nunion all\n".join(
    [f"select {lvl} as level, {q(node)} as node, round({c}, 4) as _v, round(_total, 4) as _t from g"
     for lvl, node, c in _FLOW_NODES]
    + [f"select 5 as level, {q(c)} as node, case when _c{i} > 0 then round(_c{i}, 4) end as _v, round(_total, 4) as _t from g"
       for i, c in enumerate(vocab.CATEGORIES)]) + f""")
select level, node, cast(_v as double) as v, {PCT('_v', '_t')} as pct_of_total from l where _v is not null""")
def _flow_long(spark, sf):
    return flow.flow_long(inv(spark, sf))


_PLAN_VALUES = ", ".join(f"({o}, {q(k)}, {q(u)}, {q(t)}, {q(d)})" for o, k, u, t, d in vocab.ACTION_PLAN)


@register("action_plan", f"""{WITH_INV}, g as ({_FLOW}), l as (
select {q(vocab.TIDAK_LAYAK)} as kategori, _tidak as _v from g
union all select 'REGIONAL', round(_regional, 4) from g
""" + "\n".join(f"union all select {q(c)}, case when _c{i} > 0 then round(_c{i}, 4) else 0 end from g"
               for i, c in enumerate(vocab.CATEGORIES)) + f"""),
d as (select * from (values {_PLAN_VALUES}) t(ord, kategori, uic, tindak_lanjut, due_date))
select d.ord, l.kategori, {M('l._v')} as nilai_m, d.uic, d.tindak_lanjut, d.due_date
from l join d on l.kategori = d.kategori where l._v > 0""")
def _action_plan(spark, sf):
    return flow.action_plan(inv(spark, sf))


# --- history ------------------------------------------------------------------

@register("history_trend", f"""{WITH_INV}
select report_month, {MONTH_ORD} as month_ord, {M(S())} as total_m, {M(S(ST(vocab.LAYAK)))} as layak_m,
 {M(S(ST(vocab.TIDAK_LAYAK)))} as tidak_layak_m, {M(S(ST(vocab.BERMASALAH)))} as bermasalah_m
from ar_invoice where report_month is not null group by report_month""")
def _history_trend(spark, sf):
    return history.history_trend(inv(spark, sf))


@register("history_stack", f"""{WITH_INV}, g as (select report_month, round({S(ST(vocab.LAYAK))}, 4) as layak_m,
 round({S(ST(vocab.BERMASALAH))}, 4) as bermasalah_m, round({S(ST(vocab.TIDAK_LAYAK))}, 4) as tidak_layak_m
 from ar_invoice where report_month is not null group by report_month),
l as (select report_month, 1 as _o, 'layak_m' as series, layak_m as _v from g
 union all select report_month, 2, 'bermasalah_m', bermasalah_m from g
 union all select report_month, 3, 'tidak_layak_m', tidak_layak_m from g),
w as (select *, sum(_v) over (partition by report_month order by _o rows between unbounded preceding and current row) as _y1 from l)
select report_month, series, cast(_v as double) as v, cast(_y1 - _v as double) as y0, cast(_y1 as double) as y1 from w""")
def _history_stack(spark, sf):
    return history.history_stack(inv(spark, sf))


@register("distinct_months", f"""{WITH_INV}
select cast(row_number() over (order by report_month desc) as bigint) as ord, report_month
from (select distinct report_month from ar_invoice where report_month is not null) m""")
def _distinct_months(spark, sf):
    return history.distinct_months(inv(spark, sf))


@register("months_chrono", f"""{WITH_INV}, m as (select distinct report_month from ar_invoice where report_month is not null)
select cast(row_number() over (order by {MONTH_ORD} asc nulls last, report_month asc) as bigint) as ord, report_month,
 {MONTH_ORD} as month_ord from m""")
def _months_chrono(spark, sf):
    return history.distinct_months(inv(spark, sf), chronological=True)


@register("distinct_segments", f"{WITH_INV} select distinct pengelolaan as value from ar_invoice where pengelolaan is not null")
def _distinct_segments(spark, sf):
    return filters.distinct_values(inv(spark, sf), "pengelolaan")


@register("distinct_regions", f"{WITH_INV} select distinct region as value from ar_invoice where region is not null and region <> ''")
def _distinct_regions(spark, sf):
    return filters.distinct_values(inv(spark, sf), "region", drop_blank=True)


@register("cash_inflow", f"select * from ({INFLOW}) t")
def _cash_inflow(spark, sf):
    return history.ordered(Fixtures(spark, sf).cash_inflow())


@register("trend_t13m", f"select * from ({TREND}) t")
def _trend_t13m(spark, sf):
    return history.ordered(Fixtures(spark, sf).trend_t13m())


@register("sparkline", f"select cast(sort_order as integer) as ord, month_label, overdue_pct, dso from ({METRICS}) t")
def _sparkline(spark, sf):
    return history.sparkline_rows(Fixtures(spark, sf).metrics_history())


@register("sparkline_scaled", f"""select sort_order, overdue_pct as v,
 round((overdue_pct - min(overdue_pct) over ()) / case when max(overdue_pct) over () - min(overdue_pct) over () = 0 then 1.0
  else max(overdue_pct) over () - min(overdue_pct) over () end, 6) as scaled from ({METRICS}) t""")
def _sparkline_scaled(spark, sf):
    return history.sparkline_scaled(Fixtures(spark, sf).metrics_history())


# --- customers ----------------------------------------------------------------

_OVER = "aging_category is distinct from 'Within Due'"


@register("customer_rollup", f"""{WITH_INV}, g as (select customer_name, report_month, {S()} as _b,
 {S("aging_category = 'Within Due'")} as _w, {S(_OVER)} as _o, count(case when {_OVER} then 1 end) as _n
 from ar_invoice where coalesce(trim(customer_name), '') <> '' group by customer_name, report_month)
select substr(customer_name, 1, 100) as customer_name, substr(report_month, 1, 20) as report_month,
 cast(round(_b * 1000, 2) as double) as balance, cast(round(_w * 1000, 2) as double) as within_due,
 cast(round(_o * 1000, 2) as double) as over_due,
 round(greatest(0.0, least(100.0, case when _b > 0 then cast(_o as double) / cast(_b as double) * 100 else 0.0 end)), 2) as overdue_pct,
 cast(_n as bigint) as due_invoices, cast(0 as integer) as above_credit_limit from g""")
def _customer_rollup(spark, sf):
    return customers.customer_rollup(inv(spark, sf))


@register("top_customers", f"""select *, cast(row_number() over (order by over_due desc nulls first, customer_name, report_month) as bigint) as rank
from (select * from ({TOP_CUST}) c order by over_due desc nulls first, customer_name, report_month limit {vocab.TOP_CUSTOMERS}) t""")
def _top_customers(spark, sf):
    return customers.top_customers(Fixtures(spark, sf).top_customers())


@register("customer_band", f"""select customer_name, report_month, overdue_pct,
 case when overdue_pct > {vocab.BAND_HIGH} then 'high' when overdue_pct > {vocab.BAND_MEDIUM} then 'medium' else 'low' end as band
from ({TOP_CUST}) c""")
def _customer_band(spark, sf):
    return customers.customer_band(Fixtures(spark, sf).top_customers())


# --- drill-down, search, paging ---------------------------------------------

_LAYAK = ST(vocab.LAYAK)
DRILLS = {
    "drill_status": ("status", vocab.BERMASALAH, ST(vocab.BERMASALAH)),
    "drill_home": ("home", None, f"{_LAYAK} and {HOME}"),
    "drill_regional": ("regional", None, f"{_LAYAK} and not {HOME}"),
    "drill_home_invoice": ("home_invoice", vocab.BELUM_INVOICE,
                           f"{_LAYAK} and {HOME} and status_invoice = {q(vocab.BELUM_INVOICE)}"),
    "drill_category": ("category", "KONTRAK", "invoice_status = 'KONTRAK'"),
    "drill_region_name": ("region", REGION, f"{_LAYAK} and not {HOME} and region = {q(REGION)}"),
    "drill_aging": ("aging", "31-60 Days", "aging_category = '31-60 Days'"),
}


def _drill(kind, value):
    return lambda spark, sf: out(filters.drilldown(inv(spark, sf), kind, value))


for _name, (_kind, _value, _cond) in DRILLS.items():
    register(_name, f"{WITH_INV} {fact_select()}{where(_cond)}")(_drill(_kind, _value))

SEARCH_Q = "12"


@register("search_invoices", f"{WITH_INV} {fact_select()} where " + " or ".join(
    f"contains(lower(coalesce({c}, '')), {q(SEARCH_Q)})" for c in vocab.SEARCH_COLUMNS))
def _search_invoices(spark, sf):
    return out(filters.search_invoices(inv(spark, sf), SEARCH_Q))


PAGE = 3
_DETAIL = ", ".join("cast(nilai_m as double) as nilai_m" if c == "nilai_m" else c for c in vocab.DETAIL_COLUMNS)


@register("detail_page", f"""{WITH_INV}
select invoice_id, {_DETAIL}, cast({PAGE} as bigint) as page,
 cast((select greatest(1, ceil(count(*) / {vocab.PAGE_SIZE})) from ar_invoice) as bigint) as pages
from ar_invoice order by invoice_id limit {vocab.PAGE_SIZE} offset {(PAGE - 1) * vocab.PAGE_SIZE}""")
def _detail_page(spark, sf):
    return out(paging.detail_page(inv(spark, sf), PAGE))


AFTER = "INV-2"


@register("page_after", f"{WITH_INV} select invoice_id, {_DETAIL} from ar_invoice where invoice_id > {q(AFTER)} "
                        f"order by invoice_id limit {vocab.PAGE_SIZE}")
def _page_after(spark, sf):
    return out(paging.page_after(inv(spark, sf), AFTER))


@register("table_head", f"{WITH_INV} select * from ({fact_select()}) t order by invoice_id limit {vocab.TABLE_HEAD}")
def _table_head(spark, sf):
    return out(paging.table_head(inv(spark, sf), vocab.TABLE_HEAD, ("invoice_id",)))


from kolekta.plans import registry_ingest  # noqa: E402,F401  (registers the ingest and table queries)
