"""Property tests: random small invoice sets (nulls, blanks, untrimmed home
regions, zero and negative amounts) against a plain-Python statement of the
dashboard's rules (sums skip nulls, ``!=`` is true for null, group-bys drop
null keys, shares use all regions before the positive filter)."""

from decimal import ROUND_HALF_UP, Decimal

from conftest import invoices
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kolekta import vocab
from kolekta.operators import flow, summary

STATUS = st.sampled_from(list(vocab.STATUSES) + [None])
REGION = st.sampled_from([" Jakarta ", "JAKARTA", "jakarta", "EUROPE", "ASIA", "", None])
CAT = st.sampled_from(list(vocab.CATEGORIES) + ["OTHER", None])
AGING = st.sampled_from(list(vocab.AGING_BUCKETS) + [None])
AMOUNT = st.one_of(st.none(), st.decimals(min_value=-50, max_value=500, places=6, allow_nan=False))
ROW = st.tuples(AGING, STATUS, REGION, CAT, AMOUNT)


def r4(x: Decimal) -> float:
    return float(x.quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP))


def s(rows, pred=lambda r: True) -> Decimal:
    return sum((r[4] for r in rows if pred(r) and r[4] is not None), Decimal(0))


def home(r) -> bool:
    return r[2] is not None and r[2].strip().lower() == vocab.HOME_REGION


def keep(r) -> bool:
    return r[1] != vocab.TIDAK_LAYAK


def frame(spark, rows):
    return invoices(spark, [(f"I{i}", *r) for i, r in enumerate(rows)])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=0, max_size=25))
def test_kpi_and_flow_follow_the_rules(spark, rows):
    df = frame(spark, rows)
    k = summary.kpi_summary(df).first()
    tot = s(rows)
    tl, b = s(rows, lambda r: r[1] == vocab.TIDAK_LAYAK), s(rows, lambda r: r[1] == vocab.BERMASALAH)
    assert k.total_ar_m == r4(tot) and k.total_records == len(rows)
    assert k.total_layak_tagih_m == r4(s(rows, lambda r: r[1] == vocab.LAYAK))
    assert k.over_due_m == r4(tl + b)
    expected_pct = round(float(tl + b) / float(tot) * 100, 2) if tot > 0 else 0.0
    assert abs(k.overdue_pct - expected_pct) < 0.0051
    lv = flow.flow_levels(df).first()
    assert lv.home_total_m == r4(s(rows, lambda r: keep(r) and home(r)))
    assert lv.regional_total_m == r4(s(rows, lambda r: keep(r) and not home(r)))
    cats = {r.category: r.v for r in flow.flow_categories(df).collect()}
    expect = {}
    for c in vocab.CATEGORIES:
        v = s(rows, lambda r, c=c: keep(r) and home(r) and r[3] == c)
        if v > 0:
            expect[c] = r4(v)
    assert cats == expect


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=0, max_size=25))
def test_region_breakup_follows_the_rules(spark, rows):
    got = {r.region: (r.value, r.percentage) for r in summary.region_breakup(frame(spark, rows)).collect()}
    regions = {r[2] for r in rows if r[2] is not None}
    sums = {g: s(rows, lambda r, g=g: r[2] == g) for g in regions}
    total = sum(sums.values(), Decimal(0))
    expect = {g: r4(v) for g, v in sums.items() if v > 0}
    assert {g: v for g, (v, _) in got.items()} == expect
    for g, (_, pct) in got.items():
        want = round(float(sums[g]) / float(total) * 100, 2) if total != 0 else 0.0
        assert abs(pct - want) < 0.0051
