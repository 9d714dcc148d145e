"""Property test of the sheet import: random small sheets against a direct
Python statement of the rules (ranges from row-0 labels, six brackets per
valid category, numeric non-zero cells only, key and amount formats)."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kolekta import vocab
from kolekta.operators import ingest

# Sheet layout: identity columns, KONTRAK (6 columns + 1 extra), an unknown
# label (2 columns), TERMYN (3 columns: a short range).
COLUMNS = ["NAME", "CA", "a0", "a1", "a2", "a3", "a4", "a5", "a6", "x0", "x1", "t0", "t1", "t2"]
LABELS = [None, None, "KONTRAK", None, None, None, None, None, None, "TOTAL", None, " TERMYN ", None, None]
CELL = st.one_of(st.none(), st.sampled_from(["n/a", "", "NaN", "0", "0.0", " 12 ", "1e3", "-5", "inf", "12d", "3f", "0x1p3", "1_000", "_1", ".5", "7.", "+4", "1e25"]),
                 st.decimals(min_value=-10**12, max_value=10**12, places=2, allow_nan=False).map(str))
ROW = st.tuples(st.sampled_from(["Cust A", " Cust B ", "", None]), st.sampled_from(["123456789", "77", " ", None]),
                *[CELL] * (len(COLUMNS) - 2))


def expected(rows, month="Juni 2026"):
    ranges, current = {}, None
    for idx, lab in enumerate(LABELS):
        if lab is not None:
            current = lab.strip()
            ranges[current] = [idx, len(LABELS)]
        if current is not None:
            ranges[current][1] = idx + 1
    out = set()
    for row_idx, row in enumerate(rows):
        for cat, (start, end) in ranges.items():
            if cat not in vocab.CATEGORIES:
                continue
            for off in range(6):
                col = start + off
                if col >= end:
                    continue
                raw = row[col]
                try:
                    v = float(raw)
                except (TypeError, ValueError):
                    continue
                if v == 0 or v != v or abs(v) >= 1e20:   # infinite, or too large to store: rejected
                    continue
                ca = (row[1] or "").strip()[:30]
                amount = (Decimal(raw.strip().replace("_", "")) / Decimal(10**9)).quantize(Decimal("0.000001"), rounding=ROUND_HALF_UP)
                key = f"{month[:3].upper()}{ca[:8]}-{cat[:4]}-{off}-{row_idx}"[:50]
                _, _, aging, status = vocab.BRACKETS[off]
                out.add((key, cat, aging, status, float(amount), ((row[0] or "").strip() or None)))
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=12))
def test_import_matches_rules(spark, rows):
    data = [(i, "OI 202606", 0, *r) for i, r in enumerate(rows)]
    schema = "row_idx long, sheet string, sheet_pos int, " + ", ".join(f"`{c}` string" for c in COLUMNS)
    wide = spark.createDataFrame(data, schema)
    header = spark.createDataFrame([(i, c, lab) for i, (c, lab) in enumerate(zip(COLUMNS, LABELS))],
                                   "idx int, name string, label string")
    got = {(r.invoice_id, r.invoice_status, r.aging_category, r.status_tagih, float(r.nilai_m), r.customer_name)
           for r in ingest.import_open_items(wide, header).collect()}
    assert got == expected(rows)
