"""Scalar column functions (rounding, text normalisation, parsing, month ordinals)."""

from kolekta.functions.scalar import (  # noqa: F401
    amount_sql, is_number_sql, is_home, money, month_ord, month_ord_sql, norm, not_equal_ns,
    ora_date, safe_pct, safe_str, strip, total, sum_if, money_sql, pct_sql, sql_str, values_frame, is_home_sql, strip_sql, safe_str_sql,
)
