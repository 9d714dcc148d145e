"""Column-level helpers. All return native Spark ``Column`` expressions, so they
stay inside whole-stage codegen; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolekta import vocab

ColLike = Column | str


def _c(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: ColLike, scale: int = 4) -> Column:
    """Round a decimal amount and hand it out as double (rounding happens on the
    exact decimal, so the result does not depend on summation order)."""
    return F.round(_c(c), scale).cast("double")


def total(c: ColLike, cond: Column | None = None) -> Column:
    """``S(p)``: sum of the amount where ``cond`` holds; 0 when nothing matches."""
    # Widened before summing: a sum over ~1e12 rows must not overflow
    # decimal(28,6); Spark keeps the arithmetic long-backed while values are small.
    amt = _c(c).cast("decimal(38,6)")
    return F.coalesce(F.sum(amt if cond is None else F.when(cond, amt)), F.lit(0))


def sql_str(v: str) -> str:
    """A SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sum_if(cond: str | None = None, amount: str = "nilai_m") -> Column:
    """``S(p)`` as one SQL expression (one call into the JVM, however long the
    condition): exact decimal sum of the amount where ``cond`` holds, 0 when
    nothing matches. Widened to decimal(38,6) so huge tables cannot overflow."""
    a = f"cast({amount} as decimal(38,6))"
    inner = a if cond is None else f"CASE WHEN {cond} THEN {a} END"
    return F.expr(f"coalesce(sum({inner}), cast(0 as decimal(38,6)))")


def values_frame(spark, rows, columns: tuple[str, ...]):
    """A small fixed dimension (a vocabulary) as a SQL VALUES relation."""
    def lit(v):
        return "NULL" if v is None else (sql_str(v) if isinstance(v, str) else repr(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def money_sql(x: str, scale: int = 4) -> str:
    return f"cast(round({x}, {scale}) as double)"


def pct_sql(num: str, den: str, positive_only: bool = True) -> str:
    op = ">" if positive_only else "<>"
    return (f"CASE WHEN cast({den} as double) {op} 0 THEN round(cast({num} as double) / cast({den} as double) * 100, 2) "
            f"ELSE 0.0 END")


def safe_pct(num: ColLike, den: ColLike, scale: int = 2, positive_only: bool = True) -> Column:
    """``num / den * 100`` rounded; 0.0 unless the denominator is > 0 (or != 0)."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    guard = d > 0 if positive_only else d != 0
    return F.when(guard, F.round(n / d * 100, scale)).otherwise(F.lit(0.0))


_WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: ColLike) -> Column:
    """Trim leading/trailing whitespace (spaces, tabs, line breaks) -- a
    character-set trim, no regular expression."""
    return F.btrim(_c(c).cast("string"), F.lit(_WHITESPACE))


def safe_str(c: ColLike, max_len: int, default: str | None = None) -> Column:
    """Trim then cut to ``max_len``; blank is null (Oracle stores '' as NULL),
    unless a default is given."""
    v = F.nullif(F.substring(strip(c), 1, max_len), F.lit(""))
    return v if default is None else F.coalesce(v, F.lit(default))


def norm(c: ColLike) -> Column:
    """Normalised text for comparisons: lower(trim())."""
    return F.lower(strip(c))


_WHITESPACE_SQL = r" \t\n\r\u000B\u000C"   # the same set, as Spark SQL escapes


def strip_sql(x: str) -> str:
    return f"btrim(cast({x} as string), '{_WHITESPACE_SQL}')"


def safe_str_sql(x: str, max_len: int, default: str | None = None) -> str:
    """``safe_str`` as Spark SQL text."""
    v = f"nullif(substring({strip_sql(x)}, 1, {max_len}), '')"
    return v if default is None else f"coalesce({v}, {sql_str(default)})"


def is_home_sql(region: str = "region", home: str = vocab.HOME_REGION) -> str:
    """``is_home`` as Spark SQL text."""
    return f"coalesce(lower(btrim({region}, '{_WHITESPACE_SQL}')) = {sql_str(home.lower().strip())}, false)"


def is_home(region: ColLike = "region", home: str = vocab.HOME_REGION) -> Column:
    """Home-region test; a null region is never home."""
    return F.coalesce(norm(region) == F.lit(home.lower().strip()), F.lit(False))


def not_equal_ns(c: ColLike, value: str) -> Column:
    """Null-safe inequality: true for null (pandas ``!=`` semantics)."""
    return ~_c(c).eqNullSafe(F.lit(value))


# A decimal number as text: sign, digits with an optional point, exponent. Type
# suffixes (12d), hexadecimal, NaN and infinities are no numbers here.
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _digits_sql(x: str) -> str:
    """Trimmed text without underscores between digits."""
    return f"regexp_replace({strip_sql(x)}, '(?<=[0-9])_(?=[0-9])', '')"


def is_number_sql(x: str) -> str:
    """Whether text is a decimal number (null for null)."""
    return f"{_digits_sql(x)} rlike '{_NUMBER}'"


def amount_sql(x: str, kind: str = "decimal(38,18)") -> str:
    """Text -> exact decimal; null for what is no number, and for numbers out of range."""
    return f"CASE WHEN {is_number_sql(x)} THEN try_cast({_digits_sql(x)} AS {kind}) END"


def ora_date(c: ColLike) -> Column:
    """``TO_DATE(x, 'DD-MON-YY')``."""
    return F.to_date(_c(c), "dd-MMM-yy")


# Month labels look like "Agustus 2026", "JUNI 2026", "May 2020" or "May 19".
_MONTH_LABEL = r"^\s*([A-Za-z]+)\.?\s+(\d{2}|\d{4})\s*$"


def month_ord(c: ColLike = "report_month") -> Column:
    """Month label -> ``year * 12 + month`` (null when the label does not parse)."""
    lbl = _c(c)
    name = F.lower(F.regexp_extract(lbl, _MONTH_LABEL, 1))
    year_txt = F.regexp_extract(lbl, _MONTH_LABEL, 2)
    months = F.create_map(*[x for k, v in vocab.MONTH_NAMES for x in (F.lit(k), F.lit(v))])
    month = F.try_element_at(months, name)
    year = year_txt.try_cast("int")
    year = F.when(F.length(year_txt) == 2, year + 2000).otherwise(year)
    return (year * 12 + month).cast("int")


def month_ord_sql(c: str = "report_month", dialect: str = "duckdb") -> str:
    """The same rule as SQL text. DuckDB keeps backslashes in string literals;
    Spark SQL treats them as escapes, so they are doubled for it."""
    pattern = _MONTH_LABEL.replace("\\", "\\\\") if dialect == "spark" else _MONTH_LABEL
    name = f"lower(regexp_extract({c}, '{pattern}', 1))"
    year = f"regexp_extract({c}, '{pattern}', 2)"
    cases = " ".join(f"when '{k}' then {v}" for k, v in vocab.MONTH_NAMES)
    yr = f"(case when length({year}) = 2 then cast({year} as integer) + 2000 when length({year}) = 4 then cast({year} as integer) end)"
    return f"cast({yr} * 12 + (case {name} {cases} end) as integer)"
