"""Column expressions for money, dates, rounding and ratios.

All are built-in Spark expressions (JVM side, whole-stage codegen); none is a
UDF. The rounding and division rules are chosen so Spark and an ANSI SQL
engine give the same digits (see ``round_half_up``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from resalekit.sources.schemas import MONEY

DAYS_PER_YEAR = 365.25
# Doubles at or above this magnitude cannot pass through decimal(38,10); they
# are returned unrounded (this includes +/-inf from overflowing powers).
_ROUNDABLE_LIMIT = 1e27


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_up(col, scale: int) -> Column:
    """ROUND(x, scale) half away from zero on the decimal value of ``x``.

    Rounding a double directly differs between engines (1.005 -> 1.01 in one,
    1.0 in another); going through decimal(38,10) first makes both agree.
    Returns a double; non-finite or huge values pass through unrounded.
    """
    x = _c(col).cast("double")
    return F.when(F.abs(x) < F.lit(_ROUNDABLE_LIMIT),
                  F.round(x.cast("decimal(38,10)"), scale).cast("double")).otherwise(x)


def safe_div(num, den) -> Column:
    """num / NULLIF(den, 0) in double (no divide-by-zero error under ANSI)."""
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def pct_change(new, old) -> Column:
    """100 * (new - old) / NULLIF(old, 0), as a double; the difference is
    taken exactly (decimal) before the single conversion to double."""
    diff = (_c(new) - _c(old)) * F.lit(100)
    return safe_div(diff, old)


def days_between(end, start) -> Column:
    """Whole days from ``start`` to ``end`` (date - date in SQL)."""
    return F.date_diff(_c(end), _c(start))


def years_between(end, start, days_per_year: float = DAYS_PER_YEAR) -> Column:
    """Fractional years: days / 365.25, as a double."""
    return days_between(end, start).cast("double") / F.lit(days_per_year)


def _strict(text: Column, parsed: Column, what: str, on_error: str) -> Column:
    """``parsed``; where there is a text that gave nothing, an error unless
    ``on_error`` is 'null'. Does not depend on the session's ANSI setting."""
    if on_error == "null":
        return parsed
    if on_error != "raise":
        raise ValueError("on_error must be 'raise' or 'null'")
    return F.when(text.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit(f"not {what}: "), text))).otherwise(parsed)


def parse_money(col, on_error: str = "raise") -> Column:
    """Money text -> decimal(18,2): keep digits and dots only, empty -> NULL.

    '-5' parses as 5 and 'POA' as NULL. A leftover like '1.2.3' or '.' is not
    a number: ``on_error='raise'`` fails the job, ``'null'`` maps it to NULL.
    """
    digits = F.nullif(F.regexp_replace(_c(col), r"[^0-9.]", ""), F.lit(""))
    return _strict(digits, digits.try_cast(MONEY), "money", on_error)


def parse_date(col, formats: list[str] | tuple[str, ...] | None = None,
               on_error: str = "raise") -> Column:
    """Text -> date. Default: the SQL cast (ISO 'yyyy-MM-dd', optionally
    followed by a time). ``formats`` tries each pattern in turn. A text that
    none of them reads fails the job, or is NULL with ``on_error='null'``."""
    c = _c(col)
    tries = [F.try_to_date(c, f) for f in formats] if formats else [c.try_cast("date")]
    return _strict(c, F.coalesce(*tries), "a date", on_error)


def year_of(col) -> Column:
    return F.year(_c(col)).cast("int")


def growth_power(ratio, exponent) -> Column:
    """POWER(ratio, exponent) in double. Arbitrary-precision powers are not
    available; an overflow gives +inf, which still compares as 'large'."""
    return F.pow(_c(ratio).cast("double"), _c(exponent).cast("double"))
