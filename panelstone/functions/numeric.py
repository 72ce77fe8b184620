"""Column -> Column guards and arithmetic. Missing is never zero: every guard yields null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: denominators at or below this magnitude are treated as zero.
TINY = 1e-9
TIE_OFFSET = 3.7e-10
# Fixed value: variance floor below which a regression slope is undefined.
VAR_FLOOR = 1e-12
TRADING_DAYS = 252
ANNUALISE = TRADING_DAYS**0.5
SESSIONS_PER_MONTH = 21


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rd(x: Column | str, digits: int = 6) -> Column:
    """Round for reporting.

    The small offset keeps exact halves (common among ratios of counts) from tipping either way on the last bit; the trailing
    zero folds a negative zero into a positive one.
    """
    return F.round(c(x) + F.lit(TIE_OFFSET), digits) + F.lit(0.0)


def finite(x: Column | str) -> Column:
    """NaN and both infinities become null."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def div(num, den) -> Column:
    """Plain quotient; null where the denominator is zero."""
    as_column = lambda x: c(x) if isinstance(x, (str, Column)) else F.lit(float(x))
    return F.try_divide(as_column(num).cast("double"), as_column(den))


def safe_div(num, den, positive_only: bool = False, numerator_positive: bool = False) -> Column:
    """A ratio that is null whenever the denominator (or, on request, the numerator) is meaningless."""
    num, den = c(num), c(den)
    ok = (den > TINY) if positive_only else (F.abs(den) > TINY)
    if numerator_positive:
        ok = ok & (num > TINY)
    return F.when(ok, num / den)


def bounded(x, lo: float, hi: float) -> Column:
    """Null outside the closed interval. A value out of range is absent, not clipped."""
    x = c(x)
    return F.when(x.between(lo, hi), x)


def inside(x, lo: float, hi: float) -> Column:
    """Null outside the open interval."""
    x = c(x)
    return F.when((x > lo) & (x < hi), x)


def clip(x, lo, hi) -> Column:
    """Clamp to a range, keeping null as null (least/greatest alone would skip it)."""
    x = c(x)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def cagr(now, then, years: float) -> Column:
    """Compound growth; defined only when both ends are positive."""
    now, then = c(now), c(then)
    return F.when((now > TINY) & (then > TINY), F.pow(now / then, F.lit(1.0 / years)) - 1.0)


def either(*xs) -> Column:
    return F.coalesce(*[c(x) if isinstance(x, (str, Column)) else F.lit(x) for x in xs])


def zero_if_null(x) -> Column:
    return F.coalesce(c(x), F.lit(0.0))


def value_bucket(x) -> Column:
    """A data-independent, order-preserving bucket for doubles.

    Buckets are about 0.05 % wide in relative terms on either side of zero, so their number is fixed by the range of a double.
    Equal values share a bucket; infinities share the outermost ones, and NaN, the greatest value, that of positive infinity.
    Values of a narrow range share few buckets: whoever needs them apart cuts a bucket further by what it holds.
    """
    x = c(x).cast("double")
    size = F.least(F.greatest(F.abs(x), F.lit(1e-300)), F.lit(1.7e308))
    magnitude = F.floor((F.log(size) + 700.0) * 2000.0).cast("long")
    return F.when(x > 0, magnitude + 1).when(x < 0, -magnitude - 1).otherwise(F.lit(0).cast("long"))


def banded(x, edges: list[tuple[float, str]], below: str, missing: str | None) -> Column:
    """First label whose floor is reached, scanning from the highest floor down."""
    x = c(x)
    out = F.when(x.isNull(), F.lit(missing))
    for floor, label in sorted(edges, reverse=True):
        out = out.when(x >= floor, F.lit(label))
    return out.otherwise(F.lit(below))


def mapped(x, table: dict, default=None) -> Column:
    """Value-to-label lookup compiled into the plan (for small fixed tables)."""
    x = c(x)
    out = None
    for key, value in table.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out
