"""Column builders: guarded windows, and risk metrics usable in ``agg`` and over windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DAYS, MONTHS = 252, 12
#: A deviation below this counts as none.
NO_DEVIATION = 1e-12


def r6(x: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded_mean(x: str, places: int) -> Column:
    """The mean to ``places`` decimals, halves away from zero, whatever the order in which rows are added.

    Added as floats, a mean that is half a unit exactly falls to either side by the errors of its sum. Values count to
    twelve decimals here; where one isn't finite or has more than sixteen digits before the point, the mean is the floats'.
    """
    value, exact = F.col(x), F.col(x).try_cast("decimal(28,12)")
    whole = F.count(exact) == F.count(value)
    return F.when(whole, F.round(F.avg(exact), places).cast("double")).otherwise(F.round(F.avg(value), places))


def ordered(keys: Sequence[str] = ("series_id",), by: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows where ``least`` (all ``n``) of them have a value."""
    own = last_rows(w, n)
    return F.when(F.count(x).over(own) >= (n if least is None else least), agg(x).over(own))


def expanding(agg: Callable[[Column], Column], x: Column, w: WindowSpec, least: int = 1) -> Column:
    own = so_far(w)
    return F.when(F.count(x).over(own) >= least, agg(x).over(own))


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """Relative change over ``n`` rows; null where the base is zero."""
    return x / F.nullif(F.lag(x, n).over(w), F.lit(0.0)) - 1


def positive(x: Column) -> Column:
    """x where above 0, else 0; null stays null (``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def ratio(mean: Column, deviation: Column, periods: int = DAYS) -> Column:
    return F.when(deviation > NO_DEVIATION, mean / deviation * F.sqrt(F.lit(float(periods)))).otherwise(0.0)


def sharpe(r: Column, periods: int = DAYS) -> Column:
    return ratio(F.avg(r), F.stddev_samp(r), periods)


def sortino(r: Column, periods: int = DAYS) -> Column:
    """The deviation is that of the negative returns among themselves."""
    return ratio(F.avg(r), F.stddev_samp(F.when(r < 0, r)), periods)


def volatility(r: Column, periods: int = DAYS) -> Column:
    return F.stddev_samp(r) * F.sqrt(F.lit(float(periods)))


def grown(log_growth: Column) -> Column:
    """exp(x) - 1 with the exponent kept inside the range of doubles."""
    return F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), log_growth))) - 1


def cagr(start: Column, end: Column, rows: Column) -> Column:
    """Growth per year from the first to the last value; the exponent counts rows."""
    return (
        F.when((rows < 2) | start.isNull() | end.isNull() | (start <= 0) | (end < 0), 0.0)
        .when(end == 0, -1.0)
        .otherwise(grown((F.ln(end) - F.ln(start)) * DAYS / rows))
    )


def correlation(x: Column | str, y: Column | str, over: WindowSpec | None = None) -> Column:
    """Null where one side doesn't vary (``corr`` would divide by zero)."""
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    both, dx, dy = [p.over(over) for p in parts] if over is not None else parts
    return F.when(dx * dy > 1e-14, both / (dx * dy))


def yearly_from_mean(mean: Column) -> Column:
    """What a mean daily return compounds to over a year."""
    base = mean + 1
    return F.when(base == 0, -1.0).when(base < 0, 0.0).otherwise(grown(F.ln(base) * DAYS))


def win_rate(r: Column) -> Column:
    """Share of positive among non-zero returns."""
    traded = F.count_if(r != 0)
    return F.when(traded > 0, F.count_if(r > 0) / traded).otherwise(0.0)
