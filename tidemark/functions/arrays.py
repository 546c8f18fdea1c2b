"""Quantile arrays: nine ordered levels held in ARRAY<DOUBLE>, scored without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.calendar import col

LEVELS = (0.025, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.975)
# standard normal quantiles at LEVELS
Z = (-1.959963984540054, -1.6448536269514729, -1.2815515655446004, -0.6744897501960817, 0.0, 0.6744897501960817, 1.2815515655446004, 1.6448536269514722, 1.959963984540054)
MEDIAN = LEVELS.index(0.5)


def levels() -> Column:
    return F.array(*map(F.lit, LEVELS))


def at(q: Column | str, level: float) -> Column:
    return F.element_at(col(q), LEVELS.index(level) + 1)


def pinball(y: Column, q: Column, tau: Column) -> Column:
    return F.when(y >= q, tau * (y - q)).otherwise((tau - 1) * (y - q))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def wis(q: Column | str, y: Column | str) -> Column:
    """Weighted interval score: twice the mean pinball loss over the levels."""
    y = col(y)
    return 2 * total(F.zip_with(col(q), levels(), lambda v, tau: pinball(y, v, tau))) / len(LEVELS)


def wis_from_intervals(q: Column | str, y: Column | str) -> Column:
    """The same score from central intervals and the median."""
    y, k = col(y), len(LEVELS) // 2
    out = F.abs(y - at(q, 0.5)) * 0.5
    for i in range(k):
        lo, hi, a = at(q, LEVELS[i]), at(q, LEVELS[-1 - i]), 2 * LEVELS[i]
        out = out + (a / 2) * ((hi - lo) + (2 / a) * F.greatest(lo - y, F.lit(0.0)) + (2 / a) * F.greatest(y - hi, F.lit(0.0)))
    return out / (k + 0.5)


def covers(q: Column | str, y: Column | str, lo: float, hi: float) -> Column:
    return (col(y) >= at(q, lo)) & (col(y) <= at(q, hi))


def pit(q: Column | str, y: Column | str) -> Column:
    """Level of y by linear interpolation; 0 below the first quantile and 1 above the last."""
    y, q = col(y), col(q)
    out = F.when(y > at(q, LEVELS[-1]), 1.0)
    for i in range(len(LEVELS) - 1, 0, -1):
        a, b = at(q, LEVELS[i - 1]), at(q, LEVELS[i])
        share = F.when(b > a, (y - a) / (b - a)).otherwise(F.lit(1.0))
        out = out.when((y > a) & (y <= b), LEVELS[i - 1] + (LEVELS[i] - LEVELS[i - 1]) * share)
    return out.when(y == at(q, LEVELS[0]), LEVELS[0]).when(y < at(q, LEVELS[0]), 0.0)


def tidy(q: Column) -> Column:
    """Sorted against crossing, floored at zero."""
    return F.transform(F.array_sort(q), lambda x: F.greatest(x, F.lit(0.0)))


def crossed(q: Column | str) -> Column:
    q = col(q)
    return F.exists(F.zip_with(F.slice(q, 1, len(LEVELS) - 1), F.slice(q, 2, len(LEVELS) - 1), lambda a, b: b - a), lambda d: d < 0)


def all_zero(q: Column | str) -> Column:
    return F.forall(col(q), lambda x: x == 0)


def quantile_sorted(values: Column, level: Column) -> Column:
    """Linear-interpolation quantile of a sorted array at a level that may differ by row."""
    n = F.size(values)
    place = (n - 1) * F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0))
    lo = F.floor(place).cast("int")
    hi = F.least(lo + 1, n - 1)
    a, b = F.try_element_at(values, lo + 1), F.try_element_at(values, hi + 1)
    return F.when(n > 0, a + (b - a) * (place - lo))


def mean_of(a: Column | str, b: Column | str) -> Column:
    """Vincentised ensemble: the mean of two quantile functions, level by level."""
    return tidy(F.zip_with(col(a), col(b), lambda x, y: (x + y) / 2))


#: A rational approximation of the normal quantile function, good to 1.2e-9; numerator and
#: denominator in the middle, numerator and denominator in the tails, and where the lower tail ends.
NORMAL_MIDDLE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
NORMAL_MIDDLE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
NORMAL_TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
NORMAL_TAIL_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
NORMAL_LOW = 0.02425


def polynomial(x, powers: tuple[float, ...]):
    """Highest power first."""
    out = powers[0]
    for c in powers[1:]:
        out = out * x + c
    return out


def normal_quantile(u: Column) -> Column:
    """The standard normal value at level u, 0 < u < 1."""
    middle = lambda d: d * polynomial(d * d, NORMAL_MIDDLE) / polynomial(d * d, NORMAL_MIDDLE_BELOW)
    tail = lambda t: polynomial(t, NORMAL_TAIL) / polynomial(t, NORMAL_TAIL_BELOW)
    return F.when(u < NORMAL_LOW, tail(F.sqrt(-2 * F.log(u)))).when(u > 1 - NORMAL_LOW, -tail(F.sqrt(-2 * F.log(1 - u)))).otherwise(middle(u - 0.5))


def uniform(key: Column, draw: Column, which: int = 0) -> Column:
    """The draw-th number of a key, in (0, 1): 52 bits of a hash of both, so the same wherever and however
    often it is worked out. which: 0 or 1, two independent numbers of a draw."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, draw.cast("string"))), 1 + 13 * which, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)
