"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """The value if it is a finite number, else null: a NaN is missing, never compared."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def r6(x: Column) -> Column:
    """Six decimals, off the grid of half units so that two engines agree."""
    return F.round(x + F.lit(3e-10), 6)


def above(a: Column, b: Column, slack: float = 1e-13) -> Column:
    """a > b for values that may be means or sums of doubles: what only their last bits tell apart counts as equal."""
    return a - b > F.abs(b) * slack


def full(agg: Column, over: WindowSpec, n: int, what: Column | None = None) -> Column:
    """A windowed aggregate that is null until n rows (or n values of what) are in the window."""
    seen = F.count(F.lit(1) if what is None else what).over(over)
    return F.when(seen == n, agg.over(over))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(a, b)


def change(new: Column, old: Column) -> Column:
    """Percent change, null unless the old value is above zero."""
    return F.when(old > 0, (new / F.when(old > 0, old) - 1.0) * 100.0)


def ladder(x: Column, points: list[tuple[float, float]]) -> Column:
    """A piecewise linear function through (x, y) points, flat beyond both ends; null stays null.

    The first height plus each step's rise by the share of the step that x has passed.
    """
    passed = lambda a, b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - a[0]) / (b[0] - a[0]))) * (b[1] - a[1])
    rises = [passed(points[k], points[k + 1]) for k in range(len(points) - 1)]
    return F.when(x.isNotNull(), sum(rises, F.lit(float(points[0][1]))))


def clip_linear(x: Column, low: float, high: float) -> Column:
    """0 at low, 100 at high, linear between and clipped beyond."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - F.lit(low)) / F.lit(high - low) * 100.0))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The text of the first rule that holds; null if none does."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, text in rules[1:]:
        out = out.when(test, F.lit(text))
    return out
