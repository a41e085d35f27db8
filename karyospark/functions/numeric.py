"""Column functions with integer and truncation semantics that the built-ins don't have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b) -> Column:
    """Integer division, toward zero."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint") if not isinstance(b, Column) else b)


def sorted_median(values: Column) -> Column:
    """Integer median of a non-empty array of longs; of two middle values their mean toward zero."""
    s, n = F.sort_array(values), F.size(values)
    half = (n / 2).cast("int")
    even = (F.get(s, half - 1) + F.get(s, half)).cast("double") / 2
    return F.when(n % 2 == 1, F.get(s, half)).otherwise(even.cast("bigint"))


def sorted_midpoint(values: Column) -> Column:
    """Median of a non-empty array, of two middle values their mean."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))).cast("double") / 2


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def ratio_int(ratio: Column, scale: int = 1000) -> Column:
    """The ratio's bucket: thousandths, cut off."""
    return (ratio * scale).cast("int")


def half_down(x: Column) -> Column:
    """Nearest integer where a half stays down and the integer part is cut toward zero."""
    whole = x.cast("bigint")
    return (whole + F.when(x - whole > 0.5, 1).otherwise(0)).cast("bigint")


def plot_scale(x: Column) -> Column:
    """Copy numbers above two on a log scale."""
    return F.when(x > 2, F.log2(x - 1) + 2).otherwise(x)


def log_odds(t_ro: Column, t_ao: Column, n_ro: Column, n_ao: Column) -> Column:
    """ln((t_ao / n_ao) / (t_ro / n_ro)) of positive counts."""
    d = lambda c: c.cast("double")
    return F.ln((d(t_ao) / d(n_ao)) / (d(t_ro) / d(n_ro)))
