"""Exact order statistics of groups of any size.

A double's bits, turned so that they order as the values do, are read in four digits of 16 bits. Each round counts, or
weighs, the open rows by digit and finds the digit in which a rank falls, until all 64 bits are known. A group's bins
are 65,536 at most in a round, rows that no rank needs any more drop out, and no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import checkpoint
from .blocks import dealt_join, is_small

#: Rows of a group from which on its ranks are found by digits and not in one task.
LARGE = 1 << 20
BITS, ROUNDS = 16, 4


def ordered(values: pd.Series) -> pd.Series:
    """The bits of doubles, read as unsigned numbers in the order of the values; zeros are equal."""
    bits = (values.to_numpy(np.float64) + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))))


def keyed(rows: DataFrame, column: str, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, v, k, w) of the rows whose column isn't null, checkpointed: the value, its bits, and its weight or 1."""
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    v = F.col(column).cast("double")
    held = rows.where(v.isNotNull()).select(*keys, F.when(v == 0, 0.0).otherwise(v).alias("v"), w.alias("w"))  # zeros without a sign
    return checkpoint(held.withColumn("k", F.pandas_udf(ordered, LongType())("v")))


def at_ranks(rows: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """(keys, q, v, below, at) for each of wanted (keys, q, t): the smallest value up to which the weights reach t, with the
    weights of lesser and of equal values. rows: as keyed() gives them.
    """
    state = checkpoint(wanted.select(*keys, "q", "t", F.lit(0).cast("bigint").alias("p"), (F.col("t") - F.col("t")).alias("below")))
    small = is_small(state)
    for level in range(ROUNDS):
        prefix = F.shiftrightunsigned("k", 64 - BITS * level) if level else F.lit(0).cast("bigint")
        digit = F.shiftrightunsigned("k", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))
        rank = [*keys, "q", "t", "p", "below"]
        held = dealt_join(rows.withColumn("p", prefix), state.select(*rank), [*keys, "p"], "k", small=small)
        bins = held.groupBy(*rank, digit.alias("d")).agg(F.sum("w").alias("w"), F.min("v").alias("v"))
        bins = bins.withColumn("upto", F.sum("w").over(Window.partitionBy(*rank).orderBy("d")))
        best = bins.where(F.col("below") + F.col("upto") >= F.col("t")).groupBy(*rank).agg(F.min(F.struct("d", "upto", "w", "v")).alias("x"))
        known, under = F.shiftleft("p", BITS).bitwiseOR(F.col("x.d")), F.col("below") + F.col("x.upto") - F.col("x.w")
        state = checkpoint(best.select(*keys, "q", "t", known.alias("p"), under.alias("below"), F.col("x.w").alias("at"), F.col("x.v").alias("v")))
    return state.select(*keys, "q", "v", "below", "at")


def split(rows: DataFrame, keys: Sequence[str], large: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """rows of groups up to large rows, rows of larger ones, and (keys, n) of these; None for both where there are none."""
    sizes = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > large)) if keys else checkpoint(rows.agg(F.count("*").alias("n")).where(F.col("n") > large))
    if sizes.isEmpty():
        return rows, None, None
    if not keys:
        return rows.limit(0), rows, sizes
    by = next((c for c in rows.columns if c not in keys), keys[0])
    marked = dealt_join(rows, sizes, keys, by, "left")
    return marked.where("n is null").drop("n"), marked.where("n is not null").drop("n"), sizes


def whole(rows: DataFrame) -> DataFrame:
    """rows with a key that is the same for all."""
    return rows.withColumn("_all", F.lit(0))


def medians(rows: DataFrame, keys: Sequence[str], sizes: DataFrame) -> DataFrame:
    """(keys, mid): the median of each group of keyed rows, of two middle values their mean."""
    half = F.explode(F.array(F.struct(F.lit(0).alias("q"), F.floor((F.col("n") + 1) / 2).alias("t")), F.struct(F.lit(1).alias("q"), (F.floor(F.col("n") / 2) + 1).alias("t")))).alias("x")
    found = at_ranks(rows, keys, sizes.select(*keys, half).select(*keys, "x.q", "x.t"))
    a, b = F.min("v"), F.max("v")
    return checkpoint(found.groupBy(*keys).agg(F.when(a == b, a).otherwise(0.5 * a + 0.5 * b).alias("mid")))


def median_mad(rows: DataFrame, column: str, keys: Sequence[str], sizes: DataFrame) -> DataFrame:
    """(keys, median, mad) of groups of any size; sizes: (keys, n) of their non-null rows."""
    if not keys:
        return median_mad(whole(rows), column, ["_all"], whole(sizes)).drop("_all")
    rows = keyed(rows, column, keys)
    mid = medians(rows, keys, sizes)
    away = keyed(dealt_join(rows, mid, keys, "k").withColumn("away", F.abs(F.col("v") - F.col("mid"))), "away", keys)
    return mid.withColumnRenamed("mid", "median").join(medians(away, keys, sizes).withColumnRenamed("mid", "mad"), list(keys))


def trimmed(rows: DataFrame, column: str, keys: Sequence[str], sizes: DataFrame, percent: float) -> DataFrame:
    """(keys, mean, stddev, n_used) without percent / 2 of the values at each end, of groups of any size.

    The least and the largest value used are found by rank; what lies between them is summed up, and of both
    as many copies as the ranks take.
    """
    if not keys:
        return trimmed(whole(rows), column, ["_all"], whole(sizes), percent).drop("_all")
    rows = keyed(rows, column, keys)
    n = F.col("n")
    low, high = (n * percent / 200).cast("bigint"), F.least(n, (n * (100 - percent / 2) / 100).cast("bigint") + 1)
    sizes = sizes.select(*keys, (n - high).alias("first"), (n - low).alias("last"))  # ascending places used: first up to last
    ends = F.explode(F.array(F.struct(F.lit(0).alias("q"), (F.col("first") + 1).alias("t")), F.struct(F.lit(1).alias("q"), F.col("last").alias("t")))).alias("x")
    found = at_ranks(rows, keys, sizes.select(*keys, ends).select(*keys, "x.q", "x.t"))
    one = lambda q, c, name: F.max(F.when(F.col("q") == q, F.col(c))).alias(name)
    bounds = found.groupBy(*keys).agg(one(0, "v", "lo"), one(1, "v", "hi"), one(1, "below", "under")).join(sizes, list(keys))
    bounds = checkpoint(bounds)
    inner = dealt_join(rows, bounds, keys, "k").where((F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi"))).withColumn("x", F.col("v") - F.col("lo"))
    sums = inner.groupBy(*keys).agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    both = bounds.join(sums, list(keys), "left").na.fill(0.0, ["s", "ss"])
    used, span = F.col("last") - F.col("first"), F.col("hi") - F.col("lo")
    top = F.when(F.col("hi") > F.col("lo"), F.col("last") - F.col("under")).otherwise(0)
    mean = (F.col("s") + top * span) / used
    square = (F.col("ss") + top * span * span) / used
    return both.select(*keys, (F.col("lo") + mean).alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("stddev"), used.alias("n_used"))


def weighted_median(rows: DataFrame, column: str, weight: str, keys: Sequence[str]) -> DataFrame:
    """(keys, v): the least value up to which half of the group's weight is reached, of groups of any size."""
    if not keys:
        return weighted_median(whole(rows), column, weight, ["_all"]).drop("_all")
    rows = keyed(rows.withColumn("_twice", 2 * F.col(weight)), column, keys, "_twice")
    total = rows.groupBy(*keys).agg((F.sum("w") / 2).alias("t"))
    return at_ranks(rows, keys, total.withColumn("q", F.lit(0))).select(*keys, "v")
