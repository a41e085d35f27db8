"""The weighted ratio histogram, its autocorrelation, and robust statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import ratio_int
from ..params import Params
from . import selection
from .blocks import along


def usable_segments(segments: DataFrame, p: Params = Params()) -> DataFrame:
    """Segments with ratio_int, without the noisy ones; stddev is reduced by the divider."""
    rows = segments.withColumn("stddev", F.col("stddev") / p.stddev_divider)
    rows = rows.where(~((F.col("ratio") > 0.1) & (F.col("stddev") > F.col("ratio"))))
    rows = rows.where((F.col("ratio") <= p.max_ratio_range_int / p.ratio_scale) & (F.col("stddev") > 1e-12))
    return rows.withColumn("ratio_int", ratio_int(F.col("ratio"), p.ratio_scale))


def segment_counts(segments: DataFrame, p: Params = Params()) -> DataFrame:
    """One row: all segments and the usable ones."""
    used = usable_segments(segments, p).agg(F.count("*").alias("n_used"))
    return segments.agg(F.count("*").alias("n_segments")).crossJoin(used)  # two one-row tables


def ratio_by_contig(usable: DataFrame, contigs: list[int]) -> DataFrame:
    """Windows by ratio and contig, one column for each contig."""
    return usable.groupBy("ratio_int").pivot("chr_idx", contigs).agg(F.sum("n_windows")).na.fill(0)


def density(usable: DataFrame, p: Params = Params(), *keys: str) -> DataFrame:
    """(keys, ratio_int, density): each segment spreads its windows as a normal curve over two deviations to each side."""
    m, s = F.col("ratio") * p.ratio_scale, F.col("stddev") * p.ratio_scale
    lo = F.greatest(F.lit(0).cast("bigint"), F.floor(m - 2 * s))
    hi = F.least(F.lit(p.max_ratio_int).cast("bigint"), F.ceil(m + 2 * s))
    rows = usable.where(F.col("ratio") <= p.max_ratio_int / p.ratio_scale).select(*keys, m.alias("m"), s.alias("s"), "n_windows", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    each = rows.select(*keys, "m", "s", "n_windows", F.explode(F.sequence("lo", "hi")).alias("ratio_int"))
    away = F.col("ratio_int") - F.col("m")
    part = F.col("n_windows") * p.kde_scale / F.col("s") * F.exp(-(away * away) / (2 * F.col("s") * F.col("s")))
    return each.groupBy(*keys, "ratio_int").agg(F.sum(part).alias("density"))


def autocorrelation(hist: DataFrame, p: Params = Params()) -> DataFrame:
    """(shift, cor_raw) for shifts 0 to max_lag: the sum of the largest top_terms products of densities a shift apart.

    The histogram has a bucket for each thousandth at most, so its copies per shift are bounded.
    """
    lags = F.explode(F.sequence(F.lit(0), F.lit(p.max_lag))).alias("shift")
    left = hist.select(F.col("ratio_int").alias("i"), F.col("density").alias("a"), lags)
    right = hist.select(F.col("ratio_int").alias("j"), F.col("density").alias("b"))
    pairs = left.withColumn("j", F.col("i") + F.col("shift")).join(F.broadcast(right), "j").select("shift", (F.col("a") * F.col("b")).alias("term"), "i")
    best = Window.partitionBy("shift").orderBy(F.desc("term"), "i")
    top = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= p.top_terms)
    every = hist.sparkSession.range(0, p.max_lag + 1).select(F.col("id").cast("int").alias("shift"))
    return every.join(top.groupBy("shift").agg(F.sum("term").alias("cor_raw")), "shift", "left").select("shift", F.coalesce("cor_raw", F.lit(0.0)).alias("cor_raw"))


def smoothed(acf: DataFrame) -> DataFrame:
    """(shift, cor): the mean of five neighbouring shifts, of fewer at the ends."""
    near = Window.orderBy("shift").rowsBetween(-2, 2)  # a fixed thousand of rows
    return acf.select("shift", F.avg("cor_raw").over(near).alias("cor"))


def slopes(acf: DataFrame) -> DataFrame:
    """(shift, diff): the step to the next shift of log10 of cor, on the scale of shift 0; 0 where a log has none."""
    order = Window.orderBy("shift")  # a fixed thousand of rows
    first = F.first("cor").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scale = F.when(first > 0, F.log10(F.when(first > 0, first))).otherwise(F.lit(10.0))
    rows = acf.withColumn("next", F.lead("cor").over(order)).withColumn("scale", scale).where("next is not null")
    good = (F.col("cor") > 0) & (F.col("next") > 0) & (F.col("scale") != 0)
    log = lambda c: F.log10(F.when(F.col(c) > 0, F.col(c)))
    return rows.select("shift", F.when(good, (log("next") - log("cor")) / F.when(F.col("scale") != 0, F.col("scale"))).otherwise(F.lit(0.0)).alias("diff"))


def median_mad(rows: DataFrame, column: str, *keys: str, large: int = selection.LARGE) -> DataFrame:
    """Median, and median absolute deviation without any factor, of each key's values; nulls don't count.

    Groups of more than large values are solved by selection, in no single task. No keys: one row for all, of nulls
    for an empty table.
    """
    few, many, sizes = selection.split(rows.where(F.col(column).isNotNull()), keys, large)
    c = F.col(column)
    if many is not None and not keys:
        return selection.median_mad(many, column, keys, sizes).select("median", "mad")
    if not keys:
        mid = few.agg(F.median(c).alias("mid"))
        return few.crossJoin(F.broadcast(mid)).agg(F.first("mid").alias("median"), F.median(F.abs(c - F.col("mid"))).alias("mad"))  # by one row
    mid = few.groupBy(*keys).agg(F.median(c).alias("mid"))
    got = few.join(mid, list(keys)).groupBy(*keys).agg(F.first("mid").alias("median"), F.median(F.abs(c - F.col("mid"))).alias("mad"))
    return got if many is None else got.unionByName(selection.median_mad(many, column, keys, sizes))


def trimmed(rows: DataFrame, column: str, *keys: str, percent: float = 40.0, large: int = selection.LARGE) -> DataFrame:
    """Mean and population deviation of each key's values without percent / 2 of them at each end, with their number; nulls
    don't count. Groups of more than large values are solved by selection, in no single task.
    """
    few, many, sizes = selection.split(rows.where(F.col(column).isNotNull()), keys, large)
    part = Window.partitionBy(*keys)
    ranked = few.select(*keys, F.col(column).cast("double").alias("v")).withColumn("i", F.row_number().over(part.orderBy(F.desc("v"))) - 1).withColumn("n", F.count("*").over(part))
    low = (F.col("n") * percent / 200).cast("bigint")
    high = (F.col("n") * (100 - percent / 2) / 100).cast("bigint") + 1
    got = ranked.where((F.col("i") >= low) & (F.col("i") < high)).groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.count("*").alias("n_used"))
    if many is None:
        return got
    more = selection.trimmed(many, column, keys, sizes, percent)
    return got.unionByName(more) if keys else more


def keys_of(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def noise_variance(rows: DataFrame, column: str, key: str | Sequence[str], order: str, block: int | None = None) -> DataFrame:
    """Per key the mean of half the squared steps between neighbours, null for a single row; block: see blocks.along()."""
    keys = keys_of(key)
    each = along(rows, keys, order, 1, 0, lambda d, w: d.withColumn("step", F.col(column) - F.lag(column).over(w)), block)
    return each.groupBy(*keys).agg((F.try_divide(F.sum(0.5 * F.col("step") * F.col("step")), F.count("*") - 1)).alias("variance"))


def base_level(segments: DataFrame, key: str | Sequence[str], value: str = "ratio", weight: str = "n_windows", large: int = selection.LARGE) -> DataFrame:
    """Per key the value at which half of the weight is reached, values ascending; keys of more than large distinct values
    are solved by selection, in no single task.
    """
    keys = keys_of(key)
    # one row for each value, so that the order has as many rows as values and not as segments
    each = segments.groupBy(*keys, value).agg(F.sum(weight).alias("weight"))
    few, many, _ = selection.split(each, keys, large)
    order, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    rows = few.withColumn("run", F.sum("weight").over(order)).withColumn("total", F.sum("weight").over(whole))
    got = rows.where(2 * F.col("run") >= F.col("total")).groupBy(*keys).agg(F.min(value).alias("base_level"))
    if many is None:
        return got
    more = selection.weighted_median(many, value, "weight", keys).withColumnRenamed("v", "base_level")
    return got.unionByName(more) if keys else more


def peak_stats(segments: DataFrame, peaks: DataFrame, *more) -> DataFrame:
    """Per peak (lo, hi, center): refined center, windows, and the normal log-likelihood of the segments in its bounds.

    more: further aggregates of the same rows.
    """
    from .intervals import bucket_join

    rows = bucket_join(segments, peaks)
    w = F.col("n_windows").cast("double")
    away = F.col("ratio") - F.col("center") / 1000
    got = rows.groupBy("peak_index", "center").agg(
        F.count("*").alias("n_segments"), F.sum(w).alias("n"), F.sum(w * away * away).alias("ss"), (F.sum(F.col("ratio") * w * F.sqrt(w)) / F.sum(w * F.sqrt(w))).alias("refined"), *more
    )
    s = F.sqrt(F.col("ss") / F.col("n"))
    logl = -F.col("n") / 2 - F.col("n") * (F.ln(F.when(s > 0, s)) + 0.5 * F.ln(F.lit(2 * 3.141592653589793)))
    return got.withColumn("logl", logl)


def folded(hist: DataFrame, first: int, period: int) -> DataFrame:
    """(phase, density): the histogram pooled over all periods from the first peak on."""
    return hist.where(F.col("ratio_int") >= first).groupBy(F.pmod(F.col("ratio_int") - first, F.lit(period)).alias("phase")).agg(F.sum("density").alias("density"))


def window_average(rows: DataFrame, column: str, key: str | Sequence[str], order: str, width: int, block: int | None = None) -> DataFrame:
    """Each row's value spread evenly over the rows within width, fewer at the ends, and summed where it lands (smoothed);
    block: see blocks.along().
    """

    def spread(d: DataFrame, line: WindowSpec) -> DataFrame:
        near = line.rowsBetween(-width, width)
        return d.withColumn("_part", F.col(column) / F.count("*").over(near)).withColumn("smoothed", F.sum("_part").over(near)).drop("_part")

    return along(rows, keys_of(key), order, 2 * width, 2 * width, spread, block)


def moving_stats(rows: DataFrame, column: str, key: str | Sequence[str], order: str, before: int, span: int, block: int | None = None) -> DataFrame:
    """Mean and sample deviation (moving_mean, moving_stddev) of span + 1 rows from before rows back on, or from the first row;
    block: see blocks.along().
    """

    def stats(d: DataFrame, line: WindowSpec) -> DataFrame:
        moved, head = line.rowsBetween(-before, span - before), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.when(F.col("_i") <= span, F.col(column))
        pick = lambda f: F.when(F.col("_i") >= before, f(column).over(moved)).otherwise(f(first).over(head))
        return d.withColumn("moving_mean", pick(F.avg)).withColumn("moving_stddev", pick(F.stddev_samp))

    return along(rows, keys_of(key), order, before, max(span, 0), stats, block)
