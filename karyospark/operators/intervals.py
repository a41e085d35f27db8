"""Interval joins by bins of several widths: the range condition becomes an equi-join on bins plus a residual.

Bins widen by a factor from level to level. An interval lies at the first level whose bins are as wide as it is long, so it
touches two bins at most, however long it is; a point asks one bin of each level at which intervals lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import int_div
from .blocks import running_max_before

#: How much wider the bins of the next level are, and what is wider than any interval.
FACTOR, WIDEST = 16, 1 << 62


def bins(start: Column, end: Column, width: Column) -> Column:
    """All bins from start to end, both included; none where end lies before start."""
    a, b = int_div(start, width), int_div(end, width)
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def widths(width: int) -> list[int]:
    """The bins' width at each level, 16 levels at most."""
    found = [max(1, width)]
    while found[-1] * FACTOR <= WIDEST:
        found.append(found[-1] * FACTOR)
    return found


def level_of(start: Column, end: Column, width: int) -> Column:
    """The first level whose bins are as wide as the interval is long."""
    long = end.cast("bigint") - start.cast("bigint") + 1
    return sum((F.when(long > w, 1).otherwise(0) for w in widths(width)[:-1]), F.lit(0))


def width_at(level: Column, width: int) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("bigint") for w in widths(width)]), level + 1)


def levels(intervals: DataFrame, width: int, start: str, end: str) -> DataFrame:
    """One row with _levels, the levels at which intervals lie, 16 at most."""
    found = F.sort_array(F.collect_set(level_of(F.col(start), F.col(end), width)))
    return F.broadcast(intervals.agg(F.coalesce(found, F.array().cast("array<int>")).alias("_levels")))


def asking(points: DataFrame, intervals: DataFrame, pos: str, start: str, end: str, width: int) -> DataFrame:
    """points once for each level at which intervals lie, with _level and the _bin they ask there."""
    rows = points.crossJoin(levels(intervals, width, start, end)).withColumn("_level", F.explode("_levels")).drop("_levels")  # by one row
    return rows.withColumn("_bin", int_div(F.col(pos), width_at(F.col("_level"), width)))


def placed(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """intervals with _level and _bin, one row for each bin of their level that they touch, two at most."""
    rows = intervals.withColumn("_level", level_of(F.col(start), F.col(end), width))
    return rows.withColumn("_bin", F.explode(bins(F.col(start), F.col(end), width_at(F.col("_level"), width))))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str = "pos", start: str = "start", end: str = "end", width: int = 100_000, how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them (both ends included), equal in the keys. width: that of the least bins.

    A point lies in one bin of an interval's level, so a pair is found exactly once. Columns other than the keys
    must differ in name. how: inner, or left to keep points in no interval.
    """
    names = {c: f"_{i}" for i, c in enumerate(intervals.columns)}
    a, b = asking(points, intervals, pos, start, end, width), placed(intervals, start, end, width).withColumnsRenamed(names | {"_level": "_its", "_bin": "_at"})
    same = [F.col(k) == F.col(names[k]) for k in keys] + [F.col("_level") == F.col("_its"), F.col("_bin") == F.col("_at")]
    pairs = a.join(b, [*same, F.col(pos).between(F.col(names[start]), F.col(names[end]))]).select(*points.columns, *[F.col(names[c]).alias(c) for c in intervals.columns if c not in keys])
    if how == "inner":
        return pairs
    # equal points lie in the same intervals, so all columns together tell which points are in none
    found = pairs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(points.columns)]).distinct()
    lone = points.join(found, [points[c].eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(points.columns)], "left_anti")
    return pairs.unionByName(lone, allowMissingColumns=True)


def homed_join(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str = "pos", start: str = "start", end: str = "end", width: int = 100_000) -> DataFrame:
    """Each interval with the points that it holds, ready to be grouped by it without another shuffle: (keys, _level, _home, start, end,
    _same, the points' columns), a row for each point in it, one of nulls for none.

    An interval lies in the one bin where it starts, its home, of the first level whose bins are as wide as it is long, so
    all its pairs are made in one task; equal ones are one, with their other columns in the list _same. A point asks its own
    bin, and the one before if it is near enough to the bin's start for an interval from there to reach it.
    """
    level = level_of(F.col(start), F.col(end), width)
    other = [c for c in intervals.columns if c not in (*keys, start, end)]
    # where end lies before start, or a key is null, no point is inside
    placed_at = intervals.withColumn("_level", level).withColumn("_home", int_div(F.col(start), width_at(F.col("_level"), width)))
    homes = placed_at.repartition(*keys, "_level", "_home").groupBy(*keys, "_level", "_home", start, end).agg(F.collect_list(F.struct(*other) if other else F.lit(True)).alias("_same"))
    reach = intervals.groupBy(level.alias("level")).agg(F.max(F.col(end) - F.col(start)).alias("long"))
    reach = F.broadcast(reach.agg(F.coalesce(F.collect_list(F.struct("level", "long")), F.array().cast("array<struct<level:int,long:bigint>>")).alias("_levels")))
    wide = lambda x: width_at(x["level"], width)
    asked = points.crossJoin(reach).withColumn("_x", F.explode("_levels")).drop("_levels")  # by one row
    own, before = int_div(F.col(pos), wide(F.col("_x"))), int_div(F.col(pos) - F.greatest(F.col("_x.long"), F.lit(0)), wide(F.col("_x")))
    asked = asked.withColumns({"_its": F.col("_x.level"), "_bin": F.explode(F.sequence(before, own))}).drop("_x")
    asked = asked.withColumnsRenamed({k: f"_its_{k}" for k in keys})
    same = [F.col(k) == F.col(f"_its_{k}") for k in keys] + [F.col("_level") == F.col("_its"), F.col("_home") == F.col("_bin")]
    pairs = homes.join(asked, [*same, F.col(pos).between(F.col(start), F.col(end))], "left")
    return pairs.drop("_its", "_bin", *[f"_its_{k}" for k in keys])


def sums_within(points: DataFrame, intervals: DataFrame, keys: list[str], by: str, value: str, pos: str = "pos", start: str = "start", end: str = "end", block: int = 1 << 16) -> DataFrame:
    """(by, n, total): of each value of by, over all its intervals, how many points they hold and the sum of the points' value,
    as grouping interval_join() by it gives; none for intervals without points.

    No pair is made: an interval holds what lies up to its end less what lies before its start. Points and ends go once to
    their stretch of block positions, are summed along it, and get the total of all stretches before.
    """
    nothing, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    known = [F.col(k).isNotNull() for k in keys]
    held = F.col(value).cast("bigint")
    sites = points.where(F.col(pos).isNotNull()).where(F.array_min(F.array(*known))).select(
        *keys, F.col(pos).cast("bigint").alias("_at"), F.lit(1).alias("_turn"), F.lit(None).cast(intervals.schema[by].dataType).alias("_by"), one.alias("_n"), held.isNotNull().cast("bigint").alias("_k"), F.coalesce(held, nothing).alias("_v"))
    spans = intervals.where(F.col(start) <= F.col(end)).where(F.array_min(F.array(*known)))
    edge = lambda c, turn: spans.select(*keys, F.col(c).cast("bigint").alias("_at"), F.lit(turn).alias("_turn"), F.col(by).alias("_by"), *[nothing.alias(x) for x in ("_n", "_k", "_v")])
    # at one position starts come before points, ends after them
    rows = sites.unionByName(edge(start, 0)).unionByName(edge(end, 2)).withColumn("_block", int_div(F.col("_at"), F.lit(block)))
    line = Window.partitionBy(*keys, "_block").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    along = rows.select(*keys, "_block", "_turn", "_by", *[F.sum(c).over(line).alias(c) for c in ("_n", "_k", "_v")]).where("_turn <> 1")
    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(c).alias(c) for c in ("_n", "_k", "_v")])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    totals = blocks.select(*keys, "_block", *[F.coalesce(F.sum(c).over(before), nothing).alias(f"{c}_before") for c in ("_n", "_k", "_v")])
    sign = F.col("_turn").cast("bigint") - 1
    sums = along.join(totals, [*keys, "_block"]).groupBy(F.col("_by").alias(by)).agg(*[F.sum(sign * (F.col(c) + F.col(f"{c}_before"))).alias(c) for c in ("_n", "_k", "_v")])
    return sums.where("_n > 0").select(by, F.col("_n").alias("n"), F.when(F.col("_k") > 0, F.col("_v")).alias("total"))


def apart(regions: DataFrame, keys: list[str], start: str = "start", end: str = "end", block: int | None = None) -> DataFrame:
    """(keys, start, end) of pieces that cover what the regions do, but lie apart: of each region what lies after all before.

    block: see blocks.running_max_before().
    """
    rows = running_max_before(regions.select(*keys, start, end).where(F.col(start) <= F.col(end)), end, keys, [start, end], block)
    left = F.greatest(F.col(start), F.col("_before") + 1)
    return rows.withColumn(start, left).where(F.col(start) <= F.col(end)).select(*keys, start, end)


def within(points: DataFrame, regions: DataFrame, keys: list[str], pos: str = "pos", start: str = "start", end: str = "end", width: int = 100_000) -> DataFrame:
    """Points in any of the regions, each once: in one of the pieces that lie apart and cover the same positions."""
    pieces = apart(regions.select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end")), keys, "_start", "_end")
    return interval_join(points, pieces, keys, pos, "_start", "_end", width).select(*points.columns)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = 100_000) -> DataFrame:
    """Pairs of intervals that share a position, equal in the keys: keys, l_ and r_ columns, and the shared ends.

    Each interval is placed at its own level, and at the higher levels of the other side; a pair meets at the level of the
    longer one and counts in the bin of its first shared position only.
    """

    def side(rows: DataFrame, other: DataFrame, mark: str) -> DataFrame:
        s, e = f"{mark}_{start}", f"{mark}_{end}"
        rows = rows.select(*[F.col(c).alias(c if c in keys else f"{mark}_{c}") for c in rows.columns]).withColumn(f"_{mark}", level_of(F.col(s), F.col(e), width))
        higher = F.filter("_levels", lambda x: x > F.col(f"_{mark}"))
        rows = rows.crossJoin(levels(other, width, start, end)).withColumn("_level", F.explode(F.concat(F.array(f"_{mark}"), higher))).drop("_levels")  # by one row
        return rows.withColumn("_bin", F.explode(bins(F.col(s), F.col(e), width_at(F.col("_level"), width))))

    a, b = side(left, right, "l"), side(right, left, "r")
    first, last = F.greatest(f"l_{start}", f"r_{start}"), F.least(f"l_{end}", f"r_{end}")
    joined = a.join(b, [*keys, "_level", "_bin"]).where((F.col("_level") == F.greatest("_l", "_r")) & (first <= last))
    joined = joined.where(int_div(first, width_at(F.col("_level"), width)) == F.col("_bin"))
    return joined.drop("_level", "_bin", "_l", "_r").withColumn("shared_start", first).withColumn("shared_end", last)


def bucket_join(segments: DataFrame, peaks: DataFrame, bucket: str = "ratio_int", lo: str = "lo", hi: str = "hi", how: str = "inner") -> DataFrame:
    """Segments with the peaks whose range of buckets holds theirs; peaks are at most as many as buckets and broadcast."""
    spread = peaks.withColumn("_bucket", F.explode(F.sequence(F.col(lo).cast("int"), F.col(hi).cast("int"))))
    return segments.join(F.broadcast(spread), F.col(bucket) == F.col("_bucket"), how).drop("_bucket")


def outside_peaks(segments: DataFrame, peaks: DataFrame, bucket: str = "ratio_int", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Segments whose bucket lies in no peak."""
    spread = peaks.select(F.explode(F.sequence(F.col(lo).cast("int"), F.col(hi).cast("int"))).alias("_bucket")).distinct()
    return segments.join(F.broadcast(spread), F.col(bucket) == F.col("_bucket"), "left_anti")


def complement(segments: DataFrame, contigs: DataFrame, keys: tuple[str, ...] = ("chr_idx",), block: int | None = None) -> DataFrame:
    """The gaps (keys, start, end) that the segments leave within the contigs; segments may overlap.

    A gap begins after the furthest end of all segments before, a running maximum along the contig, of each sample where
    keys name samples too; contigs without any segment are gaps as a whole. block: see blocks.running_max_before().
    """
    ends = contigs.select("chr_idx", (F.col("length") + 1).alias("start"), (F.col("length") + 1).alias("end"))
    samples = [k for k in keys if k != "chr_idx"]
    if samples:  # every contig of every sample
        ends = segments.select(*samples).distinct().crossJoin(F.broadcast(ends))  # contigs are a fixed handful
    edges = segments.select(*keys, "start", "end").unionByName(ends)
    gap_start = F.coalesce(F.col("_before"), F.lit(0)) + 1
    gaps = running_max_before(edges, "end", keys, ["start", "end"], block).select(*keys, gap_start.alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
    return gaps.where("gap_start <= gap_end").select(*keys, F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))


def fill(segments: DataFrame, contigs: DataFrame, keys: tuple[str, ...] = ("chr_idx",)) -> DataFrame:
    """Segments (keys, start, end, cp, major) with all gaps as neutral ones: two copies, one major."""
    neutral = complement(segments, contigs, keys).select(*keys, "start", "end", F.lit(2.0).alias("cp"), F.lit(1.0).alias("major"))
    return segments.select(*keys, "start", "end", F.col("cp").cast("double"), F.col("major").cast("double")).unionByName(neutral)


def with_offsets(contigs: DataFrame) -> DataFrame:
    """Contigs with cum_offset, the length of all contigs before; contigs are a fixed handful."""
    before = Window.orderBy("chr_idx").rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("cum_offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def cumulative(rows: DataFrame, contigs: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with cumu_start and cumu_end, their place in the whole genome; how: left keeps rows on no contig."""
    at = F.broadcast(with_offsets(contigs).select("chr_idx", "cum_offset"))
    return rows.join(at, "chr_idx", how).select(*rows.columns, "cum_offset").withColumn("cumu_start", F.col("start") + F.col("cum_offset")).withColumn("cumu_end", F.col("end") + F.col("cum_offset")).drop("cum_offset")
