"""Copy-number calls from a period, its peaks and the segments with their sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_down
from ..params import Params
from ..session import checkpoint
from .allele import ERROR, allele_models
from .intervals import bucket_join, cumulative, outside_peaks
from .periods import Period

CALL_COLUMNS = ("chr_idx", "start", "end", "cp", "major_allele_cp", "copy_no_float", "is_clonal")


def peak_table(spark, period: Period) -> DataFrame:
    rows = [(x.index, x.center, x.lo, x.hi, int(x.n_snps), period.copies_before + x.index) for x in period.peaks]
    return spark.createDataFrame(rows, "peak_index int, center int, lo int, hi int, peak_snps int, peak_cp int")


def copy_number(ratio_int, first: int, period: int, before: int):
    return (ratio_int - first).cast("double") / period + before


def interval_columns(rows: DataFrame, purity: float, ploidy: float, p: Params) -> DataFrame:
    """cp_stddev and the interval around the copy number, from the segment's own deviation."""
    sd = (purity * ploidy + 2 * (1 - purity)) * (F.col("stddev") * p.stddev_divider) / purity
    return rows.withColumn("cp_stddev", sd).withColumn("interval_left", F.col("copy_no_float") - sd).withColumn("interval_right", F.col("copy_no_float") + sd)


def by_peaks(segments: DataFrame, period: Period, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Segments in a peak with sites, with the peak's copies cp_int, and those in no peak; both with copy_no_float."""
    peaks = peak_table(segments.sparkSession, period)
    inside = bucket_join(segments, peaks).where("peak_snps > 0")
    if strict:
        inside = inside.withColumn("_least", F.min("peak_index").over(_by_segment())).where("peak_index = _least").drop("_least")
    value = copy_number(F.col("ratio_int"), period.first, period.period, period.copies_before).alias("copy_no_float")
    kept = [c for c in ("chr_idx", "start", "end", "stddev", "n_windows", "snps") if c in segments.columns]
    return inside.select(*kept, F.col("peak_cp").alias("cp_int"), value), outside_peaks(segments, peaks).select(*kept, value)


def totals(segments: DataFrame, period: Period, strict: bool = False) -> DataFrame:
    """One row: lengths and length-weighted copies of all called segments and of those in peaks; needs neither sites nor fits."""
    inside, outside = by_peaks(segments, period, strict)
    length = (F.col("end") - F.col("start") + 1).cast("double")
    sized = inside.select(length.alias("len"), F.col("cp_int").cast("double").alias("c"), F.lit(1).alias("k")).unionByName(outside.select(length.alias("len"), F.col("copy_no_float").alias("c"), F.lit(0).alias("k")))
    own = F.col("k") == 1
    return sized.agg(
        F.sum("len").alias("genome_len_cnv_all"),
        F.sum(F.when(own, F.col("len"))).alias("genome_len_clonal"),
        F.try_divide(F.sum(F.col("len") * F.col("c")), F.sum("len")).alias("ploidy_cnv_all"),
        F.try_divide(F.sum(F.when(own, F.col("len") * F.col("c"))), F.sum(F.when(own, F.col("len")))).alias("ploidy_clonal"),
    )


def call(segments: DataFrame, period: Period, contigs: DataFrame, p: Params = Params(), strict: bool = False, flat: str = ERROR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, one row of totals, and the allele models behind the calls, from usable segments with snps (struct or null).
    Calls have their interval.

    Segments in a peak with sites take the peak's copies; those without sites give no call but count in the totals.
    Segments in no peak are subclonal, unless their copy number is within a tenth of an integer and they have sites.
    Overlapping peaks may call a segment twice; strict keeps its lowest peak only.
    """
    inside, outside = by_peaks(segments, period, strict)
    clonal = inside.withColumn("in_peak", F.lit(True))
    outside = outside.withColumn("cp_int", half_down(F.col("copy_no_float")).cast("int"))
    near = F.abs(F.col("cp_int") - F.col("copy_no_float")) <= 0.1
    outside = outside.withColumn("subclonal", ~near)
    rows = clonal.unionByName(outside.where("not subclonal").drop("subclonal").withColumn("in_peak", F.lit(False)))
    fitted = rows.where("snps is not null and cp_int >= 0").select("chr_idx", "start", "end", F.col("cp_int").alias("cp"), F.col("snps.coverage").alias("coverage"), F.col("snps.log_or").alias("log_or"), "copy_no_float", "stddev", "n_windows", "in_peak")
    fits = checkpoint(allele_models(fitted, period.purity, flat))  # a row for each segment with sites
    models = fits.select("chr_idx", "start", "end", "cp", "major_allele_cp")
    more = ("stddev", "n_windows", "in_peak")
    exact = fitted.select("chr_idx", "start", "end", "cp", "copy_no_float", *more).join(models.distinct(), ["chr_idx", "start", "end", "cp"])
    exact = exact.select("chr_idx", "start", "end", F.col("cp").cast("double").alias("cp"), "major_allele_cp", "copy_no_float", F.lit(True).alias("is_clonal"), *more)
    loose = outside.where("subclonal").select("chr_idx", "start", "end", F.col("copy_no_float").alias("cp"), F.lit(None).cast("int").alias("major_allele_cp"), "copy_no_float", F.lit(False).alias("is_clonal"), "stddev", "n_windows", F.lit(False).alias("in_peak"))
    calls = interval_columns(cumulative(exact.unionByName(loose), contigs), period.purity, period.ploidy, p)
    calls = calls.withColumn("stddev", F.col("stddev") * p.stddev_divider)
    return calls, totals(segments, period, strict), fits


def _by_segment():
    from pyspark.sql import Window

    return Window.partitionBy("chr_idx", "start", "end")


def weighted_ploidy(calls: DataFrame) -> DataFrame:
    """One row: length-weighted copies of all calls and of the clonal ones."""
    length = (F.col("end") - F.col("start") + 1).cast("double")
    own = F.when(F.col("is_clonal"), length)
    return calls.agg(F.try_divide(F.sum(length * F.col("cp")), F.sum(length)).alias("ploidy_all"), F.try_divide(F.sum(own * F.col("cp")), F.sum(own)).alias("ploidy_clonal"))
