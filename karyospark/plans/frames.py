"""The tables behind an inference's outputs and plots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import plot_scale
from ..operators import histogram as H
from ..operators.calls import peak_table
from ..operators.intervals import bucket_join, cumulative, fill
from ..operators.periods import slope_runs, subclone_peaks
from .infer import Inference, dense_array


def frames(got: Inference) -> dict[str, DataFrame]:
    """All tables that the inference has, by name; without a best period those that need one are missing."""
    spark = got.density.sparkSession
    p = got.params
    lags, runs = slope_runs(dense_array(got.slopes, "shift", "diff", p.max_lag), p)
    out = {
        "auto": got.acf,
        "slope_runs": spark.createDataFrame([(int(lags[a]), int(lags[b - 1]), b - a, s) for a, b, s in runs], "first_lag int, last_lag int, n_lags int, level double"),
        "slopes": got.slopes.withColumn("sign", F.when(F.col("diff") > 0, 1).otherwise(-1)),
        "ratio_density": got.density,
        "ratio_by_contig": by_contig(got.usable),
        "snp_by_segment": got.usable.where("snps is not null").select("chr_idx", "start", "end", "ratio", "n_windows", F.explode("snps.log_or").alias("log_or")),
        "periods": spark.createDataFrame([(x.period, float(x.auto_cor), x.first, x.copies_before, float(x.purity), float(x.ploidy), float(x.logl_rc), float(x.penalty_rc), float(x.logl_snp), float(x.logl)) for x in got.periods], "period int, auto_cor double, first_peak int, copies_before int, purity double, ploidy double, logl_rc double, penalty_rc double, logl_snp double, logl double"),
    }
    seen = [(x.period, y.index, y.center / p.ratio_scale, float(y.height), y.half_width, float(y.n_windows), y.n_snps, y.logl) for x in got.periods for y in x.peaks]
    out["rc_log"] = spark.createDataFrame(seen, "period int, peak_index int, peak_center double, height double, half_width int, n_windows double, n_snps int, logl double")
    snp = [(x.period, x.copies_before, float(x.purity), float(x.ploidy), x.n_snps, x.n_parameters, float(x.penalty_snp), float(x.logl_snp)) for x in got.periods]
    out["snp_log"] = spark.createDataFrame(snp, "period int, copies_before int, purity double, ploidy double, n_snps int, n_parameters int, penalty double, logl double")
    if got.best is None:
        return out
    peaks = peak_table(spark, got.best)
    first, period = got.best.first, got.best.period
    return out | {
        "summary": spark.createDataFrame([(float(got.best.purity), float(got.best.ploidy), float(got.best.logl), period, got.best.copies_before, first)], "purity double, ploidy double, logl double, period int, copies_before int, first_peak int"),
        "totals": got.totals,
        "calls": got.calls,
        "peaks": peaks,
        "peak_bounds": peaks.select((F.col("lo") / 1000).alias("lower_bound"), (F.col("hi") / 1000).alias("upper_bound")),
        "peak_ratios": peaks.select("peak_index", F.explode(F.sequence("lo", "hi")).alias("ratio_int")),
        "snp_by_peak": bucket_join(got.usable.where("snps is not null"), peaks).select("peak_index", "chr_idx", "start", "end", F.explode("snps.log_or").alias("log_or")),
        "models": got.models,
        "sub_peaks": spark.createDataFrame(subclones(got), "place int, height double, score double"),
        "folded": H.folded(got.density, first, period),
    }


def by_contig(usable: DataFrame) -> DataFrame:
    """Windows by ratio and contig, long; the wide form is histogram.ratio_by_contig."""
    return usable.groupBy("ratio_int", "chr_idx").agg(F.sum("n_windows").alias("n_windows"))


def genome_plot(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    """Calls and the neutral gaps between them in genome coordinates by contig and start, copies on the plot's scale."""
    rows = fill(calls.select("chr_idx", "start", "end", "cp", F.col("major_allele_cp").alias("major")), contigs)
    return cumulative(rows, contigs).withColumn("y", plot_scale(F.col("cp"))).withColumn("y_major", plot_scale(F.col("major"))).orderBy("chr_idx", "start")


def subclones(got: Inference) -> list[tuple[int, float, float]]:
    """Peaks of the histogram folded by the best period that stand out, in three periods side by side."""
    one = dense_array(H.folded(got.density, got.best.first, got.best.period), "phase", "density", got.best.period)
    return subclone_peaks(np.tile(one, 3))


#: Segments that set the upper end of a plot are longer than this.
LONG = 3_000_000


def plot_limits(calls: DataFrame) -> DataFrame:
    """One row: the largest copy number of long segments, and the largest major of clonal ones."""
    long = F.col("end") - F.col("start") + 1 > LONG
    return calls.agg(F.max(F.when(long, F.col("cp"))).alias("highest"), F.max(F.when(F.col("is_clonal"), F.col("major_allele_cp"))).alias("highest_major"))


def histogram_plot(density: DataFrame) -> DataFrame:
    """The places of the histogram that hold anything."""
    return density.where("density > 0").orderBy("ratio_int")


def gc_plot(ratio: DataFrame, gc: DataFrame, contigs: DataFrame, window: int) -> DataFrame:
    """(window_size, gc, n, mean_ratio): ratio rows by the GC count of the window that starts where they do.

    gc: (chr, window_size, start, gc) with places from 0; ratio rows start at 1 in each window.
    """
    named = ratio.join(F.broadcast(contigs.select("chr", "chr_idx")), "chr_idx").select("chr", (F.col("start") - 1).alias("start"), "coverage_ratio")
    return named.join(gc.where(F.col("start") % window == 0), ["chr", "start"]).groupBy("window_size", "gc").agg(F.count("*").alias("n"), F.avg("coverage_ratio").alias("mean_ratio"))


def maf_plot(snps: DataFrame, bins: int = 100) -> DataFrame:
    """(bin, n): heterozygous sites by the share of their larger tumor allele."""
    share = F.greatest("tumor_ro", "tumor_ao") / F.col("tumor_depth")
    return snps.where("tumor_depth > 0").groupBy(F.floor(share * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def history_plot(history: DataFrame) -> DataFrame:
    """Results of past runs by class of sample, true purity and commit, in that order."""
    return history.orderBy("sample_class", "true_purity", "commit_id")
