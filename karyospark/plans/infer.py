"""Inference: from segments and sites to purity, ploidy and copy numbers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import histogram as H
from ..operators.allele import ERROR, allele_models
from ..operators.calls import call, peak_table
from ..operators.intervals import bucket_join
from ..operators.periods import Candidate, Period, candidate_by_draw_up, candidates, first_peak, hypothesis, peaks_of
from ..operators.snp import segment_bags
from ..params import Params
from ..session import checkpoint

# How an inference can end.
OK, NO_CANDIDATE, NO_FIT = "ok", "no candidate period", "no period fits"


@dataclass
class Inference:
    """How it ended, the best period, all evaluated ones, and the frames behind every output."""

    status: str
    best: Period | None = None
    periods: list[Period] = field(default_factory=list)
    calls: DataFrame | None = None
    totals: DataFrame | None = None
    models: DataFrame | None = None
    usable: DataFrame | None = None
    density: DataFrame | None = None
    acf: DataFrame | None = None
    slopes: DataFrame | None = None
    n_segments: int = 0
    n_sites: int = 0
    params: Params = Params()
    auto: bool = True

    def summary(self) -> dict:
        b = self.best
        return {"status": self.status} | ({"purity": b.purity, "ploidy": b.ploidy, "period": b.period, "first_peak": b.first, "copies_before": b.copies_before, "logl": b.logl} if b else {})


def dense_array(rows: DataFrame, key: str, value: str, size: int) -> np.ndarray:
    """A table of at most size rows, as an array by its key; 0 where there is none."""
    out = np.zeros(size)
    for row in rows.select(key, value).collect():
        out[row[key]] = row[value]
    return out


def local(rows: DataFrame) -> DataFrame:
    """A table of fixed size, computed once."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


@dataclass
class TableSums:
    """What a period's likelihood needs of segments with snps, summed in Spark."""

    segments: DataFrame
    p: Params
    flat: str = ERROR

    def peaks(self, period: Period) -> dict[int, dict]:
        """For each peak with segments: windows (own_n) and sites of those that have any, and windows and likelihood of all."""
        own = F.sum(F.when(F.col("snps").isNotNull(), F.col("n_windows"))).alias("own_n")
        rows = H.peak_stats(self.segments, peak_table(self.segments.sparkSession, period), own, F.sum("snps.n").alias("sites"))
        return {r["peak_index"]: r.asDict() for r in rows.collect()}

    def likelihood(self, period: Period) -> tuple[float, int]:
        """Sum of the best mixtures' log-likelihoods of the first peaks' segments, and their sites; few sites take no part."""
        p, peaks = self.p, peak_table(self.segments.sparkSession, period)
        rows = bucket_join(self.segments, peaks.where((F.col("peak_index") < p.peaks_for_logl) & (F.col("peak_snps") > p.min_peak_snps)))
        rows = rows.where(F.col("snps.n") > p.min_peak_snps).select("chr_idx", "start", "end", F.col("peak_cp").alias("cp"), "snps.coverage", "snps.log_or", F.col("snps.n").alias("n"))
        total = allele_models(rows, period.purity, self.flat).agg(F.sum("logl").alias("logl")).first()["logl"]
        return float(total or 0.0), int(rows.agg(F.sum("n").alias("n")).first()["n"] or 0)


def evaluate(candidate: Candidate, sums, curve: np.ndarray, moments, reach: int, p: Params) -> Period | None:
    """The candidate's peaks, likelihood of ratios, purity (-1 where it can't be told) and ploidy; None where it has no
    first peak or no windows."""
    found = first_peak(curve, candidate.period, reach, p)
    if found is None:
        return None
    peaks = peaks_of(curve, candidate.period, found[0], found[1], reach, moments, p)
    period = Period(candidate.period, candidate.auto_cor, peaks, peaks[0].center)
    stats = sums.peaks(period)
    for i, x in stats.items():
        peaks[i].n_windows, peaks[i].n_snps, peaks[i].logl = float(x["own_n"] or 0), int(x["sites"] or 0), x["logl"]
    n = 0.0
    for x in sorted(peaks, key=lambda x: -x.height)[: p.peaks_for_logl]:
        if x.index in stats:
            period.logl_rc += float(stats[x.index]["logl"] or 0.0)
            n += float(stats[x.index]["n"])
    if n <= 0:
        return None
    period.penalty_rc = -0.5 * np.log(n) * (10 * p.ratio_scale - period.first) / period.period
    hypothesis(period)
    return period


def evaluated(cor: np.ndarray, diff: np.ndarray, curve: np.ndarray, moments, sums, p: Params, auto: bool) -> tuple[str, list[Period]]:
    """The candidate periods, without the likelihood of their sites; OK, or why there is none."""
    found = candidates(cor, diff, p) if auto else candidate_by_draw_up(cor, p)
    if isinstance(found, str):
        return found, []
    found = found if auto else [found]
    if not found:
        return NO_CANDIDATE, []
    reach = found[0].period // 4  # the first candidate's, for all of them
    return OK, [x for x in (evaluate(c, sums, curve, moments, reach, p) for c in found) if x is not None]


def parameters(period: Period, p: Params) -> int:
    """How many allele models the first peaks with enough sites have."""
    return sum((period.copies_before + x.index) // 2 + 1 for x in period.peaks[: p.peaks_for_logl] if x.n_snps > p.min_peak_snps)


def best_period(cor: np.ndarray, diff: np.ndarray, curve: np.ndarray, moments, sums, p: Params, auto: bool) -> tuple[str, Period | None, list[Period]]:
    """How the search for a period ends, the best one, and all that were evaluated."""
    status, periods = evaluated(cor, diff, curve, moments, sums, p, auto)
    if status != OK:
        return status, None, []
    for period in periods:
        if period.purity > 0:
            logl, n_snps = sums.likelihood(period)
            if n_snps > p.min_peak_snps:
                used = parameters(period, p)
                period.penalty_snp, period.n_parameters = -0.5 * used * float(np.log(n_snps)), used
                period.logl_snp, period.n_snps = logl + period.penalty_snp, n_snps
            else:
                period.purity = -1.0
    good = [x for x in periods if 0 < x.purity <= 1 and x.ploidy > 0 and x.logl_snp > -1e98]
    if 0 < p.force_period <= len(periods):
        good = [x for x in good if x is periods[p.force_period - 1]]
    return (OK, max(good, key=lambda x: x.logl), periods) if good else (NO_FIT, None, periods)


def infer(segments: DataFrame, snps: DataFrame, contigs: DataFrame, p: Params = Params(), strict: bool = False, auto: bool = True, flat: str = ERROR) -> Inference:
    """Inference over segments (chr_idx, start, end, ratio, stddev, n_windows) and sites (chr_idx, pos, log_or, coverage).

    Sums over segments run in Spark, from usable segments with their sites that are joined and kept once; what the
    driver looks at are tables of fixed size: the histogram by thousandths, its autocorrelation, and a handful of peaks.
    auto: candidate periods by change points of the slopes; else by the plain draw-up method. flat: what log odds without
    variance give. Many samples run side by side by cohort.infer_cohort().
    """
    usable = checkpoint(segment_bags(snps, H.usable_segments(segments, p), p))
    density = local(H.density(usable, p))
    acf = local(H.smoothed(H.autocorrelation(density, p)))
    slopes = local(H.slopes(acf))
    w = F.col("n_windows") * F.sqrt(F.col("n_windows").cast("double"))
    by_bucket = usable.where(F.col("ratio_int") <= p.max_ratio_int).groupBy("ratio_int").agg(F.sum(w).alias("w"), F.sum(w * F.col("ratio")).alias("m")).collect()
    moments = tuple(np.array([r[c] for r in by_bucket], np.float64) for c in ("ratio_int", "w", "m"))
    cor, diff = dense_array(acf, "shift", "cor", p.max_lag + 1), dense_array(slopes, "shift", "diff", p.max_lag)
    curve = dense_array(density, "ratio_int", "density", p.max_ratio_int + 1)
    status, best, periods = best_period(cor, diff, curve, moments, TableSums(usable, p, flat), p, auto)
    got = Inference(status, best, periods, usable=usable, density=density, acf=acf, slopes=slopes, n_segments=segments.count(), n_sites=snps.count(), params=p, auto=auto)
    if best is not None:
        got.calls, got.totals, got.models = call(usable, best, contigs, p, strict, flat)
    return got
