"""Inference of many samples at once, as tables keyed by sample.

Sums over segments and sites are grouped in Spark, so no task holds a sample. What one function sees of a sample are its
buckets of the ratio in thousandths, of fixed number; what it returns are hypotheses, a row for each sample and candidate
period. Allele models are fitted segment by segment, whatever sample they are of.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_down
from ..operators import histogram as H
from ..operators.allele import ERROR, allele_models
from ..operators.calls import copy_number
from ..operators.intervals import cumulative
from ..operators.periods import Period
from ..operators.snp import segment_bags
from ..params import Params
from ..session import checkpoint, ship
from .infer import NO_CANDIDATE, NO_FIT, OK, evaluated, parameters

#: Samples whose hypotheses, about 1 KB each, are broadcast; beyond that they are dealt over so many salts by a shuffle.
BROADCAST_SAMPLES, SALTS = 20_000, 16


def autocorrelation_of(density: np.ndarray, p: Params) -> np.ndarray:
    """Sums of the largest products a shift apart, as means of five neighbours."""
    raw = np.array([np.sort(density[: len(density) - k] * density[k:])[::-1][: p.top_terms].sum() for k in range(p.max_lag + 1)])
    near = np.ones(5)
    return np.convolve(raw, near, "same") / np.convolve(np.ones(len(raw)), near, "same")


def slopes_of(cor: np.ndarray) -> np.ndarray:
    """Steps of log10 on the scale of shift 0; 0 where a log has none."""
    scale = math.log10(cor[0]) if cor[0] > 0 else 10.0
    good = (cor[:-1] > 0) & (cor[1:] > 0) & (scale != 0)
    log = np.log10(np.where(cor > 0, cor, 1.0))
    return np.where(good, (log[1:] - log[:-1]) / (scale or 1.0), 0.0)


#: What a sample's buckets hold: density, sums of n^1.5 and of ratio times it, windows, sums of windows times the place
#: inside the bucket and its square, and windows and sites of segments that have sites.
SUMS = ("density", "w", "m", "n", "s1", "s2", "own_n", "sites")


def buckets(usable: DataFrame, p: Params, subject: str) -> DataFrame:
    """(subject, ratio_int, SUMS) of usable segments with snps: at most max_ratio_int + 1 rows a sample."""
    n = F.col("n_windows").cast("double")
    w, inside, own = n * F.sqrt(n), F.col("ratio") - F.col("ratio_int") / p.ratio_scale, F.col("snps").isNotNull()
    parts = (F.lit(0.0), w, w * F.col("ratio"), n, n * inside, n * inside * inside, F.when(own, n), F.col("snps.n").cast("double"))
    sums = usable.where(F.col("ratio_int") <= p.max_ratio_int).groupBy(subject, "ratio_int").agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(c) for c, x in zip(SUMS, parts)])
    dense = H.density(usable, p, subject).select(subject, "ratio_int", "density", *[F.lit(0.0).alias(c) for c in SUMS[1:]])
    return sums.unionByName(dense).groupBy(subject, "ratio_int").agg(*[F.sum(c).alias(c) for c in SUMS])


@dataclass
class BucketSums:
    """What a period's likelihood of ratios needs, summed over the buckets of its peaks."""

    of: dict[str, np.ndarray]
    p: Params

    def peaks(self, period: Period) -> dict[int, dict]:
        out = {}
        for x in period.peaks:
            at = slice(x.lo, x.hi + 1)
            n = self.of["n"][at].sum()
            if n > 0:
                away = (np.arange(x.lo, x.hi + 1) - x.center) / 1000
                ss = (self.of["n"][at] * away * away + 2 * away * self.of["s1"][at] + self.of["s2"][at]).sum()
                logl = -n / 2 - n * (math.log(math.sqrt(ss / n)) + 0.5 * math.log(2 * math.pi)) if ss > 0 else None
                out[x.index] = {"own_n": self.of["own_n"][at].sum(), "sites": self.of["sites"][at].sum(), "n": n, "logl": logl}
        return out


PEAKS = "array<struct<index:int, lo:int, hi:int, sites:bigint>>"
HYPOTHESIS = f"search string, candidate int, period int, first_peak int, copies_before int, purity double, ploidy double, logl_rc double, n_parameters int, peaks {PEAKS}"


def hypotheses(usable: DataFrame, p: Params, subject: str, auto: bool = True) -> DataFrame:
    """(subject, HYPOTHESIS): a row for each sample and candidate period, from 1; a purity of -1 can't be. A sample
    without candidates has one row of nulls that says in search why. logl_rc has its penalty.
    """
    ship(usable.sparkSession)
    names = [c.split()[0] for c in HYPOTHESIS.split(", ")[:9]] + ["peaks"]

    def look(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, of = rows["ratio_int"].to_numpy(np.int64), {}
        for c in SUMS:
            of[c] = np.zeros(p.max_ratio_int + 1)
            of[c][at] = rows[c]
        cor = autocorrelation_of(of["density"], p)
        held = np.flatnonzero(of["n"])
        moments = (held.astype(float), of["w"][held], of["m"][held])
        search, periods = evaluated(cor, slopes_of(cor), of["density"], moments, BucketSums(of, p), p, auto)
        out = []
        for k, x in enumerate(periods, 1):
            peaks = [{"index": y.index, "lo": y.lo, "hi": y.hi, "sites": int(y.n_snps)} for y in x.peaks]
            out.append((key[0], search, k, x.period, x.first, x.copies_before, float(x.purity), float(x.ploidy), float(x.logl_rc + x.penalty_rc), parameters(x, p), peaks))
        return pd.DataFrame(out or [(key[0], NO_FIT if search == OK else search, *[None] * 9)], columns=[subject, *names]).astype(object)

    return buckets(usable, p, subject).groupBy(subject).applyInPandas(look, f"`{subject}` {dict(usable.dtypes)[subject]}, {HYPOTHESIS}")


def by_sample(rows: DataFrame, told: DataFrame, subject: str, n: int) -> DataFrame:
    """Segments with what is told of their sample, in n rows: broadcast where they are few, else a large sample's segments
    are dealt over salts."""
    if n <= BROADCAST_SAMPLES:
        return rows.join(F.broadcast(told), subject)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("chr_idx", "start", "end"), F.lit(SALTS)).cast("int"))
    return salted.join(told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [subject, "_salt"]).drop("_salt")


def site_likelihoods(usable: DataFrame, told: DataFrame, p: Params, subject: str, n: int, flat: str = ERROR) -> DataFrame:
    """(subject, candidate, logl, n_snps): the best mixtures' log-likelihoods over the segments of each hypothesis' first peaks."""
    few = F.slice("peaks", 1, p.peaks_for_logl)
    tried = told.where("purity > 0").select(subject, "candidate", "copies_before", "purity", F.filter(few, lambda x: x["sites"] > p.min_peak_snps).alias("peaks"))
    rows = by_sample(usable.where(F.col("snps.n") > p.min_peak_snps), tried, subject, n)
    rows = rows.withColumn("peak", F.explode(F.filter("peaks", lambda x: F.col("ratio_int").between(x["lo"], x["hi"]))))
    cp = (F.col("copies_before") + F.col("peak.index")).alias("cp")
    asked = rows.select(subject, "candidate", F.col("snps.n").alias("n_snps"), "chr_idx", "start", "end", cp, "purity", "snps.coverage", "snps.log_or")
    fits = allele_models(asked, "purity", flat, (subject, "candidate", "n_snps"))
    return fits.groupBy(subject, "candidate").agg(F.sum("logl").alias("logl"), F.sum("n_snps").alias("n_snps"))


def best_hypotheses(told: DataFrame, sites: DataFrame, p: Params, subject: str) -> DataFrame:
    """(subject, status, purity, ploidy, period, first_peak, copies_before, logl, peaks): each sample's likeliest hypothesis,
    the earlier candidate of equal ones; nulls but for the status where none fits."""
    rows = told.join(sites, [subject, "candidate"], "left")
    total = F.col("logl_rc") + F.coalesce("logl", F.lit(0.0)) - 0.5 * F.col("n_parameters") * F.log(F.col("n_snps"))
    good = F.coalesce((F.col("purity") > 0) & (F.col("purity") <= 1) & (F.col("ploidy") > 0) & (F.col("n_snps") > p.min_peak_snps), F.lit(False))
    if p.force_period > 0:  # an ordinal that a sample doesn't have forces nothing
        rows = rows.join(told.groupBy(subject).agg(F.max("candidate").alias("_most")), subject)
        good = good & ((F.col("candidate") == p.force_period) | (F.col("_most") < p.force_period))
    what = F.when(good, F.struct("purity", "ploidy", "period", "first_peak", "copies_before", total.alias("logl"), "peaks"))
    best = rows.groupBy(subject).agg(F.max_by(what, F.when(good, F.struct(total, -F.col("candidate")))).alias("best"), F.first("search").alias("search"))
    status = F.when(F.col("best").isNotNull(), OK).when(F.col("search") == OK, NO_FIT).otherwise(F.col("search"))
    return best.select(subject, status.alias("status"), "best.*")


def cohort_majors(usable: DataFrame, best: DataFrame, subject: str, n: int, strict: bool, flat: str) -> DataFrame:
    """(subject, chr_idx, start, end, cp, major_allele_cp, copy_no_float, is_clonal): every call, by the rules of calls.call()."""
    rows = by_sample(usable, best.where(F.col("status") == OK), subject, n)
    inside = F.filter("peaks", lambda x: F.col("ratio_int").between(x["lo"], x["hi"]))
    called = F.filter("inside", lambda x: x["sites"] > 0)
    value = copy_number(F.col("ratio_int"), F.col("first_peak"), F.col("period"), F.col("copies_before"))
    rows = rows.withColumn("inside", inside).withColumn("copy_no_float", value)
    place = [subject, "chr_idx", "start", "end"]
    whole = half_down(F.col("copy_no_float")).cast("int")
    outside = F.size("inside") == 0
    subclonal = outside & (F.abs(whole - F.col("copy_no_float")) > 0.1)
    integers = F.transform(F.slice(called, 1, 1) if strict else called, lambda x: F.col("copies_before") + x["index"])
    integers = F.when(outside, F.array(whole)).otherwise(integers)
    exact = rows.where(~subclonal & F.col("snps").isNotNull()).select(*place, F.explode(integers).alias("cp"), "purity", "copy_no_float", "snps.coverage", "snps.log_or").where("cp >= 0")
    fits = allele_models(exact, "purity", flat, (subject, "copy_no_float")).select(*place, F.col("cp").cast("double").alias("cp"), "major_allele_cp", "copy_no_float", F.lit(True).alias("is_clonal"))
    loose = rows.where(subclonal).select(*place, F.col("copy_no_float").alias("cp"), F.lit(None).cast("int").alias("major_allele_cp"), "copy_no_float", F.lit(False).alias("is_clonal"))
    return fits.unionByName(loose)


def infer_cohort(segments: DataFrame, snps: DataFrame, contigs: DataFrame, p: Params = Params(), subject: str = "subject", strict: bool = False, auto: bool = True, flat: str = ERROR) -> DataFrame:
    """Calls of every sample with its status, purity, ploidy and period; a sample without calls has one row of nulls.

    segments and snps are those of infer() with a column that names the sample; samples are those that have segments.
    The joined segments, the hypotheses, the best of them and the calls are kept once each; all of it is keyed by sample, so neither
    tasks nor the driver grow with a sample or with their number.
    """
    usable = checkpoint(segment_bags(snps, H.usable_segments(segments, p), p, (subject, "chr_idx")))
    told = checkpoint(hypotheses(usable, p, subject, auto))
    n = told.count()
    best = checkpoint(best_hypotheses(told, site_likelihoods(usable, told, p, subject, n, flat), p, subject))
    calls = checkpoint(cohort_majors(usable, best, subject, n, strict, flat))
    head = segments.select(subject).distinct().join(best, subject, "left")
    head = head.select(subject, F.coalesce("status", F.lit(NO_CANDIDATE)).alias("status"), "purity", "ploidy", "period", "first_peak", "logl")
    lone = head.join(calls.select(subject).distinct(), subject, "left_anti")
    rows = by_sample(calls, head, subject, n).unionByName(lone, allowMissingColumns=True)
    order = [*head.columns, "chr_idx", "start", "end", "cp", "major_allele_cp", "copy_no_float", "is_clonal"]
    return cumulative(rows.select(*order), contigs, "left")
