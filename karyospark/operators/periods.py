"""Candidate periods, periodic peaks, and the likelihood of a period; on tables of fixed size, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params
from .segmentation import change_points

# The quantile that bounds flat slopes, and messages of the plain method.
FLAT_QUANTILE = 0.4
TOO_NOISY, TOO_LITTLE_VARIATION = "too noisy", "not enough variation"


def exclusion_zone(diff: np.ndarray) -> tuple[float, float]:
    """Slopes within these bounds count as flat: quantiles of a normal curve with their median and raw deviation."""
    mid = float(np.median(diff))
    mad = float(np.median(np.abs(diff - mid)))
    z = NormalDist().inv_cdf(FLAT_QUANTILE) * mad
    return mid + z, mid - z


def signs(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lags whose slope is clearly up or down, and +1 or -1 for each."""
    left, right = exclusion_zone(diff)
    sign = np.where(diff > max(0.0, right), 1, np.where(diff < min(0.0, left), -1, 0))
    lags = np.flatnonzero(sign)
    return lags, sign[lags]


@dataclass
class Candidate:
    period: int
    auto_cor: float
    lower: int = 0
    upper: int = 0


def slope_runs(diff: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Lags that aren't flat, and runs of them (from, to, mean sign) between change points of their signs."""
    lags, sign = signs(diff)
    if not len(lags):
        return lags, []
    edges = [0, *change_points(sign.astype(float), p.period_threshold, p.min_period_run, p), len(lags)]
    return lags, [(a, b, float(sign[a:b].mean())) for a, b in zip(edges, edges[1:])]


def candidates(acf: np.ndarray, diff: np.ndarray, p: Params = Params()) -> list[Candidate]:
    """Periods where runs of rising lags turn into runs of falling ones: the two best, near enough to each other."""
    lags, runs = slope_runs(diff, p)
    found = []
    for (a, b, up), (c, d, down) in zip(runs, runs[1:]):
        if up > 0 > down and min(b - a, d - c) >= p.min_period_run:
            span = np.arange(lags[b - 1], min(p.max_period, lags[c]))
            if len(span):
                best = int(span[np.argmax(acf[span])])
                if 0 < best <= p.max_period:
                    found.append(Candidate(best, float(acf[best]), best, best))
    found.sort(key=lambda c: -c.auto_cor)
    return [c for c in found[:2] if c is found[0] or found[0].auto_cor < p.period_ratio * c.auto_cor]


def local_maxima(acf: np.ndarray, reach: int = 20) -> list[int]:
    """Places above all of reach values to the left and not below any of as many to the right."""
    out = []
    for i in range(1, len(acf)):
        if (acf[max(0, i - reach) : i] < acf[i]).all() and (acf[i + 1 : i + 1 + reach] <= acf[i]).all():
            out.append(i)
    return out


def bounds(acf: np.ndarray, top: int, p: Params) -> tuple[int, int]:
    """How far around top the curve stays high, min_bound_reach at least."""
    limit = p.bound_share * acf[top]
    low, high = top - 1, top + 1
    while low > 0 and (acf[low] > limit or top - low < p.min_bound_reach):
        low -= 1
    while high < len(acf) and (acf[high] > limit or high - top < p.min_bound_reach):
        high += 1
    return low, high


def draw_ups(acf: np.ndarray) -> np.ndarray:
    """How far each lag stands above the lowest up to it."""
    return acf - np.minimum.accumulate(acf)


def candidate_by_draw_up(acf: np.ndarray, p: Params = Params()) -> Candidate | str:
    """The plain method: the lag highest above the lowest before it, or why there is none.

    If half of a narrow peak's period has a clear peak of its own, that is the period.
    """
    rise = draw_ups(acf)
    top = int(rise.argmax())
    before = acf[max(1, top - p.shoulder_reach + 1) : top]
    after = acf[top + 1 : min(len(acf) - 1, top + p.shoulder_reach)]
    if not (before <= p.shoulder_left * acf[top]).any() or not (after <= p.shoulder_right * acf[top]).any():
        return TOO_NOISY
    if acf[top] < 0.001 * acf[0]:
        return TOO_LITTLE_VARIATION
    low, high = bounds(acf, top, p)
    if high - low <= 100:
        half, width = top / 2, (high - low) / 6
        near = [i for i in local_maxima(acf) if rise[i] >= 0.25 * acf[top] and abs(i - half) <= width]
        if near:
            top = near[0]
            low, high = bounds(acf, top, p)
    return Candidate(top, float(acf[top]), low, high)


@dataclass
class Peak:
    index: int
    center: int
    height: float
    lo: int
    hi: int
    half_width: int
    n_windows: float = 0.0
    n_snps: int = 0
    logl: float | None = None


def padded(density: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Densities at the places, 0 outside."""
    ok = (at >= 0) & (at < len(density))
    return np.where(ok, density[np.clip(at, 0, len(density) - 1)], 0.0)


def first_peak_scores(density: np.ndarray, period: int, reach: int, p: Params = Params()) -> np.ndarray:
    """For each place the density at all periodic places from it on, 0 where a first peak can't be.

    Places beside a periodic one count by the inverse square of how far they are.
    """
    centers = np.arange(p.first_peak_min, p.first_peak_max + period // 4 + 1)
    side = np.arange(1, reach + 1)
    local = density.copy()
    for j in side:
        local += (padded(density, np.arange(len(density)) - j) + padded(density, np.arange(len(density)) + j)) / (j * j)
    score = np.zeros(p.first_peak_max + period // 4 + reach + 2)
    for c in centers:
        if c < len(density) and density[c] >= p.peak_height_min:
            places = np.arange(c + period, len(density) - reach, period)
            score[c] = local[c] + local[places].sum()
    return score


def first_peak(density: np.ndarray, period: int, reach: int, p: Params = Params()) -> tuple[int, int] | None:
    """Center and half width of the first peak, where the score is largest; None if no place is dense enough."""
    score = first_peak_scores(density, period, reach, p)
    if not score.any():
        return None
    best = int(score.argmax())
    return best, grown(score, best, reach, score[best], p.first_peak_min, p.first_peak_max + reach, p)


def grown(curve: np.ndarray, center: int, most: int, height: float, low: int, high: int, p: Params) -> int:
    """The half width up to which both sides together stay high, from 1."""
    width = 1
    while width <= most and center - width >= low and center + width <= high:
        if padded(curve, np.array([center - width, center + width])).sum() < 2 * p.half_width_share * height:
            break
        width += 1
    return width


def peaks_of(density: np.ndarray, period: int, first: int, width: int, reach: int, moments, p: Params = Params()) -> list[Peak]:
    """Peaks a period apart from the first, each moved to the mean ratio of the segments in its bounds.

    moments: (ratio_int, sum of n^1.5, sum of ratio times n^1.5) arrays of the segments by bucket.
    """
    buckets, weight, mass = moments
    if width > period // 2:
        width = int(period // 2 * 0.9)
    out = []
    for i, c in enumerate(range(first, p.max_ratio_int + 1, period)):
        lo, hi = max(c - width, 0), min(c + width, p.max_ratio_int)
        peak = Peak(i, c, float(density[c]), lo, hi, width)
        inside = (buckets >= lo) & (buckets <= hi)
        total = float(weight[inside].sum())
        if total > 0:
            peak.center = min(p.max_ratio_int, int(float(mass[inside].sum()) / total * p.ratio_scale))
            peak.height = float(density[peak.center])
            peak.half_width = grown(density, peak.center, reach, peak.height, p.first_peak_min, len(density) - 1, p)
            peak.lo, peak.hi = max(peak.center - peak.half_width, 0), min(peak.center + peak.half_width, p.max_ratio_int)
        out.append(peak)
    return out


def purity_ploidy(period: float, center_two: float, scale: int = 1000) -> tuple[float, float]:
    """Purity and ploidy from the period and the center of two copies."""
    return 2.0 * period / center_two, 2 + (scale - center_two) / period


def clamped_purity(purity: float) -> float | None:
    """Purities barely outside (0, 1) are moved in, others are None."""
    if 1 <= purity < 1.1:
        return 0.99
    if -0.1 < purity <= 0:
        return 0.03
    return purity if 0 < purity < 1 else None


def purity_ploidy_columns(period: Column, center_two: Column, scale: int = 1000) -> tuple[Column, Column]:
    """The same as columns, for many hypotheses at once: clamped purity, null where there is none, and ploidy."""
    purity = 2.0 * period.cast("double") / center_two
    clamped = F.when((purity >= 1) & (purity < 1.1), 0.99).when((purity > -0.1) & (purity <= 0), 0.03).when((purity > 0) & (purity < 1), purity)
    return clamped, 2 + (scale - center_two) / period.cast("double")


@dataclass
class Period:
    """A period with its peaks, likelihood and what follows from it."""

    period: int
    auto_cor: float
    peaks: list[Peak] = field(default_factory=list)
    first: int = 0
    copies_before: int = 0
    center_two: int = 0
    purity: float = -1.0
    ploidy: float = -1.0
    logl_rc: float = 0.0
    penalty_rc: float = 0.0
    logl_snp: float = -1e99
    n_snps: int = 0
    penalty_snp: float = 0.0
    n_parameters: int = 0

    @property
    def logl(self) -> float:
        return self.logl_rc + self.penalty_rc + self.logl_snp


def hypothesis(period: Period) -> bool:
    """Sets copies before the first peak, purity and ploidy: the peak of most windows has two copies.

    False where that can't be: it is beyond the third peak, or purity or ploidy are out of range.
    """
    tallest = max(period.peaks, key=lambda x: (x.n_windows, -x.index))
    if tallest.index > 2:
        return False
    before = min(max(0, 2 - tallest.index), int(np.floor(period.first / period.period + 0.2)))
    two = 2 - before
    center = period.peaks[two].center if two < len(period.peaks) else period.first + two * period.period
    purity, ploidy = purity_ploidy(period.period, center)
    clamped = clamped_purity(purity)
    if ploidy < 0 or clamped is None:
        return False
    period.copies_before, period.center_two, period.purity, period.ploidy = before, center, clamped, ploidy
    return True


def subclone_peaks(pooled: np.ndarray, least: float = 2e3, above: float = 5.0) -> list[tuple[int, float, float]]:
    """(place, height, score) of peaks that stand out at four widths at once, above so many deviations of the widest; edges are cut off."""
    out = []
    for i in range(5, len(pooled) - 5):
        x = pooled[i]
        if x < least or x < pooled[i - 3 : i + 4].max():
            continue
        means, devs = [], []
        for before, n in ((55, 45), (27, 23), (10, 10), (5, 5)):
            w = pooled[max(i - before, 0) : max(i - before, 0) + n]
            means.append(float(w.mean()))
            devs.append(max(float(w.std(ddof=1)) if len(w) > 1 else 0.0, 1e-12))
        rising = means[0] < means[1] < means[2] < means[3] < x
        steps = [*np.diff(means), x - means[3]]
        score = sum(s / d for s, d in zip(steps, devs))
        if rising and score > 3 and (x - means[0]) / devs[0] > above:
            out.append((i, float(x), float(score)))
    return out
