"""The inference of one sample on arrays, without Spark: what tests hold the tables against."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd

from karyospark.operators.allele import ERROR, select_many
from karyospark.operators.periods import Period
from karyospark.params import Params
from karyospark.plans.cohort import autocorrelation_of, slopes_of
from karyospark.plans.infer import best_period


def density_of(ratio: np.ndarray, stddev: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    """The histogram by thousandths: each segment spreads its windows over two deviations to each side."""
    out = np.zeros(p.max_ratio_int + 1)
    m, s = ratio * p.ratio_scale, stddev * p.ratio_scale
    low, high = np.maximum(0, np.floor(m - 2 * s)).astype(np.int64), np.minimum(p.max_ratio_int, np.ceil(m + 2 * s)).astype(np.int64)
    keep = np.flatnonzero((ratio <= p.max_ratio_int / p.ratio_scale) & (low <= high))
    for part in np.array_split(keep, max(1, len(keep) // 1000)):  # so many bells at a time
        size = high[part] - low[part] + 1
        of = np.repeat(part, size)
        at = low[of] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        np.add.at(out, at, n[of] * p.kde_scale / s[of] * np.exp(-((at - m[of]) ** 2) / (2 * s[of] * s[of])))
    return out


@dataclass
class Sample:
    """A sample's usable segments as arrays, with the sites of each: None, or (number, median coverage, log odds)."""

    rows: pd.DataFrame
    bags: list
    p: Params
    flat: str = ERROR

    @staticmethod
    def of(segments: pd.DataFrame, snps: pd.DataFrame, p: Params, flat: str = ERROR) -> Sample:
        rows = segments.assign(stddev=segments["stddev"] / p.stddev_divider)
        rows = rows[~((rows["ratio"] > 0.1) & (rows["stddev"] > rows["ratio"])) & (rows["ratio"] <= p.max_ratio_range_int / p.ratio_scale) & (rows["stddev"] > 1e-12)]
        rows = rows.sort_values(["chr_idx", "start", "end"], kind="stable").reset_index(drop=True)
        rows["ratio_int"] = (rows["ratio"] * p.ratio_scale).astype(np.int64)
        # sites by contig and place, so that a segment's are a slice; then slices of log odds by size
        order = np.lexsort((snps["pos"], snps["chr_idx"]))
        contig, pos, odds, coverage = (snps[c].to_numpy()[order] for c in ("chr_idx", "pos", "log_or", "coverage"))
        low, high = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for c in np.unique(rows["chr_idx"]):
            first, last = np.searchsorted(contig, [c, c + 1])
            at = np.flatnonzero(rows["chr_idx"].to_numpy() == c)
            low[at] = first + np.searchsorted(pos[first:last], rows["start"].to_numpy()[at])
            high[at] = first + np.searchsorted(pos[first:last], rows["end"].to_numpy()[at], "right")
        bags = [(int(b - a), float(np.median(coverage[a:b])), np.sort(odds[a:b])) if b - a > p.min_segment_snps else None for a, b in zip(low.tolist(), high.tolist())]
        return Sample(rows, bags, p, flat)

    def inside(self, peak) -> np.ndarray:
        at = self.rows["ratio_int"].to_numpy()
        return np.flatnonzero((at >= peak.lo) & (at <= peak.hi))

    def peaks(self, period: Period) -> dict[int, dict]:
        out = {}
        n, ratio = self.rows["n_windows"].to_numpy(float), self.rows["ratio"].to_numpy()
        for x in period.peaks:
            at = self.inside(x)
            if len(at):
                own = [i for i in at if self.bags[i]]
                total, ss = n[at].sum(), (n[at] * (ratio[at] - x.center / 1000) ** 2).sum()
                logl = -total / 2 - total * (math.log(math.sqrt(ss / total)) + 0.5 * math.log(2 * math.pi)) if ss > 0 else None
                out[x.index] = {"own_n": n[own].sum(), "sites": sum(self.bags[i][0] for i in own), "n": total, "logl": logl}
        return out

    def likelihood(self, period: Period) -> tuple[float, int]:
        chosen = [(i, period.copies_before + x.index) for x in period.peaks[: self.p.peaks_for_logl] if x.n_snps > self.p.min_peak_snps for i in self.inside(x) if self.bags[i] and self.bags[i][0] > self.p.min_peak_snps]
        best = self.fits(chosen, period.purity)
        return sum(m["logl"] for m in best if m), sum(self.bags[i][0] for i, _ in chosen)

    def fits(self, chosen: list[tuple[int, int]], purity: float) -> list[dict | None]:
        got = select_many([self.bags[i][2] for i, _ in chosen], [cp for _, cp in chosen], purity, [self.bags[i][1] for i, _ in chosen], self.flat)
        return [next((m for m in own if m["selected"]), None) for own in got]

    def period(self, auto: bool) -> tuple[str, Period | None, list[Period]]:
        r = self.rows
        density = density_of(r["ratio"].to_numpy(), r["stddev"].to_numpy(), r["n_windows"].to_numpy(), self.p)
        cor = autocorrelation_of(density, self.p)
        low = r[r["ratio_int"] <= self.p.max_ratio_int]
        w = (low["n_windows"] ** 1.5).groupby(low["ratio_int"]).sum()
        m = (low["n_windows"] ** 1.5 * low["ratio"]).groupby(low["ratio_int"]).sum()
        return best_period(cor, slopes_of(cor), density, (w.index.to_numpy(float), w.to_numpy(), m.to_numpy()), self, self.p, auto)

    def calls(self, period: Period, strict: bool) -> list[tuple]:
        """(segment, cp, major, copies as they are, clonal) of every call."""
        at = self.rows["ratio_int"].to_numpy()
        copies = (at - period.first) / period.period + period.copies_before
        exact, out, held, called = [], [], np.zeros(len(at), bool), np.zeros(len(at), bool)
        for x in period.peaks:
            inside = self.inside(x)
            held[inside] = True
            if x.n_snps > 0:
                exact += [(int(i), period.copies_before + x.index) for i in inside if self.bags[i] and not (strict and called[i])]
                called[inside] = True
        for i in np.flatnonzero(~held):
            whole = int(copies[i]) + (copies[i] - int(copies[i]) > 0.5)
            if abs(whole - copies[i]) > 0.1:
                out.append((int(i), float(copies[i]), None, float(copies[i]), False))
            elif self.bags[i] and whole >= 0:
                exact.append((int(i), whole))
        exact = [x for x in exact if x[1] >= 0]
        for (i, cp), m in zip(exact, self.fits(exact, period.purity)):
            out.append((i, float(cp), max(m["minor"], m["major"]) if m else None, float(copies[i]), True))
        return out
