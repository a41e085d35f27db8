"""Change points of piecewise constant signals: sparse Bayesian learning, then backward elimination.

Contigs are fitted independently, those of each sample where keys name samples too: short ones in grouped functions, long ones in
blocks (changepoints.py). Breakpoints live in the basis of unit-norm, zero-mean
steps, whose inverse Gram matrix is tridiagonal; so each round costs time in proportion to the breakpoints
that are left. Elimination works on prefix sums and segment means.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..params import Params
from ..session import checkpoint, ship
from .blocks import along, numbered
from .intervals import interval_join
from .selection import split

#: Windows of a contig up to which one task fits it.
LONG = 1 << 18


def thomas(lower: np.ndarray, diag: np.ndarray, upper: np.ndarray, rhs: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solution of a tridiagonal system, with its forward and backward pivots; last: the diagonal of the backward ones, if another."""
    k = len(diag)
    lo, di, up, b = lower.tolist(), diag.tolist(), upper.tolist(), rhs.tolist()
    forward, backward = di[:], di[:] if last is None else last.tolist()
    for i in range(1, k):
        f = lo[i - 1] / forward[i - 1]
        forward[i] = di[i] - f * up[i - 1]
        b[i] -= f * b[i - 1]
    for i in range(k - 2, -1, -1):
        backward[i] -= up[i] * lo[i] / backward[i + 1]
    x = b
    if k:
        x[-1] /= forward[-1]
    for i in range(k - 2, -1, -1):
        x[i] = (x[i] - up[i] * x[i + 1]) / forward[i]
    return np.array(x), np.array(forward), np.array(backward)


def geometry(at: np.ndarray, z: np.ndarray, m: float, before: tuple[float, float] = (0.0, 0.0), behind: tuple[float, float] | None = None) -> tuple:
    """The inverse Gram matrix of the steps at these places and its product with z: its diagonal, its entries to the left
    and right of it, and the product. before, behind: place and z of the steps next to them; the signal's ends have none.
    """
    behind = (float(m), 0.0) if behind is None else behind
    edges = np.concatenate(([before[0]], at, [behind[0]])).astype(np.float64)
    gap, d = np.diff(edges), edges * (m - edges)
    x = edges[1:-1]
    h0 = x * (m - x) / m * (edges[2:] - edges[:-2]) / (gap[1:] * gap[:-1])
    h1 = -np.sqrt(d[:-1] * d[1:]) / (m * gap)  # none beyond the ends
    left, right = h1[:-1], h1[1:]
    around = np.concatenate(([before[1]], z, [behind[1]]))
    w0 = h0 * z
    w0[:-1] += right[:-1] * z[1:]
    w0[-1:] += right[-1:] * around[-1]
    w0[1:] += left[1:] * z[:-1]
    w0[:1] += left[:1] * around[0]
    return h0, left, right, w0


def posterior(h0: np.ndarray, left: np.ndarray, right: np.ndarray, alpha: np.ndarray, w0: np.ndarray, v: float, before: tuple | None = None, behind: tuple | None = None) -> tuple:
    """Solves T w = w0, T = I + v H A: the diagonal of T^-1, that of T^-1 H, and w.

    before: forward pivot and reduced right side of the unknown before these, whose precision alpha begins with then; behind:
    backward pivot and value of the one behind, whose precision ends alpha then.
    """
    own_alpha = alpha[1 if before else 0 : len(alpha) - (1 if behind else 0)]
    k = len(h0)
    diag = 1 + v * h0 * own_alpha
    upper, lower = v * right[:-1] * own_alpha[1:], v * left[1:] * own_alpha[:-1]
    first, last, rhs = diag.copy(), diag.copy(), w0.copy()
    if before:
        up_in, low_in = v * left[0] * own_alpha[0], v * left[0] * alpha[0]
        first[0] -= low_in / before[0] * up_in
        rhs[0] -= low_in / before[0] * before[1]
    if behind:
        up_out, low_out = v * right[-1] * alpha[-1], v * right[-1] * own_alpha[-1]
        last[-1] -= up_out * low_out / behind[0]
        rhs[-1] -= up_out * behind[1]
    new, forward, backward = thomas(lower, first, upper, rhs, last)
    own = 1 / (forward + backward - diag)
    # neighbours in the inverse follow from the pivots
    spread = own * h0
    spread[:-1] += right[:-1] * (-upper / backward[1:]) * own[:-1]
    spread[1:] += left[1:] * (-lower / forward[:-1]) * own[1:]
    if before:
        spread[0] += left[0] * (-low_in / before[0]) * own[0]
    if behind:
        spread[k - 1] += right[-1] * (-up_out / behind[0]) * own[k - 1]
    return own, spread, new


def learn_from(at: np.ndarray, alpha: np.ndarray, weight: np.ndarray, z: np.ndarray, m: int, variance: float, rounds: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Goes on with learning after so many rounds; the places and z of the steps that survive."""
    while len(at):
        h0, left, right, w0 = geometry(at, z, m)
        fitted = False
        while rounds < p.segment_rounds:
            rounds += 1
            _, spread, new = posterior(h0, left, right, alpha, w0, variance)
            alpha = (1 + 2 * p.segment_a) / (new * new + np.maximum(variance * spread, 0) + 2 * p.segment_b)
            still = np.max(np.abs(new - weight)) < p.segment_tolerance
            weight = new
            kept = alpha < p.segment_max_alpha
            if still:
                fitted = True
                break
            if kept.sum() < 0.9 * len(kept):
                break
        if fitted or rounds >= p.segment_rounds:
            kept = alpha < p.segment_max_alpha
            return at[kept], z[kept]
        at, alpha, weight, z = at[kept], alpha[kept], weight[kept], z[kept]
    return at, z


def learn(y: np.ndarray, variance: float, p: Params = Params()) -> np.ndarray:
    """Breakpoints (first index of each right side) that survive sparse Bayesian learning on a centred signal.

    Each round solves T w = w0 with T = I + v H A, H the tridiagonal inverse Gram matrix of the kept steps and A
    their precisions, takes the posterior variances as v diag(T^-1 H), and updates A from both. Steps with
    precisions beyond the limit go once the weights stand still; the signal is fitted anew without them.
    """
    m = len(y)
    at = np.arange(1, m)
    if m < 2 or variance <= 0:
        return at[np.abs(np.diff(y)) > 0]
    z = -np.cumsum(y)[:-1] * np.sqrt(m / (at * (m - at.astype(np.float64))))
    return learn_from(at, np.zeros(m - 1), np.zeros(m - 1), z, m, variance, 0, p)[0]


def eliminate_points(at: np.ndarray, sums: np.ndarray, m: int, sigma: float, threshold: float, least: int, whole: float = 0.0) -> list[int]:
    """Breakpoints left after removing, one by one, the weakest until all are strong and all runs long enough.

    sums: the signal's sum up to each breakpoint; whole: all of it, zero for a centred one. Weak ones (t below threshold times sigma) go first, by t and the
    shorter run beside them; then those beside a run shorter than least, by that run and t. Of equal ones the left one goes first.
    """
    points = [0, *map(int, at), m]
    total = dict(zip(points, [0.0, *map(float, sums), whole]))
    left = {b: a for a, b in zip(points, points[1:])}
    right = {a: b for a, b in zip(points, points[1:])}
    stamp = dict.fromkeys(points, 0)

    def key(b: int) -> tuple:
        a, c = left[b], right[b]
        n, k = b - a, c - b
        t = abs((total[c] - total[b]) / k - (total[b] - total[a]) / n) / np.sqrt(1 / n + 1 / k)
        short = min(n, k)
        return (0, t, short) if t < threshold * sigma else (1, short, t)

    heap = [(*key(b), b, 0) for b in points[1:-1]]
    heapq.heapify(heap)
    alive = set(points[1:-1])
    while heap:
        strong, first, _, b, s = heapq.heappop(heap)
        if b not in alive or stamp[b] != s:
            continue
        if strong and first >= least:
            break
        alive.discard(b)
        a, c = left[b], right[b]
        right[a], left[c] = c, a
        for n in (a, c):
            if n in alive:
                stamp[n] += 1
                heapq.heappush(heap, (*key(n), n, stamp[n]))
    return sorted(alive)


def eliminate(y: np.ndarray, at: np.ndarray, sigma: float, threshold: float, least: int) -> list[int]:
    """eliminate_points() of a signal."""
    return eliminate_points(at, np.cumsum(y)[np.asarray(at, np.int64) - 1] if len(at) else np.zeros(0), len(y), sigma, threshold, least, float(np.sum(y)))


def change_points(y: np.ndarray, threshold: float, least: int, p: Params = Params(), variance: float | None = None) -> list[int]:
    """Breakpoints of a signal; none for one of fewer than two values or without any change."""
    y = np.asarray(y, np.float64)
    if len(y) < 2:
        return []
    v = float(np.sum(0.5 * np.diff(y) ** 2) / (len(y) - 1)) if variance is None or variance < 0 else variance
    centred = y - y.mean()
    return eliminate(centred, learn(centred, v, p), np.sqrt(v), threshold, least)


def trimmed_stats(v: np.ndarray, percent: float) -> tuple[float, float]:
    s = np.sort(v)[::-1]
    n = len(s)
    s = s[int(n * percent / 200) : int(n * (100 - percent / 2) / 100) + 1]
    return float(s.mean()), float(np.sqrt(max(0.0, (s * s).mean() - s.mean() ** 2)))


def segment(ratio: DataFrame, p: Params = Params(), window: int | None = None, keys: tuple[str, ...] = ("chr_idx",), long: int = LONG, block: int | None = None, finish: int | None = None) -> DataFrame:
    """(keys, start, end, ratio, stddev, n_windows) of each contig's segments.

    ratio: (keys, start, coverage_ratio). A contig of up to long windows is one task; longer ones are learnt in blocks, and
    their segments' values selected in rounds, so that no task holds them. block, finish: see long_change_points().
    """
    w = window or p.window_size
    ship(ratio.sparkSession)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", kind="stable")
        y, start = pdf["coverage_ratio"].to_numpy(), pdf["start"].to_numpy()
        edges = [0, *change_points(y, p.segment_threshold, p.segment_min_length, p), len(y)]
        rows = [(*key, int(start[a]), int(start[b - 1] + w - 1), *trimmed_stats(y[a:b], p.trim_percent), b - a) for a, b in zip(edges, edges[1:])]
        return pd.DataFrame(rows, columns=[*keys, "start", "end", "ratio", "stddev", "n_windows"])

    kinds = dict(ratio.dtypes) | {"chr_idx": "int"}
    rows = ratio.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.col("start").cast("bigint").alias("start"), F.col("coverage_ratio").cast("double").alias("coverage_ratio")).where("coverage_ratio is not null")
    short, many, _ = split(rows, keys, long)
    got = short.groupBy(*keys).applyInPandas(fit, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start bigint, end bigint, ratio double, stddev double, n_windows bigint")
    return got if many is None else got.unionByName(long_segments(many, p, w, keys, block, finish))


def long_segments(rows: DataFrame, p: Params, w: int, keys: tuple[str, ...], block: int | None = None, finish: int | None = None) -> DataFrame:
    """segment() of contigs that no task holds."""
    from .changepoints import BLOCK, FINISH, long_change_points
    from .histogram import trimmed

    placed = checkpoint(numbered(rows, keys, "start", block or BLOCK))
    points = long_change_points(placed.select(*keys, "_i", F.col("coverage_ratio").alias("y")), keys, p, block or BLOCK, finish or FINISH)
    starts = points.select(*keys, F.col("at").alias("first")).unionByName(placed.select(*keys).distinct().withColumn("first", F.lit(0).cast("bigint")))
    after = F.lead("first").over(Window.partitionBy(*keys).orderBy("first"))  # a contig's breakpoints
    spans = checkpoint(starts.withColumn("last", F.coalesce(after - 1, F.lit(1 << 62))))
    each = checkpoint(interval_join(placed, spans, list(keys), "_i", "first", "last", 1000).drop("_i", "last"))
    group = [*keys, "first"]
    ends = each.groupBy(*group).agg(F.min("start").alias("start"), (F.max("start") + w - 1).alias("end"))
    stats = trimmed(each, "coverage_ratio", *group, percent=p.trim_percent)
    counts = each.groupBy(*group).agg(F.count("*").alias("n_windows"))
    rows = ends.join(stats, group).join(counts, group)
    return rows.select(*keys, "start", "end", F.col("mean").alias("ratio"), "stddev", "n_windows")


def collapse(segments: DataFrame, base: DataFrame, variance: float, threshold: float = 5.0, keys: tuple[str, ...] = ("chr_idx",), block: int | None = None) -> DataFrame:
    """Segments with level, the base level where it can't be told from it, and state gain, loss or neutral.

    A segment within threshold standard errors of the base collapses if a neighbour is as near, if it is its contig's
    first or last, or if it is longer than a neighbour. Tests use the levels before any collapse. block: see blocks.along().
    """
    rows = segments.join(base, list(keys))
    near = F.abs(F.col("ratio") - F.col("base_level")) / F.sqrt(F.lit(variance) / F.col("n_windows")) < threshold

    def beside(d: DataFrame, order: WindowSpec) -> DataFrame:
        side = lambda f: (f("near").over(order), f("n_windows").over(order))
        (near_before, n_before), (near_after, n_after) = side(F.lag), side(F.lead)
        return d.withColumns({"_nb": near_before, "_n": n_before, "_na": near_after, "_m": n_after})

    rows = along(rows.withColumn("near", near), keys, "start", 1, 1, beside, block)
    joins = F.col("_nb") | F.col("_na") | F.col("_n").isNull() | F.col("_m").isNull() | (F.col("n_windows") > F.col("_n")) | (F.col("n_windows") > F.col("_m"))
    level = F.when(F.col("near") & F.coalesce(joins, F.lit(False)), F.col("base_level")).otherwise(F.col("ratio"))
    rows = rows.withColumn("level", level)
    state = F.when(F.col("level") > F.col("base_level"), "gain").when(F.col("level") < F.col("base_level"), "loss").otherwise("neutral")
    return rows.select(*segments.columns, "base_level", "level", state.alias("state"))


def integer_states(segments: DataFrame, base: DataFrame, variance: float, ploidy: int = 2, threshold: float = 5.0, most: int = 100, keys: tuple[str, ...] = ("chr_idx",)) -> DataFrame:
    """Segments with copies: the number nearest to ploidy whose log2 level can't be told from the segment's (levels are log2)."""
    rows = segments.join(base, list(keys))
    error = threshold * F.sqrt(F.lit(variance) / F.col("n_windows"))
    d = F.col("ratio") - F.col("base_level")
    up = F.least(F.lit(most), F.greatest(F.lit(ploidy), F.floor(F.pow(F.lit(2.0), d - error) * ploidy).cast("int") + 1))
    down = F.greatest(F.lit(0), F.least(F.lit(ploidy), F.ceil(F.pow(F.lit(2.0), d + error) * ploidy).cast("int") - 1))
    copies = F.when(F.abs(d) < error, ploidy).when(d > 0, up).otherwise(down)
    return rows.select(*segments.columns, copies.alias("copies"))


def fitted(ratio: DataFrame, segments: DataFrame, width: int = 100_000, keys: tuple[str, ...] = ("chr_idx",)) -> DataFrame:
    """Ratio rows with the level of their segment."""
    return interval_join(ratio, segments.select(*keys, F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.col("ratio").alias("fitted")), list(keys), "start", "seg_start", "seg_end", width)


def labelled(segments: DataFrame, base: DataFrame, threshold: float = 5.0, keys: tuple[str, ...] = ("chr_idx",)) -> DataFrame:
    """Segments with state gain, loss or neutral: by t against the contig's base level."""
    rows = segments.join(base, list(keys))
    t = (F.col("ratio") - F.col("base_level")) * F.sqrt(F.col("n_windows").cast("double")) / F.when(F.col("stddev") > 0, F.col("stddev"))
    return rows.withColumn("state", F.when(t > threshold, "gain").when(t < -threshold, "loss").otherwise("neutral"))
