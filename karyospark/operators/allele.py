"""Allele-specific copy numbers: two-Gaussian mixtures of log odds for each split of a copy number."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Probability mass of the expected log odds, tolerance and rounds of the mixture.
MASS = 0.9999
TOLERANCE = 1e-4
ROUNDS = 10_000
#: What log odds without variance give: an error that ends the run, or no fit.
ERROR, NO_FIT = "error", "no fit"


def truncated_poisson(rate: float) -> np.ndarray:
    """Probabilities of 1, 2, ... until, with that of 0, MASS is reached."""
    total, out, k = math.exp(-rate), [], 0
    while total < MASS:
        k += 1
        q = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if not out and k > rate + 60 * math.sqrt(rate) + 60:
            break
        out.append(q)
        total += q
    return np.array(out)


@functools.lru_cache(maxsize=1 << 14)
def expected_log_odds(minor: int, major: int, purity: float, depth: float) -> float:
    """Mean log ratio of the alleles' counts, both Poisson and positive."""
    cp = minor + major
    scale = depth / (cp * purity + 2 * (1 - purity))
    a, b = truncated_poisson((minor * purity + 1 - purity) * scale), truncated_poisson((major * purity + 1 - purity) * scale)
    if not len(a) or not len(b):
        return 0.0
    log = lambda q: float(q @ np.log(np.arange(1, len(q) + 1)) / q.sum())  # noqa: E731  the counts are independent
    return log(a) - log(b)


def padded(samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Samples as rows of a matrix, filled up with zeros, and which places hold values."""
    n = np.array([len(x) for x in samples])
    held = np.arange(n.max())[None, :] < n[:, None]
    out = np.zeros(held.shape)
    out[held] = np.concatenate(samples)
    return out, held


def mixtures(x: np.ndarray, held: np.ndarray, mu: np.ndarray, steps: list[list[tuple]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: weight of the curve at -mu, shared variance, convergence and log-likelihood of two normal curves at -mu and mu.

    All rows are fitted at once, each until its own weight and variance stand still. steps, a list for each row, gets
    (weight, variance, log-likelihood) of the row after each of its rounds.
    """
    n = held.sum(1)
    average = lambda v, h, k: np.where(h, v, 0.0).sum(1) / k
    mean = average(x, held, n)
    low, high = np.where(held, x, np.inf).min(1), np.where(held, x, -np.inf).max(1)
    alpha, var = (mean - low) / (high - low), average((x - mean[:, None]) ** 2, held, n)
    right = (x - mu[:, None]) ** 2
    apart, total = np.where(held, 4 * x * mu[:, None], 0.0), np.where(held, right, 0.0).sum(1)  # left less right, and all of right
    done = np.zeros(len(x), bool)
    at = np.arange(len(x))
    own, near = held.astype(np.float64), apart
    a, v, k, all_right = alpha.copy(), var.copy(), n, total
    for _ in range(ROUNDS + 1):
        if not len(at):
            break
        # posterior of the left curve, from the difference of the two exponents
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            post = near * (0.5 / v)[:, None]
            post += (np.log(np.maximum(1 - a, 0.0)) - np.log(a))[:, None]
            np.exp(post, out=post)
            post += 1
            np.reciprocal(post, out=post)
            new_v = (all_right + np.einsum("ij,ij->i", post, near)) / k
            new_a = np.minimum(1.0, np.einsum("ij,ij->i", post, own) / k)
            tiny = np.flatnonzero(~(new_v > 1e-6 * all_right / k))  # where the sum cancels
            if len(tiny):
                i = at[tiny]
                new_v[tiny] = average(post[tiny] * (x[i] + mu[i][:, None]) ** 2 + (1 - post[tiny]) * right[i], held[i], n[i])
            still = (np.abs((a - new_a) / a) < TOLERANCE) & (np.abs((v - new_v) / v) < TOLERANCE)
        alpha[at], var[at], done[at] = new_a, new_v, still
        if steps is not None:
            for i, step in zip(at.tolist(), zip(new_a.tolist(), new_v.tolist(), likelihoods(x[at], held[at], new_a, mu[at], new_v).tolist())):
                steps[i].append(step)
        go = ~(still | ~(new_a > 0) | ~(new_v > 0))
        if not go.all():
            at, new_a, new_v, own, near, k, all_right = (y[go] for y in (at, new_a, new_v, own, near, k, all_right))
        a, v = new_a, new_v
    return alpha, var, done, likelihoods(x, held, alpha, mu, var)


def likelihoods(x: np.ndarray, held: np.ndarray, alpha: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        curve = lambda m: -((x - m[:, None]) ** 2) / (2 * var[:, None]) - 0.5 * np.log(2 * math.pi * var)[:, None]
        both = np.logaddexp(np.log(alpha)[:, None] + curve(-mu), np.log(np.maximum(0.0, 1 - alpha))[:, None] + curve(mu))
    return np.where(held, both, 0.0).sum(1)


#: Values of a matrix of samples fitted at once.
BLOCK = 1 << 18


def select_many(samples: list[np.ndarray], cps: list[int], purity: float | list[float], depths: list[float], flat: str = ERROR, trace: bool = False) -> list[list[dict]]:
    """For each sample all splits of its copy number into minor and major with their fits; selected has the largest likelihood.
    purity: one for all, or one each.

    Of equal ones the smaller minor is selected. Log odds without any variance fit nothing: flat says whether that is an
    error or gives no fits. trace: each fit has its steps, as mixtures() gives them; even splits have none.
    """
    samples = [np.asarray(x, np.float64) for x in samples]
    variance = [float(x.var()) if len(x) else 0.0 for x in samples]
    purities = [purity] * len(samples) if isinstance(purity, float) else purity
    if flat == ERROR and not all(v > 0 for v in variance):
        raise ValueError("the variance of log odds has to be above 0")
    tasks = [(len(samples[i]), i, minor, cp - minor) for i, cp in enumerate(cps) if variance[i] > 0 for minor in range(cp // 2 + 1)]
    tasks.sort()  # samples of like length need little filling
    fits: list[list[dict]] = [[] for _ in samples]
    start = 0
    while start < len(tasks):
        stop = start + 1
        while stop < len(tasks) and (stop - start + 1) * tasks[stop][0] <= BLOCK:
            stop += 1
        block = tasks[start:stop]
        start = stop
        x, held = padded([samples[i] for _, i, _, _ in block])
        even = np.array([lo == hi for _, _, lo, hi in block])
        mu = np.array([0.0 if lo == hi else expected_log_odds(lo, hi, purities[i], depths[i]) for _, i, lo, hi in block])
        alpha, var, done, logl = np.ones(len(block)), np.array([variance[i] for _, i, _, _ in block]), np.ones(len(block), bool), np.zeros(len(block))
        logl[even] = likelihoods(x[even], held[even], alpha[even], mu[even], var[even])
        if not even.all():
            paths = [[] for _ in range(int((~even).sum()))] if trace else None
            alpha[~even], var[~even], done[~even], logl[~even] = mixtures(x[~even], held[~even], mu[~even], paths)
        for k, (_, i, lo, hi) in enumerate(block):
            fits[i].append({"minor": lo, "major": hi, "alpha": float(alpha[k]), "mu": float(mu[k]), "var": float(var[k]), "converged": bool(done[k]), "logl": float(logl[k])})
            if trace:
                fits[i][-1]["steps"] = [] if even[k] else paths[int((~even[:k]).sum())]
    for own in filter(None, fits):
        own.sort(key=lambda m: m["minor"])
        best = max(range(len(own)), key=lambda i: (own[i]["logl"], -i))
        for i, m in enumerate(own):
            m["selected"] = i == best
    return fits


def select(x: np.ndarray, cp: int, purity: float, depth: float) -> list[dict]:
    return select_many([x], [cp], purity, [depth])[0]


FITS = "array<struct<minor:int, major:int, alpha:double, mu:double, var:double, converged:boolean, logl:double, selected:boolean>>"


def allele_models(segments: DataFrame, purity: float | str, flat: str = ERROR, keys: tuple[str, ...] = ()) -> DataFrame:
    """Segments (chr_idx, start, end, cp, coverage, log_or) with models, major_allele_cp and logl of the selected one.

    Segments are fitted apart, in batches; rows with a null or negative cp, without log odds, or, unless that is an error,
    with log odds that don't vary have null results. purity: one for all, or the column that has it. keys: further
    columns that tell segments apart, such as the sample; they are kept.
    """
    own = [*keys, "chr_idx", "start", "end", "cp"]
    of_row = [purity] if isinstance(purity, str) else []
    ship(segments.sparkSession)
    # fits cost time, not bytes: an explicit number of partitions isn't merged into few
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.select(*own, *of_row, "coverage", "log_or").repartition(n, *keys, "chr_idx", "start", "end")

    def fit(batches):
        for pdf in batches:
            good = [i for i, (cp, x) in enumerate(zip(pdf["cp"], pdf["log_or"])) if x is not None and cp is not None and not pd.isna(cp) and cp >= 0 and len(x)]
            pick = lambda c: [float(pdf[c].iloc[i]) for i in good]
            got = select_many([pdf["log_or"].iloc[i] for i in good], [int(pdf["cp"].iloc[i]) for i in good], pick(purity) if of_row else purity, pick("coverage"), flat)
            fits = {i: own for i, own in zip(good, got) if own}
            best = {i: next(m for m in own if m["selected"]) for i, own in fits.items()}
            rows = range(len(pdf))
            majors = [max(best[i]["minor"], best[i]["major"]) if i in best else None for i in rows]
            logls = [best[i]["logl"] if i in best else None for i in rows]
            yield pdf[own].assign(models=[fits.get(i) for i in rows], major_allele_cp=pd.array(majors, "Int32"), logl=pd.array(logls, "Float64"))

    kinds = dict(segments.dtypes)
    named = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    return rows.mapInPandas(fit, f"{named}chr_idx int, start bigint, end bigint, cp int, models {FITS}, major_allele_cp int, logl double")


def allele_traces(segments: DataFrame, purity: float, flat: str = ERROR) -> DataFrame:
    """The iterations of allele_models(): a row (chr_idx, start, end, minor, major, round, alpha, var, logl) for each round,
    from 1, of each uneven split's fit. Rows that have null results there have none here.
    """
    ship(segments.sparkSession)
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = (F.col("cp") >= 0) & (F.size("log_or") > 0)
    rows = segments.where(good).select("chr_idx", "start", "end", "cp", "coverage", "log_or").repartition(n, "chr_idx", "start", "end")
    names = ["chr_idx", "start", "end", "minor", "major", "round", "alpha", "var", "logl"]

    def fit(batches):
        for pdf in batches:
            got = select_many(list(pdf["log_or"]), pdf["cp"].astype(int).tolist(), purity, pdf["coverage"].astype(float).tolist(), flat, trace=True)
            for place, own in zip(pdf[names[:3]].itertuples(index=False), got):  # a segment at a time: rounds can be many
                steps = [(*place, m["minor"], m["major"], k, *step) for m in own for k, step in enumerate(m["steps"], 1)]
                if steps:
                    yield pd.DataFrame(steps, columns=names)

    return rows.mapInPandas(fit, "chr_idx int, start bigint, end bigint, minor int, major int, round int, alpha double, var double, logl double")
