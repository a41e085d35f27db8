"""Statistics as column expressions: gamma by its asymptotic series, binomials, and what follows from them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: the asymptotic series at z + 8, and back down by the recurrence; 14 digits."""
    z = z.cast("double")
    x = z + 8
    inner = 1 / (x * x)
    series = (1 / 12 - inner * (1 / 360 - inner * (1 / 1260 - inner * (1 / 1680 - inner / 1188)))) / x
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.ln(z + k)
    return (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series - down


def log_factorial(n: Column) -> Column:
    return log_gamma(n + 1)


def choose(n: Column, k: Column) -> Column:
    return F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k))


def binomial(n: Column, k: Column, p: float) -> Column:
    return choose(n, k) * F.pow(F.lit(p), k) * F.pow(F.lit(1 - p), n - k)


def binomial_max(n: Column, p: float, log: bool = False) -> Column:
    """Expected share of the larger of two sides when n draws fall to one side with probability p, or of its log10; 0 for n = 0."""
    n = n.cast("int")

    def part(k: Column) -> Column:
        larger = F.greatest(k, n - k).cast("double") / n
        return binomial(n, k, p) * (F.log10(larger) if log else larger)

    sides = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), part)
    return F.when(n > 0, F.aggregate(sides, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def negative_binomial_parameters(mean: Column, variance: Column) -> tuple[Column, Column]:
    """p and r of a negative binomial of this mean and larger variance."""
    return 1 - mean / variance, mean * mean / (variance - mean)


def negative_binomial(p: Column, r: Column, k: Column) -> Column:
    return choose(k + r - 1, k) * F.pow(1 - p, r) * F.pow(p, k)


def normal_density(x: Column, mean: Column, stddev: Column) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * stddev * stddev)) / (stddev * math.sqrt(2 * math.pi))
