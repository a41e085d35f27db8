"""Recall and precision of predicted copy numbers against the truth, by shared length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numeric import int_div
from ..session import ship
from .intervals import overlap_join

# Autosomes, and the distance that a neutral truth gets.
AUTOSOMES = [f"chr{i}" for i in range(1, 23)]
NEUTRAL_DISTANCE = 10_000


def drop_neutral(pred: DataFrame) -> DataFrame:
    """Predicted rows without those of two copies of which one is major; unknown majors stay."""
    return pred.where(~F.coalesce((F.col("cp") == 2) & (F.col("major") == 1), F.lit(False)))


def overlaps(truth: DataFrame, pred: DataFrame, width: int = 100_000) -> DataFrame:
    """Pairs with their shared length and the two similarities; the major one is null unless both are clonal."""
    pairs = overlap_join(truth, pred, ["chr_id"], width=width)
    length = F.col("shared_end") - F.col("shared_start") + 1
    away = F.when(F.col("l_cp") == 2, F.lit(float(NEUTRAL_DISTANCE))).otherwise(F.abs(F.col("l_cp") - F.col("r_cp")))
    both = F.col("l_is_clonal") & F.col("r_is_clonal")
    return pairs.withColumn("shared", length).withColumn("cp_sim", length * F.exp(-away)).withColumn("major_sim", F.when(both, length * F.exp(-F.abs(F.col("l_major") - F.col("r_major")))))


def altered(rows: DataFrame, name: str) -> DataFrame:
    """One row: length with other than two copies, and length of clonal rows."""
    length = F.col("end") - F.col("start") + 1
    return rows.agg(F.sum(F.when(F.col("cp") != 2, length)).alias(f"{name}_altered"), F.sum(F.when(F.col("is_clonal"), length)).alias(f"{name}_clonal"))


def recall_precision(truth: DataFrame, pred: DataFrame, width: int = 100_000) -> DataFrame:
    """One row of cp_recall, cp_precision, mcp_recall, mcp_precision; null where nothing is altered.

    Neutral predicted rows are dropped first.
    """
    pred = drop_neutral(pred)
    sims = overlaps(truth, pred, width).agg(F.sum("cp_sim").alias("cp"), F.sum("major_sim").alias("mcp"))
    one = sims.crossJoin(altered(truth, "t")).crossJoin(altered(pred, "p"))  # three one-row tables
    share = lambda a, b: F.try_divide(F.coalesce(F.col(a), F.lit(0.0)), F.col(b))
    return one.select(share("cp", "t_altered").alias("cp_recall"), share("cp", "p_altered").alias("cp_precision"), share("mcp", "t_clonal").alias("mcp_recall"), share("mcp", "p_clonal").alias("mcp_precision"))


SHARES = ("cp", "mcp", "t_altered", "t_clonal", "p_altered", "p_clonal")


def swept(events: Iterator[tuple], sums: list[float]) -> None:
    """Adds to sums (as SHARES) what rows (start, end, side, cp, major, is_clonal) of a stretch, by start, share with each other.

    Rows stay open until one begins behind them, so only what overlaps one place is held.
    """
    held: tuple[list, list] = ([], [])
    for start, end, side, cp, major, clonal in events:
        length = end - start + 1
        if cp is not None and cp != 2:
            sums[2 + 2 * side] += length
        if clonal:
            sums[3 + 2 * side] += length
        for rows in held:
            if rows and min(r[0] for r in rows) < start:
                rows[:] = [r for r in rows if r[0] >= start]
        for other_end, other_cp, other_major, other_clonal in held[1 - side]:
            shared = min(end, other_end) - start + 1
            truth = other_cp if side else cp
            if cp is not None and other_cp is not None:
                sums[0] += shared * math.exp(-(NEUTRAL_DISTANCE if truth == 2 else abs(cp - other_cp)))
            if clonal and other_clonal and major is not None and other_major is not None:
                sums[1] += shared * math.exp(-abs(major - other_major))
        held[side].append((end, cp, major, clonal))


def recall_precision_of_runs(truth: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("run",), width: int = 10_000_000) -> DataFrame:
    """keys, cp_recall, cp_precision, mcp_recall, mcp_precision of each run in truth or pred; see recall_precision().

    A sweep along each contig in place of a table of pairs. Rows are cut at multiples of width, as shared lengths add up, so
    that a long contig is many tasks. Null keys are a run of their own; rows without a start or end, or that end before they start, don't count.
    """
    ship(truth.sparkSession)
    columns = [*keys, "chr_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("cp").cast("double").alias("cp"), F.col("major").cast("double").alias("major"), "is_clonal"]
    rows = truth.select(*columns, F.lit(0).alias("side")).unionByName(drop_neutral(pred).select(*columns, F.lit(1).alias("side")))
    of = lambda c: int_div(F.col(c) - F.pmod(F.col(c), F.lit(width)), width)
    stretch = F.explode(F.sequence(of("start"), of("end")))
    rows = rows.where(F.col("start") <= F.col("end")).withColumn("stretch", stretch)
    rows = rows.withColumn("start", F.greatest("start", F.col("stretch") * width)).withColumn("end", F.least("end", (F.col("stretch") + 1) * width - 1))
    place = [*keys, "chr_id", "stretch"]
    dealt = rows.select(*place, "start", "end", "side", "cp", "major", "is_clonal").repartition(*place).sortWithinPartitions(*place, "start", "end", "side", "cp", "major", "is_clonal")
    n, kinds = len(keys), dict(rows.dtypes)
    schema = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(dealt.select(*keys).schema)] + [pa.field(c, pa.float64()) for c in SHARES])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        each = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for key, group in groupby(each, key=lambda r: r[: n + 2]):
            sums = [0.0] * len(SHARES)
            swept((r[n + 2 :] for r in group), sums)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*key[:n], *sums], schema.types)], schema=schema)

    parts = dealt.mapInArrow(sweep, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{c} double" for c in SHARES]]))
    one = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SHARES])
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return one.select(*keys, share("cp", "t_altered").alias("cp_recall"), share("cp", "p_altered").alias("cp_precision"), share("mcp", "t_clonal").alias("mcp_recall"), share("mcp", "p_clonal").alias("mcp_precision"))


def passes(purity_error: float, ploidy_error: float, recalls: list[float], max_purity: float = 0.05, max_ploidy: float = 0.2, least: float = 0.7) -> bool:
    """The quality gate on absolute errors and on recalls and precisions."""
    return abs(purity_error) <= max_purity and abs(ploidy_error) <= max_ploidy and all(r is not None and r >= least for r in recalls)


def with_deltas(results: DataFrame) -> DataFrame:
    """Results of runs with the absolute errors of purity and ploidy (delta_purity, delta_ploidy)."""
    return results.withColumn("delta_purity", F.abs(F.col("est_purity") - F.col("true_purity"))).withColumn("delta_ploidy", F.abs(F.col("est_ploidy") - F.col("true_ploidy")))


def gated(results: DataFrame, max_purity: float = 0.05, max_ploidy: float = 0.2, least: float = 0.7) -> DataFrame:
    """Results with deltas and passed: whether the errors and all recalls and precisions are good enough; unknown ones aren't."""
    rows = with_deltas(results)
    shares = [F.col(c) >= least for c in ("cp_recall", "cp_precision", "mcp_recall", "mcp_precision")]
    good = (F.col("delta_purity") <= max_purity) & (F.col("delta_ploidy") <= max_ploidy)
    for s in shares:
        good = good & s
    return rows.withColumn("passed", F.coalesce(good, F.lit(False)))
