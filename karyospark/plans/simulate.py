"""A small synthetic genome of known purity and copy numbers, in place of read simulators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import with_offsets
from ..params import Params
from .infer import Inference, infer

WINDOW = 500
#: Length of a contig and of its segments, in windows; copies and major copies, in turn.
CONTIG_WINDOWS = 40_000
SEGMENT_WINDOWS = 4_000
PROFILE = ((2, 1), (2, 1), (3, 2), (2, 1), (1, 1), (2, 1), (4, 2), (2, 1), (2, 1), (3, 2), (2, 1), (1, 1))


def genome(spark: SparkSession, purity: float, n_contigs: int = 8, depth: int = 60, snps_per_segment: int = 60, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Contigs, segments, sites and truth of a genome, drawn from the model with a fixed seed."""
    draw = np.random.default_rng(seed)
    per = CONTIG_WINDOWS // SEGMENT_WINDOWS
    states = [PROFILE[(c * 5 + i) % len(PROFILE)] for c in range(n_contigs) for i in range(per)]
    ploidy = sum(s[0] for s in states) / len(states)
    mean = purity * ploidy + 2 * (1 - purity)
    segs, snps, truth = [], [], []
    for k, (cp, major) in enumerate(states):
        c, i = divmod(k, per)
        start, end = i * SEGMENT_WINDOWS * WINDOW + 1, (i + 1) * SEGMENT_WINDOWS * WINDOW
        level = (purity * cp + 2 * (1 - purity)) / mean
        segs.append((c, start, end, float(level + draw.normal(0, 0.002)), 0.12, SEGMENT_WINDOWS))
        truth.append((c + 1, start, end, float(cp), float(major), True))
        for pos in sorted(draw.choice(np.arange(start, end), snps_per_segment, replace=False).tolist()):
            a, b = (major, cp - major) if draw.random() < 0.5 else (cp - major, major)
            share = (purity * a + 1 - purity) / (purity * cp + 2 * (1 - purity))
            d = int(draw.poisson(depth * level)) + 2
            alt = min(d - 1, max(1, int(draw.binomial(d, share))))
            nd = int(draw.poisson(depth)) + 2
            nalt = min(nd - 1, max(1, int(draw.binomial(nd, 0.5))))
            snps.append((c, int(pos), float(np.log((alt / nalt) / ((d - alt) / (nd - nalt)))), d))
    contigs = with_offsets(spark.createDataFrame([(f"chr{c + 1}", c, CONTIG_WINDOWS * WINDOW) for c in range(n_contigs)], "chr string, chr_idx int, length bigint"))
    return (
        contigs,
        spark.createDataFrame(segs, "chr_idx int, start bigint, end bigint, ratio double, stddev double, n_windows bigint"),
        spark.createDataFrame(snps, "chr_idx int, pos bigint, log_or double, coverage int"),
        spark.createDataFrame(truth, "chr_id int, start bigint, end bigint, cp double, major double, is_clonal boolean"),
    )


def demo(spark: SparkSession, purity: float = 0.7, **more) -> tuple[Inference, DataFrame]:
    contigs, segs, snps, truth = genome(spark, purity, **more)
    return infer(segs, snps, contigs, Params(stddev_divider=10.0, bin_width=1_000_000)), truth


def predicted(calls: DataFrame) -> DataFrame:
    """Calls as the evaluator takes them."""
    return calls.select((F.col("chr_idx") + 1).alias("chr_id"), "start", "end", "cp", F.col("major_allele_cp").cast("double").alias("major"), "is_clonal")


def simulated_ploidy(regions: DataFrame, haploid: float = 2_881_033_286.0) -> DataFrame:
    """One row: altered bases (copies beyond one of each allele, by proportion) and the ploidy that follows.

    regions: (start, end, copy_number, proportion), one row per altered allele.
    """
    altered = F.sum((F.col("copy_number") - 1) * (F.col("end") - F.col("start")) * F.col("proportion"))
    return regions.agg(altered.alias("altered")).select("altered", (F.col("altered") / haploid + 2).alias("ploidy"))


def prefixed(reads: DataFrame, prefix: str) -> DataFrame:
    """Sequencing reads (name, seq, qual) with the prefix before each name, so that those of several genomes stay apart."""
    return reads.withColumn("name", F.concat(F.lit(prefix), F.col("name")))


def mixed(tumor: DataFrame, normal: DataFrame) -> DataFrame:
    """Reads of a tumor and a normal genome as one sample, names told apart."""
    return prefixed(tumor, "tumor_").unionByName(prefixed(normal, "normal_"))
