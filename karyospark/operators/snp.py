"""Heterozygous sites: selection, log odds, and what each segment holds of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log_odds, sorted_midpoint
from ..params import Params
from .intervals import homed_join

# Genotypes that count as heterozygous.
HET_GENOTYPES = ("0/1", "0|1", "1|0")


def sites(calls: DataFrame) -> DataFrame:
    """Calls with the depth of each sample, the sum of its two allele counts."""
    return calls.withColumn("normal_depth", F.col("normal_ro") + F.col("normal_ao")).withColumn("tumor_depth", F.col("tumor_ro") + F.col("tumor_ao"))


def het_test(p: Params = Params()) -> tuple[Column, Column]:
    """Whether a site is good in the normal sample, and whether it is kept: depths lie strictly within bounds."""
    within = lambda c: (F.col(c) > p.snp_min_depth) & (F.col(c) < p.snp_max_depth)
    normal = F.col("normal_gt").isin(*HET_GENOTYPES) & within("normal_depth")
    return normal, normal & within("tumor_depth")


def het_snps(calls: DataFrame, p: Params = Params()) -> DataFrame:
    """Heterozygous sites of calls (chr_idx, pos, normal_gt, normal_ro, normal_ao, tumor_ro, tumor_ao)."""
    rows = sites(calls).where(het_test(p)[1])
    return rows.select("chr_idx", "pos", "tumor_depth", "tumor_ro", "tumor_ao", "normal_depth", "normal_ro", "normal_ao")


def het_counts(calls: DataFrame, p: Params = Params()) -> DataFrame:
    """One row: all sites, those good in the normal sample, and those kept."""
    normal, kept = het_test(p)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))
    return sites(calls).agg(F.count("*").alias("n_sites"), count(normal).alias("n_good_normal"), count(kept).alias("n_kept"))


def with_log_odds(snps: DataFrame) -> DataFrame:
    """(chr_idx, pos, log_or, coverage) of sites whose four allele counts aren't zero; coverage is the tumor's depth."""
    rows = snps.where("tumor_ro > 0 and tumor_ao > 0 and normal_ro > 0 and normal_ao > 0")
    odds = log_odds(*[F.col(c) for c in ("tumor_ro", "tumor_ao", "normal_ro", "normal_ao")])
    return rows.select("chr_idx", "pos", odds.alias("log_or"), F.col("tumor_depth").alias("coverage"))


def segment_snps(snps: DataFrame, segments: DataFrame, p: Params = Params(), keys: tuple[str, ...] = ("chr_idx",)) -> DataFrame:
    """Per segment with more than min_segment_snps sites: their number, median coverage, mean and variance of log odds.

    A segment is its keys (the contig, and the sample where they name one), start and end. The log odds themselves are gathered by segment_bags().
    """
    joined = homed_join(snps.select(*keys, "pos", "coverage", "log_or"), segments.select(*keys, "start", "end"), list(keys), width=p.bin_width)
    # a list of one segment's coverages is bounded, and quicker sorted than counted by value
    rows = joined.groupBy(*keys, "_level", "_home", "start", "end").agg(
        F.count("pos").alias("n_snps"), F.collect_list("coverage").alias("coverages"), F.avg("log_or").alias("mean_log_or"), F.var_pop("log_or").alias("var_log_or")
    )
    rows = rows.where(F.col("n_snps") > p.min_segment_snps)
    return rows.select(*keys, "start", "end", "n_snps", sorted_midpoint(F.col("coverages")).alias("median_coverage"), "mean_log_or", "var_log_or")


def segment_bags(snps: DataFrame, segments: DataFrame, p: Params = Params(), keys: tuple[str, ...] = ("chr_idx",)) -> DataFrame:
    """Segments with snps, a struct (n, coverage, log_or array), null where they hold too few sites.

    A bag holds one segment's sites, a bounded stretch of a genome.
    """
    more = [c for c in segments.columns if c not in (*keys, "start", "end")]
    joined = homed_join(snps.select(*keys, "pos", "coverage", "log_or"), segments, list(keys), width=p.bin_width)
    bags = joined.groupBy(*keys, "_level", "_home", "start", "end").agg(
        F.first("_same").alias("_same"), F.count("pos").alias("n"), F.collect_list("coverage").alias("coverages"), F.collect_list("log_or").alias("odds")
    )
    held = F.when(F.col("n") > p.min_segment_snps, F.named_struct(F.lit("n"), "n", F.lit("coverage"), sorted_midpoint(F.col("coverages")), F.lit("log_or"), F.sort_array("odds")))
    rows = bags.select(*keys, "start", "end", held.alias("snps"), F.explode("_same").alias("_row"))
    return rows.select(*[F.col(f"_row.{c}").alias(c) if c in more else F.col(c) for c in segments.columns], "snps")
