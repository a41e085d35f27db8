"""Coverage: fragments to windows, running medians, and the tumor-to-normal ratio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import has, int_div, sorted_median
from ..model import DUPLICATE, FIRST, MATE_UNMAPPED, PAIRED, PROPER, REVERSE, SECONDARY, SUPPLEMENTARY
from ..params import Params
from ..session import checkpoint


def with_windows(contigs: DataFrame, window: int) -> DataFrame:
    """Contigs with n_windows, the last one maybe shorter; contigs are a fixed handful."""
    return contigs.withColumn("n_windows", int_div(F.col("length") + (window - 1), window))


def valid_fragments(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """Reads that count: good mapping quality and, of pairs, one proper primary first mate of bounded span.

    Reads that aren't paired need the mapping quality only.
    """
    f = F.col("flags")
    bad_pair = (F.col("insert_size") < 0) | (F.col("insert_size") > p.max_fragment) | ~has(f, PROPER) | has(f, MATE_UNMAPPED) | ~has(f, FIRST)
    bad_pair = bad_pair | has(f, SECONDARY) | has(f, DUPLICATE) | has(f, SUPPLEMENTARY)
    return reads.where((F.col("mapq") >= p.min_mapq) & ~(has(f, PAIRED) & bad_pair))


def spans(fragments: DataFrame, contigs: DataFrame, p: Params = Params()) -> DataFrame:
    """Fragments with the windows [ws, we) they count in and their length.

    A fragment of a pair counts in windows that it covers by half; a single read counts in the window
    nearest to its start, or to its end if reversed. Fragments on other contigs are left out.
    """
    w = p.window_size
    half = w // 2
    known = F.broadcast(with_windows(contigs, w).select("chr_idx", "n_windows", F.col("length").alias("chr_length")))
    rows = fragments.join(known, "chr_idx")
    f, last = F.col("flags"), F.col("n_windows") - 1
    begin = F.when(has(f, REVERSE), F.col("mate_pos")).otherwise(F.col("pos"))
    stop = begin + F.col("insert_size")
    ws, we = int_div(begin, w), int_div(stop, w)
    ws = ws + F.when(((ws + 1) * w - begin < half) & (ws < last), 1).otherwise(0)
    we = we + F.when((stop - we * w > half) & (we < last), 1).otherwise(0)
    single = F.least(F.when(has(f, REVERSE), int_div(F.col("pos") + F.col("seq_len") - half, w)).otherwise(int_div(F.col("pos") + half, w)), last)
    paired = has(f, PAIRED)
    return rows.select(
        "sample",
        "chr_idx",
        "chr_length",
        F.when(paired, F.least(ws, last)).otherwise(single).alias("ws"),
        F.when(paired, F.least(we, last)).otherwise(single + 1).alias("we"),
        F.when(paired, F.col("insert_size")).otherwise(F.col("seq_len").cast("bigint")).alias("fragment_length"),
    )


def window_counts(spanned: DataFrame) -> DataFrame:
    """(sample, chr_idx, win, n) of windows with a fragment; counted before anything is shuffled."""
    each = spanned.where("ws < we").select("sample", "chr_idx", F.explode(F.sequence("ws", F.col("we") - 1)).alias("win"))
    return each.groupBy("sample", "chr_idx", "win").agg(F.count("*").alias("n"))


def contig_stats(spanned: DataFrame) -> DataFrame:
    """Fragments, total length and coverage per base of each sample and contig."""
    return spanned.groupBy("sample", "chr_idx", "chr_length").agg(F.count("*").alias("n_fragments"), F.sum("fragment_length").alias("total_length")).withColumn("coverage_per_base", F.col("total_length") / F.col("chr_length"))


def genome_mean(stats: DataFrame) -> DataFrame:
    """Mean coverage per sample over the contigs that it has fragments on."""
    return stats.groupBy("sample").agg((F.sum("total_length") / F.sum("chr_length")).alias("mean_coverage"))


def dense(counts: DataFrame, contigs: DataFrame, p: Params = Params()) -> DataFrame:
    """(chr_idx, win, tumor, normal) of every window of every contig, 0 where nothing was counted.

    Both samples come out of one aggregation, not of a join.
    """
    grid = with_windows(contigs, p.window_size).select("chr_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_windows") - 1)).alias("win"))
    zero = F.lit(0).cast("bigint")
    rows = counts.unionByName(grid.select(F.lit(None).cast("string").alias("sample"), "chr_idx", "win", zero.alias("n")))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("n"))), zero).alias(s)
    return rows.groupBy("chr_idx", "win").agg(total("tumor"), total("normal"))


def running_median(rows: DataFrame, columns: list[str], half: int = 2, block: int = 1 << 16, keys: tuple[str, ...] = ("chr_idx",)) -> DataFrame:
    """The columns as integer medians of the rows around them, fewer at a contig's ends; rows are dense in win.

    Contigs are cut into blocks of windows, so that a long one is no single task; rows near a block's edge
    also go to the next block, where they only serve their neighbours.
    """
    at = lambda shift: int_div(F.greatest(F.col("win") + shift, F.lit(0)), block)
    copies = rows.withColumn("_block", F.explode(F.sequence(at(-half), at(half))))
    near = Window.partitionBy(*keys, "_block").orderBy("win").rowsBetween(-half, half)
    out = copies.withColumns({c: sorted_median(F.collect_list(c).over(near)) for c in columns})
    return out.where(F.col("_block") == at(0)).drop("_block")


def coverage_ratio(grid: DataFrame, mean_tumor, mean_normal, p: Params = Params()) -> DataFrame:
    """Ratio rows from smoothed window counts and the samples' mean coverages (numbers or columns).

    Windows that are empty or too deep in either sample have an unknown ratio of -1, which takes part in
    the second running median; rows come out where that median is above 0.
    """
    t, n = F.col("tumor").cast("double"), F.col("normal").cast("double")
    known = (t > 0) & (t < p.max_coverage) & (n > 0) & (n < p.max_coverage)
    t_adj, n_adj = t / F.lit(mean_tumor), n / F.lit(mean_normal)
    raw = F.when(known, (t_adj / n_adj * p.ratio_scale).cast("bigint")).otherwise(F.lit(-p.ratio_scale).cast("bigint"))
    rows = running_median(grid.withColumn("ratio_raw", raw).withColumn("ratio", raw), ["ratio"], p.smooth_half)
    rows = rows.where("ratio > 0")
    return rows.select(
        "chr_idx",
        "win",
        (F.col("win") * p.window_size + 1).alias("start"),
        (F.col("ratio") / p.ratio_scale).alias("coverage_ratio"),
        t.alias("coverage_tumor"),
        t_adj.alias("coverage_tumor_adj"),
        n.alias("coverage_normal"),
        n_adj.alias("coverage_normal_adj"),
    )


def tallied(spanned: DataFrame) -> DataFrame:
    """(sample, chr_idx, chr_length, win, n, total_length): window counts, and under window -1 each contig's fragments and
    their total length, all from one pass over the fragments.
    """
    windows = F.when(F.col("ws") < F.col("we"), F.sequence("ws", F.col("we") - 1)).otherwise(F.array().cast("array<bigint>"))
    each = spanned.select("sample", "chr_idx", "chr_length", "fragment_length", F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), windows)).alias("win"))
    return each.groupBy("sample", "chr_idx", "chr_length", "win").agg(F.count("*").alias("n"), F.sum(F.when(F.col("win") < 0, F.col("fragment_length"))).alias("total_length"))


def normalized(reads: DataFrame, contigs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Coverage-ratio rows of a tumor and a normal sample's reads, which are read once, and a row on each contig: its
    length, windows, fragments and coverage in both samples, and both genome-wide means.
    """
    tally = checkpoint(tallied(spans(valid_fragments(reads, p), contigs, p)))  # as many rows as windows
    whole = tally.where("win < 0").withColumn("coverage_per_base", F.col("total_length") / F.col("chr_length"))
    means = {r["sample"]: r["mean_coverage"] for r in genome_mean(whole).collect()}  # two rows
    if "tumor" not in means or "normal" not in means:
        raise ValueError("both a tumor and a normal sample are needed")
    counts = tally.where("win >= 0").select("sample", "chr_idx", "win", "n")
    grid = running_median(dense(counts, contigs, p), ["tumor", "normal"], p.smooth_half)
    of = lambda s, c: F.coalesce(F.max(F.when(F.col("sample") == s, F.col(c))), F.lit(0))
    sides = whole.groupBy("chr_idx").agg(*[of(s, c).alias(f"{name}_{s}") for s in means for name, c in (("n_fragments", "n"), ("coverage_per_base", "coverage_per_base"))])
    stats = with_windows(contigs, p.window_size).select("chr_idx", "chr", "length", "n_windows").join(sides, "chr_idx", "left").na.fill(0)
    return coverage_ratio(grid, means["tumor"], means["normal"], p), stats.withColumns({f"mean_{s}": F.lit(m) for s, m in means.items()})


def normalize(reads: DataFrame, contigs: DataFrame, p: Params = Params()) -> DataFrame:
    """The coverage-ratio rows of normalized()."""
    return normalized(reads, contigs, p)[0]
