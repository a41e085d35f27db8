"""Writers: text at the edge, Parquet in between. Files of each contig have names; other text goes to folders of part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..plans.frames import frames
from ..plans.infer import Inference
from .published import publish


def tsv(rows: DataFrame, path: str, header: bool = True, null: str = "NA", mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    writer = rows.write.mode(mode).option("sep", "\t").option("header", header).option("nullValue", null).option("compression", "gzip")
    (writer.partitionBy(*by) if by else writer).csv(path)


def line(columns: list[Column], sep: str) -> Column:
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in columns])


def write_lines(parts: list[tuple[DataFrame, Column, list[Column]]], path: str, name: Column | None = None) -> None:
    """Text of parts (rows, line, order within the part), one part after the other; name: a file of the folder for each of its values.

    All lines of a file are one task: headers and a contig's or a genome's rows, not reads.
    """
    rows = None
    for i, (df, text, order) in enumerate(parts):
        keys = [(c.cast("double") if k < len(order) else F.lit(0.0)).alias(f"k{k}") for k, c in enumerate([*order, *[F.lit(0)] * (2 - len(order))])]
        one = df.select(*([] if name is None else [name.alias("file")]), F.lit(i).alias("part"), *keys, text.alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    order = ["part", "k0", "k1"]
    if name is not None:
        publish(rows, F.col("file"), F.encode(F.concat("value", F.lit("\n")), "UTF-8"), [F.col(c) for c in order], path)
    else:
        rows.coalesce(1).sortWithinPartitions(*order).select("value").write.mode("overwrite").option("compression", "none").text(path)


def write_ratio(ratio: DataFrame, path: str, debug: bool = False, stats: DataFrame | None = None, window: int = Params.window_size) -> None:
    """Ratio rows as chrN.ratio.wW.csv.gz for each contig; debug adds the raw coverages, stats the lines on each contig."""
    names = ["start", "coverage_ratio", *(["coverage_tumor"] if debug else []), "coverage_tumor_adj", *(["coverage_normal"] if debug else []), "coverage_normal_adj"]
    chr_id = (F.col("chr_idx") + 1).alias("chr")
    rows = ratio.select(chr_id, *names)
    contigs = (ratio.select("chr_idx").distinct() if stats is None else stats.drop("chr")).withColumn("chr", chr_id)
    parts = []
    if stats is not None:
        about = {
            "chr": F.concat(F.lit("chr"), F.col("chr").cast("string")), "chromosome_len": F.col("length"), "window_size": F.lit(window), "no_of_windows": F.col("n_windows"),
            "no_of_fragments_tumor": F.col("n_fragments_tumor"), "coverage_per_base_tumor": F.col("coverage_per_base_tumor"),
            "no_of_fragments_normal": F.col("n_fragments_normal"), "coverage_per_base_normal": F.col("coverage_per_base_normal"),
            "genome-wide-coverage-mean-tumor": F.col("mean_tumor"), "genome-wide-coverage-mean-normal": F.col("mean_normal"),
        }
        notes = F.posexplode(F.array(*[F.concat(F.lit(f"#{k}: "), v.cast("string")) for k, v in about.items()])).alias("place", "note")
        parts.append((contigs.select("chr", notes), F.col("note"), [F.col("place")]))
    parts.append((contigs.select("chr"), F.lit(",".join(names)), []))
    parts.append((rows, line([F.col(c) for c in names], ","), [F.col("start")]))
    write_lines(parts, path, F.concat(F.lit("chr"), F.col("chr").cast("string"), F.lit(f".ratio.w{window}.csv.gz")))


def write_het_snps(snps: DataFrame, path: str) -> None:
    tsv(snps.withColumn("chr", F.concat(F.lit("chr"), F.col("chr_idx") + 1)).select("chr", "pos", "tumor_depth", "tumor_ro", "tumor_ao", "normal_depth", "normal_ro", "normal_ao"), path)


def write_segments(segments: DataFrame, path: str, by_contig: bool = False) -> None:
    """Segments without a header; by_contig: a folder for each contig."""
    rows = segments.withColumn("chr", F.concat(F.lit("chr"), F.col("chr_idx") + 1)).select("chr", "start", "end", "ratio", "stddev", "n_windows")
    tsv(rows.withColumn("contig", F.col("chr")) if by_contig else rows, path, header=False, by=("contig",) if by_contig else ())


CALLS = ("chr", "start", "end", "cp", "major_allele_cp", "copy_no_float", "cumu_start", "cumu_end")
INTERVALS = ("chr", "start", "end", "cp", "copy_no_float", "cp_stddev", "interval_left", "interval_right", "stddev", "n_windows")


def write_calls(calls: DataFrame, path: str, totals: DataFrame | None = None) -> None:
    """Calls with integer copies of clonal rows; the majors of subclonal ones are NA. Totals follow as four lines."""
    cp = F.when(F.col("is_clonal"), F.col("cp").cast("bigint").cast("string")).otherwise(F.col("cp").cast("string"))
    rows = calls.withColumn("cp", cp).withColumn("chr", F.col("chr_idx") + 1)
    one = calls.sparkSession.range(1)
    parts = [(one, F.lit("\t".join(CALLS)), []), (rows, line([F.col(c) for c in CALLS], "\t"), [F.col("chr"), F.col("start")])]
    if totals is not None:
        names = ("genome_len_cnv_all", "genome_len_clonal", "ploidy_cnv_all", "ploidy_clonal")
        notes = F.posexplode(F.array(*[F.concat(F.lit(f"#{n}="), F.coalesce(F.col(n).cast("string"), F.lit("nan"))) for n in names])).alias("place", "note")
        parts.append((totals.select(notes), F.col("note"), [F.col("place")]))
    write_lines(parts, path)


def write_intervals(calls: DataFrame, path: str) -> None:
    """Calls outside of peaks with the interval of their copy number."""
    rows = calls.where(~F.col("in_peak")).withColumn("chr", F.col("chr_idx") + 1)
    write_lines([(calls.sparkSession.range(1), F.lit("\t".join(INTERVALS)), []), (rows, line([F.col(c) for c in INTERVALS], "\t"), [F.col("chr"), F.col("start")])], path)


def summary_text(got: Inference) -> str:
    """The run's result as three pairs of a header and a line of values."""
    b, p, t = got.best, got.params, got.totals.first()
    used = got.usable.agg(F.count("*").alias("n"), F.sum("snps.n").alias("sites")).first()
    five = lambda x: f"{x:.5g}" if isinstance(x, float) else str(x)
    pairs = [
        {"purity": b.purity, "ploidy": t["ploidy_cnv_all"], "ploidy_naive": b.ploidy, "rc_ratio_of_cp_2": b.center_two, "segment_stddev_divider": p.stddev_divider, "snp_maf_stddev_divider": p.snp_maf_stddev_divider,
         "snp_coverage_min": p.snp_coverage_min, "snp_coverage_var_vs_mean_ratio": p.snp_coverage_var_ratio, "period_discover_run_type": int(got.auto), "no_of_peaks_for_logL": p.peaks_for_logl},
        {"logL": b.logl, "period": b.period, "best_no_of_copy_nos_bf_1st_peak": b.copies_before, "first_peak_int": b.first},
        {"no_of_segments": got.n_segments, "no_of_segments_used": used["n"], "no_of_snps": got.n_sites, "no_of_snps_used": used["sites"] or 0},
    ]
    return "".join("\t".join(x) + "\n" + "\t".join(map(five, x.values())) + "\n" for x in pairs)


def write_inference(got: Inference, folder: str) -> None:
    """Every frame of an inference as Parquet, and as text the calls, their intervals and the summary."""
    for name, frame in frames(got).items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    if got.calls is not None:
        write_calls(got.calls, f"{folder}/cnv.output.tsv", got.totals)
        write_intervals(got.calls, f"{folder}/cnv.interval.tsv")
        spark = got.calls.sparkSession
        lines = list(enumerate(summary_text(got).splitlines()))
        write_lines([(spark.createDataFrame(lines, "i int, line string"), F.col("line"), [F.col("i")])], f"{folder}/infer.out.tsv")


def write_gc_index(blocks: DataFrame, folder: str) -> None:
    """A file NAME.gcSIZE.bi of raw bytes for each sequence and window size, from gc_blocks(); each is streamed by one task."""
    publish(blocks, F.concat("chr", F.lit(".gc"), F.col("window_size").cast("string"), F.lit(".bi")), F.col("counts"), [F.col("start")], folder)


RESULT = "commit_id sample_class true_purity true_ploidy est_purity est_ploidy delta_purity delta_ploidy cp_recall cp_precision mcp_recall mcp_precision period first_peak_int likelihood".split()


def append_results(results: DataFrame, path: str) -> None:
    """Appends results of runs to those at the path, with their deltas."""
    from ..operators.evaluate import with_deltas

    tsv(with_deltas(results).select(*RESULT), path, mode="append")


def write_ploidy(ploidy: DataFrame, path: str, haploid: int = 2_881_033_286) -> None:
    """The true ploidy of a simulated genome: altered bases, haploid length and ploidy."""
    tsv(ploidy.select(F.col("altered").alias("CNA_length"), F.lit(haploid).alias("haploid_length"), "ploidy"), path)
