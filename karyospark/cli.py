"""Command line: python -m karyospark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import shutil

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import coverage, evaluate, gc, snp
from .operators.segmentation import segment
from .params import Config, Params
from .plans.infer import infer
from .plans.pipeline import STEPS, Workflow
from .sources import bam, bam_sorted, bcf, sinks, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="karyospark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, help: str):
        c = sub.add_parser(name, help=help)
        for a in arguments:
            c.add_argument(a)
        return c

    command("gc-index", "fasta", "output", help="GC counts of forward windows")
    c = command("sort-reads", "reads", "output", help="reads in order of their places as a folder of BAM files with indexes")
    c.add_argument("--files", type=int, default=None)
    c = command("normalize", "tumor", "normal", "dictionary", "output", help="coverage ratio of two BAM files")
    c.add_argument("--window-size", type=int, default=500)
    c.add_argument("--debug", action="store_true")
    c = command("select-het-snp", "vcf", "output", help="heterozygous sites of a two-sample VCF")
    c.add_argument("--min-depth", type=int, default=Params.snp_min_depth)
    c.add_argument("--max-depth", type=int, default=Params.snp_max_depth)
    c = command("segment", "ratio", "output", help="change points of ratio files")
    c.add_argument("--threshold", type=float, default=Params.segment_threshold)
    c.add_argument("--prior", type=float, default=Params.segment_a)
    c.add_argument("--tolerance", type=float, default=Params.segment_tolerance)
    c.add_argument("--rounds", type=int, default=Params.segment_rounds)
    c.add_argument("--min-length", type=int, default=Params.segment_min_length)
    c.add_argument("--window-size", type=int, default=500)
    c = command("infer", "segments", "snps", "dictionary", "output", help="purity, ploidy and copy numbers")
    c.add_argument("--divider", type=float, default=Params.stddev_divider)
    c.add_argument("--auto", type=int, default=1)
    c.add_argument("--force-period", type=int, default=0)
    c.add_argument("--strict", action="store_true")
    c.add_argument("--peaks", type=int, default=Params.peaks_for_logl)
    c = command("run", "config", "tumor", "normal", "vcf", "dictionary", "output", help="the whole workflow, from any step on")
    c.add_argument("-s", "--step", type=int, default=0, help="0 prepare, 1 sites, 2 normalize, 3 segment, 4 infer")
    c.add_argument("--clean", action="store_true", help="removes what an earlier run left")
    c.add_argument("--segment_stddev_divider", type=float, default=Params.stddev_divider)
    c.add_argument("--no_of_autosomes", type=int, default=22)
    c.add_argument("--snp_coverage_min", type=int, default=Params.snp_coverage_min)
    c.add_argument("--snp_coverage_var_vs_mean_ratio", type=float, default=Params.snp_coverage_var_ratio)
    c.add_argument("--max_no_of_peaks_for_logL", type=int, default=Params.peaks_for_logl)
    c.add_argument("--nCores", type=int, default=8, help="shuffle partitions")
    c.add_argument("--auto", type=int, default=1)
    c.add_argument("--force_period_id", type=int, default=0)
    c.add_argument("-d", "--debug", type=int, default=0)
    command("recall-precision", "truth", "predicted", "output", help="recall and precision of calls")
    return top


def read_sites(spark: SparkSession, path: str):
    """Genotype calls of a text or binary file."""
    return bcf.read_bcf(spark, path) if path.endswith(".bcf") else text.read_calls(spark, path)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("karyospark").getOrCreate()
    if a.command == "gc-index":
        sinks.write_gc_index(gc.gc_blocks(text.read_fasta(spark, a.fasta)), a.output)
    elif a.command == "sort-reads":
        bam_sorted.sort_bam(spark, a.reads, a.output, a.files)
    elif a.command == "normalize":
        contigs = text.read_contigs(spark, a.dictionary)
        reads = bam.read_bam(spark, a.tumor, "tumor", contigs).unionByName(bam.read_bam(spark, a.normal, "normal", contigs))
        ratio, stats = coverage.normalized(reads, contigs, Params(window_size=a.window_size))
        sinks.write_ratio(ratio, a.output, a.debug, stats, a.window_size)
    elif a.command == "select-het-snp":
        p = Params(snp_min_depth=a.min_depth, snp_max_depth=a.max_depth)
        calls = read_sites(spark, a.vcf)
        sinks.write_het_snps(snp.het_snps(calls, p), a.output)
        print(json.dumps(snp.het_counts(calls, p).first().asDict()))
    elif a.command == "segment":
        p = Params(window_size=a.window_size, segment_threshold=a.threshold, segment_min_length=a.min_length, segment_a=a.prior, segment_tolerance=a.tolerance, segment_rounds=a.rounds)
        sinks.write_segments(segment(text.read_ratio(spark, a.ratio), p), a.output)
    elif a.command == "infer":
        p = Params(stddev_divider=a.divider, force_period=a.force_period, peaks_for_logl=a.peaks)
        snps = snp.with_log_odds(text.read_het_snps(spark, a.snps))
        got = infer(text.read_segments(spark, a.segments), snps, text.read_contigs(spark, a.dictionary), p, a.strict, bool(a.auto))
        sinks.write_inference(got, a.output)
        print(json.dumps(got.summary(), default=float))
    elif a.command == "run":
        own = Config.read(a.config)
        p = Params(
            window_size=own.window_size, stddev_divider=a.segment_stddev_divider, force_period=max(0, a.force_period_id), peaks_for_logl=a.max_no_of_peaks_for_logL,
            snp_coverage_min=a.snp_coverage_min, snp_coverage_var_ratio=a.snp_coverage_var_vs_mean_ratio,
        )
        spark.conf.set("spark.sql.shuffle.partitions", a.nCores)
        if a.clean:
            shutil.rmtree(a.output, ignore_errors=True)
        contigs = text.read_contigs(spark, a.dictionary).where(F.col("chr_idx") < a.no_of_autosomes)
        reads = bam.read_bam(spark, a.tumor, "tumor", contigs).unionByName(bam.read_bam(spark, a.normal, "normal", contigs))
        sources = {"het_snps": [a.vcf], "normalize": [a.tumor, a.normal, a.dictionary]}
        got = Workflow(spark, a.output, p, sources).run(reads, read_sites(spark, a.vcf), contigs, STEPS[a.step], auto=bool(a.auto), debug=a.debug > 0, report=True)
        print(json.dumps(got.summary(), default=float))
    elif a.command == "recall-precision":
        rows = evaluate.recall_precision(text.read_truth(spark, a.truth), text.read_predicted(spark, a.predicted))
        sinks.tsv(rows, a.output)
        print(json.dumps(rows.first().asDict()))


if __name__ == "__main__":
    main()
