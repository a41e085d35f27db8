"""The generic test tables seen as this domain's tables; columns by arithmetic only, so that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numeric import int_div
from .model import FIRST, PAIRED, PROPER
from .operators.intervals import with_offsets
from .params import Params

#: Windows and spans that suit the events table: 65 windows on each of four contigs.
READ_PARAMS = Params(window_size=40_000, max_fragment=40_000, min_mapq=30, max_coverage=100.0)
READ_CONTIGS = 4
READ_CONTIG_LENGTH = 2_600_000
SNP_CONTIGS = 22
#: Bins and dividers that suit the orders table, whose segments are 400 long.
SEGMENT_PARAMS = Params(bin_width=1000, stddev_divider=10.0)
SNP_PARAMS = Params(snp_min_depth=4, snp_max_depth=80, bin_width=1000)
#: Flags that reads take in turn: good pairs, reversed ones, unpaired ones, and each bit that rejects a pair.
FLAGS = (67, 83, 0, 16, 66 | 1 << 3 | 1, 3, 65, 67 | 0x100, 67 | 0x400, 67 | 0x800, 1024, 99)
#: Copies of the orders' genome, by customer.
PROFILE = (2, 2, 2, 3, 1, 2, 2, 4, 2, 2, 3)
PEAKS = [(i, 180 + 240 * i, 150 + 240 * i, 210 + 240 * i) for i in range(10)]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_contigs(spark: SparkSession) -> DataFrame:
    rows = [(f"chr{i + 1}", i, READ_CONTIG_LENGTH) for i in range(READ_CONTIGS)]
    return with_offsets(spark.createDataFrame(rows, "chr string, chr_idx int, length bigint"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fragments of two samples; other kinds of events are neither."""
    e = load(spark, sf_dir, "events")
    sample = F.when(F.col("event_type").isin("click", "purchase"), "tumor").when(F.col("event_type").isin("view", "signup"), "normal")
    pos = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("bigint")
    rows = e.select(
        sample.alias("sample"),
        (F.col("user_id") % READ_CONTIGS).cast("int").alias("chr_idx"),
        pos.alias("pos"),
        pos.alias("mate_pos"),
        (F.col("value") * 100).cast("bigint").alias("insert_size"),
        F.lit(100).alias("seq_len"),
        F.get_json_object("props", "$.k").cast("int").alias("mapq"),
        F.lit(PAIRED | PROPER | FIRST).alias("flags"),
    )
    return rows.where("sample is not null")


def flagged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with flags of every kind, unpaired and reversed reads among them, by event."""
    e = reads(spark, sf_dir).withColumn("kind", F.pmod(F.col("pos") + F.col("insert_size"), F.lit(len(FLAGS))).cast("int"))
    flags = F.get(F.array(*[F.lit(f) for f in FLAGS]), F.col("kind"))
    return e.withColumns({"flags": flags, "mate_pos": F.col("pos") + F.col("kind"), "seq_len": F.col("kind") * 1000 + 100}).drop("kind")


def snp_contigs(spark: SparkSession) -> DataFrame:
    rows = [(f"chr{i + 1}", i, 1_000_000) for i in range(SNP_CONTIGS)]
    return with_offsets(spark.createDataFrame(rows, "chr string, chr_idx int, length bigint"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as two-sample genotype calls."""
    x = load(spark, sf_dir, "lineitem")
    gt = F.when(F.col("l_returnflag") == "R", "0/1").when(F.col("l_returnflag") == "A", "0|1").otherwise("1/1")
    return x.select(
        (F.col("l_suppkey") % SNP_CONTIGS).cast("int").alias("chr_idx"),
        F.col("l_orderkey").alias("pos"),
        gt.alias("normal_gt"),
        F.col("l_quantity").cast("int").alias("normal_ro"),
        (F.col("l_linenumber") + (F.col("l_tax") * 100).cast("int")).alias("normal_ao"),
        (F.col("l_partkey") % 40).cast("int").alias("tumor_ro"),
        (int_div(F.col("l_partkey"), 40) % 40).cast("int").alias("tumor_ao"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments 400 long."""
    x = load(spark, sf_dir, "orders")
    return x.select(
        (F.col("o_custkey") % SNP_CONTIGS).cast("int").alias("chr_idx"),
        F.col("o_orderkey").alias("start"),
        (F.col("o_orderkey") + 400).alias("end"),
        (F.col("o_totalprice") / 200000).alias("ratio"),
        (F.lit(0.02) + (F.col("o_orderkey") % 7) * 0.01).alias("stddev"),
        (F.col("o_orderkey") % 50 + 1).alias("n_windows"),
    )


#: Order keys of a subject.
SUBJECT_KEYS = 2_000


def profile_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments of a genome of purity 0.7 whose copies go by customer, with little noise; a subject for each
    SUBJECT_KEYS order keys, so that subjects grow with the table."""
    x = load(spark, sf_dir, "orders")
    copies = F.get(F.array(*[F.lit(c) for c in PROFILE]), (F.col("o_custkey") % len(PROFILE)).cast("int"))
    mean = 0.7 * sum(PROFILE) / len(PROFILE) + 0.6
    return x.select(
        F.floor(F.col("o_orderkey") / SUBJECT_KEYS).alias("subject"),
        (F.col("o_custkey") % SNP_CONTIGS).cast("int").alias("chr_idx"),
        F.col("o_orderkey").alias("start"),
        (F.col("o_orderkey") + 400).alias("end"),
        ((0.7 * copies + 0.6) / mean + (F.col("o_orderkey") % 9 - 4) * 0.001).alias("ratio"),
        F.lit(0.12).alias("stddev"),
        (F.col("o_orderkey") % 50 + 400).alias("n_windows"),
    )


def copy_numbers(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Orders with even keys as the truth (side 0), those with odd keys as predictions (side 1)."""
    x = load(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == side)
    cp = (F.col("o_totalprice") / 50000).cast("int").cast("double")
    return x.select(
        (F.col("o_custkey") % 22 + 1).cast("int").alias("chr_id"),
        F.col("o_orderkey").alias("start"),
        (F.col("o_orderkey") + 20 + F.col("o_custkey") % 30).alias("end"),
        cp.alias("cp"),
        (cp - (F.col("o_totalprice") / 100000).cast("int")).alias("major"),
        (F.col("o_orderstatus") != "P").alias("is_clonal"),
    )


def peaks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PEAKS, "peak_index int, center int, lo int, hi int")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' texts as sequences."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chr"), F.coalesce("text", F.lit("")).alias("seq"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of past runs."""
    x = load(spark, sf_dir, "orders")
    purity = (F.col("o_custkey") % 9 + 1) / 10
    return x.select(
        F.col("o_orderpriority").alias("commit_id"),
        F.col("o_orderstatus").alias("sample_class"),
        purity.alias("true_purity"),
        F.lit(2.0).alias("true_ploidy"),
        (purity + (F.col("o_orderkey") % 17 - 8) / 64).alias("est_purity"),
        (2.0 + (F.col("o_orderkey") % 13 - 6) / 16).alias("est_ploidy"),
        ((F.col("o_orderkey") % 8 + 4) / 16).alias("cp_recall"),
        F.lit(0.75).alias("cp_precision"),
        F.lit(0.9).alias("mcp_recall"),
        ((F.col("o_custkey") % 4 + 12) / 16).alias("mcp_precision"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as altered alleles of a simulated genome."""
    x = load(spark, sf_dir, "orders")
    return x.select(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1000 + F.col("o_custkey")).alias("end"), (F.col("o_custkey") % 5).cast("int").alias("copy_number"), (F.lit(0.25) * (F.col("o_orderkey") % 5)).alias("proportion"))
