"""Readers of the text formats; gz is read as it is, block-compressed tables in splits. Schemas are fixed, columns go by position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evaluate import AUTOSOMES, drop_neutral
from ..operators.intervals import with_offsets
from ..session import checkpoint, ship
from .blocked import read_lines

# Names of autosomes in sequence dictionaries, and where contig numbers stand in names.
AUTOSOME_NAME = r"^chr\d+$"
NUMBER = r"^(?:chr)?(\d+)$"


def fields(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """The first fields of each line that is neither empty nor a comment, as strings; missing ones are null."""
    lines = read_lines(spark, path).where("trim(value) <> '' and not startswith(value, '#')")
    parts = F.split("value", sep)
    return lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def contig_number(name) -> F.Column:
    """The contig's index from a name like chr7 or 7, null for others."""
    return F.regexp_extract(name, NUMBER, 1).try_cast("int") - 1


def number(name: str, kind: str) -> F.Column:
    return F.col(name).try_cast(kind)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of a sequence dictionary: autosomes in the order of the file, which is a header of a few lines."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    sq = text.where("startswith(value, '@SQ')").select("line", F.regexp_extract("value", r"\tSN:([^\t\r]+)", 1).alias("chr"), F.regexp_extract("value", r"\tLN:(\d+)", 1).try_cast("bigint").alias("length"))
    rows = sq.where(F.col("chr").rlike(AUTOSOME_NAME)).orderBy("line").collect()
    return with_offsets(spark.createDataFrame([(r["chr"], i, r["length"]) for i, r in enumerate(rows)], "chr string, chr_idx int, length bigint"))


def read_ratio(spark: SparkSession, path: str) -> DataFrame:
    """(chr_idx, start, coverage_ratio) of ratio files named by their contig; header lines are no numbers and go."""
    rows = spark.read.text(path).withColumn("chr", F.regexp_extract(F.input_file_name(), r"chr=?(\d+)[./]", 1))
    parts = F.split("value", ",")
    rows = rows.select((F.col("chr").try_cast("int") - 1).alias("chr_idx"), F.get(parts, F.lit(0)).try_cast("bigint").alias("start"), F.get(parts, F.lit(1)).try_cast("double").alias("coverage_ratio"))
    return rows.where("start is not null and coverage_ratio is not null")


SNP_NAMES = ["chr", "pos", "tumor_depth", "tumor_ro", "tumor_ao", "normal_depth", "normal_ro", "normal_ao"]


def read_het_snps(spark: SparkSession, path: str) -> DataFrame:
    """Heterozygous sites of numbered contigs."""
    rows = fields(spark, path, SNP_NAMES).select(contig_number(F.col("chr")).alias("chr_idx"), number("pos", "bigint").alias("pos"), *[number(c, "int").alias(c) for c in SNP_NAMES[2:]])
    return rows.where("chr_idx is not null and pos is not null")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments; the files have no header."""
    rows = fields(spark, path, ["chr", "start", "end", "ratio", "stddev", "n_windows"])
    rows = rows.select(contig_number(F.col("chr")).alias("chr_idx"), number("start", "bigint").alias("start"), number("end", "bigint").alias("end"), number("ratio", "double").alias("ratio"), number("stddev", "double").alias("stddev"), number("n_windows", "bigint").alias("n_windows"))
    return rows.where("chr_idx is not null and start is not null")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """True copy numbers on autosomes. Rows without a readable copy number go; without a readable major they are subclonal."""
    rows = fields(spark, path, ["chr", "start", "end", "cp", "major"]).where(F.col("chr").isin(*AUTOSOMES))
    rows = rows.select((contig_number(F.col("chr")) + 1).alias("chr_id"), number("start", "bigint").alias("start"), number("end", "bigint").alias("end"), number("cp", "double").alias("cp"), number("major", "double").alias("major"))
    return rows.where("cp is not null and start is not null").withColumn("is_clonal", F.col("major").isNotNull())


def read_predicted(spark: SparkSession, path: str) -> DataFrame:
    """Predicted copy numbers without neutral ones; a major of NA marks subclonal rows."""
    rows = fields(spark, path, ["chr", "start", "end", "cp", "major"])
    rows = rows.select((contig_number(F.col("chr")) + 1).alias("chr_id"), number("start", "bigint").alias("start"), number("end", "bigint").alias("end"), number("cp", "double").alias("cp"), number("major", "double").alias("major"))
    return drop_neutral(rows.where("chr_id is not null and cp is not null").withColumn("is_clonal", F.col("major").isNotNull()))


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Genotype calls of a VCF whose first sample is the normal and whose second is the tumor; positions from 1.

    Sites without two allele depths in both samples have null counts.
    """
    rows = fields(spark, path, ["chr", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "normal", "tumor"])
    keys = F.split("format", ":")
    at = lambda s, k: F.get(F.split(s, ":"), F.array_position(keys, k).cast("int") - 1)
    depth = lambda s, i: F.get(F.split(at(s, "AD"), ","), F.lit(i)).try_cast("int")
    return rows.select(
        contig_number(F.col("chr")).alias("chr_idx"),
        number("pos", "bigint").alias("pos"),
        at("normal", "GT").alias("normal_gt"),
        depth("normal", 0).alias("normal_ro"),
        depth("normal", 1).alias("normal_ao"),
        depth("tumor", 0).alias("tumor_ro"),
        depth("tumor", 1).alias("tumor_ao"),
    ).where("chr_idx is not null and pos is not null")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq) of a FASTA file of short records, one row per record; read_fasta() reads contigs of any length."""
    rows = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    return rows.select(name.alias("chr"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


#: Letters of a piece of a sequence.
PIECE = 1 << 20


def read_fasta(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """(chr, start, bases): pieces of the records of FASTA files, whose splits are read apart.

    Each split numbers its records and letters from its own begin; how long the record at its begin already is follows
    from the lengths of the splits before it, one row for each split and record.
    """
    ship(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "split", "record", "name", "at", "bases"]
        now, record, name, at, held, size = None, 0, None, 0, [], 0

        def flush() -> pa.RecordBatch:
            row = [*now, record, name, at, "".join(held)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for b in batches:
            for file, split, value in zip(*(c.to_pylist() for c in b.columns)):
                fresh = (file, split) != now
                if fresh or value.startswith(">"):
                    if now is not None:
                        yield flush()
                    held, size, at = [], 0, 0
                    record, name = (0, None) if fresh else (record, name)
                    now = (file, split)
                    if value.startswith(">"):
                        record, name = record + 1, (value[1:].split() or [""])[0]
                        continue
                held.append("".join(value.split()))
                size += len(held[-1])
                if size >= piece:
                    yield flush()
                    held, size, at = [], 0, at + size
        if now is not None:
            yield flush()

    rows = checkpoint(lines.mapInArrow(cut, "file string, split bigint, record bigint, name string, at bigint, bases string"))
    line = Window.partitionBy("file").orderBy("split", "record")
    sizes = rows.groupBy("file", "split", "record").agg(F.max("name").alias("name"), F.sum(F.length("bases")).alias("n"))
    sizes = sizes.withColumn("chr", F.last("name", ignorenulls=True).over(line)).withColumn("contig", F.count("name").over(line))
    before = Window.partitionBy("file", "contig").orderBy("split", "record").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "split", "record", "chr", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.where("bases <> ''").join(base, ["file", "split", "record"]).where("chr is not null").select("chr", (F.col("base") + F.col("at")).alias("start"), "bases")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, copy_number) of a simulated genome's altered alleles."""
    rows = fields(spark, path, ["chr", "start", "end", "copy_number"])
    rows = rows.select("chr", number("start", "bigint").alias("start"), number("end", "bigint").alias("end"), number("copy_number", "int").alias("copy_number"))
    return rows.where("start is not null and copy_number is not null")


def read_slopes(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(shift, diff, sign) of a slopes file, and its last comment line, which holds the exclusion zone."""
    rows = fields(spark, path, ["shift", "diff", "sign"]).select(number("shift", "int").alias("shift"), number("diff", "double").alias("diff"), number("sign", "int").alias("sign")).where("shift is not null")
    notes = spark.read.text(path).where("startswith(value, '#')").select(F.monotonically_increasing_id().alias("i"), "value").orderBy(F.desc("i")).limit(1).collect()
    return rows, notes[0]["value"] if notes else None


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of past runs."""
    names = "commit_id sample_class true_purity true_ploidy est_purity est_ploidy delta_purity delta_ploidy cp_recall cp_precision mcp_recall mcp_precision period first_peak_int likelihood".split()
    rows = fields(spark, path, names).where(F.col("commit_id") != "commit_id")
    return rows.select("commit_id", "sample_class", *[number(c, "double").alias(c) for c in names[2:]])


def grouped_history(rows: DataFrame) -> DataFrame:
    """Past results by class of sample and true purity; runs in the order of their first appearance by commit."""
    return rows.groupBy("sample_class", "true_purity").agg(F.count("*").alias("n_runs"), F.sort_array(F.collect_list(F.struct("commit_id", "delta_purity", "delta_ploidy", "cp_recall", "cp_precision"))).alias("runs"))


def with_ordinals(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Past results with the ordinal of their commit; commits (commit_id, ordinal) are a small list. Unknown ones have null."""
    return rows.join(F.broadcast(commits.select("commit_id", "ordinal")), "commit_id", "left")


def read_summary(spark: SparkSession, path: str) -> dict[str, float]:
    """The values of a run's summary, three pairs of a header and a line of values, by name."""
    lines = [x for r in spark.read.text(path, wholetext=True).collect() for x in r["value"].splitlines() if x.strip()]
    return {k: float(v) for names, values in zip(lines[::2], lines[1::2]) for k, v in zip(names.split("\t"), values.split("\t"))}


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Allele models of each segment, a row for each split of its copies; segment names are chr, start and end."""
    rows = spark.read.parquet(path).select(F.concat_ws("_", F.concat(F.lit("chr"), F.col("chr_idx") + 1), "start", "end").alias("segment"), "cp", F.explode("models").alias("m"))
    return rows.select("segment", "cp", "m.*")


SEX_AND_MITO = ("chrX", "chrY", "chrMT", "chrM", "X", "Y", "MT", "M")


def read_for_plot(spark: SparkSession, path: str) -> DataFrame:
    """Copy numbers as plots take them: rows of other than sex and mitochondrial contigs; without a major they aren't clonal."""
    rows = fields(spark, path, ["chr", "start", "end", "cp", "major"]).where(~F.col("chr").isin(*SEX_AND_MITO))
    rows = rows.select("chr", number("start", "bigint").alias("start"), number("end", "bigint").alias("end"), number("cp", "double").alias("cp"), number("major", "double").alias("major"))
    return rows.where("start is not null and cp is not null").withColumn("is_clonal", F.col("major").isNotNull())
