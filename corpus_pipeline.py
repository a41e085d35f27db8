"""The corpus pipeline: language ID, near-dedup, decontamination, secrets, and BPE encoding of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import bpe, decontaminate, langid, secrets, simhash
from karyospark.llm.common import checkpoint_folder, remove
from karyospark.llm.token_counts import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has profiles of; the rest goes."""
    return langid.keep_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one_of_each(docs, simhash.NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets replaced."""
    return secrets.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and their digest, with the digest of what they decode to."""
    rows = bpe.encoded(docs, vocabulary("word_bpe_49k.json"), "doc_id", "lang", "source")
    digest = F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), digest)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe", encoding)]

#: SQL expresses none of these stages; a test holds all rows of run() against plain Python versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What each keeps is written as Parquet to the shared checkpoint folder and read again;
    the copy before it goes then, so that one copy of the corpus is left at the end, which the last stage reads.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
