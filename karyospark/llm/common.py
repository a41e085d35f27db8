"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows and bytes of one Arrow batch, so that a worker holds few long texts at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and by bytes; sees to it that workers can import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"karyospark-checkpoints-{os.getpid()}")
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, which outlives any executor.

    Spark removes the files of such copies that nothing refers to, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def repeated(start: DataFrame, step: Callable[[DataFrame], DataFrame | None]) -> DataFrame:
    """A checkpoint of the last rows of start, step(start), step(step(start)).. until a step gives None.

    Each round's rows are written to the shared checkpoint folder and read again, so that plans start anew from the size of
    files. A checkpoint keeps the estimated size of the plan it comes from, and that of a join is the product of its sides': where
    each round joins the last one's rows with themselves, the number's digits are a multiple of those before, and soon
    take the driver's memory and time. The files of the round before go once a round is written.
    """
    spark = start.sparkSession
    folder, before, k = f"{checkpoint_folder(spark)}/rounds-{uuid.uuid4().hex}", None, 0
    try:
        while start is not None:
            path = f"{folder}/{k}"
            start.write.parquet(path)
            rows = spark.read.schema(start.schema).parquet(path)
            if before is not None:
                remove(spark, before)
            before, k, start = path, k + 1, step(rows)
        return checkpoint(rows)
    finally:
        remove(spark, folder)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def texts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the text, null texts as empty ones; nothing else is read."""
    return docs.select(*[docs[c] for c in keep], F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def row_key(docs: DataFrame) -> list[Column]:
    """Two longs that identify a row by id and text: key_id, and key_text whose lowest bit marks a null id."""
    mark = F.xxhash64(docs["text"], docs["doc_id"])
    mark = F.shiftleft(F.shiftrightunsigned(mark, 1), 1) + docs["doc_id"].isNull().cast("bigint")
    return [F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0).cast("bigint")).alias("__key_id"), mark.alias("__key_text")]


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """docs with all but the needed columns renamed, so that no name clashes with a working column; toDF() undoes it."""
    return docs.select(*[docs[c].alias(c if c in needed else f"extra_{i}") for i, c in enumerate(docs.columns)])


def batch_of(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def balanced(sizes: list[int], limit: int):
    """Index ranges whose sizes sum to the limit at most, or hold a single entry."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
