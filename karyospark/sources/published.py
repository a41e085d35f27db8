"""A sink for files with given names: each is written by one task, beside the folder's contents, and appears at commit.

Tasks write to a hidden folder of the attempt; the commit step renames what the successful tasks wrote, and an abort
removes it, so a failed task or job leaves nothing and earlier files stay. No byte passes the driver. The path must be
mounted on the executors and the driver.
"""

from __future__ import annotations

import gzip
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import ship


@dataclass
class Written(WriterCommitMessage):
    """(final name, name in the hidden folder) of a task's files."""

    files: list[tuple[str, str]]


class PublishedWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, os.path.join(path, f".writing-{uuid.uuid4().hex}")
        os.makedirs(self.staging, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (file, value) with a file's rows together and in order; .gz names are compressed."""
        files: list[tuple[str, str]] = []
        out = plain = None
        attempt = uuid.uuid4().hex
        try:
            for batch in iterator:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if not files or files[-1][0] != name:
                        if os.path.basename(name) != name or name.startswith(".") or any(name == f for f, _ in files):
                            raise ValueError(f"no name of its own: {name}")
                        for f in (out, plain):
                            if f is not None:
                                f.close()
                        files.append((name, f"{attempt}-{len(files)}"))
                        plain = open(os.path.join(self.staging, files[-1][1]), "wb")
                        # neither time nor name in the header: equal rows give equal bytes
                        out = gzip.GzipFile("", "wb", fileobj=plain, mtime=0) if name.endswith(".gz") else plain
                    out.write(value.as_buffer())
        finally:
            for f in (out, plain):
                if f is not None:
                    f.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Renames the files; what a lost or repeated attempt wrote goes with the hidden folder."""
        found = [f for m in messages if m is not None for f in m.files]
        if len({name for name, _ in found}) < len(found):
            self.abort(messages)
            raise ValueError("two tasks wrote one file")
        for name, held in found:
            os.replace(os.path.join(self.staging, held), os.path.join(self.path, name))
        shutil.rmtree(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PublishedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> str:
        return "file string, value binary"

    def writer(self, schema, overwrite: bool) -> PublishedWriter:
        return PublishedWriter(self.options["path"])


def publish(rows: DataFrame, file: Column, value: Column, order: list[Column], path: str) -> None:
    """Writes the values (binary) of each file, in this order, to path/file. Files of the same name are replaced, others stay."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(PublishedSink)
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    dealt = rows.select(file.alias("file"), value.alias("value"), *keys).repartition("file").sortWithinPartitions("file", *[f"k{i}" for i in range(len(order))])
    dealt.select("file", "value").write.format("published").mode("append").save(path)
