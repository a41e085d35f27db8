"""A data source for lines of block-compressed text, such as .vcf.gz files of sites: files are read in splits.

A split begins with the first block in it. It gives the lines that begin after the first line end in its blocks (the first
split of a file: all) up to the first one that begins past them, so each line is given once, whatever cuts it.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from .bam import BATCH_BYTES, SPLIT_BYTES, block_size, blocks, next_block


class Piece(InputPartition):
    """The blocks that begin from byte start to stop of a file."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def is_blocked(path: str) -> bool:
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        return block_size(f.read(64)) is not None


def whole_lines(pieces: Iterator[tuple[bool, bytes]], first: bool) -> Iterator[bytes]:
    """Bytes of whole lines, from (own, bytes) of blocks; see above which. first: the pieces begin a file."""
    held: list[bytes] = []  # a line's beginning
    taking = first
    for own, data in pieces:
        if not taking:
            k = data.find(b"\n")
            if not own:
                return
            if k < 0:
                continue
            data, taking = data[k + 1 :], True
        k = data.rfind(b"\n") if own else data.find(b"\n")
        if k < 0:
            held.append(data)
            continue
        yield b"".join([*held, data[: k + 1]])
        if not own:
            return
        held = [data[k + 1 :]]
    rest = b"".join(held)
    if rest:
        yield rest + b"\n"


def batch_of(taken: list[bytes]) -> pa.RecordBatch:
    """Lines end with \\n or \\r\\n; bytes that are no UTF-8 are replaced."""
    lines = b"".join(taken).decode("utf-8", "replace").split("\n")[:-1]
    return pa.RecordBatch.from_arrays([pa.array([x.removesuffix("\r") for x in lines], pa.string())], names=["value"])


class BlockedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"]))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[InputPartition]:
        return [Piece(p, a, a + self.split_bytes) for p in self.paths for a in range(0, os.path.getsize(p), self.split_bytes)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as f:
            at = partition.start and next_block(f, partition.start, partition.stop)
            if at is None:
                return
            taken: list[bytes] = []
            size = 0
            for lines in whole_lines(((a < partition.stop, x) for a, x in blocks(f, at)), partition.start == 0):
                taken.append(lines)
                size += len(lines)
                if size >= BATCH_BYTES:
                    yield batch_of(taken)
                    taken, size = [], 0
            if taken:
                yield batch_of(taken)


class BlockedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocked_text"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> BlockedReader:
        return BlockedReader(self.options)


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(value) of the lines: block-compressed files in splits, where the path (mounted on executors and driver) has only such; else
    as Spark reads text, where any other gz file is one task."""
    paths = glob.glob(path)
    if not paths or not all(map(is_blocked, paths)):
        return spark.read.text(path)
    ship(spark)
    spark.dataSource.register(BlockedText)
    return spark.read.format("blocked_text").option("split_bytes", split_bytes).load(path)
