"""Alignments in the order of their places: reads are range-partitioned and sorted, and each task writes one BAM file with
its index. The folder's files in the order of their names are the whole, and scans with filters ask each file's index.
"""

from __future__ import annotations

import base64
import glob
import gzip
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from ..session import ship
from .bai import Index
from .bam import MAGIC, scan
from .published import PublishedWriter, Written

#: Bytes of a block before it is compressed, and compressed bytes of input that make one file.
FULL, FILE_BYTES = 0xFF00, 512 << 20
# A block's head without its size, by the format; CIGAR operations that take up the reference (M, D, N, =, X).
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
TAKING = (0, 2, 3, 7, 8)


class Blocks:
    """A file of compressed blocks that knows the virtual offset at which it stands."""

    def __init__(self, f):
        self.f, self.held, self.at = f, bytearray(), 0

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= FULL:
            self.block(bytes(self.held[:FULL]))
            del self.held[:FULL]

    def block(self, part: bytes) -> None:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = c.compress(part) + c.flush()
        out = HEAD + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(part), len(part))
        self.f.write(out)
        self.at += len(out)

    def close(self) -> None:
        """The rest, and the empty block that marks the end."""
        if self.held:
            self.block(bytes(self.held))
        self.block(b"")


def head_of(path: str) -> tuple[bytes, bytes]:
    """A BAM file's header text and its references as they are."""
    with gzip.open(path, "rb") as g:
        if g.read(4) != MAGIC:
            raise ValueError(f"{path}: no BAM file")
        text = g.read(struct.unpack("<i", g.read(4))[0]).rstrip(b"\0")
        refs = g.read(4)
        for _ in range(struct.unpack("<i", refs)[0]):
            size = g.read(4)
            refs += size + g.read(struct.unpack("<i", size)[0] + 4)
    return text, refs


def in_order(text: bytes) -> bytes:
    """The header text of a sorted file."""
    first, _, rest = text.partition(b"\n")
    if not first.startswith(b"@HD"):
        return b"@HD\tVN:1.6\tSO:coordinate\n" + text
    fields = [x for x in first.split(b"\t") if not re.match(rb"(SO|GO|SS):", x)]
    return b"\t".join([*fields, b"SO:coordinate"]) + b"\n" + rest


def span(record: bytes) -> int:
    """How much of the reference a record takes up, 1 at least."""
    n_name, n_ops = record[12], struct.unpack_from("<H", record, 16)[0]
    ops = struct.unpack_from(f"<{n_ops}I", record, 36 + n_name)
    return max(1, sum(x >> 4 for x in ops if x & 15 in TAKING))


class SortedWriter(PublishedWriter):
    """Files and indexes appear at commit; a failed task or job leaves nothing."""

    def __init__(self, path: str, head: bytes):
        super().__init__(path)
        self.head = head

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (part, record) of one part, in order."""
        name, out, attempt = None, None, os.path.join(self.staging, uuid.uuid4().hex)
        (n_text,) = struct.unpack_from("<i", self.head, 4)
        index = Index(struct.unpack_from("<i", self.head, 8 + n_text)[0])
        with open(attempt, "wb") as f:
            for batch in iterator:
                for record in batch.column(1).to_pylist():
                    if out is None:
                        name, out = f"part-{batch.column(0)[0].as_py():05d}.bam", Blocks(f)
                        out.write(self.head)
                    ref, pos = struct.unpack_from("<ii", record, 4)
                    begin = out.tell()
                    out.write(record)
                    index.add(ref, pos, pos + span(record), begin, out.tell())
            if out is not None:
                out.close()
        if name is None:
            return Written([])
        with open(attempt + ".bai", "wb") as f:
            f.write(index.to_bytes())
        # an index is renamed after its file, so that it is never the older one's
        return Written([(name, os.path.basename(attempt)), (name + ".bai", os.path.basename(attempt) + ".bai")])


class SortedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sorted_bam"

    def schema(self) -> str:
        return "part int, record binary"

    def writer(self, schema, overwrite: bool) -> SortedWriter:
        return SortedWriter(self.options["path"], base64.b64decode(self.options["head"]))


def sort_bam(spark: SparkSession, path: str, folder: str, files: int | None = None) -> None:
    """Writes the reads of a BAM file (or of files, by a pattern, with the same references) in order to folder/part-*.bam, with
    indexes. Reads without a reference come last, as the format has it; reads at one place are in the order of a hash,
    so even these can be many tasks' work. An input without reads leaves no file; a folder that has parts is refused.

    files: how many at most, by default one for each 512 MB. Paths must be mounted on executors and driver.
    """
    ship(spark)
    paths = sorted(glob.glob(path))
    if not paths:
        raise FileNotFoundError(path)
    if glob.glob(os.path.join(folder, "part-*.bam")):
        raise FileExistsError(folder)
    heads = [head_of(p) for p in paths]
    if any(refs != heads[0][1] for _, refs in heads):
        raise ValueError(f"{path}: files of different references")
    text = in_order(heads[0][0])
    head = MAGIC + struct.pack("<i", len(text)) + text + heads[0][1]
    spark.dataSource.register(SortedSink)
    n = files or -(-sum(os.path.getsize(p) for p in paths) // FILE_BYTES)
    rows = scan(spark, path, raw=True).withColumn("lone", F.col("ref") < 0).withColumn("tie", F.xxhash64("record"))
    rows = rows.repartitionByRange(n, "lone", "ref", "pos", "tie").sortWithinPartitions("lone", "ref", "pos", "tie")
    rows.select(F.spark_partition_id().alias("part"), "record").write.format("sorted_bam").option("head", base64.b64encode(head).decode()).mode("append").save(folder)
