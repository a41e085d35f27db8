"""A data source for BAM files: BGZF blocks and records by the published format, with the standard library and numpy.

Files are split by bytes. A split begins at the first block in it and there at the first place from which on records
follow each other, and it ends with the last record that begins in one of its blocks. Splits yield Arrow batches.
spark.read.format("bam") gives READS without the sample; option split_bytes sets the size of splits, and raw gives whole
records instead. Filters on chr and pos read only the chunks that the index beside a file (.bam.bai or .bai) names for them,
where there is one and spark.sql.python.filterPushdown.enabled is set, as read_bam() does.
"""

from __future__ import annotations

import glob
import gzip
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import ship
from .bai import LONGEST as WHOLE
from .bai import Index, groups

SCHEMA = "chr string, pos long, mate_pos long, insert_size long, seq_len int, mapq int, flags int"
RAW_SCHEMA = "ref int, pos long, record binary"
SPLIT_BYTES = 32 << 20
#: Decompressed bytes of a batch, and records in a row that prove a record's begin.
BATCH_BYTES = 4 << 20
IN_A_ROW = 8
#: Bytes of a record that can begin a split.
LONGEST = 1 << 26

# The format's magic numbers and the layout of a record's fixed part.
MAGIC, GZIP = b"BAM\1", b"\x1f\x8b\x08\x04"
FIXED = np.dtype(
    [("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flags", "<u2"),
     ("length", "<i4"), ("mate_ref", "<i4"), ("mate", "<i4"), ("span", "<i4")]
)


class Split(InputPartition):
    """Blocks that begin from byte start to stop of a file; first: where in the first block's bytes the records begin,
    None where that has to be found. stop None: a file that isn't BGZF, read as one."""

    def __init__(self, path: str, names: list[str], start: int, stop: int | None, first: int | None):
        self.path, self.names, self.start, self.stop, self.first = path, names, start, stop, first


class Chunks(InputPartition):
    """Chunks of virtual offsets that begin and end with records. stop: where the blocks end whose records are read, of a
    chunk that is cut; found False: where in its blocks the first record begins has to be found."""

    def __init__(self, path: str, names: list[str], chunks: list[tuple[int, int]], stop: int | None = None, found: bool = True):
        self.path, self.names, self.chunks, self.stop, self.found = path, names, chunks, stop, found


def block_size(head: bytes) -> int | None:
    """The size of the BGZF block that begins with these bytes, None if none does."""
    if len(head) < 18 or head[:4] != GZIP:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(begin, bytes) of each block from the one at this byte on."""
    while True:
        f.seek(at)
        size = block_size(f.read(64))
        if size is None:
            return
        f.seek(at)
        raw = f.read(size)
        yield at, zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] :], -15)
        at += size


def next_block(f, at: int, stop: int) -> int | None:
    """Where the first block from this byte on begins, None if none does before stop."""
    while at < stop:
        f.seek(at)
        raw = f.read(1 << 17)
        k = raw.find(GZIP)
        while k >= 0 and at + k < stop:
            size = block_size(raw[k : k + 64])
            if size is not None:
                f.seek(at + k + size)
                after = f.read(64)
                if not after or block_size(after) is not None:
                    return at + k
            k = raw.find(GZIP, k + 1)
        if len(raw) <= 64:
            return None
        at += len(raw) - 64
    return None


def plausible(data: bytes, at: int, n_names: int) -> int | None:
    """Where the next record begins if one may begin here, None if none can."""
    size, ref, pos, l_name, _, _, n_cigar, _, length, mate_ref, mate, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (-1 <= ref < n_names and -1 <= mate_ref < n_names and pos >= -1 and mate >= -1 and l_name >= 1 and length >= 0):
        return None
    if not 32 + l_name + 4 * n_cigar + (length + 1) // 2 + length <= size <= LONGEST:
        return None
    name_end = at + 36 + l_name - 1
    return at + 4 + size if name_end >= len(data) or data[name_end] == 0 else None


@dataclass(frozen=True)
class Layout:
    """How records tell their length: in so many first bytes (head), after which the next one's place is known (after); and
    plausible(data, at, known) as above, which looks at so many bytes (checked)."""

    head: int
    after: Callable[[bytes, int], int]
    checked: int
    plausible: Callable


BAM = Layout(4, lambda data, at: at + 4 + struct.unpack_from("<i", data, at)[0], FIXED.itemsize, lambda data, at, names: plausible(data, at, len(names)))


def first_record(data: bytes, known, final: bool, layout: Layout = BAM) -> int | None:
    """The first place from which on IN_A_ROW records follow each other, or fewer up to the end of a final piece.

    -1 where data that isn't final is too short to tell, None where there is none.
    """
    for at in range(len(data)):
        k, n = at, 0
        while k is not None and n < IN_A_ROW:
            if final and n and k == len(data):
                return at
            if k + layout.checked > len(data):
                if not final:
                    return -1
                break
            k, n = layout.plausible(data, k, known), n + 1
        else:
            if k is not None:
                return at
    return None if final else -1


def header(read) -> list[str]:
    """Names of the references, from a function that reads so many bytes; it stands at the first record then."""
    if read(4) != MAGIC:
        raise ValueError("no BAM file")
    read(struct.unpack("<i", read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", read(4))[0]):
        names.append(read(struct.unpack("<i", read(4))[0])[:-1].decode())
        read(4)
    return names


class Bytes:
    """Blocks' bytes as one stream that knows in which block it stands."""

    def __init__(self, f):
        self.source, self.data, self.at, self.block, self.used = blocks(f, 0), b"", 0, 0, 0

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at == len(self.data):
                self.block, self.data = next(self.source)
                self.at = 0
            part = self.data[self.at : self.at + n - len(out)]
            out += part
            self.at += len(part)
        return out


def splits_of(path: str, split_bytes: int) -> list[Split]:
    with open(path, "rb") as f:
        if block_size(f.read(64)) is None:
            return [Split(path, [], 0, None, None)]
        stream = Bytes(f)
        try:
            names = header(stream.read)
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from None
    size = os.path.getsize(path)
    edges = [stream.block, *range((stream.block // split_bytes + 1) * split_bytes, size, split_bytes), size]
    return [Split(path, names, a, b, None if i else stream.at) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def batch_of(data: bytes, offsets: list[int], names: list[str]) -> pa.RecordBatch:
    """The mapped reads that begin at the offsets."""
    raw = np.frombuffer(data, np.uint8)[np.array(offsets, np.int64)[:, None] + np.arange(FIXED.itemsize)]
    got = np.ascontiguousarray(raw).view(FIXED)[:, 0]
    got = got[got["ref"] >= 0]
    chrs = pa.DictionaryArray.from_arrays(pa.array(got["ref"].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
    longs = [pa.array(got[c].astype(np.int64)) for c in ("pos", "mate", "span")]
    ints = [pa.array(got[c].astype(np.int32)) for c in ("length", "mapq", "flags")]
    return pa.RecordBatch.from_arrays([chrs, *longs, *ints], names=["chr", "pos", "mate_pos", "insert_size", "seq_len", "mapq", "flags"])


def raw_batch(data: bytes, offsets: list[int], names: list[str]) -> pa.RecordBatch:
    """The whole records, of unmapped reads too."""
    found = [struct.unpack_from("<iii", data, a) for a in offsets]
    columns = [pa.array([r for _, r, _ in found], pa.int32()), pa.array([p for _, _, p in found], pa.int64()), pa.array([data[a : a + 4 + n] for a, (n, _, _) in zip(offsets, found)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["ref", "pos", "record"])


def records(pieces: Iterator[tuple[bool, bytes]], first: int | None, known, make=batch_of, layout: Layout = BAM) -> Iterator[pa.RecordBatch]:
    """Batches, by make(data, offsets, known), of the records that begin in own pieces of (own, bytes); of others only a record's rest is taken."""
    data, at, limit, target, more = b"", first, None, BATCH_BYTES, True
    while True:
        taken, size = [data], len(data)
        while more and size < target:
            own, piece = next(pieces, (False, None))
            more = piece is not None
            if more:
                if not own and limit is None:
                    limit, target = size, 0
                taken.append(piece)
                size += len(piece)
        data = b"".join(taken)
        if at is None:
            at = first_record(data, known, not more, layout)
        if at == -1:
            at, target = None, len(data) + (BATCH_BYTES if limit is None else 1)
            continue
        if at is None:
            return
        offsets, end = [], len(data) if limit is None else limit
        while at < end and at + layout.head <= len(data):
            after = layout.after(data, at)
            if after > len(data):
                break
            offsets.append(at)
            at = after
        if offsets:
            yield make(data, offsets, known)
        if not more or (limit is not None and at >= limit):
            return
        data, at, limit = data[at:], 0, None if limit is None else limit - at
        target = len(data) + (BATCH_BYTES if limit is None else 1)


def chunk_pieces(f, begin: int, end: int, stop: int | None = None) -> Iterator[tuple[bool, bytes]]:
    """The blocks' bytes from a byte on to a virtual offset; own are blocks before stop."""
    for at, data in blocks(f, begin):
        last = at >= end >> 16
        if at <= end >> 16:
            yield stop is None or at < stop, data[: end & 0xFFFF] if last else data
        if last:
            return


def parts_of(path: str, names: list[str], chunks: list[tuple[int, int]], most: int) -> list[Chunks]:
    """A group of chunks as one part, or its only chunk cut where it has more bytes."""
    (a, b), first = chunks[0], chunks[0][0] >> 16
    if len(chunks) > 1 or (b >> 16) - first < 2 * most:
        return [Chunks(path, names, chunks)]
    edges = [*range(first, b >> 16, most), (b >> 16) + 1]
    return [Chunks(path, names, [(x << 16 if i else a, b)], y, not i) for i, (x, y) in enumerate(zip(edges, edges[1:]))]


def index_beside(path: str) -> Index | None:
    """The file's index; None if there is none, or if the file is newer, as one that was written again is."""
    for name in (path + ".bai", os.path.splitext(path)[0] + ".bai"):
        if os.path.exists(name) and os.path.getmtime(name) >= os.path.getmtime(path):
            with open(name, "rb") as f:
                return Index.from_bytes(f.read())
    return None


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"]))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.raw = options.get("raw", "false").lower() == "true"
        self.chrs: set[str] | None = None
        self.start, self.end = 0, WHOLE
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Narrows what is read. Chunks hold other reads too, so Spark applies all filters again."""
        for x in filters:
            if getattr(x, "attribute", None) == ("chr",) and isinstance(x, (EqualTo, In)):
                own = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.chrs = own if self.chrs is None else self.chrs & own
            elif getattr(x, "attribute", None) == ("pos",) and isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and x.value is not None:
                if isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, x.value + isinstance(x, GreaterThan))
                if isinstance(x, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, x.value + (not isinstance(x, LessThan)))
        return filters

    def partitions_of(self, path: str) -> list[InputPartition]:
        splits = splits_of(path, self.split_bytes)
        narrow = not self.raw and (self.chrs is not None or self.start > 0 or self.end < WHOLE)
        index = index_beside(path) if narrow and splits and splits[0].stop is not None else None
        if index is None or self.end <= 0:  # a mapped read without a place has pos -1
            return splits
        names = splits[0].names
        refs = [i for i, name in enumerate(names) if self.chrs is None or name in self.chrs]
        found = groups(index.chunks(refs, self.start, self.end), self.split_bytes)
        return [x for own in found for x in parts_of(path, names, own, self.split_bytes)]

    def partitions(self) -> list[InputPartition]:
        # Spark asks for one partition at least
        return [s for p in self.paths for s in self.partitions_of(p)] or [Chunks(self.paths[0], [], [])]

    def read(self, partition: Split | Chunks) -> Iterator[pa.RecordBatch]:
        make = raw_batch if self.raw else batch_of
        if isinstance(partition, Chunks):
            with open(partition.path, "rb") as f:
                for begin, end in partition.chunks:
                    at = begin >> 16 if partition.found else next_block(f, begin >> 16, partition.stop)
                    if at is not None:
                        yield from records(chunk_pieces(f, at, end, partition.stop), begin & 0xFFFF if partition.found else None, partition.names, make)
            return
        if partition.stop is None:
            with gzip.open(partition.path, "rb") as g:
                try:
                    names = header(g.read)
                except ValueError as e:
                    raise ValueError(f"{partition.path}: {e}") from None
                yield from records(((True, x) for x in iter(lambda: g.read(1 << 20), b"")), 0, names, make)
            return
        with open(partition.path, "rb") as f:
            at = partition.start if partition.first is not None else next_block(f, partition.start, partition.stop)
            if at is not None:
                yield from records(((a < partition.stop, x) for a, x in blocks(f, at)), partition.first, partition.names, make)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return RAW_SCHEMA if self.options.get("raw", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def scan(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, raw: bool = False) -> DataFrame:
    """The source as it is; filters on chr and pos reach it."""
    ship(spark)
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bam").option("split_bytes", split_bytes).option("raw", str(raw).lower()).load(path)


def read_bam(spark: SparkSession, path: str, sample: str, contigs: DataFrame, split_bytes: int = SPLIT_BYTES, chrs: list[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """READS of a sample on the known contigs; unmapped reads go. chrs, start and end keep reads on these contigs that begin
    from start to end, both included and from 0; an index beside the file spares reading the rest.
    """
    rows = scan(spark, path, split_bytes)
    if chrs is not None:
        rows = rows.where(F.col("chr").isin(chrs))
    if start is not None:
        rows = rows.where(F.col("pos") >= start)
    if end is not None:
        rows = rows.where(F.col("pos") <= end)
    rows = rows.join(F.broadcast(contigs.select("chr", "chr_idx")), "chr")
    return rows.select(F.lit(sample).alias("sample"), "chr_idx", "pos", "mate_pos", "insert_size", "seq_len", "mapq", "flags")
