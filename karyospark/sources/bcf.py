"""A data source for two-sample BCF files, the binary form of VCF, by the published format.

Block-compressed files are read in splits as BAM files are (see bam.py): a split begins at the first place from which on
records follow each other. spark.read.format("bcf") gives the rows of read_calls() with contigs by name; option
split_bytes sets the size of splits.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from .bam import BATCH_BYTES, LONGEST, SPLIT_BYTES, Bytes, Layout, block_size, blocks, next_block, records

SCHEMA = "chr string, pos long, normal_gt string, normal_ro int, normal_ao int, tumor_ro int, tumor_ao int"
KINDS = [pa.string(), pa.int64(), pa.string(), *[pa.int32()] * 4]

# The magic number, and struct codes, missing values and ends of vectors of the integer types.
MAGIC = b"BCF\2"
INTEGERS = {1: ("b", 1, -128, -127), 2: ("h", 2, -32768, -32767), 3: ("i", 4, -(1 << 31), -(1 << 31) + 1)}
SIZES = {0: 0, 1: 1, 2: 2, 3: 4, 5: 4, 7: 1}


def dictionaries(text: str) -> tuple[list[str], list[str]]:
    """Names of contigs and of strings (filters, infos, formats) by their numbers: in order, or as IDX says."""
    contigs: dict[int, str] = {}
    strings: dict[int, str] = {0: "PASS"}
    for kind, body in re.findall(r"^##(contig|FILTER|INFO|FORMAT)=<(.*)>\s*$", text, re.MULTILINE):
        name = re.search(r"(?:^|,)ID=([^,>]*)", body)
        idx = re.search(r"(?:^|,)IDX=(\d+)", body)
        held = contigs if kind == "contig" else strings
        if name and (idx or name[1] not in held.values()):
            held[int(idx[1]) if idx else len(held)] = name[1]
    listed = lambda d: [d.get(i, "") for i in range(max(d, default=-1) + 1)]
    return listed(contigs), listed(strings)


def descriptor(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, length, place behind) of a typed value's head."""
    kind, n = data[at] & 15, data[at] >> 4
    if n < 15:
        return kind, n, at + 1
    inner, _, at = descriptor(data, at + 1)
    code, size, *_ = INTEGERS[inner]
    return kind, struct.unpack_from("<" + code, data, at)[0], at + size


def integers(data: bytes, at: int, kind: int, n: int) -> list[int | None]:
    """n integers, None for missing ones, up to the vector's end."""
    code, _, missing, end = INTEGERS[kind]
    values = struct.unpack_from(f"<{n}{code}", data, at)
    return [None if v == missing else v for v in (values[: values.index(end)] if end in values else values)]


def genotype(values: list[int | None]) -> str:
    """Alleles and how they are joined; the first one's mark says nothing."""
    out = ""
    for i, v in enumerate(values):
        v = v or 0
        out += ("" if not i else "|" if v & 1 else "/") + ("." if v >> 1 == 0 else str((v >> 1) - 1))
    return out


def calls(data: bytes, n_formats: int, n_samples: int, strings: list[str]) -> dict[str, list[list[int | None]]]:
    """The integers of GT and AD of each sample."""
    found: dict[str, list] = {}
    at = 0
    for _ in range(n_formats):
        kind, _, at = descriptor(data, at)
        code, size, *_ = INTEGERS[kind]
        name = strings[struct.unpack_from("<" + code, data, at)[0]]
        kind, n, at = descriptor(data, at + size)
        step = n * SIZES[kind]
        if name in ("GT", "AD") and kind in INTEGERS:
            found[name] = [integers(data, at + s * step, kind, n) for s in range(n_samples)]
        at += n_samples * step
    return found


@dataclass(frozen=True)
class Known:
    """What a file's header says, and how many samples its first record has."""

    contigs: dict[int, str] | list[str]
    strings: dict[int, str] | list[str]
    n_samples: int


def plausible(data: bytes, at: int, known: Known) -> int | None:
    """Where the next record begins if one may begin here, None if none can."""
    shared, own, contig, pos, length, _, alleles, counts = struct.unpack_from("<IIiiifII", data, at)
    good = 25 <= shared <= LONGEST and own <= LONGEST and 0 <= contig < len(known.contigs) and pos >= -1 and length >= 0
    # a site has one allele at least, all samples, and its name is a string
    good = good and alleles >> 16 >= 1 and counts & 0xFFFFFF == known.n_samples and data[at + 32] & 15 in (0, 7)
    return at + 8 + shared + own if good else None


BCF = Layout(8, lambda data, at: at + 8 + sum(struct.unpack_from("<II", data, at)), 33, plausible)


def header(path: str, read) -> Known:
    """The header, from a function that reads so many bytes; it stands at the first record then."""
    if read(5)[:4] != MAGIC:
        raise ValueError(f"{path} is no BCF file")
    contigs, strings = dictionaries(read(struct.unpack("<I", read(4))[0]).rstrip(b"\0").decode())
    return Known(contigs, strings, 0)


def batch_of(data: bytes, offsets: list[int], known: Known) -> pa.RecordBatch:
    """The calls of the records at the offsets."""
    rows: list[tuple] = []
    for at in offsets:
        shared, own = struct.unpack_from("<II", data, at)
        contig, pos = struct.unpack_from("<ii", data, at + 8)
        counts = struct.unpack_from("<I", data, at + 28)[0]
        found = calls(data[at + 8 + shared : at + 8 + shared + own], counts >> 24, counts & 0xFFFFFF, known.strings)
        depth = [(x + [None, None])[:2] for x in (found.get("AD") or [[], []])]
        normal, tumor = (depth + [[None, None]] * 2)[:2]
        rows.append((known.contigs[contig], pos + 1, genotype(found["GT"][0]) if found.get("GT") else None, *normal, *tumor))
    return batch(rows)


class BcfSplit(InputPartition):
    """Blocks that begin from byte start to stop; first: where in the first block the records begin, None where that has to be
    found. stop None: a file that isn't in blocks, read as one."""

    def __init__(self, path: str, known: Known | None, start: int, stop: int | None, first: int | None):
        self.path, self.known, self.start, self.stop, self.first = path, known, start, stop, first


def splits_of(path: str, split_bytes: int) -> list[BcfSplit]:
    with open(path, "rb") as f:
        if block_size(f.read(64)) is None:
            return [BcfSplit(path, None, 0, None, None)]
        stream = Bytes(f)
        known = header(path, stream.read)
        block, first = stream.block, stream.at
        try:
            known = replace(known, n_samples=struct.unpack_from("<I", stream.read(32), 28)[0] & 0xFFFFFF)
        except StopIteration:
            return []  # no records
    size = os.path.getsize(path)
    edges = [block, *range((block // split_bytes + 1) * split_bytes, size, split_bytes), size]
    return [BcfSplit(path, known, a, b, None if i else first) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


class BcfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"]))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        if not self.paths:
            raise FileNotFoundError(options["path"])

    def partitions(self) -> list[InputPartition]:
        # Spark asks for one partition at least
        return [s for p in self.paths for s in splits_of(p, self.split_bytes)] or [BcfSplit(self.paths[0], None, 0, 0, None)]

    def read(self, partition: BcfSplit) -> Iterator[pa.RecordBatch]:
        if partition.stop is None:
            with gzip.open(partition.path, "rb") as g:
                known = header(partition.path, g.read)
                yield from records(((True, x) for x in iter(lambda: g.read(BATCH_BYTES), b"")), 0, known, batch_of, BCF)
            return
        with open(partition.path, "rb") as f:
            at = partition.start if partition.first is not None else next_block(f, partition.start, partition.stop)
            if at is not None:
                yield from records(((a < partition.stop, x) for a, x in blocks(f, at)), partition.first, partition.known, batch_of, BCF)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), KINDS)], names=names)


class BcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BcfReader:
        return BcfReader(self.options)


def read_bcf(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Genotype calls as text.read_calls() gives them: the first sample is the normal, the second the tumor."""
    from .text import contig_number

    ship(spark)
    spark.dataSource.register(BcfSource)
    rows = spark.read.format("bcf").option("split_bytes", split_bytes).load(path)
    return rows.select(contig_number(F.col("chr")).alias("chr_idx"), *[c for c in rows.columns if c != "chr"]).where("chr_idx is not null")
