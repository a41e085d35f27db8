"""GC counts of sliding windows over sequences of any length.

A sequence comes as pieces with their places, is dealt anew as blocks that overlap by the longest window less one, and
each block counts its own windows from one running sum. No task holds more of a sequence than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import int_div
from ..session import ship

#: Letters of a piece or block, rows of an Arrow batch, and letters whose windows are counted at once.
BLOCK = 1 << 20
ROWS = 1 << 17
LETTERS_AT_ONCE = 1 << 20
# Sizes of windows and the letters that count.
SIZES = (1, 5, 25, 125)
LETTERS = "GCgc"


def pieces(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """(chr, start, bases) of sequences (chr, seq) that come as whole rows; empty and null ones have none."""
    rows = sequences.where("length(seq) > 0").select("chr", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(size))).alias("start"))
    return rows.select("chr", F.col("start").cast("bigint").alias("start"), F.expr(f"substring(seq, start + 1, {size})").alias("bases"))


def overlapping(parts: DataFrame, reach: int, block: int) -> DataFrame:
    """(chr, start, bases): blocks of the sequences that parts (chr, start, bases) tile, each with reach letters of the next."""
    end = F.col("start") + F.length("bases")
    rows = parts.withColumn("block", F.explode(F.sequence(int_div(F.greatest(F.col("start") - reach, F.lit(0)), block), int_div(end - 1, block))))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(end, (F.col("block") + 1) * block + reach)
    cut = F.substring(F.col("bases"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    joined = rows.select("chr", "block", low.alias("at"), cut.alias("bases")).groupBy("chr", "block").agg(F.sort_array(F.collect_list(F.struct("at", "bases"))).alias("x"))
    return joined.select("chr", (F.col("block") * block).alias("start"), F.array_join(F.col("x.bases"), "").alias("bases"))


def counted(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], block: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Blocks (chr, start, bases), some LETTERS_AT_ONCE letters at a time: with where each one's windows begin among all, each
    window's place in its block, and, for each size, the counts of all windows.
    """
    table = np.zeros(256, bool)
    table[[ord(c) for c in LETTERS]] = True
    for batch in batches:
        lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // LETTERS_AT_ONCE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            some = batch.slice(a, b - a)
            text = np.frombuffer(b"".join(some.column(2).cast(pa.binary()).to_pylist()), np.uint8)
            edges = np.concatenate(([0], np.cumsum(lengths[a:b])))
            first = (text & 0xC0) != 0x80  # a letter's first byte; those that count have no other
            edges = np.concatenate(([0], np.cumsum(first)))[edges]
            held = table[text[first]]
            run = np.concatenate(([0], np.cumsum(held)))
            n = np.diff(edges)
            place = np.arange(len(held)) - np.repeat(edges[:-1], n)
            windows = np.flatnonzero(place < block)
            ends = np.repeat(edges[1:], np.minimum(n, block))
            counts = [run[np.minimum(windows + s, ends)] - run[windows] for s in sizes]
            yield some, np.concatenate(([0], np.cumsum(np.minimum(n, block)))), place[windows], counts


def gc_blocks(parts: DataFrame, sizes: tuple[int, ...] = SIZES, block: int = BLOCK) -> DataFrame:
    """(chr, window_size, start, counts): the counts of all windows that start in a block, a byte each.

    parts: (chr, start, bases), which tile each sequence. Windows run forward and hold fewer letters at the end.
    """
    if max(sizes) > 255:
        raise ValueError("counts of windows above 255 letters don't fit a byte")
    ship(parts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, edges, _, counts in counted(batches, sizes, block):
            n, offsets = some.num_rows, pa.py_buffer(edges.astype(np.int32))
            for size, gc in zip(sizes, counts):
                made = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(gc.astype(np.uint8))])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(n, size, np.int32)), some.column(1), made], names=["chr", "window_size", "start", "counts"])

    return overlapping(parts, max(sizes) - 1, block).mapInArrow(count, "chr string, window_size int, start bigint, counts binary")


def gc_windows(parts: DataFrame, sizes: tuple[int, ...] = SIZES, block: int = BLOCK) -> DataFrame:
    """(chr, window_size, start, gc): a row for each window of gc_blocks()."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, start, counts in zip(*(c for c in b.columns)):
                gc = np.frombuffer(counts.as_py(), np.uint8).astype(np.int32)
                for i in range(0, len(gc), ROWS):
                    n = len(gc[i : i + ROWS])
                    columns = [pa.array([name.as_py()] * n, pa.string()), pa.array(np.full(n, size.as_py(), np.int32)), pa.array(start.as_py() + i + np.arange(n)), pa.array(gc[i : i + n])]
                    yield pa.RecordBatch.from_arrays(columns, names=["chr", "window_size", "start", "gc"])

    return gc_blocks(parts, sizes, block).mapInArrow(spread, "chr string, window_size int, start bigint, gc int")


def gc_sums(parts: DataFrame, sizes: tuple[int, ...] = SIZES, block: int = BLOCK) -> DataFrame:
    """(chr, window_size, n, total, by_place, squares): all windows of gc_windows() of each sequence and size, their counts' sum,
    the sum of counts by place from 1, and that of their squares. A block's windows are summed where they are counted.
    """
    ship(parts.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, edges, place, counts in counted(batches, sizes, block):
            n, start, each = some.num_rows, some.column(1).to_numpy(), lambda x: np.add.reduceat(x, edges[:-1])
            for size, gc in zip(sizes, counts):
                total = each(gc)
                made = [np.full(n, size, np.int32), np.diff(edges), total, each(gc * (place + 1)) + start * total, each(gc * gc)]
                yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, made)], names=["chr", "window_size", "n", "total", "by_place", "squares"])

    rows = overlapping(parts, max(sizes) - 1, block).mapInArrow(sums, "chr string, window_size int, n bigint, total bigint, by_place bigint, squares bigint")
    return rows.groupBy("chr", "window_size").agg(*[F.sum(c).alias(c) for c in ("n", "total", "by_place", "squares")])
