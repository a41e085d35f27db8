"""Sequences along a key without any task that holds the key.

Rows are range-partitioned and numbered in two passes: each partition counts its rows of a key, the counts' running sums
are handed back as offsets. Blocks of rows are cut by number then, and get from their neighbours what a frame needs:
the rows next to them, or a running total of all blocks before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import checkpoint

#: Rows of a block; sequences of fewer rows in all are one window a key.
BLOCK = 1 << 20
#: Rows up to which a small table is broadcast; larger ones are copied, and rows are dealt among the copies.
FEW = 100_000
DEALT = 32
#: Partitions of a sequence beside those that blocks of BLOCK rows need: smaller blocks share partitions, since each task
#: costs the driver some KB.
PARTITIONS = 64


def is_small(few: DataFrame) -> bool:
    """Whether a checkpointed table has FEW rows at most."""
    return few.limit(FEW + 1).count() <= FEW


def dealt_join(rows: DataFrame, few: DataFrame, on: Sequence[str], by: str, how: str = "inner", small: bool | None = None) -> DataFrame:
    """rows joined with few, a checkpointed table with few rows for each value of on; how: inner or left.

    few is broadcast up to FEW rows (small: whether it is known to be). Beyond, it goes to DEALT tasks for each value, to
    which rows are dealt by the column by, so that a value that most rows have is no single task's work.
    """
    if is_small(few) if small is None else small:
        return rows.join(F.broadcast(few), list(on), how)
    copies = few.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return rows.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(DEALT)).cast("int")).join(copies, [*on, "_deal"], how).drop("_deal")


def partitions(n: int, size: int) -> int:
    """The partitions of n rows in blocks of size: one a block, but no more than PARTITIONS for blocks of less than BLOCK rows."""
    return max(1, min(math.ceil(n / size), max(PARTITIONS, math.ceil(n / BLOCK))))


def numbered(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str], size: int = BLOCK, n: int | None = None) -> DataFrame:
    """rows with _i, their number from 0 within the key by order; checkpointed. Ties are numbered by a hash of the row."""
    order = [order] if isinstance(order, str) else list(order)
    parts = partitions(rows.count() if n is None else n, size)
    line = [*keys, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.xxhash64(*rows.columns)).repartitionByRange(parts, *line).sortWithinPartitions(*line)
    placed = checkpoint(dealt.drop("_tie").withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    counts = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part")  # a row for each partition
    offsets = checkpoint(counts.select(*keys, "_part", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_offset")))
    return dealt_join(placed, offsets, [*keys, "_part"], "_at").select(*rows.columns, (F.col("_at") + F.col("_offset")).alias("_i"))


def framed(rows: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Numbered rows with _b: each row in its own block of size rows and in each other one with a row whose frame, from before
    rows back to after rows ahead, reaches it; _own tells the row's own block.
    """
    block = lambda i: F.floor(i / size).cast("bigint")
    reached = F.sequence(F.greatest(F.lit(0).cast("bigint"), block(F.col("_i") - after)), block(F.col("_i") + before))
    return rows.withColumn("_own", block(F.col("_i"))).withColumn("_b", F.explode(reached))


def along(rows: DataFrame, keys: Sequence[str], order: str, before: int, after: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], block: int | None = None) -> DataFrame:
    """compute(rows, window) for frames of before rows back to after rows ahead at most, within the key, by order.

    compute gets rows with _i, their number within the key, and a window ordered by it. block: the rows of a block; None:
    one window a key while all rows together are BLOCK at most, and blocks of that size beyond.
    """
    if block is None:
        n = rows.count()
        if n <= BLOCK:
            line = Window.partitionBy(*keys).orderBy(order)
            return compute(rows.withColumn("_i", F.row_number().over(line) - 1), Window.partitionBy(*keys).orderBy("_i")).drop("_i")
        block = BLOCK
    spread = framed(numbered(rows, keys, order, block), block, before, after)
    done = compute(spread, Window.partitionBy(*keys, "_b").orderBy("_i"))
    return done.where(F.col("_b") == F.col("_own")).drop("_i", "_b", "_own")


def running_max_before(rows: DataFrame, column: str, keys: Sequence[str], order: Sequence[str], block: int | None = None) -> DataFrame:
    """rows with _before, the largest of column in the rows before within the key, null for the first.

    Blocks' maxima come first; their running maximum is what each block starts from.
    """
    if block is None:
        n = rows.count()
        if n <= BLOCK:
            return rows.withColumn("_before", F.max(column).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
        block = BLOCK
    cut = framed(numbered(rows, keys, order, block), block, 0, 0).drop("_own")
    most = cut.groupBy(*keys, "_b").agg(F.max(column).alias("_most"))
    line = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = checkpoint(most.select(*keys, "_b", F.max("_most").over(line).alias("_before_block")))
    within = Window.partitionBy(*keys, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    got = dealt_join(cut, starts, [*keys, "_b"], "_i").withColumn("_before", F.greatest(F.max(column).over(within), F.col("_before_block")))
    return got.drop("_i", "_b", "_before_block")
