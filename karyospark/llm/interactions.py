"""Audit of how filters interact: what each removes in every order, and its fair share over all orders.

Every document has one bit for each filter that it fails. A part's counts by mask give its removal polynomial, the
multilinear extension of "documents that fail any filter of a set": its value at a corner is what that set of filters
removes, and a filter's Shapley value is the integral of the partial derivative along the diagonal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bound_batches, checkpoint, table
from .exact_dedup import beside, refined

WHITE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
CORNERS = range(1 << len(FILTERS))
#: Rows of one batch of results.
BATCH = 6000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of docs (doc_id, text, source): the bits of the filters that its text fails.

    A: under 50 words. B: under 65 % of the words are distinct. C: over 5 % of the code points are A-Z. D: holds any of
    #$%&*|. E: a row of smaller doc_id has the same text; rows of null or equal doc_id are no smaller ones.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = refined(docs.select("doc_id", F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text")))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    rules = (
        F.size("words") < 50,
        100 * F.size(F.array_distinct("words")) < 65 * F.size("words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("bigint") > 5 * F.length("text"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((r.cast("int") * (1 << i) for i, r in enumerate(rules)), F.lit(0))
    rows = checkpoint(rows.select("doc_id", "part", mask.alias("own"), F.when(F.col("doc_id").isNotNull(), F.col("full")).alias("full")))
    first = rows.where("full is not null").groupBy("full").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    return beside(rows, first, "full", "n").select("doc_id", "part", (F.col("own") + BIT["E"] * copy).alias("mask"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, masks) with an array of (mask, n, good, toxic) for each part, one entry for each mask that occurs, 32 at most.

    A document is good or toxic if any row of labels with its doc_id says so; null labels and ids say nothing.
    """
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    told = labels.select("doc_id", F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(toxic, F.lit(False)).alias("toxic")).where("doc_id is not null and (good or toxic)")
    told = told.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    each = rows.join(told, "doc_id", "left").groupBy("part", "mask")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint")).alias(c)
    return each.agg(F.count("*").alias("n"), total("good"), total("toxic")).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


class Removal:
    """The polynomial of what sets of filters remove: its coefficient of each product of filters, by mask."""

    def __init__(self, counts: dict[int, int]) -> None:
        # the product over a failing mask of (1 - x) spreads to all of its subsets with alternating signs
        self.coefficient = {t: (-1) ** (t.bit_count() + 1) * sum(n for m, n in counts.items() if m & t == t) for t in CORNERS if t}

    def corner(self, filters: int) -> int:
        """The value where the filters' variables are 1 and all others 0: documents that fail any of them."""
        return sum(c for t, c in self.coefficient.items() if t & filters == t)

    def share(self, bit: int) -> Fraction:
        """The integral from 0 to 1 of the derivative by the filter's variable with all variables equal.

        The derivative of a product of k variables is the product of the others, on the diagonal a power k - 1.
        """
        return sum((Fraction(c, t.bit_count()) for t, c in self.coefficient.items() if t & bit), Fraction(0))


def audit(part: str, masks: list[dict]) -> Iterator[tuple]:
    """The rows of one part, as SCHEMA has them."""
    total = sum(m["n"] for m in masks)
    every, good, toxic = (Removal({m["mask"]: m[c] for m in masks}) for c in ("n", "good", "toxic"))
    corner = {c: [p.corner(s) for s in CORNERS] for c, p in (("n", every), ("good", good), ("toxic", toxic))}
    share = {f: every.share(BIT[f]) * factorial(len(FILTERS)) for f in FILTERS}
    n, whole = corner["n"], CORNERS[-1]
    for order in ORDERS:
        before = 0
        for step, f in enumerate(order, 1):
            after = before | BIT[f]
            removed = n[after] - n[before]
            yield (
                part, order, step, total - n[after], removed, n[BIT[f]] - removed, n[whole] - n[whole ^ BIT[f]],
                corner["good"][after] - corner["good"][before], corner["toxic"][after] - corner["toxic"][before], int(share[f]),
            )
            before = after


def audited(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step; counts: see mask_counts()."""

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for part, masks in zip(b.column("part").to_pylist(), b.column("masks").to_pylist()):
                held += audit(part, masks)
                if len(held) >= BATCH:
                    yield batch_of(dict(zip(SCHEMA.names, zip(*held))), SCHEMA)
                    held = []
        if held:
            yield batch_of(dict(zip(SCHEMA.names, zip(*held))), SCHEMA)

    bound_batches(counts.sparkSession)
    return counts.select("part", "masks").mapInArrow(tell, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source, order of the five filters and step. Null texts and sources count as empty, null ids are never
    copies, repeated rows count each; an empty table gives no row.
    """
    return audited(mask_counts(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


ORACLE_SQL = {
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT x1.f || x2.f || x3.f || x4.f || x5.f AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits FROM x x1, x x2, x x3, x x4, x x5
      WHERE x1.b + x2.b + x3.b + x4.b + x5.b = 31 AND len(list_distinct([x1.b, x2.b, x3.b, x4.b, x5.b])) = 5),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, list_sum(bits[1:i]) - bits[i] AS before FROM (SELECT *, unnest(range(1, 6)) AS i FROM o)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before + bit) = 0) AS kept,
             sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed, sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
             sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
             sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
}
QUERIES = {"op12_filter_audit": op12_filter_audit}
