"""Block scans, exact selection and joins of mixed lengths: the same rows as plain windows, sorts and loops, whatever the block."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyospark.operators import blocks, selection
from karyospark.operators import histogram as H
from karyospark.operators import intervals as I
from karyospark.operators import segmentation as G


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    data = [(k, i * 3, draw.choice([draw.gauss(1, 0.3), 0.5, -0.0, 0.0, -1e300, 1e-310]), draw.randrange(1, 9)) for k, n in (("a", 700), ("b", 41), ("c", 1)) for i in draw.sample(range(n), n)]
    return spark.createDataFrame(data, "key string, at bigint, v double, w bigint").cache()


def told(df, digits=None):
    return sorted(repr(tuple(round(x, digits) if digits and isinstance(x, float) else x for x in r)) for r in df.collect())


def test_numbers(rows):
    got = blocks.numbered(rows, ["key"], "at", 50).collect()
    assert all(r["_i"] * 3 == r["at"] for r in got) and len(got) == 742
    parts = Counter(r["_b"] for r in blocks.framed(blocks.numbered(rows, ["key"], "at", 50).where("key = 'a'"), 50, 0, 0).collect())
    assert max(parts.values()) == 50 and len(parts) == 14


@pytest.mark.parametrize("block", [7, 100])
def test_scans_equal_windows(rows, block):
    """Frames wider than a block too."""
    tame = rows.withColumn("v", F.when(F.abs("v") < 1e9, F.col("v")).otherwise(2.0))
    for f in (
        lambda b: H.noise_variance(tame, "v", "key", "at", block=b),
        lambda b: H.window_average(tame, "v", "key", "at", 11, block=b),
        lambda b: H.moving_stats(tame, "v", "key", "at", 5, 4, block=b),
        lambda b: H.moving_stats(tame, "v", "key", "at", 20, 40, block=b),
    ):
        assert told(f(block), 9) == told(f(None), 9)
    segments = tame.select("key", F.col("at").alias("start"), F.col("v").alias("ratio"), F.col("w").alias("n_windows"))
    base = H.base_level(segments, "key")
    assert told(G.collapse(segments, base, 0.01, keys=("key",), block=block)) == told(G.collapse(segments, base, 0.01, keys=("key",)))


@pytest.mark.parametrize("block", [5, 64])
def test_gaps_equal_a_loop(spark, block):
    draw = random.Random(block)
    segs = [(c, s, s + draw.choice([5, 5, 400])) for c in (0, 1) for s in draw.sample(range(1, 20_000), 300)]
    contigs = spark.createDataFrame([(c, 21_000) for c in range(3)], "chr_idx int, length bigint")
    got = told(I.complement(spark.createDataFrame(segs, "chr_idx int, start bigint, end bigint"), contigs, block=block))
    want = []
    for c in range(3):
        at = 1
        for _, s, e in sorted(x for x in segs if x[0] == c) + [(c, 21_001, 21_001)]:
            if s > at:
                want.append((c, at, s - 1))
            at = max(at, e + 1)
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("large", [0, 100])
def test_selection_equals_sorting(rows, large):
    """Groups solved by digits, and next to small ones; values over all exponents, equal ones, both zeros."""
    assert told(H.median_mad(rows, "v", "key", large=large)) == told(H.median_mad(rows, "v", "key"))
    if not large:
        assert told(H.median_mad(rows, "v", large=large)) == told(H.median_mad(rows, "v"))
    levels = lambda n: H.base_level(rows, "key", "v", "w", large=n).withColumn("base_level", F.col("base_level") + 0.0)
    assert told(levels(large)) == told(levels(1 << 20))
    tame = rows.withColumn("v", F.when(F.abs("v") < 1e9, F.col("v")).otherwise(2.0))
    for percent in (0.0, 40.0) if large else (7.0, 100.0):
        assert told(H.trimmed(tame, "v", "key", percent=percent, large=large), 9) == told(H.trimmed(tame, "v", "key", percent=percent), 9)


def test_selection_without_a_broadcast(rows, monkeypatch):
    monkeypatch.setattr(blocks, "FEW", 0)
    assert told(H.median_mad(rows, "v", "key", large=0)) == told(H.median_mad(rows, "v", "key"))


def test_ranks_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None), ("a", 1.0)], "key string, v double")
    assert told(H.median_mad(rows, "v", "key", large=0)) == ["('a', 1.5, 0.5)"]
    assert H.trimmed(rows.limit(0), "v", "key", large=0).count() == 0 and H.median_mad(rows.limit(0), "v", "key").count() == 0
    assert told(H.median_mad(rows.limit(0), "v")) == ["(None, None)"]


def test_bits_are_in_order():
    import pandas as pd

    values = np.array([-np.inf, -1e300, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf])
    bits = selection.ordered(pd.Series(values)).to_numpy().view(np.uint64)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5] and len(set(bits.tolist())) == 9


@pytest.fixture(scope="module")
def mixed(spark):
    draw = random.Random(4)
    spans = [(draw.randrange(2), s := draw.randrange(100_000_000), s + round(10 ** draw.uniform(0, 8)), i) for i in range(300)]
    spans += [(0, 5, 4, 900), (0, 1_599_999, 1_600_000, 901), (0, 16, 16, 902), (1, 0, 120_000_000, 903), (1, 0, 120_000_000, 903)]
    points = [(draw.randrange(2), draw.choice([draw.randrange(100_000_000), s, e]), i) for i, (_, s, e, _) in enumerate(spans)] + [(0, 16, 1000), (0, 16, 1000), (5, 16, 1001)]
    return spans, points


def test_points_in_intervals_of_all_lengths(spark, mixed):
    spans, points = mixed
    a, b = spark.createDataFrame(points, "chr_idx int, pos bigint, p int"), spark.createDataFrame(spans, "chr_idx int, start bigint, end bigint, s int")
    want = sorted((p, s) for c, x, p in points for d, i, j, s in spans if c == d and i <= x <= j)
    for width in (10, 1000, 100_000):
        got = I.interval_join(a, b, ["chr_idx"], width=width)
        assert sorted((r["p"], r["s"]) for r in got.collect()) == want
        assert sorted(r["p"] for r in I.within(a, b, ["chr_idx"], width=width).collect()) == sorted(p for c, x, p in points if any(c == d and i <= x <= j for d, i, j, _ in spans))
        asked, placed = I.asking(a, b, "pos", "start", "end", width).count(), I.placed(b, "start", "end", width).count()
        assert asked <= 8 * len(points) and placed <= 2 * len(spans)
    left = I.interval_join(a, b, ["chr_idx"], width=1000, how="left").collect()
    inside = {p for p, _ in want}
    assert sorted((r["p"], -1 if r["s"] is None else r["s"]) for r in left) == sorted(want + [(p, -1) for _, _, p in points if p not in inside])
    assert I.interval_join(a, b.limit(0), ["chr_idx"]).count() == 0 and I.interval_join(a, b.limit(0), ["chr_idx"], how="left").count() == len(points)


def test_overlaps_of_all_lengths(spark, mixed):
    spans, _ = mixed
    draw = random.Random(9)
    others = [(draw.randrange(2), s := draw.randrange(100_000_000), s + round(10 ** draw.uniform(0, 8)), i) for i in range(200)] + [(0, 1_600_000, 1_600_000, 999)]
    a, b = (spark.createDataFrame(x, "chr_idx int, start bigint, end bigint, s int") for x in (spans, others))
    want = sorted((s, t, max(i, k), min(j, m)) for c, i, j, s in spans for d, k, m, t in others if c == d and i <= j and k <= m and max(i, k) <= min(j, m))
    for width in (10, 100_000):
        got = I.overlap_join(a, b, ["chr_idx"], width=width).collect()
        assert sorted((r["l_s"], r["r_s"], r["shared_start"], r["shared_end"]) for r in got) == want


def test_points_within_more_regions_than_a_block(spark, monkeypatch):
    draw = random.Random(8)
    points = [(draw.randrange(3), draw.randrange(4_000)) for _ in range(400)]
    regions = [(draw.randrange(2), s, s + draw.choice([5, 60])) for s in draw.sample(range(4_000), 100)]
    monkeypatch.setattr(blocks, "BLOCK", 16)
    got = I.within(spark.createDataFrame(points, "chr_idx int, pos bigint"), spark.createDataFrame(regions, "chr_idx int, start bigint, end bigint"), ["chr_idx"], width=16)
    assert told(got) == sorted(repr(p) for p in points if any(c == p[0] and s <= p[1] <= e for c, s, e in regions))


def test_small_blocks_share_partitions():
    assert [blocks.partitions(n, 1000) for n in (0, 999, 5_001, 9_000_000, 100 << 20)] == [1, 1, 6, blocks.PARTITIONS, 100]
    assert blocks.partitions(5 << 20, blocks.BLOCK) == 5
