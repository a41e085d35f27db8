import random

import pytest
from pyspark.sql import functions as F

from karyospark.model import DUPLICATE, FIRST, MATE_UNMAPPED, PAIRED, PROPER, READS, REVERSE, SECONDARY, SUPPLEMENTARY
from karyospark.operators import coverage as C
from karyospark.operators import gc as GC
from karyospark.operators.intervals import with_offsets
from karyospark.params import Params

GOOD = PAIRED | PROPER | FIRST
P = Params(window_size=500)


@pytest.fixture(scope="module")
def contigs(spark):
    return with_offsets(spark.createDataFrame([("chr1", 0, 10_000), ("chr2", 1, 7_300), ("chr3", 2, 500)], "chr string, chr_idx int, length bigint"))


def reads(spark, *rows):
    return spark.createDataFrame([("tumor", 0, *r) for r in rows], READS)


def test_windows(contigs):
    assert [r["n_windows"] for r in C.with_windows(contigs, 500).orderBy("chr_idx").collect()] == [20, 15, 1]


def test_each_flag(spark):
    row = lambda size=300, mapq=60, flags=GOOD: (1000, 1200, size, 100, mapq, flags)
    bad = [row(-1), row(1001), row(mapq=29), row(flags=PAIRED | FIRST), row(flags=PAIRED | PROPER), *[row(flags=GOOD | f) for f in (MATE_UNMAPPED, SECONDARY, DUPLICATE, SUPPLEMENTARY)]]
    assert C.valid_fragments(reads(spark, *bad), P).count() == 0
    assert C.valid_fragments(reads(spark, row(), row(0), row(1000), row(2000, flags=SECONDARY), row(flags=GOOD | REVERSE)), P).count() == 5


def spanned(spark, contigs, *row):
    r = C.spans(reads(spark, row), contigs, P).first()
    return r["ws"], r["we"], r["fragment_length"]


def test_spans(spark, contigs):
    # the left hanger is exactly half: stays; one less: moves on
    assert spanned(spark, contigs, 250, 0, 500, 100, 60, GOOD) == (0, 1, 500)
    assert spanned(spark, contigs, 251, 0, 500, 100, 60, GOOD) == (1, 2, 500)
    # the right hanger is more than half
    assert spanned(spark, contigs, 0, 0, 751, 100, 60, GOOD) == (0, 2, 751)
    assert spanned(spark, contigs, 0, 0, 750, 100, 60, GOOD) == (0, 1, 750)
    # the last window takes no pairs
    assert spanned(spark, contigs, 9_600, 0, 400, 100, 60, GOOD)[:2] == (19, 19)
    # reversed pairs start at the mate
    assert spanned(spark, contigs, 900, 0, 1000, 100, 60, GOOD | REVERSE) == (0, 2, 1000)
    # single reads: nearest to the start, or to the end of reversed ones; clamped
    assert spanned(spark, contigs, 240, 0, 0, 100, 60, 0)[:2] == (0, 1)
    assert spanned(spark, contigs, 250, 0, 0, 100, 60, 0)[:2] == (1, 2)
    assert spanned(spark, contigs, 700, 0, 0, 100, 60, REVERSE)[:2] == (1, 2)
    assert spanned(spark, contigs, 9_990, 0, 0, 100, 60, 0)[:2] == (19, 20)


def test_running_median(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([5, 1, 9, 2, 7, 7])], "chr_idx int, win bigint, n bigint")
    got = [r["n"] for r in C.running_median(rows, ["n"]).orderBy("win").collect()]
    assert got == [5, 3, 5, 7, 7, 7]
    for block in (1, 2, 4):
        assert [r["n"] for r in C.running_median(rows, ["n"], block=block).orderBy("win").collect()] == got
    flat = spark.createDataFrame([(0, i, 4) for i in range(9)], "chr_idx int, win bigint, n bigint")
    assert {r["n"] for r in C.running_median(flat, ["n"]).collect()} == {4}


def test_unknown_ratios_count_in_the_median(spark):
    grid = spark.createDataFrame([(0, 0, 10, 10), (0, 1, 0, 10), (0, 2, 0, 10), (0, 3, 10, 10)], "chr_idx int, win bigint, tumor bigint, normal bigint")
    got = C.coverage_ratio(grid, 1.0, 1.0, P)
    assert got.count() == 0  # (1000 - 1000) / 2 and -1000 are not above 0


def test_normalize_needs_both(spark, contigs):
    with pytest.raises(ValueError):
        C.normalize(reads(spark, (0, 0, 500, 100, 60, GOOD)), contigs, P)


def test_gc(spark):
    rows = spark.createDataFrame([("a", "GCatgN"), ("b", ""), ("c", None)], "chr string, seq string")
    got = GC.gc_windows(GC.pieces(rows), (1, 5))
    assert [r["gc"] for r in got.where("window_size = 5").orderBy("start").collect()] == [3, 2, 1, 1, 1, 0]
    assert got.where("window_size = 1").agg(F.sum("gc")).first()[0] == 3
    with pytest.raises(ValueError):
        GC.gc_blocks(GC.pieces(rows), (300,))


def test_gc_by_blocks_and_pieces(spark):
    """Every cut into pieces and blocks gives the counts of the whole sequence."""
    draw = random.Random(1)
    seqs = {f"s{i}": "".join(draw.choice("ACGTacgtN") for _ in range(draw.randrange(1, 400))) for i in range(6)}
    rows = spark.createDataFrame(list(seqs.items()), "chr string, seq string")
    want = sorted((c, w, i, sum(x in "GCgc" for x in s[i : i + w])) for c, s in seqs.items() for w in (1, 5, 25, 125) for i in range(len(s)))
    for piece, block in ((1 << 20, 1 << 20), (7, 50), (130, 10), (50, 125)):
        got = GC.gc_windows(GC.pieces(rows, piece), block=block)
        assert sorted(map(tuple, got.collect())) == want


def test_sums_are_made_where_windows_are_counted(spark):
    """Sums of windows are those of the rows, over seams and letters of several bytes; no row is made for a window."""
    draw = random.Random(4)
    data = [(str(k), "".join(draw.choice("GCgcatNé中😀") for _ in range(draw.choice([1, 7, 40, 333])))) for k in range(30)]
    parts = GC.pieces(spark.createDataFrame(data, "chr string, seq string"), 50)
    gc = F.col("gc").cast("bigint")
    sums = (F.count("*").alias("n"), F.sum(gc).alias("total"), F.sum(gc * (F.col("start") + 1)).alias("by_place"), F.sum(gc * gc).alias("squares"))
    want = sorted(map(tuple, GC.gc_windows(parts, (1, 5, 25), 16).groupBy("chr", "window_size").agg(*sums).collect()))
    assert sorted(map(tuple, GC.gc_sums(parts, (1, 5, 25), 16).collect())) == want
    counts = lambda s, k: [sum(c in "GCgc" for c in s[i : i + k]) for i in range(len(s))]
    plain = [(c, k, len(s), sum(x), sum(v * (i + 1) for i, v in enumerate(x)), sum(v * v for v in x)) for c, s in data for k in (1, 5, 25) for x in [counts(s, k)]]
    assert want == sorted(plain)
