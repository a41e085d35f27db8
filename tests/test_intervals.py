import random

import pytest
from pyspark.sql import functions as F

from karyospark.operators import intervals as I
from karyospark.operators.evaluate import recall_precision, recall_precision_of_runs


def frame(spark, rows, names="chr_idx int, start bigint, end bigint"):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_joins_equal_nested_loops(spark, width):
    draw = random.Random(width)
    some = lambda n: [(draw.randrange(2), s := draw.randrange(200), s + draw.randrange(40)) for _ in range(n)]
    a, b = list(set(some(40))), list(set(some(40)))
    points = [(draw.randrange(2), draw.randrange(240)) for _ in range(60)]
    got = I.interval_join(frame(spark, points, "chr_idx int, pos bigint"), frame(spark, a), ["chr_idx"], width=width)
    assert sorted(map(tuple, got.collect())) == sorted((c, p, s, e) for c, p in points for k, s, e in a if c == k and s <= p <= e)
    got = I.overlap_join(frame(spark, a), frame(spark, b), ["chr_idx"], width=width).select("chr_idx", "l_start", "l_end", "r_start", "r_end")
    assert sorted(map(tuple, got.collect())) == sorted((c, s, e, u, v) for c, s, e in a for k, u, v in b if c == k and max(s, u) <= min(e, v))


def test_ends_are_inclusive(spark):
    got = I.interval_join(frame(spark, [(0, 9), (0, 10), (0, 20), (0, 21)], "chr_idx int, pos bigint"), frame(spark, [(0, 10, 20)]), ["chr_idx"], width=6, how="left")
    assert sorted((r["pos"], r["start"]) for r in got.collect()) == [(9, None), (10, 10), (20, 10), (21, None)]


def test_complement_tiles(spark):
    contigs = spark.createDataFrame([("chr1", 0, 100), ("chr2", 1, 50)], "chr string, chr_idx int, length bigint")
    segs = frame(spark, [(0, 10, 20), (0, 15, 30), (0, 31, 40), (0, 60, 100)])
    gaps = sorted(map(tuple, I.complement(segs, contigs).collect()))
    assert gaps == [(0, 1, 9), (0, 41, 59), (1, 1, 50)]
    full = I.fill(segs.selectExpr("*", "3 cp", "2 major"), contigs)
    assert full.where("cp = 2 and major = 1").count() == 3
    assert [r["cum_offset"] for r in I.with_offsets(contigs).orderBy("chr_idx").collect()] == [0, 100]


def test_evaluator(spark):
    names = "chr_id int, start bigint, end bigint, cp double, major double, is_clonal boolean"
    truth = spark.createDataFrame([(1, 1, 100, 3.0, 2.0, True), (2, 1, 50, 1.0, 1.0, True)], names)
    assert recall_precision(truth, truth).first() == (1.0, 1.0, 1.0, 1.0)
    far = spark.createDataFrame([(3, 1, 100, 3.0, None, False)], names)
    got = recall_precision(truth, far).first()
    assert got["cp_recall"] == 0 and got["mcp_precision"] is None
    neutral = spark.createDataFrame([(1, 100, 100, 2.0, 1.0, True), (2, 50, 60, 1.0, 1.0, True)], names)
    got = recall_precision(truth, neutral).first()
    assert got["cp_recall"] == pytest.approx(1 / 150) and got["cp_precision"] == pytest.approx(1 / 11)
    none = recall_precision(truth.limit(0), truth.limit(0)).first()
    assert list(none) == [None] * 4


@pytest.mark.parametrize("width", [50, 1000])
def test_runs_swept_together_equal_each_alone(spark, width):
    """Runs with overlapping rows, nulls, repeated rows, and with one side only."""
    draw = random.Random(width)
    names = "run string, chr_id int, start bigint, end bigint, cp double, major double, is_clonal boolean"
    shares = ["cp_recall", "cp_precision", "mcp_recall", "mcp_precision"]
    some = lambda runs: [(draw.choice(runs), draw.randrange(2), s := draw.randrange(600), s + draw.randrange(150), draw.choice([1.0, 2.0, 2.3, 3.0, None]), draw.choice([1.0, 2.0, None]), draw.random() < 0.7) for _ in range(150)]
    truth, pred = some(["a", "b", None, "t"]), some(["a", "b", None, "p"])
    truth, pred = truth + truth[:9] + [("a", 0, None, 5, 1.0, 1.0, True)], pred + pred[:9]
    got = {r["run"]: [r[c] for c in shares] for r in recall_precision_of_runs(frame(spark, truth, names), frame(spark, pred, names), width=width).collect()}
    assert set(got) == {"a", "b", None, "t", "p"}
    for run, found in got.items():
        one, two = [frame(spark, [x for x in rows if x[0] == run and x[2] is not None], names) for rows in (truth, pred)]
        alone = recall_precision(one, two, 100).first()
        assert found == [None if alone[c] is None else pytest.approx(alone[c], rel=1e-9) for c in shares]
    empty = frame(spark, [], names)
    assert recall_precision_of_runs(empty, empty).count() == 0


def test_intervals_at_home_equal_nested_loops(spark):
    """Each interval with its points, equal ones once, in one row a pair and one of nulls for none; grouping them shuffles nothing more."""
    draw = random.Random(5)
    points = [(draw.randrange(2), draw.randrange(3_000)) for _ in range(300)]
    spans = [(draw.randrange(3), s, s + draw.choice([-1, 0, 7, 15, 16, 200, 2_000]), k % 4) for k, s in enumerate(draw.choices(range(3_000), k=120))] * 2
    a = spark.createDataFrame(points, "chr_idx int, pos bigint")
    b = spark.createDataFrame(spans, "chr_idx int, start bigint, end bigint, kind int")
    joined = I.homed_join(a, b, ["chr_idx"], width=16)
    sums = joined.groupBy("chr_idx", "_level", "_home", "start", "end").agg(F.first("_same").alias("x"), F.count("pos").alias("n"), F.sum("pos").alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = joined.groupBy("chr_idx", "_level", "_home", "start", "end").count()._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["chr_idx"], r["start"], r["end"], sorted(x["kind"] for x in r["x"]), r["n"], r["s"] or 0) for r in sums.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for c, s, e in {x[:3] for x in spans}:
        own = [p for k, p in points if k == c and s <= p <= e]
        want.append((c, s, e, sorted(x[3] for x in spans if x[:3] == (c, s, e)), len(own), sum(own)))
    assert got == sorted(want)
    assert plan.count("Exchange hashpartitioning") == 3  # the intervals, the points, and the levels' few rows


def test_sums_within_send_each_point_once(spark):
    """Sums equal those over the pairs, with odd rows; a point goes to one place, whatever lengths intervals have."""
    draw = random.Random(8)
    points = [(draw.choice([0, 1, None]), draw.choice([None, *range(-40, 400)]), draw.choice([None, 1, 5, 70])) for _ in range(400)]
    spans = [(i % 90, draw.choice([0, 1, 2, None]), x, x + draw.choice([-3, 0, 1, 20, 300, 5000])) for i in range(120) for x in [draw.randrange(-60, 500)]]
    a, b = frame(spark, points, "chr_idx int, pos bigint, part bigint"), frame(spark, spans, "id bigint, chr_idx int, start bigint, end bigint")
    want = I.interval_join(a, b, ["chr_idx"], width=4).groupBy("id").agg(F.count("*").alias("n"), F.sum("part").alias("total"))
    for block in (1, 7, 1 << 16):
        assert sorted(map(tuple, I.sums_within(a, b, ["chr_idx"], "id", "part", block=block).collect())) == sorted(map(tuple, want.collect()))
    assert "Generate explode" not in I.sums_within(a, b, ["chr_idx"], "id", "part")._jdf.queryExecution().toString()
