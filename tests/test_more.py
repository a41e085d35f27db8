import math
import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from karyospark.functions import stats
from karyospark.operators import segmentation as SG
from karyospark.operators.histogram import density, median_mad, trimmed, usable_segments
from karyospark.params import Params


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_statistics(spark):
    assert value(spark, stats.log_gamma(F.lit(7.5))) == pytest.approx(math.lgamma(7.5), abs=1e-6)
    assert value(spark, stats.choose(F.lit(10), F.lit(3))) == pytest.approx(120, rel=1e-4)
    assert value(spark, stats.binomial_max(F.lit(2), 0.5)) == pytest.approx(0.75, rel=1e-2)
    assert value(spark, stats.binomial_max(F.lit(0), 0.5)) == 0
    p, r = stats.negative_binomial_parameters(F.lit(4.0), F.lit(6.0))
    total = sum(value(spark, stats.negative_binomial(p, r, F.lit(float(k)))) for k in range(30))
    assert total == pytest.approx(1, abs=1e-3)


def test_kernel_mass(spark):
    segs = spark.createDataFrame([(0, 1, 500, 1.0, 0.2, 100)], "chr_idx int, start bigint, end bigint, ratio double, stddev double, n_windows bigint")
    p = Params(stddev_divider=10.0)
    assert density(usable_segments(segs, p), p).agg(F.sum("density")).first()[0] == pytest.approx(0.954 * 100, rel=0.01)


def test_noisy_segments_go(spark):
    rows = [(0, 1, 9, 0.2, 5.0, 1), (0, 1, 9, 0.05, 5.0, 1), (0, 1, 9, 101.0, 1.0, 1), (0, 1, 9, 1.0, 0.0, 1)]
    segs = spark.createDataFrame(rows, "chr_idx int, start bigint, end bigint, ratio double, stddev double, n_windows bigint")
    assert [r["ratio"] for r in usable_segments(segs, Params(stddev_divider=10.0)).collect()] == [0.05]


def test_robust(spark):
    rows = spark.createDataFrame([(0, float(x)) for x in (1, 2, 3, 4, 100)], "k int, v double")
    assert tuple(median_mad(rows, "v", "k").first())[1:] == (3.0, 1.0) and tuple(median_mad(rows, "v").first()) == (3.0, 1.0)
    got = trimmed(rows, "v", "k").first()
    assert (got["mean"], got["n_used"]) == (2.5, 4)  # of 5 values places 1 to 4, largest first


def test_collapse_and_fitted(spark):
    names = "chr_idx int, start bigint, end bigint, ratio double, n_windows bigint"
    segs = spark.createDataFrame([(0, 1, 10, 1.01, 10), (0, 11, 12, 1.02, 2), (0, 13, 30, 3.0, 18), (0, 31, 31, 1.01, 1), (0, 32, 50, 0.2, 19)], names)
    base = spark.createDataFrame([(0, 1.0)], "chr_idx int, base_level double")
    got = [(r["level"], r["state"]) for r in SG.collapse(segs, base, 0.01).orderBy("start").collect()]
    assert got == [(1.0, "neutral"), (1.0, "neutral"), (3.0, "gain"), (1.01, "gain"), (0.2, "loss")]
    ratio = spark.createDataFrame([(0, 5, 0.9), (0, 13, 2.9)], "chr_idx int, start bigint, coverage_ratio double")
    assert [r["fitted"] for r in SG.fitted(ratio, segs).orderBy("start").collect()] == [1.01, 3.0]
    flat = spark.createDataFrame([(0, 1, 10, math.log2(1.5), 10_000), (0, 11, 20, -1.0, 10_000), (0, 21, 22, 0.1, 1)], names)
    zero = spark.createDataFrame([(0, 0.0)], "chr_idx int, base_level double")
    assert [r["copies"] for r in SG.integer_states(flat, zero, 0.01).orderBy("start").collect()] == [3, 1, 2]


def test_workflow_goes_on_from_a_stage(spark, tmp_path):
    from karyospark import adapters as A
    from karyospark.plans.pipeline import Workflow

    p = Params(window_size=40_000, max_fragment=40_000, max_coverage=100.0, segment_threshold=3.0, segment_min_length=3, stddev_divider=10.0, snp_min_depth=4, snp_max_depth=80)
    flow = Workflow(spark, str(tmp_path), p)
    reads, calls, contigs = A.reads(spark, "/root/testdata/sf0.01"), A.calls(spark, "/root/testdata/sf0.001"), A.read_contigs(spark)
    first = flow.run(reads, calls, contigs)
    again = flow.run(reads.limit(0), calls.limit(0), contigs, start_from="infer")
    assert first.status == again.status and first.usable.count() == again.usable.count() > 0
    assert flow.made == []
    small = Workflow(spark, str(tmp_path), replace(p, segment_threshold=4.0))
    small.run(reads, calls, contigs, start_from="infer")
    assert small.made == ["segment"]
    wide = Workflow(spark, str(tmp_path), replace(p, window_size=80_000))
    wide.run(reads, calls, contigs, start_from="infer")
    assert wide.made == ["normalize", "segment"] and wide.finished("het_snps") == flow.mark("het_snps")
    # changed input files are seen, and so is a stage that a broken run left without its entry
    file = tmp_path / "sites.vcf"
    for text, made in (("a", ["het_snps"]), ("a", []), ("ab", ["het_snps"])):
        if not file.exists() or file.read_text() != text:
            file.write_text(text)
        wide.sources = {"het_snps": [str(file)]}
        wide.run(reads, calls, contigs, start_from="infer")
        assert wide.made == made
    shutil.rmtree(tmp_path / "ledger" / "normalize")
    wide.run(reads, calls, contigs, start_from="infer")
    assert wide.made == ["normalize", "segment"]
