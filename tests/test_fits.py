from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyospark.operators import allele as AL
from karyospark.operators import periods as PE
from karyospark.operators import segmentation as SG
from karyospark.operators.evaluate import recall_precision
from karyospark.operators.histogram import base_level, noise_variance
from karyospark.operators.intervals import complement
from karyospark.params import Params
from karyospark.plans import simulate
from karyospark.plans import cohort as CO
from karyospark.plans.cohort import infer_cohort
from karyospark.plans.infer import infer
from plain_sample import Sample


def test_steps():
    draw = np.random.default_rng(0)
    y = np.concatenate([np.full(300, 1.0), np.full(200, 1.5), np.full(400, 0.8)])
    assert SG.change_points(y, 5, 3) == [300, 500]
    assert SG.change_points(y + draw.normal(0, 0.1, 900), 5, 3) == [300, 500]
    assert SG.change_points(np.ones(50), 5, 3) == []
    assert SG.change_points(np.array([1.0]), 5, 3) == []


def test_pivots_solve():
    draw = np.random.default_rng(1)
    d, u, low, b = draw.uniform(3, 4, 30), draw.uniform(-1, 1, 29), draw.uniform(-1, 1, 29), draw.normal(size=30)
    full = np.diag(d) + np.diag(u, 1) + np.diag(low, -1)
    x, f, g = SG.thomas(low, d, u, b)
    inverse = np.linalg.inv(full)
    assert np.allclose(x, inverse @ b) and np.allclose(1 / (f + g - d), np.diag(inverse))


def test_learning_equals_dense_algebra():
    """Sparse Bayesian learning with whole matrices: steps of unit norm, their Gram matrix, and posterior variances."""
    draw, p = np.random.default_rng(5), Params(segment_rounds=400)
    for k in range(6):
        y = np.concatenate([np.full(12, 0.0), np.full(9, 1.0 + k / 3), np.full(14, 0.4)]) + draw.normal(0, 0.1, 35)
        y -= y.mean()
        m, v = len(y), float(np.sum(0.5 * np.diff(y) ** 2) / (len(y) - 1))
        at = np.arange(1, m)
        alpha, rounds = np.zeros(m - 1), 0
        weight = np.zeros(m - 1)
        while rounds < p.segment_rounds:
            steps = np.array([np.where(np.arange(m) < i, -np.sqrt((m - i) / (m * i)), np.sqrt(i / (m * (m - i)))) for i in at]).T
            gram = steps.T @ steps
            rounds += 1
            spread = np.linalg.inv(gram / v + np.diag(alpha))
            new = spread @ steps.T @ y / v
            alpha = (1 + 2 * p.segment_a) / (new * new + np.maximum(np.diag(spread), 0) + 2 * p.segment_b)
            still = np.max(np.abs(new - weight)) < p.segment_tolerance
            weight, kept = new, alpha < p.segment_max_alpha
            if still:
                break
            if kept.sum() < 0.9 * len(kept):
                at, alpha, weight = at[kept], alpha[kept], weight[kept]
        assert SG.learn(y, v, p).tolist() == at[alpha < p.segment_max_alpha].tolist()


def test_elimination_equals_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(20):
        y = draw.normal(0, 1, 60)
        at = sorted(draw.choice(np.arange(1, 60), 12, replace=False).tolist())
        left = list(at)
        while left:
            edges = [0, *left, 60]
            keys = []
            for a, b, c in zip(edges, edges[1:], edges[2:]):
                t = abs(y[b:c].mean() - y[a:b].mean()) / np.sqrt(1 / (b - a) + 1 / (c - b))
                short = min(b - a, c - b)
                keys.append((0, t, short, b) if t < 2 else (1, short, t, b))
            k = min(keys)
            if k[0] and k[1] >= 5:
                break
            left.remove(k[3])
        assert SG.eliminate(y, np.array(at), 1.0, 2.0, 5) == left


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=2, max_size=80))
def test_breaks_are_inside_and_ordered(y):
    got = SG.change_points(np.array(y), 3, 2)
    assert got == sorted(set(got)) and all(0 < b < len(y) for b in got)


def test_segment(spark):
    rows = [(c, i * 500 + 1, 1.0 if i < 60 else 1.4) for c in (0, 1) for i in range(100)]
    got = SG.segment(spark.createDataFrame(rows, "chr_idx int, start bigint, coverage_ratio double"), Params(segment_min_length=5)).orderBy("chr_idx", "start").collect()
    assert [(r["chr_idx"], r["start"], r["end"], r["n_windows"]) for r in got] == [(c, *x) for c in (0, 1) for x in ((1, 30_000, 60), (30_001, 50_000, 40))]
    assert SG.segment(spark.createDataFrame([], "chr_idx int, start bigint, coverage_ratio double")).count() == 0


def test_mixture_finds_the_split():
    draw = np.random.default_rng(3)
    for minor, major in ((1, 1), (0, 2), (1, 2)):
        mu = AL.expected_log_odds(minor, major, 0.8, 80) if minor != major else 0.0
        x = np.concatenate([draw.normal(-mu, 0.2, 200), draw.normal(mu, 0.2, 200)])
        best = next(m for m in AL.select(x, minor + major, 0.8, 80) if m["selected"])
        assert (best["minor"], best["major"]) == (minor, major)
    with pytest.raises(ValueError):
        AL.select(np.ones(10), 2, 0.8, 80)


def test_many_fits_equal_a_plain_loop():
    draw = np.random.default_rng(4)
    samples = [draw.normal(draw.uniform(-0.5, 0.5), draw.uniform(0.6, 1), draw.integers(6, 60)) for _ in range(30)]
    mus = draw.uniform(0.3, 1.0, 30)
    got = AL.mixtures(*AL.padded(samples), mus)
    for i, (x, mu) in enumerate(zip(samples, mus)):
        a, v = (x.mean() - x.min()) / (x.max() - x.min()), x.var()
        for _ in range(AL.ROUNDS):
            p, q = a * np.exp(-((x + mu) ** 2) / (2 * v)), (1 - a) * np.exp(-((x - mu) ** 2) / (2 * v))
            w = p / (p + q)
            b, u = w.mean(), (w * (x + mu) ** 2 + (1 - w) * (x - mu) ** 2).mean()
            stop = abs((a - b) / a) < AL.TOLERANCE and abs((v - u) / v) < AL.TOLERANCE
            a, v = b, u
            if stop:
                break
        assert got[0][i] == pytest.approx(a, rel=1e-6, abs=1e-12) and got[1][i] == pytest.approx(v, rel=1e-6)
        assert got[2][i] or got[0][i] == 0  # a weight that goes to nothing never stands still
        logl = np.log(a * np.exp(-((x + mu) ** 2) / (2 * v)) + (1 - a) * np.exp(-((x - mu) ** 2) / (2 * v))).sum() - len(x) * 0.5 * np.log(2 * np.pi * v)
        assert got[3][i] == pytest.approx(logl, rel=1e-6)


def test_expected_log_odds_is_the_double_sum():
    p, depth, lo, hi = 0.6, 20.0, 1, 3
    scale = depth / (4 * p + 2 * (1 - p))
    a, b = AL.truncated_poisson((lo * p + 1 - p) * scale), AL.truncated_poisson((hi * p + 1 - p) * scale)
    total = sum(x * y * np.log((i + 1) / (j + 1)) for i, x in enumerate(a) for j, y in enumerate(b))
    assert AL.expected_log_odds(lo, hi, p, depth) == pytest.approx(total / (a.sum() * b.sum()))


def test_purity_and_period():
    purity, ploidy = PE.purity_ploidy(330, 970)
    assert purity == pytest.approx(2 * 330 / 970) and ploidy == pytest.approx(2 + 30 / 330)
    assert [PE.clamped_purity(x) for x in (1.05, -0.05, 0.5, 1.2, -0.2)] == [0.99, 0.03, 0.5, None, None]
    lag = np.arange(1001)
    acf = 1e6 * np.exp(-lag / 400) * (1.2 + np.cos(2 * np.pi * lag / 300))
    assert abs(PE.candidate_by_draw_up(acf).period - 300) < 25
    assert PE.candidate_by_draw_up(np.linspace(10, 1, 1001)) == PE.TOO_NOISY
    assert PE.local_maxima(np.sin(np.arange(100) / 5))[0] == 8


def calls_of(rows, *names):
    near = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(tuple((near(r[n]) is None, near(r[n]) or 0) for n in names) for r in rows)


CALL = ("chr_idx", "start", "end", "cp", "major_allele_cp", "copy_no_float", "is_clonal", "cumu_start", "cumu_end")


@pytest.mark.parametrize("strict,auto", [(False, True), (True, True), (False, False)])
def test_samples_side_by_side_equal_single_runs(spark, strict, auto):
    """Every sample of a cohort has the calls of its own run, and both ways sum the same numbers."""
    p = Params(stddev_divider=10.0, bin_width=1_000_000)
    segs, snps, alone = [], [], {}
    for k, purity in enumerate((0.4, 0.6, 0.9)):
        contigs, a, b, _ = simulate.genome(spark, purity, n_contigs=4, seed=k)
        one = infer(a, b, contigs, p, strict, auto)
        alone[f"s{k}"] = (one.status, one.best and (one.best.period, round(one.best.purity, 9), round(one.best.logl, 3)), calls_of(one.calls.collect(), *CALL) if one.calls else [])
        segs.append(a.withColumn("subject", F.lit(f"s{k}")))
        snps.append(b.withColumn("subject", F.lit(f"s{k}")))
    empty = spark.createDataFrame([(0, 1, 9, 0.05, 5.0, 1, "none")], "chr_idx int, start bigint, end bigint, ratio double, stddev double, n_windows bigint, subject string")
    got = infer_cohort(reduce(DataFrame.unionByName, [*segs, empty]), reduce(DataFrame.unionByName, snps), contigs, p, strict=strict, auto=auto).collect()
    assert {r["subject"] for r in got} == {"s0", "s1", "s2", "none"}
    assert [r["chr_idx"] for r in got if r["subject"] == "none"] == [None]
    for s, (status, best, calls) in alone.items():
        own = [r for r in got if r["subject"] == s]
        assert {r["status"] for r in own} == {status}
        if best:
            assert {(r["period"], round(r["purity"], 9), round(r["logl"], 3)) for r in own} == {best} and calls_of(own, *CALL) == calls


@pytest.mark.parametrize("few", [True, False])
def test_many_subjects_equal_plain_runs(spark, monkeypatch, few):
    """The registered query, each subject against arrays, with hypotheses broadcast and dealt over salts."""
    from karyospark.plans import queries as Q

    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(CO, "BROADCAST_SAMPLES", 20_000 if few else 0)
    rows = Q.QUERIES["cohort_calls"](spark, sf).collect()
    segs, sites = Q.A.profile_segments(spark, sf).toPandas(), Q.snps(spark, sf).toPandas()
    assert segs["subject"].nunique() >= 6
    fits = 0
    for subject, part in segs.groupby("subject"):
        own = Sample.of(part, sites[sites["pos"] // Q.A.SUBJECT_KEYS == subject], Q.PIPELINE_PARAMS, AL.NO_FIT)
        status, best, _ = own.period(True)
        got = [r for r in rows if r["subject"] == subject]
        assert {r["status"] for r in got} == {status}
        if best is None:
            assert [(r["purity"], r["chr_idx"]) for r in got] == [(None, None)]
            continue
        fits += 1
        assert {(r["period"], r["first_peak"], round(r["purity"], 9), round(r["logl"], 2)) for r in got} == {(best.period, best.first, round(best.purity, 9), round(best.logl, 2))}
        want = [(*own.rows.loc[i, ["chr_idx", "start", "end"]], cp, major, x, clonal) for i, cp, major, x, clonal in own.calls(best, False)]
        assert len(want) == len(got)
        key = lambda t: tuple((v is None, round(float(v or 0), 6)) for v in t)
        assert sorted(map(key, want)) == sorted(key([r[c] for c in CALL[:7]]) for r in got)
    assert fits >= 5


def test_forced_periods_and_samples_without_any(spark):
    """Hypotheses of a made table: the forced ordinal wins where a sample has it, few sites and bad purities don't."""
    from dataclasses import replace

    told = spark.createDataFrame(
        [("a", "ok", 1, 100, 0.5, -10.0), ("a", "ok", 2, 200, 0.6, -20.0), ("b", "ok", 1, 100, 0.5, -10.0), ("c", "ok", 1, 100, -1.0, -1.0), ("d", "no period", None, None, None, None), ("e", "ok", 1, 100, 0.5, -1.0), ("f", "ok", 1, 100, 0.5, -1.0), ("f", "ok", 2, 50, 0.5, -1.0)],
        "subject string, search string, candidate int, period int, purity double, logl_rc double",
    )
    told = told.withColumns({"first_peak": F.lit(1), "copies_before": F.lit(0), "ploidy": F.lit(2.0), "n_parameters": F.lit(0), "peaks": F.lit(None).cast(CO.PEAKS)})
    sites = spark.createDataFrame([("a", 1, -1.0, 50), ("a", 2, -1.0, 50), ("b", 1, -1.0, 50), ("c", 1, -1.0, 50), ("e", 1, -1.0, 5), ("f", 1, 0.0, 6), ("f", 2, 0.0, 6)], "subject string, candidate int, logl double, n_snps bigint")
    for force, a in ((0, 100), (1, 100), (2, 200)):
        got = {r["subject"]: (r["status"], r["period"]) for r in CO.best_hypotheses(told, sites, replace(Params(), force_period=force), "subject").collect()}
        assert got == {"a": ("ok", a), "b": ("ok", 100), "c": ("no period fits", None), "d": ("no period", None), "e": ("no period fits", None), "f": ("ok", 50 if force == 2 else 100)}


def test_tables_equal_a_plain_run(spark):
    """The registered query over whole tables, against arrays of one sample."""
    from karyospark.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    rows = Q.QUERIES["copy_number_pipeline"](spark, sf).collect()
    segs = Q.A.profile_segments(spark, sf).toPandas()
    own = Sample.of(segs, Q.snps(spark, sf).toPandas(), Q.PIPELINE_PARAMS, AL.NO_FIT)
    status, best, _ = own.period(True)
    assert status == "ok" and abs(best.purity - 0.7) < 0.05 and {(r["status"], round(r["purity"], 9), r["period"]) for r in rows} == {(status, round(best.purity, 9), best.period)}
    want = [(*own.rows.loc[i, ["chr_idx", "start", "end"]], cp, major, round(x, 4), clonal) for i, cp, major, x, clonal in own.calls(best, False)]
    assert calls_of(rows, *CALL[:7]) == sorted(tuple((v is None, (round(v, 6) if isinstance(v, float) else v) or 0) for v in w) for w in want)


def test_allele_models_equal_single_fits(spark):
    """The registered query against one fit at a time; sites that don't vary have no model."""
    from karyospark.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    sites = [tuple(r) for r in Q.snps(spark, sf).select("chr_idx", "pos", "log_or", "coverage").collect()]
    got = {(r["chr_idx"], r["start"]): r for r in Q.QUERIES["allele_model"](spark, sf).collect()}
    assert len(got) > 100
    for (c, start), r in sorted(got.items())[::20]:
        x = sorted(v for k, pos, v, _ in sites if k == c and start <= pos <= r["end"])
        depth = float(np.median([d for k, pos, _, d in sites if k == c and start <= pos <= r["end"]]))
        best = next(m for m in AL.select(x, r["cp"], 0.7, depth) if m["selected"])
        assert (r["major_allele_cp"], r["logl"]) == (max(best["minor"], best["major"]), pytest.approx(best["logl"], rel=1e-6))
    flat = spark.createDataFrame([(0, 1, 9, 2, 30.0, [0.5] * 12), (0, 11, 19, 2, 30.0, [0.1, 0.5, -0.3])], "chr_idx int, start bigint, end bigint, cp int, coverage double, log_or array<double>")
    models = AL.allele_models(flat, 0.7, AL.NO_FIT).orderBy("start").collect()
    assert models[0]["models"] is None and models[0]["logl"] is None and models[1]["major_allele_cp"] is not None
    with pytest.raises(Exception, match="variance"):
        AL.allele_models(flat, 0.7).collect()


def test_samples_are_segmented_apart(spark):
    """Two samples in one run give what two runs give."""
    draw = np.random.default_rng(6)
    rows = [(s, c, i * 500 + 1, float((1.0 if i < 60 + 10 * k else 1.4) + draw.normal(0, 0.02))) for k, s in enumerate("ab") for c in (0, 1) for i in range(120)]
    ratio = spark.createDataFrame(rows, "subject string, chr_idx int, start bigint, coverage_ratio double")
    p, keys = Params(segment_min_length=5, segment_threshold=5.0), ("subject", "chr_idx")
    contigs = spark.createDataFrame([("chr1", 0, 70_000), ("chr2", 1, 90_000), ("chr3", 2, 5)], "chr string, chr_idx int, length bigint")

    def run(rows, keys):
        segs = SG.segment(rows, p, keys=keys)
        base = base_level(segs, keys)
        gaps = complement(segs, contigs, keys)
        states = SG.collapse(segs, base, 0.0004, keys=keys)
        noise = noise_variance(rows, "coverage_ratio", keys, "start")
        return [sorted(map(tuple, x.select(*[c for c in x.columns if c != "subject"]).collect())) for x in (segs, base, gaps, states, noise)]

    both = run(ratio, keys)
    single = [run(ratio.where(F.col("subject") == s).drop("subject"), ("chr_idx",)) for s in "ab"]
    assert both == [sorted(a + b) for a, b in zip(*single)]


@pytest.mark.parametrize("purity", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
def test_known_genome(spark, purity):
    # at the least purity sites as dense as in the published simulation, 1.8 million of a genome; else 20 times fewer
    got, truth = simulate.demo(spark, purity, snps_per_segment=1250 if purity < 0.2 else 60)
    assert got.status == "ok"
    assert abs(got.best.purity - purity) <= 0.05
    want = truth.agg({"cp": "avg"}).first()[0]
    assert abs(got.best.ploidy - want) <= 0.2
    truth = truth.where("not (cp = 2 and major = 1)")
    assert min(recall_precision(truth, simulate.predicted(got.calls)).first()) >= 0.7
    assert got.totals.first()["ploidy_cnv_all"] == pytest.approx(want, abs=0.05)


def test_simulated_ploidy(spark):
    # sums of altered bases by their weights
    rows = [(0, 867_020_000, 2, 0.8), (0, 747_020_000, 2, 0.2)]
    got = simulate.simulated_ploidy(spark.createDataFrame(rows, "start bigint, end bigint, copy_number int, proportion double")).first()
    assert got["altered"] == pytest.approx(843_020_000) and got["ploidy"] == pytest.approx(2.29261029509674)


def test_traces_are_those_of_plain_loops(spark):
    """Every round's weight, variance and likelihood of 30 segments, each split fitted alone by its definition."""
    draw = np.random.default_rng(5)
    rows = [(0, i, i + 1, 2 + i % 4, 30.0, (draw.choice([-0.8, 0.8], 12 + i) + draw.normal(0, 0.4, 12 + i)).tolist()) for i in range(30)]
    odd = [(1, 1, 2, None, 30.0, [0.1, 0.2]), (1, 2, 3, 3, 30.0, None), (1, 3, 4, -1, 30.0, [0.1, 0.2]), (1, 4, 5, 3, 30.0, [])]
    segments = spark.createDataFrame(rows + odd, "chr_idx int, start bigint, end bigint, cp int, coverage double, log_or array<double>")
    got = {}
    for r in AL.allele_traces(segments, 0.7).orderBy("chr_idx", "start", "minor", "round").collect():
        got.setdefault((r["chr_idx"], r["start"], r["minor"], r["major"]), []).append((r["alpha"], r["var"], r["logl"]))
        assert r["round"] == len(got[r["chr_idx"], r["start"], r["minor"], r["major"]])
    assert set(got) == {(0, i, lo, cp - lo) for _, i, _, cp, _, _ in rows for lo in range((cp + 1) // 2)}
    normal = lambda x, m, v: np.exp(-((x - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)
    for (_, i, lo, hi), steps in got.items():
        x, mu = np.array(rows[i][5]), AL.expected_log_odds(lo, hi, 0.7, 30.0)
        a, v = (x.mean() - x.min()) / (x.max() - x.min()), x.var()
        for alpha, var, logl in steps:
            one, two = a * normal(x, -mu, v), (1 - a) * normal(x, mu, v)
            post = one / (one + two)
            a, v = min(1.0, post.mean()), (post * (x + mu) ** 2 + (1 - post) * (x - mu) ** 2).mean()
            assert (alpha, var) == pytest.approx((a, v), rel=1e-6)
            assert logl == pytest.approx(np.log(a * normal(x, -mu, v) + (1 - a) * normal(x, mu, v)).sum(), rel=1e-6)
