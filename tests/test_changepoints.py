"""Change points learnt in blocks are those of the undivided fit, and long contigs give the segments that short ones do."""

import numpy as np
import pandas as pd
import pytest

from karyospark.operators import changepoints as CP
from karyospark.operators import segmentation as SG
from karyospark.params import Params


def signal(m, seed, jumps=8, noise=0.15):
    draw = np.random.default_rng(seed)
    at = np.sort(draw.choice(np.arange(1, m), jumps, replace=False))
    return np.repeat(draw.choice([0.5, 1, 1.5, 2], jumps + 1), np.diff(np.concatenate(([0], at, [m])))) + draw.normal(0, noise, m)


def test_blocks_learn_what_the_whole_learns(spark):
    """30 signals in 64 blocks each, with breakpoints next to seams, a constant signal, and one of two values."""
    p, m, size = Params(segment_threshold=6.0, segment_min_length=10), 2560, 40
    signals = {k: signal(m, k) for k in range(30)}
    for k in (0, 1, 2):  # jumps on the seam, and one window to either side of it
        signals[k][10 * size + k - 1 :] += 2
    signals |= {30: np.ones(m), 31: np.array([1.0, 3.0])}
    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"sample": k, "_i": np.arange(len(y)), "y": y}) for k, y in signals.items()]))
    got = {}
    for r in CP.long_change_points(rows, ("sample",), p, size, 1500).collect():
        got.setdefault(r["sample"], []).append(r["at"])
    for k, y in signals.items():
        assert sorted(got.get(k, [])) == SG.change_points(y, p.segment_threshold, p.segment_min_length, p), k
    assert sum(map(len, got.values())) > 60


def test_a_round_in_blocks_is_the_round_of_the_whole():
    """Pivots, unknowns and variances of a round in any blocks, some of them empty, are those of the undivided system."""
    p, draw = Params(), np.random.default_rng(3)
    m, v = 400.0, 0.3
    at = np.sort(draw.choice(np.arange(1, 400), 60, replace=False)).astype(np.int64)
    alpha, weight, z = draw.uniform(0, 50, 60), draw.normal(size=60), draw.normal(size=60)
    nothing = dict(l_at=0.0, l_alpha=0.0, l_z=0.0, r_at=m, r_alpha=0.0, r_z=0.0, pivot=1.0, rhs=0.0, back=1.0, next=0.0)
    want = CP.advance(at, alpha, weight, z, nothing, m, v, p)
    for cuts in ([0, 60], [0, 1, 2, 30, 30, 59, 60], [0, 0, 17, 60, 60], list(range(61))):
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        told = pd.DataFrame([{"block": i} | CP.summary(at[s], alpha[s], z[s], p) for i, s in enumerate(parts)])
        near = CP.neighbours(told, m, False)
        ends = pd.DataFrame([dict(zip(CP.TOLD[-6:], CP.corners(at[s], alpha[s], z[s], n, m, v))) for s, n in zip(parts, near)])
        heard = CP.joined(pd.concat([told, ends], axis=1), m, v)
        got = [CP.advance(at[s], alpha[s], weight[s], z[s], h, m, v, p) for s, h in zip(parts, heard) if s.stop > s.start]
        assert np.allclose(np.concatenate([g[0] for g in got]), want[0], rtol=1e-9)
        assert np.allclose(np.concatenate([g[1] for g in got]), want[1], rtol=1e-9)
        assert max(g[2] for g in got) == pytest.approx(want[2], rel=1e-9)


def test_long_contigs_give_the_segments_of_short_ones(spark):
    p = Params(window_size=10, segment_threshold=6.0, segment_min_length=10)
    data = [(c, i * 10, float(y)) for c, n in ((1, 1500), (2, 30), (3, 1)) for i, y in enumerate(signal(n, c, jumps=min(4, n - 1)))] + [(1, 99, None)]
    rows = spark.createDataFrame(data, "chr_idx int, start bigint, coverage_ratio double")
    told = lambda df: sorted((r["chr_idx"], r["start"], r["end"], round(r["ratio"], 9), round(r["stddev"], 9), r["n_windows"]) for r in df.collect())
    assert told(SG.segment(rows, p, long=100, block=64, finish=200)) == told(SG.segment(rows, p))


def test_rounds_end_where_more_survive_than_finish(spark, monkeypatch):
    """Breakpoints that no round drops any more don't cost a job for each round until they stand still."""
    p, m, seen = Params(segment_threshold=6.0, segment_min_length=10), 640, []
    signals = {k: signal(m, k) for k in range(3)}
    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"sample": k, "_i": np.arange(m), "y": y}) for k, y in signals.items()]))
    run = CP.Learning.run

    def watched(self, finish):
        for states, rounds in run(self, finish):
            seen.append(rounds)
            yield states, rounds

    monkeypatch.setattr(CP.Learning, "run", watched)
    got = {}
    for r in CP.long_change_points(rows, ("sample",), p, 160, 0).collect():
        got.setdefault(r["sample"], []).append(r["at"])
    assert {k: sorted(x) for k, x in got.items()} == {k: SG.change_points(y, p.segment_threshold, p.segment_min_length, p) for k, y in signals.items()}
    assert seen and max(seen) <= CP.WAIT
