"""Every query against its SQL on the smallest test tables."""

import os

import duckdb
import pytest

from karyospark.plans import queries as Q

SF = "/root/testdata/sf0.001"
BIGGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    rel = db.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=key)
    assert got == want


def test_segmentation_equals_single_signals(spark):
    """The registered query, contig by contig from the ratio rows that SQL confirms."""
    from karyospark.operators import segmentation as SG

    p = Q.Params(window_size=Q.W, segment_threshold=3.0, segment_min_length=3)
    ratio = {}
    for r in Q.QUERIES["coverage_ratio"](spark, BIGGER).orderBy("start").collect():
        ratio.setdefault(r["chr_idx"], []).append((r["start"], r["coverage_ratio"]))
    want = []
    for c, rows in ratio.items():
        y = [x for _, x in rows]
        edges = [0, *SG.change_points(y, 3.0, 3, p), len(y)]
        for a, b in zip(edges, edges[1:]):
            v = sorted(y[a:b], reverse=True)[int((b - a) * 0.2) : int((b - a) * 0.8) + 1]
            want.append((c, rows[a][0], rows[b - 1][0] + Q.W - 1, pytest.approx(sum(v) / len(v)), b - a))
    got = Q.QUERIES["segmentation"](spark, BIGGER).collect()
    assert want and sorted((r["chr_idx"], r["start"], r["end"], r["ratio"], r["n_windows"]) for r in got) == sorted(want, key=lambda w: w[:2])


def test_totals_need_no_fits(spark, db, monkeypatch):
    """The totals of a period come from its segments alone: no mixture is fitted and no site joined for them."""
    from karyospark.operators import calls
    from karyospark.operators import snp

    def never(*args, **kwargs):
        raise AssertionError

    monkeypatch.setattr(calls, "allele_models", never)
    monkeypatch.setattr(snp, "segment_bags", never)
    got = Q.QUERIES["totals_of_a_period"](spark, SF).first().asDict()
    rel = db.execute(Q.ORACLE_SQL["totals_of_a_period"])
    assert got == dict(zip([d[0] for d in rel.description], rel.fetchone()))
