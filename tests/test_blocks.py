"""Blocked correlations against pairs of plain arrays."""

import numpy as np
import pytest

from tickloom.operators import blocks


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(23):
        for day in range(0, 90):
            if rng.random() < 0.6:
                rows.append((f"f{k:02d}", day, 0.01 if k == 4 else float(round(rng.normal(0, 0.02), 3))))
    rows += [("solo", 500, 0.1), ("two", 500, 0.2), ("none", 3, None)]
    return rows, spark.createDataFrame(rows, "code string, date int, ret double")


def pairs(rows):
    by = {}
    for c, d, r in rows:
        if r is not None:
            by.setdefault(c, {})[d] = r
    for a in by:
        for b in by:
            days = sorted(by[a].keys() & by[b].keys())
            if a < b and days:
                yield a, b, np.array([by[a][d] for d in days]), np.array([by[b][d] for d in days])


def corr(x, y):
    return None if x.min() == x.max() or y.min() == y.max() else float(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize("codes", [4, 256])
def test_pairwise(returns, codes, monkeypatch):
    rows, df = returns
    got = {(r.a, r.b): (r.corr, r.n) for r in blocks.pairwise_corr(df, codes=codes).collect()}
    want = {(a, b): (corr(x, y), len(x)) for a, b, x, y in pairs(rows)}
    assert got.keys() == want.keys()
    for k, (c, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if c is None else got[k][0] == pytest.approx(c, abs=1e-9))
    high = {(r.a, r.b) for r in blocks.pairwise_corr(df, 0.1, codes).collect()}
    assert high == {k for k, (c, _) in want.items() if c is not None and c > 0.1}


@pytest.mark.parametrize("codes", [4, 256])
def test_downside(returns, codes):
    rows, df = returns
    got = {(r.a, r.b): (r.downside, r.n) for r in blocks.downside_corr(df, 0.2, codes=codes).collect()}
    want = {}
    for a, b, x, y in pairs(rows):
        take = min(len(x), max(int(len(x) * 0.2), 5))
        worst = sorted(range(len(x)), key=lambda k: ((x[k] + y[k]) / 2, k))[:take]
        c = corr(x[worst], y[worst])
        want[a, b] = 0.5 if c is None else c, take
    assert got.keys() == want.keys() and all(got[k][1] == n and got[k][0] == pytest.approx(c, abs=1e-9) for k, (c, n) in want.items())


def test_no_date_meets_by_join(returns):
    _, df = returns
    plan = blocks.pairwise_corr(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "date#" not in plan.split("Join Inner")[0]


def test_empty(returns):
    _, df = returns
    assert blocks.pairwise_corr(df.filter("false")).collect() == []
