"""Operators against plain loops on small frames, and their treatment of NULL and short series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import folds
from tickloom.functions.series import Series
from tickloom.operators import combos, funds, joins, trades

S = Series()


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(1)
    rows = []
    for code in "abc":
        p = 10.0
        for t in range({"a": 80, "b": 45, "c": 1}[code]):
            p = max(1.0, round(p * (1 + rng.uniform(-0.05, 0.05)), 2))
            rows.append((code, t, p, round(p * 1.02, 2), round(p * 0.98, 2), round(p * rng.uniform(0.98, 1.02), 2), rng.random() < 0.2))
    return spark.createDataFrame(rows, "code string, ts int, open double, high double, low double, close double, buy boolean"), rows


def test_windows_are_null_until_full(walk):
    df, _ = walk
    out = df.select("code", "ts", S.ma("close", 10).alias("m"), S.std("close", 10).alias("s")).collect()
    assert all((r.m is None) == (r.ts < 9) and (r.s is None) == (r.ts < 9) for r in out)


def test_ema_against_a_loop(spark):
    values = [None, None, 3.0, 4.0, None, 7.0, 1.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "code string, ts int, x double")
    got = [r.e for r in folds.fold(df, {"e": folds.ema("x", 3)}).orderBy("ts").collect()]
    want, last = [], None
    for v in values:
        last = last if v is None else v if last is None else last + 0.5 * (v - last)
        want.append(last)
    assert got == want


def test_folds_do_not_cross_keys(walk):
    df, rows = walk
    out = folds.fold(df.repartition(5), {"run": folds.run_of_lower("high"), "f": folds.filtered("buy", 3)}).collect()
    for code in "abc":
        mine = sorted((r for r in out if r.code == code), key=lambda r: r.ts)
        highs = [r.high for r in mine]
        quiet = 0
        for i, r in enumerate(mine):
            at = max((j for j in range(i) if highs[j] >= highs[i]), default=None)
            assert r.run == (0 if at is None else i - 1 - at)
            fires = quiet == 0 and r.buy
            assert r.f == fires
            quiet = 3 if fires else max(0, quiet - 1)


def loop_average_down(rows, code, days=None):
    bars = [r for r in rows if r[0] == code]
    out = []
    for i, (_, _, _, _, _, close, buy) in enumerate(bars):
        if not buy:
            continue
        closes, j = [close], i + 1
        while j < len(bars):
            price = round(sum(closes) / len(closes), 9)
            goal = trades.target(price)
            if bars[j][3] >= goal:
                out.append((i, j, len(closes), max(goal, bars[j][2])))
                break
            if days is not None and j - i >= days:
                out.append((i, j, len(closes), bars[j][5]))
                break
            closes.append(bars[j][5])
            j += 1
        else:
            out.append((i, len(bars) - 1, len(closes), bars[-1][5]))
    return out


@pytest.mark.parametrize("days", [None, 2, 5])
def test_average_down_against_a_loop(walk, days):
    df, rows = walk
    got = sorted((r.code, r.buy_index, r.buy_index + r.days_held, r.shares // 100, round(r.sell_price, 6)) for r in trades.exit_average_down(df, days).collect())
    want = sorted((c, i, j, n, round(p, 6)) for c in "abc" for i, j, n, p in loop_average_down(rows, c, days))
    assert got == want


def test_one_position_never_overlaps(walk):
    df, _ = walk
    for average in (False, True):
        rows = sorted(trades.hold_one_position(df, average).collect(), key=lambda r: (r.code, r.buy_index))
        for a, b in zip(rows, rows[1:]):
            assert a.code != b.code or b.buy_index > a.buy_index + a.days_held


def test_greedy_filter_against_a_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 30
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12]
        kept = []
        for k in range(n):
            if not any((min(k, j), max(k, j)) in set(pairs) for j in kept):
                kept.append(k)
        ranked = spark.createDataFrame([(k, k + 1) for k in range(n)], "code int, rank int")
        out = funds.greedy_corr_filter(ranked, spark.createDataFrame(pairs, "a int, b int"), lambda df: df.cache())
        assert sorted(r.code for r in out.collect()) == kept


@pytest.mark.parametrize(("offset", "own"), [(0, None), (5, None), (10, [0.5, 0.3, 0.2])])
def test_portfolio_path_against_a_loop(spark, offset, own):
    rng = np.random.default_rng(4)
    r = rng.uniform(-0.02, 0.02, (100, 3))
    rets = spark.createDataFrame([(f"f{k}", t, float(r[t, k])) for t in range(100) for k in range(3)], "code string, date int, ret double")
    combo = spark.createDataFrame([("x", ["f0", "f1", "f2"])], "key string, combo array<string>")
    rows = funds.combo_returns(rets, combo)
    start = np.array(own or [1 / 3] * 3)
    if own:
        rows = rows.join(spark.createDataFrame([(f"f{k}", w) for k, w in enumerate(own)], "code string, weight double"), "code")
    got = [x.ret for x in funds.portfolio_path(rows, 30, offset).orderBy("t").collect()]
    w, want = start, []
    for t in range(100):
        v = w * (1 + r[t])
        want.append(v.sum() / w.sum() - 1)
        # the weights are reset after the day, so the next one is the first with them
        w = start if t >= 30 and (t - offset) % 30 == 0 else v
    assert np.allclose(got, want, atol=1e-12)


def test_constant_series_have_no_correlation(spark):
    rets = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.1), ("b", 1, 0.1), ("b", 2, 0.3)], "code string, date int, ret double")
    assert funds.pairwise_corr(rets).first().corr is None


def test_apriori_needs_all_subsets(spark):
    sets = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["b", "c"],), (["a", "d"],)], "combo array<string>")
    assert [r.combo for r in combos.apriori_next(sets).collect()] == [["a", "b", "c"]]
    assert combos.apriori_next(sets, False).count() == combos.estimate_next_count(sets).first().n == 3


def test_confirmation_needs_the_first_longer_bar(spark):
    small = spark.createDataFrame([("a", "2024-01-01", True), ("a", "2024-01-10", True), ("a", "2024-03-01", True), ("b", "2024-01-01", True)], "code string, ts string, buy boolean").withColumn("ts", F.to_date("ts"))
    big = spark.createDataFrame([("a", "2024-01-05", False), ("a", "2024-01-12", True), ("a", "2024-05-01", True)], "code string, ts string, buy boolean").withColumn("ts", F.to_date("ts"))
    got = {(r.code, str(r.ts)): r.buy for r in joins.confirm_by_longer_period(small, big).collect()}
    assert got == {("a", "2024-01-01"): False, ("a", "2024-01-10"): True, ("a", "2024-03-01"): False, ("b", "2024-01-01"): False}
