"""Preparation of features against numpy, elimination of useless ones, stop and reverse against a plain loop."""

import random

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickloom.functions import folds
from tickloom.operators import models as ml


def frame(spark, seed=3, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 6))
    x[:, 1] = x[:, 0] + rng.normal(0, 0.1, n)  # nearly one direction
    y = (x[:, 0] + 0.5 * x[:, 2] > 0).astype(float)
    rows = [("a", k, *map(float, r), float(v), 1.0) for k, (r, v) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "code string, ts long, " + ", ".join(f"f{k} double" for k in range(6)) + ", label double, weight double")


def test_components_that_keep_a_share_of_the_variance(spark):
    x, y, df = frame(spark)
    columns = [f"f{k}" for k in range(6)]
    scaled = (x - x.mean(0)) / x.std(0, ddof=1)

    def f_value(v):
        groups = [v[y == c] for c in (0, 1)]
        between = sum(len(g) * (g.mean() - v.mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        return between / (within / (len(v) - 2))

    chosen = sorted(sorted(range(6), key=lambda k: -f_value(scaled[:, k]))[:4])
    values, axes = np.linalg.eigh(np.cov(scaled[:, chosen].T))
    order = np.argsort(-values)
    for share in (0.5, 0.95, 1.0):
        k = int((np.cumsum(values[order]) / values.sum() < share - 1e-12).sum()) + 1
        model = ml.preprocess_by_variance(df, columns, 4, share)
        got = np.array([r.v for r in model.transform(df).orderBy("ts").select(vector_to_array("features").alias("v")).collect()])
        want = scaled[:, chosen] @ axes[:, order[:k]]
        assert got.shape == want.shape
        assert np.allclose(np.abs((got * want).sum(0)), (want * want).sum(0), rtol=1e-6)  # the same up to the sign


def test_elimination_keeps_what_the_label_depends_on(spark):
    _, _, df = frame(spark)
    kept, means = ml.eliminate_by_folds(df, [f"f{k}" for k in range(6)], 0.3, 2, 1)
    assert list(means) == [6, 5, 4, 3, 2, 1] and all(0.4 < m <= 1 for m in means.values())
    assert "f2" in kept and ({"f0", "f1"} & set(kept)) and means[len(kept)] == max(means.values())


def stop_and_reverse(high, low, start=0.02, most=0.2):
    """By the book: one value a bar from the second on."""
    out = [None]
    down = low[0] - low[1]
    long = not (down > 0 and down > high[1] - high[0])
    af, ep, sar = start, (high[1] if long else low[1]), (low[0] if long else high[0])
    for k in range(1, len(high)):
        if long and low[k] <= sar:
            long, sar = False, max(ep, high[k - 1], high[k])
            out.append(sar)
            af, ep = start, low[k]
        elif not long and high[k] >= sar:
            long, sar = True, min(ep, low[k - 1], low[k])
            out.append(sar)
            af, ep = start, high[k]
        else:
            out.append(sar)
            if long and high[k] > ep:
                ep, af = high[k], min(af + start, most)
            if not long and low[k] < ep:
                ep, af = low[k], min(af + start, most)
        sar += af * (ep - sar)
        sar = min(sar, low[k - 1], low[k]) if long else max(sar, high[k - 1], high[k])
    return out


def test_stop_and_reverse_against_a_loop(spark):
    rng, rows, want = random.Random(11), [], {}
    for code in "abcd":
        close, highs, lows = 20.0, [], []
        for t in range(80):
            close += rng.uniform(-1, 1)
            highs.append(round(close + rng.random(), 2))
            lows.append(round(close - rng.random(), 2))
            rows.append((code, t, highs[-1], lows[-1]))
        for t, x in enumerate(stop_and_reverse(highs, lows)):
            want[code, t] = x
    df = spark.createDataFrame(rows, "code string, ts int, high double, low double")
    got = {(r.code, r.ts): r.sar for r in folds.fold(df, {"sar": folds.sar()}).collect()}
    assert all((got[k] is None and x is None) or abs(got[k] - x) < 1e-9 for k, x in want.items()) and len(got) == len(want)


def test_marks_before_the_next_free_day(spark):
    from tickloom.functions.series import Series
    from tickloom.functions.steps import with_steps
    from tickloom.operators import features as ft

    days = ["2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11"]  # Monday to Thursday
    df = Series().numbered(spark.createDataFrame([("a", d) for d in days], "code string, ts string").withColumn("ts", F.col("ts").cast("date")))
    got = [(r.pre1, r.pre2, r.pre3) for r in with_steps(df, ft.holiday_marks()).orderBy("ts").collect()]
    assert got == [(False, False, False), (False, False, False), (False, False, True), (False, True, False)]
    soon = [(r.pre1, r.pre2, r.pre3) for r in with_steps(df, ft.holiday_marks(free_day="2024-01-12")).orderBy("ts").collect()]
    assert soon == [(False, False, False), (False, False, True), (False, True, False), (True, False, False)]
