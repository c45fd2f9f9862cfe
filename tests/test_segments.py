"""Vectorised kernels of whole series against plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import segments
from tickloom.functions.series import Series
from tickloom.operators import bars as br
from tickloom.operators import features as ft
from tickloom.operators import trades as tr


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 64, 150])
@pytest.mark.parametrize("values", [2, 1000])
def test_kernels(n, values):
    rng = np.random.default_rng(n * values)
    x = rng.integers(0, values, n).astype(float)
    assert segments.counts_below(x).tolist() == [int((x[:k] < x[k]).sum()) for k in range(n)]
    start, level = rng.integers(0, n + 1, 50), rng.integers(-1, values, 50).astype(float)
    if n:
        want = [next((j for j in range(s, n) if x[j] > v), n) for s, v in zip(start, level, strict=True)]
        assert segments.first_above(x, start, level).tolist() == want


def test_missing_values():
    x = np.array([2.0, np.nan, 1.0, 3.0, np.nan, 2.5])
    assert segments.counts_below(x).tolist() == [0, 0, 0, 2, 0, 2]
    assert segments.first_above(x, np.array([0, 1, 4]), np.array([2.0, 2.9, np.nan])).tolist() == [3, 3, 6]


def test_long_series_take_seconds():
    x = np.random.default_rng(1).random(500_000)
    began = time.time()
    segments.counts_below(x)
    segments.first_above(x, np.arange(1, len(x) + 1), x)
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def series(spark):
    rng, rows = random.Random(3), []
    for code, n in (("a", 1), ("b", 60), ("c", 2), ("d", 40)):
        for t in range(n):
            close = float(rng.randint(5, 15))
            rows.append((code, t, close + rng.randint(0, 2), close, rng.choice([None, 1.0, 2.0, 3.0]), rng.random() < 0.4))
    df = spark.createDataFrame(rows, "code string, ts int, high double, close double, turnover double, buy boolean")
    return rows, Series().numbered(df)


def by_code(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_series_over_batches(spark, series, batch):
    rows, df = series
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.code, r.ts): (r.rank, r.rank_gain) for r in ft.profit_ratio_rank(df).collect()}
        until = {(r.code, r.ts): r.until_higher for r in br.days_until_higher(df).collect()}
        ledger = {(r.code, int(r.buy_ts)): (int(r.sell_ts), r.sell_price, r.days_held, r.buy_index, r.profit) for r in tr.exit_first_high(df).collect()}
        later = {(r.code, int(r.buy_ts)) for r in tr.first_later_high(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, want_until, want_ledger, want_later = {}, {}, {}, set()
    for code, own in by_code(rows).items():
        last = None
        for k, (_, t, _, close, x, buy) in enumerate(own):
            rank = 1 + sum(o[4] is not None and x is not None and o[4] < x for o in own[:k])
            want[code, t] = rank, None if last is None else rank - last
            last = rank
            j = next((i for i in range(k + 1, len(own)) if own[i][2] > close), None)
            want_until[code, t] = len(own) if j is None else j - k
            at, price = (len(own) - 1, own[-1][3]) if j is None else (j, own[j][2])
            if j is not None:
                want_later.add((code, t))
            if buy:
                want_ledger[code, t] = own[at][1], price, at - k, k, (price - close) * 100
    assert got == want and until == want_until and ledger == want_ledger and later == want_later


def test_empty_table(series):
    _, df = series
    assert ft.profit_ratio_rank(df.filter(F.lit(False))).collect() == []
