"""Price thresholds against recomputing the signal over all bars for every step."""

import random

import pandas as pd
import pytest

from tickloom.functions.series import Series
from tickloom.operators import thresholds as th

LIMIT = 4.0


@pytest.fixture(scope="module")
def frame():
    rng, rows = random.Random(6), []
    for code in ("a", "b", "c"):
        close = 10.0
        for t in range(40):
            close = round(max(close * (1 + rng.uniform(-0.03, 0.03)), 0.05), 2)
            rows.append((code, t, round(close * rng.uniform(1, 1.01), 2), round(close * rng.uniform(0.99, 1), 2), close))
    out = pd.DataFrame(rows, columns=["code", "ts", "high", "low", "close"])
    out["prev_close"] = out.groupby("code")["close"].shift(1)
    out["limit_rate"] = LIMIT
    return out


def ema_rule(w):
    short, long = w.ema(3), w.ema(9)
    return lambda c: short(c) > long(c)


def ema_signal(bars):
    return bars["close"].ewm(span=3, adjust=False).mean() > bars["close"].ewm(span=9, adjust=False).mean()


def band_rule(w):
    mean, top, before = w.mean(5), w.highest(4), w.earlier("high")
    return lambda c: (c.close > mean(c) + 1e-6) & (c.high < top(c) * 1.0013) & (c.close < before(c)) & (c.amplitude < 3)


def band_signal(bars):
    amplitude = (bars["high"] - bars["low"]) / bars["close"].shift(1) * 100
    return (bars["close"] > bars["close"].rolling(5).mean() + 1e-6) & (bars["high"] < bars["high"].rolling(4).max() * 1.0013) & (bars["close"] < bars["high"].shift(1)) & (amplitude < 3)


def brute(bars, signal, at):
    """Thresholds of the bar at a position: each step's bars are made anew and the signal computed over all."""
    close, prev = bars.loc[at, "close"], bars.loc[at, "close" if at == 0 else "prev_close"]
    if at == 0 or abs(close - prev) / prev * 100 > LIMIT + 1e-9:
        return None, None
    now, out = bool(signal(bars.loc[:at])[at]), []
    for sign in (1, -1):
        found, k = None, 1
        while (price := round(close + sign * k * 0.01, 6)) > 0 and abs(price - prev) / prev * 100 <= LIMIT + 1e-9:
            made = bars.loc[:at].copy()
            made.loc[at, ["close", "high", "low"]] = price, max(made.loc[at, "high"], price), min(made.loc[at, "low"], price)
            if bool(signal(made)[at]) != now:
                found = price
                break
            k += 1
        out.append(found)
    return tuple(out)


@pytest.mark.parametrize(("rule", "signal", "monotone"), [(ema_rule, ema_signal, True), (ema_rule, ema_signal, False), (band_rule, band_signal, False)])
def test_every_bar_against_recomputing(spark, frame, rule, signal, monotone):
    from pyspark.sql import functions as F

    bars = Series().numbered(spark.createDataFrame(frame))
    got = {(r.code, r.ts): (r.threshold_up, r.threshold_down) for r in th.price_thresholds(bars, rule, monotone, F.lit(True)).collect()}
    want = {}
    for code, own in frame.groupby("code"):
        own = own.reset_index(drop=True)
        want |= {(code, t): brute(own, signal, t) for t in range(len(own))}
    nan = lambda x: None if x is None or x != x else round(x, 6)
    assert {k: tuple(map(nan, v)) for k, v in got.items()} == {k: (None, None) if v is None else v for k, v in want.items()}
    assert sum(x is not None for v in want.values() if v for x in v) > 10


def test_last_bars_only(spark, frame):
    bars = Series().numbered(spark.createDataFrame(frame))
    rows = th.price_thresholds(bars, ema_rule, True).collect()
    assert sorted((r.code, r.ts) for r in rows) == [("a", 39), ("b", 39), ("c", 39)]
    empty = bars.filter("code = 'none'")
    assert th.price_thresholds(empty, ema_rule, True).collect() == []
