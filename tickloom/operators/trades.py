"""Matching buy signals to exits: bars with a boolean ``buy`` give a ledger with one row for a trade.

The first later high is found for all bars of a series at once. The other rules are states that see a
series bar by bar: ``look`` at each bar, ``finish`` at the last one; only the trades that are open are held.
A bar's exits come before its own entry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import by_series, later_high

C = F.col
SHARES = 100
LEDGER = "code string, buy_ts string, buy_price double, sell_ts string, sell_price double, shares long, cost double, profit double, days_held long, buy_index long"
NAMES = [x.split()[0] for x in LEDGER.split(", ")]


def target_price(x: Column, margin: float = 1.0025) -> Column:
    """The price a margin above, rounded up to a cent."""
    return F.ceil(F.round(x * margin * 100, 7)) / 100


def target(price: float, margin: float = 1.0025) -> float:
    return math.ceil(round(price * margin * 100, 7)) / 100


class Bar:
    __slots__ = ("i", "ts", "open", "high", "low", "close", "buy")

    def __init__(self, i, ts, open_, high, low, close, buy):
        self.i, self.ts, self.open, self.high, self.low, self.close, self.buy = i, ts, open_, high, low, close, buy


def _row(code, first, price, bar, sold, shares):
    return (code, first.ts, price, bar.ts, sold, shares, price * shares, (sold - price) * shares, bar.i - first.i, first.i)


class AverageDown:
    """Each signal buys at the close and again at each close whose bar misses the target over the mean cost; at most ``days`` bars if given."""

    def __init__(self, days: int | None = None):
        self.open: list = []
        self.days = days

    def look(self, code, bar):
        left = []
        for trade in self.open:
            first, total, n = trade
            price = round(total / n, 9)
            goal = target(price)
            if bar.high >= goal:
                yield _row(code, first, price, bar, max(goal, bar.open), n * SHARES)
            elif self.days is not None and bar.i - first.i >= self.days:
                yield _row(code, first, price, bar, bar.close, n * SHARES)
            else:
                trade[1], trade[2] = total + bar.close, n + 1
                left.append(trade)
        self.open = left
        if bar.buy:
            self.open.append([bar, bar.close, 1])

    def finish(self, code, bar):
        for first, total, n in self.open:
            yield _row(code, first, round(total / n, 9), bar, bar.close, n * SHARES)


class OnePosition:
    """One trade at a time: the first signal while none is open buys; sells at the target or better; skips bars whose high is the open."""

    def __init__(self, average: bool = False):
        self.first, self.average = None, average

    def look(self, code, bar):
        if self.first is None:
            if bar.buy:
                self.first, self.total, self.n = bar, bar.close, 1
            return
        if bar.high == bar.open:
            return
        price = round(self.total / self.n, 9)
        goal = target(price)
        if bar.high >= goal:
            yield _row(code, self.first, price, bar, max(goal, bar.open), self.n * SHARES)
            self.first = None
        elif self.average:
            self.total, self.n = self.total + bar.close, self.n + 1

    def finish(self, code, bar):
        if self.first is not None:
            yield _row(code, self.first, round(self.total / self.n, 9), bar, bar.close, self.n * SHARES)


def match(bars: DataFrame, rule: Callable) -> DataFrame:
    """The ledger of bars (code, ts, open, high, low, close, buy) under a rule (a maker of one state for each series)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, state, bar, out = None, None, None, []
        for batch in batches:
            for k, ts, *prices, buy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or k != code:
                    if state is not None and bar is not None:
                        out.extend(state.finish(code, bar))
                    code, state, bar = k, rule(), None
                bar = Bar(0 if bar is None else bar.i + 1, ts, *prices, buy)
                out.extend(state.look(code, bar))
            if out:
                yield pa.record_batch([pa.array(list(c)) for c in zip(*out, strict=True)], NAMES)
                out = []
        if state is not None and bar is not None:
            out = list(state.finish(code, bar))
            if out:
                yield pa.record_batch([pa.array(list(c)) for c in zip(*out, strict=True)], NAMES)

    ordered = bars.repartition("code").sortWithinPartitions("code", "ts")
    rows = ordered.select(C("code").cast("string").alias("code"), C("ts").cast("string").alias("ts"), "open", "high", "low", "close", F.coalesce("buy", F.lit(False)).alias("buy"))
    return rows.mapInArrow(run, LEDGER)


def _outcomes(values: dict, bounds: np.ndarray, rows: pa.Table) -> dict:
    """Buying at each bar's close and selling at the first later high above it, or at the last close."""
    found, sold = later_high(values["high"], values["close"], bounds)
    price = np.where(sold, values["high"][found], values["close"][found])
    place = np.arange(len(found))
    out = {"sold": sold, "sell_price": price, "days_held": found - place, "buy_index": place - np.repeat(bounds[:-1], np.diff(bounds))}
    return out | {"profit": (price - values["close"]) * SHARES} | ({"sell_ts": rows.column("buy_ts").take(pa.array(found))} if "buy_ts" in rows.column_names else {})


OUTCOMES = {"sold": "boolean", "sell_price": "double", "days_held": "long", "buy_index": "long", "profit": "double"}


def _first_highs(bars: DataFrame) -> DataFrame:
    rows = bars.select(C("code").cast("string").alias("code"), "ts", C("ts").cast("string").alias("buy_ts"), "high", "close", F.coalesce("buy", F.lit(False)).alias("buy"))
    made = by_series(rows, ["high", "close"], _outcomes, OUTCOMES | {"sell_ts": "string"}).filter("buy")
    return made.withColumns({"buy_price": C("close"), "shares": F.lit(SHARES).cast("long"), "cost": C("close") * SHARES})


def exit_first_high(bars: DataFrame) -> DataFrame:
    """Each signal buys at the close and sells at the first later high above it, or else at the last close."""
    return _first_highs(bars).select(*NAMES)


def first_later_high(bars: DataFrame) -> DataFrame:
    """Each bar as a signal, with the first later high above its close; bars that have none are left out."""
    return _first_highs(bars.withColumn("buy", F.lit(True))).filter("sold").select(*NAMES)


def exit_average_down(bars: DataFrame, days: int | None = None) -> DataFrame:
    return match(bars, lambda: AverageDown(days))


def hold_one_position(bars: DataFrame, average: bool = False) -> DataFrame:
    return match(bars, lambda: OnePosition(average))


def label_every_bar(bars: DataFrame) -> DataFrame:
    """Each bar with the outcome of buying at it."""
    made = by_series(bars, ["high", "close"], _outcomes, {x: OUTCOMES[x] for x in ("profit", "days_held")})
    return made.withColumn("ts", C("ts").cast("string"))


def sell_threshold_grid(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Profit of each target: paths (id, best, last) sell at the target % if the path's best reaches it, else at its last value. The grid is small."""
    outcome = F.when(C("best") >= C("goal"), C("goal")).otherwise(C("last"))
    return paths.crossJoin(F.broadcast(steps)).groupBy("goal").agg(F.sum(outcome).alias("profit"), F.count_if(C("best") >= C("goal")).alias("sold"))


def attach_following_days(df: DataFrame) -> DataFrame:
    """High and close of the next two bars; where there is none, the bar's own."""
    from ..functions.series import Series

    w = Series().w
    return df.withColumns({f"{c}{k}": F.coalesce(F.lead(c, k).over(w), C(c)) for c in ("high", "close") for k in (1, 2)})


def fill_thresholds(ledger: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The ledger with the threshold prices (code, ts, ...) of its dates of buying; NULL where there are none."""
    return ledger.join(thresholds.withColumn("buy_ts", C("ts").cast("string")).drop("ts"), ["code", "buy_ts"], "left")
