"""Structured Streaming forms of the bar builders and live rules; ticks are (code, ts, price, qty)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col
LATE = "10 minutes"
#: Rows of a frame that a kernel gives back at once.
CHUNK = 10_000


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Bars of fixed width; a bar comes out when the watermark passes its end."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("code", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("qty").alias("volume"))
        .select("code", C("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sliding_totals(votes: DataFrame, width: str, step: str, late: str = LATE) -> DataFrame:
    """Votes of each code in sliding windows."""
    return votes.withWatermark("ts", late).groupBy("code", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum("qty").alias("total")).select("code", C("w.start").alias("ts"), "n", "total")


def first_of_each(ticks: DataFrame, late: str = LATE) -> DataFrame:
    """The first row of each (code, ts) within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["code", "ts"])


def in_session(ticks: DataFrame, begin: str, end: str) -> DataFrame:
    """Rows of a time of day; a session may cross midnight."""
    t = F.date_format("ts", "HH:mm:ss")
    return ticks.filter(t.between(begin, end) if begin <= end else (t >= begin) | (t <= end))


def running_day_bars(ticks: DataFrame, late: str = LATE) -> DataFrame:
    """The day's bar so far, at each tick, by (code, day). A day's state goes once the watermark is past its end."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, high, low, volume = state.get if state.exists else (None, float("-inf"), float("inf"), 0)
        # a large group comes in several Arrow batches, in no order
        ticks = pd.concat(list(batches))[["ts", "price", "qty"]].sort_values(["ts", "price"])
        for at in range(0, len(ticks), CHUNK):
            rows = ticks.iloc[at : at + CHUNK]
            first = float(rows["price"].iloc[0]) if first is None else first
            highs, lows, volumes = rows["price"].cummax().clip(lower=high), rows["price"].cummin().clip(upper=low), rows["qty"].cumsum() + volume
            yield pd.DataFrame({"code": key[0], "day": key[1], "ts": rows["ts"], "open": first, "high": highs, "low": lows, "close": rows["price"], "volume": volumes})
            high, low, volume = float(highs.iloc[-1]), float(lows.iloc[-1]), int(volumes.iloc[-1])
        state.update((first, high, low, volume))
        end = int(pd.Timestamp(key[1], tz="UTC").timestamp() * 1000) + 86_400_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    keyed = ticks.withWatermark("ts", late).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return keyed.groupBy("code", "day").applyInPandasWithState(
        run, "code string, day string, ts timestamp, open double, high double, low double, close double, volume long", "open double, high double, low double, volume long", "append", GroupStateTimeout.EventTimeTimeout
    )


def order_prices(ticks: DataFrame, least: float, most: float) -> DataFrame:
    """The price clamped to a range, where it is lower than any before it for the code. The state is one number for each code."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lowest = state.get[0] if state.exists else float("inf")

        def lower(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["ts", "price"])
            return rows[rows["price"] < rows["price"].cummin().shift(1).fillna(float("inf")).clip(upper=lowest)]

        # a large group comes in several Arrow batches, in no order; what is not lower within its own batch is not lower within all
        kept = lower(pd.concat([lower(batch[["ts", "price"]].assign(price=batch["price"].clip(least, most))) for batch in batches]))
        if len(kept):
            yield pd.DataFrame({"code": key[0], "ts": kept["ts"], "price": kept["price"]})
            lowest = float(kept["price"].iloc[-1])
        state.update((lowest,))

    return ticks.groupBy("code").applyInPandasWithState(run, "code string, ts timestamp, price double", "lowest double", "append", GroupStateTimeout.NoTimeout)


#: One row a live bar, one column a bar of its window (oldest first, NaN before the first bar), by name of the field.
Windows = dict[str, np.ndarray]


def _windows(held: list[tuple], new: pd.DataFrame, fields: list[str], n: int) -> tuple[Windows, list[tuple]]:
    """The windows of bars (ts, fields) in their order of arrival, and the last n bars after them."""
    times = [x[0] for x in held]
    if new["ts"].is_monotonic_increasing and new["ts"].is_unique and (not held or new["ts"].iloc[0] > times[-1]):
        before = np.array([x[1:] for x in held[len(held) - min(len(held), n - 1) :]], float).reshape(-1, len(fields))
        blank = np.full((n - 1 - len(before), len(fields)), np.nan)
        values = np.concatenate((blank, before, new[fields].to_numpy(float)))
        windows = np.lib.stride_tricks.sliding_window_view(values, n, axis=0).swapaxes(0, 1)
        held = [*held, *new.iloc[-n:].itertuples(index=False, name=None)][-n:]
    else:
        windows = np.full((len(fields), len(new), n), np.nan)
        for k, bar in enumerate(new.itertuples(index=False, name=None)):
            at = bisect_left(times, bar[0])
            if at < len(times) and times[at] == bar[0]:
                held[at] = bar  # a bar that comes again takes the place of the one before
            else:
                held.insert(at, bar)
                times.insert(at, bar[0])
            known = held[max(0, at + 1 - n) : at + 1]
            windows[:, k, n - len(known) :] = np.array([x[1:] for x in known], float).T
            if len(held) > n:
                del held[0], times[0]
    return dict(zip(fields, windows, strict=True)), held


def live_signals(bars: DataFrame, rule: Callable[[Windows], np.ndarray], n: int = 100, fields: tuple[str, ...] = ("open", "high", "low", "close", "volume"), ttl: int | None = None) -> DataFrame:
    """(code, ts, arrival, buy) for each row of a stream of bars (code, ts, fields, arrival): the rule over the code's last n bars up to it.

    Rows count in the order of ``arrival``, so the result is the same however the stream is cut into
    batches. A late bar takes its place in the window and has its own row over the bars before it, as far as
    the last n bars are kept; a bar that comes again replaces the one with its time and has a row again.
    Rows with a negative arrival are history: they fill the windows and give no row. The state is the last
    n bars of a code, as arrays; after ``ttl`` milliseconds without a bar it goes.
    """
    names = list(fields)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("arrival")
        held = [*zip(*state.get, strict=True)] if state.exists else []
        windows, held = _windows(held, rows[["ts", *names]], names, n)
        state.update(tuple(map(list, zip(*held, strict=True))))
        if ttl is not None:
            state.setTimeoutDuration(ttl)
        live = (rows["arrival"] >= 0).to_numpy()
        buy = np.asarray(rule(windows), bool)
        yield pd.DataFrame({"code": key[0], "at": rows["ts"].to_numpy(), "arrival": rows["arrival"].to_numpy(), "buy": buy})[live]

    rows = bars.select("code", F.unix_micros(C("ts").cast("timestamp")).alias("ts"), *[C(x).cast("double").alias(x) for x in names], "arrival")
    kept = "ts array<long>, " + ", ".join(f"`{x}` array<double>" for x in names)
    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
    made = rows.groupBy("code").applyInPandasWithState(run, "code string, at long, arrival long, buy boolean", kept, "append", timeout)
    return made.select("code", F.timestamp_micros("at").alias("ts"), "arrival", "buy")
