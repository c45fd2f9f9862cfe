"""Queries of price thresholds: the nearest close at which a signal flips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import thresholds as th
from ..operators import trades as tr
from . import sqltext as q
from .build import bars, register
from .trade_queries import FIRST, ledger, r6

C = F.col
#: Limits of the synthetic bars, whose prices jump far more than real ones.
LIMIT, BAR_LIMIT = 200.0, 60.0
OUT = ("close", "threshold_up", "threshold_down")


def crossing(w: th.WhatIf) -> th.Value:
    """The mean of 3 at or above the mean of 8: monotone in the price."""
    short, long = w.mean(3), w.mean(8)
    return lambda c: short(c) >= long(c)


def calm_and_new(w: th.WhatIf) -> th.Value:
    """Below the mean of 5 and the lowest close of 3 bars, with a small amplitude: may flip to and fro."""
    mean, lowest = w.mean(5), w.lowest(3, "close")
    return lambda c: (c.close < mean(c)) & (c.close <= lowest(c)) & (c.amplitude < 60)


def half_mean(w: th.WhatIf) -> th.Value:
    """The signal of the ledgers: below half of the mean of 10."""
    mean = w.mean(10)
    return lambda c: c.close < mean(c) * 0.5


def searched(source: str, limit: float, value: str, wanted: str, longest: int) -> str:
    """Stages to ``th_o``: each wanted bar of ``source`` with the first step either way at which ``value`` (of the what-if close p, high hi, low lo and the list h of closes before) is another."""
    return f""", th_w as (select code, ts, close, high, low, prev_close, list(close) over (partition by code order by ts rows between {longest} preceding and 1 preceding) as h, row_number() over (partition by code order by ts desc) = 1 as is_last from {source}),
    th_c as (select *, close as p, high as hi, low as lo from th_w), th_n as (select * exclude (p, hi, lo), coalesce({value}, false) as now from th_c),
    th_s as (select *, greatest(cast(floor((prev_close * (1 + {limit} / 100) - close) / 0.01 + 1e-6) as bigint), 0) as ku, greatest(cast(floor((close - prev_close * (1 - {limit} / 100)) / 0.01 + 1e-6) as bigint), 0) as kd, abs(close - prev_close) <= prev_close * {limit} / 100 + 1e-9 as inside from th_n where {wanted}),
    th_k as (select *, 1 as sign, unnest(range(1, ku + 1)) as k from th_s where inside union all select *, -1 as sign, unnest(range(1, kd + 1)) as k from th_s where inside),
    th_p as (select *, round(close + sign * k * 0.01::double, 6) as p from th_k), th_q as (select *, greatest(high, p) as hi, least(low, p) as lo from th_p where p > 0),
    th_f as (select code, ts, sign, arg_min(p, k) as flip from th_q where coalesce({value}, false) <> now group by 1, 2, 3),
    th_o as (select x.code, x.ts, x.close, x.now, u.flip as threshold_up, d.flip as threshold_down from th_s x left join th_f u on u.code = x.code and u.ts = x.ts and u.sign = 1 left join th_f d on d.code = x.code and d.ts = x.ts and d.sign = -1)"""


def mean_of(n: int) -> str:
    return f"case when len(h) >= {n - 1} then (list_sum(h[len(h) - {n - 2} :]) + p) / {n} end"


ROUNDED = ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in OUT)


def limited(spark, sf, kind: str, limit: float):
    return bars(spark, sf, kind).withColumn("limit_rate", F.lit(limit))


register(
    "signal_price_threshold",
    lambda spark, sf: th.price_thresholds(limited(spark, sf, "user_day", LIMIT), crossing, True).select("code", C("ts").cast("string").alias("ts"), "now", *r6(*OUT)),
    q.base("user_day", quoted=True) + searched("b", LIMIT, f"{mean_of(3)} >= {mean_of(8)}", "is_last", 7) + f" select code, ts::varchar as ts, now, {ROUNDED} from th_o",
)
register(
    "signal_price_threshold_bars",
    lambda spark, sf: th.price_thresholds(limited(spark, sf, "hour", BAR_LIMIT), calm_and_new, False, C("now")).select("code", C("ts").cast("string").alias("ts"), "now", *r6(*OUT)),
    q.base() + searched("b", BAR_LIMIT, f"p < {mean_of(5)} and (len(h) >= 2 and p <= list_min(list_append(h[len(h) - 1 :], p))) and (hi - lo) / prev_close * 100 < 60", "now", 4) + f" select code, ts::varchar as ts, now, {ROUNDED} from th_o",
)


def flips(spark, sf):
    """Where the ledgers' signal would end: the nearest higher close at which it is off."""
    return th.price_thresholds(limited(spark, sf, "hour", LIMIT), half_mean, True, C("now")).select("code", "ts", C("threshold_up").alias("flips_at"))


register(
    "trade_fill_thresholds",
    lambda spark, sf: tr.fill_thresholds(ledger(spark, sf), flips(spark, sf)).select("code", "buy_ts", *r6("flips_at", "profit")),
    FIRST + searched("b", LIMIT, f"p < {mean_of(10)} * 0.5", "now", 9) + " select l.code, l.buy_ts::varchar as buy_ts, round(o.threshold_up + 1e-9, 6) as flips_at, round(l.profit + 1e-9, 6) as profit from l left join th_o o on o.code = l.code and o.ts = l.buy_ts",
)
