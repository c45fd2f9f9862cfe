"""Features and labels over bars. Each function gives steps for ``with_steps``; labels begin with ``fwd_``."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as fn
from ..functions.segments import by_series, counts_below
from ..functions.series import Series
from ..functions.steps import with_steps
from . import indicators as ind

C = F.col
S = Series()


def _pct(x):
    """Percent to two digits, missing counts as 0."""
    return F.coalesce(fn.half_even(x * 100, 2), F.lit(0.0))


def technical(df: DataFrame, prefix: str = "") -> DataFrame:
    """df with stoch_k, stoch_d, willr, boll_up, boll_mid, boll_low, rsi, dif, dea, hist and bar of the prices named with a prefix."""
    own = df.withColumns({p: C(f"{prefix}{p}") for p in ("open", "high", "low", "close")}) if prefix else df
    own = own.withColumn("prev_close", S.ref("close"))
    made = with_steps(own, [*ind.stoch(), *ind.willr(), *ind.boll(), *ind.rsi_wilder(), *ind.macd_seeded()])
    out = {"stoch_k": "slowk", "stoch_d": "slowd", "willr": "willr", "boll_up": "boll_up", "boll_mid": "boll_mid", "boll_low": "boll_low", "rsi": "rsi_w", "dif": "dif_s", "dea": "dea_s", "hist": "macd_s"}
    return made.select(*df.columns, *[C(c).alias(f"{prefix}{n}") for n, c in out.items()], (C("macd_s") * 2).alias(f"{prefix}bar"))


#: Columns that no feature is made of.
KEYS = {"code", "ts", "rn", "limit_rate", "prev_close"}


def analysed(df: DataFrame, without: tuple[str, ...] = ("fwd_", "_over_", "_under_", "_vs_", "pre", "post")) -> list[str]:
    """Numeric columns to analyse: no keys, labels, flags, or gaps against another price."""
    numbers = {"double", "float", "int", "bigint"}
    return [c for c, t in df.dtypes if t in numbers and c not in KEYS and not any(w in c for w in without)]


def _features(df: DataFrame, keys: list[str], windows: tuple[int, ...], flat: float) -> DataFrame:
    df = with_steps(df, [*range_position(tuple(keys), windows[-2:], flat), *trend_streaks(tuple(keys)), *rolling_flags(tuple(keys), windows)])
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def _filled(df: DataFrame, warmup: int) -> DataFrame:
    """Numbers without NULL, rows after the warm-up, and no bare means."""
    numbers = [c for c, t in df.dtypes if t in ("double", "int", "bigint") and c not in KEYS]
    means = [c for c in df.columns if "_mean" in c]
    return df.filter(C("rn") > warmup).na.fill(0, numbers).drop(*means)


def data_features(df: DataFrame, keys: list[str] | None = None, warmup: int = 26, windows: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """The whole feature set of bars (code, ts, prices, volume, rn, prev_close): holiday marks, changes and their crossings,
    technical columns, amplitudes; then place in the range, streaks and flags of each analysed column (``keys``, else all),
    crossings of the price with its means and bands. NULL counts as 0, and the first ``warmup`` rows go."""
    df = with_steps(df, [*holiday_marks(), *change_pct(("close",), (3, 5, 10))])
    df = with_steps(df, crossings(("close_chg3", "close_chg5", "close_chg10")))
    df = with_steps(technical(df), window_amplitude())
    df = _features(df, keys or analysed(df), windows, 0.0)
    df = with_steps(df, [lambda: {f"m{n}": S.ma("close", n) for n in windows}, *crossings(("close", *[f"m{n}" for n in windows], "boll_up", "boll_low"))])
    return _filled(df.drop(*[f"m{n}" for n in windows]), warmup)


def index_features(df: DataFrame, prefixes: tuple[str, str], keys: list[str] | None = None, windows: tuple[int, ...] = (3, 5)) -> DataFrame:
    """The same for two index series side by side, by prefix of their columns; the frame is one series (code, ts, rn)."""
    closes = tuple(f"{p}close" for p in prefixes)
    df = with_steps(df, [*holiday_marks(), *change_pct(closes, (1, 3, 5))])
    df = with_steps(df, crossings(tuple(f"{c}_chg{n}" for c in closes for n in (1, 3))))
    for p in prefixes:
        df = technical(df, p)
        named = df.withColumns({x: C(f"{p}{x}") for x in ("high", "low", "close")})
        df = with_steps(named, window_amplitude((1, 3, 5))).withColumnsRenamed({f"amp{n}": f"{p}amp{n}" for n in (1, 3, 5)}).drop("high", "low", "close")
    df = _features(df, keys or [c for c in analysed(df) if c.startswith(prefixes) and not any(x in c for x in ("high", "low", "5", "10"))], windows, 0.0)
    for p in prefixes:
        df = with_steps(df, [lambda p=p: {f"{p}m{n}": S.ma(f"{p}close", n) for n in windows}, *crossings((f"{p}close", *[f"{p}m{n}" for n in windows], f"{p}boll_up", f"{p}boll_low"))])
        df = df.drop(*[f"{p}m{n}" for n in windows])
    return _filled(df, 0)


def change_pct(keys=("close", "volume"), periods=(1, 2, 5)):
    """{key}_chg{p}"""
    return [lambda: {f"{k}_chg{p}": _pct(fn.div(S.diff(k, p), S.ref(k, p))) for k in keys for p in periods}]


def relative_amplitude(keys=("open", "high", "low", "close")):
    """{a}_{b}_vs_{k}: the gap of two prices over the previous value of each"""
    return [lambda: {f"{a}_{b}_vs_{k}": _pct(fn.div(C(a) - C(b), S.ref(k))) for a, b in combinations(keys, 2) for k in keys}]


def window_amplitude(windows=(1, 3, 5, 10)):
    """amp{n}"""
    return [lambda: {f"amp{n}": _pct(fn.div(F.max("high").over(S.past(n)) - F.min("low").over(S.past(n)), F.lag("close", n - 1).over(S.w))) for n in windows}]


def trend_streaks(keys=("close", "volume")):
    """{key}_up, {key}_down: run lengths; {key}_turn_up, {key}_turn_down: the run before was of one bar"""
    return [
        lambda: {f"_{k}_{n}": fn.sig(c) for k in keys for n, c in (("rise", C(k) > S.ref(k)), ("fall", C(k) < S.ref(k)))},
        lambda: {f"{k}_{n}": S.barslastcount(f"_{k}_{c}") for k in keys for n, c in (("up", "rise"), ("down", "fall"))},
        lambda: {f"{k}_turn_{n}": fn.sig((C(f"{k}_{n}") > 0) & (S.ref(f"{k}_{o}") == 1)).cast("int") for k in keys for n, o in (("up", "down"), ("down", "up"))},
    ]


def rolling_flags(keys=("close",), windows=(3, 5, 10)):
    """{key}_mean{n}, {key}_is_max{n}, {key}_is_min{n}, {key}_above{n}, {key}_below{n}"""
    def one(k, n):
        return {
            f"{k}_mean{n}": S.ma(k, n),
            f"{k}_is_max{n}": fn.sig(C(k) == S.hhv(k, n)).cast("int"),
            f"{k}_is_min{n}": fn.sig(C(k) == S.llv(k, n)).cast("int"),
            f"{k}_above{n}": fn.sig(C(k) > S.ma(k, n)).cast("int"),
            f"{k}_below{n}": fn.sig(C(k) < S.ma(k, n)).cast("int"),
        }

    return [lambda: {name: c for k in keys for n in windows for name, c in one(k, n).items()}]


def range_position(keys=("close",), windows=(5, 10), flat=0.0):
    """{key}_pos{n}: place in the window's range; ``flat`` where the window is flat, 0 before it is full"""
    def one(k, n):
        lo, hi = S.llv(k, n), S.hhv(k, n)
        return F.when(hi == lo, flat).otherwise(F.coalesce(fn.div(C(k) - lo, hi - lo), F.lit(0.0)))

    return [lambda: {f"{k}_pos{n}": one(k, n) for k in keys for n in windows}]


def holiday_marks(gap=1, most=3, free_day=None):
    """pre1..pre3, post1..post3: bars before and after a gap of more than ``gap`` days

    What follows the last bar is not known yet: it counts as before a gap if ``free_day`` (a date; by default the
    next Saturday) is up to ``most`` days off, and the bars before it accordingly.
    """
    def before(i):
        last = F.max(C("ts").cast("date")).over(S.all)
        until = F.pmod(F.lit(5) - F.weekday(last), F.lit(7)) if free_day is None else F.datediff(F.lit(free_day).cast("date"), last)
        back = F.count("*").over(S.all) - C("rn")
        return F.coalesce(F.lead("_gap", i).over(S.w), F.lit(False)) | ((until <= most) & (back == i - until))

    return [
        lambda: {"_gap": fn.sig(F.datediff(C("ts"), F.lag("ts").over(S.w)) > gap)},
        lambda: {f"pre{i}": before(i) for i in range(1, most + 1)} | {f"post{i}": F.coalesce(F.lag("_gap", i - 1).over(S.w), F.lit(False)) for i in range(1, most + 1)},
    ]


def crossings(keys):
    """{a}_over_{b}, {a}_under_{b}: the sign of a - b turned, for each two of the columns"""
    def flags(a, b):
        before, now = S.ref(a) - S.ref(b), C(a) - C(b)
        return {f"{a}_over_{b}": fn.sig((before < 0) & (now > 0)).cast("int"), f"{a}_under_{b}": fn.sig((before > 0) & (now < 0)).cast("int")}

    return [lambda: {k: c for a, b in combinations(keys, 2) for k, c in flags(a, b).items()}]


def crossovers(keys=("close", "m3", "m5", "m10")):
    """Crossings of the price and its means of 3, 5 and 10 bars (m3, m5, m10)"""
    return [lambda: {f"m{n}": S.ma("close", n) for n in (3, 5, 10)}, *crossings(keys)]


def forward_returns(days=(1, 2, 3)):
    """fwd_open, fwd_high{d}, fwd_low{d}, fwd_close{d}: against the close, in %"""
    def over(x):
        return fn.div(x - C("close"), "close") * 100

    return [
        lambda: {"fwd_open": over(F.lead("open").over(S.w))}
        | {f"fwd_high{d}": over(F.max("high").over(S.w.rowsBetween(1, d))) for d in days}
        | {f"fwd_low{d}": over(F.min("low").over(S.w.rowsBetween(1, d))) for d in days}
        | {f"fwd_close{d}": over(F.lead("close", d).over(S.w)) for d in days}
    ]


def forward_high(days=(1, 2, 3)):
    """fwd_max{d}"""
    return [lambda: {f"fwd_max{d}": F.max("high").over(S.w.rowsBetween(1, d)) for d in days}]


def capture_rebound(n=10, drop=10):
    """rebound: well under the high before, a bar that falls and one that rises after it"""
    return [
        lambda: {"_top": S.hhv("high", n)},
        lambda: {"_fall": fn.half_even(fn.div(S.ref("_top") - C("close"), S.ref("_top")) * 100, 2), "_next": F.lead(C("close") > C("open")).over(S.w)},
        lambda: {"rebound": fn.sig((C("_fall") > drop) & (C("close") <= C("open")) & C("_next")).cast("int")},
    ]


def label_by_threshold(profit=5.0):
    """label1, label2, label3"""
    r = "fwd_high"
    return [*forward_returns(), lambda: {"label1": fn.sig(C(f"{r}1") >= profit), "label2": fn.sig(C(f"{r}2") >= profit), "label3": fn.sig((C(f"{r}1") < C(f"{r}2")) & (C(f"{r}1") < profit))}]


# -- over several series or dates ---------------------------------------------------------------


def market_performance(bars: DataFrame, levels=(0.5, 1, 2, 5, 10, 20)) -> DataFrame:
    """By ts: share of series whose forward high reaches each level (a missing one counts as no), and the share that rose."""
    rates = [F.avg(fn.sig(C(f"fwd_high{d}") >= p).cast("double")).alias(f"high{d}_{str(p).replace('.', '_')}") for d in (1, 2, 3) for p in levels]
    days = bars.groupBy("ts").agg(*rates, F.avg(fn.sig(C("chg") > 0).cast("double")).alias("rise"))
    # one row a date; the order over all dates is small however many series there are
    w = Window.orderBy("ts")
    return days.withColumns({"next_rise": F.lead("rise").over(w), "last_success": F.lag(f"high1_{str(levels[1]).replace('.', '_')}").over(w)})


def split_stratified(df: DataFrame, k: int = 10) -> DataFrame:
    """Deal the rows of each date to k parts in turn, by return."""
    w = Window.partitionBy("ts").orderBy("fwd_close1", "code")
    return df.withColumn("part", (F.row_number().over(w) - 1) % k)


def train_or_test(df: DataFrame, train_parts: int = 7) -> DataFrame:
    return df.withColumn("train", C("part") < train_parts)


def market_regime_split(df: DataFrame, performance: DataFrame, rate: float, level: str = "high1_1") -> DataFrame:
    """Rows with ``bad`` for those of dates whose success was at most the rate."""
    return df.join(performance.select("ts", (C(level) <= rate).alias("bad")), "ts")


def money_flow_metrics(flow: DataFrame, sizes=("s", "m", "l", "xl")) -> DataFrame:
    """Long (code, date, size, net) to one row a day: total, share of the largest, 3- and 5-day sums and changes by size."""
    wide = flow.groupBy("code", "date").agg(*[F.sum(F.when(C("size") == s, C("net"))).alias(f"net_{s}") for s in sizes])
    wide = wide.na.fill(0.0, [f"net_{s}" for s in sizes])
    w = Window.partitionBy("code").orderBy("date")
    sums = {f"sum{n}_{s}": F.when(F.count("*").over(w.rowsBetween(1 - n, 0)) >= n, F.sum(f"net_{s}").over(w.rowsBetween(1 - n, 0))) for s in sizes for n in (3, 5)}
    total = sum((F.abs(f"net_{s}") for s in sizes), F.lit(0.0))
    out = wide.withColumns({"gross": total, "largest": fn.div(F.greatest(*[F.abs(f"net_{s}") for s in sizes]), total)} | sums)
    return out.withColumns({f"chg_{s}": C(f"net_{s}") - F.lag(f"net_{s}").over(w) for s in sizes} | {f"ratio35_{s}": fn.div(f"sum3_{s}", f"sum5_{s}") for s in sizes})


def profit_ratio_rank(df: DataFrame, x: str = "turnover") -> DataFrame:
    """rank: 1 + earlier rows of the series below today's value; rank_gain: against the row before.

    Counted in merges, n log n for a series of n rows; a row without a value has rank 1.
    """

    def kernel(values: dict, bounds: np.ndarray, rows) -> dict:
        rank = np.concatenate([counts_below(values[x][a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]) + 1
        gain = np.ma.masked_array(np.diff(rank, prepend=0), np.isin(np.arange(len(rank)), bounds[:-1]))
        return {"rank": rank, "rank_gain": gain}

    return by_series(df.select("code", "ts", "rn", x), [x], kernel, {"rank": "long", "rank_gain": "long"}).drop(x)
