"""Named screens: each a condition in SQL over prepared columns of bars; a NULL comparison counts as false.

``columns`` names the steps that prepare them: lags (p_ and p2_), means (ma5...), rolling extremes
(close_hi15, close_lo60...), MACD columns, Bollinger gap, Williams ratio, operating lines.
"""

from __future__ import annotations

import re
from operator import sub

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import series as fn
from ..functions.series import Series
from ..functions.steps import with_steps
from . import indicators as ind

S = Series()

SCREENS: dict[str, str] = {
    "buy_1": "bar_min20 = bar and p_bar < 0 and close > open and close < ma10 and close < ma40 and p_chg <= 0 and chg <= 0 and p_chg >= -0.9 * limit_rate and turnover > 0.5 and close_hi15 - close > 0.1 * close",
    "buy_3": "abs(open - close) > 1.5 * abs(p_open - p_close) and chg < 0 and p_chg < 0",
    "buy_4": "boll_gap_hi3 > 0 and close > open and p_chg < 0 and p_close <= p_open",
    "buy_5": "boll_gap_hi3 > 0 and close > open and turnover > 0.5 and bar_min5 = bar",
    "buy_6": "true",
    "buy_7": "turnover > 0.5 and close_hi15 - close < 0.1 * close and p_volume - volume > volume",
    "buy_8": "bar_min20 * 0.97 >= p_bar and turnover > 0.5 and close_hi10 - close > 0.1 * close",
    "buy_weekly_8": "bar > 0 and bar_min5 = bar and p_chg < 0 and close > ma40 and (bar - p_bar) * 1.2 > p_bar - p2_bar and (bar - p_bar) - (p_bar - p2_bar) >= 0.01",
    "buy_9": "bar_min20 * 0.9 >= p_bar and p_bar < 0 and close <= bar_low20_price and close > open and close < ma10 and close < ma40 and p_chg <= 0 and chg <= 0 and p_chg >= -0.9 * limit_rate and turnover > 0.5 and close_hi15 - close > 0.1 * close",
    "buy_10": "p_close >= high and wr1 >= 95 and turnover > 0.5 and low >= p_low",
    "buy_11": "(p_volume + p2_volume) / 2 - volume > volume",
    "monthly_1": "bar_min3 = bar and turnover > 10 and bar - p_bar > p_bar - p2_bar",
    "monthly_2": "macd_gap < 0 and macd_gap_rate < 0 and macd_gap_body_rate < 0",
    "daily_1": "rn > 100 and close = ll and turnover > 0.5",
    "daily_2": "rn > 100 and p_close = ll and (chg >= 0 or close >= open) and turnover > 0.5",
    "daily_3": "slow_line < 3 and surge and p_chg > -0.8 * limit_rate and chg > -0.8 * limit_rate and turnover > 0.5",
    "daily_4": "close = close_lo60 and close > open and chg > -5 and turnover > 0.5",
    "daily_5": "p_j < 0 and j >= 0 and turnover > 0.5",
    "daily_6": "p_trend_class = 3 and trend_class = 2 and turnover > 0.5",
    "daily_7": "rn > 200 and m50 > p_m50 and close < p_close * 0.97 and low <= m50 * 1.03 and close >= m50 * 0.98 and close = close_lo3 and close > p_close * 0.9 and high < p_high + 0.07",
    "daily_8": "turnover > p_turnover * 1.3 and open >= close and close - p_close < -0.06 * p_close",
    "daily_12": "close <= close_lo40 and amount < p_amount_ma5 / 2",
    "daily_13": "chg >= -9.8 and chg <= -8 and close < ma5",
    "daily_14": "(open - close) * 4 < close - low and open - close > 0 and turnover > 0.5",
    "daily_15": "open = low and close > open and turnover > 0.5 and bar = bar_min10 and chg < 5 and bar < 0",
    "daily_16": "close = low and turnover > 0.5 and close = close_lo20",
    "daily_17": "bar = bar_min10 and abs_bar = abs_bar_max10 and p_macd_gap - 0.01 > macd_gap and p_macd_gap < 0 and chg > -9 and p_open - p_close > 0",
    "daily_18": "macd_gap < 0 and p_macd_gap > macd_gap",
    "daily_19": "open - close > 2 * (p_open - p_close) and open > close and open - close > 0.04 * close",
    "daily_20": "high < p_close and chg > -0.8 * limit_rate",
    "daily_21": "chg >= -0.5 and chg <= 0.5",
    "daily_22": "high - low > limit_rate * 0.01 * close",
    "daily_23": "abs(open - p_close) < 0.01 + 0.001 * p_close and abs(p_open - close) < 0.01 + 0.001 * p_close",
    "daily_29": "p_chg > 9.5 and low < 0.905 * p_close and ts > timestamp '2023-01-01 00:00:00'",
    "daily_30": "limit_rate > 0 and low <= p_close * 0.95 * 0.9 and close > open and close > 2",
    "daily_31": "limit_rate > 0 and p_chg > 0.95 * limit_rate and close > open and p_close < open and chg < 5",
    "can_not_buy": "chg >= 0.95 * limit_rate",
    "true": "chg < 0.95 * limit_rate",
}
SCREENS["buy_1_7"] = f"({SCREENS['buy_1']}) and p_volume - volume > volume"
SCREENS["monthly_1_2"] = f"({SCREENS['monthly_1']}) and ({SCREENS['monthly_2']})"


#: Steps that a screen needs only if it names one of their columns.
GROUPS = (
    (("bar", "p_bar", "p2_bar", "bar_low20_price", "abs_bar", "macd_gap", "p_macd_gap", "macd_gap_rate", "macd_gap_body_rate", "boll_gap_hi3", "bar_min3", "bar_min5", "bar_min10", "bar_min20", "abs_bar_max10"), ind.bar_columns),
    (("wr1",), ind.wr),
    (("slow_line", "surge"), ind.operating_lines),
    (("j", "p_j"), ind.kdj),
    (("m50", "p_m50"), lambda: [lambda: {"m50": folds.ema("close", 50)}]),
)


def columns(condition: str):
    """Steps that prepare what a condition reads."""
    words = set(re.findall(r"[a-z_0-9]+", condition))
    lagged = ("open", "high", "low", "close", "chg", "volume", "turnover")
    C = F.col
    groups = [make for names, make in GROUPS if words & set(names)]
    bar, j, m50 = (any(words & set(GROUPS[k][0]) for k in ks) for ks in ((0,), (3,), (4,)))
    return [
        *[step for make in groups for step in make()],
        lambda: {f"p_{c}": S.ref(c) for c in lagged}
        | {"p2_volume": S.ref("volume", 2)}
        | ({"p_bar": S.ref("bar"), "p2_bar": S.ref("bar", 2), "p_macd_gap": S.ref("macd_gap")} if bar else {})
        | ({"p_j": S.ref("j")} if j else {})
        | ({"p_m50": S.ref("m50")} if m50 else {})
        | {f"ma{n}": S.ma("close", n) for n in (5, 10, 40)}
        | {f"close_hi{n}": S.hhv("close", n) for n in (10, 15)}
        | {f"close_lo{n}": S.llv("close", n) for n in (3, 20, 40, 60)}
        | ({f"bar_min{n}": S.llv("bar", n) for n in (3, 5, 10, 20)} | {"abs_bar_max10": S.hhv("abs_bar", 10), "boll_gap_hi3": S.hhv("boll_gap", 3)} if bar else {})
        | {"ll": F.min("low").over(S.upto), "amount_ma5": S.ma("amount", 5), "low20": S.ma("low", 20), "high20": S.ma("high", 20)},
        lambda: {
            "p_amount_ma5": S.ref("amount_ma5"),
            "trend_class": F.when((C("close") > C("low20") * 1.1) & (C("close") <= C("low20") * 1.2), 3)
            .when((C("close") > C("high20") * 0.9) & (C("close") <= C("low20") * 1.1), 2)
            .when(C("close") < C("high20") * 0.8, 0)
            .when(C("close") > C("low20") * 1.2, 4)
            .otherwise(1),
        },
        lambda: {"p_trend_class": S.ref("trend_class")},
    ]


def screen(name: str) -> Column:
    return F.expr(f"coalesce({SCREENS[name]}, false)")


def prepared(bars: DataFrame, name: str) -> DataFrame:
    return with_steps(bars, columns(SCREENS[name]))


def delayed(buy: str = "buy") -> Column:
    """The signal of the bar before."""
    return F.coalesce(S.ref(buy), F.lit(False))


# -- screens with steps of their own --------------------------------------------------------------


def _lagged(**lags: int):
    return lambda: {f"{c}{k}": S.ref(c, k) for c, n in lags.items() for k in range(1, n + 1)}


def daily_24():
    """Well under the adaptive line, open rising towards it, in a falling market."""
    C = F.col
    return [
        *ind.adaptive_line(),
        lambda: {"od": F.coalesce(fn.quotient("open", "adaptive"), F.lit(0.0)) * 100, "cd": F.coalesce(fn.quotient("close", "adaptive"), F.lit(0.0)) * 100, "ma40": S.ma("close", 40)},
        lambda: {"od1": S.ref("od")},
        _lagged(chg=1, open=1, close=1),
        lambda: {"buy": F.expr("coalesce(od < 96 and od > od1 and close < ma40 and chg < 0 and turnover > 0.5 and chg1 < 0 and cd < 96 and chg > -0.95 * limit_rate and open1 > close1, false)")},
    ]


def daily_26():
    """A pullback in nine parts: inside the last range, above the long mean, with a growing range and a weak close."""
    C = F.col
    return [
        lambda: {"hi20": S.hhv("high", 20), "lo10": S.llv("low", 10), "lo3": S.llv("low", 3), "ma18": S.ma("close", 18), "ma20": S.ma("close", 20), "tr": F.when(C("prev_close").isNotNull(), ind.true_range())},
        lambda: {"tr14": S.ma("tr", 14), "line": (C("high") + C("low")) / 2 - S.ma("tr", 2)},
        lambda: {"line3": S.hhv("line", 3)},
        _lagged(hi20=1, lo10=1, lo3=1, ma20=1, tr=1, tr14=1),
        lambda: {
            "buy": F.expr(
                "coalesce(chg < 0.95 * limit_rate and low > lo101 and high < hi201 and rn > 31 and close < line3 and close < prev_close and close < open and close != low and close > ma18"
                " and ma20 > ma201 and close < lo31 and tr14 > tr141 and tr > tr1 and close - low < 0.3 * (high - low), false)"
            )
        },
    ]


def daily_27():
    """Two patterns of a fall after mixed bars."""
    C = F.col
    return [
        lambda: {"e5": folds.ema("close", 5)},
        lambda: {"ma14": S.ma("close", 14), "v16": S.llv("volume", 16)},
        _lagged(open=3, close=3, high=3, volume=3),
        lambda: {
            "buy": F.expr(
                "coalesce(open3 < close3 and open2 < close2 and open1 > close1 and open > close and close < 1.098 * close1 and close1 >= 1.03 * close and close < 1.03 * low and high < high1"
                " and close - low < (open - close) * 0.6 and close1 < 1.0995 * close2 and volume < v16 * 9.5 and high1 < 1.07 * close and high - open > close - low and high3 > 1.011 * least(open3, close3)"
                " and close2 < close1 * 1.01 and close - low > 0.03 * (high - low) and close - low < 0.3 * (high - low), false)"
                " or coalesce(open3 > close3 and open2 > close2 and open1 < close1 and open > close and close1 >= 1.03 * close and close < 1.03 * low and volume < volume3 * 1.2 and volume > volume3 * 0.9"
                " and high < high1 and e5 > ma14 * 1.017, false)"
            )
        },
    ]


def daily_28(level: float = 95.0):
    """The price's distance from the mean paid crosses a level from below."""
    C = F.col
    return [
        lambda: {"ea": folds.ema("amount", 13), "ev": folds.ema("volume", 13)},
        lambda: {"paid": F.try_divide(C("ea"), C("ev"))},
        lambda: {"far": F.try_divide(C("close") - C("paid"), C("paid")) * 1000},
        lambda: {"buy": F.coalesce((C("chg") < C("limit_rate") * 0.95) & (S.ref("far") < level) & (C("far") >= level), F.lit(False))},
    ]


def _adjusted(n: int):
    """Factor of each bar for a mean with weights (1 - a)^k over all bars so far, a = 2 / (n + 1)."""
    a = 2 / (n + 1)
    return F.lit(a) / (1 - F.pow(F.lit(1 - a), F.col("rn")))


def daily_9():
    """Oversold against the long means after wide bars, unless a rise has already followed."""
    C = F.col
    return [
        lambda: {"_x3": fn.sig(C("high") > C("low") * 1.052), "_low": fn.sig(fn.quotient("close", S.ma("close", 60)) * 100 < 75) | fn.sig(fn.quotient("close", S.ma("close", 40)) * 100 < 80), "_a5": _adjusted(5)},
        lambda: {"_x6": C("_x3") & fn.sig(S.count("_x3", 5) > 1) & C("_low") & ~((C("close") == C("low")) & (C("high") == C("low")))},
        lambda: {"_e5": folds.dma("close", "_a5")},
        lambda: {"buy": C("_x6") & ~((C("close") > C("open")) & S.exist("_x6", 10) & fn.sig(C("_e5") > S.ref("_e5")))},
    ]


def daily_10():
    """Far under several means at once, at most once in ten bars."""
    C = F.col

    def far(n):
        return fn.quotient(C("close") - S.ma("close", n), S.ma("close", n))

    return [
        lambda: {"_b27": far(27) * 100, "_b21": far(21), "_b28": far(28) * 100, "_typical": (C("close") + C("low") + C("high")) / 3, "_a3": _adjusted(3), "_a26": _adjusted(26), "_c10": S.llv("close", 10), "_l10": S.llv("low", 10)},
        lambda: {"_t3": folds.dma("_typical", "_a3"), "_t26": folds.dma("_t3", "_a26")},
        lambda: {"_x3": S.ma("_b27", 2), "_x9": S.ma("_b21", 3) * 100},
        lambda: {"_up": fn.sig((S.ref("_x3") < -10) & (C("_x3") > -10))},
        # the crossing before the last one, counted from the start of the series
        lambda: {"_prev": F.coalesce(F.last(F.when(C("_up"), C("rn")), True).over(S.w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))},
        lambda: {"_second": F.coalesce(F.last(F.when(C("_up"), C("_prev")), True).over(S.upto), F.lit(0))},
        lambda: {
            "_all": fn.sig(
                (C("_x3") < -10) & (C("_second") > 3) & (fn.quotient("close", C("_t26") * 0.9) < 0.95) & (C("_x9") < -15) & (C("_b28") < -23)
                & (fn.quotient("close", S.ref("_c10")) < 0.96) & (fn.quotient("low", S.ref("_l10")) < 0.99) & (C("close") != C("low")) & (fn.quotient("close", "low") > 1.005)
            )
        },
        lambda: {"_before": F.last(F.when(C("_all"), C("rn")), True).over(S.w.rowsBetween(Window.unboundedPreceding, -1))},
        lambda: {"buy": C("_all") & F.coalesce(C("rn") - C("_before") >= 10, F.lit(True))},
    ]


def _rolling_max_by_key(df: DataFrame, x: str, width: str, out: str) -> DataFrame:
    """Maximum of x over the last ``width`` bars (one width for each series), NULL unless all of them have a value.

    Blocks of that width: a window is the end of one block and the start of the next, so two running maxima
    and an equi-join on the row number give it for any width.
    """
    C = F.col
    block = df.withColumn("_block", F.floor((C("rn") - 1) / C(width)))
    w = Window.partitionBy("code", "_block").orderBy("rn")
    block = block.withColumns({"_head": F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_tail": F.max(x).over(w.rowsBetween(0, Window.unboundedFollowing)), "_known": F.count(x).over(S.upto)})
    other = block.select(C("code"), (C("rn") + C(width) - 1).alias("rn"), C("_tail").alias("_from"), C("_known").alias("_known_from"), C(x).isNotNull().alias("_has"))
    joined = block.join(other, ["code", "rn"], "left")
    full = C("_known") - C("_known_from") + C("_has").cast("int") == C(width)
    return joined.withColumn(out, F.when(full, F.greatest("_head", "_from"))).drop("_block", "_head", "_tail", "_known", "_from", "_known_from", "_has")


def daily_11(bars: DataFrame) -> DataFrame:
    """bars with ``buy``: a weak close over a rising mean, within a channel of the true range whose width depends on the whole series."""
    C = F.col
    df = with_steps(
        bars,
        [
            lambda: {"_tr": F.greatest(C("high") - C("low"), F.abs(C("prev_close") - C("high")), F.abs(C("prev_close") - C("low")))},
            lambda: {"_x2": (C("high") + C("low")) / 2 + S.ma("_tr", 2), "_x3": (C("high") + C("low")) / 2 - S.ma("_tr", 2)},
            lambda: {"_x4": F.when(C("_x2") <= S.ref("_x2"), S.ref("_x2")), "_x5": S.llv("_x2", 3)},
            lambda: {"_x6": F.when(F.coalesce(C("_x5") != S.ref("_x5"), F.lit(True)) & fn.sig(C("_x4") < S.ref("_x4")), C("_x4")).otherwise(C("_x5"))},
            lambda: {"_on": fn.sig(C("_x2") == C("_x6")).cast("int"), "_cross": fn.sig(((C("prev_close") < C("_x6")) & (C("close") > C("_x6"))) | ((C("prev_close") > C("_x6")) & (C("close") < C("_x6")))).cast("int")},
            lambda: {"_x7": F.coalesce(S.total("_on", 2), F.lit(0))},
            lambda: {"_x8": F.when(C("_x7") > 0, C("_cross")).otherwise(0) + F.when(C("_x7") > 1, F.coalesce(S.ref("_cross"), F.lit(0))).otherwise(0)},
            lambda: {"_x9": F.coalesce(F.datediff("ts", F.last(F.when(C("_x8") > 0, C("ts")), True).over(S.upto)), F.lit(0))},
            lambda: {"_width": F.max("_x9").over(S.all) + 1},
        ],
    )
    df = _rolling_max_by_key(df, "_x3", "_width", "_top")
    return with_steps(
        df,
        [
            lambda: {"_x10": F.sum(fn.sig(C("_top") > C("close")).cast("int")).over(S.upto), "_m18": S.ma("close", 18), "_l3": S.llv("low", 3), "_x15": F.when(C("close") < C("open"), F.try_divide(C("close") - C("low"), C("high") - C("low"))).otherwise(0.0)},
            lambda: {
                "buy": fn.sig(
                    (C("_x9") < C("_x10")) & (fn.quotient("close", S.ref("_l3")) < 1) & (C("close") < C("open")) & (C("close") != C("low"))
                    & (C("close") >= C("_m18") * 1.004) & (C("_m18") >= S.ref("_m18")) & (C("_x15") > 0.03) & (C("_x15") < 0.3)
                )
            },
        ],
    )


SPANS = (4, 6, 9, 13, 18, 24)


def daily_25():
    """Six blended means draw together and the price breaks out of them on volume."""
    C = F.col

    def fold_over(f, xs):
        out = xs[0]
        for x in xs[1:]:
            out = f(out, x)
        return out

    def pb():
        return [C(f"_pb{n}") for n in SPANS]

    def spread():
        return sum((F.abs(a - b) for i, a in enumerate(pb()) for b in pb()[i + 1 :]), F.lit(0.0))

    return [
        lambda: {f"_e{n}": folds.ema("close", n) for n in SPANS},
        lambda: {f"_pb{n}": (C(f"_e{n}") + S.ma("close", 2 * n) + S.ma("close", 4 * n)) / 3 for n in SPANS} | {"_m60": S.ma("close", 60), "_v5": S.ma("volume", 5), "_v60": S.ma("volume", 60)},
        lambda: {"_lowest": fold_over(fn.least, pb()), "_highest": fold_over(fn.greatest, pb()), "_lb": fn.div("volume", S.ref("_v5")), "_near": fn.sig(fn.quotient(spread(), "close") < 0.2)},
        lambda: {"_xg": (fn.sig(C("open") < C("_lowest")) | fn.sig(S.ref("open") < C("_lowest"))) & fn.sig(C("close") > C("_highest")), "_loud": fn.sig(C("_lb") > 2.2)},
        lambda: {
            "_jl": fn.sig((C("close") > C("_m60")) & (C("_v5") > C("_v60") * 0.9) & (C("close") > C("_m60") * 1.02) & (C("close") < C("_m60") * 1.15) & (C("close") > C("open") * 1.02) & (fn.quotient("close", "prev_close") - 1 > 0.03))
            & (C("_loud") | fn.sig(S.ref("_loud"))) & (C("_xg") | fn.sig(S.ref("_xg"))) & (C("_near") | fn.sig(S.ref("_near")))
        },
        lambda: {
            "buy": fn.sig(C("chg") < C("limit_rate") * 0.95)
            & (((C("_jl") | fn.sig(S.ref("_jl"))) & fn.sig(C("close") > C("_pb4") * 0.88)) | (C("_xg") & C("_loud") & fn.sig((C("close") > C("_m60") * 1.02) & (C("close") < C("_m60") * 1.15))))
        },
    ]


def select_stocks():
    """Entry of a slow line under a fast one, or a turn of the smoothed range position; columns of the parts, ``bottom`` and ``buy``.

    As computed by the rule's own text: a comparison with the bars since the last crossing of the lines binds
    tighter than its conditions, so ``entry`` only fails on a bar that crosses both ways at a low slow line.
    """
    C = F.col

    def place(n):
        lo, hi = S.llv("low", n), S.hhv("high", n)
        return fn.div(C("close") - lo, hi - lo) * 100

    return [
        lambda: {"_e5": folds.ema("close", 5), "_e340": folds.ema("close", 340), "v1": folds.of(sub, "_e5", "_e340"), "v2": folds.ema("v1", 144)},
        lambda: {"v3": place(27), "fast": place(9), "_fall": F.abs(C("low") - S.ref("low")), "_rise": F.when(S.ref("low").isNotNull(), F.greatest(C("low") - S.ref("low"), F.lit(0.0))), "_l34": S.llv("low", 34)},
        lambda: {
            "_sf": folds.sma_cn("_fall", 13), "_sr": folds.sma_cn("_rise", 13), "_m2": folds.of(lambda a, b: a / b * 4, "_sf", "_sr"), "_m3": folds.ema("_m2", 13),
            "slow": folds.sma_cn("fast", 3), "_s5": folds.sma_cn("v3", 5), "_s53": folds.sma_cn("_s5", 3), "turn": folds.of(lambda a, b: 3 * a - 2 * b, "_s5", "_s53"),
        },
        lambda: {"_at": F.when(C("low") <= C("_l34"), C("_m3")).otherwise(0.0)},
        lambda: {"_m5": folds.ema("_at", 3)},
        lambda: {"main": fn.sig(C("_m5") > S.ref("_m5")), "_over": fn.sig((S.ref("slow") < C("fast")) & (C("slow") > C("fast"))), "_under": fn.sig((S.ref("fast") < C("slow")) & (C("fast") > C("slow")) & (C("slow") < 30))},
        lambda: {"main20": F.when(F.count("*").over(S.past(20)) >= 20, F.sum(C("main").cast("int")).over(S.past(20))), "_since": S.barslast("_over"), "gup": F.when(fn.sig((S.ref("v3") < 5) & (C("v3") > 5) & (C("v1") < C("v2"))), 40).otherwise(20)},
        lambda: {"entry": C("_since") >= C("_under").cast("int"), "bottom": fn.sig((S.ref("turn") < 3) & (C("turn") > 3))},
        lambda: {"buy": C("entry") | C("bottom")},
    ]
