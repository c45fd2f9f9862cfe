"""Technical indicators over bars (code, ts, open, high, low, close, volume, amount, prev_close, rn).

Each function gives the steps for ``with_steps``; results are columns of the names in its docstring,
intermediate ones begin with an underscore. NULL appears until a window is full or a divisor is not zero.
"""

from __future__ import annotations

from operator import sub

from pyspark.sql import functions as F

from ..functions import folds
from ..functions import series as fn
from ..functions.series import Series

C = F.col
S = Series()


def _dx(t, up, down):
    """Directional index of a row: 0 where both directions are 0 or missing, NULL before there is a range."""
    return None if t is None else 0.0 if up is None or down is None or not up + down else abs(up - down) * 100 / (up + down)


def macd(short=12, long=26, m=9):
    """dif, dea, macd"""
    return [
        lambda: {"_short": folds.ema("close", short), "_long": folds.ema("close", long), "dif": folds.of(sub, "_short", "_long"), "dea": folds.ema("dif", m)},
        lambda: {"macd": (C("dif") - C("dea")) * 2},
    ]


def kdj(n=9, m1=3, m2=3):
    """k, d, j"""
    return [
        lambda: {"_low": S.llv("low", n), "_high": S.hhv("high", n)},
        lambda: {"_rsv": fn.div(C("close") - C("_low"), C("_high") - C("_low")) * 100},
        lambda: {"k": folds.ema("_rsv", 2 * m1 - 1), "d": folds.ema("k", 2 * m2 - 1)},
        lambda: {"j": C("k") * 3 - C("d") * 2},
    ]


def rsi(n=24):
    """rsi"""
    return [
        lambda: {"_d": C("close") - C("prev_close")},
        lambda: {"_up": F.when(C("_d").isNotNull(), F.greatest(C("_d"), F.lit(0.0))), "_move": F.abs("_d")},
        lambda: {"_a": folds.sma_cn("_up", n), "_b": folds.sma_cn("_move", n)},
        lambda: {"rsi": fn.div("_a", "_b") * 100},
    ]


def wr(n=10, m=6):
    """wr1, wr2"""
    def one(k):
        return fn.div(S.hhv("high", k) - C("close"), S.hhv("high", k) - S.llv("low", k)) * 100

    return [lambda: {"wr1": one(n), "wr2": one(m)}]


def bias(*ns):
    """bias1, bias2, ..."""
    return [lambda: {f"bias{i}": fn.div(C("close") - S.ma("close", n), S.ma("close", n)) * 100 for i, n in enumerate(ns or (6, 12, 24), 1)}]


def boll(n=20, p=2):
    """boll_mid, boll_up, boll_low"""
    return [lambda: {"boll_mid": S.ma("close", n), "boll_up": S.ma("close", n) + S.std("close", n) * p, "boll_low": S.ma("close", n) - S.std("close", n) * p}]


def psy(n=12, m=6):
    """psy, psyma"""
    return [lambda: {"_c": fn.sig(C("close") > C("prev_close"))}, lambda: {"psy": S.count("_c", n) / n * 100}, lambda: {"psyma": S.ma("psy", m)}]


def cci(n=14):
    """cci"""
    return [lambda: {"_tp": (C("high") + C("low") + C("close")) / 3}, lambda: {"cci": fn.div(C("_tp") - S.ma("_tp", n), S.avedev("_tp", n) * 0.015)}]


def true_range():
    return F.greatest(C("high") - C("low"), F.abs(C("prev_close") - C("high")), F.abs(C("prev_close") - C("low")))


def atr(n=20):
    """atr; a bar without one before it has no range"""
    return [lambda: {"_tr": F.when(C("prev_close").isNotNull(), true_range())}, lambda: {"atr": S.ma("_tr", n)}]


def bbi(*ns):
    """bbi"""
    ns = ns or (3, 6, 12, 20)
    return [lambda: {"bbi": sum((S.ma("close", n) for n in ns), F.lit(0.0)) / len(ns)}]


def dmi(m1=14, m2=6):
    """pdi, mdi, adx, adxr"""
    return [
        lambda: {"_tr": F.when(C("prev_close").isNotNull(), true_range()), "_hd": S.diff("high"), "_ld": -S.diff("low")},
        lambda: {
            "_dp": F.when(fn.sig((C("_hd") > 0) & (C("_hd") > C("_ld"))), C("_hd")).otherwise(0.0),
            "_dm": F.when(fn.sig((C("_ld") > 0) & (C("_ld") > C("_hd"))), C("_ld")).otherwise(0.0),
        },
        lambda: {"_t": S.total("_tr", m1), "_p": S.total("_dp", m1), "_m": S.total("_dm", m1)},
        lambda: {"pdi": fn.div(C("_p") * 100, "_t"), "mdi": fn.div(C("_m") * 100, "_t")},
        lambda: {"_dx": fn.div(F.abs(C("mdi") - C("pdi")), C("pdi") + C("mdi")) * 100},
        lambda: {"adx": S.ma("_dx", m2)},
        lambda: {"adxr": (C("adx") + S.ref("adx", m2)) / 2},
    ]


def taq(n=20):
    """taq_up, taq_mid, taq_down"""
    return [lambda: {"taq_up": S.hhv("high", n), "taq_mid": (S.hhv("high", n) + S.llv("low", n)) / 2, "taq_down": S.llv("low", n)}]


def ktn(n=20, m=10):
    """ktn_up, ktn_mid, ktn_down"""
    return [
        *atr(m),
        lambda: {"_mid": (C("high") + C("low") + C("close")) / 3},
        lambda: {"ktn_mid": folds.ema("_mid", n)},
        lambda: {"ktn_up": C("ktn_mid") + C("atr") * 2, "ktn_down": C("ktn_mid") - C("atr") * 2},
    ]


def trix(m1=12, m2=20):
    """trix, trma"""
    return [
        lambda: {"_e1": folds.ema("close", m1), "_e2": folds.ema("_e1", m1), "_e3": folds.ema("_e2", m1)},
        lambda: {"trix": fn.div(C("_e3") - S.ref("_e3"), S.ref("_e3")) * 100},
        lambda: {"trma": S.ma("trix", m2)},
    ]


def vr(n=26):
    """vr"""
    return [
        lambda: {"_u": F.when(fn.sig(C("close") > C("prev_close")), C("volume")).otherwise(0.0), "_n": F.when(fn.sig(C("close") <= C("prev_close")), C("volume")).otherwise(0.0)},
        lambda: {"vr": fn.div(S.total("_u", n), S.total("_n", n)) * 100},
    ]


def cr(n=20):
    """cr"""
    return [
        lambda: {"_mid": S.ref("high") + S.ref("low") + S.ref("close")},
        lambda: {"_mid": C("_mid") / 3},
        lambda: {"_a": F.when(C("_mid").isNotNull(), F.greatest(F.lit(0.0), C("high") - C("_mid"))), "_b": F.when(C("_mid").isNotNull(), F.greatest(F.lit(0.0), C("_mid") - C("low")))},
        lambda: {"cr": fn.div(S.total("_a", n), S.total("_b", n)) * 100},
    ]


def emv(n=14, m=9):
    """emv, maemv"""
    return [
        lambda: {"_v": fn.div(S.ma("volume", n), "volume"), "_mid": fn.div((C("high") + C("low") - S.ref("high") - S.ref("low")) * 100, C("high") + C("low")), "_range": C("high") - C("low")},
        lambda: {"_e": fn.div(C("_mid") * C("_v") * C("_range"), S.ma("_range", n))},
        lambda: {"emv": S.ma("_e", n)},
        lambda: {"maemv": S.ma("emv", m)},
    ]


def dpo(m1=20, m2=10, m3=6):
    """dpo, madpo"""
    return [lambda: {"_m": S.ma("close", m1)}, lambda: {"dpo": C("close") - S.ref("_m", m2)}, lambda: {"madpo": S.ma("dpo", m3)}]


def brar(n=26):
    """ar, br"""
    def over(x):
        return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))

    return [
        lambda: {"_ho": C("high") - C("open"), "_ol": C("open") - C("low"), "_hp": over(C("high") - C("prev_close")), "_pl": over(C("prev_close") - C("low"))},
        lambda: {"ar": fn.div(S.total("_ho", n), S.total("_ol", n)) * 100, "br": fn.div(S.total("_hp", n), S.total("_pl", n)) * 100},
    ]


def dfma(n1=10, n2=50, m=10):
    """dma_dif, dma_ma"""
    return [lambda: {"dma_dif": S.ma("close", n1) - S.ma("close", n2)}, lambda: {"dma_ma": S.ma("dma_dif", m)}]


def mtm(n=12, m=6):
    """mtm, mtmma"""
    return [lambda: {"mtm": S.diff("close", n)}, lambda: {"mtmma": S.ma("mtm", m)}]


def mass(n1=9, n2=25, m=6):
    """mass, ma_mass"""
    return [
        lambda: {"_range": C("high") - C("low")},
        lambda: {"_m": S.ma("_range", n1)},
        lambda: {"_r": fn.div("_m", S.ma("_m", n1))},
        lambda: {"mass": S.total("_r", n2)},
        lambda: {"ma_mass": S.ma("mass", m)},
    ]


def roc(n=12, m=6):
    """roc, maroc"""
    return [lambda: {"roc": fn.div(S.diff("close", n), S.ref("close", n)) * 100}, lambda: {"maroc": S.ma("roc", m)}]


def expma(n1=12, n2=50):
    """expma1, expma2"""
    return [lambda: {"expma1": folds.ema("close", n1), "expma2": folds.ema("close", n2)}]


def obv():
    """obv: signed volume summed, in ten thousands"""
    return [lambda: {"_s": F.when(fn.sig(C("close") > C("prev_close")), C("volume")).when(fn.sig(C("close") < C("prev_close")), -C("volume")).otherwise(0.0)}, lambda: {"obv": S.total("_s") / 10000}]


def mfi(n=14):
    """mfi"""
    return [
        lambda: {"_tp": (C("high") + C("low") + C("close")) / 3},
        lambda: {"_up": F.when(fn.sig(C("_tp") > S.ref("_tp")), C("_tp") * C("volume")).otherwise(0.0), "_dn": F.when(fn.sig(C("_tp") < S.ref("_tp")), C("_tp") * C("volume")).otherwise(0.0)},
        lambda: {"_v": fn.div(S.total("_up", n), S.total("_dn", n))},
        lambda: {"mfi": F.lit(100.0) - fn.div(F.lit(100.0), C("_v") + 1)},
    ]


def asi(m1=26, m2=10):
    """asi, asit"""
    return [
        lambda: {"_a": F.abs(C("high") - C("prev_close")), "_b": F.abs(C("low") - C("prev_close")), "_c": F.abs(C("high") - S.ref("low")), "_d": F.abs(C("prev_close") - S.ref("open"))},
        lambda: {
            "_r": F.when((C("_a") > C("_b")) & (C("_a") > C("_c")), C("_a") + C("_b") / 2 + C("_d") / 4)
            .when((C("_b") > C("_c")) & (C("_b") > C("_a")), C("_b") + C("_a") / 2 + C("_d") / 4)
            .otherwise(C("_c") + C("_d") / 4),
            "_x": C("close") - C("prev_close") + (C("close") - C("open")) / 2 + C("prev_close") - S.ref("open"),
        },
        lambda: {"_si": fn.div(C("_x") * 16, "_r") * F.greatest("_a", "_b")},
        lambda: {"asi": S.total("_si", m1)},
        lambda: {"asit": S.ma("asi", m2)},
    ]


def xsii(n=102, m=7):
    """xs1, xs2, xs3, xs4"""
    return [
        lambda: {"_aa": S.ma(C("close") * 2 + C("high") + C("low"), 5) / 4, "_m20": S.ma("close", 20)},
        lambda: {"_cc": fn.div(F.abs(C("close") * 2 + C("high") + C("low") - C("_m20") * 4), C("_m20") * 4)},
        lambda: {"_dd": folds.dma("close", "_cc")},
        lambda: {"xs1": C("_aa") * n / 100, "xs2": C("_aa") * (200 - n) / 100, "xs3": (1 + F.lit(m) / 100) * C("_dd"), "xs4": (1 - F.lit(m) / 100) * C("_dd")},
    ]


# -- published forms with seeded means ---------------------------------------------------------


def ema_seeded(n=40):
    """ema_s"""
    return [lambda: {"ema_s": folds.ema_seeded("close", n)}]


def macd_seeded(short=12, long=26, m=9):
    """dif_s, dea_s, macd_s: all from bar long + m - 2"""
    return [
        lambda: {"_short": folds.ema_seeded("close", short, long - short), "_long": folds.ema_seeded("close", long), "_dif": folds.of(sub, "_short", "_long"), "_dea": folds.ema_seeded("_dif", m)},
        lambda: {"dif_s": F.when(C("_dea").isNotNull(), C("_dif")), "dea_s": C("_dea"), "macd_s": C("_dif") - C("_dea")},
    ]


def rsi_wilder(n=14):
    """rsi_w"""
    return [
        lambda: {"_d": C("close") - C("prev_close")},
        lambda: {"_g": F.when(C("_d").isNotNull(), F.greatest(C("_d"), F.lit(0.0))), "_l": F.when(C("_d").isNotNull(), F.greatest(-C("_d"), F.lit(0.0)))},
        lambda: {"_ag": folds.wilder("_g", n), "_al": folds.wilder("_l", n)},
        lambda: {"rsi_w": F.when(C("_ag").isNotNull(), F.coalesce(fn.div(C("_ag") * 100, C("_ag") + C("_al")), F.lit(0.0)))},
    ]


def atr_wilder(n=14):
    """atr_w"""
    return [lambda: {"_tr": F.when(C("prev_close").isNotNull(), true_range())}, lambda: {"atr_w": folds.wilder("_tr", n)}]


def stoch(n=14, k=3, d=3):
    """slowk, slowd"""
    return [
        lambda: {"_lo": S.llv("low", n), "_hi": S.hhv("high", n)},
        lambda: {"_fast": F.when(C("_hi") == C("_lo"), 0.0).otherwise(fn.div((C("close") - C("_lo")) * 100, C("_hi") - C("_lo")))},
        lambda: {"_k": S.ma("_fast", k)},
        lambda: {"slowd": S.ma("_k", d)},
        lambda: {"slowk": F.when(C("slowd").isNotNull(), C("_k"))},
    ]


def willr(n=14):
    """willr"""
    return [lambda: {"_lo": S.llv("low", n), "_hi": S.hhv("high", n)}, lambda: {"willr": F.when(C("_hi") == C("_lo"), 0.0).otherwise(fn.div((C("_hi") - C("close")) * -100, C("_hi") - C("_lo")))}]


def cci_zero(n=14):
    """cci_z: 0 where the deviation is 0"""
    return [lambda: {"_tp": (C("high") + C("low") + C("close")) / 3}, lambda: {"_m": S.ma("_tp", n), "_ad": S.avedev("_tp", n)}, lambda: {"cci_z": F.when(C("_ad") == 0, 0.0).otherwise(fn.div(C("_tp") - C("_m"), C("_ad") * 0.015))}]


def obv_from_volume():
    """obv_v: starts at the first volume"""
    return [lambda: {"_s": F.when(C("rn") == 1, C("volume")).when(C("close") > C("prev_close"), C("volume")).when(C("close") < C("prev_close"), -C("volume")).otherwise(0.0)}, lambda: {"obv_v": S.total("_s")}]


def adx_wilder(n=14):
    """adx_w"""
    return [
        lambda: {"_tr": F.when(C("prev_close").isNotNull(), true_range()), "_hd": S.diff("high"), "_ld": -S.diff("low")},
        lambda: {
            "_dp": F.when(C("_hd").isNotNull(), F.when((C("_hd") > 0) & (C("_hd") > C("_ld")), C("_hd")).otherwise(0.0)),
            "_dm": F.when(C("_hd").isNotNull(), F.when((C("_ld") > 0) & (C("_ld") > C("_hd")), C("_ld")).otherwise(0.0)),
        },
        lambda: {
            "_t": folds.wilder("_tr", n),
            "_p": folds.wilder("_dp", n),
            "_m": folds.wilder("_dm", n),
            "_pdi": folds.of(lambda p, t: p * 100 / t, "_p", "_t"),
            "_mdi": folds.of(lambda p, t: p * 100 / t, "_m", "_t"),
            "_dx": folds.Fold(("_t", "_pdi", "_mdi"), lambda: _dx),
            "adx_w": folds.wilder("_dx", n),
        },
    ]


def sar(start=0.02, most=0.2):
    """sar"""
    return [lambda: {"sar": folds.sar("high", "low", start, most)}]


# -- other columns -------------------------------------------------------------------------------


def vwap_and_levels():
    """vwap, momentum, support, resistance, ll, ll60, max_close15"""
    return [
        lambda: {"_pv": C("close") * C("volume")},
        lambda: {
            "vwap": fn.div(S.total("_pv"), S.total("volume")),
            "momentum": S.diff("close", 14),
            "support": S.llv("low", 20),
            "resistance": S.hhv("high", 20),
            "ll": F.min("low").over(S.upto),
            "ll60": S.llv("low", 60),
            "max_close15": S.hhv("close", 15),
        },
    ]


def bar_columns():
    """bar, abs_bar, bar_low20, bar_low20_price, macd_gap, macd_gap_rate, macd_gap_body_rate, boll_gap"""
    return [
        *macd_seeded(),
        lambda: {"bar": C("macd_s") * 2},
        lambda: {
            "abs_bar": F.abs("bar"),
            "bar_low20": S.llv("bar", 20),
            "_low_price": F.min(F.when(C("bar").isNotNull(), F.struct(C("bar"), C("rn"), C("close")))).over(S.past(20))["close"],
            "_n20": F.count("bar").over(S.past(20)),
            "macd_gap": C("bar") - S.ref("bar"),
            "boll_gap": S.ma("close", 20) - S.std("close", 20) * 2 - C("close"),
        },
        lambda: {"bar_low20_price": F.when(C("_n20") >= 20, C("_low_price")), "macd_gap_rate": fn.div("chg", "macd_gap"), "macd_gap_body_rate": fn.div(C("close") - C("open"), "macd_gap")},
    ]


def operating_lines():
    """hxjz, bztd, surge, trend, trend_rate, q, slow_line"""
    weights = [26, *range(1, 27)]  # of the bar 0, 1, ... 26 ago

    return [
        lambda: {"_mid": (C("close") * 2 + C("high") + C("low")) / 4, "_lo": S.llv("close", 28), "_hi": S.hhv("close", 28), "q": (C("close") * 3 + C("low") + C("open") + C("high")) / 6},
        lambda: {"hxjz": S.ma("_mid", 5), "_t0": fn.div(C("close") - C("_lo"), C("_hi") - C("_lo")) * 100, "slow_line": sum((F.lag("q", k).over(S.w) * weights[k] for k in range(27)), F.lit(0.0)) / 351},
        lambda: {"bztd": C("hxjz") * 89 / 100, "_t1": S.ma("_t0", 2)},
        lambda: {"surge": fn.sig((S.ref("low") <= S.ref("bztd")) & (C("low") > C("bztd"))), "trend": S.ma("_t1", 2)},
        lambda: {"trend_rate": fn.div(S.ref("trend") - C("trend"), "trend")},
    ]


def pct_change():
    """pct"""
    return [lambda: {"pct": fn.div("close", "prev_close") - 1}]


def adaptive_line(n=10):
    """er, adaptive: an average over 1 to n bars, longer the more the price wanders"""
    def choice():
        size = F.greatest(F.coalesce(F.floor(F.lit(10) - C("_cs") * 10), F.lit(1)), F.lit(1)).cast("int")
        means = F.array(*[F.avg("close").over(S.past(k)) for k in range(1, n + 1)])
        return F.when(C("rn") - 1 >= size, F.element_at(means, size))

    return [
        lambda: {"_move": F.abs(C("close") - C("prev_close"))},
        lambda: {"_dir": F.abs(S.diff("close", n)), "_vir": S.total("_move", n)},
        lambda: {"er": fn.div("_dir", "_vir")},
        lambda: {"_x": C("er") * (2 / 3 - 2 / 14) + 2 / 14},
        lambda: {"_cs": folds.sma_cn("_x", 3)},
        lambda: {"_ma": choice()},
        lambda: {"adaptive": folds.ema("_ma", 2)},
    ]
