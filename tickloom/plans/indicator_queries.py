"""Queries of the technical indicators."""

from __future__ import annotations

from ..operators import indicators as ind
from . import sqltext as q
from .build import steps

R, D, SIG = q.ref, q.div, q.sig
TR = "case when prev_close is not null then greatest(high - low, abs(prev_close - high), abs(prev_close - low)) end"


def add(name: str, stages, sql, out: str) -> None:
    steps(f"ind_{name}", stages, sql, out.split())


MACD = [{"_short": q.ema("close", 12), "_long": q.ema("close", 26)}, {"dif": "_short - _long"}, {"dea": q.ema("dif", 9)}, {"macd": "(dif - dea) * 2"}]
add("macd", ind.macd(), MACD, "dif dea macd")
add("kdj", ind.kdj(), [{"_low": q.llv("low", 9), "_high": q.hhv("high", 9)}, {"_rsv": D("close - _low", "_high - _low") + " * 100"}, {"k": q.ema("_rsv", 5)}, {"d": q.ema("k", 5)}, {"j": "k * 3 - d * 2"}], "k d j")
add("rsi", ind.rsi(), [{"_d": "close - prev_close"}, {"_up": "case when _d is not null then greatest(_d, 0) end", "_move": "abs(_d)"}, {"_a": q.smooth("_up", 1 / 24), "_b": q.smooth("_move", 1 / 24)}, {"rsi": D("_a", "_b") + " * 100"}], "rsi")
WR = lambda k: D(f"{q.hhv('high', k)} - close", f"{q.hhv('high', k)} - {q.llv('low', k)}") + " * 100"
add("wr", ind.wr(), [{"wr1": WR(10), "wr2": WR(6)}], "wr1 wr2")
add("bias", ind.bias(), [{f"bias{i}": D(f"close - {q.ma('close', n)}", q.ma("close", n)) + " * 100" for i, n in enumerate((6, 12, 24), 1)}], "bias1 bias2 bias3")
add("boll", ind.boll(), [{"boll_mid": q.ma("close", 20), "boll_up": f"{q.ma('close', 20)} + {q.std('close', 20)} * 2", "boll_low": f"{q.ma('close', 20)} - {q.std('close', 20)} * 2"}], "boll_mid boll_up boll_low")
add("psy", ind.psy(), [{"_c": SIG("close > prev_close")}, {"psy": f"{q.total('_c::int', 12)} / 12.0::double * 100"}, {"psyma": q.ma("psy", 6)}], "psy psyma")
AVEDEV = lambda x, n: f"(case when count({x}) over {q.past(n)} >= {n} then list_avg(list_transform(list({x}) over {q.past(n)}, lambda v: abs(v - list_avg(list({x}) over {q.past(n)})))) end)"
TP = {"_tp": "(high + low + close) / 3"}
LISTED = {"_w": f"list(_tp) over {q.past(14)}", "_m": q.ma("_tp", 14)}
DEV = {"_ad": "case when _m is not null then list_avg(list_transform(_w, lambda v: abs(v - list_avg(_w)))) end"}
add("cci", ind.cci(), [TP, LISTED, DEV, {"cci": D("_tp - _m", "_ad * 0.015")}], "cci")
add("cci_zero", ind.cci_zero(), [TP, LISTED, DEV, {"cci_z": f"case when _ad = 0 then 0 else {D('_tp - _m', '_ad * 0.015')} end"}], "cci_z")
add("atr", ind.atr(), [{"_tr": TR}, {"atr": q.ma("_tr", 20)}], "atr")
add("bbi", ind.bbi(), [{"bbi": "(" + " + ".join(q.ma("close", n) for n in (3, 6, 12, 20)) + ") / 4"}], "bbi")
MOVES = {"_tr": TR, "_hd": f"high - {R('high')}", "_ld": f"{R('low')} - low"}
add("dmi", ind.dmi(), [MOVES, {"_dp": f"case when {SIG('_hd > 0 and _hd > _ld')} then _hd else 0 end", "_dm": f"case when {SIG('_ld > 0 and _ld > _hd')} then _ld else 0 end"}, {"_t": q.total("_tr", 14), "_p": q.total("_dp", 14), "_m": q.total("_dm", 14)}, {"pdi": D("_p * 100", "_t"), "mdi": D("_m * 100", "_t")}, {"_dx": D("abs(mdi - pdi)", "pdi + mdi") + " * 100"}, {"adx": q.ma("_dx", 6)}, {"adxr": f"(adx + {R('adx', 6)}) / 2"}], "pdi mdi adx adxr")
add("taq", ind.taq(), [{"taq_up": q.hhv("high", 20), "taq_mid": f"({q.hhv('high', 20)} + {q.llv('low', 20)}) / 2", "taq_down": q.llv("low", 20)}], "taq_up taq_mid taq_down")
add("ktn", ind.ktn(), [{"_tr": TR}, {"atr": q.ma("_tr", 10), "_mid": "(high + low + close) / 3"}, {"ktn_mid": q.ema("_mid", 20)}, {"ktn_up": "ktn_mid + atr * 2", "ktn_down": "ktn_mid - atr * 2"}], "ktn_up ktn_mid ktn_down")
add("trix", ind.trix(), [{"_e1": q.ema("close", 12)}, {"_e2": q.ema("_e1", 12)}, {"_e3": q.ema("_e2", 12)}, {"trix": D(f"_e3 - {R('_e3')}", R("_e3")) + " * 100"}, {"trma": q.ma("trix", 20)}], "trix trma")
add("vr", ind.vr(), [{"_u": f"case when {SIG('close > prev_close')} then volume else 0 end", "_n": f"case when {SIG('close <= prev_close')} then volume else 0 end"}, {"vr": D(q.total("_u", 26), q.total("_n", 26)) + " * 100"}], "vr")
add("cr", ind.cr(), [{"_mid": f"({R('high')} + {R('low')} + {R('close')}) / 3"}, {"_a": "case when _mid is not null then greatest(0, high - _mid) end", "_b": "case when _mid is not null then greatest(0, _mid - low) end"}, {"cr": D(q.total("_a", 20), q.total("_b", 20)) + " * 100"}], "cr")
add("emv", ind.emv(), [{"_v": D(q.ma("volume", 14), "volume"), "_mid": D(f"(high + low - {R('high')} - {R('low')}) * 100", "high + low"), "_range": "high - low"}, {"_e": D("_mid * _v * _range", q.ma("_range", 14))}, {"emv": q.ma("_e", 14)}, {"maemv": q.ma("emv", 9)}], "emv maemv")
add("dpo", ind.dpo(), [{"_m": q.ma("close", 20)}, {"dpo": f"close - {R('_m', 10)}"}, {"madpo": q.ma("dpo", 6)}], "dpo madpo")
OVER = lambda x: f"case when {x} is not null then greatest(0, {x}) end"
add("brar", ind.brar(), [{"_ho": "high - open", "_ol": "open - low", "_hp": OVER("(high - prev_close)"), "_pl": OVER("(prev_close - low)")}, {"ar": D(q.total("_ho", 26), q.total("_ol", 26)) + " * 100", "br": D(q.total("_hp", 26), q.total("_pl", 26)) + " * 100"}], "ar br")
add("dfma", ind.dfma(), [{"dma_dif": f"{q.ma('close', 10)} - {q.ma('close', 50)}"}, {"dma_ma": q.ma("dma_dif", 10)}], "dma_dif dma_ma")
add("mtm", ind.mtm(), [{"mtm": f"close - {R('close', 12)}"}, {"mtmma": q.ma("mtm", 6)}], "mtm mtmma")
add("mass", ind.mass(), [{"_range": "high - low"}, {"_m": q.ma("_range", 9)}, {"_r": D("_m", q.ma("_m", 9))}, {"mass": q.total("_r", 25)}, {"ma_mass": q.ma("mass", 6)}], "mass ma_mass")
add("roc", ind.roc(), [{"roc": D(f"close - {R('close', 12)}", R("close", 12)) + " * 100"}, {"maroc": q.ma("roc", 6)}], "roc maroc")
add("expma", ind.expma(), [{"expma1": q.ema("close", 12), "expma2": q.ema("close", 50)}], "expma1 expma2")
add("obv", ind.obv(), [{"_s": "case when close > prev_close then volume when close < prev_close then -volume else 0 end"}, {"obv": f"{q.total('_s')} / 10000"}], "obv")
add("obv_from_volume", ind.obv_from_volume(), [{"_s": "case when rn = 1 or close > prev_close then volume when close < prev_close then -volume else 0 end"}, {"obv_v": q.total("_s")}], "obv_v")
add("mfi", ind.mfi(), [TP, {"_up": f"case when {SIG(f'_tp > {R('_tp')}')} then _tp * volume else 0 end", "_dn": f"case when {SIG(f'_tp < {R('_tp')}')} then _tp * volume else 0 end"}, {"_v": D(q.total("_up", 14), q.total("_dn", 14))}, {"mfi": "100 - 100 / (_v + 1)"}], "mfi")
add("asi", ind.asi(), [
    {"_a": "abs(high - prev_close)", "_b": "abs(low - prev_close)", "_c": f"abs(high - {R('low')})", "_d": f"abs(prev_close - {R('open')})"},
    {"_r": "case when _a > _b and _a > _c then _a + _b / 2 + _d / 4 when _b > _c and _b > _a then _b + _a / 2 + _d / 4 else _c + _d / 4 end", "_x": f"close - prev_close + (close - open) / 2 + prev_close - {R('open')}"},
    {"_si": D("_x * 16", "_r") + " * greatest(_a, _b)"}, {"asi": q.total("_si", 26)}, {"asit": q.ma("asi", 10)}], "asi asit")
add("xsii", ind.xsii(), [
    {"_aa": q.ma("(close * 2 + high + low)", 5) + " / 4", "_m20": q.ma("close", 20)},
    {"_cc": D("abs(close * 2 + high + low - _m20 * 4)", "_m20 * 4")},
    {"_l": f"list(struct_pack(x := close, f := coalesce(_cc, 1))) over {q.UPTO}"},
    {"_dd": "list_reduce(_l, lambda a, b: struct_pack(x := b.f * b.x + (1 - b.f) * a.x, f := b.f)).x"},
    {"xs1": "_aa * 102 / 100", "xs2": "_aa * 98 / 100", "xs3": "1.07::double * _dd", "xs4": "0.93::double * _dd"}], "xs1 xs2 xs3 xs4")
add("ema_seeded", ind.ema_seeded(), [{"ema_s": q.ema_seeded("close", 40)}], "ema_s")
MACDS = [{"_late": "case when rn > 14 then close end"}, {"_short": q.ema_seeded("_late", 12), "_long": q.ema_seeded("close", 26)}, {"_dif": "_short - _long"}, {"_dea": q.ema_seeded("_dif", 9)}, {"dif_s": "case when _dea is not null then _dif end", "dea_s": "_dea", "macd_s": "_dif - _dea"}]
add("macd_seeded", ind.macd_seeded(), MACDS, "dif_s dea_s macd_s")
add("rsi_wilder", ind.rsi_wilder(), [{"_d": "close - prev_close"}, {"_g": "case when _d is not null then greatest(_d, 0) end", "_l": "case when _d is not null then greatest(-_d, 0) end"}, {"_ag": q.wilder("_g", 14), "_al": q.wilder("_l", 14)}, {"rsi_w": f"case when _ag is not null then coalesce({D('_ag * 100', '_ag + _al')}, 0) end"}], "rsi_w")
add("atr_wilder", ind.atr_wilder(), [{"_tr": TR}, {"atr_w": q.wilder("_tr", 14)}], "atr_w")
LOHI = {"_lo": q.llv("low", 14), "_hi": q.hhv("high", 14)}
add("stoch", ind.stoch(), [LOHI, {"_fast": f"case when _hi = _lo then 0 else {D('(close - _lo) * 100', '_hi - _lo')} end"}, {"_k": q.ma("_fast", 3)}, {"slowd": q.ma("_k", 3)}, {"slowk": "case when slowd is not null then _k end"}], "slowk slowd")
add("willr", ind.willr(), [LOHI, {"willr": f"case when _hi = _lo then 0 else {D('(_hi - close) * -100', '_hi - _lo')} end"}], "willr")
add("adx_wilder", ind.adx_wilder(), [MOVES, {"_dp": "case when _hd is not null then case when _hd > 0 and _hd > _ld then _hd else 0 end end", "_dm": "case when _hd is not null then case when _ld > 0 and _ld > _hd then _ld else 0 end end"}, {"_t": q.wilder("_tr", 14), "_p": q.wilder("_dp", 14), "_m": q.wilder("_dm", 14)}, {"_pdi": D("_p * 100", "_t"), "_mdi": D("_m * 100", "_t")}, {"_dx": f"case when _t is not null then coalesce({D('abs(_pdi - _mdi) * 100', '_pdi + _mdi')}, 0) end"}, {"adx_w": q.wilder("_dx", 14)}], "adx_w")
add("sar", ind.sar(), None, "sar")
add("vwap_and_levels", ind.vwap_and_levels(), [{"_pv": "close * volume"}, {"vwap": D(q.total("_pv"), q.total("volume")), "momentum": f"close - {R('close', 14)}", "support": q.llv("low", 20), "resistance": q.hhv("high", 20), "ll": f"min(low) over {q.UPTO}", "ll60": q.llv("low", 60), "max_close15": q.hhv("close", 15)}], "vwap momentum support resistance ll ll60 max_close15")
add("bar_columns", ind.bar_columns(), [*MACDS, {"bar": "macd_s * 2"}, {"abs_bar": "abs(bar)", "bar_low20": q.llv("bar", 20), "bar_low20_price": f"case when count(bar) over {q.past(20)} >= 20 then arg_min(close, bar) over {q.past(20)} end", "macd_gap": f"bar - {R('bar')}", "boll_gap": f"{q.ma('close', 20)} - {q.std('close', 20)} * 2 - close"}, {"macd_gap_rate": D("chg", "macd_gap"), "macd_gap_body_rate": D("close - open", "macd_gap")}], "bar abs_bar bar_low20 bar_low20_price macd_gap macd_gap_rate macd_gap_body_rate boll_gap")
LINES = [
    {"_mid": "(close * 2 + high + low) / 4", "_lo": q.llv("close", 28), "_hi": q.hhv("close", 28), "q": "(close * 3 + low + open + high) / 6"},
    {"hxjz": q.ma("_mid", 5), "_t0": D("close - _lo", "_hi - _lo") + " * 100", "slow_line": "(" + " + ".join(f"lag(q, {k}) over {q.W} * {k or 26}" for k in range(27)) + ") / 351"},
    {"bztd": "hxjz * 89 / 100", "_t1": q.ma("_t0", 2)},
    {"surge": SIG(f"{R('low')} <= {R('bztd')} and low > bztd") + "::int", "trend": q.ma("_t1", 2)},
    {"trend_rate": D(f"{R('trend')} - trend", "trend")},
]
add("operating_lines", [*ind.operating_lines(), lambda: {"surge": ind.C("surge").cast("int")}], LINES, "hxjz bztd surge trend trend_rate q slow_line")
add("pct_change", ind.pct_change(), [{"pct": "close / prev_close - 1"}], "pct")
ADAPTIVE = [
    {"_move": "abs(close - prev_close)"}, {"_dir": f"abs(close - {R('close', 10)})", "_vir": q.total("_move", 10)}, {"er": D("_dir", "_vir")}, {"_x": f"er * {2 / 3 - 2 / 14!r}::double + {2 / 14!r}::double"},
    {"_cs": q.smooth("_x", 1 / 3)}, {"_size": "greatest(coalesce(floor(10 - _cs * 10), 1), 1)::int"},
    {"_ma": "case when rn - 1 >= _size then [" + ", ".join(f"avg(close) over {q.past(k)}" for k in range(1, 11)) + "][_size] end"}, {"adaptive": q.ema("_ma", 2)}]
add("adaptive_line", ind.adaptive_line(), ADAPTIVE, "er adaptive")
