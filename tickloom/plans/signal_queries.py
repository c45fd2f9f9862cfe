"""Queries of the signal templates, their catalogue and the named screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screens as sc
from ..operators import signals as sg
from . import sqltext as q
from .build import bars, register, stable, steps
from .indicator_queries import ADAPTIVE, LINES, MACDS, TR

C = F.col
SIG, R = q.sig, q.ref


def bands(key, v):
    out = {f"{key}_under_{v[0]}": f"{key} < {v[0]}"} | {f"{key}_{a}_to_{b}": f"{key} >= {a} and {key} < {b}" for a, b in zip(v, v[1:])} | {f"{key}_over_{v[-1]}": f"{key} > {v[-1]}"}
    return {f'"{k}"': SIG(c) for k, c in out.items()}


def mean(key, ns):
    return {f"{key}_{w}_mean{n}": SIG(f"{key} {o} {q.ma(key, n)} {s} 1e-6") for n in ns for w, o, s in (("over", ">=", "-"), ("under", "<=", "+"))}


def last(keys):
    return {f"{a}_over_last_{b}": SIG(f"{a} >= {R(b)}") for a in keys for b in keys if a != b}


def today(keys):
    return {f"{a}_over_{b}": SIG(f"{a} >= {b}") for a in keys for b in keys if a != b}


def ext(key, ns):
    return {f"{key}_{w}{n}": SIG(f"{key} = {f(key, n)}") for n in ns for w, f in (("max", q.hhv), ("min", q.llv))}


P = ["open", "high", "low", "close"]


def template(name, spark_cols, sql, before=None, before_sql=None):
    names = [k.strip('"') for k in sql]
    steps(f"signal_{name}", [*(before or []), spark_cols], [*(before_sql or []), sql], [f"`{n}`" for n in names] if name == "fixed_bands" else names, rounded=False)


register(
    "signal_fixed_bands",
    lambda spark, sf: bars(spark, sf).select("code", C("ts").cast("string").alias("ts"), *[c.alias(k.replace("-", "m")) for k, c in sg.fixed_bands("chg", [-5, 0, 5]).items()]),
    q.base() + " select code, cast(ts as varchar) as ts, " + ", ".join(f"{c} as {k.strip(chr(34)).replace('-', 'm')}" for k, c in bands("chg", [-5, 0, 5]).items()) + " from b",
)
template("vs_mean", lambda: sg.vs_mean("close", [5, 20]), mean("close", [5, 20]))
template("vs_yesterday", lambda: sg.vs_yesterday(P), last(P))
template("vs_today", lambda: sg.vs_today(P), today(P))
template("extreme", lambda: sg.extreme("low", [5, 20]), ext("low", [5, 20]))
template("cross_up", lambda: sg.cross_up(["m5"], ["m10", "m20"]), {f"m5_cross_m{n}": SIG(f"m5 >= m{n} and {R('m5')} < {R(f'm{n}')}") for n in (10, 20)}, [lambda: {f"m{n}": sg.S.ma("close", n) for n in (5, 10, 20)}], [{f"m{n}": q.ma("close", n) for n in (5, 10, 20)}])
template("yesterday", lambda: sg.yesterday(["low_max5", "low_min5"]), {f"last_low_{w}5": SIG(R(f"low_{w}5")) for w in ("max", "min")}, [lambda: sg.extreme("low", [5])], [ext("low", [5])])

FAMILIES = {
    "close": mean("close", [5, 10, 20, 40]) | ext("close", [5, 10, 20, 60]),
    "turnover": bands("turnover", [0.5, 1, 2]) | mean("turnover", [5, 10]) | ext("turnover", [5, 20]),
    "body": bands("body", [-50, 0, 50]) | ext("body", [5, 20]),
    "listing": {"limit_down": SIG("chg < -0.95 * limit_rate"), "new": "rn <= 101"},
    "open": mean("open", [5, 10, 20]) | ext("open", [5, 20]),
    "high": mean("high", [5, 10, 20]) | ext("high", [5, 20]),
    "low": mean("low", [5, 10, 20]) | ext("low", [5, 20]),
    "chg": bands("chg", [-5, -1, 0, 1, 5]) | mean("chg", [5, 10]) | ext("chg", [5, 20]),
    "amplitude": bands("amplitude", [5, 10, 50]) | mean("amplitude", [5, 10]) | ext("amplitude", [5, 20]),
    "price_last": last(["open", "close", "high", "low"]),
    "price_today": today(["open", "close"]),
    "amount": mean("amount", [5, 10]) | {"amount_doubled": SIG(f"amount >= 2 * {R('amount')}"), "amount_halved": SIG(f"amount <= 0.5 * {R('amount')}")},
}


def counts(spark, sf, family):
    """How often each signal of a family holds, by code."""
    df, names = sg.catalogue(bars(spark, sf), [family])
    return df.groupBy("code").agg(*[F.count_if(C(f"`{n}`")).alias(n.replace("-", "m").replace(".", "p")) for n in names])


for _family, _sql in FAMILIES.items():
    register(
        f"signal_catalogue_{_family}",
        lambda spark, sf, family=_family: counts(spark, sf, family),
        q.base() + ", d as (select *, close - open as body from b), s as (select code, " + ", ".join(f'{c} as "{k.strip(chr(34))}"' for k, c in _sql.items()) + " from d) select code, " + ", ".join(f'count(*) filter (where "{k.strip(chr(34))}") as {k.strip(chr(34)).replace("-", "m").replace(".", "p")}' for k in _sql) + " from s group by code",
    )
register(
    "signal_all_of",
    lambda spark, sf: sg.catalogue(bars(spark, sf), ["close"])[0].withColumn("buy", sg.all_of(["close_under_mean5", "close_under_mean20"])).select("code", C("ts").cast("string").alias("ts"), "buy"),
    q.base() + f", s as (select *, {', '.join(f'{c} as {k}' for k, c in mean('close', [5, 20]).items())} from b) select code, cast(ts as varchar) as ts, close_under_mean5 and close_under_mean20 and {SIG('chg between -(limit_rate - 1 / close) and limit_rate - 1 / close')} as buy from s",
)
ACTIVE = ["close_under_mean5", "close_over_mean20", "close_max5", "close_min5"]
register(
    "signal_active_on",
    lambda spark, sf: sg.active_on(sg.catalogue(bars(spark, sf), ["close"])[0], ACTIVE, "2024-01-05").select("code", C("ts").cast("string").alias("ts"), "signal"),
    q.base() + ", s as (select *, " + ", ".join(f"{c} as {k}" for k, c in (mean("close", [5, 20]) | ext("close", [5])).items()) + " from b) " + " union all ".join(f"select code, cast(ts as varchar) as ts, '{n}' as signal from s where ts::date = date '2024-01-05' and {n}" for n in ACTIVE),
)

# -- screens -------------------------------------------------------------------------------------
KDJ = [{"_low9": q.llv("low", 9), "_high9": q.hhv("high", 9)}, {"_rsv": q.div("close - _low9", "_high9 - _low9") + " * 100"}, {"k": q.ema("_rsv", 5)}, {"d": q.ema("k", 5)}, {"j": "k * 3 - d * 2"}]
WR = q.div(f"{q.hhv('high', 10)} - close", f"{q.hhv('high', 10)} - {q.llv('low', 10)}") + " * 100"
PREPARED = [
    *MACDS,
    {"bar": "macd_s * 2", "wr1": WR, "m50": q.ema("close", 50)},
    {"abs_bar": "abs(bar)", "macd_gap": f"bar - {R('bar')}", "boll_gap": f"{q.ma('close', 20)} - {q.std('close', 20)} * 2 - close", "bar_low20_price": f"case when count(bar) over {q.past(20)} >= 20 then arg_min(close, bar) over {q.past(20)} end"},
    {"macd_gap_rate": q.div("chg", "macd_gap"), "macd_gap_body_rate": q.div("close - open", "macd_gap")},
    *[{k: (v.removesuffix("::int") if k == "surge" else v) for k, v in s.items()} for s in LINES],
    *KDJ,
    {f"p_{c}": R(c) for c in ("open", "high", "low", "close", "chg", "volume", "turnover")}
    | {"p2_volume": R("volume", 2), "p_bar": R("bar"), "p2_bar": R("bar", 2), "p_macd_gap": R("macd_gap"), "p_j": R("j"), "p_m50": R("m50")}
    | {f"ma{n}": q.ma("close", n) for n in (5, 10, 40)}
    | {f"close_hi{n}": q.hhv("close", n) for n in (10, 15)}
    | {f"close_lo{n}": q.llv("close", n) for n in (3, 20, 40, 60)}
    | {f"bar_min{n}": q.llv("bar", n) for n in (3, 5, 10, 20)}
    | {"abs_bar_max10": q.hhv("abs_bar", 10), "boll_gap_hi3": q.hhv("boll_gap", 3), "ll": f"min(low) over {q.UPTO}", "amount_ma5": q.ma("amount", 5), "low20": q.ma("low", 20), "high20": q.ma("high", 20)},
    {"p_amount_ma5": R("amount_ma5"), "trend_class": "case when close > low20 * 1.1 and close <= low20 * 1.2 then 3 when close > high20 * 0.9 and close <= low20 * 1.1 then 2 when close < high20 * 0.8 then 0 when close > low20 * 1.2 then 4 else 1 end"},
    {"p_trend_class": R("trend_class")},
]
#: The prepared columns differ in names between the two sides only where they hold the same thing.
PREPARED = [{("x_" + k if k in ("_low", "_high") else k): v for k, v in s.items()} for s in PREPARED]
for _name, _cond in sc.SCREENS.items():
    register(
        f"screen_{_name}",
        lambda spark, sf, name=_name: sc.prepared(bars(spark, sf), name).select("code", C("ts").cast("string").alias("ts"), sc.screen(name).alias("buy")),
        q.staged([*PREPARED, {"buy": f"coalesce({_cond}, false)"}], ["buy"], rounded=False),
    )
register(
    "screen_delayed",
    lambda spark, sf: bars(spark, sf).withColumn("buy", F.expr("coalesce(chg < -50, false)")).select("code", C("ts").cast("string").alias("ts"), sc.delayed().alias("buy")),
    q.base() + f" select code, cast(ts as varchar) as ts, coalesce(lag(coalesce(chg < -50, false)) over {q.W}, false) as buy from b",
)

LAG = lambda **lags: {f"{c}{k}": R(c, k) for c, n in lags.items() for k in range(1, n + 1)}
steps("screen_daily_24", sc.daily_24(), [*ADAPTIVE, {"od": "coalesce(open / adaptive, 0) * 100", "cd": "coalesce(close / adaptive, 0) * 100", "ma40": q.ma("close", 40)}, {"od1": R("od")}, LAG(chg=1, open=1, close=1), {"buy": "coalesce(od < 96 and od > od1 and close < ma40 and chg < 0 and turnover > 0.5 and chg1 < 0 and cd < 96 and chg > -0.95 * limit_rate and open1 > close1, false)"}], ["buy"], rounded=False)
steps(
    "screen_daily_26",
    sc.daily_26(),
    [
        {"hi20": q.hhv("high", 20), "lo10": q.llv("low", 10), "lo3": q.llv("low", 3), "ma18": q.ma("close", 18), "ma20": q.ma("close", 20), "tr": TR},
        {"tr14": q.ma("tr", 14), "line": f"(high + low) / 2 - {q.ma('tr', 2)}"},
        {"line3": q.hhv("line", 3)},
        LAG(hi20=1, lo10=1, lo3=1, ma20=1, tr=1, tr14=1),
        {"buy": "coalesce(chg < 0.95 * limit_rate and low > lo101 and high < hi201 and rn > 31 and close < line3 and close < prev_close and close < open and close != low and close > ma18 and ma20 > ma201 and close < lo31 and tr14 > tr141 and tr > tr1 and close - low < 0.3 * (high - low), false)"},
    ],
    ["buy"],
    rounded=False,
)
_A = "open3 < close3 and open2 < close2 and open1 > close1 and open > close and close < 1.098 * close1 and close1 >= 1.03 * close and close < 1.03 * low and high < high1 and close - low < (open - close) * 0.6 and close1 < 1.0995 * close2 and volume < v16 * 9.5 and high1 < 1.07 * close and high - open > close - low and high3 > 1.011 * least(open3, close3) and close2 < close1 * 1.01 and close - low > 0.03 * (high - low) and close - low < 0.3 * (high - low)"
_B = "open3 > close3 and open2 > close2 and open1 < close1 and open > close and close1 >= 1.03 * close and close < 1.03 * low and volume < volume3 * 1.2 and volume > volume3 * 0.9 and high < high1 and e5 > ma14 * 1.017"
steps("screen_daily_27", sc.daily_27(), [{"e5": q.ema("close", 5), "ma14": q.ma("close", 14), "v16": q.llv("volume", 16)}, LAG(open=3, close=3, high=3, volume=3), {"buy": f"coalesce({_A}, false) or coalesce({_B}, false)"}], ["buy"], rounded=False)
steps("screen_daily_28", sc.daily_28(), [{"ea": q.ema("amount", 13), "ev": q.ema("volume", 13)}, {"paid": q.div("ea", "ev")}, {"far": q.div("close - paid", "paid") + " * 1000"}, {"buy": f"coalesce(chg < 0.95 * limit_rate and {R('far')} < 95 and far >= 95, false)"}], ["buy"], rounded=False)

ALPHA = lambda n: f"({2 / (n + 1)!r}::double / (1 - pow({1 - 2 / (n + 1)!r}::double, rn)))"


def moving(x: str, a: str, name: str) -> list[dict[str, str]]:
    """Stages of a mean whose factor is another column."""
    return [{f"_l_{name}": f"list(struct_pack(x := {x}, f := {a})) over {q.UPTO}"}, {name: f"list_reduce(_l_{name}, lambda a, b: struct_pack(x := b.f * b.x + (1 - b.f) * a.x, f := b.f)).x"}]


LAST = lambda c, x, frame: f"max(case when {c} then {x} end) over (partition by code order by ts rows between unbounded preceding and {frame})"
steps(
    "screen_daily_9",
    sc.daily_9(),
    [
        {"_x3": SIG("high > low * 1.052"), "_low": SIG(f"close / {q.ma('close', 60)} * 100 < 75") + " or " + SIG(f"close / {q.ma('close', 40)} * 100 < 80"), "_a5": ALPHA(5)},
        {"_x6": f"_x3 and {SIG(f'{q.total('_x3::int', 5)} > 1')} and _low and not (close = low and high = low)"},
        *moving("close", "_a5", "_e5"),
        {"buy": f"_x6 and not (close > open and {SIG(f'{q.total('_x6::int', 10)} > 0')} and {SIG(f'_e5 > {R('_e5')}')})"},
    ],
    ["buy"],
    rounded=False,
)
FAR = lambda n: f"((close - {q.ma('close', n)}) / {q.ma('close', n)})"
steps(
    "screen_daily_10",
    sc.daily_10(),
    [
        {"_b27": f"{FAR(27)} * 100", "_b21": FAR(21), "_b28": f"{FAR(28)} * 100", "_typical": "(close + low + high) / 3", "_a3": ALPHA(3), "_a26": ALPHA(26), "_c10": q.llv("close", 10), "_l10": q.llv("low", 10)},
        *moving("_typical", "_a3", "_t3"),
        *moving("_t3", "_a26", "_t26"),
        {"_x3": q.ma("_b27", 2), "_x9": f"{q.ma('_b21', 3)} * 100"},
        {"_up": SIG(f"{R('_x3')} < -10 and _x3 > -10")},
        {"_prev": f"coalesce({LAST('_up', 'rn', '1 preceding')}, 0)"},
        {"_second": f"coalesce({LAST('_up', '_prev', 'current row')}, 0)"},
        {"_all": SIG(f"_x3 < -10 and _second > 3 and close / (_t26 * 0.9) < 0.95 and _x9 < -15 and _b28 < -23 and close / {R('_c10')} < 0.96 and low / {R('_l10')} < 0.99 and close != low and close / low > 1.005")},
        {"_before": LAST("_all", "rn", "1 preceding")},
        {"buy": "_all and coalesce(rn - _before >= 10, true)"},
    ],
    ["_up", "_second", "buy"],
    rounded=False,
)
ELEVEN = [
    {"_tr": "case when prev_close is null then high - low else greatest(high - low, abs(prev_close - high), abs(prev_close - low)) end"},
    {"_x2": f"(high + low) / 2 + {q.ma('_tr', 2)}", "_x3": f"(high + low) / 2 - {q.ma('_tr', 2)}"},
    {"_x4": f"case when _x2 <= {R('_x2')} then {R('_x2')} end", "_x5": q.llv("_x2", 3)},
    {"_x6": f"case when coalesce(_x5 != {R('_x5')}, true) and {SIG(f'_x4 < {R('_x4')}')} then _x4 else _x5 end"},
    {"_on": SIG("_x2 = _x6") + "::int", "_cross": SIG("(prev_close < _x6 and close > _x6) or (prev_close > _x6 and close < _x6)") + "::int"},
    {"_x7": f"coalesce({q.total('_on', 2)}, 0)"},
    {"_x8": f"case when _x7 > 0 then _cross else 0 end + case when _x7 > 1 then coalesce({R('_cross')}, 0) else 0 end"},
    {"_x9": f"coalesce(date_diff('day', max(case when _x8 > 0 then ts end) over {q.UPTO}, ts), 0)"},
    {"_width": "max(_x9) over (partition by code) + 1"},
    {"_lx": f"list(_x3) over {q.UPTO}"},
    {"_top": "case when rn >= _width and len(list_filter(_lx[(rn - _width + 1)::bigint:], lambda v: v is null)) = 0 then list_max(_lx[(rn - _width + 1)::bigint:]) end"},
    {"_x10": f"sum({SIG('_top > close')}::int) over {q.UPTO}", "_m18": q.ma("close", 18), "_l3": q.llv("low", 3), "_x15": f"case when close < open then {q.div('close - low', 'high - low')} else 0 end"},
    {"buy": SIG(f"_x9 < _x10 and close / {R('_l3')} < 1 and close < open and close != low and close >= _m18 * 1.004 and _m18 >= {R('_m18')} and _x15 > 0.03 and _x15 < 0.3")},
]
register(
    "screen_daily_11",
    lambda spark, sf: sc.daily_11(bars(spark, sf, "day")).select("code", C("ts").cast("string").alias("ts"), C("_x9").cast("long").alias("x9"), C("_x10").cast("long").alias("x10"), "buy"),
    q.staged([*ELEVEN, {"x9": "_x9", "x10": "_x10::bigint"}], ["x9", "x10", "buy"], "day", rounded=False),
)
PB = [f"_pb{n}" for n in sc.SPANS]
steps(
    "screen_daily_25",
    sc.daily_25(),
    [
        {f"_e{n}": q.ema("close", n) for n in sc.SPANS},
        {f"_pb{n}": f"(_e{n} + {q.ma('close', 2 * n)} + {q.ma('close', 4 * n)}) / 3" for n in sc.SPANS} | {"_m60": q.ma("close", 60), "_v5": q.ma("volume", 5), "_v60": q.ma("volume", 60)},
        {"_lowest": f"case when _pb24 is not null then least({', '.join(PB)}) end", "_highest": f"case when _pb24 is not null then greatest({', '.join(PB)}) end", "_lb": q.div("volume", R("_v5")), "_near": SIG("(" + " + ".join(f"abs({a} - {b})" for i, a in enumerate(PB) for b in PB[i + 1 :]) + ") / close < 0.2")},
        {"_xg": f"({SIG('open < _lowest')} or {SIG(f'{R('open')} < _lowest')}) and {SIG('close > _highest')}", "_loud": SIG("_lb > 2.2")},
        {"_jl": SIG("close > _m60 and _v5 > _v60 * 0.9 and close > _m60 * 1.02 and close < _m60 * 1.15 and close > open * 1.02 and close / prev_close - 1 > 0.03") + "".join(f" and ({c} or {SIG(R(c))})" for c in ("_loud", "_xg", "_near"))},
        {"buy": SIG("chg < limit_rate * 0.95") + f" and (((_jl or {SIG(R('_jl'))}) and {SIG('close > _pb4 * 0.88')}) or (_xg and _loud and {SIG('close > _m60 * 1.02 and close < _m60 * 1.15')}))"},
    ],
    ["_xg", "_near", "_loud", "_jl", "buy"],
    rounded=False,
)
PLACE = lambda n: q.div(f"close - {q.llv('low', n)}", f"{q.hhv('high', n)} - {q.llv('low', n)}") + " * 100"
steps(
    "screen_select_stocks",
    [*sc.select_stocks(), lambda: {"main20": C("main20").cast("long")}],
    [
        {"_e5": q.ema("close", 5), "_e340": q.ema("close", 340)},
        {"v1": "_e5 - _e340"},
        {"v2": q.ema("v1", 144), "v3": PLACE(27), "fast": PLACE(9), "_fall": f"abs(low - {R('low')})", "_rise": f"case when {R('low')} is not null then greatest(low - {R('low')}, 0) end", "_l34": q.llv("low", 34)},
        {"_sf": q.smooth("_fall", 1 / 13), "_sr": q.smooth("_rise", 1 / 13), "slow": q.smooth("fast", 1 / 3), "_s5": q.smooth("v3", 1 / 5)},
        {"_m2": q.div("_sf", "_sr") + " * 4", "_s53": q.smooth("_s5", 1 / 3)},
        {"_m3": q.ema("_m2", 13), "turn": "3 * _s5 - 2 * _s53"},
        {"_at": "case when low <= _l34 then _m3 else 0 end"},
        {"_m5": q.ema("_at", 3)},
        {"main": SIG(f"_m5 > {R('_m5')}"), "_over": SIG(f"{R('slow')} < fast and slow > fast"), "_under": SIG(f"{R('fast')} < slow and fast > slow and slow < 30")},
        {"main20": f"(case when rn >= 20 then sum(main::int) over {q.past(20)} end)::bigint", "_since": f"rn - coalesce({LAST('_over', 'rn', 'current row')}, 0)", "gup": f"case when {SIG(f'{R('v3')} < 5 and v3 > 5 and v1 < v2')} then 40 else 20 end"},
        {"entry": "_since >= _under::int", "bottom": SIG(f"{R('turn')} < 3 and turn > 3")},
        {"buy": "entry or bottom"},
    ],
    ["main20", "gup", "entry", "bottom", "buy"],
    rounded=False,
)
register("screen_mix_date", lambda spark, sf: bars(spark, sf).select("code", C("ts").cast("string").alias("ts"), sg.on_date("2024-01-04").alias("buy")), q.base() + " select code, cast(ts as varchar) as ts, ts::date = date '2024-01-04' as buy from b")
MIXED = ["close", "turnover", "price_today"]
_SIGS = mean("close", [5, 10, 20, 40]) | ext("close", [5, 10, 20, 60]) | bands("turnover", [0.5, 1, 2]) | mean("turnover", [5, 10]) | ext("turnover", [5, 20]) | today(["open", "close"])


def _mix_back(spark, sf):
    df, names = sg.catalogue(bars(spark, sf), MIXED)
    plain = [n.replace(".", "_") for n in names]
    df = df.withColumnsRenamed(dict(zip(names, plain, strict=True)))
    target = df.filter("code = 'error'").orderBy(C("ts").desc()).limit(1)
    return sg.same_signals(df, plain, target).select("code", C("ts").cast("string").alias("ts"), "buy")


register(
    "screen_mix_back",
    _mix_back,
    q.base() + ", s as (select code, ts, [" + ", ".join(f"case when {c} then '{n.strip(chr(34))}' end" for n, c in _SIGS.items()) + "] as l from b), a as (select code, ts, list_filter(l, lambda x: x is not null) as active from s), t as (select active as wanted from a where code = 'error' order by ts desc limit 1) select code, cast(ts as varchar) as ts, list_has_all(active, wanted) as buy from a, t",
)
register("signal_sort_by_least", lambda spark, sf: sg.sort_by_least(bars(spark, sf, "user_day").select("code", C("turnover").alias("score"))).select("code", stable(C("least")).alias("least"), "place"), q.base("user_day") + ", l as (select code, min(turnover) as least from b group by 1) select code, round(least + 1e-9, 6) as least, row_number() over (order by least, code) as place from l")


def _kept_columns(spark, sf):
    df, names = sg.catalogue(bars(spark, sf), ["body"])
    df = df.withColumnsRenamed({n: f"{n.replace('.', '_').replace('-', 'm')}_signal" for n in names})
    return sg.keep_columns(df, ["code", "close"]).withColumn("code", C("code"))


register("signal_keep_columns", _kept_columns, q.base() + ", y as (select *, close - open as body from b) select code, close, " + ", ".join(f'{c} as "{n.strip(chr(34)).replace(".", "_").replace("-", "m")}_signal"' for n, c in (bands("body", [-50, 0, 50]) | ext("body", [5, 20])).items()) + " from y")
