"""Queries of the features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.steps import with_steps
from ..operators import features as ft
from ..sources import views
from . import sqltext as q
from .build import bars, register, stable, steps

R, D, SIG = q.ref, q.div, q.sig
PCT = lambda x: f"coalesce(round_even(({x}) * 100, 2), 0)"


def add(name, stages, sql, kind="hour", rounded=True):
    steps(f"feat_{name}", stages, sql, list(sql[-1]), kind, rounded)


add("change_pct", ft.change_pct(), [{f"{k}_chg{p}": PCT(D(f"{k} - {R(k, p)}", R(k, p))) for k in ("close", "volume") for p in (1, 2, 5)}])
KEYS = ("open", "high", "low", "close")
add("relative_amplitude", ft.relative_amplitude(), [{f"{a}_{b}_vs_{k}": PCT(D(f"{a} - {b}", R(k))) for a, b in combinations(KEYS, 2) for k in KEYS}])
add("window_amplitude", ft.window_amplitude(), [{f"amp{n}": PCT(D(f"max(high) over {q.past(n)} - min(low) over {q.past(n)}", R("close", n - 1))) for n in (1, 3, 5, 10)}])
TS = ("close", "volume")
add("trend_streaks", ft.trend_streaks(), [
    {f"_{k}_{n}": SIG(f"{k} {o} {R(k)}") for k in TS for n, o in (("rise", ">"), ("fall", "<"))},
    {f"{k}_{n}": f"rn - coalesce(max(case when not _{k}_{c} then rn end) over {q.UPTO}, 0)" for k in TS for n, c in (("up", "rise"), ("down", "fall"))},
    {f"{k}_turn_{n}": SIG(f"{k}_{n} > 0 and {R(f'{k}_{o}')} = 1") + "::int" for k in TS for n, o in (("up", "down"), ("down", "up"))}])
add("rolling_flags", ft.rolling_flags(), [{k: v for n in (3, 5, 10) for k, v in {
    f"close_mean{n}": q.ma("close", n), f"close_is_max{n}": SIG(f"close = {q.hhv('close', n)}") + "::int", f"close_is_min{n}": SIG(f"close = {q.llv('close', n)}") + "::int",
    f"close_above{n}": SIG(f"close > {q.ma('close', n)}") + "::int", f"close_below{n}": SIG(f"close < {q.ma('close', n)}") + "::int"}.items()}])
add("range_position", ft.range_position(), [{f"close_pos{n}": f"coalesce({D(f'close - {q.llv('close', n)}', f'{q.hhv('close', n)} - {q.llv('close', n)}')}, 0)" for n in (5, 10)}])
add("range_position_flat", ft.range_position(("volume",), (3,), 1.0), [{"volume_pos3": f"case when {q.hhv('volume', 3)} = {q.llv('volume', 3)} then 1 else coalesce({D(f'volume - {q.llv('volume', 3)}', f'{q.hhv('volume', 3)} - {q.llv('volume', 3)}')}, 0) end"}])
UNTIL = "(13 - isodow(max(ts) over (partition by code))) % 7"
PRE = f"coalesce(lead(_gap, {{0}}) over {q.W}, false) or ({UNTIL} <= 3 and count(*) over (partition by code) - rn = {{0}} - {UNTIL})"
add("holiday_marks", ft.holiday_marks(), [{"_gap": SIG(f"date_diff('day', {R('ts')}, ts) > 1")}, {f"pre{i}": PRE.format(i) for i in (1, 2, 3)} | {f"post{i}": f"coalesce(lag(_gap, {i - 1}) over {q.W}, false)" for i in (1, 2, 3)}], "day", False)
CK = ("close", "m3", "m5", "m10")
add("crossovers", ft.crossovers(), [{f"m{n}": q.ma("close", n) for n in (3, 5, 10)}, {k: v for a, b in combinations(CK, 2) for k, v in {f"{a}_over_{b}": SIG(f"{R(a)} - {R(b)} < 0 and {a} - {b} > 0") + "::int", f"{a}_under_{b}": SIG(f"{R(a)} - {R(b)} > 0 and {a} - {b} < 0") + "::int"}.items()}])
NEXT = lambda f, x, d: f"{f}({x}) over (partition by code order by ts rows between 1 following and {d} following)"
FWD = {"fwd_open": f"(lead(open) over {q.W} - close) / nullif(close, 0) * 100"}
for _d in (1, 2, 3):
    FWD |= {f"fwd_high{_d}": f"({NEXT('max', 'high', _d)} - close) / nullif(close, 0) * 100", f"fwd_low{_d}": f"({NEXT('min', 'low', _d)} - close) / nullif(close, 0) * 100", f"fwd_close{_d}": f"(lead(close, {_d}) over {q.W} - close) / nullif(close, 0) * 100"}
add("forward_returns", ft.forward_returns(), [FWD])
add("forward_high", ft.forward_high(), [{f"fwd_max{d}": NEXT("max", "high", d) for d in (1, 2, 3)}])
add("capture_rebound", ft.capture_rebound(), [{"_top": q.hhv("high", 10)}, {"_fall": f"round_even({D(f'{R('_top')} - close', R('_top'))} * 100, 2)", "_next": f"lead(close > open) over {q.W}"}, {"rebound": SIG("_fall > 10 and close <= open and _next") + "::int"}])
add("label_by_threshold", ft.label_by_threshold(), [FWD, {"label1": SIG("fwd_high1 >= 5"), "label2": SIG("fwd_high2 >= 5"), "label3": SIG("fwd_high1 < fwd_high2 and fwd_high1 < 5")}], "hour", False)


def labelled(spark, sf_dir, kind="hour"):
    return with_steps(bars(spark, sf_dir, kind), ft.forward_returns())


LEVELS = (0.5, 1, 2, 5, 10, 20)
RATES = {f"high{d}_{str(p).replace('.', '_')}": f"avg({SIG(f'fwd_high{d} >= {p}')}::int)" for d in (1, 2, 3) for p in LEVELS} | {"rise": f"avg({SIG('chg > 0')}::int)"}
LABELLED = q.base() + ", f as (select *, " + ", ".join(f"{e} as {n}" for n, e in FWD.items()) + " from b)"
PERF = LABELLED + ", p0 as (select ts, " + ", ".join(f"{e} as {n}" for n, e in RATES.items()) + " from f group by ts), p as (select *, lead(rise) over (order by ts) as next_rise, lag(high1_1) over (order by ts) as last_success from p0)"
PERF_OUT = [*RATES, "next_rise", "last_success"]
register(
    "feat_market_performance",
    lambda spark, sf_dir: ft.market_performance(labelled(spark, sf_dir)).select(F.col("ts").cast("string").alias("ts"), *[stable(F.col(c)).alias(c) for c in PERF_OUT]),
    PERF + " select cast(ts as varchar) as ts, " + ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in PERF_OUT) + " from p",
)
register(
    "feat_split_stratified",
    lambda spark, sf_dir: ft.train_or_test(ft.split_stratified(labelled(spark, sf_dir))).select("code", F.col("ts").cast("string").alias("ts"), "part", "train"),
    LABELLED + ", p as (select *, ((row_number() over (partition by ts order by fwd_close1 nulls first, code)) - 1) % 10 as part from f) select code, cast(ts as varchar) as ts, part, part < 7 as train from p",
)
register(
    "feat_market_regime_split",
    lambda spark, sf_dir: ft.market_regime_split(df := labelled(spark, sf_dir), ft.market_performance(df), 0.6).groupBy("bad").agg(F.count("*").alias("n"), F.countDistinct("ts").alias("days")),
    PERF + " select high1_1 <= 0.6 as bad, count(*) as n, count(distinct f.ts) as days from f join p using (ts) group by 1",
)
SIZES = ("s", "m", "l", "xl")
FLOW_OUT = [f"net_{s}" for s in SIZES] + ["gross", "largest"] + [f"{k}_{s}" for s in SIZES for k in ("sum3", "sum5", "chg", "ratio35")]
WD = "(partition by code order by date)"


def _flow_sql() -> str:
    last = lambda n: f"(partition by code order by date rows between {n - 1} preceding and current row)"
    wide = ", ".join(f"coalesce(sum(net) filter (where size = '{s}'), 0) as net_{s}" for s in SIZES)
    sums = ", ".join(f"case when count(*) over {last(n)} >= {n} then sum(net_{s}) over {last(n)} end as sum{n}_{s}" for s in SIZES for n in (3, 5))
    gross = " + ".join(f"abs(net_{s})" for s in SIZES)
    big = "greatest(" + ", ".join(f"abs(net_{s})" for s in SIZES) + ")"
    more = ", ".join(f"net_{s} - lag(net_{s}) over {WD} as chg_{s}, sum3_{s} / nullif(sum5_{s}, 0) as ratio35_{s}" for s in SIZES)
    out = ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in FLOW_OUT)
    return f"{q.views('money_flow')}, w as (select code, date, {wide} from money_flow group by 1, 2), x as (select *, {gross} as gross, {big} / nullif({gross}, 0) as largest, {sums} from w), y as (select *, {more} from x) select code, cast(date as varchar) as date, {out} from y"


register(
    "feat_money_flow_metrics",
    lambda spark, sf_dir: ft.money_flow_metrics(views.money_flow(spark, sf_dir)).select("code", F.col("date").cast("string").alias("date"), *[stable(F.col(c)).alias(c) for c in FLOW_OUT]),
    _flow_sql(),
)
register(
    "feat_profit_ratio_rank",
    lambda spark, sf_dir: ft.profit_ratio_rank(bars(spark, sf_dir)).select("code", F.col("ts").cast("string").alias("ts"), "rank", "rank_gain"),
    q.base() + f", r as (select code, ts, 1 + (select count(*) from b o where o.code = b.code and o.rn < b.rn and o.turnover < b.turnover) as rank from b) select code, cast(ts as varchar) as ts, rank, rank - lag(rank) over {q.W} as rank_gain from r",
)


# -- whole feature sets: each column by its own SQL ------------------------------------------------
from .indicator_queries import LOHI, MACDS  # noqa: E402

BANDS20 = lambda x: {"boll_mid": q.ma(x, 20), "boll_up": f"{q.ma(x, 20)} + {q.std(x, 20)} * 2", "boll_low": f"{q.ma(x, 20)} - {q.std(x, 20)} * 2"}


def technical_sql(prefix: str = "") -> list[dict[str, str]]:
    """Stages of ``technical``; with a prefix every column has it."""
    import re

    stages = [
        {"_d": f"close - {R('close')}"},
        {"_g": "case when _d is not null then greatest(_d, 0) end", "_l": "case when _d is not null then greatest(-_d, 0) end"} | LOHI | BANDS20("close"),
        {"_ag": q.wilder("_g", 14), "_al": q.wilder("_l", 14), "_fast": f"case when _hi = _lo then 0 else {D('(close - _lo) * 100', '_hi - _lo')} end", "willr": f"case when _hi = _lo then 0 else {D('(_hi - close) * -100', '_hi - _lo')} end"},
        {"rsi": f"case when _ag is not null then coalesce({D('_ag * 100', '_ag + _al')}, 0) end", "_k": q.ma("_fast", 3)},
        {"stoch_d": q.ma("_k", 3)},
        {"stoch_k": "case when stoch_d is not null then _k end"},
        *MACDS,
        {"dif": "dif_s", "dea": "dea_s", "hist": "macd_s", "bar": "macd_s * 2"},
    ]
    if not prefix:
        return stages
    own = {n for st in stages for n in st} | {"open", "high", "low", "close"}
    put = lambda x: re.sub(r"[A-Za-z_][A-Za-z_0-9]*", lambda m: prefix + m[0] if m[0] in own else m[0], x)
    return [{prefix + n: put(e) for n, e in st.items()} for st in stages]


def crossing_sql(keys) -> dict[str, str]:
    return {k: v for a, b in combinations(keys, 2) for k, v in {f"{a}_over_{b}": SIG(f"{R(a)} - {R(b)} < 0 and {a} - {b} > 0") + "::int", f"{a}_under_{b}": SIG(f"{R(a)} - {R(b)} > 0 and {a} - {b} < 0") + "::int"}.items()}


def analysis_sql(keys, windows) -> list[dict[str, str]]:
    """Stages of places, streaks and flags."""
    flags = {}
    for k in keys:
        for n in windows:
            flags |= {f"{k}_is_max{n}": SIG(f"{k} = {q.hhv(k, n)}") + "::int", f"{k}_is_min{n}": SIG(f"{k} = {q.llv(k, n)}") + "::int", f"{k}_above{n}": SIG(f"{k} > {q.ma(k, n)}") + "::int", f"{k}_below{n}": SIG(f"{k} < {q.ma(k, n)}") + "::int"}
        for n in windows[-2:]:
            flags[f"{k}_pos{n}"] = f"coalesce({D(f'{k} - {q.llv(k, n)}', f'{q.hhv(k, n)} - {q.llv(k, n)}')}, 0)"
    return [
        {f"_{k}_{n}": SIG(f"{k} {o} {R(k)}") for k in keys for n, o in (("rise", ">"), ("fall", "<"))},
        {f"{k}_{n}": f"rn - coalesce(max(case when not _{k}_{c} then rn end) over {q.UPTO}, 0)" for k in keys for n, c in (("up", "rise"), ("down", "fall"))},
        {f"{k}_turn_{n}": SIG(f"{k}_{n} > 0 and {R(f'{k}_{o}')} = 1") + "::int" for k in keys for n, o in (("up", "down"), ("down", "up"))} | flags,
    ]


def set_sql(stages: list[dict[str, str]], out: list[str], warmup: int, head: str) -> str:
    text, last = head, "b"
    for i, stage in enumerate(stages):
        text += f", s{i} as (select *, " + ", ".join(f"{e} as {n}" for n, e in stage.items()) + f" from {last})"
        last = f"s{i}"
    return f"{text} select code, cast(ts as varchar) as ts, " + ", ".join(f"round(coalesce({c}, 0) + 1e-9, 5) as {c}" for c in out) + f" from {last} where rn > {warmup}"


def rounded(df, out):
    return df.select("code", F.col("ts").cast("string").alias("ts"), *[F.round(F.col(c).cast("double") + 1e-9, 5).alias(c) for c in out])


TECH = ["stoch_k", "stoch_d", "willr", "boll_up", "boll_mid", "boll_low", "rsi", "dif", "dea", "hist", "bar"]
register("feat_technical", lambda spark, sf: rounded(ft.technical(bars(spark, sf)).na.fill(0, TECH), TECH), set_sql(technical_sql(), TECH, 0, q.base()))
AKEYS = ["close", "turnover", "close_chg3", "rsi", "bar", "boll_up", "amp5"]
GAPS = ("close_chg3", "close_chg5", "close_chg10")
LINES3 = ("close", "m3", "m5", "m10", "boll_up", "boll_low")
DATA = [
    {"_gap": SIG(f"date_diff('day', {R('ts')}, ts) > 1")} | {f"close_chg{p}": PCT(D(f"close - {R('close', p)}", R("close", p))) for p in (3, 5, 10)},
    {f"pre{i}": PRE.format(i) for i in (1, 2, 3)} | crossing_sql(GAPS),
    *technical_sql(),
    {f"amp{n}": PCT(D(f"max(high) over {q.past(n)} - min(low) over {q.past(n)}", R("close", n - 1))) for n in (1, 3, 5, 10)},
    *analysis_sql(AKEYS, (3, 5, 10)),
    {f"m{n}": q.ma("close", n) for n in (3, 5, 10)},
    crossing_sql(LINES3),
]
DATA_OUT = [*GAPS, *TECH, "amp1", "amp3", "amp5", "amp10", *crossing_sql(GAPS), *[f"{k}_{x}" for k in AKEYS for x in ("pos5", "pos10", "up", "down", "turn_up", "turn_down", "is_max3", "is_min10", "above5", "below10")], *crossing_sql(LINES3)]
register("feat_data_features", lambda spark, sf: rounded(ft.data_features(bars(spark, sf), AKEYS), DATA_OUT), set_sql(DATA, DATA_OUT, 26, q.base()))
TWO = ("sz_", "sh_")
WIDE = (
    q.base("day", quoted=False)
    + ", w0 as (select a.ts, " + ", ".join(f"{s}.{c} as {p}{c}" for s, p in (("a", "sz_"), ("c", "sh_")) for c in ("open", "high", "low", "close", "amount")) + " from b a join b c on a.ts = c.ts and a.code = '1-URGENT' and c.code = '2-HIGH'), "
)
IKEYS = [f"{p}{c}" for p in TWO for c in ("close", "rsi", "close_chg1", "amp3")]
ICHG = [f"{p}close_chg{n}" for p in TWO for n in (1, 3)]
INDEX = [
    {f"{p}close_chg{n}": PCT(D(f"{p}close - {R(f'{p}close', n)}", R(f"{p}close", n))) for p in TWO for n in (1, 3, 5)},
    crossing_sql(ICHG),
    *technical_sql("sz_"),
    *technical_sql("sh_"),
    {f"{p}amp{n}": PCT(D(f"max({p}high) over {q.past(n)} - min({p}low) over {q.past(n)}", R(f"{p}close", n - 1))) for p in TWO for n in (1, 3, 5)},
    *analysis_sql(IKEYS, (3, 5)),
    {f"{p}m{n}": q.ma(f"{p}close", n) for p in TWO for n in (3, 5)},
    {k: v for p in TWO for k, v in crossing_sql((f"{p}close", f"{p}m3", f"{p}m5", f"{p}boll_up", f"{p}boll_low")).items()},
]
INDEX_OUT = [*INDEX[0], *[f"{p}{c}" for p in TWO for c in TECH], *[f"{p}amp{n}" for p in TWO for n in (1, 3, 5)], *[f"{k}_{x}" for k in IKEYS for x in ("pos3", "pos5", "up", "down", "turn_up", "is_max3", "above5")], *INDEX[-1]]


def _index_features(spark, sf):
    from ..operators import bars as br

    day = views.bars_day(spark, sf)
    wide = br.index_join_wide(day.filter("code = '1-URGENT'"), day.filter("code = '2-HIGH'"), "sz", "sh").withColumn("code", F.lit("index"))
    from .build import S

    return rounded(ft.index_features(S.numbered(wide), TWO, IKEYS), INDEX_OUT)


register("feat_index_features", _index_features, set_sql(INDEX, INDEX_OUT, 0, WIDE.replace(" b as (select *, row", " b as (select *, row") + "b2 as (select 'index' as code, *, row_number() over (order by ts) as rn from w0)").replace("s0 as (select *, ", "s0 as (select *, ", 1).replace(" from b)", " from b2)", 1))
