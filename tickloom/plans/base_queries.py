"""Queries of cleaning, bar building and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as br
from ..operators import clean as cl
from ..operators import joins as jn
from ..sources import views
from . import sqltext as q
from .build import bars, register, stable

C = F.col
R, SIG = q.ref, q.sig
DAY = q.base("day")
TS = "cast(ts as varchar) as ts"
SUM = "count(*) as n, min(ts)::varchar as first_ts, round(sum(close) + 1e-9, 4) as total"


def summary(df):
    """Rows, first bar and sum of closes for each code: enough to see which rows a filter kept."""
    return df.groupBy("code").agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first_ts"), F.round(F.sum("close") + 1e-9, 4).alias("total"))


def kept(name, op, sql, kind="day"):
    register(f"clean_{name}", lambda spark, sf: summary(op(bars(spark, sf, kind))), f"{sql} group by code")


kept("valid_price", lambda d: cl.valid_price(d.withColumn("close", C("close") - 90000)), DAY + f", v as (select * replace (close - 90000 as close) from b) select code, {SUM} from v where close > 0")
kept("date_range", lambda d: cl.date_range(d, "1993-01-01", "1995-06-30"), DAY + f" select code, {SUM} from b where ts > date '1993-01-01' and ts < date '1995-06-30'")
kept("date_range_closed", lambda d: cl.date_range(d, "1993-01-01", "1995-06-30", True), DAY + f" select code, {SUM} from b where ts between date '1993-01-01' and date '1995-06-30'")
kept("gap_cut", lambda d: cl.gap_cut(d, 3), DAY + f", g as (select *, date_diff('day', ts, lead(ts) over {q.W}) as gap from b), c as (select code, arg_max(ts, gap * 100000 - rn) as cut from g where gap > 3 group by code) select code, {SUM} from b left join c using (code) where cut is null or ts > cut")
kept("data_filter", cl.data_filter, DAY + f", k as (select * from b where chg <= 0 or greatest(open, high, low, close) - least(open, high, low, close) >= 0.01), l as (select *, chg <= limit_rate - 1 / nullif(lag(close) over {q.W}, 0) as ok from k) select code, {SUM} from l where ok")
kept("warmup_drop", cl.warmup_drop, DAY + f" select code, {SUM} from b where rn > 26")
register(
    "clean_abnormal_split",
    lambda spark, sf: cl.abnormal_split(bars(spark, sf, "day"), C("chg") > 300).groupBy("code", "segment").agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first_ts")),
    DAY + f", f as (select *, {SIG('chg > 300')} as bad, sum({SIG('chg > 300')}::int) over {q.UPTO} as segment from b) select code, segment::bigint as segment, count(*) as n, min(ts)::varchar as first_ts from f where not bad group by 1, 2 having count(*) >= 26",
)
register("clean_tradable_base", lambda spark, sf: cl.limit_band(cl.tradable_base(bars(spark, sf))).select("code", C("ts").cast("string").alias("ts"), "buy", "in_band"), q.base() + f" select code, {TS}, {SIG('chg < limit_rate * 0.95')} as buy, {SIG('chg between -(limit_rate - 1 / close) and limit_rate - 1 / close')} as in_band from b")
register("clean_new_listing_flag", lambda spark, sf: cl.new_listing_flag(bars(spark, sf)).select("code", C("ts").cast("string").alias("ts"), "new", "seasoned"), q.base() + f" select code, {TS}, rn <= 101 as new, rn >= 101 as seasoned from b")
register("clean_fill_zero", lambda spark, sf: cl.fill_zero(bars(spark, sf), ["chg", "amplitude"]).select("code", C("ts").cast("string").alias("ts"), stable(C("chg")).alias("chg"), stable(C("amplitude")).alias("amplitude")), q.base() + f" select code, {TS}, round(coalesce(chg, 0) + 1e-9, 6) as chg, round(coalesce(amplitude, 0) + 1e-9, 6) as amplitude from b")


def _debtors(spark, sf):
    return views.table(spark, sf, "supplier").filter("s_acctbal < 0").select(C("s_suppkey").alias("code"))


register(
    "clean_board_filter",
    lambda spark, sf: cl.board_filter(views.universe(spark, sf), "type", ("CH", "FR", "GE"), _debtors(spark, sf)).select("code", "name", "type"),
    q.views("universe") + " select code, name, type from universe where substr(type, 1, 2) in ('CH', 'FR', 'GE') and code not in (select s_suppkey from supplier where s_acctbal < 0)",
)
END = "2024-12-31 00:00:00"
PERIODS = q.views("status_posts") + """, r as (select *, coalesce(sum((kind = 'end')::int) over (partition by code order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as run from status_posts where kind != 'other'),
p as (select code, run, min(case when kind = 'start' then ts end) as begin, coalesce(max(case when kind = 'end' then ts end), timestamp '2024-12-31 00:00:00') as fin from r group by 1, 2 having min(case when kind = 'start' then ts end) is not null)"""


def periods(spark, sf):
    return cl.status_periods(views.status_posts(spark, sf), F.lit(END).cast("timestamp"))


register("clean_status_periods", lambda spark, sf: periods(spark, sf).select("code", C("begin").cast("string").alias("begin"), C("end").cast("string").alias("fin")), PERIODS + " select code, begin::varchar as begin, fin::varchar as fin from p")
register(
    "clean_status_periods_adjacent",
    lambda spark, sf: cl.status_periods_adjacent(views.status_posts(spark, sf)).select("code", C("begin").cast("string").alias("begin"), C("end").cast("string").alias("fin"), "n"),
    q.views("status_posts") + ", r as (select *, sum((kind != 'start')::int) over (partition by code order by ts, event_id) as island from status_posts) select code, min(ts)::varchar as begin, max(ts)::varchar as fin, count(*) as n from r where kind = 'start' group by code, island",
)
register(
    "clean_limit_rate",
    lambda spark, sf: cl.limit_rate(views.bars_user_day(spark, sf), periods(spark, sf)).select("code", C("ts").cast("string").alias("ts"), "limit_rate"),
    PERIODS + f", b as ({q.BARS['user_day']}) select code, {TS}, case when open = high and high = low and low = close then 0 when exists (select 1 from p where p.code = b.code and b.ts between p.begin::date and p.fin::date) then 5 else 10 end as limit_rate from b",
)
register(
    "clean_universe_filter",
    lambda spark, sf: cl.universe_filter(views.universe(spark, sf), ["BRAZIL", "CHINA"], "7", "77", "[0-9]$").select("code", "name"),
    q.views("universe") + ", k as (select *, regexp_replace(name, '[0-9]$', '') as base from universe where type not in ('BRAZIL', 'CHINA') and not (regexp_matches(name, '7') and not regexp_matches(name, '77'))), n as (select *, row_number() over (partition by base order by name, code) as n from k) select code, name from n where n = 1",
)


def _words(spark, sf):
    return views.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.right("s_name", F.lit(2)).alias("word")).distinct()


WORDS = q.views("universe") + ", w as (select distinct right(s_name, 2) as word from supplier where s_acctbal < 0)"
register("clean_blacklist", lambda spark, sf: cl.blacklist(views.universe(spark, sf), _words(spark, sf))[0].select("code", "name"), WORDS + " select code, name from universe where not exists (select 1 from w where contains(name, word))")
register("clean_blacklist_unused", lambda spark, sf: cl.blacklist(views.universe(spark, sf).filter("type < 'G'"), _words(spark, sf))[1], WORDS + " select word from w where not exists (select 1 from universe where type < 'G' and contains(name, word))")
RETS = q.views("fund_ret")
register(
    "clean_jump_filter",
    lambda spark, sf: cl.jump_filter(views.fund_ret(spark, sf), most=0.0099, jump=0.005, calm=0.0045).select("code", stable(C("top")).alias("top"), stable(C("rest")).alias("rest")),
    RETS + ", k as (select *, row_number() over (partition by code order by ret desc, date) as n from fund_ret), m as (select code, max(ret) as top, stddev_samp(case when n > 3 then ret end) as rest from k group by code) select code, round(top + 1e-9, 6) as top, round(rest + 1e-9, 6) as rest from m where not (top > 0.0099 or coalesce(top > 0.005 and rest < 0.0045, false))",
)

# -- bars ----------------------------------------------------------------------------------------
HOUR = q.base()
DW = "(partition by code, ts::date order by ts rows between unbounded preceding and current row)"
RW = "(partition by code, ts::date order by ts rows between current row and unbounded following)"


def cols(df, names, key=("code",), digits=True):
    return df.select(*key, C("ts").cast("string").alias("ts"), *[stable(C(c)).alias(c) for c in names])


def rnd(names):
    return ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in names)


DAYCOLS = ["day_open", "day_high", "day_low", "day_volume", "day_amount"]
register("bars_running_day_bar", lambda spark, sf: cols(br.running_day_bar(bars(spark, sf)), DAYCOLS), HOUR + f", d as (select *, first_value(open) over {DW} as day_open, max(high) over {DW} as day_high, min(low) over {DW} as day_low, sum(volume) over {DW} as day_volume, sum(amount) over {DW} as day_amount from b) select code, {TS}, {rnd(DAYCOLS)} from d")
register("bars_rest_of_day_extrema", lambda spark, sf: cols(br.rest_of_day_extrema(bars(spark, sf)), ["rest_high", "rest_low"]), HOUR + f" select code, {TS}, max(high) over {RW} as rest_high, min(low) over {RW} as rest_low from b")
OHLC = ["open", "high", "low", "close", "volume", "amount"]
for _unit in ("day", "week", "month"):
    register(
        f"bars_resample_{_unit}",
        lambda spark, sf, unit=_unit: br.resample(bars(spark, sf), unit).select("code", C("bar").cast("string").alias("bar"), *[stable(C(c)).alias(c) for c in OHLC]),
        HOUR + f", d as (select code, date_trunc('{_unit}', ts) as bar, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume, sum(amount) as amount from b group by 1, 2) select code, cast(bar::timestamp as varchar) as bar, {rnd(OHLC)} from d",
    )
WHAT = ["move", "close", "high", "low", "chg", "amplitude"]
register(
    "bars_what_if_bar",
    lambda spark, sf: cols(br.what_if_bar(bars(spark, sf), [-5, -1, 1, 5]), WHAT),
    HOUR + f", l as (select * from b qualify row_number() over (partition by code order by ts desc) = 1), m as (select code, ts, m::double as move, close * (1 + m / 100.0::double) as close, high as h, low as l, prev_close as p from l, (select unnest([-5, -1, 1, 5]) as m)), x as (select *, greatest(h, close) as high, least(l, close) as low from m) , y as (select *, (close - p) / p * 100 as chg, (high - low) / p * 100 as amplitude from x) select code, {TS}, {rnd(WHAT)} from y",
)
WIDE = [f"{s}_{c}" for s in ("a", "b") for c in ("open", "high", "low", "close", "amount")]
register(
    "bars_index_join_wide",
    lambda spark, sf: br.index_join_wide((d := views.bars_hour(spark, sf)).filter("code = 'click'"), d.filter("code = 'view'"), "a", "b").select(C("ts").cast("string").alias("ts"), *[stable(C(c)).alias(c) for c in WIDE]),
    HOUR + ", x as (select " + ", ".join(f"{s}.{c} as {s}_{c}" for s in ("a", "e") for c in ("open", "high", "low", "close", "amount")) + ", a.ts from b a join b e on a.ts = e.ts where a.code = 'click' and e.code = 'view') select cast(ts as varchar) as ts, " + ", ".join(f"round({c.replace('b_', 'e_', 1) if c.startswith('b_') else c} + 1e-9, 6) as {c}" for c in WIDE) + " from x",
)
register("bars_market_mean", lambda spark, sf: br.market_mean(bars(spark, sf)).select(C("ts").cast("string").alias("ts"), stable(C("mean_close")).alias("mean_close"), "n"), HOUR + " select cast(ts as varchar) as ts, round(avg(close) + 1e-9, 6) as mean_close, count(*) as n from b group by b.ts")
register("bars_relative_return", lambda spark, sf: cols(br.relative_return(bars(spark, sf)), ["relative"]), HOUR + f" select code, {TS}, round(close / first_value(close) over {q.W} - 1 + 1e-9, 6) as relative from b")
register("bars_adj_nav", lambda spark, sf: br.adj_nav(views.fund_ret(spark, sf)).select("code", C("date").cast("string").alias("date"), stable(C("nav")).alias("nav")), RETS + " select code, date::varchar as date, round(product(1 + ret) over (partition by code order by date rows between unbounded preceding and current row) + 1e-9, 6) as nav from fund_ret")
register("bars_days_until_higher", lambda spark, sf: br.days_until_higher(bars(spark, sf)).select("code", C("ts").cast("string").alias("ts"), "until_higher"), HOUR + f" select code, {TS}, coalesce((select min(o.rn) - b.rn from b o where o.code = b.code and o.rn > b.rn and o.high > b.close), count(*) over (partition by b.code)) as until_higher from b")

# -- joins ---------------------------------------------------------------------------------------
FLOW = q.views("money_flow") + f", b0 as ({q.BARS['day']}), b as ({q.QUOTED} from b0)"
for _how in ("inner", "left", "right", "full"):
    register(
        f"join_{_how}",
        lambda spark, sf, how=_how: (
            views.bars_day(spark, sf).filter("volume > 2").select("code", C("ts").alias("date"), "close").join(views.money_flow(spark, sf).filter("size = 'l'").select("code", "date", "net"), ["code", "date"], how).select("code", C("date").cast("string").alias("date"), "close", "net")
        ),
        FLOW + f" select code, date::varchar as date, close, net from (select code, ts as date, close from b where volume > 2) x {_how} join (select code, date, net from money_flow where size = 'l') y using (code, date)",
    )
for _how, _not in (("semi", ""), ("anti", "not ")):
    register(
        f"join_{_how}",
        lambda spark, sf, how=_how: views.bars_day(spark, sf).select("code", C("ts").alias("date"), "close").join(views.money_flow(spark, sf).filter("size = 'xl'"), ["code", "date"], f"left_{how}").select("code", C("date").cast("string").alias("date"), "close"),
        FLOW + f" select code, ts::varchar as date, close from b where {_not}exists (select 1 from money_flow m where m.code = b.code and m.date = b.ts and size = 'xl')",
    )
register(
    "join_interval",
    lambda spark, sf: views.bars_user_day(spark, sf).join(periods(spark, sf).select("code", C("begin").cast("date").alias("b"), C("end").cast("date").alias("e")), "code").filter("ts between b and e").select("code", C("ts").cast("string").alias("ts")).distinct(),
    PERIODS + f", b as ({q.BARS['user_day']}) select distinct b.code, b.ts::varchar as ts from b join p on p.code = b.code and b.ts between p.begin::date and p.fin::date",
)
register(
    "join_confirm_by_longer_period",
    lambda spark, sf: jn.confirm_by_longer_period(
        bars(spark, sf, "day").select("code", C("ts").cast("timestamp").alias("ts"), (C("close") > C("open")).alias("buy")), br.resample(bars(spark, sf, "day"), "week").select("code", C("bar").alias("ts"), (C("close") > C("open")).alias("buy")), 10
    ).select("code", C("ts").cast("date").cast("string").alias("ts"), "buy"),
    DAY + ", w as (select code, date_trunc('week', ts) as wts, arg_max(close, ts) > arg_min(open, ts) as wbuy from b group by 1, 2), n as (select b.code, b.ts, b.close > b.open as buy, (select arg_min(wbuy, wts) from w where w.code = b.code and w.wts >= b.ts) as nb, (select min(wts) from w where w.code = b.code and w.wts >= b.ts) as nt from b) select code, ts::varchar as ts, buy and coalesce(date_diff('day', ts, nt) <= 10 and nb, false) as buy from n",
)
register(
    "join_next_trading_day",
    lambda spark, sf: jn.next_trading_day(bars(spark, sf, "day")).select("code", C("ts").cast("string").alias("ts"), C("next_ts").cast("string").alias("next_ts"), "next_close"),
    DAY + ", c as (select ts, lead(ts) over (order by ts) as next_ts from (select distinct ts from b)) select b.code, b.ts::varchar as ts, c.next_ts::varchar as next_ts, o.close as next_close from b join c on b.ts = c.ts left join b o on o.code = b.code and o.ts = c.next_ts",
)
register("join_pairs", lambda spark, sf: (u := views.fund_ret(spark, sf).select("code").distinct()).join(u.select(C("code").alias("other")), C("code") < C("other")), RETS + ", u as (select distinct code from fund_ret) select a.code, b.code as other from u a join u b on a.code < b.code")
register(
    "join_near_in_parameters",
    lambda spark, sf: jn.near_in_parameters(views.votes(spark, sf).groupBy(F.floor(C("prob") * 100).alias("p"), F.month("date").alias("m")).agg(F.avg(C("hit").cast("double")).alias("rate")), {"p": 3.0, "m": 1.0}, "rate").select("p", "m", stable(C("near_value")).alias("near_value"), "n"),
    q.views("votes") + ", g as (select floor(prob * 100) as p, month(date) as m, avg(hit::int) as rate from votes group by 1, 2), j as (select a.p, a.m, b.rate, pow(0.5::double, abs(a.p - b.p) / 3 + abs(a.m - b.m)) as w from g a join g b on abs(a.p - b.p) <= 3 and abs(a.m - b.m) <= 1) select p::bigint as p, m, round(sum(w * rate) / sum(w) + 1e-9, 6) as near_value, count(*) as n from j group by p, m",
)
register(
    "join_upsert_latest",
    lambda spark, sf: jn.upsert_latest((d := views.bars_day(spark, sf).select("code", "ts", "close", F.when(C("volume") > 1, C("volume")).alias("volume"))).filter("day(ts) <= 20"), d.filter("day(ts) >= 15").withColumn("close", C("close") + 1), ["code", "ts"]).select("code", C("ts").cast("string").alias("ts"), stable(C("close")).alias("close"), "volume"),
    DAY + ", d as (select code, ts, close, case when volume > 1 then volume end as volume from b) select code, ts::varchar as ts, round(coalesce(n.close + 1, h.close) + 1e-9, 6) as close, coalesce(n.volume, h.volume) as volume from (select * from d where day(ts) <= 20) h full join (select * from d where day(ts) >= 15) n using (code, ts)",
)
register(
    "join_append_first_wins",
    lambda spark, sf: jn.append_first_wins((d := views.bars_day(spark, sf).select("code", "ts", "close")).filter("day(ts) <= 20"), d.filter("day(ts) >= 15").withColumn("close", C("close") + 1), ["code", "ts"]).select("code", C("ts").cast("string").alias("ts"), stable(C("close")).alias("close")),
    DAY + " select code, ts::varchar as ts, round(close + case when day(ts) > 20 then 1 else 0 end + 1e-9, 6) as close from b",
)
