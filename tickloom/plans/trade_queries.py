"""Queries of trade matching and of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as sm
from ..operators import trades as tr
from ..sources import views
from . import sqltext as q
from .build import S, bars, register, stable

C = F.col
#: A signal for the examples: under the mean of ten bars by more than half.
BUY = f"case when {q.ma('close', 10)} is not null and close < {q.ma('close', 10)} * 0.5 then true else false end"
HOUR = q.base() + f", s as (select *, {BUY} as buy, sum(close) over {q.UPTO} as cs, max(rn) over (partition by code) as n, last_value(close) over (partition by code order by ts rows between unbounded preceding and unbounded following) as last_close, last_value(ts) over (partition by code order by ts rows between unbounded preceding and unbounded following) as last_ts from b)"
COLS = ["buy_price", "sell_price", "cost", "profit"]


def signals(spark, sf):
    return bars(spark, sf).withColumn("buy", F.coalesce(C("close") < S.ma("close", 10) * 0.5, F.lit(False)))


def ledger_out(df):
    return df.select("code", "buy_ts", "sell_ts", "shares", "days_held", "buy_index", *[stable(C(c)).alias(c) for c in COLS])


OUT = "code, buy_ts::varchar as buy_ts, sell_ts::varchar as sell_ts, shares, days_held, buy_index, " + ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in COLS)
FIRST = HOUR + """, e as (select s.code, s.ts as buy_ts, s.close as buy_price, s.rn, s.n, s.last_close, s.last_ts, (select min(o.rn) from b o where o.code = s.code and o.rn > s.rn and o.high > s.close) as j from s where buy),
l as (select e.code, e.buy_ts, e.buy_price, coalesce(o.ts, e.last_ts) as sell_ts, coalesce(o.high, e.last_close) as sell_price, 100 as shares, e.buy_price * 100 as cost, (coalesce(o.high, e.last_close) - e.buy_price) * 100 as profit, coalesce(j, e.n) - e.rn as days_held, e.rn - 1 as buy_index from e left join b o on o.code = e.code and o.rn = e.j)"""
register("trade_exit_first_high", lambda spark, sf: ledger_out(tr.exit_first_high(signals(spark, sf))), FIRST + f" select {OUT} from l")


def _average_sql(days: int | None) -> str:
    goal = "ceil(round(round((o.cs_before - s.cs_before) / (o.rn - s.rn), 9) * 1.0025 * 100, 7)) / 100"
    cap = f" and o.rn - s.rn <= {days}" if days else ""
    return HOUR + f""", t as (select *, cs - close as cs_before from s),
    c as (select s.code, s.rn, min(o.rn) as j from t s join t o on o.code = s.code and o.rn > s.rn{cap} where s.buy and o.high >= {goal} group by 1, 2),
    x as (select s.*, c.j, coalesce(c.j, {f'least(s.n, s.rn + {days})' if days else 's.n'}) as k from t s left join c on c.code = s.code and c.rn = s.rn where s.buy),
    y as (select x.code, x.ts as buy_ts, x.rn, x.n, x.j, x.k, o.ts as sell_ts, o.open as o_open, o.close as o_close, o.rn as o_rn,
      case when x.j is null and x.k = x.n {f'and x.k - x.rn < {days}' if days else ''} then x.k - x.rn + 1 else greatest(x.k - x.rn, 1) end as m, x.cs_before, o.cs_before as o_before, o.cs as o_cs from x join t o on o.code = x.code and o.rn = x.k),
    z as (select *, round((case when m = k - rn + 1 then o_cs else o_before end - cs_before) / m, 9) as buy_price from y),
    l as (select code, buy_ts, sell_ts, buy_price, case when j is not null then greatest(ceil(round(buy_price * 1.0025 * 100, 7)) / 100, o_open) else o_close end as sell_price, m * 100 as shares, k - rn as days_held, rn - 1 as buy_index from z),
    w as (select *, buy_price * shares as cost, (sell_price - buy_price) * shares as profit from l)"""


register("trade_exit_average_down", lambda spark, sf: ledger_out(tr.exit_average_down(signals(spark, sf))), _average_sql(None) + f" select {OUT} from w")
register("trade_exit_average_down_capped", lambda spark, sf: ledger_out(tr.exit_average_down(signals(spark, sf), 2)), _average_sql(2) + f" select {OUT} from w")
register("trade_hold_one_position", lambda spark, sf: ledger_out(tr.hold_one_position(signals(spark, sf))))
register("trade_hold_one_position_average", lambda spark, sf: ledger_out(tr.hold_one_position(signals(spark, sf), True)))
register("trade_target_price", lambda spark, sf: bars(spark, sf).select("code", C("ts").cast("string").alias("ts"), tr.target_price(C("close")).alias("goal")), q.base() + " select code, cast(ts as varchar) as ts, ceil(round(close * 1.0025 * 100, 7)) / 100 as goal from b")
register(
    "trade_label_every_bar",
    lambda spark, sf: tr.label_every_bar(bars(spark, sf)).select("code", "ts", stable(C("profit")).alias("profit"), "days_held"),
    FIRST.replace("where buy)", ")").replace("from s where buy", "from s") + " select code, buy_ts::varchar as ts, round(profit + 1e-9, 6) as profit, days_held from l",
)
PATHS = q.base() + f", p as (select code, ts, (max(high) over (partition by code order by ts rows between 1 following and 3 following) / close - 1) * 100 as best, (lead(close, 3) over {q.W} / close - 1) * 100 as last from b)"
register(
    "trade_sell_threshold_grid",
    lambda spark, sf: tr.sell_threshold_grid(
        bars(spark, sf).select(((F.max("high").over(S.w.rowsBetween(1, 3)) / C("close") - 1) * 100).alias("best"), ((F.lead("close", 3).over(S.w) / C("close") - 1) * 100).alias("last")).filter("last is not null"), spark.range(0, 101).select((C("id") / 10).alias("goal"))
    ).select("goal", F.round(C("profit") + 1e-9, 4).alias("profit"), "sold"),
    PATHS + ", g as (select unnest(range(0, 101)) / 10 as goal) select goal, round(sum(case when best >= goal then goal else last end) + 1e-9, 4) as profit, count(*) filter (where best >= goal) as sold from p, g where last is not null group by goal",
)
FOL = [f"{c}{k}" for c in ("high", "close") for k in (1, 2)]
register("trade_attach_following_days", lambda spark, sf: tr.attach_following_days(bars(spark, sf)).select("code", C("ts").cast("string").alias("ts"), *FOL), q.base() + " select code, cast(ts as varchar) as ts, " + ", ".join(f"coalesce(lead({c}, {k}) over {q.W}, {c}) as {c}{k}" for c in ("high", "close") for k in (1, 2)) + " from b")
register(
    "trade_outcome_of_selection",
    lambda spark, sf: tr.exit_first_high(signals(spark, sf)).filter("hour(buy_ts) < 12").groupBy("code").agg(F.count("*").alias("n"), F.avg((C("days_held") > 1).cast("double")).alias("bad"), (F.sum("profit") * 10000 / F.sum("cost")).alias("p10k")).select("code", "n", stable(C("bad")).alias("bad"), stable(C("p10k")).alias("p10k")),
    FIRST + " select code, count(*) as n, round(avg((days_held > 1)::int) + 1e-9, 6) as bad, round(sum(profit) * 10000 / sum(cost) + 1e-9, 6) as p10k from l where hour(buy_ts) < 12 group by code",
)

# -- summaries -----------------------------------------------------------------------------------


def ledger(spark, sf):
    return tr.exit_first_high(signals(spark, sf))


def r6(*names):
    return [stable(C(c)).alias(c) for c in names]


def s6(*names):
    return ", ".join(f"round({c} + 1e-9, 6) as {c}" for c in names)


SUMS = "count(*) as trade_count, sum(profit) as total_profit, sum(cost) as total_cost, count(*) filter (where days_held > 1) as slow_count, sum(days_held)::bigint as days_held"
AGES = ", ".join(f"count(*) filter (where buy_ts::date >= date '2024-02-01' - interval {12 * y} month) as last_{y}y" for y in (1, 2, 3))
register("agg_trade_summary", lambda spark, sf: sm.trade_summary(ledger(spark, sf), ["code"], 1, "2024-02-01").select("code", "trade_count", "slow_count", "days_held", "last_1y", "last_2y", "last_3y", *r6("total_profit", "total_cost")), FIRST + f", a as (select code, {SUMS}, {AGES} from l group by code) select code, trade_count, slow_count, days_held, last_1y, last_2y, last_3y, {s6('total_profit', 'total_cost')} from a")
register("agg_trade_summary_by_period", lambda spark, sf: sm.trade_summary_by_period(ledger(spark, sf), "week").select("period", "trade_count", "slow_count", "days_held", *r6("total_profit", "total_cost")), FIRST + f", p as (select *, date_trunc('week', buy_ts)::date::varchar as period from l), a as (select period, {SUMS} from p group by 1 union all select 'all', {SUMS} from p) select period, trade_count, slow_count, days_held, {s6('total_profit', 'total_cost')} from a")
RATIOS = ("ratio", "average_days_held", "average_profit", "profit_10k")
DERIVED = "slow_count / trade_count as ratio, days_held / trade_count as average_days_held, total_profit / trade_count as average_profit, total_profit * 10000 / total_cost as profit_10k"
register(
    "agg_merge_partials",
    lambda spark, sf: sm.merge_partials(sm.trade_summary(ledger(spark, sf).withColumn("month", F.month("buy_ts")), ["code", "month"], 1, "2024-02-01"), ["code"]).select("code", "trade_count", *r6(*RATIOS)),
    FIRST + f", a as (select code, {SUMS} from l group by code), d as (select *, {DERIVED} from a) select code, trade_count, {s6(*RATIOS)} from d",
)
register("agg_fitness", lambda spark, sf: sm.fitness(sm.derived(sm.trade_summary(ledger(spark, sf), ["code"], 1, "2024-02-01"))).select("code", *r6("fitness")), FIRST + f", a as (select code, {SUMS} from l group by code), d as (select *, {DERIVED} from a) select code, round(ln(trade_count) / (ratio + 0.01) + 1e-9, 6) as fitness from d")
register(
    "agg_portfolio_report",
    lambda spark, sf: sm.portfolio_report(ledger(spark, sf), bars(spark, sf)).select("trade_count", "date_count", "all_days", "first", "last", "slow_count", *r6("total_profit", "total_cost", "date_ratio", "slow_ratio")),
    FIRST + ", a as (select count(*) as trade_count, count(distinct buy_ts::date) as date_count, (select count(distinct ts::date) from b) as all_days, min(buy_ts)::varchar as first, max(buy_ts)::varchar as last, count(*) filter (where days_held > 1) as slow_count, sum(profit) as total_profit, sum(cost) as total_cost from l), d as (select *, date_count / all_days as date_ratio, slow_count / trade_count as slow_ratio from a) select trade_count, date_count, all_days, first, last, slow_count, " + s6("total_profit", "total_cost", "date_ratio", "slow_ratio") + " from d",
)
VOTES = q.views("votes")
register("agg_interval_histogram", lambda spark, sf: sm.interval_histogram(views.votes(spark, sf), "prob", 0.1, 12).select("bin", "n", *r6("share")), VOTES + ", f as (select floor(prob / 0.1::double + 1e-9)::int as bin, count(*) as n from votes group by 1), e as (select unnest(range(12))::int as bin) select bin, coalesce(n, 0) as n, round(coalesce(n, 0) / (select count(*) from votes) + 1e-9, 6) as share from e left join f using (bin)")
NUM = ["open", "high", "low", "close", "volume", "amount"]
register("agg_column_range_rank", lambda spark, sf: sm.column_range_rank(bars(spark, sf), NUM).select("name", *r6("spread"), "place"), q.base() + ", r as (" + " union all ".join(f"select '{c}' as name, max({c}) - min({c}) as spread from b" for c in NUM) + ") select name, round(spread + 1e-9, 6) as spread, row_number() over (order by spread desc, name) as place from r")
register("agg_select_stats", lambda spark, sf: sm.select_stats(views.votes(spark, sf), "prob", 0.6).select("n", "days", "low", "low_days", *r6("low_share", "low_day_share")), VOTES + ", a as (select count(*) as n, count(distinct date) as days, count(*) filter (where prob < 0.6) as low, count(distinct case when prob < 0.6 then date end) as low_days from votes) select *, round(low / n + 1e-9, 6) as low_share, round(low_days / days + 1e-9, 6) as low_day_share from a")
register("agg_group_transform", lambda spark, sf: sm.group_transform(views.votes(spark, sf), ["date", "model"], "prob").select("vote_id", "group_n", *r6("group_mean", "group_max")), VOTES + " select vote_id, count(*) over w as group_n, round(avg(prob) over w + 1e-9, 6) as group_mean, round(max(prob) over w + 1e-9, 6) as group_max from votes window w as (partition by date, model)")
LV = (50, 60, 70, 80)
register("agg_detail_threshold_counts", lambda spark, sf: sm.detail_threshold_counts(views.votes(spark, sf)).select(C("date").cast("string").alias("date"), "code", "n", *[f"n{v}" for v in LV], *r6(*[f"share{v}" for v in LV])), VOTES + ", a as (select date, code, count(*) as n, " + ", ".join(f"count(*) filter (where prob >= {v / 100}) as n{v}" for v in LV) + " from votes group by 1, 2) select date::varchar as date, code, n, " + ", ".join(f"n{v}" for v in LV) + ", " + ", ".join(f"round(n{v} / n + 1e-9, 6) as share{v}" for v in LV) + " from a")
register("agg_weighted_share", lambda spark, sf: sm.weighted_share(views.votes(spark, sf), "prob", ~C("hit")).select(F.round("weight", 4).alias("weight"), *r6("share")), VOTES + " select round(sum(case when not hit then prob else 0 end), 4) as weight, round(sum(case when not hit then prob else 0 end) / sum(prob) + 1e-9, 6) as share from votes")
GRID = list(range(-10, 11, 2))
register(
    "agg_fail_rate_grid",
    lambda spark, sf: sm.fail_rate_grid(bars(spark, sf).select("code", C("chg").alias("a"), (C("amplitude") - 50).alias("b")), ["code"], ["a", "b"], GRID).select("code", "name", "level", "n", "fails", *r6("rate")),
    q.base() + ", l as (select code, 'a' as name, chg as value from b union all select code, 'b', amplitude - 50 from b), g as (select unnest([" + ", ".join(map(str, GRID)) + "]) as level), a as (select code, name, level, count(value) as n, count(*) filter (where value < level) as fails from l, g group by 1, 2, 3) select code, name, level, n, fails, round(fails / n + 1e-9, 6) as rate from a",
)
register("agg_quantile_cut", lambda spark, sf: sm.quantile_cut(bars(spark, sf), "volume", "amount").select("code", C("ts").cast("string").alias("ts")), q.base() + ", c as (select quantile_cont(volume, 0.25) as qa, quantile_cont(amount, 0.25) as qb from b) select code, cast(ts as varchar) as ts from b, c where volume > qa and amount > qb")
HOLD = "with h as (select p_brand as owner, l_suppkey as member, round(sum(l_extendedprice), 2) as weight from lineitem join part on l_partkey = p_partkey group by 1, 2)"


def _holdings(spark, sf):
    t = lambda n: views.table(spark, sf, n)
    return t("lineitem").join(t("part").select("p_partkey", "p_brand"), C("l_partkey") == C("p_partkey")).groupBy(C("p_brand").alias("owner"), C("l_suppkey").alias("member")).agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"))


register("agg_top_holdings", lambda spark, sf: sm.top_holdings(_holdings(spark, sf)), HOLD + ", r as (select *, row_number() over (partition by owner order by weight desc, member) as place from h) select owner, string_agg(member::varchar, ',' order by place) as members from r where place <= 10 group by owner")
register("agg_order_quantities", lambda spark, sf: sm.order_quantities(views.table(spark, sf, "lineitem").select(C("l_suppkey").alias("id"), C("l_quantity").alias("qty"))), "with a as (select l_suppkey as id, sum(l_quantity) as qty from lineitem group by 1) select id, qty, row_number() over (order by qty desc, id) as place from a")
