"""Queries of result tables of parameter searches, and of the forms of reports that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as rs
from ..operators import selection as se
from ..operators import summaries as sm
from ..operators import trades as tr
from ..sources import views
from . import sqltext as q
from .build import bars, register, stable
from .misc_queries import scratch
from .search_queries import DAYS, REPORT, VOTES, days, report
from .trade_queries import DERIVED, FIRST, SUMS, ledger, r6, s6

C = F.col
SUBSETS = """, sb as (select y.*, count(*) over (partition by date) > 1 as several, row_number() over (partition by date order by votes desc, code) = 1 as biggest from y),
sp as (select *, unnest(list_filter(['data', case when several then 'several' end, case when biggest then 'biggest' end, case when several and biggest then 'biggest_several' end, case when not several then 'single' end], lambda x: x is not null)) as subset from sb)"""
STATS = "count(*) as n, count(distinct date) as days, sum(hit)::bigint as hits, count(distinct case when hit = 0 then date end) as bad_days"
SCOLS = ("success", "bad_share")


def stats_out(keys: str) -> str:
    return f" select {keys}, n, days, hits, bad_days, round(hits / n + 1e-9, 6) as success, round(bad_days / days + 1e-9, 6) as bad_share from st"


def market(spark, sf):
    """Success of each date over all votes."""
    return views.votes(spark, sf).groupBy("date").agg(F.avg(C("hit").cast("double")).alias("success"))


MARKET = ", mk as (select date, avg(hit::int) as success from votes group by 1)"
register("select_detail_analysis", lambda spark, sf: rs.detail_analysis(days(spark, sf)).select("subset", "n", "days", "hits", "bad_days", *r6(*SCOLS)), DAYS + SUBSETS + f", st as (select subset, {STATS} from sp group by 1)" + stats_out("subset"))
RATIOS = [k / 10 for k in range(1, 11)]
register(
    "select_market_ratio_analysis",
    lambda spark, sf: rs.market_ratio_analysis(days(spark, sf), market(spark, sf), RATIOS).select("ratio", "more", "subset", "n", "days", "hits", "bad_days", *r6(*SCOLS)),
    DAYS + MARKET + SUBSETS + f", st as (select ratio, mk.success >= ratio as more, subset, {STATS} from sp join mk using (date), (select unnest([{', '.join(map(str, RATIOS))}])::double as ratio) group by 1, 2, 3)" + stats_out("ratio, more, subset"),
)


def searched(spark, sf):
    """Votes with their model's share of failures and days."""
    votes = views.votes(spark, sf)
    own = votes.groupBy("model").agg(F.avg((~C("hit")).cast("double")).alias("ratio"), F.countDistinct("date").alias("select_days"))
    return votes.join(own, "model")


SEARCHED = VOTES + ", ow as (select model, avg((not hit)::int) as ratio, count(distinct date) as select_days from votes group by 1), y as (select date, code, count(*) as votes, max(hit::int) as hit from votes join ow using (model) where ratio <= 0.7 and select_days >= 50 group by 1, 2 having count(*) >= 1)"
for _subset in ("data", "biggest_several", "single"):
    register(
        f"select_param_filter_{_subset}",
        lambda spark, sf, s=_subset: rs.param_filter(searched(spark, sf), 0.7, 50, 1, s).select(C("date").cast("string").alias("date"), "code", "votes", "hit"),
        SEARCHED + SUBSETS + f" select date::varchar as date, code, votes, hit from sp where subset = '{_subset}'",
    )


def swept(spark, sf):
    """Results of a sweep, each with a key."""
    made = se.nested_sweep(days(spark, sf), {"best": [0.6, 0.7, 0.8, 0.9], "votes": [1, 2]})
    return made.select(F.concat_ws("/", "cut_best", "above_best", "cut_votes", "above_votes").alias("key"), "above_best", F.round("success", 2).alias("success"), "n", "days")


SWEPT = DAYS + ", nw as (select cb, best >= cb as above_best, cv, votes >= cv as above_votes, count(*) as n, count(distinct date) as days, round(avg(hit), 2) as success from y, (select unnest([0.6, 0.7, 0.8, 0.9])::double as cb), (select unnest([1.0, 2.0])::double as cv) group by 1, 2, 3, 4), sw as (select cb::varchar || '/' || above_best::varchar || '/' || cv::varchar || '/' || above_votes::varchar as key, above_best, success, n, days from nw)"
register(
    "select_dedupe_params",
    lambda spark, sf: rs.dedupe_params(swept(spark, sf), ["above_best", "success"]).select("key", "success", "n", "days"),
    SWEPT + " select key, success, n, days from sw qualify row_number() over (partition by above_best, success order by days desc, n desc, key) = 1",
)


def _merged(spark, sf):
    path = scratch(spark)
    rows = swept(spark, sf)
    rows.write.json(f"{path}/first.json")
    rows.withColumn("n", C("n") + 1).write.json(f"{path}/second.json")
    return rs.merge_param_files(spark, f"{path}/*", "key string, above_best boolean, success double, n long, days long", ["key"]).select("key", "file", "n", "days", "success")


register("select_merge_param_files", _merged, SWEPT + " select key, 'first.json' as file, n, days, success from sw")


def by_file(spark, sf):
    """How often each model chose a code on a date and was right, as one file for each model."""
    named = F.concat(C("model"), F.lit("day"), (F.substring("model", 2, 9).cast("int") % 4).cast("string"))
    return views.votes(spark, sf).groupBy(named.alias("file"), "date", "code").agg(F.sum(C("hit").cast("long")).alias("total_count"))


FILES = VOTES + ", fl as (select model || 'day' || (substr(model, 2)::int % 4)::varchar as file, date, code, sum(hit::int)::bigint as total_count from votes group by 1, 2, 3)"
register("select_combined_score", lambda spark, sf: rs.combined_score(by_file(spark, sf)).select(C("date").cast("string").alias("date"), "code", "total", "nonzero", "files", "kinds", "score"), FILES + " select date::varchar as date, code, sum(total_count)::bigint as total, count(*) filter (where total_count > 0) as nonzero, count(*) as files, count(distinct string_split(file, 'day')[2]) as kinds, (sum(total_count) * (count(*) + count(distinct string_split(file, 'day')[2])))::bigint as score from fl group by 1, 2")


def by_band(spark, sf):
    """Votes of each code and date by band of probability (0.5 to 1 in eight bands)."""
    band = F.least(F.floor((C("prob") - 0.5) * 16 + 1e-9), F.lit(7)).cast("int")
    return views.votes(spark, sf).groupBy("date", "code", band.alias("band")).agg(F.count("*").alias("total_count"))


register(
    "select_regime_interpolation",
    lambda spark, sf: rs.regime_interpolation(by_band(spark, sf), market(spark, sf)).select(C("date").cast("string").alias("date"), "code", *r6("total")),
    VOTES + MARKET + """, bb as (select date, code, least(floor((prob - 0.5) * 16 + 1e-9), 7)::int as band, count(*) as total_count from votes group by 1, 2, 3),
    sc as (select date, success * 10 as x, floor(success * 10 + 1e-9)::int as k from mk),
    wt as (select date, 7 as band, 1.0::double as weight from sc where k > 7 union all select date, 0, 1.0 from sc where k < 1 union all select date, k, greatest(x - k, 0) from sc where k between 1 and 7 union all select date, k - 1, 1 - greatest(x - k, 0) from sc where k between 1 and 7),
    rg as (select date, code, sum(total_count * weight) as total from bb join wt using (date, band) group by 1, 2) select date::varchar as date, code, round(total + 1e-9, 6) as total from rg""",
)


def near_table(spark, sf):
    """A result row for each model and level of probability: its failures and parameters."""
    rows = report(spark, sf).filter("picked > 0")
    rank = F.regexp_extract("model", "([0-9]+)", 1).cast("double")
    return rows.select(C("level").alias("threshold"), F.floor(C("days") / 20.0).cast("double").alias("profit"), F.floor(C("good_days") / 20.0).cast("double").alias("highest_profit"), rank.alias("rank"), C("picked").cast("double").alias("total_count"), (C("picked") - C("hits")).cast("double").alias("fail_count"), F.floor(C("level") * 10 + 1e-9).alias("second"), F.lit("all").alias("key"))


NEAR = REPORT + ", nt as (select level as threshold, floor(days / 20)::double as profit, floor(good_days / 20)::double as highest_profit, regexp_extract(model, '([0-9]+)', 1)::double as rank, picked::double as total_count, (picked - hits)::double as fail_count, floor(level * 10 + 1e-9)::bigint as second, 'all' as key from r where picked > 0)"
TARGET = ["threshold", "profit", "highest_profit", "rank"]
NOUT = ("count_total", "total_count", "fail_count", "fail_rate")
register(
    "select_neighbour_fail_rate",
    lambda spark, sf: rs.neighbour_fail_rate(near_table(spark, sf), near_table(spark, sf).select(*TARGET).distinct()).select(*TARGET, "multiple", "shift", "second", "key", *r6(*NOUT)),
    NEAR + """, tg as (select distinct threshold as t1, profit as t2, highest_profit as t3, rank as t4 from nt), ms as (select unnest([0.5, 1, 1.5, 2])::double as m), ps as (select unnest([0, 1]) as p),
    jn as (select *, round(abs(threshold - t1 + 0.05::double * p), 9) as d1, round(abs(profit - t2 + 0.5::double * p), 9) as d2, round(abs(highest_profit - t3 + 0.5::double * p), 9) as d3, abs(rank - t4) as d4 from nt, tg, ms, ps),
    wj as (select *, (1 - d1 / (m * 0.1::double)) * (1 - d2 / (m * 10)) * (1 - d3 / (m * 10)) * (1 - d4 / (m * 10)) as w from jn where d1 <= 0.1::double * m + 1e-9 and d2 <= m + 1e-9 and d3 <= m + 1e-9 and d4 <= m + 1e-9),
    gj as (select t1 as threshold, t2 as profit, t3 as highest_profit, t4 as rank, m as multiple, p as shift, second, key, avg(total_count * w) as total_count, avg(fail_count * w) as fail_count, sum(total_count * w) as count_total from wj group by 1, 2, 3, 4, 5, 6, 7, 8)
    select threshold, profit, highest_profit, rank, multiple, shift, second, key, round(count_total + 1e-9, 6) as count_total, round(total_count + 1e-9, 6) as total_count, round(fail_count + 1e-9, 6) as fail_count, round(round(fail_count / nullif(total_count, 0) + 1e-9, 4) + 1e-9, 6) as fail_rate from gj""",
)
LAGGING = q.base("user_day", quoted=False) + f""", mk as (select ts, avg(close) as close from b group by 1),
mm as (select *, avg(close) over (order by ts rows between 4 preceding and current row) as s, avg(close) over (order by ts rows between 9 preceding and current row) as l, close / first_value(close) over (order by ts) - 1 as market from mk),
mr as (select ts, market, coalesce(s > l and lag(s) over (order by ts) <= lag(l) over (order by ts), false) as market_up from mm),
om as (select *, avg(close) over {q.past(5)} as s, avg(close) over {q.past(10)} as l, close / first_value(close) over {q.W} - 1 as own, max(close) over {q.UPTO} as m from b),
ou as (select *, coalesce(s > l and lag(s) over {q.W} <= lag(l) over {q.W}, false) as up, lead(m) over {q.W} / close - 1 as gain from om),
oj as (select o.*, mr.market, mr.market_up from ou o join mr using (ts)),
oc as (select *, max(up::int) over (partition by code order by ts rows between 3 preceding and 1 preceding) as recent, covar_pop(own, market) over (partition by code order by ts rows between unbounded preceding and 1 preceding) / nullif(stddev_pop(own) over (partition by code order by ts rows between unbounded preceding and 1 preceding) * stddev_pop(market) over (partition by code order by ts rows between unbounded preceding and 1 preceding), 0) as corr from oj)"""
register(
    "select_lagging_rebound",
    lambda spark, sf: rs.lagging_rebound(b := views.bars_user_day(spark, sf), b.groupBy("ts").agg(F.avg("close").alias("close"))).select("code", C("ts").cast("string").alias("ts"), *r6("corr", "gain")),
    LAGGING + f" select code, cast(ts as varchar) as ts, {s6('corr', 'gain')} from oc where market_up and corr >= 0.5 and coalesce(recent, 0) = 0",
)
register(
    "agg_daily_ledger_performance",
    lambda spark, sf: sm.daily_ledger_performance(ledger(spark, sf)).select(C("buy_date").cast("string").alias("buy_date"), "trade_count", "slow_count", *r6("ratio", "average_days_held", "average_profit", "profit_10k")),
    FIRST + f", a as (select buy_ts::date as buy_date, {SUMS} from l group by 1), d as (select *, {DERIVED} from a) select buy_date::varchar as buy_date, trade_count, slow_count, {s6('ratio', 'average_days_held', 'average_profit', 'profit_10k')} from d",
)
