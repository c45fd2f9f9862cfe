"""Queries of combination search, model reports, selection analyses and funds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as fn
from ..operators import combos as co
from ..operators import funds as fu
from ..operators import selection as se
from ..sources import views
from . import sqltext as q
from .build import bars, local_folder, register, stable
from .trade_queries import r6, s6

C = F.col
VOTES, RETS = q.views("votes"), q.views("fund_ret")


def durable(df):
    """Cut the lineage of a loop by a checkpoint in the session's folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(local_folder(df.sparkSession))
    return df.checkpoint()


# -- combinations --------------------------------------------------------------------------------
NAMES = ["ma5", "ma20", "down", "quiet", "red"]
CONDS = {"ma5": f"close < {q.ma('close', 5)}", "ma20": f"close < {q.ma('close', 20)}", "down": "chg < 0", "quiet": "turnover < 1", "red": "close > open"}


def flags(spark, sf):
    from .build import S

    conds = {"ma5": C("close") < S.ma("close", 5), "ma20": C("close") < S.ma("close", 20), "down": C("chg") < 0, "quiet": C("turnover") < 1, "red": C("close") > C("open")}
    active = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conds.items()]), lambda x: x.isNotNull())
    return bars(spark, sf).select("code", "ts", active.alias("active"), F.coalesce("chg", F.lit(0.0)).alias("value"))


def base(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "signal string")


def key(df, *more):
    return df.select(F.array_join("combo", ":").alias("combo"), *more)


FLAGS = q.base() + ", c as (select coalesce(chg, 0) as value, " + ", ".join(f"coalesce({c}, false) as f_{n}" for n, c in CONDS.items()) + " from b), f as (select value, list_filter([" + ", ".join(f"case when f_{n} then '{n}' end" for n in NAMES) + "], lambda x: x is not null) as active from c)"
SIGS = "s as (select unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) as s)"
FAMILIES = [("part", "p_brand"), ("customer", "c_mktsegment"), ("region", "r_name")]
register(
    "combo_group_product",
    lambda spark, sf: key(co.group_product([views.table(spark, sf, t).select(C(c).alias("member")).distinct() for t, c in FAMILIES])),
    "with a as (select distinct p_brand as x from part union all select null), b as (select distinct c_mktsegment as y from customer union all select null), c as (select distinct r_name as z from region union all select null) select array_to_string(list_sort(list_filter([x, y, z], lambda v: v is not null)), ':') as combo from a, b, c where coalesce(x, y, z) is not null",
)
PAIRS = SIGS + ", p as (select a.s || ':' || b.s as combo, [a.s, b.s] as l from s a join s b on a.s < b.s)"


def pairs(spark):
    one = base(spark).select(F.array("signal").alias("combo"))
    return co.level_join(base(spark), one, one)


EVAL = "select combo, count(f.value) as n, sum(f.value) as total, avg(f.value) as mean from {0} left join f on list_has_all(f.active, {0}.l) group by combo"
register("combo_level_join", lambda spark, sf: key(co.evaluate(flags(spark, sf), pairs(spark), "value"), "n"), FLAGS + ", " + PAIRS + f", e as ({EVAL.format('p')}) select combo, n from e")
register("combo_evaluate", lambda spark, sf: key(co.evaluate(flags(spark, sf), pairs(spark), "value"), "n", F.round(C("total") + 1e-9, 4).alias("total"), *r6("mean")), FLAGS + ", " + PAIRS + f", e as ({EVAL.format('p')}) select combo, n, round(total + 1e-9, 4) as total, round(mean + 1e-9, 6) as mean from e")
register(
    "combo_prune_supersets",
    lambda spark, sf: key(co.prune_supersets(co.level_join(base(spark), pairs(spark)), co.evaluate(flags(spark, sf), pairs(spark), "value").filter("n < 700"))),
    FLAGS + ", " + PAIRS + f", e as ({EVAL.format('p')}), t as (select a.s || ':' || b.s || ':' || c.s as combo, [a.s, b.s, c.s] as l from s a join s b on a.s < b.s join s c on b.s < c.s) select combo from t where not exists (select 1 from e where n < 700 and list_has_all(t.l, string_split(e.combo, ':')))",
)
LAYERS = FLAGS + ", " + PAIRS + ", o as (select s as combo, [s] as l from s), t as (select a.s || ':' || b.s || ':' || c.s as combo, [a.s, b.s, c.s] as l from s a join s b on a.s < b.s join s c on b.s < c.s), u as (select * from o union all select * from p union all select * from t), " + f"e as ({EVAL.format('u')})"
register("combo_layered_search", lambda spark, sf: key(co.layered_search(flags(spark, sf), base(spark), "value", 300, 3, durable), "n", *r6("mean")), LAYERS + " select combo, n, round(mean + 1e-9, 6) as mean from e where n >= 300")
register("combo_best_filter", lambda spark, sf: key(co.best_filter(co.evaluate(flags(spark, sf), pairs(spark), "value"), 1200, 100.0), "n"), FLAGS + ", " + PAIRS + f", e as ({EVAL.format('p')}) select combo, n from e where n >= 1200 or mean >= 100")
register("combo_fitness", lambda spark, sf: key(co.evaluate(flags(spark, sf), pairs(spark), "value"), stable(co.candidate_fitness(C("n"), F.lit(0.1))).alias("fitness")), FLAGS + ", " + PAIRS + f", e as ({EVAL.format('p')}) select combo, round(case when n > 0 then ln(n) / 0.11 else 0 end + 1e-9, 6) as fitness from e")
#: Pairs of funds that rise and fall together; the margin keeps the order of a sum from deciding.
CODES = RETS + ", u as (select distinct code from fund_ret), two as (select a.code as a, b.code as b, count(*) as n from fund_ret a join fund_ret b on a.date = b.date and a.code < b.code group by 1, 2 having covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0) > 1e-9)"


def codes(spark, sf):
    return views.fund_ret(spark, sf).select("code").distinct()


def two(spark, sf):
    return fu.pairwise_corr(views.fund_ret(spark, sf)).filter("corr > 1e-9").select(F.array("a", "b").alias("combo"), "n")


def sets(spark, sf):
    return two(spark, sf).select("combo")


THREE = CODES + ", loose as (select x.a, x.b, y.b as c from two x join two y on x.a = y.a and x.b < y.b)"
register("combo_apriori_next", lambda spark, sf: key(co.apriori_next(sets(spark, sf))), THREE + " select l.a || ':' || l.b || ':' || l.c as combo from loose l join two z on z.a = l.b and z.b = l.c")
register("combo_apriori_loose", lambda spark, sf: key(co.apriori_next(sets(spark, sf), False)), THREE + " select a || ':' || b || ':' || c as combo from loose")
register("combo_estimate_next_count", lambda spark, sf: co.estimate_next_count(sets(spark, sf)), THREE + " select count(*) as n from loose")
SCORED = "scored as (select a, b, a || ':' || b as key, n as score from two)"


def scored(spark, sf):
    return two(spark, sf).select("combo", F.array_join("combo", ":").alias("key"), C("n").alias("score"))


def active(spark, sf):
    """Funds without a long still stand."""
    return fu.zero_run(views.fund_ret(spark, sf), 0.0005).filter("zero_run <= 2").select("code")


register("combo_pick_k_for_target", lambda spark, sf: co.pick_k_for_target(scored(spark, sf), 150), CODES + ", " + SCORED + ", r as (select *, row_number() over (partition by a order by score desc, key) as place from scored), m as (select *, sum(place - 1) over (order by score desc, key) as made from r) select count(*) as k, coalesce(max(made), 0)::bigint as made from m where made <= 150")
register(
    "combo_pick_k_strict",
    lambda spark, sf: co.pick_k_strict(scored(spark, sf), 120, durable),
    CODES + ", " + SCORED + ", r as (select *, row_number() over (order by score desc, key) as rank from scored), t as (select greatest(x.rank, y.rank, z.rank) as birth from r x join r y on x.a = y.a and x.b < y.b join r z on z.a = x.b and z.b = y.b), m as (select birth, sum(count(*)) over (order by birth) as made from t group by 1), k as (select coalesce((select min(birth) from m where made > 120) - 1, (select count(*) from r)) as k) select k, (select count(*) from t where birth <= k) as made from k",
)


def last_day(spark, sf):
    """The hourly rows of the last day, with their active signals."""
    rows = flags(spark, sf).withColumn("day", F.to_date("ts"))
    return rows.join(F.broadcast(rows.agg(F.max("day").alias("day"))), "day").select("code", C("ts").cast("string").alias("ts"), "active")


def all_sets(spark):
    """Every set of one to four signals."""
    pool = base(spark).select(C("signal").alias("member"))
    one, *more = [co.combination_source(pool, n).select("combo") for n in range(1, 5)]
    for x in more:
        one = one.unionByName(x)
    return one


register(
    "signal_satisfied_combos",
    lambda spark, sf: co.satisfied(last_day(spark, sf), all_sets(spark), ["code", "ts"]).select("code", "ts", F.array_join(F.array_sort("combo"), ":").alias("combo")),
    q.base() + ", c as (select code, ts, " + ", ".join(f"coalesce({c}, false) as f_{n}" for n, c in CONDS.items()) + " from b), f as (select code, ts, list_filter([" + ", ".join(f"case when f_{n} then '{n}' end" for n in NAMES) + "], lambda x: x is not null) as active from c where ts::date = (select max(ts::date) from c)), m as (select unnest(range(1, 31)) as m), s as (select list_sort(list_filter([" + ", ".join(f"case when (m >> {k}) & 1 = 1 then '{n}' end" for k, n in enumerate(NAMES)) + "], lambda x: x is not null)) as l from m) select code, ts::varchar as ts, array_to_string(l, ':') as combo from f join s on list_has_all(active, l)",
)
register(
    "combo_seed_select",
    lambda spark, sf: co.seed_select(scored(spark, sf), 20, active(spark, sf)).select("key", "score"),
    CODES + ", " + SCORED + ", z as (select *, abs(ret) < 0.0005 as zero from fund_ret), i as (select *, sum((not zero)::int) over (partition by code order by date) as island from z), q as (select code, island, count(*) as n from i where zero group by 1, 2), pool as (select code from u where coalesce((select max(n) from q where q.code = u.code), 0) <= 2) select key, score from scored where score > 20 and a in (select code from pool) and b in (select code from pool)",
)

# -- model reports -------------------------------------------------------------------------------
LEVELS = [0.5, 0.6, 0.7, 0.8, 0.9]
REPORT = VOTES + ", g as (select *, prob >= level as picked from votes, (select unnest([0.5, 0.6, 0.7, 0.8, 0.9])::double as level)), d as (select model, level, date, count(*) as n, count(*) filter (where picked) as picked, count(*) filter (where picked and hit) as hits from g group by 1, 2, 3), t as (select model, level, sum(n)::bigint as n, sum(picked)::bigint as picked, sum(hits)::bigint as hits, count(*) filter (where picked > 0) as days, count(*) filter (where picked > 0 and hits >= 0.9 * picked) as good_days from d group by 1, 2), r as (select *, hits / nullif(picked, 0) as precision, picked / n as predicted, good_days / nullif(days, 0) as good_share, hits - (picked - hits) * 3 > 0 as loss_ok from t)"


def report(spark, sf):
    return se.threshold_report(views.votes(spark, sf), LEVELS)


register("model_threshold_report", lambda spark, sf: report(spark, sf).select("model", "level", "n", "picked", "hits", "days", "good_days", "loss_ok", *r6("precision", "predicted", "good_share")), REPORT + f" select model, level, n, picked, hits, days, good_days, loss_ok, {s6('precision', 'predicted', 'good_share')} from r")
register("model_first_passing", lambda spark, sf: se.first_passing(report(spark, sf), 0.49), REPORT + " select model, min(level) as level from r where precision >= 0.49 group by model")
register("model_hash_split", lambda spark, sf: se.stable_split(views.votes(spark, sf), "vote_id").groupBy("model", "train").agg(F.count("*").alias("n")), VOTES + " select model, ('0x' || substr(md5(vote_id::varchar), 1, 7))::bigint % 1000 < 700 as train, count(*) as n from votes group by 1, 2")
DAYS = VOTES + ", y as (select date, code, count(*) as votes, max(prob) as best, min(prob) as least, max(hit::int) as hit from votes group by 1, 2)"


def days(spark, sf):
    return se.votes_per_stock_day(views.votes(spark, sf))


def date(df, *cols):
    return df.select(C("date").cast("string").alias("date"), *cols)


register("model_min_day_scan", lambda spark, sf: se.min_day_scan(days(spark, sf).groupBy("date").agg(F.count("*").alias("n"), (F.avg("hit") >= 0.3).alias("good")), [0, 1, 2, 3, 4, 5, 6], 0.8), DAYS + ", d as (select date, count(*) as n, avg(hit) >= 0.3 as good from y group by 1), g as (select cutoff, avg(good::int) as share from d, (select unnest(range(7)) as cutoff) where n > cutoff group by 1) select min(cutoff)::int as cutoff from g where share >= 0.8")
register("model_common_thresholds", lambda spark, sf: se.common_thresholds(report(spark, sf).filter("precision > 0.44").select("level", C("model").alias("source")), 12), REPORT + " select level from r where precision > 0.44 group by level having count(distinct model) = 12")
register("model_monotone_check", lambda spark, sf: se.monotone_check(report(spark, sf), 2), REPORT + ", f as (select model, coalesce(precision < lag(precision) over (partition by model order by level), false)::int as fall from r where precision is not null) select model, sum(fall)::bigint as falls, sum(fall) <= 2 as ok from f group by model")
RANKS = ", k as (select model, avg(hit::int) as p from votes where prob > 0.99 group by 1), ranked as (select model, row_number() over (order by p desc, model) as rank from k)"


def ranks(spark, sf):
    from pyspark.sql import Window

    return views.votes(spark, sf).filter("prob > 0.99").groupBy("model").agg(F.avg(C("hit").cast("double")).alias("p")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p"), "model"))).drop("p")


register("model_cover_filter", lambda spark, sf: se.model_cover_filter(views.votes(spark, sf).filter("prob > 0.99"), ranks(spark, sf)).select("model", "rank"), VOTES + RANKS + ", f as (select date, code, min(rank) as rank from votes join ranked using (model) where prob > 0.99 group by 1, 2) select model, rank from ranked where rank in (select rank from f)")
register("model_topn_success", lambda spark, sf: se.topn_success(views.votes(spark, sf)).select("n", "votes", *r6("success")), VOTES + ", t as (select *, row_number() over (partition by date order by prob desc, vote_id) as r from votes) select n::int as n, count(*) as votes, round(avg(hit::int) + 1e-9, 6) as success from t join (select unnest(range(1, 11)) as n) on r <= n group by n")
register("model_load_best", lambda spark, sf: se.load_best_models(report(spark, sf), 50).select("model", "level", *r6("precision")), REPORT + " select model, level, round(precision + 1e-9, 6) as precision from r where days >= 50 and precision is not null qualify row_number() over (partition by model order by precision desc, level) = 1")
register("model_tree_votes", lambda spark, sf: date(se.tree_votes(views.votes(spark, sf), 0.75), "code", "n", "up", *r6("share", "log_ratio")), VOTES + ", t as (select date, code, count(*) as n, count(*) filter (where prob >= 0.75) as up from votes group by 1, 2) select date::varchar as date, code, n, up, round(up / n + 1e-9, 6) as share, round(ln((up + 1) / (n - up + 1)) + 1e-9, 6) as log_ratio from t")

# -- selection -----------------------------------------------------------------------------------
register("select_votes_per_stock_day", lambda spark, sf: date(days(spark, sf), "code", "votes", "best", "least", "hit"), DAYS + " select date::varchar as date, code, votes, best, least, hit from y")
register("select_single_code_days", lambda spark, sf: se.single_code_days(days(spark, sf)).groupBy("single").agg(F.count("*").alias("n")), DAYS + ", s as (select count(*) over (partition by date) = 1 as single from y) select single, count(*) as n from s group by 1")
register("select_biggest_per_day", lambda spark, sf: date(se.biggest_per_day(days(spark, sf)), "code", "votes"), DAYS + " select date::varchar as date, code, votes from y qualify row_number() over (partition by date order by votes desc, code) = 1")
SPLIT = ", d as (select best as cut, row_number() over (order by best) as r, count(*) over () as total from (select distinct best from y)), cuts as (select cut from d where total // 8 > 0 and r % (total // 8) = 0 and r / (total // 8) < 8)"
register("select_split_points", lambda spark, sf: se.split_points(days(spark, sf), "best", 8), DAYS + SPLIT + " select cut from cuts")
register("select_parameter_sweep", lambda spark, sf: se.parameter_sweep(days(spark, sf), se.split_points(days(spark, sf), "best", 8), "best").select("cut", "above", "n", "days", *r6("success")), DAYS + SPLIT + ", m as (select cut, best >= cut as above, count(*) as n, count(distinct date) as days, avg(hit) as success from y, cuts group by 1, 2) select cut, above, n, days, round(success + 1e-9, 6) as success from m qualify row_number() over (partition by above, n, days, round(success, 9) order by cut) = 1")
PTS = lambda c: f"case dense_rank() over (partition by date order by {c} desc) when 1 then 5 when 2 then 3 when 3 then 2 else 1 end"
register("select_rank_score", lambda spark, sf: se.rank_score(views.votes(spark, sf), ["prob", "code"]).select("vote_id", "points"), VOTES + f" select vote_id, {PTS('prob')} + {PTS('code')} as points from votes")
register("select_total_rank", lambda spark, sf: se.total_rank(views.votes(spark, sf), ["prob", "code"]).select("vote_id", "total_rank"), VOTES + " select vote_id, rank() over (partition by date order by prob desc) + rank() over (partition by date order by code desc) as total_rank from votes")
register("select_ratio_membership", lambda spark, sf: date(se.ratio_membership(views.votes(spark, sf), 0.1), "code", "classes"), VOTES + " select date::varchar as date, code, count(distinct floor(prob / 0.1::double + 1e-9)) as classes from votes group by 1, 2")
register("select_condition_grid", lambda spark, sf: se.condition_grid(days(spark, sf), [0.6, 0.7, 0.8, 0.9]).select("level", "n", "fails", *r6("rate")), DAYS + ", g as (select level, date, hit from y, (select unnest([0.6, 0.7, 0.8, 0.9])::double as level) where best >= level qualify row_number() over (partition by level, date order by code) = 1) select level, count(*) as n, count(*) filter (where hit = 0) as fails, round(count(*) filter (where hit = 0) / count(*) + 1e-9, 6) as rate from g group by level")
register("select_ma_cross_rebound", lambda spark, sf: se.ma_cross_rebound(bars(spark, sf)).select("code", C("ts").cast("string").alias("ts"), "rebound"), q.base() + f", m as (select *, avg(close) over {q.past(5)} as a, avg(close) over {q.past(20)} as z from b) select code, cast(ts as varchar) as ts, coalesce(lag(a) over {q.W} - lag(z) over {q.W} < 0 and a - z > 0, false) as rebound from m")


def relative(spark, sf):
    from ..operators.bars import relative_return

    return relative_return(bars(spark, sf))


REL = q.base() + f", r as (select *, close / first_value(close) over {q.W} - 1 as relative from b)"
register("select_future_max_return", lambda spark, sf: se.future_max_return(relative(spark, sf)).select("code", C("ts").cast("string").alias("ts"), *r6("future_max")), REL + f", m as (select *, max(relative) over {q.UPTO} as m from r) select code, cast(ts as varchar) as ts, round(lead(m) over {q.W} + 1e-9, 6) as future_max from m")
register("select_group_market_corr", lambda spark, sf: se.group_market_corr(relative(spark, sf)).select("code", "n", *r6("corr")), REL + ", m as (select ts, avg(relative) as market from r group by 1) select code, count(*) as n, round(covar_pop(relative, market) / nullif(stddev_pop(relative) * stddev_pop(market), 0) + 1e-9, 6) as corr from r join m using (ts) group by code")

# -- funds ---------------------------------------------------------------------------------------
FUPTO = "(partition by code order by date rows between unbounded preceding and current row)"
ZERO = RETS + f", z as (select *, abs(ret) < 0.0005 as zero from fund_ret), i as (select *, sum((not zero)::int) over {FUPTO} as island from z), n as (select code, island, count(*) as n from i where zero group by 1, 2), zr as (select f.code, coalesce(max(n.n), 0) as zero_run from (select distinct code from fund_ret) f left join n using (code) group by 1)"


def rets(spark, sf):
    return views.fund_ret(spark, sf)


register("fund_zero_run", lambda spark, sf: fu.zero_run(rets(spark, sf), 0.0005), ZERO + " select code, zero_run from zr")
register("fund_stats", lambda spark, sf: fu.fund_stats(rets(spark, sf), 0.0005).select("code", C("first").cast("string").alias("first"), C("last").cast("string").alias("last"), "days", *r6("missing"), "zero_run"), ZERO + ", c as (select date, row_number() over (order by date) as pos from (select distinct date from fund_ret)), s as (select code, min(date) as first, max(date) as last, count(*) as days from fund_ret group by 1) select s.code, first::varchar as first, last::varchar as last, days, round(1 - days / (b.pos - a.pos + 1) + 1e-9, 6) as missing, zero_run from s join c a on a.date = first join c b on b.date = last join zr using (code)")
PROFILE = RETS + f", k as (select * from fund_ret qualify row_number() over (partition by code order by date desc) <= 1260), v as (select *, product(1 + ret) over {FUPTO} as nav from k), w as (select *, greatest(max(nav) over {FUPTO}, 1) as peak from v), p as (select code, count(*) as days, arg_max(nav, date) as final, min(nav / peak - 1) as drawdown from w group by 1), pr as (select *, pow(final, 252.0::double / days) - 1 as annual from p)"
PCOLS = ("final", "drawdown", "annual")
register("fund_profile", lambda spark, sf: fu.fund_profile(rets(spark, sf)).select("code", "days", *r6(*PCOLS)), PROFILE + f" select code, days, {s6(*PCOLS)} from pr")
register("fund_incremental_profile", lambda spark, sf: fu.incremental_profile(fu.fund_profile(rets(spark, sf).filter("code < 'Brand#3'")), rets(spark, sf)).select("code", "days", *r6(*PCOLS)), PROFILE + f" select code, days, {s6(*PCOLS)} from pr")
register("fund_baseline", lambda spark, sf: fu.baseline(fu.fund_profile(rets(spark, sf))).select(*r6("annual", "drawdown", "ratio")), PROFILE + " select round(avg(annual) + 1e-9, 6) as annual, round(avg(drawdown) + 1e-9, 6) as drawdown, round(avg(annual) / abs(avg(drawdown)) + 1e-9, 6) as ratio from pr")
register("fund_pool_reject_reason", lambda spark, sf: __import__("tickloom.operators.clean", fromlist=["x"]).pool_reject_reason(fu.fund_stats(rets(spark, sf), 0.0005).join(fu.fund_profile(rets(spark, sf)).drop("days"), "code"), 1000, 0.0, 0.5, 4).select("code", "reason"), ZERO + PROFILE.removeprefix(RETS) + ", c as (select date, row_number() over (order by date) as pos from (select distinct date from fund_ret)), s as (select code, min(date) as first, max(date) as last, count(*) as days from fund_ret group by 1), st as (select s.code, s.days, 1 - s.days / (b.pos - a.pos + 1) as missing, zero_run from s join c a on a.date = first join c b on b.date = last join zr using (code)) select st.code, case when st.days < 1000 then 'days' when annual < 0 then 'return' when missing > 0.5 then 'missing' when zero_run > 4 then 'zero_run' when drawdown < -0.7 then 'drawdown' end as reason from st join pr using (code)")
CORR = RETS + ", pc as (select a.code as a, b.code as b, covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0) as corr, count(*) as n from fund_ret a join fund_ret b on a.date = b.date and a.code < b.code group by 1, 2)"
register("fund_pairwise_corr", lambda spark, sf: fu.pairwise_corr(rets(spark, sf)).select("a", "b", "n", *r6("corr")), CORR + " select a, b, n, round(corr + 1e-9, 6) as corr from pc")
register("fund_downside_corr", lambda spark, sf: fu.downside_corr(rets(spark, sf)).select("a", "b", "n", *r6("downside")), RETS + ", p as (select a.code as a, b.code as b, a.date, a.ret as x, b.ret as y, (a.ret + b.ret) / 2 as mean from fund_ret a join fund_ret b on a.date = b.date and a.code < b.code), r as (select *, row_number() over (partition by a, b order by mean, date) as r, count(*) over (partition by a, b) as n from p) select a, b, count(*) as n, round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0.5) + 1e-9, 6) as downside from r where r <= greatest(floor(n * 0.05::double), 5) group by 1, 2")


def by_growth(spark, sf):
    """Funds by annual return, best first; the list of funds is short."""
    from pyspark.sql import Window

    return fu.fund_profile(rets(spark, sf)).select("code", F.row_number().over(Window.orderBy(F.desc("annual"), "code")).alias("rank"))


register("fund_greedy_corr_filter", lambda spark, sf: fu.greedy_corr_filter(by_growth(spark, sf), durable(fu.conflicts(fu.pairwise_corr(rets(spark, sf), 0.02), fu.downside_corr(rets(spark, sf), above=0.3), 0.02, 0.3)), durable).select("code", "rank"))
COMBO = RETS + ", cb as (select a.code || ':' || b.code as key, a.code as a, b.code as b from (select distinct code from fund_ret) a join (select distinct code from fund_ret) b on a.code < b.code), cr as (select key, row_number() over (partition by key order by x.date) - 1 as t, x.date, x.ret as x, y.ret as y from cb join fund_ret x on x.code = cb.a join fund_ret y on y.code = cb.b and y.date = x.date)"


def combos(spark, sf):
    """All pairs of funds that share a date, found by the dates they share."""
    r = rets(spark, sf).select("date", "code")
    both = r.withColumnRenamed("code", "a").join(r.withColumnRenamed("code", "b"), "date").filter("a < b").select("a", "b").distinct()
    return both.select(F.concat_ws(":", "a", "b").alias("key"), F.array("a", "b").alias("combo"))


SEG = "(partition by key, seg order by t rows between unbounded preceding and current row)"
PATH = COMBO + f", sg as (select *, case when t > 30 then (t - 31) // 30 + 1 else 0 end as seg from cr), gr as (select *, (product(1 + x) over {SEG} + product(1 + y) over {SEG}) / 2 as v from sg), pp as (select key, t, date, v / coalesce(lag(v) over (partition by key, seg order by t), 1) - 1 as ret from gr)"


def path(spark, sf):
    return fu.portfolio_path(fu.combo_returns(rets(spark, sf), combos(spark, sf)))


OVERLAP = "min(date)::varchar as first, max(date)::varchar as last, count(*) as days, date_diff('day', max(date), (select max(date) from fund_ret)) > {0} as stale"


def overlap(df):
    return df.select("key", C("first").cast("string").alias("first"), C("last").cast("string").alias("last"), "days", "stale")


register("fund_valid_overlap", lambda spark, sf: overlap(fu.valid_overlap(rets(spark, sf), combos(spark, sf))), COMBO + " select key, " + OVERLAP.format(35) + " from cr group by 1")


def triples(spark, sf):
    """Every set of three funds, made from its number."""
    made = co.combination_source(codes(spark, sf).withColumnRenamed("code", "member"), 3)
    return made.select(F.array_join("combo", ":").alias("key"), "combo")


TRIPLES = RETS + ", u3 as (select distinct code from fund_ret), c3 as (select a.code || ':' || b.code || ':' || c.code as key, a.code as a, b.code as b, c.code as c from u3 a join u3 b on a.code < b.code join u3 c on b.code < c.code), cr as (select key, x.date, x.ret as x, y.ret as y, z.ret as z from c3 join fund_ret x on x.code = c3.a join fund_ret y on y.code = c3.b and y.date = x.date join fund_ret z on z.code = c3.c and z.date = x.date)"
register("combo_source", lambda spark, sf: triples(spark, sf).select("key"), TRIPLES + " select key from c3")
register("fund_valid_overlap_triples", lambda spark, sf: overlap(fu.valid_overlap(rets(spark, sf), triples(spark, sf), 1)), TRIPLES + " select key, " + OVERLAP.format(1) + " from cr group by 1")
register("fund_portfolio_path", lambda spark, sf: path(spark, sf).select("key", "t", C("date").cast("string").alias("date"), F.round(C("ret") + 1e-12, 8).alias("ret")), PATH + " select key, t, date::varchar as date, round(ret + 1e-12, 8) as ret from pp")
def measured(k: str, source: str) -> str:
    """Stages from daily returns (k, t, ret) of ``source`` to the metrics mm by k."""
    run = f"(partition by {k} order by t rows between unbounded preceding and current row)"
    return (
        f", nv as (select *, product(1 + ret) over {run} as nav, lag(ret) over (partition by {k} order by t) as prev from {source}),"
        f" yr as (select *, greatest(max(nav) over {run}, 1) as peak, case when t = 251 then nav - 1 else nav / lag(nav, 252) over (partition by {k} order by t) - 1 end as year from nv),"
        f" isl as (select *, sum((nav >= peak * (1 - 1e-12))::int) over {run} as island from yr), wet as (select {k}, max(n) as recovery from (select {k}, island, count(*) filter (where nav < peak * (1 - 1e-12)) as n from isl group by 1, 2) group by 1),"
        f" mt as (select {k}, count(*) as days, arg_max(nav, t) as final, min(nav / peak - 1) as drawdown, covar_pop(prev, ret) / nullif(stddev_pop(prev) * stddev_pop(case when prev is not null then ret end), 0) as ar1, stddev_samp(ret) * sqrt(252) as vol, coalesce(min(year), 0) as worst_year, avg((ret > 1e-12)::int) as win from yr group by 1),"
        f" mc as (select *, pow(final, 252.0::double / days) - 1 as cagr from mt join wet using ({k})), mm as (select *, cagr / nullif(abs(drawdown), 0) as calmar, cagr / nullif(vol, 0) as sharpe from mc)"
    )


def straight(k: str, source: str) -> str:
    """Stages from daily returns to the least R2 by k (r2w)."""
    run = f"(partition by {k} order by t rows between unbounded preceding and current row)"
    frame = f"(partition by {k} order by t rows between 251 preceding and current row)"
    return (
        f", lg as (select *, sum(ln(1 + ret)) over {run} as cum, max(t) over (partition by {k}) as last_t from {source}), cc as (select *, coalesce(pow(covar_pop(t, cum) over {frame} / nullif(stddev_pop(t) over {frame} * stddev_pop(cum) over {frame}, 0), 2), 0) as r2 from lg),"
        f" r2w as (select {k}, count(*) as windows, min(r2) as worst_r2 from cc where case when last_t >= 251 then t >= 251 and (t - 251) % 21 = 0 else t = last_t end group by 1)"
    )


METRICS = PATH + measured("key", "pp")
MCOLS = ("final", "drawdown", "ar1", "vol", "worst_year", "win", "cagr", "calmar", "sharpe")
register("fund_portfolio_metrics", lambda spark, sf: fu.portfolio_metrics(path(spark, sf)).select("key", "days", "recovery", *r6(*MCOLS)), METRICS + f" select key, days, recovery, {s6(*MCOLS)} from mm")
#: Limits at which some of these funds pass.
LIMITS = {"hurdle": -0.01, "drawdown": 0.5, "calmar_multiple": 0.2, "recovery": 900, "worst_year": -0.05, "least_days": 40}
FOUR = COMBO + """, sd as (select unnest([0, 1024, 2048, 4096]) as seed),
cu as (select key, t - min(t) over (partition by key) as t, date, x, y, max(t) over (partition by key) - min(t) over (partition by key) + 1 as dd from (select *, max(t) over (partition by key) - t as back from cr) where back < 1260),
hs as (select key, a, b, seed, (('0x' || substr(md5(key || '|' || a || '|' || seed), 1, 7))::bigint % 10001) / 10000.0::double as ha, (('0x' || substr(md5(key || '|' || b || '|' || seed), 1, 7))::bigint % 10001) / 10000.0::double as hb from cb, sd),
rw as (select key, seed, case when seed = 0 then 0.5::double else least(greatest(0.5 + (ha * 2 - 1) * 0.05::double, 0.01), 1) end as ra, case when seed = 0 then 0.5::double else least(greatest(0.5 + (hb * 2 - 1) * 0.05::double, 0.01), 1) end as rb from hs),
vr as (select key || '~' || seed as k2, key, seed, t, date, x, y, ra / (ra + rb) as wa, rb / (ra + rb) as wb, case when seed = 0 then 30 else 45 end as s0 from cu join rw using (key) where dd >= 40),
s4 as (select *, case when t > s0 then (t - 1 - s0) // 30 + 1 else 0 end as seg from vr),
g4 as (select *, wa * product(1 + x) over (partition by k2, seg order by t rows between unbounded preceding and current row) + wb * product(1 + y) over (partition by k2, seg order by t rows between unbounded preceding and current row) as v from s4),
p4 as (select k2, key, seed, t, x, y, v / coalesce(lag(v) over (partition by k2, seg order by t), 1) - 1 as ret from g4)""" + measured("k2", "p4") + straight("k2", "p4") + """,
mb as (select key, t, x as r, 'x' as m from cu where dd >= 40 union all select key, t, y, 'y' from cu where dd >= 40),
mn as (select *, product(1 + r) over (partition by key, m order by t rows between unbounded preceding and current row) as nav, sum((abs(r) >= 1e-8)::int) over (partition by key, m order by t rows between unbounded preceding and current row) as island from mb),
mp as (select *, greatest(max(nav) over (partition by key, m order by t rows between unbounded preceding and current row), 1) as peak, sum((abs(r) < 1e-8)::int) over (partition by key, m, island order by t rows between unbounded preceding and current row) as zeros from mn),
me as (select key, m, arg_max(nav, t) as final, count(*) as days, min(nav / peak - 1) as drawdown, max(zeros) as zeros from mp group by 1, 2),
bl as (select key, avg(pow(final, 252.0::double / days) - 1) as mean_cagr, avg(drawdown) as mean_drawdown, max(zeros) as zeros from me group by 1),
bz as (select *, case when abs(mean_drawdown) > 1e-6 then mean_cagr / abs(mean_drawdown) else 0 end as baseline from bl),
wr as (select *, row_number() over (partition by k2 order by round(ret, 9), t) as r, count(*) over (partition by k2) as nn from p4),
dn as (select k2, coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0.5) as downside from wr where r <= greatest(floor(nn * 0.05::double), 5) group by 1),
al as (select mm.*, split_part(mm.k2, '~', 1) as key, split_part(mm.k2, '~', 2) = '0' as plain, bz.baseline, bz.zeros, r2w.worst_r2, dn.downside from mm join r2w using (k2) join dn using (k2) join bz on bz.key = split_part(mm.k2, '~', 1)),
vt as (select *, case when zeros > 10 then 'distortion' when cagr < -0.01 then 'hurdle' when -drawdown > 0.5 then 'drawdown' when coalesce(calmar, 0) <= baseline * 0.2::double then 'baseline' when recovery > 900 then 'bleeding' when coalesce(ar1, 1) > 0.55 and vol < 0.03 then 'smooth' when worst_year < -0.05 then 'worst_year' end as veto from al),
sc as (select *, case when veto is null then greatest(greatest(cagr, 0) / greatest(abs(drawdown), 0.01) * worst_r2 * exp(least(worst_year, 0) * 2.5) * least(1, sqrt(days / 1260.0::double)) * case when downside > 0.8 then 0.1 when downside > 0.5 then least(greatest(1 - (downside - 0.5), 0.5), 1) else 1 end, 0) else 0 end as score from vt),
ev as (select a.*, b.perturbed, least(a.score, b.perturbed) as total from sc a join (select key, min(score) as perturbed from sc where not plain group by 1) b using (key) where a.plain)"""


def evaluated(spark, sf, chosen=None):
    return fu.evaluate_combos(rets(spark, sf), combos(spark, sf) if chosen is None else chosen, limits=LIMITS, keep=durable)


ECOLS = ("cagr", "drawdown", "calmar", "baseline", "worst_r2", "downside", "score", "perturbed", "total")
register("fund_veto_and_score", lambda spark, sf: evaluated(spark, sf).select("key", "days", "zeros", "recovery", "veto", *r6(*ECOLS)), FOUR + f" select key, days, zeros, recovery, veto, {s6(*ECOLS)} from ev")
register(
    "fund_perturbed_weights",
    lambda spark, sf: fu.perturbed_weights(combos(spark, sf)).select("key", "seed", "code", *r6("weight")),
    FOUR + ", wl as (select key, seed, split_part(key, ':', 1) as code, ra / (ra + rb) as weight from rw where seed > 0 union all select key, seed, split_part(key, ':', 2), rb / (ra + rb) from rw where seed > 0) select key, seed, code, round(weight + 1e-9, 6) as weight from wl",
)


def _appended(spark, sf):
    every = combos(spark, sf)
    old = fu.portfolio_metrics(fu.portfolio_path(fu.combo_returns(rets(spark, sf), every.filter("combo[0] < 'Brand#2'")))).select("key", "days", "cagr")
    return fu.append_results(every, old, lambda new: fu.portfolio_metrics(fu.portfolio_path(fu.combo_returns(rets(spark, sf), new)))).select("key", "days", *r6("cagr"))


register("fund_append_results", _appended, METRICS + " select key, days, round(cagr + 1e-9, 6) as cagr from mm")
register(
    "fund_downside_from_results",
    lambda spark, sf: fu.downside_corr_from_results(evaluated(spark, sf).join(combos(spark, sf), "key")).select("a", "b", *r6("downside")),
    FOUR + " select split_part(key, ':', 1) as a, split_part(key, ':', 2) as b, round(downside + 1e-9, 6) as downside from ev union all select split_part(key, ':', 2), split_part(key, ':', 1), round(downside + 1e-9, 6) from ev",
)


def _ranking(spark, sf):
    one = fu.fund_profile(rets(spark, sf)).select(C("code").alias("key"), F.array("code").alias("combo"), "days", C("annual").alias("cagr"), fn.div("annual", F.abs("drawdown")).alias("calmar"), F.lit(0.0).alias("baseline"), F.lit(0.5).alias("downside"), (1 + C("annual")).alias("total"))
    pairs = evaluated(spark, sf).join(combos(spark, sf), "key").select("key", "combo", "days", "cagr", "calmar", "baseline", "downside", "total")
    funds = views.table(spark, sf, "part").groupBy(C("p_brand").alias("code")).agg(F.concat(F.min("p_name"), F.lit(" (all) "), F.min("p_type"), F.lit("A")).alias("name"), (F.min("p_size") > 1).alias("overseas"))
    return fu.merge_dims_and_rank([one, pairs], funds, 60, -0.5).select("key", "size", "names", "overseas", *r6(*RCOLS))


RCOLS = ("total", "score", "calmar_gain", "total_less_corr", "score_less_corr")
register(
    "fund_merge_dims_and_rank",
    _ranking,
    FOUR + ", " + PROFILE.removeprefix(RETS + ", ") + """, fd as (select p_brand as code, regexp_replace(regexp_replace(min(p_name) || ' (all) ' || min(p_type) || 'A', '[（(][^）)]*[）)]', '', 'g'), '[A-E]$', '') as name, min(p_size) > 1 as overseas from part group by 1),
    un as (select code as key, [code] as combo, days, annual as cagr, annual / nullif(abs(drawdown), 0) as calmar, 0.0::double as baseline, 0.5::double as downside, 1 + annual as total from pr union all select key, string_split(key, ':'), days, cagr, calmar, baseline, downside, total from ev),
    kp as (select *, total * 10000 as total10 from un where days > 60 and total > 0 and cagr > -0.5),
    nm as (select key, count(*) as size, string_agg(name, '_' order by i) as names, max(overseas::int) = 1 as overseas from (select key, unnest(combo) as code, unnest(range(len(combo))) as i from kp) join fd using (code) group by 1),
    sr as (select kp.key, nm.size, nm.names, nm.overseas, total10 as total, pow(cagr * 10, 3) * total10 as score, calmar - baseline as calmar_gain, downside from kp join nm using (key)),
    fin as (select *, total / (downside + 1) as total_less_corr, score / (downside + 1) as score_less_corr from sr)
    select key, size, names, overseas, """ + s6(*RCOLS) + " from fin",
)
register("fund_worst_window_r2", lambda spark, sf: fu.worst_window_r2(path(spark, sf)).select("key", "windows", *r6("worst_r2")), PATH + straight("key", "pp") + " select key, windows, round(worst_r2 + 1e-9, 6) as worst_r2 from r2w")
register("fund_simplify_name", lambda spark, sf: views.universe(spark, sf).select("code", fu.simplify_name(C("name")).alias("name")), q.views("universe") + " select code, regexp_replace(regexp_replace(regexp_replace(name, '[（(][^）)]*[）)]', '', 'g'), '(Supplier|#)', '', 'g'), '[A-E]$', '') as name from universe")
register(
    "select_nested_sweep",
    lambda spark, sf: (lambda d: d.select("cut_best", "above_best", "cut_votes", "above_votes", "n", "days", *r6("success")))(se.nested_sweep(days(spark, sf), {"best": [0.6, 0.8, 0.9], "votes": [1, 2]})),
    DAYS + ", m as (select cb as cut_best, best >= cb as above_best, cv as cut_votes, votes >= cv as above_votes, count(*) as n, count(distinct date) as days, avg(hit) as success from y, (select unnest([0.6, 0.8, 0.9])::double as cb), (select unnest([1, 2])::double as cv) group by 1, 2, 3, 4) select cut_best, above_best, cut_votes, above_votes, n, days, round(success + 1e-9, 6) as success from m",
)
register(
    "select_apply_params",
    lambda spark, sf: date(se.apply_params(views.votes(spark, sf), spark.createDataFrame([(1, ["m1", "m2", "m3"], 0.6, 1), (2, ["m4", "m5", "m6", "m7"], 0.8, 2)], "id int, models array<string>, least double, min_count int")), "id", "code", "n", "hit"),
    VOTES + ", p as (select unnest([1, 2]) as id, unnest([['m1', 'm2', 'm3'], ['m4', 'm5', 'm6', 'm7']]) as models, unnest([0.6, 0.8])::double as least, unnest([1, 2]) as min_count), h as (select id, date, code, count(*) as n, max(hit::int) as hit from votes join p on list_contains(models, model) and prob >= least group by id, date, code, min_count having count(*) >= min_count) select date::varchar as date, id, code, n, hit from h qualify row_number() over (partition by id, date order by n desc, code) = 1",
)
register(
    "select_interval_split",
    lambda spark, sf: se.interval_split(days(spark, sf), days(spark, sf).groupBy("date").agg(F.avg("hit").alias("success")), [0.2, 0.4, 0.6, 0.8]).groupBy("band").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days")),
    DAYS + ", s as (select date, avg(hit) as success from y group by 1), z as (select y.*, (success >= 0.2)::int + (success >= 0.4)::int + (success >= 0.6)::int + (success >= 0.8)::int as band from y join s using (date)) select band, count(*) as n, count(distinct date) as days from z group by 1",
)
register("select_attach_next_day", lambda spark, sf: date(se.attach_next_day(days(spark, sf)), "code", C("next_date").cast("string").alias("next_date"), "next_hit"), DAYS + " select date::varchar as date, code, (lead(date) over (partition by code order by date))::varchar as next_date, lead(hit) over (partition by code order by date) as next_hit from y")
register("select_fail_rate_pairs", lambda spark, sf: se.fail_rate_pairs(days(spark, sf).withColumn("month", F.month("date")), "month").select("month", "n", *r6("single_rate", "several_rate")), DAYS + " select month(date) as month, count(*) as n, round(avg(case when votes = 1 then (hit = 0)::int end) + 1e-9, 6) as single_rate, round(avg(case when votes > 1 then (hit = 0)::int end) + 1e-9, 6) as several_rate from y group by 1")
register("select_second_day_filter", lambda spark, sf: se.second_day_filter(days(spark, sf), 0.5), DAYS + ", m as (select code, date_trunc('month', date) as month, avg((hit = 0)::int) as rate from y group by 1, 2) select code, count(*) as months from m group by code having count(*) = count(*) filter (where rate <= 0.5)")
