"""Fund analytics on long daily returns (code, date, ret); the wide matrix is never built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as fn
from .blocks import downside_corr, pairwise_corr  # noqa: F401  part of this module's functions

C = F.col
YEAR = 252
MARK = "\u0001"  # between a key and the seed of its weights
#: Seeds of the perturbed weights; limits of the vetoes and the score (fixed values).
SEEDS = (1024, 2048, 4096)
LIMITS = {
    "history": 5 * YEAR, "least_days": 40, "zeros": 10, "hurdle": 0.05, "drawdown": 0.5, "calmar_multiple": 1.01, "recovery": 350, "ar1": 0.55, "vol": 0.03, "worst_year": -0.15,
    "tail": 2.5, "saturation": 5 * YEAR, "corr_high": 0.8, "corr_mid": 0.5,
}


def upto():
    return Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def zero_run(rets: DataFrame, tiny: float = 1e-8) -> DataFrame:
    """Longest run of returns of about zero by code."""
    flagged = rets.withColumn("zero", F.abs("ret") < tiny)
    islands = flagged.withColumn("island", F.sum((~C("zero")).cast("int")).over(upto())).filter("zero")
    runs = islands.groupBy("code", "island").agg(F.count("*").alias("n")).groupBy("code").agg(F.max("n").alias("zero_run"))
    return rets.select("code").distinct().join(runs, "code", "left").select("code", F.coalesce("zero_run", F.lit(0)).alias("zero_run"))


def fund_stats(rets: DataFrame, tiny: float = 1e-8) -> DataFrame:
    """Active span, days, share of calendar dates missing in the span, longest zero run."""
    span = rets.groupBy("code").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("days"))
    calendar = rets.select("date").distinct()
    # a position in the calendar turns the span into a count without a join on ranges
    ranked = calendar.withColumn("pos", F.row_number().over(Window.orderBy("date")))
    a, b = ranked.select(C("date").alias("first"), C("pos").alias("p1")), ranked.select(C("date").alias("last"), C("pos").alias("p2"))
    made = span.join(a, "first").join(b, "last").withColumn("missing", 1 - C("days") / (C("p2") - C("p1") + 1))
    return made.join(zero_run(rets, tiny), "code").select("code", "first", "last", "days", "missing", "zero_run")


def fund_profile(rets: DataFrame, last_n: int = 5 * YEAR) -> DataFrame:
    """Days, annual return and maximum drawdown of the adjusted value over the last n days."""
    recent = rets.withColumn("back", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).filter(C("back") <= last_n)
    nav = recent.withColumn("nav", F.product(1 + C("ret")).over(upto())).withColumn("peak", F.greatest(F.max("nav").over(upto()), F.lit(1.0)))
    made = nav.groupBy("code").agg(F.count("*").alias("days"), F.max_by("nav", "date").alias("final"), F.min(C("nav") / C("peak") - 1).alias("drawdown"))
    return made.withColumn("annual", F.pow("final", F.lit(float(YEAR)) / C("days")) - 1)


def incremental_profile(old: DataFrame, rets: DataFrame, last_n: int = 5 * YEAR) -> DataFrame:
    """Profiles of funds that the old table lacks, with the old ones."""
    new = fund_profile(rets.join(old.select("code"), "code", "left_anti"), last_n)
    return old.unionByName(new.select(*old.columns))


def conflicts(corr: DataFrame, downside: DataFrame, most: float = 0.95, most_downside: float = 0.75) -> DataFrame:
    """Pairs (a, b) too alike: by all days or by the worst ones. A fund in neither table conflicts with none."""
    return corr.filter(C("corr") > most).select("a", "b").unionByName(downside.filter(C("downside") > most_downside).select("a", "b")).distinct()


def greedy_corr_filter(ranked: DataFrame, conflicts: DataFrame, keep) -> DataFrame:
    """In rank order keep a fund unless it conflicts with a kept one: rounds of keeping those without an undecided better neighbour.

    ranked: (code, rank); conflicts: (a, b) pairs. ``keep`` makes a round durable.
    """
    both = conflicts.select("a", "b").unionByName(conflicts.select(C("b").alias("a"), C("a").alias("b")))
    r = ranked.select("code", "rank")
    edges = keep(both.join(r.select(C("code").alias("a"), C("rank").alias("ra")), "a").join(r.select(C("code").alias("b"), C("rank").alias("rb")), "b").filter(C("rb") < C("ra")).select("a", "b"))
    undecided, kept = keep(r), None
    while not undecided.isEmpty():
        waits = edges.join(undecided.select(C("code").alias("b")), "b", "left_semi").select(C("a").alias("code")).distinct()
        ready = keep(undecided.join(waits, "code", "left_anti"))
        kept = ready if kept is None else keep(kept.unionByName(ready))
        gone = edges.join(ready.select(C("code").alias("b")), "b", "left_semi").select(C("a").alias("code")).distinct()
        undecided = keep(undecided.join(ready.select("code"), "code", "left_anti").join(gone, "code", "left_anti"))
    return kept if kept is not None else r


def combo_returns(rets: DataFrame, combos: DataFrame) -> DataFrame:
    """Rows (key, size, code, t, date, ret) over the dates on which all members have a return."""
    members = combos.select("key", F.size("combo").alias("size"), F.explode("combo").alias("code"))
    rows = members.join(rets, "code")
    full = rows.withColumn("n", F.count("*").over(Window.partitionBy("key", "date"))).filter(C("n") == C("size")).drop("n")
    return full.withColumn("t", F.dense_rank().over(Window.partitionBy("key").orderBy("date")) - 1)


def perturbed_weights(combos: DataFrame, seeds: tuple[int, ...] = SEEDS, spread: float = 0.05, least: float = 0.01) -> DataFrame:
    """(key, seed, code, weight): equal weights, each moved by up to ``spread`` (drawn by a stable hash), cut to ``least``..1 and scaled to 1."""
    members = combos.select("key", F.size("combo").alias("size"), F.explode("combo").alias("code")).withColumn("seed", F.explode(F.array(*[F.lit(x) for x in seeds])))
    named = F.concat_ws("|", "key", "code", C("seed").cast("string")).cast("binary")
    draw = F.conv(F.substring(F.md5(named), 1, 7), 16, 10).cast("long") % 10001 / F.lit(10000.0)
    raw = members.withColumn("raw", F.least(F.greatest(1 / C("size") + (draw * 2 - 1) * spread, F.lit(least)), F.lit(1.0)))
    return raw.select("key", "seed", "code", (C("raw") / F.sum("raw").over(Window.partitionBy("key", "seed"))).alias("weight"))


def portfolio_path(rows: DataFrame, every: int = 30, offset: int = 0) -> DataFrame:
    """Daily return of weights (column ``weight``, else equal ones) that drift and are reset after day t if t >= every and every divides t - offset.

    Within a segment the value is the weighted sum of the members' running products, so no loop is needed.
    """
    first = every + offset  # the first day with a reset after it
    seg = rows.withColumn("segment", F.when(C("t") > first, F.floor((C("t") - 1 - first) / every) + 1).otherwise(0).cast("int"))
    grown = seg.withColumn("g", F.product(1 + C("ret")).over(Window.partitionBy("key", "code", "segment").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum(C("g") * C("weight")) if "weight" in rows.columns else F.avg("g")
    value = grown.groupBy("key", "segment", "t", "date").agg(total.alias("v"))
    last = F.coalesce(F.lag("v").over(Window.partitionBy("key", "segment").orderBy("t")), F.lit(1.0))
    return value.withColumn("ret", C("v") / last - 1).select("key", "t", "date", "ret")


def portfolio_metrics(path: DataFrame) -> DataFrame:
    """Days, growth, drawdown, calmar, first-order autocorrelation, volatility, worst year (0 within the first), longest time under water and share of gains."""
    w = Window.partitionBy("key").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    nav = path.withColumn("nav", F.product(1 + C("ret")).over(run))
    year = F.when(C("t") == YEAR - 1, C("nav") - 1).otherwise(C("nav") / F.lag("nav", YEAR).over(w) - 1)
    nav = nav.withColumns({"peak": F.greatest(F.max("nav").over(run), F.lit(1.0)), "prev": F.lag("ret").over(w), "year": year})
    nav = nav.withColumn("under", C("nav") < C("peak") * (1 - 1e-12)).withColumn("island", F.sum((~C("under")).cast("int")).over(run))
    nav = nav.withColumn("wet", F.sum(C("under").cast("int")).over(Window.partitionBy("key", "island").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    pair = C("prev").isNotNull()
    x, y = F.when(pair, C("prev")), F.when(pair, C("ret"))
    made = nav.groupBy("key").agg(
        F.count("*").alias("days"), F.max_by("nav", "t").alias("final"), F.min(C("nav") / C("peak") - 1).alias("drawdown"), fn.div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("ar1"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(YEAR)))).alias("vol"), F.coalesce(F.min("year"), F.lit(0.0)).alias("worst_year"),
        F.max("wet").alias("recovery"), F.avg((C("ret") > 1e-12).cast("double")).alias("win"),
    )
    made = made.withColumn("cagr", F.pow("final", F.lit(float(YEAR)) / C("days")) - 1)
    return made.withColumns({"calmar": fn.div("cagr", F.abs("drawdown")), "sharpe": fn.div("cagr", "vol")})


def member_baseline(rows: DataFrame, tiny: float = 1e-8) -> DataFrame:
    """By key over its members' own paths: mean annual return, mean drawdown, their ratio, and the longest run of returns of about zero."""
    w = Window.partitionBy("key", "code").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    nav = rows.withColumns({"nav": F.product(1 + C("ret")).over(w), "island": F.sum((F.abs("ret") >= tiny).cast("int")).over(w)}).withColumn("peak", F.greatest(F.max("nav").over(w), F.lit(1.0)))
    still = Window.partitionBy("key", "code", "island").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    nav = nav.withColumn("zeros", F.sum((F.abs("ret") < tiny).cast("int")).over(still))
    each = nav.groupBy("key", "code").agg(F.max_by("nav", "t").alias("final"), F.count("*").alias("days"), F.min(C("nav") / C("peak") - 1).alias("drawdown"), F.max("zeros").alias("zeros"))
    made = each.groupBy("key").agg(F.avg(F.pow("final", F.lit(float(YEAR)) / C("days")) - 1).alias("mean_cagr"), F.avg("drawdown").alias("mean_drawdown"), F.max("zeros").alias("zeros"))
    return made.withColumn("baseline", F.when(F.abs("mean_drawdown") > 1e-6, C("mean_cagr") / F.abs("mean_drawdown")).otherwise(0.0))


def path_downside(rows: DataFrame, path: DataFrame, share: float = 0.05, least: int = 5) -> DataFrame:
    """By key: the largest correlation of two members on the path's worst days; 0.5 where none is defined. Members meet by (key, day)."""
    w = Window.partitionBy("key")
    ranked = path.withColumns({"r": F.row_number().over(w.orderBy(F.round("ret", 9), "t")), "n": F.count("*").over(w)})
    worst = ranked.filter(C("r") <= F.greatest(F.floor(C("n") * share), F.lit(least))).select("key", "t")
    days = rows.join(worst, ["key", "t"])
    pairs = days.select("key", "t", C("code").alias("a"), C("ret").alias("x")).join(days.select("key", "t", C("code").alias("b"), C("ret").alias("y")), ["key", "t"]).filter("a < b")
    each = pairs.groupBy("key", "a", "b").agg(fn.div(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("corr"))
    found = each.groupBy("key").agg(F.max("corr").alias("corr"))
    return path.select("key").distinct().join(found, "key", "left").select("key", F.coalesce("corr", F.lit(0.5)).alias("downside"))


def veto_and_score(metrics: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """The first veto that a combination meets, and its score (0 under a veto).

    Score: calmar x smoothness (worst R2) x tail discount x time factor x correlation penalty. ``metrics`` has
    the columns of portfolio_metrics, member_baseline (zeros, baseline), worst_window_r2 and path_downside.
    """
    v = LIMITS | (limits or {})
    veto = (
        F.when(C("zeros") > v["zeros"], "distortion")
        .when(C("cagr") < v["hurdle"], "hurdle")
        .when(-C("drawdown") > v["drawdown"], "drawdown")
        .when(F.coalesce("calmar", F.lit(0.0)) <= C("baseline") * v["calmar_multiple"], "baseline")
        .when(C("recovery") > v["recovery"], "bleeding")
        .when((F.coalesce("ar1", F.lit(1.0)) > v["ar1"]) & (C("vol") < v["vol"]), "smooth")
        .when(C("worst_year") < v["worst_year"], "worst_year")
    )
    calmar = F.greatest(C("cagr"), F.lit(0.0)) / F.greatest(F.abs("drawdown"), F.lit(0.01))
    tail = F.exp(F.least(C("worst_year"), F.lit(0.0)) * v["tail"])
    time = F.least(F.lit(1.0), F.sqrt(C("days") / v["saturation"]))
    dc = C("downside")
    penalty = F.when(dc > v["corr_high"], 0.1).when(dc > v["corr_mid"], F.least(F.greatest(1 - (dc - v["corr_mid"]), F.lit(0.5)), F.lit(1.0))).otherwise(1.0)
    score = F.greatest(calmar * C("worst_r2") * tail * time * penalty, F.lit(0.0))
    return metrics.withColumn("veto", veto).withColumn("score", F.when(C("veto").isNull(), score).otherwise(0.0))


def evaluate_combos(rets: DataFrame, combos: DataFrame, every: int = 30, seeds: tuple[int, ...] = SEEDS, limits: dict[str, float] | None = None, keep=lambda df: df) -> DataFrame:
    """Each combination (key, combo): metrics and veto of equal weights, its score, the least score of the perturbed weights
    (reset half a period off), and the lesser of the two as ``total``. Days are those on which all members have a return;
    the last ``history`` count, and combinations with fewer than ``least_days`` drop out. ``keep`` makes what is
    read several times durable."""
    v = LIMITS | (limits or {})
    back = F.max("t").over(Window.partitionBy("key")) - C("t")
    rows = combo_returns(rets, combos).withColumn("back", back).filter(C("back") < v["history"]).drop("back")
    days = F.max("t").over(Window.partitionBy("key")) - F.min("t").over(Window.partitionBy("key")) + 1
    rows = rows.withColumns({"_days": days, "t": C("t") - F.min("t").over(Window.partitionBy("key"))}).filter(C("_days") >= v["least_days"]).drop("_days")
    rows = keep(rows)
    moved = rows.join(perturbed_weights(combos, seeds), ["key", "code"]).withColumn("key", F.concat_ws(MARK, "key", C("seed").cast("string"))).drop("seed")
    path = keep(portfolio_path(rows, every).unionByName(portfolio_path(moved, every, every // 2)))
    both = rows.unionByName(moved.select(*rows.columns))
    made = portfolio_metrics(path).join(member_baseline(both), "key").join(worst_window_r2(path).drop("windows"), "key").join(path_downside(both, path), "key")
    scored = veto_and_score(made, v).withColumns({"of": F.split_part("key", F.lit(MARK), F.lit(1)), "moved": F.contains(C("key"), F.lit(MARK))})
    worst = scored.filter("moved").groupBy(C("of").alias("key")).agg(F.min("score").alias("perturbed"))
    return scored.filter("not moved").drop("of", "moved").join(worst, "key").withColumn("total", F.least("score", "perturbed"))


def append_results(combos: DataFrame, computed: DataFrame, evaluate) -> DataFrame:
    """Results so far (with a column key) and those of the combinations that they lack."""
    new = evaluate(combos.join(computed.select("key"), "key", "left_anti"))
    return computed.unionByName(new.select(*computed.columns))


def downside_corr_from_results(results: DataFrame) -> DataFrame:
    """(a, b, downside), both ways round, from results of pairs (combo, downside): the mean where a pair comes more than once."""
    pairs = results.filter(F.size("combo") == 2).select(C("combo")[0].alias("x"), C("combo")[1].alias("y"), "downside")
    both = pairs.select(C("x").alias("a"), C("y").alias("b"), "downside").unionByName(pairs.select(C("y").alias("a"), C("x").alias("b"), "downside"))
    return both.groupBy("a", "b").agg(F.avg("downside").alias("downside"))


def merge_dims_and_rank(dims: list[DataFrame], funds: DataFrame, least_days: int, least_cagr: float, scale: float = 10000) -> DataFrame:
    """Results of several sizes (key, combo, days, cagr, calmar, baseline, downside, total) as one ranking.

    Only combinations of known funds (code, name, overseas) stay that pass the limits and have a score; with
    the members' simplified names in order, their number, whether one is overseas, and scores less correlation.
    """
    every = dims[0]
    for more in dims[1:]:
        every = every.unionByName(more)
    kept = every.filter((C("days") > least_days) & (C("total") > 0) & (C("cagr") > least_cagr)).withColumn("total", C("total") * scale)
    members = kept.select("key", F.size("combo").alias("size"), F.posexplode("combo").alias("at", "code"))
    known = members.join(funds.select("code", simplify_name(C("name")).alias("name"), "overseas"), "code")
    named = known.groupBy("key", "size").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "_").alias("names"), F.max(C("overseas").cast("int")).alias("overseas")).filter(C("n") == C("size"))
    score = F.pow(C("cagr") * 10, F.lit(3)) * C("total")
    out = kept.join(named.drop("n"), "key").withColumns({"score": score, "calmar_gain": C("calmar") - C("baseline")})
    return out.withColumns({"total_less_corr": C("total") / (C("downside") + 1), "score_less_corr": C("score") / (C("downside") + 1), "overseas": C("overseas") == 1})


def valid_overlap(rets: DataFrame, combos: DataFrame, stale_days: int = 35) -> DataFrame:
    """First and last date on which all members have a return, how many such days, and whether the last is over ``stale_days`` days before the table's last date."""
    found = combo_returns(rets, combos).groupBy("key").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("days"))
    newest = F.broadcast(rets.agg(F.max("date").alias("newest")))  # one row
    return found.join(newest).withColumn("stale", F.date_diff("newest", "last") > stale_days).drop("newest")


def baseline(profiles: DataFrame) -> DataFrame:
    made = profiles.agg(F.avg("annual").alias("annual"), F.avg("drawdown").alias("drawdown"))
    return made.withColumn("ratio", fn.div("annual", F.abs("drawdown")))


def worst_window_r2(path: DataFrame, window: int = YEAR, step: int = 21) -> DataFrame:
    """Least R2 of the log value against time over windows that start every ``step`` days; a shorter path is one window. 0 where it is undefined."""
    w = Window.partitionBy("key").orderBy("t")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    logs = path.withColumn("y", F.sum(F.log1p("ret")).over(run)).withColumns({"_ty": C("t") * C("y"), "_yy": C("y") * C("y")})
    # sums over a window are differences of running sums
    sums = logs.withColumns({f"_run{c}": F.sum(c).over(run) for c in ("y", "_ty", "_yy")})
    sums = sums.withColumns({f"_in{c}": C(f"_run{c}") - F.coalesce(F.lag(f"_run{c}", window).over(w), F.lit(0.0)) for c in ("y", "_ty", "_yy")})
    n = F.least(C("t") + 1, F.lit(window)).cast("double")
    cov = (C("_in_ty") - (C("t") + 1 - n) * C("_iny")) / n - (n - 1) / 2 * C("_iny") / n
    var = (n * n - 1) / 12 * (C("_in_yy") / n - F.pow(C("_iny") / n, F.lit(2)))
    last = F.max("t").over(Window.partitionBy("key"))
    ends = (C("t") >= window - 1) & ((C("t") - (window - 1)) % step == 0)
    kept = sums.withColumns({"r2": F.when(var > 1e-12, cov * cov / var).otherwise(0.0), "ends": F.when(last >= window - 1, ends).otherwise(C("t") == last)}).filter("ends")
    return kept.groupBy("key").agg(F.min("r2").alias("worst_r2"), F.count("*").alias("windows"))


def simplify_name(name):
    """Without brackets, listed words and a closing class letter."""
    x = F.regexp_replace(name, r"[（(][^）)]*[）)]", "")
    return F.regexp_replace(F.regexp_replace(x, "(Supplier|#)", ""), "[A-E]$", "")
