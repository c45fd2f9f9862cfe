"""Reports over model votes (vote_id, date, code, model, prob, hit) and analyses of what they select."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import series as fn

C = F.col


def stable_split(df: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """Train (True) or test by the first digits of the key's MD5, which any engine gives alike."""
    digits = F.conv(F.substring(F.md5(C(key).cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    return df.withColumn("train", digits % 1000 < int(share * 1000))


def threshold_report(votes: DataFrame, levels: list[float], good: float = 0.9) -> DataFrame:
    """By model and level: precision, share predicted, share of dates with precision of at least ``good``, and whether the loss rule holds."""
    grid = votes.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    picked = (C("prob") >= C("level")).cast("int")
    days = grid.groupBy("model", "level", "date").agg(F.count("*").alias("n"), F.sum(picked).alias("picked"), F.sum(picked * C("hit").cast("int")).alias("hits"))
    made = days.groupBy("model", "level").agg(
        F.sum("n").alias("n"), F.sum("picked").alias("picked"), F.sum("hits").alias("hits"), F.count_if(C("picked") > 0).alias("days"), F.count_if((C("picked") > 0) & (C("hits") >= good * C("picked"))).alias("good_days")
    )
    return made.withColumns({"precision": fn.div("hits", "picked"), "predicted": fn.div("picked", "n"), "good_share": fn.div("good_days", "days"), "loss_ok": C("hits") - (C("picked") - C("hits")) * 3 > 0})


def first_passing(report: DataFrame, least: float) -> DataFrame:
    """The lowest level of each model at which the precision passes."""
    return report.filter(C("precision") >= least).groupBy("model").agg(F.min("level").alias("level"))


def min_day_scan(days: DataFrame, cutoffs: list[int], least: float) -> DataFrame:
    """The smallest count a day must have for the share of good days to pass (days: date, n, good)."""
    grid = days.withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs]))).filter(C("n") > C("cutoff"))
    return grid.groupBy("cutoff").agg(F.avg(C("good").cast("double")).alias("share"), F.count("*").alias("days")).filter(C("share") >= least).agg(F.min("cutoff").alias("cutoff"))


def common_thresholds(passing: DataFrame, sources: int) -> DataFrame:
    """Levels that pass in every source."""
    return passing.groupBy("level").agg(F.countDistinct("source").alias("n")).filter(C("n") == sources).select("level")


def monotone_check(report: DataFrame, most: int) -> DataFrame:
    """Models whose precision falls at most ``most`` times as the level rises."""
    w = Window.partitionBy("model").orderBy("level")
    falls = report.filter("precision is not null").withColumn("fall", fn.sig(C("precision") < F.lag("precision").over(w)).cast("int"))
    return falls.groupBy("model").agg(F.sum("fall").alias("falls")).withColumn("ok", C("falls") <= most)


def model_cover_filter(votes: DataFrame, rank: DataFrame) -> DataFrame:
    """Models, best rank first, that cover a stock-day no better one covers: those with the least rank of some item."""
    first = votes.join(rank, "model").groupBy("date", "code").agg(F.min("rank").alias("rank"))
    return rank.join(first.select("rank").distinct(), "rank", "left_semi")


def topn_success(votes: DataFrame, most: int = 10) -> DataFrame:
    """Success of the n most probable votes of each date, for n up to ``most``."""
    w = Window.partitionBy("date").orderBy(F.desc("prob"), "vote_id")
    top = votes.withColumn("r", F.row_number().over(w)).filter(C("r") <= most)
    each = top.withColumn("n", F.explode(F.sequence(C("r"), F.lit(most))))
    return each.groupBy("n").agg(F.count("*").alias("votes"), F.avg(C("hit").cast("double")).alias("success"))


def load_best_models(report: DataFrame, least_days: int) -> DataFrame:
    """The level of best precision of each model with enough days; ties to the lower level."""
    w = Window.partitionBy("model").orderBy(F.desc("precision"), "level")
    return report.filter((C("days") >= least_days) & C("precision").isNotNull()).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def tree_votes(votes: DataFrame, level: float) -> DataFrame:
    """Share of votes above the level for each item, and the log ratio of votes for and against."""
    up = F.count_if(C("prob") >= level)
    made = votes.groupBy("date", "code").agg(F.count("*").alias("n"), up.alias("up"))
    return made.withColumns({"share": fn.div("up", "n"), "log_ratio": F.ln((C("up") + 1) / (C("n") - C("up") + 1))})


def votes_per_stock_day(votes: DataFrame) -> DataFrame:
    return votes.groupBy("date", "code").agg(F.count("*").alias("votes"), F.max("prob").alias("best"), F.min("prob").alias("least"), F.max(C("hit").cast("int")).alias("hit"))


def single_code_days(days: DataFrame) -> DataFrame:
    return days.withColumn("single", F.count("*").over(Window.partitionBy("date")) == 1)


def biggest_per_day(days: DataFrame) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.desc("votes"), "code")
    return days.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def split_points(df: DataFrame, column: str, k: int) -> DataFrame:
    """k-1 values at equal steps of the sorted distinct values."""
    ranked = ranks.row_numbers(df.select(C(column).alias("cut")).distinct(), C("cut"), [], "r")
    total = ranked.agg(F.max("r").alias("total"))
    step = F.floor(C("total") / k)
    return ranked.crossJoin(F.broadcast(total)).filter((step > 0) & (C("r") % step == 0) & (C("r") / step < k)).select("cut")


def parameter_sweep(days: DataFrame, cuts: DataFrame, column: str) -> DataFrame:
    """Both sides of each cut: rows, dates and success; of sides with the same rows and dates the least cut stays."""
    sides = days.crossJoin(F.broadcast(cuts)).withColumn("above", C(column) >= C("cut"))
    made = sides.groupBy("cut", "above").agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.avg(C("hit").cast("double")).alias("success"))
    w = Window.partitionBy("above", "n", "days", F.round("success", 9)).orderBy("cut")
    return made.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def rank_score(votes: DataFrame, columns: list[str]) -> DataFrame:
    """Points by dense rank within a date: 5, 3, 2, then 1; summed over the columns."""
    def points(c):
        r = F.dense_rank().over(Window.partitionBy("date").orderBy(F.desc(c)))
        return F.when(r == 1, 5).when(r == 2, 3).when(r == 3, 2).otherwise(1)

    return votes.withColumn("points", sum((points(c) for c in columns), F.lit(0)))


def total_rank(votes: DataFrame, columns: list[str]) -> DataFrame:
    return votes.withColumn("total_rank", sum((F.rank().over(Window.partitionBy("date").orderBy(F.desc(c))) for c in columns), F.lit(0)))


def ratio_membership(votes: DataFrame, width: float) -> DataFrame:
    """In how many probability classes each item appears."""
    return votes.groupBy("date", "code").agg(F.countDistinct(F.floor(C("prob") / width + 1e-9)).alias("classes"))


def condition_grid(days: DataFrame, levels: list[float]) -> DataFrame:
    """For each level, the first row of each date that reaches it: how many, and how many fail."""
    grid = days.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).filter(C("best") >= C("level"))
    first = grid.withColumn("r", F.row_number().over(Window.partitionBy("level", "date").orderBy("code"))).filter("r = 1")
    return first.groupBy("level").agg(F.count("*").alias("n"), F.count_if(C("hit") == 0).alias("fails")).withColumn("rate", fn.div("fails", "n"))


def ma_cross_rebound(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    """The short mean crosses the long one from below (means over what there is)."""
    from ..functions.series import Series

    s = Series()
    df = df.withColumns({"_s": F.avg("close").over(s.past(short)), "_l": F.avg("close").over(s.past(long))})
    return df.withColumn("rebound", s.cross("_s", "_l", "sign")).drop("_s", "_l")


def future_max_return(df: DataFrame) -> DataFrame:
    """The running maximum of the relative return, one bar on."""
    from ..functions.series import Series

    s = Series()
    return df.withColumn("_m", F.max("relative").over(s.upto)).withColumn("future_max", F.lead("_m").over(s.w)).drop("_m")


def group_market_corr(df: DataFrame) -> DataFrame:
    """Correlation of each series' relative return with the market's mean; NULL for a constant series."""
    market = df.groupBy("ts").agg(F.avg("relative").alias("market"))
    both = df.join(market, "ts").filter(C("relative").isNotNull() & C("market").isNotNull())
    return both.groupBy("code").agg(fn.div(F.covar_pop("relative", "market"), F.stddev_pop("relative") * F.stddev_pop("market")).alias("corr"), F.count("*").alias("n"))


def nested_sweep(days: DataFrame, axes: dict[str, list[float]]) -> DataFrame:
    """Both sides of a cut on each axis, in all combinations: rows, dates and success. Axes are short lists of cuts."""
    out, keys = days, []
    for column, cuts in axes.items():
        out = out.withColumn(f"cut_{column}", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).withColumn(f"above_{column}", C(column) >= C(f"cut_{column}"))
        keys += [f"cut_{column}", f"above_{column}"]
    return out.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.avg(C("hit").cast("double")).alias("success"))


def apply_params(votes: DataFrame, params: DataFrame) -> DataFrame:
    """For each parameter row (id, models, least, min_count): the most voted code of each date among votes of its models
    at ``least`` or better, if it has ``min_count`` votes. Votes meet the parameters by model."""
    keyed = params.select("id", F.explode("models").alias("model"), "least", "min_count")
    hit = votes.join(keyed, "model").filter(C("prob") >= C("least"))
    made = hit.groupBy("id", "date", "code").agg(F.count("*").alias("n"), F.first("min_count").alias("min_count"), F.max(C("hit").cast("int")).alias("hit")).filter(C("n") >= C("min_count"))
    best = F.row_number().over(Window.partitionBy("id", "date").orderBy(F.desc("n"), "code"))
    return made.withColumn("r", best).filter("r = 1").select("id", "date", "code", "n", "hit")


def interval_split(days: DataFrame, performance: DataFrame, edges: list[float]) -> DataFrame:
    """Rows with the band of success (performance: date, success) that their date falls into; the last band is open."""
    band = sum(((C("success") >= e).cast("int") for e in edges), F.lit(0))
    return days.join(performance.select("date", band.alias("band")), "date")


def attach_next_day(days: DataFrame) -> DataFrame:
    """Each row with its code's outcome on its own next date."""
    w = Window.partitionBy("code").orderBy("date")
    return days.withColumns({"next_date": F.lead("date").over(w), "next_hit": F.lead("hit").over(w)})


def fail_rate_pairs(df: DataFrame, group: str) -> DataFrame:
    """For each group the failure rates of single and of several votes, side by side."""
    def rate(c):
        return F.avg(F.when(c, (C("hit") == 0).cast("double")))

    return df.groupBy(group).agg(rate(C("votes") == 1).alias("single_rate"), rate(C("votes") > 1).alias("several_rate"), F.count("*").alias("n"))


def second_day_filter(df: DataFrame, most: float) -> DataFrame:
    """Codes whose failure rate stays within the limit in every month they appear in."""
    months = df.groupBy("code", F.date_trunc("month", "date").alias("month")).agg(F.avg((C("hit") == 0).cast("double")).alias("rate"))
    return months.groupBy("code").agg(F.count("*").alias("months"), F.count_if(C("rate") <= most).alias("ok")).filter(C("months") == C("ok")).select("code", "months")
