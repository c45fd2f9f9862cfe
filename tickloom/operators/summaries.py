"""Summaries of trades, votes and market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import series as fn

C = F.col


def trade_summary(ledger: DataFrame, by: list[str], slow: int = 1, last: str | None = None) -> DataFrame:
    """Trades, profit, cost, slow trades, days held, and trades by age against the date ``last``."""
    age = F.months_between(F.lit(last).cast("date") if last else F.max("buy_ts").over(Window.partitionBy()), C("buy_ts").cast("date"))
    rows = ledger.withColumn("age", age)
    return rows.groupBy(*by).agg(
        F.count("*").alias("trade_count"),
        F.sum("profit").alias("total_profit"),
        F.sum("cost").alias("total_cost"),
        F.count_if(C("days_held") > slow).alias("slow_count"),
        F.sum("days_held").alias("days_held"),
        *[F.count_if(C("age") <= 12 * y).alias(f"last_{y}y") for y in (1, 2, 3)],
    )


def derived(stats: DataFrame) -> DataFrame:
    """Ratios of summed counters; a group without trades has ratio 1."""
    n = C("trade_count")
    return stats.withColumns(
        {
            "ratio": F.when(n == 0, 1.0).otherwise(fn.div("slow_count", n)),
            "average_days_held": F.when(n == 0, 0.0).otherwise(fn.div("days_held", n)),
            "average_profit": F.when(n == 0, 0.0).otherwise(fn.div("total_profit", n)),
            "profit_10k": F.when(n == 0, 0.0).otherwise(fn.div(C("total_profit") * 10000, "total_cost")),
        }
    )


def trade_summary_by_period(ledger: DataFrame, unit: str = "month", slow: int = 1) -> DataFrame:
    """A row for each period and one for all (period 'all')."""
    period = F.date_trunc(unit, C("buy_ts").cast("timestamp")).cast("date").cast("string")
    made = ledger.withColumn("period", period).rollup("period").agg(F.grouping_id().alias("g"), F.count("*").alias("trade_count"), F.sum("profit").alias("total_profit"), F.sum("cost").alias("total_cost"), F.count_if(C("days_held") > slow).alias("slow_count"), F.sum("days_held").alias("days_held"))
    return made.withColumn("period", F.when(C("g") == 1, "all").otherwise(C("period"))).drop("g")


def daily_ledger_performance(ledger: DataFrame, slow: int = 1) -> DataFrame:
    """A row for each date of buying, the smallest share of slow trades first, then the most trades."""
    made = ledger.groupBy(C("buy_ts").cast("date").alias("buy_date")).agg(F.count("*").alias("trade_count"), F.sum("profit").alias("total_profit"), F.sum("cost").alias("total_cost"), F.count_if(C("days_held") > slow).alias("slow_count"), F.sum("days_held").alias("days_held"))
    return derived(made).orderBy("ratio", F.desc("trade_count"), "buy_date")


def merge_partials(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add counters of the same key, then derive the ratios."""
    counters = ("trade_count", "total_profit", "total_cost", "slow_count", "days_held")
    return derived(parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]))


def portfolio_report(ledger: DataFrame, calendar: DataFrame, slow: int = 1) -> DataFrame:
    days = calendar.agg(F.countDistinct(C("ts").cast("date")).alias("all_days"))
    total = ledger.agg(F.count("*").alias("trade_count"), F.sum("profit").alias("total_profit"), F.sum("cost").alias("total_cost"), F.countDistinct(C("buy_ts").cast("date")).alias("date_count"), F.min("buy_ts").alias("first"), F.max("buy_ts").alias("last"), F.count_if(C("days_held") > slow).alias("slow_count"))
    return total.crossJoin(days).withColumns({"date_ratio": fn.div("date_count", "all_days"), "slow_ratio": fn.div("slow_count", "trade_count")})


def fitness(stats: DataFrame) -> DataFrame:
    """log of the count over the ratio; 0 without trades."""
    return stats.withColumn("fitness", F.when(C("trade_count") > 0, fn.div(F.log(C("trade_count")), C("ratio") + 0.01)).otherwise(0.0))


def interval_histogram(df: DataFrame, x: str, width: float, bins: int) -> DataFrame:
    """Count and share of each of the bins [k * width, ...), empty ones included."""
    spark = df.sparkSession
    filled = df.groupBy(F.floor(C(x) / width + 1e-9).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(x).alias("total"))
    every = spark.range(bins).select(C("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").crossJoin(total).select("bin", F.coalesce("n", F.lit(0)).alias("n"), fn.div(F.coalesce("n", F.lit(0)), "total").alias("share"))


def column_range_rank(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by the spread of their values, widest first."""
    spread = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns])
    long = spread.unpivot([], columns, "name", "spread")
    return long.withColumn("place", F.row_number().over(Window.orderBy(F.desc("spread"), "name")))


def select_stats(df: DataFrame, value: str, least: float) -> DataFrame:
    """Rows and days in all and below a threshold, their shares, and the days below in order."""
    low = C(value) < least
    made = df.agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.count_if(low).alias("low"), F.countDistinct(F.when(low, C("date"))).alias("low_days"))
    return made.withColumns({"low_share": fn.div("low", "n"), "low_day_share": fn.div("low_days", "days")})


def group_transform(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({"group_n": F.count("*").over(w), "group_mean": F.avg(value).over(w), "group_max": F.max(value).over(w)})


def detail_threshold_counts(votes: DataFrame, levels=(0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """For each (date, code): how many votes reach each level, and their share."""
    counts = {f"n{int(v * 100)}": F.count_if(C("prob") >= v) for v in levels}
    made = votes.groupBy("date", "code").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in counts.items()])
    return made.withColumns({f"share{k[1:]}": fn.div(k, "n") for k in counts})


def weighted_share(df: DataFrame, weight: str, cond) -> DataFrame:
    return df.agg(F.sum(F.when(cond, C(weight)).otherwise(0)).alias("weight"), fn.div(F.sum(F.when(cond, C(weight)).otherwise(0)), F.sum(weight)).alias("share"))


def fail_rate_grid(df: DataFrame, keys: list[str], columns: list[str], levels: list[int]) -> DataFrame:
    """For each key, column and level: values below the level and their share."""
    long = df.unpivot(keys, columns, "name", "value")
    grid = F.explode(F.array(*[F.lit(v) for v in levels]))
    return long.withColumn("level", grid).groupBy(*keys, "name", "level").agg(F.count("value").alias("n"), F.count_if(C("value") < C("level")).alias("fails")).withColumn("rate", fn.div("fails", "n"))


def quantile_cut(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows above the first quartile of both measures."""
    cut = df.agg(F.percentile(a, 0.25).alias("qa"), F.percentile(b, 0.25).alias("qb"))
    return df.crossJoin(F.broadcast(cut)).filter((C(a) > C("qa")) & (C(b) > C("qb"))).drop("qa", "qb")


def top_holdings(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n members by weight as a comma list."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("weight"), "member"))).filter(C("place") <= n)
    return ranked.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x["member"].cast("string")), ",").alias("members"))


def order_quantities(df: DataFrame) -> DataFrame:
    made = df.groupBy("id").agg(F.sum("qty").alias("qty"))
    return ranks.row_numbers(made, -C("qty").cast("double"), ["id"])
