"""Market tables derived from the star schema: bars, ticks, notices, fund returns, money flow, votes, universe.

Bars have (code, ts, open, high, low, close, volume, amount); ``quoted`` adds what a quote table has.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import quotient


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(rows: DataFrame, code, ts, price: str, by: str, digits: int) -> DataFrame:
    return rows.groupBy(code.alias("code"), ts.alias("ts")).agg(
        F.min_by(price, by).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, by).alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.round(F.sum(price), digits).alias("amount"),
    )


def bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(table(spark, sf_dir, "events"), F.col("event_type"), F.date_trunc("hour", "ts"), "value", "ts", 4)


def bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderdate").cast("date"), "o_totalprice", "o_orderkey", 2)


def bars_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(table(spark, sf_dir, "events"), F.col("user_id"), F.col("ts").cast("date"), "value", "ts", 4)


def quoted(bars: DataFrame) -> DataFrame:
    """Previous close, change %, amplitude %, turnover and daily limit of bars."""
    w = Window.partitionBy("code").orderBy("ts")
    last = F.lag("close").over(w)
    return bars.select(
        "*",
        last.alias("prev_close"),
        ((quotient("close", last) - 1) * 100).alias("chg"),
        (quotient(F.col("high") - F.col("low"), last) * 100).alias("amplitude"),
        (F.col("volume") / F.avg("volume").over(Window.partitionBy("code"))).alias("turnover"),
        F.lit(10.0).alias("limit_rate"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), "event_id", "ts", F.col("value").alias("price"), F.lit(1).alias("qty"))


def status_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "start").when(F.col("event_type") == "signup", "end").otherwise("other")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), "ts", "event_id", kind.alias("kind"))


def fund_ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    # as decimals: sums of doubles depend on the order of the rows, and a mean at half a unit of the sixth digit (one group in a hundred) was rounded by that
    mean = F.avg(F.col("l_discount").cast("decimal(28,18)")).cast("decimal(32,20)")
    ret = F.round((mean - F.lit(Decimal("0.05"))) * F.lit(Decimal("0.2")), 6).cast("double")
    return rows.groupBy(F.col("p_brand").alias("code"), F.col("l_shipdate").cast("date").alias("date")).agg(ret.alias("ret"))


def money_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    size = F.when(price >= 400000, "xl").when(price >= 250000, "l").when(price >= 100000, "m").otherwise("s")
    signed = F.when(F.col("o_orderstatus") == "F", price).when(F.col("o_orderstatus") == "O", -price).otherwise(0.0)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code"), F.col("o_orderdate").cast("date").alias("date"), size.alias("size")).agg(F.round(F.sum(signed), 2).alias("net"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("vote_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_custkey").alias("code"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 12).cast("string")).alias("model"),
        F.round(F.lit(0.5) + (F.col("o_orderkey") * 7919 % 500) / 1000.0, 3).alias("prob"),
        (F.col("o_orderstatus") == "F").alias("hit"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("type"), F.col("r_name").alias("region"))
    )
