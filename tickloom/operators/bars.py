"""Building and reshaping bars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as fn
from ..functions.segments import by_series, later_high
from ..functions.series import Series

C = F.col
S = Series()


def running_day_bar(df: DataFrame) -> DataFrame:
    """Within each day so far: day_open, day_high, day_low, day_volume, day_amount."""
    w = Window.partitionBy("code", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"day_open": F.first("open").over(w), "day_high": F.max("high").over(w), "day_low": F.min("low").over(w), "day_volume": F.sum("volume").over(w), "day_amount": F.sum("amount").over(w)})


def rest_of_day_extrema(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("code", F.to_date("ts")).orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({"rest_high": F.max("high").over(w), "rest_low": F.min("low").over(w)})


def resample(df: DataFrame, unit: str) -> DataFrame:
    """Bars of a longer unit (day, week, month)."""
    return df.groupBy("code", F.date_trunc(unit, "ts").alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )


def what_if_bar(df: DataFrame, moves: list[float]) -> DataFrame:
    """The last bar of each series with its close moved by each %, and high, low, change and amplitude to match."""
    last = df.withColumn("back", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("ts")))).filter("back = 1")
    moved = last.withColumn("move", F.explode(F.array(*[F.lit(float(m)) for m in moves]))).withColumn("close", C("close") * (1 + C("move") / 100))
    moved = moved.withColumns({"high": F.greatest("high", "close"), "low": F.least("low", "close")})
    return moved.withColumns({"chg": fn.div(C("close") - C("prev_close"), "prev_close") * 100, "amplitude": fn.div(C("high") - C("low"), "prev_close") * 100}).drop("back")


def index_join_wide(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Two series side by side by ts."""
    cols = ("open", "high", "low", "close", "amount")
    return a.select("ts", *[C(c).alias(f"{left}_{c}") for c in cols]).join(b.select("ts", *[C(c).alias(f"{right}_{c}") for c in cols]), "ts")


def market_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("ts").agg(F.avg("close").alias("mean_close"), F.count("*").alias("n"))


def relative_return(df: DataFrame) -> DataFrame:
    return df.withColumn("relative", fn.div("close", F.first("close").over(S.w)) - 1)


def adj_nav(rets: DataFrame, first: float = 1.0) -> DataFrame:
    """Running product of 1 + return."""
    w = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rets.withColumn("nav", F.product(1 + C("ret")).over(w) * first)


def days_until_higher(df: DataFrame) -> DataFrame:
    """Bars until a later high is above today's close; the length of the series if none is."""

    def kernel(values: dict, bounds: np.ndarray, rows) -> dict:
        found, sold = later_high(values["high"], values["close"], bounds)
        return {"until_higher": np.where(sold, found - np.arange(len(found)), np.repeat(np.diff(bounds), np.diff(bounds)))}

    return by_series(df, ["high", "close"], kernel, {"until_higher": "long"})
