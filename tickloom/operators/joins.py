"""Joins of series by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def confirm_by_longer_period(small: DataFrame, big: DataFrame, days: int = 30) -> DataFrame:
    """Keep a small-period signal only if the first big-period bar from its date to ``days`` later is a signal too.

    Both sides have (code, ts, buy). The big side's next bar is found by one window over the union of both,
    so the join needs no range condition.
    """
    both = small.select("code", "ts", "buy", F.lit(1).alias("side")).unionByName(big.select("code", "ts", "buy", F.lit(0).alias("side")))
    w = Window.partitionBy("code").orderBy("ts", F.desc("side")).rowsBetween(0, Window.unboundedFollowing)
    first = F.first(F.when(C("side") == 0, F.struct("ts", "buy")), True).over(w)
    found = both.withColumn("next", first).filter("side = 1")
    ok = F.coalesce((F.datediff(C("next.ts"), C("ts")) <= days) & C("next.buy"), F.lit(False))
    return found.select("code", "ts", (C("buy") & ok).alias("buy"))


def next_trading_day(df: DataFrame) -> DataFrame:
    """Each row with the next date of the calendar, and its code's close on that date (NULL if it did not trade)."""
    calendar = df.select("ts").distinct().withColumn("next_ts", F.lead("ts").over(Window.orderBy("ts")))
    other = df.select("code", C("ts").alias("next_ts"), C("close").alias("next_close"))
    return df.join(calendar, "ts").join(other, ["code", "next_ts"], "left")


def near_in_parameters(df: DataFrame, keys: dict[str, float], value: str, decay: float = 0.5) -> DataFrame:
    """Mean value of the rows within a band of each key, each weighted by decay per step away.

    A band join is bucketed: every row goes to its cell and its neighbours' cells along the first key, so
    it meets only rows nearby.
    """
    first, width = next(iter(keys.items()))
    cell = F.floor(C(first) / width)
    left = df.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    right = df.select(*[C(k).alias(f"o_{k}") for k in keys], C(value).alias("o_value"), cell.alias("cell"))
    near = F.lit(True)
    steps = F.lit(0.0)
    for k, band in keys.items():
        near = near & (F.abs(C(k) - C(f"o_{k}")) <= band)
        steps = steps + F.abs(C(k) - C(f"o_{k}")) / band
    pairs = left.join(right, "cell").filter(near).withColumn("weight", F.pow(F.lit(decay), steps))
    return pairs.groupBy(*keys).agg((F.sum(C("weight") * C("o_value")) / F.sum("weight")).alias("near_value"), F.count("*").alias("n"))


def upsert_latest(history: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values that are not NULL win; history fills the rest."""
    cols = [c for c in history.columns if c not in keys]
    joined = history.alias("h").join(new.alias("n"), keys, "full")
    return joined.select(*keys, *[F.coalesce(C(f"n.{c}"), C(f"h.{c}")).alias(c) for c in cols])


def append_first_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, one for each key, old before new."""
    both = old.withColumn("source", F.lit(0)).unionByName(new.withColumn("source", F.lit(1)))
    return both.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("source"))).filter("n = 1").drop("n", "source")
