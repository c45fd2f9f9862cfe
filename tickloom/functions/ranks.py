"""Running sums and row numbers over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is cut into.
PARTS = 64


def running(df: DataFrame, key: Column, ties: list, sums: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """df with a running sum for each of ``sums`` (the row included) in ascending order of a number ``key``, then of ``ties``.

    Quantiles of the key cut the rows into ranges; each range has its own window, and what lies before a
    range comes from the ranges' totals (``parts`` rows). Rows of one key value share a range. NULL keys
    come first.
    """
    cuts = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c < key)), F.lit(-1)) if cuts else F.lit(0)
    keyed = df.withColumns({"_range": F.when(key.isNull(), -1).otherwise(bucket)} | {f"_of_{n}": x for n, x in sums.items()})
    totals = keyed.groupBy("_range").agg(*[F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    w = Window.partitionBy("_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    made = keyed.join(F.broadcast(before), "_range").withColumns({n: F.sum(f"_of_{n}").over(w) + F.col(f"_before_{n}") for n in sums})
    return made.drop("_range", *[f"_of_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def row_numbers(df: DataFrame, key: Column, ties: list, name: str = "place", parts: int = PARTS) -> DataFrame:
    """df numbered from 1 in ascending order of a number ``key``, then of ``ties``."""
    return running(df, key, ties, {name: F.lit(1)}, parts)
