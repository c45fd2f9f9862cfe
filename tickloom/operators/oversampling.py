"""Balancing classes by new rows of the smaller one, each between a row and one of its near neighbours.

Neighbours are sought by locality: the rows of the smaller class are put in the order of a random projection
and cut into blocks of BLOCK rows, several projections apart; within a block the nearest are exact, and the
best of all projections count. A class of up to BLOCK rows is one block, so its neighbours are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks

C = F.col
BLOCK = 2048
PROJECTIONS = 3


def _nearest(k: int):
    """Kernel over a block (num, x): (num, distance, near, other) of the k nearest other rows of each."""

    def run(group: pa.Table) -> pa.Table:
        num, n = group.column("num").to_numpy(), group.num_rows
        x = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        square = (x * x).sum(1)
        apart = np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0)
        np.fill_diagonal(apart, np.inf)
        most = min(k, n - 1)
        best = np.argpartition(apart, most - 1, axis=1)[:, :most] if most else np.empty((n, 0), int)
        at = np.repeat(np.arange(n), most)
        flat = best.ravel()
        exact = ((x[at] - x[flat]) ** 2).sum(1)
        return pa.table({"num": num[at], "distance": exact, "near": num[flat], "other": pa.array(list(x[flat]), pa.list_(pa.float64()))})

    return run


def neighbours(rows: DataFrame, width: int, k: int = 5, block: int = BLOCK, projections: int = PROJECTIONS, seed: int = 7) -> DataFrame:
    """(num, near): of rows (num, x: array of ``width`` numbers) the k nearest others, nearest first, as an array of (distance, near, other)."""
    draw = np.random.default_rng(seed)
    found = None
    for _ in range(projections if rows.limit(block + 1).count() > block else 1):
        line = F.array(*[F.lit(float(v)) for v in draw.standard_normal(width)])
        on_line = F.aggregate(F.zip_with("x", line, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        placed = ranks.row_numbers(rows.withColumn("_on_line", on_line), C("_on_line"), ["num"], "_place").withColumn("_block", F.floor((C("_place") - 1) / block))
        made = placed.select("_block", "num", "x").groupBy("_block").applyInArrow(_nearest(k), "num long, distance double, near long, other array<double>")
        found = made if found is None else found.unionByName(made)
    best = F.slice(F.array_sort(F.collect_set(F.struct("distance", "near", "other"))), 1, k)
    return found.groupBy("num").agg(best.alias("near"))


def oversample(df: DataFrame, keys: list[str], k: int = 5, block: int = BLOCK, projections: int = PROJECTIONS, seed: int = 7) -> DataFrame:
    """(keys, label, features, made): df with as many new rows of the smaller class (of two) as it lacks.

    A new row has the keys of its base, which takes turns, and lies at a hash of (base, turn) between it and one
    of its k nearest neighbours. A class of one row is repeated; without a row of one class nothing is made.
    """
    rows = df.select(*keys, "label", vector_to_array("features").alias("x"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    whole = rows.withColumn("made", F.lit(False))
    if len(counts) == 2 and min(counts.values()) < max(counts.values()):
        few = min(counts, key=counts.get)
        have, lack = counts[few], max(counts.values()) - counts[few]
        own = ranks.row_numbers(rows.filter(C("label") == few), F.xxhash64(*keys, "x").cast("double"), [*keys, "x"], "num").withColumn("num", C("num").cast("long"))
        width = len(rows.first()["x"])
        near = neighbours(own.select("num", "x"), width, k, block, projections, seed)
        turns = F.lit(lack // have) + (C("num") <= lack % have).cast("int")
        each = own.join(near, "num", "left").withColumn("turns", turns).filter("turns > 0").withColumn("turn", F.explode(F.sequence(F.lit(1), C("turns"))))
        pick = F.pmod(F.xxhash64("num", "turn", F.lit(seed)), F.greatest(F.size("near"), F.lit(1))).cast("int")
        share = F.pmod(F.xxhash64("turn", "num", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
        between = F.zip_with("x", F.coalesce(F.get("near", pick)["other"], C("x")), lambda a, b: a + (b - a) * C("share"))
        whole = whole.unionByName(each.withColumn("share", share).select(*keys, "label", between.alias("x"), F.lit(True).alias("made")))
    return whole.select(*keys, "label", array_to_vector("x").alias("features"), "made")
