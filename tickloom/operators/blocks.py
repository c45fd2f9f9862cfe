"""Correlations of all pairs of codes by tiles: series as vectors in blocks of codes, moments by matrix products.

Dates get numbers; a code's returns are one sparse vector (place, value). Codes are cut into blocks by hash.
Each two blocks meet in one task, which lays both out as matrices over their common dates and gets the sums of
every pair's common days from a few products, so no row of (pair, date) ever exists. Memory of a task is two
blocks of series, whatever the number of codes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col
#: Codes of a block on average.
CODES = 256
#: Days whose products are taken at a time.
DAYS = 4096


def packed(rets: DataFrame, codes: int) -> DataFrame:
    """(block, code, day, ret): one row a code, its days as numbers in order and their returns. A code has one return a day."""
    number = C("date").cast("int") if dict(rets.dtypes)["date"] in ("int", "bigint") else F.unix_date(C("date").cast("date"))
    series = rets.select(C("code").cast("string").alias("code"), number.alias("day"), C("ret").cast("double").alias("ret"))
    whole = series.filter("ret is not null").groupBy("code").agg(F.array_sort(F.collect_list(F.struct("day", "ret"))).alias("s"))
    blocks = max(1, -(-whole.count() // codes))
    return whole.select(F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int").alias("block"), "code", C("s.day").alias("day"), C("s.ret").alias("ret"))


def meetings(series: DataFrame) -> DataFrame:
    """Each series once for every pair of blocks that its block is in: (x, y, side, block, code, day, ret)."""
    blocks = series.select("block").distinct()
    other = blocks.agg(F.sort_array(F.collect_list("block")).alias("others"))  # a number for CODES codes
    met = series.join(F.broadcast(other)).withColumn("other", F.explode("others")).drop("others")
    return met.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other"), "side": (C("block") > C("other")).cast("int")}).drop("other")


def _laid_out(group: pa.Table, rows: np.ndarray, days: np.ndarray) -> np.ndarray:
    """(codes, days) of a group's rows, NaN where a code has no return."""
    out = np.full((len(rows), len(days)), np.nan)
    for k, r in enumerate(rows.tolist()):
        own = group.column("day")[r].values.to_numpy()
        at = np.minimum(np.searchsorted(days, own), len(days) - 1)
        there = days[at] == own
        out[k, at[there]] = group.column("ret")[r].values.to_numpy()[there]
    return out


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    side = group.column("side").to_numpy()
    order = np.argsort(group.column("code").to_numpy(zero_copy_only=False), kind="stable")
    left, right = order[side[order] == 0], order[side[order] == 1]
    within = not len(right)
    days = np.unique(group.column("day").combine_chunks().flatten().to_numpy())
    return left, left if within else right, days, within


def _pairs(codes: np.ndarray, left: np.ndarray, right: np.ndarray, keep: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.triu(keep, 1) if within else keep)
    a, b = codes[left[i]], codes[right[j]]
    swap = a > b
    return i, j, np.where(swap, b, a), np.where(swap, a, b)


def pairwise_corr(rets: DataFrame, least: float | None = None, codes: int = CODES) -> DataFrame:
    """(a, b, corr, n) of each pair a < b with common dates; NULL if one is constant on them. With ``least`` only pairs above it leave a tile."""

    def run(group: pa.Table) -> pa.Table:
        left, right, days, within = _sides(group)
        names = group.column("code").to_numpy(zero_copy_only=False)
        shape = (len(left), len(right))
        n, sx, sy, sxx, syy, sxy = (np.zeros(shape) for _ in range(6))
        low_x, high_x, low_y, high_y = np.full(shape, np.inf), np.full(shape, -np.inf), np.full(shape, np.inf), np.full(shape, -np.inf)
        for k in range(0, len(days), DAYS):
            x = _laid_out(group, left, days[k : k + DAYS])
            y = x if within else _laid_out(group, right, days[k : k + DAYS])
            mx, my = ~np.isnan(x), ~np.isnan(y)
            fx, fy, wx, wy = np.where(mx, x, 0), np.where(my, y, 0), mx.astype(float), my.astype(float)
            n += wx @ wy.T
            sx += fx @ wy.T
            sy += wx @ fy.T
            sxx += (fx * fx) @ wy.T
            syy += wx @ (fy * fy).T
            sxy += fx @ fy.T
            # a series that is constant on the common days has no correlation: its extremes are equal there
            for r in range(shape[0]):
                both = my & mx[r]
                low_x[r] = np.minimum(low_x[r], np.where(both, x[r], np.inf).min(1))
                high_x[r] = np.maximum(high_x[r], np.where(both, x[r], -np.inf).max(1))
                low_y[r] = np.minimum(low_y[r], np.where(both, y, np.inf).min(1))
                high_y[r] = np.maximum(high_y[r], np.where(both, y, -np.inf).max(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
            corr = np.where((low_x < high_x) & (low_y < high_y), cov / np.sqrt(np.maximum(vx * vy, 0)), np.nan)
        keep = (n > 0) if least is None else (n > 0) & (corr > least)
        i, j, a, b = _pairs(names, left, right, keep, within)
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "corr": pa.array(corr[i, j], mask=~np.isfinite(corr[i, j])), "n": n[i, j].round().astype(np.int64)})

    return meetings(packed(rets, codes)).groupBy("x", "y").applyInArrow(run, "a string, b string, corr double, n long")


def downside_corr(rets: DataFrame, share: float = 0.05, least: int = 5, above: float | None = None, codes: int = CODES) -> DataFrame:
    """(a, b, downside, n): correlation of each pair on the worst days of their mean return, 0.5 where there is none. With ``above`` only pairs above it leave a tile."""

    def run(group: pa.Table) -> pa.Table:
        left, right, days, within = _sides(group)
        names = group.column("code").to_numpy(zero_copy_only=False)
        x = _laid_out(group, left, days)
        y = x if within else _laid_out(group, right, days)
        corr, count = np.full((len(left), len(right)), np.nan), np.zeros((len(left), len(right)), np.int64)
        for r in range(len(left)):
            for c in range(r + 1 if within else 0, len(right)):
                both = np.flatnonzero(~np.isnan(x[r]) & ~np.isnan(y[c]))
                if not len(both):
                    continue
                u, v = x[r, both], y[c, both]
                take = min(len(both), max(int(np.floor(len(both) * share)), least))
                worst = np.argsort((u + v) / 2, kind="stable")[:take]  # days are in order, so ties go to the earlier one
                u, v = u[worst], v[worst]
                flat = u.min() == u.max() or v.min() == v.max()
                du, dv = u - u.mean(), v - v.mean()
                corr[r, c], count[r, c] = 0.5 if flat else (du * dv).sum() / np.sqrt((du * du).sum() * (dv * dv).sum()), take
        keep = count > 0
        if above is not None:
            keep &= corr > above
        i, j, a, b = _pairs(names, left, right, keep, within)
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "downside": corr[i, j], "n": count[i, j]})

    return meetings(packed(rets, codes)).groupBy("x", "y").applyInArrow(run, "a string, b string, downside double, n long")
