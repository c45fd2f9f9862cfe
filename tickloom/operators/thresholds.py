"""Prices at which a signal flips: the nearest close, in steps of a cent, at which a rule says the opposite.

A rule is stated on a ``WhatIf``, whose functions split a window or a recursive series into what lies
before the bar (columns, computed once for all bars) and the bar itself. A candidate price then costs a
few operations whatever the window's length, and no bar is ever copied or recomputed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.series import Series

C = F.col
S = Series()
STEP = 0.01
#: Halvings of a range of steps; enough for 16 million steps.
HALVINGS = 24


@dataclass(frozen=True)
class Candidate:
    """A bar as it would be at some close: high and low give way to it."""

    close: Column
    high: Column
    low: Column
    chg: Column
    amplitude: Column

    @staticmethod
    def at(price: Column) -> Candidate:
        high, low = F.greatest("high", price), F.least("low", price)
        return Candidate(price, high, low, (price - C("prev_close")) / C("prev_close") * 100, (high - low) / C("prev_close") * 100)


Value = Callable[[Candidate], Column]


class WhatIf:
    """Series functions of a bar at a candidate price; NULL where the window isn't full, as in ``Series``."""

    def __init__(self):
        self.columns: dict[str, Column] = {}
        self.folds: dict[str, folds.Fold] = {}

    def _kept(self, name: str, column: Column) -> Column:
        self.columns[name] = column
        return C(name)

    def _head(self, name: str, n: int, x: str, how) -> Column:
        w = S.w.rowsBetween(1 - n, -1)
        return self._kept(f"_{name}_{x}_{n}", F.when(F.count(x).over(w) == n - 1, how(x).over(w)))

    def mean(self, n: int, x: str = "close") -> Value:
        before = self._head("sum", n, x, F.sum)
        return lambda c: (before + getattr(c, x)) / n

    def highest(self, n: int, x: str = "high") -> Value:
        before = self._head("max", n, x, F.max)
        return lambda c: F.when(before.isNotNull(), F.greatest(before, getattr(c, x)))

    def lowest(self, n: int, x: str = "low") -> Value:
        before = self._head("min", n, x, F.min)
        return lambda c: F.when(before.isNotNull(), F.least(before, getattr(c, x)))

    def earlier(self, x: str, k: int = 1) -> Value:
        """A column of the bars as it was k bars ago; the candidate doesn't touch it."""
        held = self._kept(f"_ref_{x}_{k}", F.lag(x, k).over(S.w))
        return lambda c: held

    def ema(self, n: int) -> Value:
        """The exponential mean of the close; its value before the bar is the fold's last one."""
        name = f"_ema_{n}"
        self.folds[name] = folds.ema("close", n)
        before = self._kept(f"{name}_before", F.lag(name).over(S.w))
        return lambda c: F.coalesce(before + (c.close - before) * (2 / (n + 1)), c.close)

    def prepared(self, bars: DataFrame) -> DataFrame:
        made = folds.fold(bars, self.folds) if self.folds else bars
        return made.withColumns(self.columns) if self.columns else made


def price_thresholds(bars: DataFrame, rule: Callable[[WhatIf], Value], monotone: bool, wanted: Column | None = None, step: float = STEP) -> DataFrame:
    """(code, ts, close, now, threshold_up, threshold_down) of each code's last bar, or of the bars ``wanted``.

    bars have prev_close and limit_rate. Steps go from the close up and down while the price is positive and
    its change against the bar before is within limit_rate %. ``monotone`` says that the rule flips at most
    once each way; then the steps are halved, else all are tried. NULL: no flip, or no bar before.
    ``wanted`` may use ``now``, the rule's value at the bar's own close.
    """
    what_if = WhatIf()
    value = rule(what_if)
    holds = lambda price: F.coalesce(value(Candidate.at(price)), F.lit(False))
    rows = what_if.prepared(bars).withColumn("now", holds(C("close")))
    last = F.row_number().over(S.w.orderBy(F.desc("ts"))) == 1
    rows = rows.withColumn("_wanted", last if wanted is None else wanted).filter("_wanted")
    limit = C("prev_close") * C("limit_rate") / 100
    inside = F.abs(C("close") - C("prev_close")) <= limit + 1e-9
    up = F.floor((C("prev_close") + limit - C("close")) / step + 1e-6)
    down = F.least(F.floor((C("close") - C("prev_close") + limit) / step + 1e-6), F.ceil(C("close") / step - 1e-6) - 1)

    def first_flip(sign: int, most: Column) -> Column:
        price = lambda k: F.round(C("close") + k * (sign * step), 6)
        flips = lambda k: holds(price(k)) != C("now")
        if not monotone:
            k = F.get(F.filter(F.sequence(F.lit(1).cast("long"), most), flips), 0)
        else:
            span = F.struct(F.lit(0).cast("long").alias("same"), most.alias("other"))

            def halve(held: Column, _: Column) -> Column:
                middle = F.floor((held["same"] + held["other"]) / 2)
                turned = flips(middle)
                done = held["other"] - held["same"] <= 1
                return F.struct(F.when(done | turned, held["same"]).otherwise(middle).alias("same"), F.when(~done & turned, middle).otherwise(held["other"]).alias("other"))

            k = F.when(flips(most), F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), span, halve)["other"])
        return F.when(inside & (most > 0), price(k))

    return rows.select("code", "ts", "close", "now", first_flip(1, up).alias("threshold_up"), first_flip(-1, down).alias("threshold_down"))
