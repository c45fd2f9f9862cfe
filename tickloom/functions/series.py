"""Rolling and conditional functions of a series, as window columns.

A ``Series`` names the key and the order; its methods take columns (or names) and give columns. A window
of N is NULL until it holds N non-null values. Arguments must be plain columns of the frame (a window
function cannot be nested in another), so composite formulas add their steps as columns first. Methods
that count bars need a row number column, which ``numbered`` adds as ``rn``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sig(x: Column) -> Column:
    """A comparison with NULL counts as false."""
    return F.coalesce(x, F.lit(False))


def div(a, b) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(col(a), col(b))


def quotient(a, b) -> Column:
    """Division as doubles are divided: infinity or NaN for a zero divisor, where ``/`` would end the job."""
    a, b = col(a).cast("double"), col(b).cast("double")
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(F.try_divide(a, b))


def half_even(x, digits: int) -> Column:
    """Round half to even after scaling, as numpy does."""
    return F.rint(col(x) * 10**digits) / 10**digits


def greatest(a, b) -> Column:
    """The larger of two values, NULL if either is NULL."""
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def least(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def between(x, a, b) -> Column:
    """Strictly between two values in either order."""
    x, a, b = col(x), col(a), col(b)
    return sig((x > a) & (x < b) | (x < a) & (x > b))


@dataclass(frozen=True)
class Series:
    key: str = "code"
    order: str = "ts"

    @property
    def all(self) -> WindowSpec:
        return Window.partitionBy(self.key)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.order)

    def past(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def upto(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def numbered(self, df: DataFrame) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(self.w))

    def roll(self, fn, x, n: int) -> Column:
        """fn over the last n bars, NULL before there are n values."""
        x = col(x)
        return F.when(F.count(x).over(self.past(n)) >= n, fn(x).over(self.past(n)))

    # values
    def ref(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.w)

    def diff(self, x, n: int = 1) -> Column:
        return col(x) - self.ref(x, n)

    def ret(self, x, n: int = 1) -> Column:
        """The n-th value from the end of the series."""
        backwards = Window.partitionBy(self.key).orderBy(F.desc(self.order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.nth_value(col(x), n).over(backwards)

    def const(self, x) -> Column:
        """The last value for all rows."""
        return F.last(col(x)).over(self.whole)

    # windows
    def ma(self, x, n: int) -> Column:
        return self.roll(F.avg, x, n)

    def std(self, x, n: int) -> Column:
        return self.roll(F.stddev_pop, x, n)

    def total(self, x, n: int = 0) -> Column:
        return self.roll(F.sum, x, n) if n else F.sum(col(x)).over(self.upto)

    def hhv(self, x, n: int) -> Column:
        return self.roll(F.max, x, n)

    def llv(self, x, n: int) -> Column:
        return self.roll(F.min, x, n)

    def hhvbars(self, x, n: int, rn="rn") -> Column:
        """Bars since the window's highest value, the latest of equals."""
        high = F.max(F.struct(col(x).alias("v"), col(rn).alias("rn"))).over(self.past(n))["rn"]
        return F.when(F.count(col(x)).over(self.past(n)) >= n, col(rn) - high)

    def llvbars(self, x, n: int, rn="rn") -> Column:
        low = F.max(F.struct((-col(x)).alias("v"), col(rn).alias("rn"))).over(self.past(n))["rn"]
        return F.when(F.count(col(x)).over(self.past(n)) >= n, col(rn) - low)

    def wma(self, x, n: int) -> Column:
        """Linear weights, n for the newest."""
        parts = sum((F.lag(col(x), k).over(self.w) * (n - k) for k in range(n)), F.lit(0.0))
        return parts / (n * (n + 1) / 2)

    def avedev(self, x, n: int) -> Column:
        """Mean absolute deviation from the window's mean."""
        values = F.collect_list(col(x)).over(self.past(n))
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
        spread = F.transform(F.array(mean), lambda m: F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - m)) / n)[0]
        return F.when(F.count(col(x)).over(self.past(n)) >= n, spread)

    def slope(self, x, n: int, rn="rn") -> Column:
        return F.when(F.count(col(x)).over(self.past(n)) >= n, F.regr_slope(col(x), col(rn).cast("double")).over(self.past(n)))

    def forecast(self, x, n: int, rn="rn") -> Column:
        """The rolling regression's value at the last bar."""
        line = F.regr_slope(col(x), col(rn).cast("double")).over(self.past(n)) * col(rn) + F.regr_intercept(col(x), col(rn).cast("double")).over(self.past(n))
        return F.when(F.count(col(x)).over(self.past(n)) >= n, line)

    # conditions
    def count(self, c, n: int) -> Column:
        flag = col(c).cast("int")
        return F.when(F.count(flag).over(self.past(n)) >= n, F.sum(flag).over(self.past(n))) if n else F.sum(flag).over(self.upto)

    def every(self, c, n: int) -> Column:
        return sig(self.count(c, n) == n)

    def exist(self, c, n: int) -> Column:
        return sig(self.count(c, n) > 0)

    def lasting(self, c, a: int, b: int) -> Column:
        """True for all bars from a to b bars ago."""
        frame = self.w.rowsBetween(-a, -b)
        return sig(F.sum(col(c).cast("int")).over(frame) == a - b + 1)

    def barslast(self, c, rn="rn") -> Column:
        """Bars since the condition last held; from the start of the series if it never did."""
        return col(rn) - F.coalesce(F.last(F.when(col(c), col(rn)), True).over(self.upto), F.lit(0))

    def barslastcount(self, c, rn="rn") -> Column:
        """Length of the run of trues that ends here."""
        return col(rn) - F.coalesce(F.last(F.when(~col(c), col(rn)), True).over(self.upto), F.lit(0))

    def barssincen(self, c, n: int, rn="rn") -> Column:
        """Bars since the first true among the last n, 0 if there is none or fewer bars."""
        return F.when(F.count("*").over(self.past(n)) >= n, F.coalesce(col(rn) - F.min(F.when(col(c), col(rn))).over(self.past(n)), F.lit(0))).otherwise(0)

    def valuewhen(self, c, x) -> Column:
        return F.last(F.when(col(c), col(x)), True).over(self.upto)

    def cross(self, a, b, mode: str = "rise") -> Column:
        """a crosses b. rise: not above before, above now; either: above now and not, or the reverse, within two bars;
        sign: below before and above now; touch: at or above now and below before."""
        a, b = col(a), col(b)
        pa, pb = F.lag(a).over(self.w), F.lag(b).over(self.w)
        if mode == "rise":
            return sig((a > b) & ~sig(pa > pb) & (F.row_number().over(self.w) > 1))
        if mode == "either":
            return sig(sig(a > b) != sig(pa > pb)) & (F.row_number().over(self.w) > 1)
        if mode == "sign":
            return sig((pa - pb < 0) & (a - b > 0))
        return sig((a >= b) & (pa < pb))

    def longcross(self, a, b, n: int) -> Column:
        """Below for the n bars before, above now."""
        below = F.sum((col(a) < col(b)).cast("int")).over(self.w.rowsBetween(-n, -1))
        return sig((below == n) & (col(a) > col(b)))
