"""Boolean signals: templates over a column and its parameters, and the catalogues made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import series as fn
from ..functions.series import Series

C = F.col
S = Series()
EPSILON = 1e-6


def fixed_bands(key: str, values: list[float]) -> dict[str, Column]:
    """Below the first value, between neighbours (the lower one included), above the last."""
    v = sorted(values)
    out = {f"{key}_under_{v[0]}": C(key) < v[0]}
    out |= {f"{key}_{a}_to_{b}": (C(key) >= a) & (C(key) < b) for a, b in zip(v, v[1:], strict=False)}
    return {k: fn.sig(c) for k, c in (out | {f"{key}_over_{v[-1]}": C(key) > v[-1]}).items()}


def vs_mean(key: str, ns: list[int]) -> dict[str, Column]:
    return {f"{key}_{name}_mean{n}": fn.sig(c) for n in ns for name, c in (("over", C(key) >= S.ma(key, n) - EPSILON), ("under", C(key) <= S.ma(key, n) + EPSILON))}


def vs_yesterday(keys: list[str]) -> dict[str, Column]:
    return {f"{a}_over_last_{b}": fn.sig(C(a) >= S.ref(b)) for a in keys for b in keys if a != b}


def vs_today(keys: list[str]) -> dict[str, Column]:
    return {f"{a}_over_{b}": fn.sig(C(a) >= C(b)) for a in keys for b in keys if a != b}


def cross_up(keys: list[str], others: list[str]) -> dict[str, Column]:
    return {f"{a}_cross_{b}": S.cross(a, b, "touch") for a in keys for b in others if a != b}


def extreme(key: str, ns: list[int]) -> dict[str, Column]:
    return {f"{key}_{name}{n}": fn.sig(C(key) == c) for n in ns for name, c in (("max", S.hhv(key, n)), ("min", S.llv(key, n)))}


def yesterday(names: list[str]) -> dict[str, Column]:
    return {f"last_{n}": fn.sig(S.ref(n)) for n in names}


#: Families of the basic catalogue: each a call of templates over its columns.
CATALOGUE = {
    "close": lambda: vs_mean("close", [5, 10, 20, 40]) | extreme("close", [5, 10, 20, 60]),
    "turnover": lambda: fixed_bands("turnover", [0.5, 1, 2]) | vs_mean("turnover", [5, 10]) | extreme("turnover", [5, 20]),
    "body": lambda: fixed_bands("body", [-50, 0, 50]) | extreme("body", [5, 20]),
    "listing": lambda: {"limit_down": fn.sig(C("chg") < -0.95 * C("limit_rate")), "new": C("rn") <= 101},
    "open": lambda: vs_mean("open", [5, 10, 20]) | extreme("open", [5, 20]),
    "high": lambda: vs_mean("high", [5, 10, 20]) | extreme("high", [5, 20]),
    "low": lambda: vs_mean("low", [5, 10, 20]) | extreme("low", [5, 20]),
    "chg": lambda: fixed_bands("chg", [-5, -1, 0, 1, 5]) | vs_mean("chg", [5, 10]) | extreme("chg", [5, 20]),
    "amplitude": lambda: fixed_bands("amplitude", [5, 10, 50]) | vs_mean("amplitude", [5, 10]) | extreme("amplitude", [5, 20]),
    "price_last": lambda: vs_yesterday(["open", "close", "high", "low"]),
    "price_today": lambda: vs_today(["open", "close"]),
    "amount": lambda: vs_mean("amount", [5, 10]) | {"amount_doubled": fn.sig(C("amount") >= 2 * S.ref("amount")), "amount_halved": fn.sig(C("amount") <= 0.5 * S.ref("amount"))},
}


def catalogue(df: DataFrame, families: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """df with the signals of these families, all in one projection, and their names."""
    df = df.withColumn("body", C("close") - C("open"))
    made = reduce(lambda a, b: a | b, (CATALOGUE[f]() for f in families or CATALOGUE))
    return df.withColumns(made), list(made)


def all_of(names: list[str]) -> Column:
    """AND of named signals and the limit band."""
    room = C("limit_rate") - fn.div(F.lit(1.0), "close")
    return reduce(lambda a, b: a & b, (C(n) for n in names)) & fn.sig(C("chg").between(-room, room))


def active_on(df: DataFrame, names: list[str], date: str) -> DataFrame:
    """(code, ts, signal) of the signals that hold on a date."""
    day = df.filter(C("ts").cast("date") == F.lit(date).cast("date"))
    held = F.filter(F.array(*[F.when(C(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return day.select("code", "ts", F.explode(held).alias("signal"))


def sort_by_least(scores: DataFrame) -> DataFrame:
    """(code, least score, rank): the lowest ratio of each code, ascending."""
    return ranks.row_numbers(scores.groupBy("code").agg(F.min("score").alias("least")), C("least").cast("double"), ["code"])


def keep_columns(df: DataFrame, names: list[str], signals: str = "signal") -> DataFrame:
    """The listed columns that df has, and all whose name holds the word for signals."""
    return df.select(*[C(f"`{c}`") for c in df.columns if c in names or signals in c])


def on_date(date: str) -> Column:
    """True on one date."""
    return fn.sig(C("ts").cast("date") == F.lit(date).cast("date"))


def same_signals(df: DataFrame, names: list[str], target: DataFrame) -> DataFrame:
    """df with ``buy``: the row has all the signals that hold in the one row of ``target`` (which has the same signals)."""
    active = F.array_compact(F.array(*[F.when(C(n), F.lit(n)) for n in names]))
    wanted = target.select(active.alias("_wanted")).limit(1)
    return df.crossJoin(F.broadcast(wanted)).withColumn("buy", F.size(F.array_except("_wanted", active)) == 0).drop("_wanted")
