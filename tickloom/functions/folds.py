"""Recursive series: values that depend on their own last value.

``fold`` runs any number of them in one pass, also folds of folds. Rows are dealt by key, sorted by (key, order) inside each
partition and streamed in Arrow batches; only the running state of the current key is held, so a long
key needs no more memory than a short one. A step takes its inputs (None for NULL) and gives a value;
``make`` gives a fresh step for each key.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Fold:
    """One recursive column: its inputs, a maker of its step, and its type."""

    inputs: tuple[str, ...]
    make: Callable[[], Callable]
    kind: str = "double"


def fold(df: DataFrame, folds: dict[str, Fold], key: str = "code", order: str = "ts") -> DataFrame:
    """df with a column for each fold, all in one pass over one shuffle; a fold may take those before it as inputs.

    Ties in the order are broken by the folds' inputs only if ``order`` is unique per key.
    """
    needed = [c for c in dict.fromkeys(c for f in folds.values() for c in f.inputs) if c in df.columns]
    kinds = {"double": T.DoubleType(), "boolean": T.BooleanType(), "long": T.LongType()}
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kinds[f.kind]) for name, f in folds.items()]])
    arrow = {"double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, steps = object(), {}
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            if not keys:
                continue
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            values = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in needed}
            for name, f in folds.items():
                inputs, out = [values[c] for c in f.inputs], []
                for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                    if k or keys[0] != now:
                        steps[name] = f.make()
                    out.extend(map(steps[name], *[x[a:b] for x in inputs]))
                values[name] = out
            now = keys[-1]
            added = [pa.array(values[name], arrow[f.kind]) for name, f in folds.items()]
            yield pa.record_batch([*batch.columns, *added], names=[*batch.schema.names, *folds])

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


# -- steps -------------------------------------------------------------------------------------


def of(formula: Callable, *inputs: str) -> Fold:
    """A formula of the row's own values, for use between folds of one pass; NULL if a value is missing or a divisor is 0."""

    def step(*values):
        if None in values:
            return None
        try:
            return formula(*values)
        except ZeroDivisionError:
            return None

    return Fold(inputs, lambda: step)


def smooth(alpha: float):
    """Exponential mean that starts at the first value and keeps its value over NULLs."""

    def make():
        last = None

        def step(x):
            nonlocal last
            if x is not None:
                last = x if last is None else last + alpha * (x - last)
            return last

        return step

    return make


def ema(x: str, n: int) -> Fold:
    return Fold((x,), smooth(2 / (n + 1)))


def last_ema(n: int):
    """A grouped aggregate of (value, order): the exponential mean after the last row of a group. A group is held by one task."""

    @F.pandas_udf("double")
    def run(x: pd.Series, at: pd.Series) -> float:
        known = x.iloc[np.argsort(at.to_numpy(), kind="stable")].dropna().to_numpy(float)
        if not len(known):
            return None
        alpha = 2 / (n + 1)
        weights = alpha * (1 - alpha) ** np.arange(len(known) - 1, -1, -1.0)
        weights[0] /= alpha  # the series starts at its first value
        return float(weights @ known)

    return run


def sma_cn(x: str, n: int, m: int = 1) -> Fold:
    return Fold((x,), smooth(m / n))


def sma_cn_seeded(x: str, n: int, m: int = 1) -> Fold:
    """The mean of the first n values, then m/n of each new one."""

    def make():
        seen, last = [], None

        def step(v):
            nonlocal last
            if v is None:
                return None
            if last is None:
                seen.append(v)
                if len(seen) == n:
                    last = sum(seen) / n
                return last
            last = (m * v + (n - m) * last) / n
            return last

        return step

    return Fold((x,), make)


def dma(x: str, a: str) -> Fold:
    """Smoothing by a factor series; a missing factor counts as 1."""

    def make():
        last = None

        def step(v, f):
            nonlocal last
            f = 1.0 if f is None else f
            if v is not None:
                last = v if last is None else f * v + (1 - f) * last
            return last

        return step

    return Fold((x, a), make)


def filtered(c: str, n: int) -> Fold:
    """After a true, the next n bars are false."""

    def make():
        quiet = 0

        def step(v):
            nonlocal quiet
            if quiet:
                quiet -= 1
                return False
            if v:
                quiet = n
                return True
            return False

        return step

    return Fold((c,), make, "boolean")


def run_of_lower(x: str, sign: int = 1) -> Fold:
    """Bars just before that are all lower (sign -1: higher); 0 if no earlier bar stops the run."""

    def make():
        stack: list[tuple[int, float]] = []
        i = -1

        def step(v):
            nonlocal i
            i += 1
            while stack and stack[-1][1] < sign * v:
                stack.pop()
            out = i - 1 - stack[-1][0] if stack else 0
            stack.append((i, sign * v))
            return out

        return step

    return Fold((x,), make, "long")


def ema_seeded(x: str, n: int, skip: int = 0) -> Fold:
    """The mean of n values after the first ``skip``, then 2/(n+1) of each new one."""

    def make():
        seen, last, i = [], None, 0

        def step(v):
            nonlocal last, i
            if v is None:
                return None
            i += 1
            if i <= skip:
                return None
            if last is None:
                seen.append(v)
                if len(seen) == n:
                    last = sum(seen) / n
                return last
            last = last + 2 / (n + 1) * (v - last)
            return last

        return step

    return Fold((x,), make)


def wilder(x: str, n: int) -> Fold:
    """The mean of the first n values, then (last * (n-1) + value) / n."""

    def make():
        seen, last = [], None

        def step(v):
            nonlocal last
            if v is None:
                return None
            if last is None:
                seen.append(v)
                if len(seen) == n:
                    last = sum(seen) / n
                return last
            last = (last * (n - 1) + v) / n
            return last

        return step

    return Fold((x,), make)


def sar(high: str = "high", low: str = "low", start: float = 0.02, most: float = 0.2) -> Fold:
    """Stop and reverse: the stop follows the extreme point by a growing factor and turns when touched."""

    def make():
        bars: deque = deque(maxlen=2)
        rising, stop, extreme, factor = None, 0.0, 0.0, start

        def step(h, l):
            nonlocal rising, stop, extreme, factor
            bars.append((h, l))
            if len(bars) < 2:
                return None
            (ph, pl), (h, l) = bars
            if rising is None:
                rising = not (pl - l > 0 and pl - l > h - ph)
                stop, extreme = (pl, h) if rising else (ph, l)
            if rising and l <= stop or not rising and h >= stop:
                rising = not rising
                out = max(extreme, ph, h) if not rising else min(extreme, pl, l)
                extreme, factor = (h, start) if rising else (l, start)
                stop = out + factor * (extreme - out)
                stop = min(stop, pl, l) if rising else max(stop, ph, h)
                return out
            out = stop
            if rising and h > extreme or not rising and l < extreme:
                extreme, factor = (h if rising else l), min(factor + start, most)
            stop = stop + factor * (extreme - stop)
            stop = min(stop, pl, l) if rising else max(stop, ph, h)
            return out

        return step

    return Fold((high, low), make)


def ceil_cent(x: float) -> float:
    return math.ceil(round(x * 100, 7)) / 100
