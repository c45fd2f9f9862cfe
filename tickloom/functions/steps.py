"""Formulas of several steps: each step is a function that gives new columns, or folds, over the columns so far."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .folds import Fold, fold


def with_steps(df: DataFrame, stages, key: str = "code", order: str = "ts") -> DataFrame:
    """Add columns stage by stage."""
    for stage in stages:
        made = stage()
        if made and all(isinstance(x, Fold) for x in made.values()):
            df = fold(df, made, key, order)
        else:
            df = df.withColumns(made)
    return df
