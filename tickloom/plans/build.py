"""Helpers to state a query once: steps on bars in Spark, the same steps as SQL text."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from ..functions.steps import with_steps
from ..sources import views
from . import sqltext

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

S = Series()


def register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def local_folder(spark) -> str:
    """A new folder on this machine, where no shared one is set; only a local master may use it."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tickloom-")


def bars(spark, sf_dir: str, kind: str = "hour") -> DataFrame:
    return S.numbered(views.quoted(getattr(views, f"bars_{kind}")(spark, sf_dir)))


def stable(x):
    """Six digits; the nudge keeps a value at a half from being rounded two ways."""
    return F.round(x + 1e-9, 6)


def result(df: DataFrame, out: list[str], rounded: bool = True) -> DataFrame:
    cols = [stable(F.col(c)).alias(c) if rounded else F.col(c) for c in out]
    return df.select("code", F.col("ts").cast("string").alias("ts"), *cols)


def steps(name: str, spark_stages, sql_stages: list[dict[str, str]] | None, out: list[str], kind: str = "hour", rounded: bool = True) -> None:
    """Register a query of columns over bars and, if SQL stages are given, its oracle."""
    register(
        name,
        lambda spark, sf_dir: result(with_steps(bars(spark, sf_dir, kind), spark_stages), out, rounded),
        None if sql_stages is None else sqltext.staged(sql_stages, out, kind, rounded),
    )
