"""All registered queries of the market-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.steps import with_steps
from ..operators import features, signals
from . import sqltext as q
from . import (  # noqa: F401  these modules fill the tables below
    base_queries,
    feature_queries,
    indicator_queries,
    misc_queries,
    result_queries,
    search_queries,
    series_queries,
    signal_queries,
    trade_queries,
    whatif_queries,
)
from .build import ORACLES, QUERIES, S, bars, register


def flagship(spark, sf_dir: str):
    """Hourly bars, a moving-average crossing as the signal, and the share of its bars with a higher high within three bars, by day."""
    made = with_steps(
        bars(spark, sf_dir),
        [lambda: {"m5": S.ma("close", 5), "m10": S.ma("close", 10)}, *signal_steps(), *features.forward_returns()],
    )
    return (
        made.filter("buy")
        .groupBy(F.to_date("ts").cast("string").alias("day"))
        .agg(F.count("*").alias("signals"), *[F.round(F.avg((F.coalesce(f"fwd_high{d}", F.lit(0.0)) > 0).cast("double")) + 1e-9, 6).alias(f"success{d}") for d in (1, 2, 3)])
    )


def signal_steps():
    return [lambda: {"buy": S.cross("m5", "m10", "touch") & ~signals.vs_mean("close", [5])["close_under_mean5"]}]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


_FWD = ", ".join(f"(max(high) over (partition by code order by ts rows between 1 following and {d} following) - close) / nullif(close, 0) * 100 as f{d}" for d in (1, 2, 3))
register(
    "crossing_success_by_day",
    flagship,
    q.base()
    + f", m as (select *, {q.ma('close', 5)} as m5, {q.ma('close', 10)} as m10, {_FWD} from b), s as (select *, coalesce(m5 >= m10 and {q.ref('m5')} < {q.ref('m10')}, false) and not coalesce(close <= m5 + 1e-6, false) as buy from m) "
    + "select ts::date::varchar as day, count(*) as signals, "
    + ", ".join(f"round(avg((coalesce(f{d}, 0) > 0)::int) + 1e-9, 6) as success{d}" for d in (1, 2, 3))
    + " from s where buy group by 1",
)
