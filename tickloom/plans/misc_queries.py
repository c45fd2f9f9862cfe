"""Queries of sources, streams, models, sorts, sets and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.steps import with_steps
from ..operators import features as ft
from ..operators import forests as fo
from ..operators import models as ml
from ..operators import oversampling as ov
from ..sources import io, views
from ..streaming import live, upserts
from . import sqltext as q
from .build import S, bars, local_folder, register, stable
from .trade_queries import r6, s6

C = F.col
HOUR, DAY = q.base(), q.base("day")


def scratch(spark) -> str:
    """A new folder in the shared checkpoint folder, or a local one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{local_folder(spark)}"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


# -- sources -------------------------------------------------------------------------------------
register("source_last_rows", lambda spark, sf: io.last_rows(bars(spark, sf), 20).select("code", C("ts").cast("string").alias("ts"), "close"), HOUR + " select code, cast(ts as varchar) as ts, close from b qualify row_number() over (partition by code order by ts desc) <= 20")


def _codes(spark, sf):
    path = scratch(spark)
    io.write_bar_files(views.bars_day(spark, sf), path)
    return io.read_codes(spark, path, ["1-URGENT", "5-LOW"], ["code", "ts", "close"]).select("code", C("ts").cast("string").alias("ts"), "close")


register("source_parquet_round_trip", _codes, DAY + " select code, ts::varchar as ts, close from b where code in ('1-URGENT', '5-LOW')")


def _csv(spark, sf):
    path = scratch(spark)
    rows = views.bars_day(spark, sf).select(F.regexp_replace("code", "[^0-9A-Z]", "").alias("code"), C("ts").cast("string").alias("date"), "open", "high", "low", "close", "volume", "amount")
    rows.write.partitionBy("code").option("header", True).option("sep", "\t").csv(path)
    schema = "date string, open double, high double, low double, close double, volume double, amount double"
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path).select(C("date").alias("ts"), "close", "volume")


register("source_text_round_trip", _csv, DAY + " select ts::varchar as ts, close, volume from b")


def _json(spark, sf):
    path = scratch(spark)
    views.status_posts(spark, sf).select(C("code").cast("string").alias("code"), C("kind").alias("post_title"), F.lit("n").alias("notice_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("post_publish_time")).write.json(path)
    return io.read_notices(spark, path).groupBy("code", "post_title").agg(F.count("*").alias("n"), F.min("ts").cast("string").alias("first"))


register("source_notices_json", _json, q.views("status_posts") + " select code::varchar as code, kind as post_title, count(*) as n, cast(min(date_trunc('second', ts)) as varchar) as first from status_posts group by 1, 2")
register("source_downcast", lambda spark, sf: io.downcast(views.table(spark, sf, "orders").select("o_orderkey", "o_custkey")).select(C("o_orderkey").cast("long").alias("k"), C("o_custkey").cast("long").alias("c")), "select o_orderkey as k, o_custkey as c from orders")

# -- streams, replayed from files ------------------------------------------------------------------


RANGES, FILES = 3, 2


def replay(spark, sf, make):
    """Run a stream over the events to its end and give the rows it wrote."""
    path = scratch(spark)
    source = views.table(spark, sf, "events")
    # ranges of time, one after the other, each in FILES files: one micro-batch each, so state is carried from batch to batch
    at = F.unix_micros(C("ts").cast("timestamp"))
    cuts = source.agg(F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)])).first()[0] or []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = source.filter((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.repartition(FILES).write.mode("append").parquet(f"{path}/in")
    ticks = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/in").select(C("event_type").alias("code"), C("ts").cast("timestamp").alias("ts"), C("value").alias("price"), F.lit(1).alias("qty"))
    query = make(ticks).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(make(ticks).schema).parquet(f"{path}/out")


TICKS = q.views("ticks")
register(
    "stream_tumbling_bars",
    lambda spark, sf: replay(spark, sf, live.tumbling_bars).select("code", C("ts").cast("string").alias("ts"), "open", "high", "low", "close", "volume"),
    TICKS + ", l as (select max(ts) - interval 10 minute as mark from ticks) select code, cast(date_trunc('hour', t.ts) as varchar) as ts, arg_min(price, t.ts) as open, max(price) as high, min(price) as low, arg_max(price, t.ts) as close, count(*) as volume from ticks t, l group by code, date_trunc('hour', t.ts), mark having date_trunc('hour', t.ts) + interval 1 hour <= mark",
)
register(
    "stream_sliding_totals",
    lambda spark, sf: replay(spark, sf, lambda t: live.sliding_totals(t, "2 hours", "1 hour")).select("code", C("ts").cast("string").alias("ts"), "n", "total"),
    TICKS + ", w as (select code, date_trunc('hour', ts) - k * interval 1 hour as ts from ticks, (select unnest([0, 1]) as k)), l as (select max(ts) - interval 10 minute as mark from ticks) select code, cast(ts as varchar) as ts, count(*) as n, count(*) as total from w, l group by code, ts, mark having ts + interval 2 hour <= mark",
)
register("stream_first_of_each", lambda spark, sf: replay(spark, sf, live.first_of_each).groupBy("code").agg(F.count("*").alias("n")), TICKS + " select code, count(distinct ts) as n from ticks group by code")
register("stream_in_session", lambda spark, sf: replay(spark, sf, lambda t: live.in_session(t, "22:30:00", "01:15:00")).groupBy("code").agg(F.count("*").alias("n")), TICKS + " select code, count(*) as n from ticks where strftime(ts, '%H:%M:%S') >= '22:30:00' or strftime(ts, '%H:%M:%S') <= '01:15:00' group by code")
DW = "(partition by code, ts::date order by ts rows between unbounded preceding and current row)"
register("stream_running_day_bars", lambda spark, sf: replay(spark, sf, live.running_day_bars).select("code", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "open", "high", "low", "close", "volume"), TICKS + f" select code, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, first_value(price) over {DW} as open, max(price) over {DW} as high, min(price) over {DW} as low, price as close, count(*) over {DW} as volume from ticks")
register("stream_order_prices", lambda spark, sf: replay(spark, sf, lambda t: live.order_prices(t, 2.0, 60.0)).select("code", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "price"), TICKS + ", p as (select code, ts, least(greatest(price, 2.0), 60.0)::double as price from ticks), m as (select *, min(price) over (partition by code order by ts rows between unbounded preceding and 1 preceding) as before from p) select code, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, price from m where before is null or price < before")



BATCHES = 5


def in_batches(spark, rows, at, path, writer):
    """Run a stream of the rows in BATCHES micro-batches, one after the other by the number ``at``; ``writer`` makes its writer of it.

    The rows are made once; each run goes on from the last one's checkpoint with the files that were added since.
    """
    rows.withColumn("_at", at).write.parquet(f"{path}/all")
    made = spark.read.parquet(f"{path}/all")
    cuts = made.agg(F.percentile_approx("_at", [k / BATCHES for k in range(1, BATCHES)], 100_000)).first()[0] or []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = made.filter((F.lit(True) if low is None else C("_at") > low) & (F.lit(True) if high is None else C("_at") <= high))
        part.drop("_at").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        writer(stream).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def _upserted(spark, sf):
    """Each code's bar of each day, kept up to date by micro-batches of running bars."""
    path = scratch(spark)
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts")
    running = views.table(spark, sf, "events").select(
        C("user_id").cast("string").alias("code"), F.to_date("ts").cast("string").alias("ts"), F.first("value").over(w).alias("open"), F.max("value").over(w).alias("high"), C("value").alias("close"), F.row_number().over(w).cast("long").alias("volume"), F.unix_micros(C("ts").cast("timestamp")).alias("at")
    )
    in_batches(spark, running, C("at"), path, lambda stream: upserts.upsert_batches(stream.drop("at"), f"{path}/out", ["code", "ts"], "volume", 16))
    return upserts.latest(spark, f"{path}/out").select("code", "ts", "open", "high", "close", "volume")


register("stream_upsert_batches", _upserted, q.base("user_day", quoted=False) + " select code::varchar as code, ts::varchar as ts, open, high, close, volume::bigint as volume from b")


def half_mean_of_10(bars):
    """Below half of the mean of ten closes; false while there are fewer."""
    last = bars["close"][:, -10:]
    return last[:, -1] < last.mean(1) * 0.5


def _live(spark, sf):
    """The mean signal of new bars, with the last bars of the history before them; some bars come late, some come again with another close."""
    path = scratch(spark)
    every = views.bars_hour(spark, sf)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp")
    history, new = every.filter(C("ts") < cut), every.filter(C("ts") >= cut)
    hours = (F.unix_seconds(C("ts").cast("timestamp")) / 3600).cast("long") * 100
    on_time = new.withColumn("arrival", hours + F.when(F.hour("ts") == 7, 350).otherwise(0))
    again = new.filter(F.hour("ts") == 13).withColumns({"arrival": hours + 250, "close": C("close") * 0.4})
    before = history.withColumn("arrival", hours - 10**9)
    in_batches(spark, before.unionByName(on_time).unionByName(again), C("arrival"), path, lambda stream: live.live_signals(stream, half_mean_of_10, 12).writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"))
    return spark.read.schema("code string, ts timestamp, arrival long, buy boolean").parquet(f"{path}/out").select("code", C("ts").cast("string").alias("ts"), "arrival", "buy")


register(
    "stream_live_signals",
    _live,
    HOUR
    + """, a as (select code, ts, close, (epoch(ts) // 3600)::bigint * 100 + case when ts < timestamp '2024-01-20 00:00:00' then -1000000000 when hour(ts) = 7 then 350 else 0 end as arrival from b
    union all select code, ts, close * 0.4::double, (epoch(ts) // 3600)::bigint * 100 + 250 from b where ts >= timestamp '2024-01-20 00:00:00' and hour(ts) = 13),
    k as (select x.code, x.ts, x.arrival, x.close, y.ts as ts2, arg_max(y.close, y.arrival) as c from a x join a y on y.code = x.code and y.ts <= x.ts and y.arrival <= x.arrival where x.arrival > 0 group by 1, 2, 3, 4, 5),
    r as (select *, row_number() over (partition by code, ts, arrival order by ts2 desc) as r from k),
    m as (select code, ts, arrival, any_value(close) as close, count(*) as n, avg(c) as m from r where r <= 10 group by 1, 2, 3)
    select code, cast(ts as varchar) as ts, arrival, n = 10 and close < m * 0.5 as buy from m""",
)


def _bar_files(spark, sf):
    path = scratch(spark)
    rows = views.bars_day(spark, sf).select(F.regexp_replace("code", "[^0-9A-Z]", "").alias("code"), C("ts").cast("string").alias("date"), "open", "high", "low", "close", "volume", "amount")
    io.write_series_files(rows.withColumn("name", F.concat(F.lit("bar "), "code")), path)
    return io.read_bar_files(spark, f"{path}/*").select("name", "code", C("ts").cast("string").alias("ts"), "close")


register("source_bar_files", _bar_files, DAY + " select 'bar ' || regexp_replace(code, '[^0-9A-Z]', '', 'g') as name, regexp_replace(code, '[^0-9A-Z]', '', 'g') as code, ts::varchar as ts, close from b")


def _text_table(spark, sf):
    path = scratch(spark)
    views.universe(spark, sf).write.option("sep", "\t").csv(path)
    return io.read_text_table(spark, path, "code long, name string, type string, region string")


register("source_text_table", _text_table, q.views("universe") + " select code, name, type, region from universe")


def _database(spark, sf):
    path = scratch(spark)
    io.write_sqlite(views.bars_day(spark, sf).select("code", C("ts").cast("string").alias("ts"), "close"), path, "bars", {"code": "instrument", "ts": "bar_date"})
    return io.read_sqlite(spark, path, "bars", "instrument string, bar_date string, close double")


register("source_database", _database, DAY + " select code as instrument, ts::varchar as bar_date, close from b")

# -- models ----------------------------------------------------------------------------------------


def training(spark, sf):
    df = with_steps(bars(spark, sf), [*ft.change_pct(), *ft.rolling_flags(), *ft.range_position(), *ft.forward_returns()])
    columns = [c for c in ml.feature_columns(df) if c not in ("volume", "amount", "limit_rate")]
    data = ml.assemble(df.filter("fwd_high1 is not null and rn > 10"), columns, C("fwd_high1") >= 5)
    return ml.balance(data), columns


GRID = {"trees": [4, 8], "depths": [2, 4], "splits": [2, 40], "leaf_rows": [1, 5]}


def _grid(spark, sf):
    return fo.forest_grid(training(spark, sf)[0], scratch(spark), **GRID, folds=2)


def _best_forest(data, spark):
    best = fo.best_cell(fo.forest_grid(data, scratch(spark), **GRID, folds=2))
    return ml.forest(data, best["trees"], best["depth"], best["leaf"])


def _forest(spark, sf):
    data, _ = training(spark, sf)
    return fo.score_many(data, {"forest": (_best_forest(data, spark), 0.5)}, scratch(spark), 1.0).select("code", C("ts").cast("string").alias("ts"), "label", "model", *r6("prob", "margin"))


def _boosted(spark, sf):
    data, _ = training(spark, sf)
    return fo.score_many(data, {"boosted": (ml.gradient_boosting(data, 3), 0.5)}, scratch(spark), 0.1).select("code", C("ts").cast("string").alias("ts"), "label", "model", *r6("prob", "margin"))


def _many(spark, sf):
    """Several forests and a boosted model over all rows, in one scan."""
    data, _ = training(spark, sf)
    models = {f"forest{d}": (ml.forest(data, 6, d), 0.5) for d in (2, 3, 4)} | {"boosted": (ml.gradient_boosting(data, 3), 0.6)}
    return fo.score_many(data, models, scratch(spark), 0.2).select("code", C("ts").cast("string").alias("ts"), "label", "model", *r6("prob", "margin"))


def _votes(spark, sf):
    """The votes of a forest's trees on every row, at two thresholds."""
    data, _ = training(spark, sf)
    data = data.withColumn("ts", C("ts").cast("string"))
    trees = fo.nodes_of(ml.forest(data, 9, 4), scratch(spark))
    return fo.detailed_votes(fo.tree_probabilities(data, trees, ["code", "ts"]), ["code", "ts"], [0.5, 0.6])


register("model_forest_grid", _forest)
register("model_grid_cells", lambda spark, sf: _grid(spark, sf).select("trees", "depth", "split", "leaf", "tp", "fp", "fn", "tn", *r6("recall", "precision")))
register("model_gradient_boosting", _boosted)
register("model_score_many", _many)
register("model_detailed_votes", _votes)
register(
    "model_oversample",
    lambda spark, sf: ov.oversample(training(spark, sf)[0].withColumn("ts", C("ts").cast("string")), ["code", "ts"]).groupBy("label", "made").agg(F.count("*").alias("n")),
    HOUR + ", f as (select lead(high) over (partition by code order by ts) as nh, close, rn from b), g as (select ((nh - close) / close * 100 >= 5)::int::double as label from f where nh is not null and rn > 10), c as (select label, count(*) as n from g group by 1) select label, false as made, n from c union all select label, true as made, (select max(n) from c) - n as n from c where n < (select max(n) from c)",
)
register("model_balance_classes", lambda spark, sf: training(spark, sf)[0].groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).select("label", "n", *r6("weight")), HOUR + f", f as (select ((max(high) over (partition by code order by ts rows between 1 following and 1 following)) - close) / close * 100 as f1, rn from b), g as (select (f1 >= 5)::int::double as label from f where f1 is not null and rn > 10), c as (select label, count(*) as n from g group by 1) select label, n, round((select sum(n) from c) / (select count(*) from c) + 1e-9, 6) as weight from c")



def _preprocessed(spark, sf):
    data, columns = training(spark, sf)
    made = ml.preprocess(columns, 8, 3).fit(raw := data.drop("features")).transform(raw)
    return made.select("code", C("ts").cast("string").alias("ts"), F.size(vector_to_array("features")).alias("components")).groupBy("code", "components").agg(F.count("*").alias("n"))


register("model_preprocess", _preprocessed, HOUR + ", f as (select code, rn, lead(high) over (partition by code order by ts) as nh from b) select code, 3 as components, count(*) as n from f where nh is not null and rn > 10 group by code")


def _eliminated(spark, sf):
    """The features that stay, and how the rows' labels go with each."""
    data, columns = training(spark, sf)
    left = ml.eliminate_features(data, columns, 5, 0.5)
    return data.unpivot(["label"], left, "feature", "value").groupBy("feature").agg(F.count("*").alias("n"), F.count_if(C("label") == 1).alias("positive"))


register("model_feature_elimination", _eliminated)


def _by_variance(spark, sf):
    """Rows by how many components keep 95 % of the variance."""
    data, columns = training(spark, sf)
    made = ml.preprocess_by_variance(raw := data.drop("features"), columns).transform(raw)
    return made.select("code", F.size(vector_to_array("features")).alias("components")).groupBy("code", "components").agg(F.count("*").alias("n"))


def _by_folds(spark, sf):
    """How well each number of features does over the folds, and whether it is the one that is kept."""
    data, columns = training(spark, sf)
    kept, means = ml.eliminate_by_folds(data, columns, 0.34, 2, 2)
    return spark.createDataFrame([(n, round(m, 6), n == len(kept)) for n, m in means.items()], "features int, accuracy double, kept boolean")


register("model_preprocess_by_variance", _by_variance)
register("model_elimination_by_folds", _by_folds)

register("series_last_ema", lambda spark, sf: bars(spark, sf).groupBy("code").agg(folds.last_ema(5)("close", "ts").alias("last_ema")).select("code", *r6("last_ema")), HOUR + f", e as (select code, ts, {q.ema('close', 5)} as e from b) select code, round(arg_max(e, ts) + 1e-9, 6) as last_ema from e group by code")

# -- sorts, sets, scalars ----------------------------------------------------------------------------
register("sort_top_per_group", lambda spark, sf: views.votes(spark, sf).groupBy("model").agg(F.max_by("vote_id", F.struct("prob", -C("vote_id"))).alias("best"), F.min_by("vote_id", F.struct("prob", "vote_id")).alias("worst")), q.views("votes") + " select model, arg_max(vote_id, prob * 1000000000 - vote_id) as best, arg_min(vote_id, prob * 1000000000 + vote_id) as worst from votes group by model")
register("sort_top_k", lambda spark, sf: views.votes(spark, sf).orderBy(F.desc("prob"), "vote_id").limit(25).select("vote_id", "prob"), q.views("votes") + " select vote_id, prob from votes order by prob desc, vote_id limit 25")
A, B = "select distinct code from votes where prob > 0.9", "select distinct code from votes where prob < 0.6"
for _op, _sql in (("intersect", "intersect"), ("exceptAll", "except"), ("unionByName", "union all")):
    register(
        f"set_{_op.lower()}",
        lambda spark, sf, op=_op: getattr(views.votes(spark, sf).filter("prob > 0.9").select("code").distinct(), op)(views.votes(spark, sf).filter("prob < 0.6").select("code").distinct()),
        q.views("votes") + f" {A} {_sql} {B}",
    )
register("set_distinct", lambda spark, sf: views.votes(spark, sf).select("model", "hit").distinct(), q.views("votes") + " select distinct model, hit from votes")
register(
    "scalar_strings",
    lambda spark, sf: views.universe(spark, sf).select(
        "code", F.lpad(C("code").cast("string"), 6, "0").alias("padded"), C("name").contains("00").alias("has"), C("type").startswith("A").alias("starts"), F.split("name", "#")[0].alias("head"), F.replace("name", F.lit("Supplier"), F.lit("S")).alias("short"), F.regexp_extract("name", "([0-9]+)", 1).alias("digits"), F.array_join(F.array("type", "region"), "/").alias("joined")
    ),
    q.views("universe") + " select code, lpad(code::varchar, 6, '0') as padded, contains(name, '00') as has, starts_with(type, 'A') as starts, string_split(name, '#')[1] as head, replace(name, 'Supplier', 'S') as short, regexp_extract(name, '([0-9]+)', 1) as digits, type || '/' || region as joined from universe",
)
register(
    "scalar_dates",
    lambda spark, sf: bars(spark, sf, "day").select("code", C("ts").cast("string").alias("ts"), F.year("ts").alias("y"), F.date_format("ts", "yyyyMM").alias("ym"), F.weekday("ts").alias("wd"), F.datediff(C("ts"), F.lit("1992-01-01").cast("date")).alias("days"), F.date_trunc("month", "ts").cast("date").cast("string").alias("month")),
    DAY + " select code, ts::varchar as ts, year(ts) as y, strftime(ts, '%Y%m') as ym, isodow(ts) - 1 as wd, date_diff('day', date '1992-01-01', ts) as days, date_trunc('month', ts)::date::varchar as month from b",
)
register(
    "scalar_math",
    lambda spark, sf: bars(spark, sf).select("code", C("ts").cast("string").alias("ts"), *[stable(e).alias(n) for n, e in {"ex": F.exp(C("turnover")), "angle": F.degrees(F.atan(C("chg") / 100)), "up": F.ceil(C("close") * 10) / 10, "clip": F.least(F.greatest(C("chg"), F.lit(-10.0)), F.lit(10.0)), "sg": F.signum("chg")}.items()]),
    HOUR + ", m as (select code, ts, exp(turnover) as ex, degrees(atan(chg / 100)) as angle, ceil(close * 10) / 10 as up, case when chg is null then -10 else least(greatest(chg, -10), 10) end as clip, sign(chg) as sg from b) select code, cast(ts as varchar) as ts, " + s6("ex", "angle", "up", "clip", "sg") + " from m",
)
register(
    "scalar_arrays",
    lambda spark, sf: views.votes(spark, sf).groupBy("code").agg(F.array_sort(F.collect_set("model")).alias("m")).select("code", F.array_join("m", ",").alias("models"), F.size(F.array_intersect("m", F.array(F.lit("m1"), F.lit("m2")))).alias("both"), F.array_join(F.array_sort(F.array_union("m", F.array(F.lit("m0")))), ",").alias("more"), F.array_contains("m", "m3").alias("has")),
    q.views("votes") + ", g as (select code, list_sort(list_distinct(list(model))) as m from votes group by 1) select code, array_to_string(m, ',') as models, len(list_intersect(m, ['m1', 'm2'])) as both, array_to_string(list_sort(list_distinct(list_concat(m, ['m0']))), ',') as more, list_contains(m, 'm3') as has from g",
)
register("scalar_json", lambda spark, sf: views.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(C("event_type").alias("t"))).alias("j")), "select event_id, (props::json ->> 'k')::int as k, '{\"t\":\"' || event_type || '\"}' as j from events")
