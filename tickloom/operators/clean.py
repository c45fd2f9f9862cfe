"""Cleaning and segmenting series of bars, and rules over universes and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as fn
from ..functions.series import Series

C = F.col
S = Series()


def valid_price(df: DataFrame) -> DataFrame:
    return df.filter(C("close") > 0)


def date_range(df: DataFrame, begin: str, end: str, closed: bool = False) -> DataFrame:
    """Rows strictly between two dates, or with the ends if closed."""
    ts, a, b = C("ts"), F.lit(begin).cast("date"), F.lit(end).cast("date")
    return df.filter(ts.between(a, b) if closed else (ts > a) & (ts < b))


def gap_cut(df: DataFrame, days: int = 30) -> DataFrame:
    """Drop each series' bars up to its largest gap of more than ``days`` days (the first of equals)."""
    gaps = df.withColumn("gap", F.datediff(F.lead("ts").over(S.w), C("ts")))
    cuts = gaps.filter(C("gap") > days).groupBy("code").agg(F.max_by("ts", F.struct("gap", -F.unix_timestamp(C("ts").cast("timestamp")))).alias("cut"))
    return df.join(cuts, "code", "left").filter(C("cut").isNull() | (C("ts") > C("cut"))).drop("cut")


def abnormal_split(df: DataFrame, bad: Column, min_rows: int = 26) -> DataFrame:
    """Split series at abnormal bars into segments (``segment``), dropping those bars and short segments."""
    flagged = df.withColumn("bad", fn.sig(bad)).withColumn("segment", F.sum(C("bad").cast("int")).over(S.upto))
    good = flagged.filter(~C("bad")).drop("bad")
    return good.withColumn("n", F.count("*").over(Window.partitionBy("code", "segment"))).filter(C("n") >= min_rows).drop("n")


def data_filter(df: DataFrame) -> DataFrame:
    """Drop bars locked at the upper limit, and rises beyond the limit less a cent of the last kept price."""
    spread = F.greatest("open", "high", "low", "close") - F.least("open", "high", "low", "close")
    kept = df.filter((C("chg") <= 0) | (spread >= 0.01))
    limit = C("limit_rate") - fn.div(F.lit(1.0), F.lag("close").over(S.w))
    return kept.withColumn("ok", fn.sig(C("chg") <= limit)).filter("ok").drop("ok")


def tradable_base(df: DataFrame) -> DataFrame:
    return df.withColumn("buy", fn.sig(C("chg") < C("limit_rate") * 0.95))


def limit_band(df: DataFrame) -> DataFrame:
    room = C("limit_rate") - fn.div(F.lit(1.0), "close")
    return df.withColumn("in_band", fn.sig(C("chg").between(-room, room)))


def board_filter(df: DataFrame, name: str, prefixes: tuple[str, ...], exclude: DataFrame | None = None) -> DataFrame:
    """Names that begin with one of the prefixes, less the rows that a table of exclusions matches in all its columns."""
    size = len(prefixes[0])
    kept = df.filter(F.substring(name, 1, size).isin(*prefixes))
    return kept if exclude is None else kept.join(exclude, exclude.columns, "left_anti")


def new_listing_flag(df: DataFrame, n: int = 100) -> DataFrame:
    return df.withColumns({"new": C("rn") <= n + 1, "seasoned": C("rn") >= n + 1})


def warmup_drop(df: DataFrame, n: int = 26) -> DataFrame:
    return df.filter(C("rn") > n)


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0, columns)


def status_periods(posts: DataFrame, open_end: Column) -> DataFrame:
    """(code, begin, end): from the first start notice after the last end, to the next end notice; an open one ends at ``open_end``."""
    w = Window.partitionBy("code").orderBy("ts", "event_id")
    ends = F.sum((C("kind") == "end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = posts.filter("kind != 'other'").withColumn("run", F.coalesce(ends, F.lit(0)))
    made = runs.groupBy("code", "run").agg(F.min(F.when(C("kind") == "start", C("ts"))).alias("begin"), F.max(F.when(C("kind") == "end", C("ts"))).alias("end"))
    return made.filter("begin is not null").select("code", "begin", F.coalesce("end", open_end).alias("end"))


def status_periods_adjacent(posts: DataFrame) -> DataFrame:
    """(code, begin, end, n): maximal runs of consecutive start notices."""
    w = Window.partitionBy("code").orderBy("ts", "event_id")
    hit = C("kind") == "start"
    runs = posts.withColumn("island", F.sum((~hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter(hit).groupBy("code", "island").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("island")


def limit_rate(bars: DataFrame, periods: DataFrame) -> DataFrame:
    """limit_rate: 10, 5 inside a period of the code, 0 for a bar without movement. The join is on code and bounded by the period."""
    p = periods.select(C("code").alias("c"), C("begin").cast("date").alias("b"), C("end").cast("date").alias("e"))
    inside = bars.join(p, (C("code") == C("c")) & (C("ts") >= C("b")) & (C("ts") <= C("e")), "left_semi").select("code", "ts", F.lit(True).alias("inside"))
    flat = (C("open") == C("high")) & (C("high") == C("low")) & (C("low") == C("close"))
    return bars.drop("limit_rate").join(inside, ["code", "ts"], "left").withColumn("limit_rate", F.when(flat, 0).when(C("inside"), 5).otherwise(10)).drop("inside")


def universe_filter(df: DataFrame, drop_types: list[str], suspect: str, shield: str, class_mark: str) -> DataFrame:
    """Drop listed types, suspect names without a shield word, and all but the first name of each base name."""
    kept = df.filter(~C("type").isin(drop_types)).filter(~(C("name").rlike(suspect) & ~C("name").rlike(shield)))
    based = kept.withColumn("base", F.regexp_replace("name", class_mark, ""))
    first = F.row_number().over(Window.partitionBy("base").orderBy("name", "code"))
    return based.withColumn("n", first).filter("n = 1").drop("n", "base")


def blacklist(df: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose name has none of the words, and the words that no name has.

    A word can only be in a name that has the word's first two characters side by side, so names and words
    meet by those and no pair of strangers is looked at.
    """
    listed = words.select("word").distinct().withColumn("_pair", F.left("word", F.lit(2)))
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda k: F.substring(C("name"), k, F.lit(2)))
    singles = F.transform(places, lambda x: F.left(x, F.lit(1)))
    names = df.select("name").distinct().withColumn("_pair", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), places, singles))))
    hits = names.join(listed, "_pair").filter(F.contains(C("name"), C("word"))).select("name", "word")
    return df.join(hits.select("name").distinct(), "name", "left_anti"), words.join(hits.select("word").distinct(), "word", "left_anti")


def pool_reject_reason(stats: DataFrame, min_days=40, min_ret=0.0, max_missing=0.05, max_zero=10, max_drawdown=-0.7) -> DataFrame:
    """The first rule that a fund fails, NULL if none."""
    reason = (
        F.when(C("days") < min_days, "days").when(C("annual") < min_ret, "return").when(C("missing") > max_missing, "missing").when(C("zero_run") > max_zero, "zero_run").when(C("drawdown") < max_drawdown, "drawdown")
    )
    return stats.withColumn("reason", reason)


def jump_filter(rets: DataFrame, most=0.315, jump=0.06, calm=0.006) -> DataFrame:
    """Funds to keep: no return above ``most``, nor above ``jump`` where the rest (less the 3 largest) is calm."""
    ranked = rets.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("ret"), "date")))
    made = ranked.groupBy("code").agg(F.max("ret").alias("top"), F.stddev_samp(F.when(C("n") > 3, C("ret"))).alias("rest"))
    return made.filter(~((C("top") > most) | fn.sig((C("top") > jump) & (C("rest") < calm))))
