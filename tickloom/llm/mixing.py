"""Operator 3: mixing sources to target weights by hash thresholds, without sorting documents.

A source takes whole passes over itself (target // size) and, for the rest, the documents whose hash is
under a threshold. The threshold is found from a histogram of words by (source, top 12 bits of the
hash): whole buckets fit the budget up to a boundary bucket, and only that bucket is split again by the
next 12 bits, until it holds one hash. A document at the boundary is taken if that brings the sum
nearer to the target. Rising budgets take nested sets of documents.

Targets share all words by weight; a source's target stops at CEILING times its size and the excess goes
to the others by weight: target = min(CEILING * size, weight * level), with one level for all sources.

Sources in code-point order, null last, weigh WEIGHTS in turn; null is a source of its own. Null, empty
and blank texts have size 0 and take 0 words; a source without words has target 0. Repeated rows share a
hash, so they are taken or left together; a null doc_id hashes like the empty string. An empty table
gives an empty result. Other columns play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table, unstash, unused, words_of
from .exact_dedup import bounded_broadcast

WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3
HASH_BITS = 60
LEVEL_BITS = 12


def _sizes(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").cast("string").alias("source"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return own.select(
        "doc_id",
        F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("key"),
        "source",
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"),
    )


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(key, source_size, target) for each source; rows have (key, source, size). Windows run over one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sized = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * ceiling
    filling = Window.orderBy(F.col("source_size") * ceiling / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(
        filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    filled = sized.withColumn("weight", weight).withColumn("level", level)
    # the first source, by size per weight, that its level does not fill sets the level of all after it
    common = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct((F.col("source_size") * ceiling / F.col("weight")).alias("r"), "source", "level"))).over(everything)["level"]
    return filled.withColumn("common", common).select("key", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("common") * F.col("weight"), cap.cast("double"))).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> tuple[DataFrame, list[str]]:
    """(key, source_size, target, passes, threshold): take ``passes`` copies of each document, and one more below the threshold."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan, path = stash(goals.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))))
    paths = [path]
    state = plan.filter("rest > 0").select("key", "rest", F.lit(0).cast("long").alias("path"), F.lit(False).alias("found"), F.lit(0).cast("long").alias("threshold"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        going = state.filter("not found")
        bucket = F.shiftright("h", shift)
        inside = rows.join(bounded_broadcast(going.select("key", "rest", "path")), "key").filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("path"))
        histogram = inside.groupBy("key", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        along = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = histogram.withColumn("upto", F.sum("words").over(along)).filter("upto > rest")
        edge = over.groupBy("key").agg(F.min(F.struct("bucket", "words", "lo", "hi", "upto", "rest")).alias("e")).select("key", "e.*")
        left = F.col("rest") - (F.col("upto") - F.col("words"))
        lone = F.col("lo") == F.col("hi")
        next_state = edge.select(
            "key",
            left.alias("rest"),
            F.col("bucket").alias("path"),
            lone.alias("found"),
            F.when(lone & (left * 2 >= F.col("words")), F.col("lo") + 1).when(lone, F.col("lo")).otherwise(F.lit(0).cast("long")).alias("threshold"),
        )
        # a budget that no bucket passes takes all of the source (only by rounding)
        missing = going.join(edge.select("key"), "key", "left_anti").select("key", "rest", "path", F.lit(True).alias("found"), F.lit(1 << HASH_BITS).alias("threshold"))
        state, path = stash(state.filter("found").unionByName(next_state).unionByName(missing))
        paths.append(path)
        if state.filter("not found").isEmpty():
            break
    return plan.join(state.select("key", "threshold"), "key", "left").select("key", "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold")), paths


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row."""
    rows, rows_path = stash(_sizes(df, doc_id, text, source))
    found, paths = thresholds(rows, targets(rows, weights, ceiling))
    cuts, _ = stash(found)
    unstash(df.sparkSession, paths)
    copies = (F.col("passes") + (F.col("h") < F.col("threshold")).cast("long")).alias("copies")
    decided = rows.join(bounded_broadcast(cuts), "key").select("doc_id", "size", "source_size", "target", copies)
    return decided.withColumn("taken", F.col("size") * F.col("copies"))


def repeat_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """df's rows as often as the mix takes them (0 to CEILING times), with df's columns."""
    rows, rows_path = stash(_sizes(df, doc_id, text, source))
    found, paths = thresholds(rows, targets(rows, weights, ceiling))
    key, passes, threshold, n = unused(df, "__key", "__passes", "__threshold", "__n")
    cuts, _ = stash(found.select(F.col("key").alias(key), F.col("passes").alias(passes), F.col("threshold").alias(threshold)))
    unstash(df.sparkSession, [rows_path, *paths])
    origin = F.col(f"`{source}`").cast("string")
    named = F.when(origin.isNull(), "-").otherwise(F.concat(F.lit("+"), origin))
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    copies = F.col(passes) + (h < F.col(threshold)).cast("long")
    joined = df.withColumn(key, named).join(bounded_broadcast(cuts), key)
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[F.col(f"`{c}`") for c in df.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source collate "binary" nulls last) - 1) % 3 + 1] as weight
  from d group by source),
f as (
  select *, 3 * source_size / weight as r,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
         / sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as level
  from s),
c as (select arg_min(level, r) as common from f where level * weight <= 3 * source_size),
g as (select source, source_size, least(3.0::double * source_size, coalesce(common * weight, 3.0::double * source_size)) as target from f, c),
p as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from g),
q as (select *, greatest(0.0::double, target - passes * source_size) as rest from p),
u as (
  select source, h, sum(size) as words, sum(sum(size)) over (partition by source order by h) as upto
  from d group by source, h),
e as (
  select q.source, arg_min(case when (rest - (upto - words)) * 2 >= words then h + 1 else h end, h) as threshold
  from q join u on u.source is not distinct from q.source where rest > 0 and upto > rest group by q.source),
t as (
  select q.*, case when rest > 0 then coalesce(threshold, 1152921504606846976) else 0 end as threshold
  from q left join e on e.source is not distinct from q.source)
select d.doc_id, d.size, t.source_size, t.target, (t.passes + (d.h < t.threshold)::bigint)::bigint as copies,
       (d.size * (t.passes + (d.h < t.threshold)::bigint))::bigint as taken
from d join t on t.source is not distinct from d.source
"""
