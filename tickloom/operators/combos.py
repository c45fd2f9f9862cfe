"""Search of signal and fund combinations, level by level; a combination is a sorted array."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions import series as fn

C = F.col


def group_product(families: list[DataFrame]) -> DataFrame:
    """At most one member of each family (a table with one column ``member``), at least one in all. Families are short lists."""
    out = None
    for k, family in enumerate(families):
        one = family.select(C("member").alias(f"m{k}")).distinct()
        one = one.unionByName(family.sparkSession.range(1).select(F.lit(None).cast("string").alias(f"m{k}")))
        out = one if out is None else out.crossJoin(one)
    chosen = F.array_sort(F.array_compact(F.array(*[C(f"m{k}") for k in range(len(families))])))
    return out.select(chosen.alias("combo")).filter(F.size("combo") > 0)


def level_join(base: DataFrame, last: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Every set of ``last`` with every base signal it lacks, each once, less those that exist.

    The sorted base signals are one short array, which each set of a level filters and explodes.
    """
    signals = base.agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    more = F.array_except("signals", "combo")
    made = last.select("combo").join(F.broadcast(signals)).select("combo", F.explode(more).alias("signal"))
    made = made.select(F.array_sort(F.concat("combo", F.array("signal"))).alias("combo")).distinct()
    return made if existing is None else made.join(existing.select("combo"), "combo", "left_anti")


def prune_supersets(candidates: DataFrame, dead: DataFrame, members: str = "combo") -> DataFrame:
    """Candidates that hold no dead set: a dead set is contained exactly if as many of its members meet as it has."""
    d = dead.select(C(members).alias("dead")).withColumn("dead_key", F.array_join("dead", ":"))
    parts = candidates.select(C(members).alias("c"), F.explode(members).alias("m"))
    each = d.select("dead_key", F.size("dead").alias("size"), F.explode("dead").alias("m"))
    held = parts.join(each, "m").groupBy("c", "dead_key", "size").agg(F.count("*").alias("n")).filter(C("n") == C("size")).select(C("c").alias(members)).distinct()
    return candidates.join(held, members, "left_anti")


def evaluate(flags: DataFrame, combos: DataFrame, value: str) -> DataFrame:
    """Count and sum of ``value`` over the rows whose active signals (array ``active``) include the combination.

    Rows meet a combination through one of its members, so the join is on equal signals.
    """
    keyed = combos.withColumn("first", C("combo")[0])
    rows = flags.select(value, "active", F.explode("active").alias("first"))
    hit = rows.join(keyed, "first").filter(F.size(F.array_except("combo", "active")) == 0)
    made = hit.groupBy("combo").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return combos.select("combo").join(made, "combo", "left").select("combo", F.coalesce("n", F.lit(0)).alias("n"), "total", "mean")


def layered_search(flags: DataFrame, base: DataFrame, value: str, least: int, levels: int, keep) -> DataFrame:
    """Level after level: evaluate, drop sets under ``least`` rows, extend the rest. ``keep`` makes a level durable."""
    level = base.select(F.array("signal").alias("combo"))
    found = None
    for _ in range(levels):
        scored = keep(evaluate(flags, level, value).filter(C("n") >= least))
        if scored.isEmpty():
            break
        found = scored if found is None else found.unionByName(scored)
        level = level_join(base, scored, found)
    return found if found is not None else evaluate(flags, level, value).limit(0)


def best_filter(scores: DataFrame, least_n: int, least_mean: float) -> DataFrame:
    return scores.filter((C("n") >= least_n) | (C("mean") >= least_mean)).distinct()


def apriori_next(sets: DataFrame, strict: bool = True) -> DataFrame:
    """Sets of n from sets of n-1 that share their first n-2; strict: all their subsets must be there."""
    n = F.size("combo")
    keyed = sets.select(C("combo"), F.slice("combo", 1, n - 1).alias("prefix"), F.element_at("combo", -1).alias("tail"))
    other = keyed.select("prefix", C("tail").alias("tail2"))
    made = keyed.join(other, "prefix").filter(C("tail") < C("tail2")).select(F.concat("combo", F.array("tail2")).alias("combo"))
    if not strict:
        return made
    subsets = made.select(C("combo").alias("whole"), F.explode("combo").alias("without")).withColumn("combo", F.array_remove(C("whole"), C("without")))
    return subsets.join(sets.select("combo"), "combo").groupBy("whole").agg(F.count("*").alias("k")).filter(C("k") == F.size("whole")).select(C("whole").alias("combo"))


def estimate_next_count(sets: DataFrame) -> DataFrame:
    """How many sets ``apriori_next(strict=False)`` would make, from the sizes of the prefix groups."""
    n = sets.groupBy(F.slice("combo", 1, F.size("combo") - 1).alias("prefix")).agg(F.count("*").alias("k"))
    return n.agg(F.coalesce(F.sum((C("k") * (C("k") - 1) / 2).cast("long")), F.lit(0)).alias("n"))


def pick_k_for_target(seeds: DataFrame, target: int) -> DataFrame:
    """The largest number of best seeds whose candidates number at most the target: a seed of place p in its prefix group adds p-1 pairs."""
    prefix = F.slice("combo", 1, F.size("combo") - 1)
    ranked = seeds.withColumn("place", F.row_number().over(Window.partitionBy(prefix).orderBy(F.desc("score"), "key")))
    run = ranks.running(ranked, -C("score").cast("double"), ["key"], {"made": C("place") - 1})
    fit = run.filter(C("made") <= target)
    return fit.agg(F.count("*").alias("k"), F.coalesce(F.max("made"), F.lit(0)).alias("made"))


def candidate_births(ranked: DataFrame) -> DataFrame:
    """(birth, n): how many sets of one more have all their subsets among the first so many seeds (combo, rank), for each rank at which some become complete."""
    prefix = F.slice("combo", 1, F.size("combo") - 1)
    keyed = ranked.select("combo", prefix.alias("prefix"), F.element_at("combo", -1).alias("tail"))
    made = keyed.join(keyed.select("prefix", C("tail").alias("tail2")), "prefix").filter(C("tail") < C("tail2")).select(F.concat("combo", F.array("tail2")).alias("whole"))
    subsets = made.select("whole", F.explode("whole").alias("without")).select("whole", F.array_remove("whole", C("without")).alias("combo"))
    complete = subsets.join(ranked.select("combo", "rank"), "combo").groupBy("whole").agg(F.count("*").alias("k"), F.max("rank").alias("birth")).filter(C("k") == F.size("whole"))
    return complete.groupBy("birth").agg(F.count("*").alias("n"))


def pick_k_strict(seeds: DataFrame, target: int, keep) -> DataFrame:
    """(k, made): the largest number of best seeds (combo, key, score) whose strict candidates number at most the target.

    A candidate is born with the worst-ranked of its subsets, so one count of births answers for every number
    of seeds up to it. The number of seeds looked at begins with what the loose count allows, which is never
    too large, and doubles until the target is passed. ``keep`` makes a table durable.
    """
    spark = seeds.sparkSession
    ranked = keep(ranks.row_numbers(seeds, -C("score").cast("double"), ["key"], "rank").select("combo", C("rank").cast("long").alias("rank")))
    total, k = ranked.count(), max(2, pick_k_for_target(seeds, target).first()["k"])
    while True:
        births = keep(candidate_births(ranked.filter(C("rank") <= k)))
        made = births.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if made > target:
            run = ranks.running(births, C("birth").cast("double"), [], {"made": C("n")})
            k = run.filter(C("made") > target).agg(F.min("birth")).first()[0] - 1
            made = births.filter(C("birth") <= k).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            break
        if k >= total:
            k = total
            break
        k *= 2
    return spark.range(1).select(F.lit(k).cast("long").alias("k"), F.lit(made).cast("long").alias("made"))


#: Members of a pool that a combination source may hold on the driver and in every task.
POOL = 1_000_000


def combination_source(pool: DataFrame, n: int, begin: int = 0, end: int | None = None) -> DataFrame:
    """(number, combo): the sets of n members (column ``member``) with numbers from begin to end, each made in its task from its number alone.

    Numbers count sets in the order of their largest member, then the next one, and so on; any range can be
    made on its own, so a batch of a search is a range, not a table.
    """
    spark = pool.sparkSession
    names = [r[0] for r in pool.select("member").distinct().orderBy("member").limit(POOL + 1).collect()]
    if len(names) > POOL:
        raise ValueError(f"a pool has at most {POOL} members")
    whole = math.comb(len(names), n)
    end = whole if end is None else min(end, whole)
    if end >= 1 << 62:
        raise ValueError("numbers of these sets don't fit 64 bits; take a range")
    # how many sets of k have all members below m, as far as 64 bits go
    below = [np.array([min(math.comb(m, k), (1 << 62)) for m in range(len(names) + 1)]) for k in range(1, n + 1)]
    member = pa.array(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column(0).to_numpy().copy()
            at = np.zeros((len(left), n), np.int64)
            for k in range(n, 0, -1):
                at[:, k - 1] = np.searchsorted(below[k - 1], left, "right") - 1
                left -= below[k - 1][at[:, k - 1]]
            sets = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * n), member.take(pa.array(at.ravel())))
            yield pa.record_batch([batch.column(0), sets], ["number", "combo"])

    kind = pool.schema["member"].dataType.simpleString()
    return spark.range(begin, max(begin, end)).mapInArrow(run, f"number long, combo array<{kind}>")


def satisfied(flags: DataFrame, combos: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, combo): the combinations whose members are all among a row's active signals (array ``active``).

    A row meets a combination only through the member that fewest rows have, so a common signal multiplies nothing.
    """
    members = combos.select("combo").distinct().select("combo", F.explode("combo").alias("signal"))
    often = flags.select(F.explode("active").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))
    rarest = members.join(often, "signal", "left").groupBy("combo").agg(F.min_by("signal", F.struct(F.coalesce("n", F.lit(0)), "signal")).alias("signal"))
    rows = flags.select(*keys, "active", F.explode(F.array_distinct("active")).alias("signal"))
    return rows.join(rarest, "signal").filter(F.size(F.array_except("combo", "active")) == 0).select(*keys, "combo")


def seed_select(results: DataFrame, baseline: float, pool: DataFrame) -> DataFrame:
    """Results above the baseline whose members are all in the pool, one for each key, best first."""
    inside = results.select("key", "score", "combo", F.explode("combo").alias("code")).join(pool.select("code"), "code").groupBy("key", "score", "combo").agg(F.count("*").alias("n")).filter(C("n") == F.size("combo"))
    best = inside.filter(C("score") > baseline).withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"))))
    return best.filter("r = 1").select("key", "score", "combo")


def candidate_fitness(n: Column, ratio: Column) -> Column:
    return F.when(n > 0, fn.div(F.log(n), ratio + 0.01)).otherwise(0.0)
