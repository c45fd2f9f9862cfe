"""Operator 8: exact dedup of incoming batches against immutable snapshots, screened by binary fuse filters.

A snapshot is a table of distinct texts (digest, largest doc_id, rows) in shards by digest, with one
static binary fuse filter a shard. An incoming batch is first grouped by digest on its own, so a hot
text is one row before anything is routed; the distinct digests then meet their shard's filter, and
only positives join the snapshot's exact rows. Every row of a merged group is compared byte for byte
with the row that stays; rows that share a digest but not the bytes are grouped by their bytes.

Null counts as the empty text, so null and empty texts are copies of each other. Of equal texts the row
with the largest doc_id stays; repeated rows (same doc_id and text) count in group_size, and
``filter_documents`` leaves one of them. A null doc_id never beats another; in a group of nulls alone
keep_id is null. Up to BROADCAST_IDS copies, texts of any length are shuffled only if they have a copy;
beyond that all texts meet the copies' ids and digests by a shuffle. Empty tables give empty results;
other columns play no part and may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse_filter
from .common import stash, table, unstash, unused

#: Digests a shard's filter holds on average: bounds what one task builds or probes.
SHARD_KEYS = 200_000
#: Rows of a group of copies that are compared in one salted part.
SALT_ROWS = 4096
#: Rows of slim tables that may be broadcast (about 30 MB); more are joined by shuffle.
BROADCAST_IDS = 200_000


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.withColumns({"key": key, "shard": F.pmod(F.shiftrightunsigned(key, 7), F.lit(shards)).cast("int")})


def build_filters(snapshot: DataFrame) -> DataFrame:
    """One filter for each shard of a snapshot: (shard, filter)."""

    def build(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([fuse_filter.build(keys)], pa.binary())})

    return snapshot.select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of incoming (shard, key, ...) whose digest may be in the snapshot."""

    def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
        if not rows.num_rows or not held.num_rows:
            return rows.slice(0, 0)
        blob = held.column("filter")[0].as_py()
        return rows.filter(pa.array(fuse_filter.contains(blob, rows.column("key").to_numpy())))

    return incoming.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(probe, incoming.schema)


def group_batch(rows: DataFrame) -> DataFrame:
    """Distinct digests of a batch: (digest, keep_id, group_size)."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def merge(batch: DataFrame, snapshot: DataFrame, filters: DataFrame) -> DataFrame:
    """Groups of a batch and of a snapshot as one table: the next snapshot."""
    positive = screen(batch, filters).select("digest", F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    found = snapshot.join(positive, "digest", "left")
    grown = found.select(
        "digest",
        F.greatest("keep_id", "new_id").alias("keep_id"),
        (F.col("group_size") + F.coalesce("new_size", F.lit(0))).alias("group_size"),
        "key",
        "shard",
    )
    known = found.filter("new_size is not null").select("digest")
    fresh = batch.join(known, "digest", "left_anti").select("digest", "keep_id", "group_size", "key", "shard")
    return grown.unionByName(fresh)


def bounded_broadcast(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """ids with a broadcast hint if they are few by count; else as they are, for a shuffle join."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def decide(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> tuple[DataFrame, list[str]]:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, and the stashed tables it reads.

    The table is taken as ``batches`` arrivals by a hash of doc_id: the first makes the snapshot, each
    later one is screened against the snapshot before it.
    """
    paths: list[str] = []
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    rows, path = stash(docs.select("doc_id", digest_of(F.col("text")).alias("digest"), arrival.alias("arrival")))
    paths.append(path)
    total = rows.count()
    shards = max(1, -(-total // SHARD_KEYS))
    snapshot = None
    for k in range(batches):
        batch = _sharded(group_batch(rows.filter(F.col("arrival") == k)), shards)
        step = batch if snapshot is None else merge(batch, snapshot, build_filters(snapshot))
        snapshot, path = stash(step)
        paths.append(path)

    copies = rows.join(snapshot.filter("group_size > 1").select("digest", "keep_id", "group_size"), "digest")
    decided = rows.join(snapshot.select("digest", "keep_id", "group_size"), "digest").select("doc_id", "digest", "keep_id", "group_size")

    # byte check of every copy against the row that stays
    ids = copies.select(F.col("doc_id").alias("id"), "digest", "keep_id", "group_size").distinct()
    # by id and digest: ids may be null or repeated
    held, path = stash(docs.withColumn("own", digest_of(F.col("text"))).join(bounded_broadcast(ids), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest"))).drop("id", "own"))
    paths.append(path)
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    stays = (
        held.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .dropDuplicates(["digest"])
        .select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("text").alias("kept_text"))
    )
    differ = (
        held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
        .join(stays, ["digest", "salt"])
        .filter(F.col("text") != F.col("kept_text"))
        .select("doc_id", "digest", "text", "group_size")
    )
    collisions, path = stash(differ)
    paths.append(path)
    if not collisions.isEmpty():
        lost = collisions.groupBy("digest").agg(F.count("*").alias("lost"))
        own = collisions.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = collisions.drop("group_size").join(own, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        decided = (
            decided.join(apart.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
            .join(lost, "digest", "left")
            .select("doc_id", "digest", "keep_id", (F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"))
            .unionByName(apart)
        )
    out = decided.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
    return out, paths


def filter_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all of df's columns. Rows go by doc_id and text digest, as ids can be null or repeated."""
    decisions, paths = decide(df, doc_id, text)
    row = ["doc_id", "text_sha256"]
    id_, digest, own_digest = unused(df, "__id", "__digest", "__own")
    gone, _ = stash(decisions.filter("not kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(digest)).distinct())
    repeated = not decisions.filter("kept").groupBy(*row).count().filter("count > 1").isEmpty()
    unstash(df.sparkSession, paths)
    own = digest_of(F.col(f"`{text}`"))
    kept = df.join(bounded_broadcast(gone), F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (own == F.col(digest)), "left_anti")
    return kept.withColumn(own_digest, own).dropDuplicates([doc_id, own_digest]).drop(own_digest) if repeated else kept


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = decide(table(spark, sf_dir, "documents"))
    return out


ORACLE = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""
