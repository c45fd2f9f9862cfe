"""A table of the latest rows by key, kept by micro-batches: buckets of key hashes, of which only touched ones are written.

Layout: ``<path>/v<batch>/bucket=<k>`` holds bucket k as batch left it; ``<path>/manifest-<batch>.json``
names the version of each bucket. A batch writes its touched buckets beside the old ones and then switches by
renaming one small file, so a reader sees all of a batch or nothing. The manifest before stays for readers
that have begun with it; older ones and the buckets that only they name are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
BUCKETS = 64
MARK = "manifest-"


class _Folder:
    """The table's folder through Hadoop's file systems, so any store that Spark writes will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(""))) if self.fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write beside and rename: the file is there whole or not at all."""
        part = self._at(f"_{name}")
        out = self.fs.create(part, True)
        out.write(text.encode())
        out.close()
        self.fs.delete(self._at(name), False)
        self.fs.rename(part, self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _manifests(folder: _Folder) -> list[str]:
    return [n for n in folder.names() if n.startswith(MARK)]


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest one: batch, buckets (how many), schema, versions by bucket; None if there is no table yet."""
    folder = _Folder(spark, path)
    names = _manifests(folder)
    return json.loads(folder.read(names[-1])) if names else None


def _places(path: str, made: dict, buckets: list[str] | None = None) -> list[str]:
    return [f"{path.rstrip('/')}/v{version:09d}/bucket={k}" for k, version in made["versions"].items() if buckets is None or k in buckets]


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the last whole batch left it."""
    made = manifest(spark, path)
    return spark.read.schema(made["schema"]).parquet(*_places(path, made)) if made else None


def upsert(batch: DataFrame, number: int, path: str, keys: list[str], last: str, buckets: int = BUCKETS) -> int:
    """Put a batch's rows into the table; how many buckets that wrote.

    Of rows with the same keys the one with the largest ``last`` stays, in the batch and against the table.
    A batch that is already in the table (by its number) changes nothing.
    """
    spark = batch.sparkSession
    made = manifest(spark, path) or {"batch": -1, "buckets": buckets, "schema": ", ".join(f"`{n}` {t}" for n, t in batch.dtypes), "versions": {}}
    if number <= made["batch"]:
        return 0
    bucket = F.pmod(F.xxhash64(*keys), F.lit(made["buckets"])).cast("int")
    cols = [c for c in batch.columns if c not in keys]
    newest = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct(*cols), last).alias("v")).select(*keys, *[C(f"v.{c}").alias(c) for c in cols]).select(*batch.columns)
    touched = [str(r[0]) for r in batch.select(bucket).distinct().collect()]
    if not touched:
        return 0
    old = _places(path, made, touched)
    both = batch if not old else spark.read.schema(made["schema"]).parquet(*old).unionByName(batch)
    newest(both).withColumn("bucket", bucket).repartition(min(len(touched), made["buckets"]), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/v{number:09d}")
    folder = _Folder(spark, path)
    before = _manifests(folder)
    after = made | {"batch": number, "versions": made["versions"] | {k: number for k in touched}}
    folder.put(f"{MARK}{number:09d}.json", json.dumps(after))
    named = {f"v{v:09d}/bucket={k}" for x in (made, after) for k, v in x["versions"].items()}
    for name in before[:-1]:
        gone = {f"v{v:09d}/bucket={k}" for k, v in json.loads(folder.read(name))["versions"].items()} - named
        for place in gone:
            folder.delete(place)
        for version in {x.split("/")[0] for x in gone} - {x.split("/")[0] for x in named}:
            folder.delete(version)
        folder.delete(name)
    return len(touched)


def upsert_batches(rows: DataFrame, path: str, keys: list[str], last: str, buckets: int = BUCKETS):
    """A stream's micro-batches put into the table one after the other."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            upsert(held, number, path, keys, last, buckets)
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(each)
