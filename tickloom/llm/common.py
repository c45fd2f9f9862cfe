"""Small helpers that the operators of this subpackage share.

Words everywhere are runs of bytes other than space and \\x09-\\x0D; ``bytes.split()`` with no
argument splits on exactly those, and ``bytes.lower()`` lower-cases only A-Z.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line breaks and other white space that count as a space between words (fixed values).
OTHER_SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")
LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; null or blank text: an empty array."""
    flat = F.coalesce(text, F.lit(""))
    for space in OTHER_SPACES:
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once, also where ``body`` uses x inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a local master (tests, one machine), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return context.getCheckpointDir().rstrip("/")


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unstash(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of stash() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove shuffle files of frames that nothing holds any more, which it does when the driver's garbage is collected."""
    for _ in range(2):  # Python lets go of its handles on a thread of its own
        gc.collect()
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()


def byte_rows(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    """A binary or string column as bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def parts_of(batch: pa.RecordBatch, size: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of a column (a longer value is a part of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_batches(df: DataFrame, kernel, schema: str) -> DataFrame:
    """mapInArrow with one function from a record batch to a record batch (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = kernel(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
