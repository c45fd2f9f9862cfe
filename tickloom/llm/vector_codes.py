"""Operator 13: vectors compressed to codes of their parts, nearest entries found by LAESA pivots.

Components become integers, so sums and distances are exact and every rerun agrees. A vector is cut into
PARTS parts; each part position has a codebook, whose first entries are the parts of the vectors with the
smallest ids and which ROUNDS rounds of assignment and mean improve. The first PIVOTS of the first entries
are the pivots of a position: the distances from all parts to them are computed once and kept with the
parts. In each round the distances from pivots to entries give, by differences, lower bounds of every
part's distance to every entry; entries are tried from the least bound on, and a part is done when its
next bound exceeds the best exact distance so far. Bounds are loosened by more than their rounding, and
equal distances go to the lower index, so the result is that of trying all entries.

Parts never move: a round is one pass over the stored parts that yields, for each task, counts and sums of
each entry; the entries (PARTS * ENTRIES vectors, whatever the table's size) are the only thing that goes
through the driver and into the tasks.

Rows whose vector is null or holds null or non-finite components have no result. A vector has as many
dimensions as most vectors have (the fewer in a tie), others have no result either; dimensions that
PARTS doesn't divide are filled with zeros. Integers are held within a bound that keeps all distances in
64 bits (for 64 dimensions components beyond 32,768 count as that). Sums of a label beyond 64 bits are
null. Repeated ids are rows of their own, in the order of their vectors where order counts; a null id
comes after all others. Fewer vectors than ENTRIES give as many entries. Null labels are equal to each
other. An empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stash, table
from .exact_dedup import bounded_broadcast

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
PIVOTS = 4
#: By which share, and by how much besides, bounds are loosened for what 32-bit distances lose.
LOOSE_SHARE = 1e-6
LOOSE = 1e-3


def bound_of(dims: int) -> int:
    """The largest integer component for which squared distances of whole vectors stay within 62 bits."""
    return isqrt((1 << 62) // max(dims, 1)) // 2


def integers(floats: np.ndarray, parts: int) -> np.ndarray:
    """Components as integers (32 bits hold them), with zeros up to a multiple of parts: (rows, parts, width)."""
    n, dims = floats.shape
    bound = bound_of(dims)
    out = np.zeros((n, -(-dims // parts) * parts), np.int32)
    out[:, :dims] = np.clip(np.floor(floats * SCALE), -bound, bound)
    return out.reshape(n, parts, out.shape[1] // parts)


def _array(column: pa.Array, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _roots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows, pivots) of integer parts."""
    apart = x[:, None] - pivots[None]
    return np.sqrt((apart * apart).sum(2).astype(np.float64))


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each part's nearest entry, and how many distances that took."""
    n = len(x)
    between = _roots(entries, pivots)  # (entries, pivots)
    bounds = np.zeros((n, len(entries)))
    for k in range(len(pivots)):
        held = to_pivots[:, k, None].astype(np.float64)
        np.maximum(bounds, np.abs(held - between[None, :, k]) - LOOSE_SHARE * (held + between[None, :, k]) - LOOSE, out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(entries))
    rows, tried = np.arange(n), 0
    for rank in range(len(entries)):
        at = order[rows, rank]
        # a part whose next bound is beyond its best distance is done: later bounds are no smaller
        going = bounds[rows, at] <= np.sqrt(best[rows].astype(np.float64)) * (1 + LOOSE_SHARE)
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        apart = x[rows] - entries[at]
        found = (apart * apart).sum(1)
        tried += len(rows)
        better = (found < best[rows]) | ((found == best[rows]) & (at < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], at[better]
    return index, best, tried


def _prepared(dims: int, pivots: np.ndarray):
    """Kernel over (vec_id, label, vector): integer parts, and the distances of all parts to their pivots as 32-bit numbers."""
    parts = len(pivots)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        floats = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        x = integers(floats.reshape(batch.num_rows, dims), parts)
        found = np.stack([_roots(x[:, k].astype(np.int64), pivots[k]) for k in range(parts)], 1).astype(np.float32)
        columns = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x, found)]
        return pa.record_batch([batch.column(0), batch.column(1), *columns], ["vec_id", "label", "parts", "to_pivots"])

    return kernel


def _sums(books: np.ndarray, pivots: np.ndarray):
    """Kernel over (parts, to_pivots) of a task: (part, entry, n, sums) of what is assigned to each entry."""
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        # 64 bits hold the sums of a batch in two halves; Python's integers hold those of a task
        total = np.zeros((parts, entries, width), object)
        for batch in batches:
            x = _array(batch.column(0), np.int32, parts, width).astype(np.int64)
            held = _array(batch.column(1), np.float32, parts, pivots.shape[1])
            for k in range(parts):
                index, _, _ = nearest(x[:, k], held[:, k], books[k], pivots[k])
                order = np.argsort(index, kind="stable")
                own = index[order]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
                if len(starts):
                    counts[k, own[starts]] += np.diff(np.append(starts, len(own)))
                    rows = x[order, k]
                    total[k, own[starts]] += np.add.reduceat(rows >> 20, starts).astype(object) * (1 << 20) + np.add.reduceat(rows & ((1 << 20) - 1), starts)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.decimal128(38, 0)))], schema=schema)

    return run


def _codes(books: np.ndarray, pivots: np.ndarray):
    """Kernel over (vec_id, label, parts, to_pivots): (vec_id, label, code, error)."""
    parts, _, width = books.shape

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _array(batch.column(2), np.int32, parts, width).astype(np.int64)
        held = _array(batch.column(3), np.float32, parts, pivots.shape[1])
        found = [nearest(x[:, k], held[:, k], books[k], pivots[k])[:2] for k in range(parts)]
        code = np.stack([i for i, _ in found], 1).astype(np.uint8)
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in code]), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    return kernel


def _usual_length(rows: DataFrame) -> int | None:
    """The most frequent number of components, the smallest in a tie; None without rows."""
    row = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return row and row["dims"]


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept row, and the codebooks (part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part, so entries must be 1 to 256")
    own = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = own.filter(F.col("vector").isNotNull() & ~bad)
    dims = _usual_length(kept)
    if dims is None:
        return own.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    rows = kept.filter(F.size("vector") == dims)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = integers(np.array([r["vector"] for r in first], np.float64).reshape(len(first), dims), parts).astype(np.int64).swapaxes(0, 1)
    fixed = books[:, :pivots].copy()
    kinds = dict(own.dtypes)
    names = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    held, _ = stash(map_batches(rows, _prepared(dims, fixed), f"{names}, parts binary, to_pivots binary"))
    width = books.shape[2]
    for _ in range(rounds):
        summed = held.select("parts", "to_pivots").mapInArrow(_sums(books, fixed), "part int, entry int, n long, sums array<decimal(38,0)>")
        # a row for each entry comes to the driver
        positions = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)]
        books = books.copy()
        for r in summed.groupBy("part", "entry").agg(F.sum("n").alias("n"), *positions).collect():
            books[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return map_batches(held, _codes(books, fixed), f"{names}, code string, error long"), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded, _ = stash(coded)
    wide = F.col("error").cast("decimal(38,0)")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(wide).try_cast("long").alias("label_error"))
    joined = coded.join(bounded_broadcast(by_label), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    def assigned(k: int) -> str:
        return f"""
d{k} as materialized (
  select x.vec_id, x.part, e.entry, sum((x.x - e.x) * (x.x - e.x)) as d
  from x join b{k} e on e.part = x.part and e.pos = x.pos group by 1, 2, 3),
a{k} as materialized (select vec_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d from d{k} group by 1, 2)"""

    def moved(k: int) -> str:
        return f"""
m{k} as materialized (
  select a.part, a.entry, x.pos, sum(x.x) as s, count(*) as n
  from a{k - 1} a join x on x.vec_id = a.vec_id and x.part = a.part group by 1, 2, 3),
b{k} as materialized (
  select b.part, b.entry, b.pos, cast(coalesce((s - ((s % n) + n) % n) // n, b.x) as bigint) as x
  from b{k - 1} b left join m{k} m on m.part = b.part and m.entry = b.entry and m.pos = b.pos)"""

    steps = [assigned(0)]
    for k in range(1, rounds + 1):
        steps += [moved(k), assigned(k)]
    return f"""
with kept as materialized (
  select vec_id, label, embedding as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (
  select vec_id, k // (n // {PARTS}) as part, k % (n // {PARTS}) as pos, cast(floor({SCALE} * cast(v[k + 1] as double)) as bigint) as x
  from (select vec_id, v, len(v) as n, unnest(range(len(v))) as k from kept)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < {ENTRIES}),
b0 as materialized (select x.part, f.entry, x.pos, x.x from x join first f using (vec_id)),
{",".join(steps)},
sha as (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from b{rounds}),
coded as materialized (
  select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error
  from a{rounds} join kept using (vec_id) group by 1, 2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded cross join sha
"""


ORACLE = _oracle()
