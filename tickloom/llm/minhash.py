"""Operator 11: MinHash near-dedup with banding, signature verification and components by alternating stars.

A text's set is its distinct word shingles. Each of BANDS * ROWS universal hash functions (multiply, add,
upper half) takes its minimum over the set; ROWS minima make the key of a band. Two sets of similarity s
share a key with probability 1 - (1 - s^ROWS)^BANDS: at 0.8 less than one pair in a million shares none.
Pairs that share a key are held against each other by the signature (the lowest byte of each minimum);
at a similarity of ``percent`` less than one in a million agrees in under CUT of it. The rest is confirmed
on the full sets of the texts, byte for byte.

No bucket emits all its pairs. Equal texts are one node. Each member of a bucket first meets two centres:
the least member, and the one that has most company in all its buckets (of a group of copies that is the
text they were made from); the best match of each member is confirmed. Buckets that still hold several
components are cut into blocks of up to BLOCK members by set size; blocks meet if their sizes allow the
similarity, each two blocks in a task's bounded memory. Pairs of different components that the signatures
allow are confirmed in the meeting itself, which yields only what connects: no link is missed that would
connect more, no bucket is too large for a task, and no table of pairs grows with the square of a group.
Two members that share several buckets are compared in the first of them.

Null, empty and blank texts have the empty set and are linked with nothing; a text with fewer words than
a shingle has its whole sequence as the one member of its set. Repeated rows are members of the same
component. A null doc_id joins its component but never names it, unless all ids of the component are
null. Other columns play no part and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, map_batches, parts_of, stash, table, unstash
from .components import components
from .exact_dedup import bounded_broadcast
from .simhash import numbered, shingle_set, text_digest

SHINGLE = 4
PERCENT = 80
BANDS = 36
ROWS = 5
#: Least share of the signature in which two similar sets agree.
CUT = 0.64
#: Members of an open bucket that are compared with as many others in one task.
BLOCK = 2048
#: Shingle hashes that are taken through all hash functions at a time.
SPAN = 1 << 16
#: Bytes of text whose sets are held at a time, and words whose hashes a task remembers.
PART = 1 << 22
WORDS = 1 << 19


def _odd(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x (xor-shift and multiply, in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def set_of(words: list[bytes], known: _WordHash, size: int, factors: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text, in order; no words: none."""
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        out += own[k : len(own) - width + 1 + k] * factors[k]
    return np.unique(_mixed(out))


def signatures(sets: list[np.ndarray], functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima (upper half of 64 bits) of each set under each function, one row a set; no set may be empty."""
    times, plus = functions
    flat = np.concatenate(sets) & np.uint64(0xFFFFFFFF)
    bounds = np.cumsum([0, *map(len, sets)])
    out = np.full((len(sets), len(times)), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(flat), SPAN):
        x = flat[begin : begin + SPAN]
        first, last = np.searchsorted(bounds, begin, "right") - 1, np.searchsorted(bounds, begin + len(x), "left")
        starts = np.maximum(bounds[first:last] - begin, 0)
        here = np.empty((len(times), len(starts)), np.uint64)
        held = np.empty_like(x)
        for k in range(len(times)):
            np.multiply(x, times[k], out=held)
            held += plus[k]
            np.minimum.reduceat(held, starts, out=here[k])
        out[first:last] = np.minimum(out[first:last], here.T)
    return out >> np.uint64(32)


def sketches(df: DataFrame, doc_id: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, n, keys, signature) for every row: n is the size of the set; no set, no keys."""
    rng = np.random.default_rng(11)
    factors, functions = _odd(rng, shingle), (_odd(rng, bands * rows), _odd(rng, bands * rows))
    band_factors, band_plus = _odd(rng, rows), _odd(rng, bands)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for part in (p for batch in batches for p in parts_of(batch, PART)):
            sets = []
            for one in byte_rows(part):
                sets.append(set_of(one.lower().split(), known, shingle, factors))
                if len(known) > WORDS:
                    known.clear()
            sizes = np.array([len(x) for x in sets])
            some = [x for x in sets if len(x)]
            keys, marks = [None] * len(sets), [None] * len(sets)
            if some:
                found = signatures(some, functions)
                made = _mixed((found.reshape(-1, bands, rows) * band_factors).sum(2, dtype=np.uint64) + band_plus).view(np.int64)
                low = (found & np.uint64(0xFF)).astype(np.uint8)
                for k, at in enumerate(np.flatnonzero(sizes).tolist()):
                    keys[at], marks[at] = made[k], low[k].tobytes()
            yield pa.record_batch([part.column(0), part.column(2), pa.array(sizes), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], schema=schema)

    raw = F.col(f"`{text}`")
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), raw.cast("binary").alias("text"), text_digest(raw).alias("digest"))
    return own.mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>, signature binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, num) in order: (key, member, least member) for every member of a bucket of two or more, the least included."""
    key0 = num0 = None
    alone = False
    for batch in batches:
        key, num = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        begins = np.concatenate(([key[0] != key0], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        centre = np.where(at >= 0, num[np.maximum(at, 0)], num0 if num0 is not None else 0)
        ends = np.concatenate((begins[1:], [False]))  # whether the bucket ends with this row, as far as seen
        member = ~begins
        # a bucket's first row is told once a second one is there
        first_with_more = begins & ~ends
        first_with_more[-1] = False
        keep = member | first_with_more
        held_first = alone and not begins[0]
        k, m, c = key[keep], num[keep], centre[keep]
        if held_first:
            k, m, c = np.concatenate(([key0], k)), np.concatenate(([num0], m)), np.concatenate(([num0], c))
        if len(k):
            yield pa.record_batch([pa.array(k), pa.array(m), pa.array(c)], ["key", "a", "b"])
        key0, num0, alone = key[-1], centre[-1], bool(begins[-1])


def _agree(cut: float, percent: int):
    """Kernel over (a, b, n, other_n, signature, other_signature): (a, b, match) of pairs whose sizes and signatures allow the similarity."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        own, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(n), -1) for k in (4, 5))
        match = (own == other).sum(1)
        fits = (match >= cut * own.shape[1]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(match.astype(np.int32))], ["a", "b", "match"]).filter(pa.array(fits))

    return kernel


def _blocks_agree(cut: float, percent: int):
    """Kernel over one pair of blocks (key, side, num, root, n, signature, keys): (meeting, a, b), the pairs of different components that may be similar, as one row."""

    def run(group: pa.Table) -> pa.Table:
        side, num, root, n, key = (group.column(k).to_numpy() for k in ("side", "num", "root", "n", "key"))
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(num), -1)
        marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(num), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(right)
        a, b = [], []
        for at, x in enumerate(left.tolist()):
            others = left[at + 1 :] if within else right
            others = others[(root[others] != root[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
            if len(others):
                near = others[(marks[others] == marks[x]).sum(1) >= cut * marks.shape[1]]
                near = near[keys[x][(keys[near] == keys[x]).argmax(1)] == key[0]]
                a.append(np.full(len(near), num[x]))
                b.append(num[near])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        some = 1 if len(a) else 0
        return pa.table({"meeting": pa.array([group.column("meeting")[0].as_py()] * some, pa.int64()), "a": pa.array([a] * some, pa.list_(pa.int64())), "b": pa.array([b] * some, pa.list_(pa.int64()))})

    return run


def _meeting_links(percent: int, size: int):
    """Kernel over the pairs (meeting, a, b) and the texts (of, num, text) of a meeting: links (a, b) that connect what all its true pairs connect."""

    def run(pairs: pa.Table, members: pa.Table) -> pa.Table:
        sets = {x: shingle_set(y, size) for x, y in zip(members.column("num").to_pylist(), members.column("text").to_pylist(), strict=True)}
        parent = {x: x for x in sets}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for xs, ys in zip(pairs.column("a"), pairs.column("b"), strict=True):
            for x, y in zip(xs.values.to_pylist(), ys.values.to_pylist(), strict=True):
                own, other = sets[x], sets[y]
                shared = len(own & other)
                if 100 * shared >= percent * (len(own) + len(other) - shared) and (p := top(x)) != (q := top(y)):
                    parent[p] = q
                    found.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _confirmed(percent: int, size: int):
    """Kernel over (a, b, text, other): the pairs whose full sets have the similarity."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, held, out = None, set(), []
        for text, other in zip(byte_rows(batch, 2), byte_rows(batch, 3), strict=True):
            if other != last:
                last, held = other, shingle_set(other, size)
            own = shingle_set(text, size)
            shared = len(own & held)
            out.append(100 * shared >= percent * (len(own) + len(held) - shared))
        return pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    return kernel


def _open_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, joined: DataFrame, shingle: int, cut: float, percent: int, block: int) -> tuple[DataFrame, list[str]]:
    """Links (a, b) that connect what all links among members (key, num) of the same bucket connect, where joined (node, root) doesn't yet.

    Texts come only to the meetings of two blocks that have a pair to confirm, each once to a meeting.
    """
    spark = members.sparkSession
    rooted = members.join(joined.select(F.col("node").alias("num"), "root"), "num", "left").withColumn("root", F.coalesce("root", "num"))
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    # blocks by set size: a coarse rank (eighths of a doubling), then a hash within it where a rank holds too many
    rank = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    ranked, path = stash(rooted.join(split, "key").join(nodes.select("num", "n", "signature", "keys"), "num").withColumn("rank", rank))
    sizes = ranked.groupBy("key", "rank").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = ranked.join(sizes, ["key", "rank"]).withColumn("at", F.struct("rank", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int").alias("block"))).drop("rank", "blocks")
    blocks, blocks_path = stash(placed.groupBy("key", "at").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    l, r = blocks.alias("l"), blocks.alias("r")
    meets = l.join(r, "key").filter((F.col("l.at") <= F.col("r.at")) & (100 * F.col("l.most") >= percent * F.col("r.least")))
    met = meets.select("key", F.xxhash64("key", "l.at", "r.at").alias("meeting"), F.col("l.at").alias("x"), F.col("r.at").alias("y"))
    sides = met.select("key", "meeting", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at"))))).alias("s")).select("key", "meeting", "s.side", "s.at")
    rows = sides.join(placed, ["key", "at"]).drop("at")
    likely, likely_path = stash(rows.groupBy("key", "meeting").applyInArrow(_blocks_agree(cut, percent), "meeting long, a array<long>, b array<long>"))
    wanted = likely.select("meeting", F.explode(F.array_distinct(F.concat("a", "b"))).alias("num"))
    held, held_path = stash(texts.join(bounded_broadcast(wanted.select("num").distinct()), "num").dropDuplicates(["num"]))
    there = wanted.distinct().join(held, "num").select(F.col("meeting").alias("of"), "num", "text")
    links, links_path = stash(likely.groupBy("meeting").cogroup(there.groupBy("of")).applyInArrow(_meeting_links(percent, shingle), "a long, b long"))
    unstash(spark, [path, blocks_path, likely_path, held_path])
    return links, [links_path]


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, cut: float = CUT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain, plain_path = stash(sketches(df, doc_id, text, shingle, bands, rows))
    seed = numbered(plain.select("digest"))
    number = F.xxhash64("digest", F.lit(seed)).alias("num")
    nodes, nodes_path = stash(plain.filter("n > 0").select(number, "n", "keys", "signature").dropDuplicates(["num"]))

    bands_of = nodes.select(F.explode("keys").alias("key"), "num").repartition(parts, "key").sortWithinPartitions("key", "num")
    stars, stars_path = stash(bands_of.mapInArrow(_stars, "key long, a long, b long"))
    slim = nodes.select("num", "n", "signature")
    members = stars.select("key", F.col("a").alias("num"))
    company = members.join(members.groupBy("key").agg(F.count("*").alias("rows")), "key").groupBy("num").agg(F.sum("rows").alias("company"))
    centres = members.join(company, "num").groupBy("key").agg(F.max_by("num", F.struct("company", "num")).alias("b"))
    popular = members.join(centres, "key").filter("num != b").select(F.col("num").alias("a"), "b")
    pairs = stars.filter("a != b").select("a", "b").unionByName(popular).distinct()
    both = pairs.join(slim.toDF("a", "n", "signature"), "a").join(slim.toDF("b", "other_n", "other"), "b").select("a", "b", "n", "other_n", "signature", "other")
    likely, likely_path = stash(map_batches(both, _agree(cut, percent), "a long, b long, match int"))

    texts = df.select(F.xxhash64(text_digest(F.col(f"`{text}`")), F.lit(seed)).alias("num"), F.col(f"`{text}`").cast("binary").alias("text"))
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("match", -F.col("b"))).alias("b"))
    held, held_path = stash(texts.join(bounded_broadcast(best.select(F.explode(F.array("a", "b")).alias("num")).distinct()), "num").dropDuplicates(["num"]))
    sides = best.join(held.toDF("a", "text"), "a").join(held.toDF("b", "other"), "b").select("a", "b", "text", "other")
    links, links_path = stash(map_batches(sides, _confirmed(percent, shingle), "a long, b long"))
    joined, joined_path = components(links)
    more, more_paths = _open_links(members, nodes, texts, joined, shingle, cut, percent, block)
    paths = [held_path, links_path, joined_path, *more_paths]
    if not more.isEmpty():
        joined, joined_path = components(links.unionByName(more))
        paths.append(joined_path)

    named = plain.withColumn("num", number).join(joined.withColumnRenamed("node", "num"), "num", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "num")).alias("root"))
    rows_of, rows_path = stash(named)
    least = rows_of.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    unstash(spark, [plain_path, nodes_path, stars_path, likely_path, *paths])
    grouped = least.filter("rows > 1").select("root", "least")
    component = F.when(F.col("root").isNull() | F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    out = rows_of.join(bounded_broadcast(grouped), "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+')"

ORACLE = f"""
with recursive words as materialized (
  select doc_id, {_WORDS} as w from documents),
shingles as materialized (
  select distinct doc_id, hash(s) as h, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k : k + 3], ' ')) end) as s from words)),
sizes as materialized (select doc_id, count(*) as n from shingles group by 1),
links as materialized (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as shared
    from shingles x join shingles y on x.h = y.h and x.s = y.s and x.doc_id <> y.doc_id group by 1, 2)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * shared >= 80 * (p.n + q.n - shared)),
reach as (select doc_id, doc_id as other from documents union select reach.doc_id, links.b from reach join links on links.a = reach.other)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id)
join (select doc_id, min(other) as component_id from reach group by 1) using (doc_id)
"""
