"""Operator 5: SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint has a bit for each majority among the XXH64 hashes of the text's word shingles. Bit i
gets a vector m(i) of radius+1 bits; for each of the 2^(radius+1)-1 non-zero vectors v a mask keeps
the bits whose m(i) has odd product with v. Any set of at most ``radius`` differing bits is orthogonal
to some v, so each pair within the radius shares a key in some table: no pair is missed.

Equal fingerprints are one node from the start. Buckets of a table are streamed in key order: a bucket
of up to BUCKET distinct fingerprints yields a spanning forest of its links (never all pairs); of a
larger one every member meets others at variants, members with one bit flipped against members with
two, which finds exactly the pairs within 3 bits with work in proportion to the bucket.

Null, empty and blank texts have fingerprint zero and are linked like any other; a text with fewer
words than a shingle counts as one shingle. Repeated rows are members of the same class; a null doc_id
joins its class but never names it, unless all ids of the class are null. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, map_batches, release, stash, table, unstash, unused
from .components import components
from .exact_dedup import bounded_broadcast

SHINGLE = 3
RADIUS = 3
SEED = 42
BUCKET = 4096
BITS = 64
#: Shingles whose bits are counted at a time, so that a long text needs little memory.
BLOCK = 1 << 16
#: Shingles with a signed hash below this (three eighths of all) tell which texts may have a similar one.
SAMPLED = -(1 << 61)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : min(n, k + BLOCK)].tolist(), last[k : k + BLOCK].tolist(), strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(x, shingle) for x in byte_rows(batch)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return map_batches(own, kernel, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps, as signed 64-bit integers; radius up to 6.

    The vectors of the bits are spread so that every mask keeps about half of the bits or more: all
    non-zero vectors in turn while there are fewer than bits, else a leading 1 and a counter.
    """
    if not 0 < radius <= 6:
        raise ValueError("radius must be 1 to 6")
    vectors = (1 << (radius + 1)) - 1
    own = [1 + i % vectors if vectors <= BITS else (1 << radius) | (i % (1 << radius)) for i in range(BITS)]
    out = []
    for v in range(1, vectors + 1):
        m = sum(1 << i for i in range(BITS) if (v & own[i]).bit_count() % 2)
        out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among these fingerprints (signed longs, as are the ends of the edges)."""
    edges, left = [], prints.view(np.uint64)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                edges.extend((int(x.view(np.int64)), int(y)) for y in found.view(np.int64))
    return edges


def _bucket_links(radius: int, limit: int):
    """Kernel over rows (t, key, fp) in order of (t, key): links of small buckets (hot false), members of large ones (hot true)."""
    schema = pa.schema([("hot", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32())])

    def out(hot: bool, a, b, t) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(a), hot)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(t, np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
        held, hot = empty, None  # rows of the bucket that is not over; its name while it is a large one

        def closed(t, key, fp):
            cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], cut, [len(t)]))
            edges = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                edges += _forest(fp[bounds[k] : bounds[k + 1]], radius)
            return out(False, [x for x, _ in edges], [y for _, y in edges], np.zeros(len(edges))) if edges else None

        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            if hot is not None:
                n = int(((t == hot[0]) & (key == hot[1])).sum())
                if n:
                    yield out(True, fp[:n], fp[:n], t[:n])
                    t, key, fp = t[n:], key[n:], fp[n:]
                if not len(t):
                    continue
                hot = None
            t, key, fp = (np.concatenate(x) for x in zip(held, (t, key, fp), strict=True))
            begin = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0] != t[-1] or key[0] != key[-1]) else 0
            sizes_cut = np.flatnonzero((t[1:begin] != t[: max(begin - 1, 0)]) | (key[1:begin] != key[: max(begin - 1, 0)])) + 1 if begin > 1 else np.empty(0, np.int64)
            bounds = np.concatenate(([0], sizes_cut, [begin])) if begin else np.array([0])
            large = np.flatnonzero(np.diff(bounds) > limit)
            small = np.ones(begin, bool)
            for k in large:
                part = slice(bounds[k], bounds[k + 1])
                small[part] = False
                yield out(True, fp[part], fp[part], t[part])
            if begin:
                made = closed(t[:begin][small], key[:begin][small], fp[:begin][small])
                if made is not None:
                    yield made
            held = (t[begin:], key[begin:], fp[begin:])
            if len(held[0]) > limit:
                hot = (held[0][0], held[1][0])
                yield out(True, held[2], held[2], held[0])
                held = empty
        if len(held[0]) > 1:
            made = closed(*held)
            if made is not None:
                yield made

    return run


def _large_bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Links that connect the members (t, fp) of large buckets as all pairs within the radius would.

    x and y differ in at most radius bits exactly if flipping some radius//2 bits of one and the rest of
    the other gives the same value. All members at a value hang on one that came by the fewer flips, and
    every such link is within the radius. Only bits that the table's mask leaves out can differ.
    """
    spark = members.sparkSession
    few, many = radius // 2, radius - radius // 2
    flips = []
    for t, mask in enumerate(masks(radius)):
        free = [i for i in range(BITS) if not mask >> i & 1]
        for size in range(many + 1):
            for bits in combinations(free, size):
                value = sum(1 << i for i in bits)
                flips.append((t, value - (1 << BITS) if value >> (BITS - 1) else value, size <= few))
    moves = spark.createDataFrame(flips, "t int, flip long, near boolean")
    at = members.join(F.broadcast(moves), "t").select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"), "near")
    centres = at.filter("near").groupBy("t", "at").agg(F.min("fp").alias("centre"))
    return at.join(centres, ["t", "at"]).filter("fp != centre").select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> tuple[DataFrame, list[str]]:
    """Links (a, b) among distinct fingerprints (fp) that connect what all pairs within the radius connect."""
    fp = F.col("fp")
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])).alias("k"))
    rows = keyed.select("k.t", "k.key", "fp")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, path = stash(rows.repartition(parts, "t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_links(radius, bucket), "hot boolean, a long, b long, t int"))
    small, large = found.filter("not hot").select("a", "b"), found.filter("hot").select("t", F.col("a").alias("fp"))
    return (small if large.isEmpty() else small.unionByName(_large_bucket_links(large, radius))), [path]


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    rows, _ = stash(fingerprints(df, doc_id, text, shingle))
    prints, prints_path = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges, edge_paths = links(prints.select("fp"), radius, bucket)
    joined, joined_path = components(edges)
    # nodes without a link are their own class
    named, _ = stash(prints.join(joined, prints["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    unstash(df.sparkSession, [prints_path, joined_path, *edge_paths])
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(roots, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, size: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _similar(least: float, size: int):
    """Kernel over (a, b, text, other): the pairs whose texts' word shingles have a Jaccard similarity of at least ``least``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        last, held, out = None, set(), []
        for text, other in zip(byte_rows(batch, 2), byte_rows(batch, 3), strict=True):
            if other != last:
                last, held = other, shingle_set(other, size)
            own = shingle_set(text, size)
            shared = len(own & held)
            out.append(shared >= least * (len(own) + len(held) - shared))
        return pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    return kernel


def _tokens(size: int, least: float | None = None):
    """Kernel over (num, text): a row (token, num, n) for each of the n distinct word shingles of a text, as a 64-bit hash.

    With ``least`` only for those below SAMPLED, and n is the least number of these that a text of that similarity
    has too; where that is none, n is 0 and there is one row at least.
    """
    schema = pa.schema([("token", pa.int64()), ("num", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nums, needs, total = [], [], [], 0

        def out() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held])
            columns = np.concatenate(held), np.repeat(np.array(nums, np.int64), sizes), np.repeat(np.array(needs, np.int32), sizes)
            return pa.record_batch([pa.array(x) for x in columns], schema=schema)

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for num, text in zip(batch.column(0).to_pylist(), byte_rows(batch), strict=True):
                own = np.unique(np.array([digest(x, SEED) for x in shingle_set(text, size)], np.uint64).view(np.int64))
                n = len(own)
                if least is not None:
                    part = own[: np.searchsorted(own, SAMPLED)]
                    n = max(0, len(part) - (n - math.ceil(n * least - 1e-9)))
                    own = part if len(part) else own[:1]
                held.append(own)
                nums.append(num)
                needs.append(n)
                total += len(own)
                if total >= BLOCK:
                    yield out()
                    held, nums, needs, total = [], [], [], 0
        if held:
            yield out()

    return run


def _repeated(cap: int):
    """Kernel over rows (token, num, n) in order of (token, num): those of tokens that several texts have, or with n of 0, with their number up to ``cap``."""
    schema = pa.schema([("token", pa.int64()), ("num", pa.int64()), ("n", pa.int32()), ("df", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of the last token so far: held back until their number is known or has reached cap
        token, num, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        hot = last = None

        def out(token, num, n, df) -> pa.RecordBatch:
            return pa.record_batch([pa.array(token), pa.array(num), pa.array(n), pa.array(df.astype(np.int32))], schema=schema)

        for batch in batches:
            t, m, k = (batch.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            # equal texts give equal rows, one after the other
            first = np.concatenate(([last != (t[0], m[0])], (t[1:] != t[:-1]) | (m[1:] != m[:-1])))
            last = (t[-1], m[-1])
            t, m, k = t[first], m[first], k[first]
            if hot is not None:
                of = int(np.searchsorted(t, hot, "right"))
                if of:
                    yield out(t[:of], m[:of], k[:of], np.full(of, cap))
                    t, m, k = t[of:], m[of:], k[of:]
                if not len(t):
                    continue
                hot = None
            token, num, n = np.concatenate((token, t)), np.concatenate((num, m)), np.concatenate((n, k))
            if not len(token):
                continue
            end = int(np.searchsorted(token, token[-1]))
            if end:
                _, inverse, counts = np.unique(token[:end], return_inverse=True, return_counts=True)
                df = np.minimum(counts[inverse], cap)
                many = (df > 1) | (n[:end] == 0)
                if many.any():
                    yield out(token[:end][many], num[:end][many], n[:end][many], df[many])
            token, num, n = token[end:], num[end:], n[end:]
            if len(token) >= cap:
                hot = token[0]
                yield out(token, num, n, np.full(len(token), cap))
                token, num, n = token[:0], num[:0], n[:0]
        if len(token) > 1 or (n == 0).any():
            yield out(token, num, n, np.full(len(token), min(len(token), cap)))

    return run


def promising(texts: DataFrame, shingle: int, least: float) -> tuple[DataFrame, str]:
    """(num) of the texts (num, text) that may have one of similarity ``least`` beside them; no other one has.

    A text of n shingles has at most n - ceil(least * n) that a similar one lacks. So of its shingles below SAMPLED, which
    are the same choice in all texts, no more than that are of this text alone.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = texts.mapInArrow(_tokens(shingle, least), "token long, num long, n int").repartition(parts, "token").sortWithinPartitions("token", "num")
    seen = tokens.mapInArrow(_repeated(2), "token long, num long, n int, df int")
    return stash(seen.groupBy("num", "n").agg(F.count("*").alias("found")).filter("found >= n").select("num"))


def prefixes(texts: DataFrame, shingle: int, least: float, cap: int = BUCKET) -> tuple[DataFrame, str]:
    """(token, num, n, place): the rarest shingles of each text (num, text), such that two texts of similarity ``least`` share one.

    A text with n shingles shares at least least * n of them with a similar one, so among its
    n - ceil(least * n) + 1 first in any order that holds for all texts there is one that both have first.
    The order is by the number of texts that have a shingle (all from ``cap`` on count as equal), then by
    hash. Shingles of one text alone come first and meet nothing: they are counted, not listed.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = texts.mapInArrow(_tokens(shingle), "token long, num long, n int").repartition(parts, "token").sortWithinPartitions("token", "num")
    seen = tokens.mapInArrow(_repeated(cap), "token long, num long, n int, df int")
    ordered = seen.groupBy("num", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
    alone = F.col("n") - F.size("common")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    short = ordered.withColumn("alone", alone).withColumn("listed", F.slice("common", 1, F.greatest(length - F.col("alone"), F.lit(0))))
    return stash(short.select("num", "n", "alone", F.posexplode("listed").alias("at", "x")).select("x.token", "num", "n", (F.col("alone") + F.col("at")).alias("place")))


def _may_be_similar(least: float):
    """Of two rows l and r of prefixes() at one token: whether the lengths, and what follows the token in both, allow ``least``."""
    ln, rn = F.col("l.n"), F.col("r.n")
    shared = F.least(ln - F.col("l.place"), rn - F.col("r.place"))
    return (F.least(ln, rn) >= F.greatest(ln, rn) * least - 1e-9) & (shared >= (ln + rn) * (least / (1 + least)) - 1e-9)


def numbered(rows: DataFrame) -> int:
    """A seed for which the 64-bit numbers of all digests differ."""
    seed = 0
    while not rows.groupBy(F.xxhash64("digest", F.lit(seed)).alias("num")).agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo != hi").isEmpty():
        seed += 1
    return seed


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 6) -> DataFrame:
    """(doc_id, digest) of every row to drop so that one of each group of near duplicates stays, the smallest doc_id.

    Two texts are linked if they share at least ``least`` of their word shingles, and groups are what links
    connect. Candidates are the SimHash links at ``radius``, each text of a prefix token with the first of
    the token, and last all pairs at a prefix token that are not yet connected, so that no link is missed
    that would connect more. Equal texts are one node. A null doc_id stays only if all of its group are null.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")).withColumn("digest", text_digest(F.col("text")))
    plain, plain_path = stash(docs.select("doc_id", "digest").distinct())
    number = F.xxhash64("digest", F.lit(numbered(plain)))
    names = plain.withColumn("num", number)
    texts = docs.select(number.alias("num"), "text")

    rows, rows_path = stash(fingerprints(texts, "num", "text").distinct().withColumnRenamed("doc_id", "num"))
    prints, prints_path = stash(rows.groupBy("fp").agg(F.min("num").alias("first")))
    edges, edge_paths = links(prints.select("fp"), radius)
    name = lambda side: prints.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_id"))
    linked = edges.distinct().join(name("a"), "a").join(name("b"), "b").select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b"))
    equal = rows.join(prints, "fp").filter("num != first").select(F.col("num").alias("a"), F.col("first").alias("b"))

    release(spark)
    hopeful, hopeful_path = promising(texts, shingle, least)
    release(spark)
    rare, rare_path = prefixes(texts.join(bounded_broadcast(hopeful), "num", "left_semi"), shingle, least)
    unstash(spark, [hopeful_path])
    release(spark)
    firsts = rare.groupBy("token").agg(F.min(F.struct("num", "n", "place")).alias("f"), F.count("*").alias("rows")).filter("rows > 1").select("token", "f.*")
    stars = rare.alias("l").join(firsts.alias("r"), "token").filter("l.num != r.num").filter(_may_be_similar(least)).select(F.col("l.num").alias("a"), F.col("r.num").alias("b"))
    tried, tried_path = stash(linked.unionByName(equal).unionByName(stars).distinct())
    unstash(spark, [rows_path, prints_path, *edge_paths])

    def verified(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
        wanted = pairs.select(F.col("a").alias("num")).unionByName(pairs.select(F.col("b").alias("num"))).distinct()
        held, held_path = stash(texts.join(bounded_broadcast(wanted), "num").dropDuplicates(["num"]))
        both = pairs.join(held.select(F.col("num").alias("a"), "text"), "a").join(held.select(F.col("num").alias("b"), F.col("text").alias("other")), "b").select("a", "b", "text", "other")
        counted, counted_path = stash(map_batches(both, _similar(least, shingle), "a long, b long"))
        unstash(spark, [held_path])
        return counted, [counted_path]

    counted, counted_paths = verified(tried)
    joined, joined_path = components(counted)

    # pairs that nothing connects yet, at tokens of more than one group
    grouped, grouped_path = stash(rare.join(joined.select(F.col("node").alias("num"), "root"), "num", "left").withColumn("root", F.coalesce("root", "num")))
    mixed = grouped.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token")
    open_rows, open_path = stash(grouped.join(mixed, "token", "left_semi"))
    apart = open_rows.alias("l").join(open_rows.alias("r"), "token").filter((F.col("l.num") > F.col("r.num")) & (F.col("l.root") != F.col("r.root"))).filter(_may_be_similar(least))
    fresh, fresh_path = stash(apart.select(F.col("l.num").alias("a"), F.col("r.num").alias("b")).distinct())
    more, more_paths = verified(fresh)
    unstash(spark, [rare_path, tried_path, joined_path, grouped_path, open_path, fresh_path])
    joined, joined_path = components(counted.unionByName(more))

    whole = names.join(joined.withColumnRenamed("node", "num"), "num", "left").select("doc_id", "digest", F.coalesce("root", "num").alias("root"))
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    stays = whole.groupBy("root").agg(F.min(rank).alias("stays"), F.count("*").alias("rows")).filter("rows > 1")
    gone, _ = stash(whole.join(stays, "root").filter(rank != F.col("stays")).select("doc_id", "digest"))
    unstash(spark, [plain_path, joined_path, *counted_paths, *more_paths])
    return gone


def filter_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 6) -> DataFrame:
    """df without the rows of duplicates(), all of df's columns."""
    id_, digest = unused(df, "__id", "__digest")
    gone = bounded_broadcast(duplicates(df, doc_id, text, shingle, least, radius).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)))
    return df.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (text_digest(F.col(f"`{text}`")) == F.col(digest)), "left_anti")
