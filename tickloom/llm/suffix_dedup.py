"""Operator 7: remove bytes of passages of 50 bytes or more that an earlier document has, by a hash-compared suffix sort.

Suffixes are brought together by anchors instead of one global array. An anchor is a 24-byte string whose
hash is least among all that begin in some 27 neighbouring places, so each 50-byte string holds one, at
a place that its own bytes decide: equal strings meet at equal anchors, about one for 14 bytes.

1. Documents go in packs of about PACK bytes, named by their content. Each task sends the hashes of a
   pack's anchors, once each, to buckets by hash. A bucket answers each pack with a bit for each of its
   hashes: whether several documents have it. Packs and answers meet by the pack's name, so the plan is
   the same at every size and nothing is broadcast.
2. Each 50-byte string belongs to its anchor of least hash. For repeated anchors a task takes the bytes of
   the strings that belong to them, up to 26 on both sides. An occurrence whose bytes equal those of a
   smaller doc_id in the same pack (by hash, then by the bytes) is settled there. The rest go to buckets.
3. In a bucket the suffixes that begin at anchors are sorted in merges. Two suffixes are compared by their
   common extension, found by binary search over prefix polynomial hashes, and the byte after it. The
   suffixes that begin 1 to 26 bytes before are put in order by that byte and the order found so far.
   Runs of neighbours that share 50 bytes are equal strings, and the smallest doc_id of a run stays. Each
   match is compared byte by byte, so a collision of hashes removes nothing.

A byte is removed if a 50-byte string over it also starts in a document with a smaller doc_id, judged on
the input. Null and empty texts have no bytes; texts under 50 bytes stay whole; matches never cross
documents (documents are kept apart by a byte that UTF-8 does not have). Equal passages within one
document or under the same doc_id remove nothing; rows that share a doc_id keep spans of their own, by the
hash of id and text. Rows with a null doc_id count as smaller than all others. Extra columns play no part;
empty tables give empty results. All occurrences of one anchor meet in one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, parts_of, release, stash, table, unstash

LENGTH = 50
GRAM = 24
SIDE = LENGTH - GRAM  # bytes on either side that a string over the anchor can have
AROUND = SIDE + GRAM + SIDE
GAP = b"\xff" * AROUND  # between documents
#: Bytes of text in a pack, that are looked at at a time, and for which a bucket of anchors and one of hashes is made.
PACK = 1 << 23
BLOCK = 1 << 22
BUCKET_BYTES = 1 << 23
HASH_BYTES = 1 << 25
LEAST = -(1 << 63)  # stands for a null doc_id

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_RECORD = np.dtype([("h", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("own", "<i8"), ("at", "<i4"), ("n", "<i4"), ("place", "<i4"), ("left", "i1"), ("right", "i1")])
_SPAN = np.dtype([("begin", "<i8"), ("end", "<i8")])
_TRIPLE = np.dtype([("own", "<i8"), ("begin", "<i8"), ("end", "<i8")])


def _loads(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as an integer."""
    return np.ndarray((n,), "<u8", data, 0, (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x = x * _A
    return x ^ (x >> _U(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    x = _loads(data, n + 16)
    return _mixed(x[:n] * _A + _mixed(x[8 : n + 8] * _B) + x[16 : n + 16] * _C)


def _row_hashes(near: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of bytes."""
    words = np.zeros((len(near), -(-AROUND // 8)), _U)
    words.view(np.uint8)[:, :AROUND] = near
    h = np.zeros(len(near), _U)
    for k in range(words.shape[1]):
        h = _mixed(h * _B + words[:, k] * _C + _A)
    return h


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a block of documents with gaps around them, and the least hash of each string of LENGTH bytes."""
    h = _gram_hashes(data)
    bad = np.concatenate(([0], np.cumsum(data == 0xFF)))
    h[bad[GRAM:] - bad[:-GRAM] > 0] = _U(2**64 - 1)
    least = _slide(h, SIDE + 1, np.minimum)
    # a place is an anchor if its hash is the least of some run over it
    padded = np.concatenate((np.zeros(SIDE, _U), least, np.zeros(SIDE, _U)))
    most = _slide(padded, SIDE + 1, np.maximum)
    at = np.flatnonzero((most == h) & (h != _U(2**64 - 1)))
    return at, h[at], least


def _claimed(at: np.ndarray, h: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far before each anchor the first and the last string begin that has no smaller hash than the anchor's."""
    first, last = np.full(len(at), -1, np.int8), np.full(len(at), -1, np.int8)
    for k in range(SIDE + 1):
        begin = at - k
        own = (begin >= 0) & (begin < len(least))
        own[own] = least[begin[own]] == h[own]
        first[own] = k
        last[own & (last < 0)] = k
    return first, last


def _blocks(docs: np.ndarray, owns: np.ndarray, sizes: np.ndarray, text: bytes, claims: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block by block of a pack: the bytes with gaps around documents, and an anchor record for each place (all but around; left and right if ``claims``)."""
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK)) + 1).tolist(), len(sizes)]
    raw = np.frombuffer(text, np.uint8)
    for low, high in zip(cuts, cuts[1:], strict=False):
        size, end = sizes[low:high], ends[low:high]
        data = np.full(int(size.sum()) + AROUND * (len(size) + 1), 0xFF, np.uint8)
        begins = AROUND + np.cumsum(size) - size + AROUND * np.arange(len(size))
        for begin, until, n in zip(begins.tolist(), end.tolist(), size.tolist(), strict=True):
            data[begin : begin + n] = raw[until - n : until]
        at, h, least = anchors(data)
        doc = np.searchsorted(begins, at, "right") - 1
        r = np.zeros(len(at), _RECORD)
        r["h"], r["doc"], r["own"], r["at"], r["n"], r["place"] = h, docs[low + doc], owns[low + doc], at - begins[doc], size[doc], at
        if claims:
            r["left"], r["right"] = _claimed(at, h, least)
        yield data, r


def _surroundings(data: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records that claim a string inside their document, and the bytes around them; bytes of no claimed string are as a gap."""
    begin, end = np.maximum(r["at"] - r["left"], 0), np.minimum(r["at"] - r["right"] + LENGTH, r["n"])
    r = r[(r["left"] >= 0) & (end - begin >= LENGTH)]
    around = np.arange(AROUND)
    near = data[(r["place"] - SIDE)[:, None] + around]
    near[(around < (SIDE - r["left"])[:, None]) | (around >= (AROUND - r["right"])[:, None])] = 0xFF
    return r, near


def _settled(r: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by anchor, surroundings and doc, and which of them repeat a smaller doc's in full; near: the bytes of each place."""
    r = r[np.lexsort((r["doc"], r["around"], r["h"]))]
    if not len(r):
        return r, np.empty(0, bool)
    start = np.concatenate(([True], (r["h"][1:] != r["h"][:-1]) | (r["around"][1:] != r["around"][:-1])))
    first = np.flatnonzero(start)[np.cumsum(start) - 1]
    full = r["doc"] > r["doc"][first]
    at = np.flatnonzero(full)
    full[at] = (near[r["place"][at]] == near[r["place"][first[at]]]).all(1)
    return r, full


def _full_spans(r: np.ndarray) -> np.ndarray:
    """The spans of the strings that records claim."""
    return _by_owner(r["own"], np.maximum(r["at"] - r["left"], 0), np.minimum(r["at"] - r["right"] + LENGTH, r["n"]))


def _by_owner(own: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans merged within each document, as (own, begin, end)."""
    order = np.lexsort((begin, own))
    own, begin, end = own[order], begin[order], end[order]
    first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.empty(0, bool)
    shift = (np.cumsum(first) - 1) << 40  # a place of its own for each document
    m = merged(begin + shift, end + shift) if len(own) else np.empty(0, _SPAN)
    out, rank = np.empty(len(m), _TRIPLE), m["begin"] >> 40
    out["own"], out["begin"], out["end"] = own[first][rank], m["begin"] - (rank << 40), m["end"] - (rank << 40)
    return out


def _to_documents(spans: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Rows of spans for the buckets of their documents."""
    return [(0, bucket, spans[part].tobytes()) for bucket, part in _parts((_mixed(spans["own"].view(_U)) % _U(buckets)).astype(np.int64))]


def merged(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of spans given in order of begin."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > reach[:-1]))
    out = np.empty(int(new.sum()), _SPAN)
    out["begin"], out["end"] = begin[new], reach[np.concatenate((new[1:], [True]))]
    return out


#: kind: 0 spans of a bucket of documents, 1 something for a bucket of anchors.
ROWS = "kind int, id long, data binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("data", pa.binary())])


def _out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places in the array), each bucket once."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Documents (doc, own, text) in packs: name, docs, owns, sizes, bytes. Equal packs have equal names and equal answers."""
    for batch in batches:
        for part in parts_of(batch, PACK, 2):
            texts = byte_rows(part, 2)
            docs, owns, sizes, data = part.column(0).to_numpy(), part.column(1).to_numpy(), np.array([len(x) for x in texts], np.int64), b"".join(texts)
            name = hashlib.md5(docs.tobytes() + owns.tobytes() + sizes.tobytes() + data, usedforsecurity=False).digest()
            yield name, docs, owns, sizes, data


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, docs, owns, sizes, data in _packs(batches):
        yield pa.record_batch([pa.array([x], pa.binary()) for x in (name, docs.tobytes(), owns.tobytes(), sizes.tobytes(), data)], ["pack", "docs", "owns", "sizes", "data"])


def _hashes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchor hashes of a pack for each bucket: a flag each for several documents, then their gaps by byte planes."""
        for name, docs, owns, sizes, data in _packs(batches):
            each = [(r["h"].copy(), r["doc"].copy()) for _, r in _blocks(docs, owns, sizes, data, False)]
            h, doc = (np.concatenate(x) for x in zip(*each, strict=True))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            h, ids, blobs = h[first], [], []
            for bucket, part in _parts((h % _U(buckets)).astype(np.int64)):
                gaps = np.diff(h[part], prepend=_U(0))
                ids.append(bucket)
                blobs.append(many[part].tobytes() + gaps.view(np.uint8).reshape(-1, 8).T.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.binary()), pa.array(blobs, pa.binary())], ["bucket", "pack", "data"])

    return run


def _answers(group: pa.Table) -> pa.Table:
    """For each pack a bit for each of its hashes in this bucket: whether several documents have it."""
    found, many = [], []
    for blob in group.column("data").to_pylist():
        n = len(blob) // 9
        many.append(np.frombuffer(blob, bool, n))
        found.append(np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, n).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64))
    h, flag = np.concatenate(found), np.concatenate(many)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    sizes = np.diff(np.append(start, len(h)))
    wanted = np.empty(len(h), bool)
    wanted[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(flag[order], start), sizes)
    ends = np.cumsum([len(x) for x in found])
    bits = [np.packbits(wanted[e - len(x) : e]).tobytes() for x, e in zip(found, ends.tolist(), strict=True)]
    return pa.table({"pack": group.column("pack"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _find(hash_buckets: int, buckets: int):
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        """Spans of what repeats within a pack, and surroundings of the other repeated anchors for the buckets."""
        bits, rows = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)), []
        for docs, owns, sizes, text in zip(*(packs.column(c).to_pylist() for c in ("docs", "owns", "sizes", "data")), strict=True):
            each = list(_blocks(np.frombuffer(docs, np.int64), np.frombuffer(owns, np.int64), np.frombuffer(sizes, np.int64), text))
            distinct = np.unique(np.concatenate([r["h"] for _, r in each]))
            wanted = np.zeros(len(distinct), bool)
            for bucket, part in _parts((distinct % _U(hash_buckets)).astype(np.int64)):
                wanted[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(part)).astype(bool)
            repeated = distinct[wanted]
            each = [_surroundings(data, r[np.isin(r["h"], repeated)]) for data, r in each]
            r, near = (np.concatenate(x) for x in zip(*each, strict=True))
            r["around"], r["place"] = _row_hashes(near), np.arange(len(r))
            r, full = _settled(r, near)
            rows += _to_documents(_full_spans(r[full]), buckets)
            r = r[~full]
            for bucket, part in _parts((r["h"] % _U(buckets)).astype(np.int64)):
                x = r[part]
                rows.append((1, bucket, x["h"].tobytes() + x["doc"].tobytes() + x["own"].tobytes() + x["at"].astype("<u4").tobytes() + near[x["place"]].tobytes()))
        return pa.Table.from_batches([_out(rows)])

    return run


class Suffixes:
    """Suffixes of short strings (rows of bytes) that begin at any of their places, compared by prefix polynomial hashes."""

    BASE = _U(0x100000001B3)

    def __init__(self, near: np.ndarray):
        n, self.width = len(near), near.shape[1] + 1
        hashes = np.zeros((n, self.width), _U)
        for i in range(near.shape[1]):
            hashes[:, i + 1] = hashes[:, i] * self.BASE + near[:, i].astype(_U) + _U(1)
        self.near, self.flat = near, hashes.ravel()
        self.power = np.array([pow(int(self.BASE), i, 2**64) for i in range(self.width)], _U)

    def same(self, x: np.ndarray, y: np.ndarray, k: int, length) -> np.ndarray:
        """Whether ``length`` bytes from place k have equal hashes in rows x and y."""
        x, y, power = x * self.width + k, y * self.width + k, self.power[length]
        return self.flat[x + length] - self.flat[x] * power == self.flat[y + length] - self.flat[y] * power

    def common(self, x: np.ndarray, y: np.ndarray, k: int, most: int) -> np.ndarray:
        """Length of the common extension from place k, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
        for _ in range(most.bit_length()):
            middle = (low + high + 1) >> 1
            equal = self.same(x, y, k, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def precedes(self, x: np.ndarray, y: np.ndarray, k: int, most: int, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix of x from k comes before that of y (equal ones: as ``ties`` says)."""
        shared = self.common(x, y, k, most)
        after = np.minimum(k + shared, self.near.shape[1] - 1)
        return np.where(shared == most, ties, self.near[x, after] < self.near[y, after])

    def merge_sorted(self, order: np.ndarray, begins: np.ndarray, sizes: np.ndarray, k: int, most: int) -> np.ndarray:
        """Sort each group (a run of ``order`` from ``begins``) by suffix: merges of runs of 1, 2, 4, ... rows, all groups side by side."""
        width = 1
        while width < sizes.max(initial=0):
            big = np.flatnonzero(sizes > width)
            slot = np.repeat(begins[big] - np.concatenate(([0], np.cumsum(sizes[big])[:-1])), sizes[big]) + np.arange(sizes[big].sum())
            begin, end = np.repeat(begins[big], sizes[big]), np.repeat(begins[big] + sizes[big], sizes[big])
            run = (slot - begin) // width
            other = begin + (run ^ 1) * width
            low, high = np.minimum(other, end), np.minimum(other + width, end)
            mine, left = order[slot], run & 1 == 0
            for _ in range(width.bit_length()):
                going = np.flatnonzero(low < high)
                middle = (low[going] + high[going]) >> 1
                before = self.precedes(order[middle], mine[going], k, most, ~left[going])
                low[going] = np.where(before, middle + 1, low[going])
                high[going] = np.where(before, high[going], middle)
            merged_at = begin + (run & ~1) * width + (slot - begin - run * width) + (low - np.minimum(other, end))
            out = order.copy()
            out[merged_at] = mine
            order, width = out, 2 * width
        return order


def _compare(group: pa.Table, buckets: int) -> pa.Table:
    """A bucket's suffixes over its anchors in order, and the spans of those that a smaller doc_id has too."""
    kinds, ids, blobs = (group.column(c).to_pylist() for c in ("kind", "id", "data"))
    rows = [(0, i, b) for k, i, b in zip(kinds, ids, blobs, strict=True) if k == 0]  # settled before
    parts = [(b, len(b) // (28 + AROUND)) for k, b in zip(kinds, blobs, strict=True) if k == 1]
    if not parts:
        return pa.Table.from_batches([_out(rows)])
    h, doc, own = (np.concatenate([np.frombuffer(b, t, m, i * 8 * m) for b, m in parts]) for i, t in enumerate(("<u8", "<i8", "<i8")))
    at = np.concatenate([np.frombuffer(b, "<u4", m, 24 * m) for b, m in parts]).astype(np.int64)
    near = np.concatenate([np.frombuffer(b, np.uint8, AROUND * m, 28 * m).reshape(m, AROUND) for b, m in parts])
    n, suffixes = len(h), Suffixes(near)
    outside = np.concatenate((np.zeros((n, 1), np.int32), np.cumsum(near == 0xFF, 1, dtype=np.int32)), 1)
    low, high = np.full(n, AROUND, np.int64), np.zeros(n, np.int64)
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, n))
    anchor = np.empty(n, np.int64)
    anchor[order] = np.cumsum(new) - 1
    order = suffixes.merge_sorted(order, begins, sizes, SIDE, LENGTH)
    for k in range(SIDE, -1, -1):
        if k < SIDE:  # one byte more in front
            order = order[np.argsort(anchor[order] * 256 + near[order, k], kind="stable")]
        inside = order[outside[order, k + LENGTH] == outside[order, k]]
        if len(inside) < 2:
            continue
        first = np.concatenate(([True], (anchor[inside[1:]] != anchor[inside[:-1]]) | ~suffixes.same(inside[1:], inside[:-1], k, LENGTH)))
        of, owner = np.cumsum(first) - 1, doc[inside]
        least = np.minimum.reduceat(owner, np.flatnonzero(first))
        stays = np.empty(len(least), np.int64)
        hit = np.flatnonzero(owner == least[of])
        stays[of[hit]] = inside[hit]
        later = owner > least[of]
        mine, source = inside[later], stays[of[later]]
        mine = mine[(near[mine, k : k + LENGTH] == near[source, k : k + LENGTH]).all(1)]
        low[mine] = np.minimum(low[mine], k)
        high[mine] = np.maximum(high[mine], k + LENGTH)
    found = high > 0
    # each of a place's matches covers its anchor, so together they are one span
    begin = at[found] - SIDE
    rows += _to_documents(_by_owner(own[found], begin + low[found], begin + high[found]), buckets)
    return pa.Table.from_batches([_out(rows)])


def _collect(group: pa.Table) -> pa.Table:
    """All spans of a bucket's documents, a row for each document."""
    t = np.frombuffer(b"".join(group.column("data").to_pylist()), _TRIPLE)
    t = _by_owner(t["own"], t["begin"], t["end"])
    cuts = np.flatnonzero(np.diff(t["own"])) + 1
    parts = [x for x in np.split(t, cuts) if len(x)]
    blobs = [np.stack((x["begin"], x["end"]), 1).tobytes() for x in parts]
    return pa.table({"id": pa.array([int(x["own"][0]) for x in parts], pa.int64()), "data": pa.array(blobs, pa.binary())})


def repeatable(df: DataFrame) -> bool:
    """Whether each read of df gives the same rows in the same order: columns and filters over files, nothing behind a shuffle."""

    def plain(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in ("Project", "Filter", "LogicalRelation") and all(plain(children.apply(k)) for k in range(children.size()))

    plan = df._jdf.queryExecution().optimizedPlan()
    return bool(plan.deterministic()) and plain(plan)


def spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, data): the spans to remove of each document that has any, by the hash of id and text (own).

    Packs are cut twice, once for their hashes and once for their bytes; an input that may come in another order is written first.
    """
    docs = _documents(df, doc_id, text)
    if not repeatable(df):
        docs, _ = stash(docs)
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets, hash_buckets = max(1, int(size // BUCKET_BYTES)), max(1, int(size // HASH_BYTES))
    spark = df.sparkSession
    answers, answers_path = stash(docs.mapInArrow(_hashes(hash_buckets), "bucket long, pack binary, data binary").groupBy("bucket").applyInArrow(_answers, "pack binary, bucket long, bits binary"))
    packs = docs.mapInArrow(_pack_rows, "pack binary, docs binary, owns binary, sizes binary, data binary")
    found = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_find(hash_buckets, buckets), ROWS)
    release(spark)
    every, _ = stash(found.groupBy("id").applyInArrow(lambda group: _compare(group, buckets), ROWS))
    del found, packs
    unstash(spark, [answers_path])
    release(spark)
    return every.groupBy("id").applyInArrow(_collect, "id long, data binary")


def _documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    doc, body = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LEAST)), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return df.select(doc.alias("doc"), F.xxhash64(doc, body).alias("own"), body.alias("text"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row with the bytes that remain."""
    docs = _documents(df, doc_id, text)
    joined = docs.join(spans(df, doc_id, text), F.col("own") == F.col("id"), "left").select("doc", "text", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, body, blobs in zip(batch.column(0).to_pylist(), byte_rows(batch), batch.column(2).to_pylist(), strict=True):
                s = np.frombuffer(blobs or b"", _SPAN)
                s = s[np.argsort(s["begin"], kind="stable")]
                s = s[s["end"] <= len(body)]
                if len(s):
                    s = merged(s["begin"], s["end"])
                kept, at = [], 0
                for a, b in s.tolist():
                    kept.append(body[at:a])
                    at = b
                kept.append(body[at:])
                left = b"".join(kept)
                rows.append((None if doc == LEAST else doc, len(body), len(body) - len(left), len(s), left))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, RESULT)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
