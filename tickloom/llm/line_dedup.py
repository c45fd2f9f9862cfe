"""Operator 1: lines that come again, equal or one word apart, by a deletion-neighbourhood join.

Lines are compared as lower-cased word sequences. Two lines are within one edit exactly if they are
equal, if deleting the same place of both gives the same words (a substitution), or if deleting a place
of one gives the other (an insertion). So each line emits the hash of itself and, with its place, of
each variant with one word deleted; lines meet at equal keys. All lines at a substitution key are
within one edit of each other, and all at an insertion key of its whole line, so the earliest line at
the key decides without listing pairs; the pair with that line is verified on the words.

A line goes if an earlier line (smaller doc_id, then line number, over all documents) is within one
edit; it is judged on the input, whether or not the earlier line stays. Lines with fewer than MIN_WORDS
words (in scripts without spaces a line is one word) go only if they equal an earlier line, in the query
all but blank lines; ``equal_words`` sets how many words a line needs for that. Equal lines are collapsed first. Words are fetched only of lines that share a half
with another line: one edit leaves the first or the second half of the shorter line untouched. For the same reason two such
lines share all but one of their PARTS parts, and a line emits only the variants without a word of a part that it may differ in.

Null and empty texts have one empty line, which stays. Rows that repeat a doc_id and line are one place
and do not drop each other; rows of one doc_id with different lines keep apart by the line's digest. A
null doc_id sorts first. A line of n words has n variants and costs work in proportion to n. Extra columns play no part; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, map_batches, parts_of, release, stash, table, unstash
from .exact_dedup import bounded_broadcast

MIN_WORDS = 5
#: Parts of a line of which one edit leaves all but one untouched.
PARTS = 8
#: Bytes of text that are cut into lines at a time.
BLOCK = 1 << 21
#: Bytes with A-Z in lower case and all white space but the line feed as a space.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[[9, 11, 12, 13]] = 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_A, _B = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of_line(line: bytes) -> list[bytes]:
    return line.lower().split()


def digest(joined: bytes) -> bytes:
    return hashlib.md5(joined, usedforsecurity=False).digest()


class Lines:
    """Lines of texts as lower-cased words with one space between: bytes, and hashes of any run of words.

    A word's hash is a polynomial of its bytes; a run's is a polynomial of its words, taken from sums over
    all words of the block, so a run without one of its words costs no more than a run.
    """

    def __init__(self, texts: list[bytes]):
        raw = FOLDED[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        space, feed = raw == 0x20, raw == 0x0A
        gap = space | feed
        after = np.concatenate(([True], gap[:-1]))  # the byte before is a gap
        kept = feed | ~space | (space & ~after)
        data = raw[kept]
        # a space before a line's end stays in the bytes and is cut off by the lines' ends
        feeds = np.flatnonzero(data == 0x0A)
        self.begins = np.concatenate(([0], feeds[:-1] + 1)) if len(feeds) else np.empty(0, np.int64)
        self.ends = feeds - ((feeds > self.begins) & (data[np.maximum(feeds - 1, 0)] == 0x20))
        self.text_of = np.repeat(np.arange(len(texts)), [x.count(b"\n") + 1 for x in texts])
        first_line = np.concatenate(([0], np.cumsum([x.count(b"\n") + 1 for x in texts])[:-1])) if texts else np.empty(0, np.int64)
        self.number = np.arange(len(feeds)) - first_line[self.text_of] if len(feeds) else np.empty(0, np.int64)
        self.bytes = data.tobytes()
        letter = (data != 0x20) & (data != 0x0A)
        word_begin = np.flatnonzero(letter & np.concatenate(([True], ~letter[:-1])))
        word_end = np.flatnonzero(letter & np.concatenate((~letter[1:], [True]))) + 1
        longest = int((word_end - word_begin).max(initial=1))
        place = np.zeros(len(data), np.int64)
        place[letter] = np.arange(len(data))[letter] - np.repeat(word_begin, word_end - word_begin)
        sums = np.concatenate(([_U(0)], np.cumsum(np.where(letter, (data.astype(_U) + _U(1)) * _powers(_BASE, longest)[place], _U(0)), dtype=_U)))
        hashes = _mixed(sums[word_end] - sums[word_begin] + (word_end - word_begin).astype(_U))
        #: Words before each line, and after the last.
        self.words = np.searchsorted(word_begin, np.append(self.begins, len(data)))
        self.count = np.diff(self.words)
        most = int(self.count.max(initial=1)) + 1
        at = np.arange(len(hashes)) - np.repeat(self.words[:-1], self.count)
        self.sums = np.concatenate(([_U(0)], np.cumsum(hashes * _powers(_BASE, most)[at], dtype=_U)))
        self.back = _powers(_INVERSE, most + 1)

    def run(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words a to b of lines."""
        w = self.words[line]
        return _mixed((self.sums[w + b] - self.sums[w + a]) * self.back[a] + (b - a).astype(_U))

    def joined(self, line: int) -> bytes:
        return self.bytes[self.begins[line] : self.ends[line]]

    def halves(self, line: np.ndarray) -> list[np.ndarray]:
        """Keys of which lines within one edit share one: halves as the shorter line of a pair and as the longer one."""
        n, out, zero = self.count[line], [], np.zeros(len(line), np.int64)
        for m in (n, n - 1):
            half = m // 2
            out.append(_mixed(self.run(line, zero, half) + m.astype(_U) * _U(2)))
            out.append(_mixed(self.run(line, n - (m - half), n) + m.astype(_U) * _U(2) + _U(1)))
        return out

    def parts(self, line: np.ndarray) -> np.ndarray:
        """Keys of all but one part, a column for each part as the shorter line of a pair (or as long as the other), then as the longer one."""
        n, out, zero = self.count[line], [], np.zeros(len(line), np.int64)
        for m in (n, n - 1):
            for j in range(PARTS):
                a, b = m * j // PARTS, m * (j + 1) // PARTS
                around = _mixed(self.run(line, zero, a) + _A) + self.run(line, n - (m - b), n)
                out.append(_mixed(around + m.astype(_U) * _U(PARTS) + _U(j)))
        return np.stack(out, 1)

    def variants(self, line: np.ndarray, open_parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``line``, key, role) of the whole lines (role 2) and of each line without one word, alone (1) and with its place (0).

        ``open_parts`` has a bit for each column of parts() that another line has too: only words of such parts are left out,
        for role 0 and 2 where the line is the shorter one, for role 1 where it is the longer one.
        """
        n = self.count[line]
        bits = np.full(len(line), (1 << 2 * PARTS) - 1) if open_parts is None else np.asarray(open_parts, np.int64)
        of = np.repeat(np.arange(len(line)), n)
        i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        wanted = [np.zeros(len(of), bool), np.zeros(len(of), bool)]
        for longer in (0, 1):
            m = n - longer
            for j in range(PARTS):
                a, b = m * j // PARTS, m * (j + 1) // PARTS + longer
                wanted[longer] |= (bits >> (longer * PARTS + j) & 1).astype(bool)[of] & (i >= a[of]) & (i < b[of])
        any_word = wanted[0] | wanted[1]
        of, i, same, shorter = of[any_word], i[any_word], wanted[0][any_word], wanted[1][any_word]
        w, size = self.words[line][of], n[of]
        left = self.sums[w + i] - self.sums[w]
        right = (self.sums[w + size] - self.sums[w + i + 1]) * self.back[1]
        cut = _mixed(left + right + (size - 1).astype(_U))
        entire = np.flatnonzero(bits & ((1 << PARTS) - 1))
        whole = self.run(line[entire], np.zeros(len(entire), np.int64), n[entire])
        keys = np.concatenate((whole, cut[shorter], _mixed(cut + i.astype(_U) + _A)[same]))
        roles = np.repeat(np.array([2, 1, 0], np.int8), [len(entire), int(shorter.sum()), int(same.sum())])
        return np.concatenate((entire, of[shorter], of[same])), keys, roles


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """True if one substitution, insertion or deletion of a word at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    # tells rows apart by id and text, so that rows without an id do not share one list of lines
    return rows.withColumn("own", F.xxhash64("doc_id", "text"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for part in parts_of(batch, BLOCK):
        yield part, Lines(byte_rows(part))


def _places(least: int):
    """Kernel: each line with at least ``least`` words: its place, digest and, of MIN_WORDS words or more, halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lines in _blocks(batch):
                at = np.flatnonzero(lines.count >= max(1, least))
                long = lines.count[at] >= MIN_WORDS
                keys = np.stack(lines.halves(at[long]), 1).ravel().view(np.int64)
                ends = np.concatenate(([0], np.cumsum(4 * long))).astype(np.int32)
                columns = [part.column(0).take(pa.array(lines.text_of[at])), pa.array(lines.number[at], pa.int32()), pa.array([digest(lines.joined(i)) for i in at.tolist()], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)), part.column(2).take(pa.array(lines.text_of[at]))]
                yield pa.record_batch(columns, ["doc_id", "line", "digest", "halves", "own"])

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: digest and words of each line of MIN_WORDS words or more."""
    for batch in batches:
        for _, lines in _blocks(batch):
            seen = {digest(x): x for x in map(lines.joined, np.flatnonzero(lines.count >= MIN_WORDS).tolist())}
            yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["digest", "words"])


def _part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over (digest, words): a row for each column of parts()."""
    for batch in batches:
        for part, lines in _blocks(batch):
            keys = lines.parts(np.arange(part.num_rows)).view(np.int64)
            rows = pa.array(np.repeat(np.arange(part.num_rows), 2 * PARTS))
            yield pa.record_batch([part.column(0).take(rows), pa.array(np.tile(np.arange(2 * PARTS, dtype=np.int32), part.num_rows)), pa.array(keys.ravel())], ["digest", "at", "key"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over (digest, words, first, bits): the variants."""
    for batch in batches:
        for part, lines in _blocks(batch):
            at, keys, roles = lines.variants(np.arange(part.num_rows), part.column(3).to_numpy())
            rows = pa.array(at)
            yield pa.record_batch([part.column(0).take(rows), pa.array(keys.view(np.int64)), pa.array(roles), part.column(2).take(rows)], ["digest", "key", "role", "first"])


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    ok = [within_one(a.split(b" "), b.split(b" ")) for a, b in zip(byte_rows(batch, 1), byte_rows(batch, 2), strict=True)]
    return pa.record_batch([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["digest"])


def _candidates(docs: DataFrame, first: DataFrame) -> tuple[DataFrame, list[str]]:
    """(digest, words, first) of the distinct lines that share a half with another line."""
    # a line has each of its keys once, so a key that comes twice is of two lines; a line's hash stands for its digest
    keyed = first.select(F.xxhash64("digest").alias("wanted"), F.explode("halves").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    near, near_path = stash(keyed.join(shared, "key").select("wanted").distinct())
    found = docs.select("doc_id", "text").mapInArrow(_texts, "digest binary, words binary")
    held = found.join(bounded_broadcast(near), F.xxhash64("digest") == F.col("wanted"), "left_semi").groupBy("digest").agg(F.first("words").alias("words"))
    candidates, path = stash(held.join(first.select("digest", "first"), "digest"))
    unstash(docs.sparkSession, [near_path])
    return candidates, [path]


def _near_an_earlier(candidates: DataFrame) -> DataFrame:
    """(digest, near) of the lines within one edit of an earlier one that is not equal."""
    spark = candidates.sparkSession
    parts, parts_path = stash(candidates.select("digest", "words").mapInArrow(_part_keys, "digest binary, at int, key long"))
    shared = parts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    bits = parts.join(shared, "key").groupBy("digest").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at"))).alias("bits"))
    emitted, path = stash(candidates.join(bits, "digest").select("digest", "words", "first", "bits").mapInArrow(_emit, "digest binary, key long, role byte, first struct<known:boolean,doc_id:bigint,line:int>"))
    unstash(spark, [parts_path])
    who = F.struct("first", "digest")
    met = emitted.groupBy("key", (F.col("role") == 0).alias("same")).agg(
        F.min(who).alias("any"), F.min(F.when(F.col("role") == 2, who)).alias("whole"), F.min(F.when(F.col("role") == 1, who)).alias("cut"), F.count("*").alias("n")
    ).filter("n > 1")
    # the earliest line on the other side of the key
    joined = emitted.withColumn("same", F.col("role") == 0).join(met, ["key", "same"])
    other = F.when(F.col("role") == 0, F.col("any")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("cut"))
    pairs = joined.select("digest", "first", other.alias("o")).filter("o is not null and o.first < first").select("digest", F.col("o.digest").alias("earlier")).distinct()
    words = candidates.select("digest", "words")
    both = pairs.join(words, "digest").join(words.select(F.col("digest").alias("earlier"), F.col("words").alias("earlier_words")), "earlier").select("digest", "words", "earlier_words")
    near, _ = stash(map_batches(both, _verify, "digest binary").distinct().withColumn("near", F.lit(True)))
    unstash(spark, [path])
    return near


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", equal_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, line, digest, own) of each line to remove; own is the hash of its row's id and text."""
    spark = df.sparkSession
    docs = _documents(df, doc_id, text)
    places, places_path = stash(docs.mapInArrow(_places(equal_words), "doc_id long, line int, digest binary, halves array<long>, own long"))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line")
    first, first_path = stash(places.groupBy("digest").agg(F.min(place).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("n")))
    candidates, candidate_paths = _candidates(docs, first)
    near_gone = _near_an_earlier(candidates)
    unstash(spark, candidate_paths)

    # of equal lines the earliest stays, unless it is near an earlier line
    marked = places.select("doc_id", "line", "digest", "own").join(first.filter("n > 1").select("digest", "first"), "digest", "left").join(near_gone, "digest", "left")
    later = F.coalesce(F.col("first") < place, F.lit(False))
    gone, _ = stash(marked.filter(F.coalesce(F.col("near"), F.lit(False)) | later).select("doc_id", "line", "digest", "own"))
    unstash(spark, [places_path, first_path])
    # the texts are shuffled next
    del marked
    release(spark)
    return gone


RESULT = "doc_id long, n_lines long, n_removed long, text string"


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", equal_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): every row with its text less the removed lines."""
    docs = _documents(df, doc_id, text)
    lists = removals(df, doc_id, text, equal_words).groupBy("own").agg(F.collect_set(F.struct("line", "digest")).alias("gone"))
    joined = docs.join(lists, "own", "left").select("doc_id", "text", "gone")

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, total, removed = [], [], []
        for text_of, gone in zip(byte_rows(batch), batch.column(2).to_pylist(), strict=True):
            lines = text_of.split(b"\n")
            wanted = {(g["line"], g["digest"]) for g in gone or []}
            at = {k for k, _ in wanted}
            kept = [x for k, x in enumerate(lines) if k not in at or (k, digest(b" ".join(words_of_line(x)))) not in wanted]
            out.append(b"\n".join(kept).decode())
            total.append(len(lines))
            removed.append(len(lines) - len(kept))
        return pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    return map_batches(joined, apply, RESULT)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), equal_words=1).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
