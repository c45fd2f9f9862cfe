"""Operator 12: spelling variants grouped by blocked Gram matrices of letter counts.

A word has a vector of letter counts. One replaced letter moves it by a squared distance of 2, one letter
more or less by 1, so near words are at most 2 apart and in the same or an adjacent block of lengths.
Squared distances of a block against another come from one NumPy matrix product; the pairs at 1 or 2 (a
distance of 0 is a permutation, never one edit) are then verified letter by letter.

Blocks are finer than lengths, without loss: the letters fall in CLASSES classes, and a word's cell is how
many of each it has. One edit changes the cell by one letter more, one less, or one moved between two
classes; a cell therefore meets half of these neighbours and itself. A cell of more than BLOCK words is cut
by hash; each task streams the words of the neighbours past one block of at most about that many, so that
memory is bounded whatever a cell holds.

A word's form is its near word of the largest count, if at least twice its own; counts grow along forms,
so they are trees, and the roots are found by doubling jumps.

Null, empty and blank texts have no words; a null id counts as the empty text in the hash. Repeated rows
are counted as often as they come. Texts of any length are read whole. An empty table, or one without
words of MIN_LETTERS letters and MIN_COUNT occurrences, gives an empty result. Other columns play no part
and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, parts_of, stash, table, unstash
from .exact_dedup import bounded_broadcast

MIN_LETTERS = 5
MIN_COUNT = 3
#: A run of a document gets a typing error if its hash divides by this.
ERROR_EVERY = 97
#: a-z and U+00C0 to U+00FF (only A-Z are lower-cased, so capital letters with marks stay).
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
CLASSES = 5
BLOCK = 2048
#: Words that are multiplied with a block at a time, candidate letters verified at a time, words counted before they are passed on.
STREAM = 2048
VERIFY = 1 << 24
HELD = 300_000
PART = 1 << 22


def _count_runs(least: int, every: int):
    """Kernel over (doc_id, text): (word, n) of the runs of a task, with the errors that the hashes ask for."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)

        crc, get = zlib.crc32, total.get
        for part in (p for batch in batches for p in parts_of(batch, PART)):
            for doc_id, text in zip(part.column(0).to_pylist(), byte_rows(part), strict=True):
                seed = crc(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(text.lower().decode())).items():
                    h = crc(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] = get(word, 0) + n
                if len(total) > HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return run


def words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, error_every: int = ERROR_EVERY) -> DataFrame:
    """(word, n): words of enough letters and occurrences in all texts."""
    own = df.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("binary").alias("text"))
    counted = own.mapInArrow(_count_runs(min_letters, error_every), "word string, n long")
    return counted.filter(F.length("word") >= min_letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def cell_of(word: Column) -> Column:
    """How many letters of each class a word has; a letter's class is its code point modulo CLASSES."""
    own = ["".join(x for x in LETTERS if ord(x) % CLASSES == k) for k in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, x, "")) for x in own])


def _moves() -> list[list[int]]:
    """What one edit adds to a cell, one of each two opposite moves."""
    one = np.eye(CLASSES, dtype=int)
    return [*[x.tolist() for x in one], *[(one[i] - one[j]).tolist() for i in range(CLASSES) for j in range(i)]]


def meetings(counted: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """(cell, block, guest, word, n): the words of each block of a cell, and the guests that pass it, so that each two words of adjacent cells meet once."""
    placed, path = stash(counted.withColumn("cell", cell_of(F.col("word"))))
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cells, cells_path = stash(cells)
    home = placed.join(bounded_broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    moves = F.array(*[F.array(*map(F.lit, x)) for x in _moves()])
    away = placed.select("word", "n", "cell", F.explode(moves).alias("move")).select("word", "n", F.zip_with("cell", "move", lambda a, b: a + b).alias("cell"))
    visits = away.join(bounded_broadcast(cells), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n")
    inside = home.filter("block > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("block"), "word", "n")
    guests = visits.unionByName(inside).select("cell", "block", F.lit(True).alias("guest"), "word", "n")
    return home.select("cell", "block", F.lit(False).alias("guest"), "word", "n").unionByName(guests), [path, cells_path]


class _Side:
    """Words of one side of a product: letters as small numbers in rows, counts of each, lengths."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        self.n, self.words = n, words
        self.texts = words.to_pylist()
        self.size = np.array([len(x) for x in self.texts])
        flat = np.frombuffer("".join(self.texts).encode("utf-16-le"), np.uint16)
        code = np.where(flat >= 0xC0, flat - (0xC0 - 27), flat - (ord("a") - 1)).astype(np.uint8)
        rows = np.repeat(np.arange(len(n)), self.size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.letters = np.zeros((len(n), -(-(int(self.size.max()) + 1) // 8) * 8), np.uint8)
        self.letters[rows, place] = code
        self.counts = np.bincount(rows * (len(LETTERS) + 1) + code, minlength=len(n) * (len(LETTERS) + 1)).reshape(len(n), -1)[:, 1:]
        self.square = (self.counts * self.counts).sum(1)


def candidates(x: _Side, y: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose letter counts are at a squared distance of 1 or 2."""
    # -d/2 = G - |a|/2 - |b|/2, exact in 32 bits while the squares are small
    kind = np.float32 if max(int(x.square.max()), int(y.square.max())) < 1 << 21 else np.float64
    left = np.concatenate((x.counts, x.square[:, None] / -2, np.ones((len(x.n), 1))), 1, dtype=kind)
    right = np.concatenate((y.counts, np.ones((len(y.n), 1)), y.square[:, None] / -2), 1, dtype=kind)
    product = left @ right.T
    return np.nonzero((product >= -1) & (product < 0))


def _width(side: np.ndarray, width: int) -> np.ndarray:
    return side if side.shape[1] == width else np.pad(side, ((0, 0), (0, width - side.shape[1])))


def _one_edit(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs differ by one letter replaced, or one more or less."""
    width = max(x.letters.shape[1], y.letters.shape[1])
    left, right = _width(x.letters, width), _width(y.letters, width)
    out = np.zeros(len(i), bool)
    step = max(1, VERIFY // width)
    for begin in range(0, len(i), step):
        a, b = i[begin : begin + step], j[begin : begin + step]
        differs = left[a] != right[b]
        apart = np.bitwise_count(differs.view(np.uint64)).sum(1)
        longer = y.size[b] - x.size[a]
        found = (longer == 0) & (apart == 1)
        # of different lengths: equal up to some place, and equal from there on once the longer one's letter is left out
        for by, short, long, s, t in ((1, left, right, a, b), (-1, right, left, b, a)):
            at = np.flatnonzero(longer == by)
            if len(at):
                first = differs[at].argmax(1)
                moved = np.pad(long[t[at]][:, 1:], ((0, 0), (0, 1))) != short[s[at]]
                found[at] = ~(moved & (np.arange(width) >= first[:, None])).any(1)
        out[begin : begin + step] = found
    return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, block, guest, word, n) in order, the block's own words first: (word, near, near_n) both ways for each two near words."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    empty = pa.array([], pa.string()), np.empty(0, np.int64)
    here, own, waiting = None, empty, empty  # the block at hand, its own words, guests that have not met them yet

    def joined(x, y):
        return pa.concat_arrays([x[0], y[0]]), np.concatenate((x[1], y[1]))

    def near(x: _Side, y: _Side) -> Iterator[pa.RecordBatch]:
        i, j = candidates(x, y)
        if x is y:
            once = i < j
            i, j = i[once], j[once]
        keep = _one_edit(x, y, i, j)
        i, j = i[keep], j[keep]
        if len(i):
            a, b = x.words.take(pa.array(i)), y.words.take(pa.array(j))
            yield pa.record_batch([pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.array(np.concatenate((y.n[j], x.n[i])))], schema=schema)

    home: _Side | None = None

    def meet(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, home
        if not len(own[1]) or not (last or len(waiting[1]) >= STREAM):
            return
        if home is None:
            home = _Side(*own)
            for k in range(0, len(own[1]), STREAM):
                part = home if len(own[1]) <= STREAM else _Side(own[0][k : k + STREAM], own[1][k : k + STREAM])
                yield from near(part, part)
                for m in range(k + STREAM, len(own[1]), STREAM):
                    yield from near(part, _Side(own[0][m : m + STREAM], own[1][m : m + STREAM]))
        for k in range(0, len(waiting[1]), STREAM):
            yield from near(home, _Side(waiting[0][k : k + STREAM], waiting[1][k : k + STREAM]))
        waiting = empty

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).flatten().to_numpy().reshape(-1, CLASSES)
        key = np.concatenate((cell, batch.column(1).to_numpy()[:, None]), 1)
        guest = batch.column(2).to_numpy(zero_copy_only=False)
        word, n = batch.column(3).cast(pa.string()), batch.column(4).to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1) | (guest[1:] != guest[:-1])) + 1).tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if here != (name := tuple(key[a].tolist())):
                yield from meet(True)
                here, own, waiting, home = name, empty, empty, None
            part = word[a:b], n[a:b]
            if guest[a]:
                waiting = joined(waiting, part)
                yield from meet(False)
            else:
                own = joined(own, part)
    yield from meet(True)


def near_words(counted: DataFrame, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """(word, near, near_n): each two words of one edit, both ways."""
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, paths = meetings(counted, block)
    dealt = rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "guest")
    return dealt.mapInArrow(_pairs, "word string, near string, near_n long"), paths


def roots(forms: DataFrame) -> tuple[DataFrame, str]:
    """(word, root) of words with a form (word, form): where the forms end. Jumps double each round."""
    spark = forms.sparkSession
    now, path = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.alias("x").join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after, next_path = stash(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        unstash(spark, [path])
        now, path = after.select("word", "root"), next_path
        if after.filter("moved").isEmpty():
            return now, path


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, error_every: int = ERROR_EVERY, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word."""
    counted, counted_path = stash(words(df, doc_id, text, min_letters, min_count, error_every))
    pairs, paths = near_words(counted, block)
    # the largest count, then the least word in code-point order, which is the order of UTF-8 bytes
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    summed = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    whole = counted.join(summed, "word", "left").withColumn("taken", -F.col("best.less") >= 2 * F.col("n"))
    known, known_path = stash(
        whole.select("word", F.when(F.col("taken"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n"))
    )
    unstash(df.sparkSession, [counted_path, *paths])
    ends, _ = roots(known.filter("form is not null").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


#: CRC-32 in SQL, a byte at a time and bit by bit (its reversed polynomial is a fixed value); a letter with a mark is two bytes in UTF-8.
_BYTES = "flatten(list_transform(string_split(s, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end))"
_EIGHT_BITS = "list_reduce(list_concat([xor(a, b) & 255], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)"
_CRC = f"xor(list_reduce(list_concat([4294967295::bigint], bytes), lambda a, b: xor(a >> 8, {_EIGHT_BITS})), 4294967295::bigint)"

ORACLE = f"""
with recursive runs as materialized (
  select doc_id, w, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents)
  where length(w) >= {MIN_LETTERS} group by 1, 2),
coded as (select w, k, {_BYTES} as bytes from (select w, k, coalesce(doc_id::varchar, '') || ':' || w as s from runs)),
hashed as materialized (select w, k, {_CRC} as h from coded),
words as materialized (
  select word, sum(k)::bigint as n from (
    select case when h % {ERROR_EVERY} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, k from hashed)
  where length(word) >= {MIN_LETTERS} group by 1 having sum(k) >= {MIN_COUNT}),
less as materialized (select word, p, substr(word, 1, p - 1) || substr(word, p + 1) as v from (select word, unnest(range(1, length(word) + 1)) as p from words)),
pairs as materialized (
  select x.word as a, y.word as b from less x join less y on x.v = y.v and x.p = y.p and x.word <> y.word
  union select w.word, l.word from words w join less l on l.v = w.word union select l.word, w.word from words w join less l on l.v = w.word),
best as (select a as word, count(*) as n_near, arg_min(b, (-n, b)) as near, max(n) as near_n from pairs join words on words.word = b group by 1),
forms as materialized (
  select words.word, words.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 2 * words.n then near end as form, case when near_n >= 2 * words.n then near_n end as form_n
  from words left join best using (word)),
up as (select word, word as root from forms union all select up.word, forms.form from up join forms on forms.word = up.root where forms.form is not null)
select f.word, f.form, u.root, f.n, f.n_near, f.form_n
from forms f join (select up.word, up.root from up join forms g on g.word = up.root where g.form is null) u using (word)
"""
