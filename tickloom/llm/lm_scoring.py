"""Operator 4: log-likelihood of whole documents under a gated recurrent language model.

1. Words of all training documents are counted block by block in tasks and summed by Spark.
2. Every text is cut into words once and written as numbers: the most frequent words are the model's
   (``MODELLED``), the next (``COMMON`` in all) are looked up in a broadcast table of that bounded size;
   the counts of all others are joined by word. Training and scoring read the numbers.
3. ``ROUNDS`` times, each task trains the current model by truncated backpropagation on its own training
   documents of the round (one in ``SHARE`` by hash of doc_id; the rounds together take all of them),
   and the mean of the tasks' parameters, weighted by their tokens, is the next model.
4. Every document is scored whole: the state is carried from window to window. A word that is not
   modelled has the model's probability of "another word" times its smoothed share among those.

score is a log10 probability, as is base_score, the smoothed unigram sum. Words are lower-cased (A-Z)
and each text has one end after them, so null, empty and blank texts have one token. Training documents
are those with crc32(doc_id) mod 5 other than 1 (null doc_id: as the empty string). With no training
document all counts are 0 and the model is uniform. Repeated rows are counted and scored as rows of
their own; extra columns play no part; empty tables give empty results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import gru
from .common import byte_rows, parts_of, stash, table, unstash

FOLDS, HELD = 5, 1
COMMON = 200_000
MODELLED = 4096
SHARE = 4  # each round trains on one in so many of the training documents, another part each time
ROUNDS = 4
#: Distinct words a task gathers before it hands its sums over.
TABLE = 400_000
#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 22
#: Tokens that are laid out at a time, in training and scoring, and from which a text counts as long.
LEARNT = 500_000
TOKENS = 1_000_000
LONG = 2048
#: Tasks' parameters that the driver adds up itself at most.
SUMS = 16
LN10 = float(np.log(10))
#: Bytes with A-Z in lower case and all white space as a space.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[9:14] = 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, each with one space after it, and how many of them lie before each text and after the last."""
    data = FOLDED[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = data == 0x20
    word_end = space.copy()
    word_end[0] = False
    word_end[1:] &= ~space[:-1]
    at = np.flatnonzero(word_end)
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    kept = data[word_end | ~space]
    offsets = np.concatenate(([0], np.flatnonzero(kept == 0x20) + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), np.searchsorted(at, begins)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the rows of one binary column; words have a space after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0

        def out() -> list[pa.RecordBatch]:
            sums = pa.Table.from_batches(found).group_by("word").aggregate([("n", "sum")])
            found.clear()
            return sums.rename_columns(["word", "n"]).to_batches(max_chunksize=100_000)

        for batch in batches:
            for part in parts_of(batch, BLOCK, 0):
                each = pc.value_counts(cut(byte_rows(part, 0))[0])
                found.append(pa.record_batch([each.field(0), each.field(1)], ["word", "n"]))
                rows += len(each)
                if rows > TABLE:
                    yield from out()
                    rows = 0
        if rows:
            yield from out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """The common words by frequency, numbered from 1 (0 is the end of a text), and the counts by number."""

    def __init__(self, words, counts, ends: int):
        self.words = pa.array(words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words, pa.binary())
        self.counts = np.append(float(ends), np.asarray(counts, np.float64))
        self.log = np.log10(self.counts + 0.5)

    def of(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of words; -1: not common."""
        return pc.fill_null(pc.add(pc.index_in(distinct, self.words), 1), -1).to_numpy(zero_copy_only=False)


NUMBERED = "uid long, doc_id long, n_tokens long, n_common long, common_log double, n_other long, other_log double, rare array<struct<word:binary,n:long>>, ids binary"


def numbered(docs: DataFrame, shared) -> DataFrame:
    """Rows (doc_id, text) as numbers: sums over the common words, the other words with their counts, and the model's word numbers (16 bits each)."""

    def block(known: Words, ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        n = len(texts)
        words, before = cut(texts)
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        number = known.of(coded.dictionary)[which] if len(which) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(n), np.diff(before))
        tokens, starts = np.zeros(len(number) + n, np.int64), before + np.arange(n + 1)
        tokens[np.arange(len(number)) + owner] = number
        seen = tokens >= 0
        log, other = np.where(seen, known.log[np.maximum(tokens, 0)], 0.0), seen & (tokens >= MODELLED)
        total = lambda x: np.add.reduceat(x, starts[:-1])  # noqa: E731  each text has its end at least
        model = np.where(seen & ~other, tokens, MODELLED).astype(np.int16)
        rare, often = np.unique(owner[number < 0] * max(1, len(coded.dictionary)) + which[number < 0], return_counts=True)
        of, word = np.divmod(rare, max(1, len(coded.dictionary)))
        entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(often, pa.int64())], ["word", "n"])
        arrays = [
            pa.array(np.frombuffer(os.urandom(8 * n), np.int64)), ids, pa.array(np.diff(starts), pa.int64()), pa.array(total((seen & (known.counts[np.maximum(tokens, 0)] > 0)).astype(np.int64))),
            pa.array(total(log)), pa.array(total((other | ~seen).astype(np.int64))), pa.array(total(np.where(other, log, 0.0))),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), entries),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(model)]),
        ]
        return pa.record_batch(arrays, ["uid", "doc_id", "n_tokens", "n_common", "common_log", "n_other", "other_log", "rare", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, BLOCK):
                yield block(shared.value, part.column(0), byte_rows(part))

    return docs.mapInArrow(run, NUMBERED)


def _model_words(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int16).astype(np.int32)


class Waiting:
    """Items held back until their tokens fill a lay-out; long texts wait for each other, so that their lanes run side by side."""

    def __init__(self, short: int, long: int):
        self.room = {False: short, True: long}
        self.held = {False: [], True: []}
        self.size = {False: 0, True: 0}

    def add(self, item, tokens: int) -> list:
        """What is due with this item: nothing, or all items of its kind."""
        kind = tokens > LONG
        self.held[kind].append(item)
        self.size[kind] += tokens
        return self._taken(kind) if self.size[kind] >= self.room[kind] else []

    def _taken(self, kind: bool) -> list:
        out, self.held[kind], self.size[kind] = self.held[kind], [], 0
        return out

    def rest(self) -> list[list]:
        return [x for kind in (False, True) if (x := self._taken(kind))]


def train(rows: DataFrame, start: dict, rounds: int = ROUNDS, share: int = SHARE) -> dict:
    """The model after ``rounds`` rounds over rows (doc_id, ids) of training documents."""
    spark = rows.sparkSession
    params, shape, size = start, gru.shapes(start), len(gru.packed(start))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(gru.packed(params))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trainer, waiting = gru.Trainer(gru.unpacked(sent.value, shape)), Waiting(LEARNT, LEARNT)
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    trainer.learn(waiting.add(_model_words(blob), len(blob) // 2))
            for texts in waiting.rest():
                trainer.learn(texts)
            if trainer.tokens:
                flat = gru.packed(trainer.p).astype(np.float64) * trainer.tokens
                yield pa.record_batch([pa.array([int.from_bytes(os.urandom(4), "big")], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["at", "tokens", "weights"])

        def add(group: pa.Table) -> pa.Table:
            total = np.zeros(size)
            for x in group.column("weights"):
                total += np.frombuffer(x.as_py(), np.float64)
            return pa.table({"at": pa.array([0], pa.int64()), "tokens": pa.array([sum(group.column("tokens").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})

        schema = "at long, tokens long, weights binary"
        mine = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == turn % share).select("ids")
        sums, path = stash(mine.mapInArrow(learn, schema))
        paths, n = [path], sums.count()
        # sums of sums, so that no task or driver holds every task's parameters
        width = max(SUMS, int(n**0.5))
        while n > SUMS:
            sums, path = stash(sums.groupBy(F.pmod("at", F.lit(width)).alias("g")).applyInArrow(add, schema).withColumn("at", F.monotonically_increasing_id()))
            paths.append(path)
            n, width = sums.count(), SUMS
        found = sums.collect()
        if found:
            params = gru.unpacked(sum(np.frombuffer(r["weights"], np.float64) for r in found) / sum(r["tokens"] for r in found), shape)
        unstash(spark, paths)
        sent.unpersist()
    return params


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = df.sparkSession
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    training = own.filter(~held_out(F.col("doc_id")))
    counts, _ = stash(count_words(training.select("text")))
    ends = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    # the counts from which at most COMMON words are common; words that tie at the edge are all left out
    by_count = counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("n"))))
    least = by_count.filter(F.col("upto") <= COMMON).agg(F.min("n").alias("n")).first()["n"]
    top = counts.filter(F.col("n") >= (total["n"] + 1 if least is None else least)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = Words(top.column("word"), top.column("n"), ends)
    del top
    shared = spark.sparkContext.broadcast(words)

    frequent = np.zeros(MODELLED + 1)
    frequent[: min(MODELLED, len(words.counts))] = words.counts[:MODELLED]
    frequent[MODELLED] = n - frequent[:MODELLED].sum()
    others, kinds = float(frequent[MODELLED]), max(0, v - MODELLED)
    # rows get a random name, drawn once as they are written
    lines, _ = stash(numbered(own, shared))
    start = gru.initial(frequent)
    shape = gru.shapes(start)
    params = train(lines.filter(~held_out(F.col("doc_id"))), start, rounds, share)
    sent = spark.sparkContext.broadcast(gru.packed(params))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, waiting = gru.unpacked(sent.value, shape), Waiting(TOKENS, 2 * TOKENS)

        def scored(items: list) -> pa.RecordBatch:
            logs = gru.log_likelihood(p, [_model_words(blob) for _, blob in items]) / LN10
            return pa.record_batch([pa.array([uid for uid, _ in items], pa.int64()), pa.array(logs)], ["uid", "model_log"])

        for batch in batches:
            for item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if due := waiting.add(item, len(item[1]) // 2):
                    yield scored(due)
        for items in waiting.rest():
            yield scored(items)

    logs = lines.select("uid", "ids").mapInArrow(kernel, "uid long, model_log double")
    each = lines.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", F.col("r.n").alias("tf"))
    count = F.coalesce(F.col("n"), F.lit(0))
    tail = (
        each.join(counts, "word", "left")
        .groupBy("uid")
        .agg(F.sum(F.log10(count + 0.5) * F.col("tf")).alias("tail_log"), F.sum(F.when(count > 0, F.col("tf")).otherwise(0)).alias("tail_known"))
    )
    both = lines.drop("rare", "ids").join(tail, "uid", "left").join(logs, "uid")
    tail_log, tail_known = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    base = F.col("common_log") + tail_log - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    model = F.col("model_log") + F.col("other_log") + tail_log - F.col("n_other") * float(np.log10(others + 0.5 * (kinds + 1)))
    return both.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_common") + tail_known).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
