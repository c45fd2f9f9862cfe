"""Operator 10: quality by votes of the nearest labelled documents in a latent-semantic space.

Terms are the ends of a text's words (three bytes, which keep symbols, marks and capitals) and a few
terms for its shape: share of distinct words, repeated lines, length. Inverse document frequencies come
from all documents. A bounded sample of labelled rows (``most_labelled``, by hash of doc_id) spans the
latent space (truncated SVD of its tf-idf rows) and is broadcast as unit vectors; every document is
projected, compared with all of them by one blocked product of matrices, and scored by the votes of its
``neighbours`` most similar ones, weighted by similarity.

Only text enters a score. Labels come from rows with crc32(doc_id) mod 5 other than 0. Null, empty and
blank texts have shape terms alone. Without labelled rows every score is 0.5; a text without a
similar neighbour gets the labelled share of 1. Ties in similarity go to the earlier sample row. Several
labels of a doc_id count by their largest; a null label is none; a null doc_id counts as held out.
Repeated rows get equal scores, other columns play no part and empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_rows, map_batches, table

#: Labelled rows that are broadcast at most.
MOST_LABELLED = 2048
DIMENSIONS = 4096
LATENT = 48
NEIGHBOURS = 25
FOLDS = 5
CUT = 0.3
#: Documents in a block of the product.
BLOCK = 512


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a text, ascending, and their damped counts."""
    words = text.split()
    counts = Counter([w[-3:] for w in words])
    lines = [x for x in text.split(b"\n") if x.strip()]
    shape = {
        b"distinct:%d" % (10 * len(set(words)) // max(1, len(words))): 1 + len(words) // 2,
        b"repeated:%d" % (10 * (len(lines) - len(set(lines))) // max(1, len(lines))): 1 + len(words) // 2,
        b"length:%d" % len(words).bit_length(): 1 + len(words) // 8,
    }
    sums: Counter = Counter()
    for term, n in [*counts.items(), *shape.items()]:
        sums[zlib.crc32(term) % DIMENSIONS] += n
    at = np.fromiter(sums, np.int64, len(sums))
    order = np.argsort(at)
    return at[order], 1 + np.log(np.fromiter(sums.values(), np.float64, len(sums))[order])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows each hashed term occurs; texts has one binary column."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.zeros(DIMENSIONS, np.int64)
        for text in byte_rows(batch, 0):
            found[terms(text)[0]] += 1
        at = np.flatnonzero(found)
        return pa.record_batch([pa.array(at.astype(np.int32)), pa.array(found[at])], ["at", "n"])

    out = np.zeros(DIMENSIONS, np.float64)
    # at most one row a dimension comes to the driver
    for row in map_batches(texts, kernel, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


def _latent(rows: np.ndarray, size: int) -> np.ndarray:
    """The leading right singular vectors as columns, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(0).standard_normal((rows.shape[1], min(size + 16, *rows.shape)))
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :size]


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(df: DataFrame, labels: DataFrame, doc_id: str, text: str, most_labelled: int) -> dict:
    """Weights, projection and labelled unit vectors (at most most_labelled) for score()."""
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    total = own.count()
    idf = np.log((1 + total) / (1 + document_frequencies(own.select("text")))) + 0.1
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).filter(~held_out(F.col("doc_id")))
    # labels without a document must not fill the sample, so documents are met before the limit
    here = known.join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = here.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(x) for x in byte_rows(batch, 2)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int64())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))], ["doc_id", "quality", "at", "value"])

    joined = own.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    # a doc_id on several rows counts once, so no more than most_labelled rows come to the driver
    rows = map_batches(joined, kernel, "doc_id long, quality int, at array<long>, value array<double>").groupBy("doc_id").agg(F.min(F.struct("at", "value", "quality")).alias("r")).orderBy("doc_id").select("r.*").collect()
    if not rows:
        return {"idf": idf, "project": None}
    full = np.zeros((len(rows), DIMENSIONS))
    for i, row in enumerate(rows):
        full[i, row["at"]] = np.array(row["value"]) * idf[row["at"]]
    full = _units(full)
    project = _latent(full, LATENT)
    votes = np.array([row["quality"] for row in rows], np.float64)
    return {"idf": idf, "project": np.ascontiguousarray(project, np.float32), "known": np.ascontiguousarray(_units(full @ project).T, np.float32), "votes": votes}


def vote(vectors: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of similarity that the nearest labelled vectors give to label 1."""
    similar = vectors @ model["known"]
    n = similar.shape[1]
    k = min(neighbours, n)
    # rounded, with the place below, so that ties and the last bits of a product decide nothing
    keys = np.round(similar.astype(np.float64) * 1e6).astype(np.int64) * n - np.arange(n)
    best = np.argpartition(-keys, k - 1, axis=1)[:, :k]
    weights = np.maximum(np.round(np.take_along_axis(similar, best, 1).astype(np.float64), 6), 0) ** 4
    total = weights.sum(1)
    prior = model["votes"].mean()
    return np.where(total > 0, (weights * model["votes"][best]).sum(1) / np.where(total > 0, total, 1), prior)


def score(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_labelled: int = MOST_LABELLED, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(fit(df, labels, doc_id, text, most_labelled))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, found = shared.value, []
        texts = byte_rows(batch)
        if model["project"] is None:
            found = [np.full(len(texts), 0.5)]
        for k in range(0, len(texts) if not found else 0, BLOCK):
            block = texts[k : k + BLOCK]
            vectors = np.zeros((len(block), model["project"].shape[1]), np.float32)
            for i, x in enumerate(block):
                at, value = terms(x)
                vectors[i] = (value * model["idf"][at]).astype(np.float32) @ model["project"][at]
            found.append(vote(_units(vectors).astype(np.float32), model))
        return pa.record_batch([batch.column(0), pa.array(np.clip(np.concatenate(found), 0, 1) if found else [], pa.float64())], ["doc_id", "score"])

    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    scored = map_batches(own, kernel, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
