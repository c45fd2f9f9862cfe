import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickloom.llm import vector_codes as vc


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label error, digest) with Python's integers, trying every entry."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // parts
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for v in whole]
    books = [[v[k] for v in cut[:entries]] for k in range(parts)]

    def assign(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[k]))

    for _ in range(rounds):
        for k in range(parts):
            held = defaultdict(list)
            for v in cut:
                held[assign(k, v[k])[1]].append(v[k])
            for j, xs in held.items():
                books[k][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], Counter()
    for (i, _, label), v in zip(kept, cut, strict=True):
        found = [assign(k, v[k]) for k in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def got(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vc.op13_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(seed, n, dims=16, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, dims))
    return [(int(i), (centres[i % 9] + rng.normal(0, spread, dims)).astype(np.float32).tolist(), int(i) % 4 if i % 5 else None) for i in rng.permutation(n)]


def test_against_all_entries(spark, tmp_path):
    rows = vectors(1, 300)
    assert got(spark, tmp_path, rows) == brute(rows)


def test_ties_repeats_and_bad_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.integers(-2, 3, 8) / 4096).tolist(), 1) for k in range(80)]  # parts of one component: nearly all tie
    rows += [(5, rows[5][1], 1), (None, rows[7][1], None), (200, None, 1), (201, [None] * 8, 1), (202, [float("nan")] * 8, 2), (203, [float("-inf")] * 8, 2), (-9, [float("inf")] + [0.0] * 7, 2)]
    assert got(spark, tmp_path, rows) == brute(rows)


def test_few_vectors_and_hot_vector(spark, tmp_path):
    rows = vectors(4, 5) + [(100 + k, [0.25] * 16, 7) for k in range(60)]
    assert got(spark, tmp_path, rows) == brute(rows)


def test_empty_and_odd_lengths(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int, code string, parts int, error double"
    empty = spark.createDataFrame([], schema)
    assert vc.compress(empty)[0].collect() == []
    rows = [(k, [0.1 * k] * 12, k % 2, "x", 1, 0.5) for k in range(20)] + [(50, [1.0] * 16, 1, "x", 1, 0.5), (51, [], 1, "x", 1, 0.5)]
    out, books = vc.compress(spark.createDataFrame(rows, schema))
    assert sorted(r.vec_id for r in out.collect()) == list(range(20)) and books.shape == (8, 16, 2)
    blank, books = vc.compress(spark.createDataFrame([(1, [], 1, "x", 1, 0.5)], schema))
    assert [tuple(r) for r in blank.collect()] == [(1, 1, "00" * 8, 0)] and books.shape == (8, 1, 0)


def test_large_components_are_held_within_the_bound(spark):
    rows = [(k, [3e38 * (-1) ** k] * 64, None) for k in range(40)]
    out, books = vc.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert vc.bound_of(64) == 1 << 27 and set(np.abs(books).ravel()) == {1 << 27}
    assert {r.error for r in out.collect()} == {0}


@pytest.mark.parametrize("spread", [1, 1000, 1 << 24])
def test_pruning_is_exact_and_saves_distances(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (16, 3))
    x = np.concatenate([entries[rng.integers(0, 16, 3000)] + rng.integers(-spread // 20, spread // 20 + 1, (3000, 3)), rng.integers(-spread, spread + 1, (500, 3))])
    pivots = entries[:4]
    index, best, tried = vc.nearest(x, vc._roots(x, pivots).astype(np.float32), entries, pivots)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
    assert spread == 1 or tried < 0.5 * every.size
