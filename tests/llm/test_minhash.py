import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import minhash


def brute(rows, size=4, percent=80):
    """(doc_id, set size, component) by comparing all pairs of distinct sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    nodes = [s for s in dict.fromkeys(sets) if s]
    parent = {s: s for s in nodes}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            shared = len(a & b)
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[find(s)].append(i)
    return sorted(((i, len(s), min(least[find(s)], default=None) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def near_copies(seed, families, copies, length=60):
    rng, out = random.Random(seed), []
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(length)] = f"x{rng.randrange(400)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


def got(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(df, **more).collect()), key=str)


def test_components_against_all_pairs(spark):
    rows = near_copies(3, 12, 12) + [(900, "Same  Words\there now and then"), (901, "same words HERE now and then"), (902, "a b"), (903, "A B"), (904, "b a")]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [3, 40])
def test_open_buckets_in_blocks(spark, block):
    # one minimum makes a key, so nearly all texts of a common passage share buckets and must be told apart in blocks
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{passage} {t}") for i, t in near_copies(5, 8, 6, 30)]
    assert got(spark, rows, bands=12, rows=1, cut=0.3, block=block) == brute(rows)


def test_odd_texts_and_columns(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = minhash.classes(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert minhash.classes(no_docs).collect() == []


def test_long_text_and_hot_copies(spark):
    rng = random.Random(1)
    long = [f"v{rng.randrange(5000)}" for _ in range(150_000)]
    other = list(long)
    for k in range(0, len(other), 40):
        other[k] = "z"
    rows = [(0, " ".join(long)), (1, " ".join(other))] + [(k, "one text that a third of the rows have") for k in range(2, 300)]
    assert got(spark, rows) == brute(rows)


def test_signatures_in_spans(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 50, 7, 900, 1)]
    times, plus = (rng.integers(0, 2**63, 6, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    want = [[min((int(x) % 2**32 * int(a) + int(b)) % 2**64 for x in s) >> 32 for a, b in zip(times, plus, strict=True)] for s in sets]
    for span in (3, 64, 1 << 16):
        monkeypatch.setattr(minhash, "SPAN", span)
        assert minhash.signatures(sets, (times, plus)).tolist() == want


def test_similarity_is_what_minima_estimate():
    rng = np.random.default_rng(4)
    common, own, other = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    functions = rng.integers(0, 2**63, 2000, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = minhash.signatures([np.concatenate((common, own)), np.concatenate((common, other))], functions)
    assert abs((a == b).mean() - 0.8) < 0.04


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_stars_over_batches(size):
    rows = sorted((random.Random(k).randrange(12), k) for k in range(60))
    keys, nums = (np.array(x) for x in zip(*rows, strict=True))
    batches = [pa.record_batch([pa.array(keys[k : k + size]), pa.array(nums[k : k + size])], ["key", "num"]) for k in range(0, len(rows), size)]
    buckets = defaultdict(list)
    for k, n in rows:
        buckets[k].append(n)
    want = sorted((k, n, min(ns)) for k, ns in buckets.items() if len(ns) > 1 for n in ns)
    assert sorted(tuple(r.values()) for b in minhash._stars(iter(batches)) for r in b.to_pylist()) == want


def test_no_pair_misses_a_bucket_by_design():
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-6


def test_rows_may_change_their_order(spark):
    rows = near_copies(8, 5, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.classes(df).collect()) == sorted(brute(rows))
