import random
from collections import Counter

import numpy as np

from tickloom.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for i, t in rows:
        b, key = (t or "").encode(), sd.LEAST if i is None else i
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, key), key)
    out = Counter()
    for i, t in rows:
        b, key = (t or "").encode(), sd.LEAST if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(b), len(b) - len(kept), runs, kept)] += 1
    return out


def result(frame):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove(frame).collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["der", "die", "là", "ennt", "of", "the", "haan", "ñ", "zz"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(9, 30))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : a + rng.randint(30, 90)] if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))))
        rows.append((i, "".join(parts)))
    rows += [(200, "a" * 300), (201, "b" + "a" * 70 + "c"), (202, "a" * 49), (203, "a" * 50), rows[5], (None, rows[9][1]), (204, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(frame) == brute(rows)


def test_odd(odd_docs, no_docs):
    assert result(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sd.remove(no_docs).count() == 0


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 101, 5000).astype(np.uint8))
    data = np.frombuffer(sd.GAP + text + sd.GAP, np.uint8)
    at, h, least = sd.anchors(data)
    at -= len(sd.GAP)
    for k in range(len(text) - 49):
        assert ((at >= k) & (at + sd.GRAM <= k + 50)).any()
    first, last = sd._claimed(at + len(sd.GAP), h, least)
    claimed = {int(a) - j for a, f, n in zip(at, first, last) for j in range(n, f + 1)}
    assert set(range(len(text) - 49)) <= claimed


def test_small_packs_and_buckets(spark, odd_docs, monkeypatch):
    for name, value in (("PACK", 900), ("BLOCK", 300), ("BUCKET_BYTES", 500), ("HASH_BYTES", 700)):
        monkeypatch.setattr(sd, name, value)
    assert result(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_one_doc_id_on_two_texts(spark):
    line = "one passage of well over fifty bytes that comes again and again; "
    rows = [(5, line + "x"), (5, "y" * 20 + line), (3, "other words before it " + line), (9, line * 2)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_hot_passage(spark):
    passage = " ".join(f"word{k}" for k in range(40))
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) + passage + "".join(rng.choice("abcdefgh ") for _ in range(80))) for i in range(400)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == brute(rows)


def test_an_input_that_comes_in_another_order_at_each_read(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sd, "PACK", 2000)
    passage = " ".join(f"word{k}" for k in range(20))
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) + (passage if i % 3 else "")) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs.repartition(3).orderBy(F.rand())) == brute(rows)
    docs.write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    assert sd.repeatable(stored.filter("doc_id > 3").select("doc_id", "text"))
    assert not sd.repeatable(stored.orderBy("doc_id")) and not sd.repeatable(stored.filter(F.rand() > 0.5)) and not sd.repeatable(stored.repartition(4))


def test_suffixes_are_sorted():
    rng = np.random.default_rng(5)
    near = rng.integers(97, 99, (500, sd.AROUND)).astype(np.uint8)
    near[250:] = near[:250]
    begins, sizes = np.array([0, 3, 200]), np.array([3, 197, 300])
    suffixes = sd.Suffixes(near)
    order = suffixes.merge_sorted(rng.permutation(500), begins, sizes, sd.SIDE, sd.LENGTH)
    for b, n in zip(begins, sizes):
        rows = [bytes(near[i, sd.SIDE :]) for i in order[b : b + n]]
        assert rows == sorted(rows)
    x, y = rng.integers(0, 500, (2, 200))
    want = [next((k for k in range(sd.LENGTH) if near[a, k + 3] != near[b, k + 3]), sd.LENGTH) for a, b in zip(x, y)]
    assert suffixes.common(x, y, 3, sd.LENGTH).tolist() == want
