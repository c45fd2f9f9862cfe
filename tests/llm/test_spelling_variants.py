import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import spelling_variants as sv


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    """The result by the rule itself, with all pairs of words."""
    seen = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(x.lower() if x.isascii() else x for x in word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            seen[word] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if is_near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def made_rows(seed, docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéßÄ") for _ in range(rng.randint(5, 8))) for _ in range(25)]
    out = []
    for i in range(docs):
        words = []
        for _ in range(80):
            w = base[min(int(rng.expovariate(0.2)), 24)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "a" + w[at:], w[:at] + "b" + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        out.append((i, rng.choice([" ", ", ", "9", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("block", [2048, 4])
def test_groups_against_all_pairs(spark, block):
    rows = made_rows(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[1] != "" for r in want) > 20
    assert rows_of(sv.groups(df, block=block)) == want


def test_odd_texts(spark, odd_docs, no_docs):
    assert rows_of(sv.groups(odd_docs)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sv.groups(no_docs).collect() == []
    rows = [(None, "letters"), (None, "letters letters"), (1, "x" * 30_000 + " ÀÉ÷×ÿ lettors"), (1, "x" * 30_000 + " ÀÉ÷×ÿ"), (2, "x" * 30_000 + " ÀÉ÷×ÿ lettors lettors"), (2, "x" * 29_999 + "y"), (3, "x" * 29_999 + "y " + "x" * 29_999 + "y")]
    rows += [(k, "letters") for k in range(5, 12)]
    clashing = spark.createDataFrame([(*r, "w", 1, [1]) for r in rows], "doc_id long, text string, word string, n int, cell array<int>")
    want = brute(rows)
    assert rows_of(sv.groups(clashing)) == want
    assert ("x" * 29_999 + "y" in {r[0] for r in want}) and any(r[:3] == ("lettors", "letters", "letters") for r in want)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "w5"), ("b", "c")]
    out, _ = sv.roots(spark.createDataFrame(chain, "word string, form string"))
    got = {r.word: r.root for r in out.collect()}
    assert got.pop("b") == "c" and set(got.values()) == {"w37"} and len(got) == 38


def test_products_find_every_edit():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(500)})
    side = sv._Side(pa.array(words), np.arange(len(words)))
    i, j = sv.candidates(side, side)
    keep = sv._one_edit(side, side, i, j)
    assert set(zip(i[keep].tolist(), j[keep].tolist(), strict=True)) == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if is_near(x, y)}


@pytest.mark.parametrize("stream", [2, 5, 1000])
def test_each_pair_meets_once(spark, monkeypatch, stream):
    monkeypatch.setattr(sv, "STREAM", stream)
    words = sorted({w for _, t in made_rows(7, 4) for w in re.findall("[a-zÀ-ÿ]+", t)})
    counted = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    rows, _ = sv.meetings(counted, 3)
    batch = pa.Table.from_pandas(rows.orderBy("cell", "block", "guest").toPandas(), preserve_index=False).cast(pa.schema([("cell", pa.list_(pa.int32())), ("block", pa.int32()), ("guest", pa.bool_()), ("word", pa.string()), ("n", pa.int64())]))
    found = [(r["word"], r["near"]) for size in [7] for b in sv._pairs(iter(batch.to_batches(size))) for r in b.to_pylist()]
    assert sorted(found) == sorted((a, b) for a in words for b in words if is_near(a, b))
