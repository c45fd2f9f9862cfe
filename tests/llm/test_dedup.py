import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tickloom.llm import exact_dedup, fuse_filter, simhash
from tickloom.llm.components import components


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 20_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    blob = fuse_filter.build(np.concatenate((keys, keys)))
    assert fuse_filter.contains(blob, keys).all()
    assert fuse_filter.contains(blob, np.arange(50_000)).mean() < 0.02


def test_exact_dedup(odd_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter()
    for i, t in rows:
        top = max((x for x in groups[t] if x is not None), default=None)
        want[(i, top, len(groups[t]), i == top, hashlib.sha256(t.encode()).hexdigest())] += 1
    out, _ = exact_dedup.decide(odd_docs)
    assert Counter(map(tuple, out.collect())) == want
    kept = exact_dedup.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)


def test_exact_dedup_batches(spark):
    docs = spark.createDataFrame([(i, f"t{i % 37}") for i in range(400)], "doc_id long, text string")
    for batches in (1, 3):
        out, _ = exact_dedup.decide(docs, batches=batches)
        for r in out.collect():
            same = [i for i in range(400) if i % 37 == r.doc_id % 37]
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))


def test_exact_dedup_tells_collisions_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "digest_of", lambda text: F.substring(text, 1, 1))
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ab"), (4, "ac"), (5, "z")], "doc_id long, text string")
    out = exact_dedup.decide(docs)[0].collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [(1, 3, 2), (2, 4, 2), (3, 3, 2), (4, 4, 2), (5, 5, 1)]


def test_many_null_ids_meet_by_digest(spark):
    docs = spark.range(30_000).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 10000) as text")
    out = exact_dedup.decide(docs)[0]
    assert out.count() == 30_000 and out.filter("group_size = 3 and keep_id is null").count() == 30_000
    assert exact_dedup.filter_documents(docs).count() == 10_000


def test_exact_filter_of_repeated_and_null_ids(spark):
    rows = [(1, "copy"), (None, "copy"), (None, "only here"), (2, "twin"), (3, "twin"), (2, "only there"), (4, None), (4, "")]
    kept = exact_dedup.filter_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text or "") for r in kept) == Counter([(1, "copy"), (None, "only here"), (3, "twin"), (2, "only there"), (4, "")])


def test_empty(no_docs):
    assert exact_dedup.decide(no_docs)[0].count() == 0
    assert simhash.classes(no_docs).count() == 0


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_fingerprints(odd_docs):
    for r, f in zip(odd_docs.collect(), simhash.fingerprints(odd_docs).collect(), strict=True):
        assert f.fp % 2**64 == brute_print(r.text)
    long = "one two three four five six seven " * 20_000
    assert simhash.fingerprint(long.encode()) == simhash.fingerprint(long[:-1].upper().encode())


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6])
def test_masks_cover_every_pair_within_the_radius(radius):
    rng = random.Random(0)
    masks = [m % 2**64 for m in simhash.masks(radius)]
    assert min(m.bit_count() for m in masks) >= 28
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("bucket", [2, 4096])
def test_links_connect_as_all_pairs_do(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    edges, _ = simhash.links(frame, bucket=bucket)
    at = {p: i for i, p in enumerate(signed)}
    for r in edges.collect():
        assert ((r.a ^ r.b) % 2**64).bit_count() <= 3
    joined, _ = components(edges)
    got = {r.node: r.root for r in joined.collect()}
    want = brute_classes(prints)
    classes = defaultdict(set)
    for p in signed:
        classes[got.get(p, p)].add(at[p])
    brute = defaultdict(set)
    for i, c in enumerate(want):
        brute[c].add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, brute.values()))


def test_classes(odd_docs):
    rows = odd_docs.collect()
    prints = [brute_print(r.text) for r in rows]
    roots = brute_classes(prints)
    want = Counter()
    for r, c in zip(rows, roots, strict=True):
        ids = [x.doc_id for x, d in zip(rows, roots, strict=True) if d == c and x.doc_id is not None]
        want[(r.doc_id, min(ids, default=None))] += 1
    assert Counter((r.doc_id, r.component_id) for r in simhash.classes(odd_docs).collect()) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges)[0].collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_duplicates(spark, odd_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(6)]
    rows = []
    for k, b in enumerate(base):
        for j in range(4):
            w = list(b)
            for _ in range(j):
                w[rng.randrange(len(w))] = word()
            rows.append((10 * k + j, " ".join(w), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.filter_documents(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # what is dropped is similar to a smaller id that stays, and all close copies go
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t, _ in rows}
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i, _, _ in rows:
        assert i in ids or any(k != i and close(k, i) for k, _, _ in rows)
    assert {i for i in ids if i % 10 == 0} == {0, 10, 20, 30, 40, 50} and not {i for i in ids if i % 10 == 1}
    assert simhash.filter_documents(odd_docs).count() <= odd_docs.count()


def test_near_duplicates_far_apart_in_bits(spark):
    """Pairs just over 0.8 are dropped however many bits their fingerprints differ in; what is left has no such pair."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, far = [], 0
    for k in range(60):
        w = [word() for _ in range(104)]
        v = list(w)
        for i in (20, 70):
            v[i] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        far += (brute_print(rows[-1][1]) ^ brute_print(rows[-2][1])).bit_count() > 6
    assert far >= 10
    kept = {r.doc_id for r in simhash.filter_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == set(range(0, 120, 2))


@pytest.mark.parametrize("cap", [2, 3, 4096])
def test_prefixes_meet_for_every_similar_pair(spark, cap):
    rng = random.Random(cap)
    base = [[rng.choice("abcdef") for _ in range(40)] for _ in range(4)]
    texts = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        texts.append((i, " ".join(w)))
    texts += [(60, ""), (61, " "), (62, "a b"), (63, "A  b")]
    listed = defaultdict(set)
    frame = spark.createDataFrame(texts, "num long, text string").selectExpr("num", "cast(text as binary) as text").repartition(3)
    for r in simhash.prefixes(frame, 5, 0.8, cap)[0].collect():
        listed[r.num].add(r.token)
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts}
    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert listed[a] & listed[b]


def test_near_duplicates_of_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(200)]
    long, near, other, third = " ".join(words), " ".join([*words[:-1], "end"]), "one text that no other row has at all", "a third text of its own"
    rows = [(1, long), (2, near), (2, other), (None, near), (None, third)]
    kept = simhash.filter_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, long), (2, other), (None, third)}


def test_only_texts_that_may_have_a_similar_one_are_listed(spark):
    rng = random.Random(7)
    texts, line = [], [f"common{i}" for i in range(30)]
    for k in range(80):
        w = [f"{rng.getrandbits(40):x}" for _ in range(rng.choice((1, 3, 6, 9, 30, 100, 300)))]
        texts.append(line + w if len(w) >= 100 else w)
        if k % 2:
            v = list(w)
            for _ in range(rng.randint(0, len(w) // 50 + 1)):
                v[rng.randrange(len(v))] = "new"
            texts.append(line + v if len(w) >= 100 else v)
    texts = list(enumerate(" ".join(w) for w in texts)) + [(900, ""), (901, " "), (902, "a b"), (903, "A  b")]
    frame = spark.createDataFrame(texts, "num long, text string").selectExpr("num", "cast(text as binary) as text")
    got = [r.num for r in simhash.promising(frame.unionByName(frame.filter("num < 9")).repartition(3), 5, 0.8)[0].collect()]
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in texts}
    similar = {i for i in sets for j in sets if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(similar) > 30 and similar <= set(got) and len(got) == len(set(got))
    # a common passage alone is not enough
    apart = {i for i in sets if len(sets[i]) >= 100 and all(i == j or len(sets[i] & sets[j]) < 0.3 * len(sets[i] | sets[j]) for j in sets)}
    assert len(apart) > 5 and not apart & set(got)
