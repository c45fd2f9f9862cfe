import hashlib
import random
from collections import Counter

import numpy as np

from tickloom.llm import line_dedup as ld


def brute(rows):
    lines = []
    for i, t in rows:
        for k, x in enumerate((t or "").encode().split(b"\n")):
            w = ld.words_of_line(x)
            if len(w) >= ld.MIN_WORDS:
                lines.append(((i is not None, i or 0, k), w))
    gone = {p for p, w in lines if any(q < p and ld.within_one(v, w) for q, v in lines)}
    out = Counter()
    for i, t in rows:
        parts = (t or "").encode().split(b"\n")
        kept = [x for k, x in enumerate(parts) if (i is not None, i or 0, k) not in gone or len(ld.words_of_line(x)) < ld.MIN_WORDS]
        out[(i, len(parts), len(parts) - len(kept), b"\n".join(kept).decode())] += 1
    return out


def test_within_one():
    s = lambda x: x.encode().split()
    assert ld.within_one(s("a b c"), s("a b c")) and ld.within_one(s("a b c"), s("a x c"))
    assert ld.within_one(s("a b c"), s("a c")) and ld.within_one(s("a c"), s("a b c"))
    assert not ld.within_one(s("a b c"), s("b a c")) and not ld.within_one(s("a b c d"), s("a b"))


def test_against_brute_force(spark):
    rng = random.Random(1)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(4, 8))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(pool))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice("abcdefgh")] * rng.randint(0, 2)
            lines.append((" " * rng.randint(1, 2)).join(w).upper() if rng.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows = rows + [rows[7], (None, rows[3][1]), (100, None), (101, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in ld.dedup(frame).collect())
    assert got == brute(rows)


def test_odd(odd_docs, no_docs):
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in ld.dedup(odd_docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert ld.dedup(no_docs).count() == 0


def test_equal_short_lines_go_in_the_query(spark, tmp_path):
    long = "five words make a line"
    rows = [(1, "Short line\n\nhttp://a.b/c\n" + long), (2, "short  LINE\nshort lime\n\nhttp://a.b/c\n\u4e00\u4e8c\u4e09"), (3, "\u4e00\u4e8c\u4e09\nfive words make one line\na\nb\na")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in ld.op1_line_dedup(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (4, 0, sha(rows[0][1])), 2: (5, 2, sha("short lime\n\n\u4e00\u4e8c\u4e09")), 3: (5, 3, sha("a\nb"))}


def test_lines_are_cut_and_hashed_as_words():
    texts = [b"", b" A  b\tc \n\n x\x0by ", b"\n", "É one two".encode(), b"one two"]
    lines = ld.Lines(texts)
    want = [(k, n, b" ".join(ld.words_of_line(x))) for k, t in enumerate(texts) for n, x in enumerate(t.split(b"\n"))]
    assert [(int(lines.text_of[i]), int(lines.number[i]), lines.joined(i)) for i in range(len(want))] == want
    rng = random.Random(3)
    rows = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() for _ in range(200)]
    lines = ld.Lines(rows)
    at, keys, roles = lines.variants(np.arange(len(rows)))
    of = {}
    for i, key, role in zip(at.tolist(), keys.tolist(), roles.tolist()):
        w = rows[i].split()
        forms = [(tuple(w), None)] if role == 2 else [(tuple(w[:k] + w[k + 1 :]), k if role == 0 else None) for k in range(len(w))]
        of.setdefault(key, []).append((i, set(forms)))
    # lines at one key share a form; lines that share a form meet
    assert all(set.intersection(*(f for _, f in x)) for x in of.values())
    by_form = {}
    for i, row in enumerate(rows):
        for k in range(len(row.split())):
            w = row.split()
            by_form.setdefault((tuple(w[:k] + w[k + 1 :]), k), set()).add(i)
    met = {frozenset((a, b)) for x in of.values() for a, _ in x for b, _ in x}
    assert all(frozenset((a, b)) in met for x in by_form.values() for a in x for b in x)


def test_a_line_of_200_000_words(spark):
    words = [f"w{k % 977}" for k in range(200_000)]
    other = words[:1000] + ["new"] + words[1000:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:-2]))]
    got = {r.doc_id: r.n_removed for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_a_template_line_with_one_changing_word(spark):
    rows = [(i, f"this line was printed by {i} for you") for i in range(500)] + [(None, f"no id {i} on these lines at all") for i in range(50)]
    got = Counter((r.doc_id, r.n_removed) for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got[(0, 0)] == 1 and sum(n for (i, k), n in got.items() if k == 1 and i is not None) == 499


def test_only_parts_that_may_differ_emit_variants():
    rng = random.Random(5)
    rows = {" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 60))) for _ in range(60)}
    for x in sorted(rows):
        w = x.split()
        k = rng.randint(0, len(w))
        w[k : k + rng.randint(0, 1)] = ["new"] * rng.randint(0, 1)
        rows.add(" ".join(w))
    rows = [x.encode() for x in sorted(rows) if len(x.split()) >= ld.MIN_WORDS]
    lines, every = ld.Lines(rows), np.arange(len(rows))
    parts = lines.parts(every)
    times = Counter(parts.ravel().tolist())
    bits = [sum(1 << k for k, key in enumerate(row) if times[key] > 1) for row in parts.tolist()]
    at, keys, roles = lines.variants(every, np.array(bits))
    # a change costs a part of a line for each line it joins, not the whole line
    assert len(at) < sum(2 * len(x.split()) + 1 for x in rows) / 4
    met = {}
    for i, key, role in zip(at.tolist(), keys.tolist(), roles.tolist()):
        met.setdefault((key, role), set()).add(i)
    for a, b in [(a, b) for a in every for b in every if a < b and ld.within_one(rows[a].split(), rows[b].split())]:
        assert any(a in of and b in (of if role == 0 else met.get((key, 3 - role), ())) for (key, role), of in met.items())
