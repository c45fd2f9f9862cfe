import re
from collections import Counter, defaultdict

import pytest

from tickloom.llm import mixing, quality_rules, url_filters

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def brute_measures(text):
    t = text or ""
    w = [x.decode() for x in WORD.findall(t.encode())]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x.encode())]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(odd_docs, no_docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measure(odd_docs).collect())
    assert got == Counter((r.doc_id, *brute_measures(r.text)) for r in odd_docs.collect())
    assert quality_rules.measure(no_docs).count() == 0 and quality_rules.filter_documents(no_docs).count() == 0


def test_long_texts_take_the_paired_form(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 3)
    text = "a b c d a b c e f g a b c d x y z x y z"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.measure(docs).first().n_repeat_words == brute_measures(text)[4]


def test_order_changes_cost_alone(odd_docs):
    docs = odd_docs
    one = quality_rules.filter_documents(docs, rules=quality_rules.RULES)
    two = quality_rules.filter_documents(docs, rules=quality_rules.RULES[::-1])
    assert one.columns == docs.columns
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    import random

    rng = random.Random(seed)
    sources = ["é", "a", "zz", None, "B", "empty"]
    rows = [(i, "" if (s := rng.choice(sources)) == "empty" else "w " * rng.randint(0, 30 if s != "a" else 3), s) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    by_id = {i: s for i, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        targets[s] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    for s, want in brute_targets(sizes).items():
        assert abs(targets[s] - want) < 1e-6 * max(1, want) and abs(taken[s] - want) <= 15.5
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_repeats(odd_docs, no_docs):
    copies = Counter()
    for r in mixing.mix(odd_docs).collect():
        copies[r.doc_id] = r.copies
    out = mixing.repeat_documents(odd_docs)
    assert out.columns == odd_docs.columns
    rows = Counter(r.doc_id for r in odd_docs.collect())
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: copies[i] * n for i, n in rows.items() if copies[i]})
    assert mixing.mix(no_docs).count() == 0 and mixing.repeat_documents(no_docs).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://example.net", "https://example.net/fr/", "ftp://b.example.com/de/1#t", "x://example.com/en/", "http://sub.org/fr/", "http://org/fr", "http://notexample.net/en/", "http://m.spam-farm.example.org/en/", "http://a.b://c/d", "://net/"]
    rows = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    got = {urls[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[None] == got[""] == got["no scheme"] == ("", "", None, "allow")
    assert got["http://A.Example.NET/en/x?q"] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got["https://example.net"] == ("example.net", "", None, "allow")
    assert got["https://example.net/fr/"][2:] == ("net/", "block")
    assert got["ftp://b.example.com/de/1#t"][2:] == ("example.com/de/", "block")
    assert got["x://example.com/en/"][2:] == (None, "allow")
    assert got["http://sub.org/fr/"][2:] == ("org/fr/", "allow") and got["http://org/fr"][2:] == (None, "allow")
    assert got["http://notexample.net/en/"][2:] == ("net/", "block")
    assert got["http://m.spam-farm.example.org/en/"][2:] == (None, "block")
    assert got["://net/"] == ("net", "/", "net/", "block")
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filters.xxhash, "xxh64_intdigest", lambda name: 7)
    path = tmp_path / "f"
    path.write_bytes(url_filters.pack(url_filters.RULES))
    held = url_filters.Filter(str(path))
    assert held.longest([("x.net", "/"), ("y.example.com", "/de/"), ("none", "/")]) == [("net/", 1), ("example.com/de/", 1), None]


def test_rules_are_ordered_by_what_is_left_to_reject(spark):
    rows = [("short",)] * 40 + [("# " * 80,)] * 5 + [(" ".join(f"word{k}" for k in range(80)),)] * 5
    docs = spark.createDataFrame(rows, "text string")
    order = [r.name for r in quality_rules.order_rules(quality_rules._sample(docs, "text", 256))]
    assert sorted(order) == sorted(r.name for r in quality_rules.RULES)
    assert order.index("too_few_words") < order.index("repeated_words")
    assert quality_rules.filter_documents(docs).count() == 5


def test_a_hot_source_and_a_long_text(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i}") for i in range(600)] + [(1000, "word " * 200_000, "hot"), (1001, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(out) == 602 and out[1000].size == 200_000 and out[1001].size == 0
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in out.values())
    kept = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    assert kept[1000].n_words == 200_000 and kept[1000].n_repeat_words == 200_000 and kept[1001].n_words == 0
