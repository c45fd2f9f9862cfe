"""Combination search against loops."""

import itertools
import math
import random

import pytest

from tickloom.operators import combos as co


def keep(df):
    return df.cache()


@pytest.mark.parametrize("size", [2, 3])
def test_strict_seed_counts_against_a_loop(spark, size):
    rng = random.Random(size)
    names = "abcdefghi"
    sets = [c for c in itertools.combinations(names, size) if rng.random() < 0.6]
    scores = {c: rng.randint(0, 9) for c in sets}
    seeds = spark.createDataFrame([(list(c), ":".join(c), s) for c, s in scores.items()], "combo array<string>, key string, score int")
    order = sorted(sets, key=lambda c: (-scores[c], ":".join(c)))

    def count(k):
        have = set(order[:k])
        return sum(all(s in have for s in itertools.combinations(c, size)) for c in itertools.combinations(names, size + 1))

    for target in (0, 1, 7, 10_000):
        k = max(k for k in range(len(order) + 1) if count(k) <= target)
        got = co.pick_k_strict(seeds, target, keep).first()
        assert (got.k, got.made) == (k, count(k))


def test_every_combination_once_and_any_range_alone(spark):
    pool = spark.createDataFrame([(f"m{k:02d}",) for k in range(25)], "member string")
    whole = {r.number: tuple(r.combo) for r in co.combination_source(pool, 3).collect()}
    assert sorted(whole) == list(range(math.comb(25, 3)))
    assert set(whole.values()) == set(itertools.combinations([f"m{k:02d}" for k in range(25)], 3))
    part = {r.number: tuple(r.combo) for r in co.combination_source(pool, 3, 700, 750).collect()}
    assert part == {k: whole[k] for k in range(700, 750)}
    assert co.combination_source(pool, 3, 2299, 9999).count() == 1 and co.combination_source(pool, 26).count() == 0


def test_large_numbers(spark):
    pool = spark.range(3917).selectExpr("cast(id as string) as member")
    last = math.comb(3917, 5) - 1
    row = co.combination_source(pool, 5, last, last + 1).first()
    assert row.combo == sorted(str(k) for k in range(3917))[-5:]


def test_satisfied_sets(spark):
    rng = random.Random(4)
    rows = [(k, sorted(s for s in "abcdef" if rng.random() < (0.9 if s == "a" else 0.4))) for k in range(60)]
    sets = [c for n in (1, 2, 3) for c in itertools.combinations("abcdefz", n)]
    flags = spark.createDataFrame(rows, "id int, active array<string>")
    combos = spark.createDataFrame([(list(c),) for c in sets], "combo array<string>")
    got = sorted((r.id, tuple(r.combo)) for r in co.satisfied(flags, combos, ["id"]).collect())
    assert got == sorted((k, c) for k, active in rows for c in sets if set(c) <= set(active))
