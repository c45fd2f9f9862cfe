"""Tree models as node arrays, the grid judged from few fits, and oversampling, on small data."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tickloom.operators import forests as fo
from tickloom.operators import models as ml
from tickloom.operators import oversampling as ov


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 4)).round(2)
    label = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.5, 400) > 0.7).astype(float)
    df = spark.createDataFrame([("a", k, *map(float, r), float(y)) for k, (r, y) in enumerate(zip(x, label, strict=True))], "code string, ts long, f0 double, f1 double, f2 double, f3 double, y double")
    return ml.balance(ml.assemble(df, ["f0", "f1", "f2", "f3"], F.col("y"))).cache()


def test_mean_of_the_trees_is_the_models_probability(data, tmp_path):
    model = RandomForestClassifier(numTrees=7, maxDepth=5, seed=1).fit(data)
    want = {r.ts: r.p for r in model.transform(data).select("ts", vector_to_array("probability")[1].alias("p")).collect()}
    trees = fo.nodes_of(model, str(tmp_path))
    for limit in (1 << 30, 500):
        each = fo.tree_probabilities(data, trees, ["code", "ts"], limit)
        got = {r.ts: (r.n, r.p) for r in each.groupBy("ts").agg(F.count("*").alias("n"), F.avg("prob").alias("p")).collect()}
        assert all(got[t][0] == 7 and abs(got[t][1] - p) < 1e-9 for t, p in want.items()) and len(got) == 400
    votes = fo.detailed_votes(each, ["ts"], [0.5, 0.7]).filter("level = 0.7").collect()
    probs = {}
    for r in each.collect():
        probs.setdefault(r.ts, []).append(r.prob)
    for v in votes:
        p = np.array(probs[v.ts])
        assert v.gt_true == round((p > 0.7).mean(), 2) and v.gt_false == round((1 - p > 0.7).mean(), 2)
        assert v.ratio_gt == pytest.approx(np.log(((p > 0.7).sum() + 1e-10) / ((1 - p > 0.7).sum() + 1e-10)) / 27, abs=0.0051)


@pytest.mark.parametrize("limit", [1 << 30, 1000])
def test_many_models_in_one_scan(data, tmp_path, limit):
    models = {f"m{d}": (RandomForestClassifier(numTrees=4, maxDepth=d, seed=d).fit(data), 0.1 * d) for d in (1, 3, 5)} | {"boosted": (GBTClassifier(maxIter=3, maxDepth=2, seed=1).fit(data), 0.5)}
    out = fo.score_many(data, models, str(tmp_path), 0.2, limit)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == (1 if limit > 1000 else 4)
    got = {(r.ts, r.model): (r.prob, r.margin) for r in out.collect()}
    want = {}
    for name, (model, cut) in models.items():
        for r in model.transform(data).select("ts", vector_to_array("probability")[1].alias("p")).collect():
            if r.p - cut >= -0.2:
                want[r.ts, name] = r.p, r.p - cut
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_cut_trees_equal_trees_fitted_alone(data, tmp_path):
    alike = {"featureSubsetStrategy": "all", "bootstrap": False, "numTrees": 1, "seed": 3}
    x = np.array([r.x for r in data.select(vector_to_array("features").alias("x")).collect()])
    deep = fo.nodes_of(RandomForestClassifier(maxDepth=6, minInstancesPerNode=2, **alike).fit(data), str(tmp_path))
    cut = fo.cell_values(deep, fo.cut_leaves(deep, [1, 2, 4, 6, 9], [2, 60]), x)
    for k, d in enumerate((1, 2, 4, 6)):
        alone = fo.nodes_of(RandomForestClassifier(maxDepth=d, minInstancesPerNode=2, **alike).fit(data), str(tmp_path))
        assert np.allclose(cut[:, 0, k, 0], alone.value[fo.leaves(alone, x)][:, 0])
    assert np.array_equal(cut[:, :, 4], cut[:, :, 3])

    def walk(row):
        """The value with 60 rows for a split, and whether the tree says the same all below."""

        def said(at):
            if deep.left[at] < 0 or deep.rows[at] < 60:
                return {deep.value[at] > 0.5}
            return said(deep.left[at]) | said(deep.right[at])

        at = 0
        while len(said(at)) > 1:
            at = deep.left[at] if row[deep.feature[at]] <= deep.threshold[at] else deep.right[at]
        return deep.value[at]

    assert np.allclose(cut[:, 0, 3, 1], [walk(r) for r in x])


def test_grid_cells_against_forests_of_their_own(data, tmp_path):
    cells = {(r.trees, r.depth, r.split, r.leaf): r for r in fo.forest_grid(data, str(tmp_path), [3, 6], [2, 4, 99], [2, 50], [1, 10], folds=2).collect()}
    assert set(cells) == {(t, d, s, leaf) for t in (3, 6) for d in (2, 4, 30) for s in (2, 50) for leaf in (1, 10)}
    assert all(r.tp + r.fp + r.fn + r.tn == 400 for r in cells.values())
    # the largest cell is what Spark itself says about the same folds
    keyed = data.withColumn("_fold", F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(2)))
    tp = fn = 0
    for fold in range(2):
        model = RandomForestClassifier(weightCol="weight", numTrees=6, maxDepth=30, minInstancesPerNode=10, seed=7).fit(keyed.filter(F.col("_fold") != fold))
        for r in model.transform(keyed.filter(F.col("_fold") == fold)).groupBy("label", "prediction").count().collect():
            tp += r["count"] * (r.label == 1 and r.prediction == 1)
            fn += r["count"] * (r.label == 1 and r.prediction == 0)
    assert (cells[6, 30, 2, 10].tp, cells[6, 30, 2, 10].fn) == (tp, fn)


@pytest.mark.parametrize("block", [2048, 40])
def test_oversampling(data, block):
    out = ov.oversample(data.select("code", "ts", "label", "features"), ["ts"], k=3, block=block)
    rows = [(r.label, r.ts, np.array(r.x), r.made) for r in out.select("label", "ts", vector_to_array("features").alias("x"), "made").collect()]
    n = [sum(y == label for y, *_ in rows) for label in (0.0, 1.0)]
    assert n[0] == n[1] and sum(not m for *_, m in rows) == 400
    few = min((0.0, 1.0), key=lambda label: sum(y == label and not m for y, _, _, m in rows))
    base = {t: x for y, t, x, m in rows if y == few and not m}
    points = np.array(list(base.values()))
    for y, t, x, m in rows:
        if m:
            assert y == few
            order = np.argsort(((points - base[t]) ** 2).sum(1), kind="stable")[1:]
            near = points[order[:3] if block > 400 else order]
            ends = near - base[t]
            share = ((x - base[t]) * ends).sum(1) / np.maximum((ends**2).sum(1), 1e-12)
            on = np.abs(base[t] + share[:, None] * ends - x).max(1) < 1e-6
            assert (on & (share >= -1e-9) & (share < 1 + 1e-9)).any()


def test_neighbours_by_projection_mostly_agree(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 3))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "num long, x array<double>")
    exact = {r.num: {n.near for n in r.near} for r in ov.neighbours(df, 3, 5).collect()}
    for k in (0, 17):
        assert exact[k] == set(np.argsort(((x - x[k]) ** 2).sum(1))[1:6].tolist())
    blocked = {r.num: {n.near for n in r.near} for r in ov.neighbours(df, 3, 5, block=100, projections=4).collect()}
    assert sum(len(exact[k] & blocked[k]) for k in exact) / 3000 > 0.8
