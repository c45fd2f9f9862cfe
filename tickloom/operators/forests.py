"""Fitted tree models as flat node arrays: votes of each tree, many models in one scan, grids judged from a few fits.

A model's saved nodes are read as a table and become arrays of feature, threshold, children, rows and
class shares; all trees of all models stand end to end. The arrays are broadcast if their bytes are within
LIMIT, else in several packs of whole trees, each with its own scan. Rows go down all trees of a pack side by
side, one vectorised step a level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Bytes of node arrays that are broadcast at once.
LIMIT = 64 << 20
#: Values that a step of the walk handles at a time (rows by trees by cells).
AT_ONCE = 1 << 22
#: Spark's trees go no deeper.
DEEPEST = 30


@dataclass
class Trees:
    """Nodes of trees, end to end; children are places in the arrays (a leaf has none: -1)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    value: np.ndarray  # share of class 1, or the prediction of a boosted tree
    roots: np.ndarray

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.feature, self.threshold, self.left, self.right, self.rows, self.value))

    def part(self, begin: int, end: int) -> Trees:
        """The trees from one number to another."""
        a, b = int(self.roots[begin]), int(self.roots[end]) if end < len(self.roots) else len(self.feature)
        move = lambda x: np.where(x >= 0, x - a, -1)[a:b]
        return Trees(self.feature[a:b], self.threshold[a:b], move(self.left), move(self.right), self.rows[a:b], self.value[a:b], self.roots[begin:end] - a)


def joined(trees: list[Trees]) -> Trees:
    starts = np.cumsum([0, *[len(t.feature) for t in trees]])
    move = lambda x, s: np.where(x >= 0, x + s, -1)
    each = list(zip(trees, starts, strict=False))
    return Trees(*[np.concatenate([getattr(t, k) for t in trees]) for k in ("feature", "threshold")], *[np.concatenate([move(getattr(t, k), s) for t, s in each]) for k in ("left", "right")], *[np.concatenate([getattr(t, k) for t in trees]) for k in ("rows", "value")], np.concatenate([t.roots + s for t, s in each]))


def nodes_of(model, folder: str) -> Trees:
    """The node arrays of a fitted random forest or boosted model, by way of its saved form in ``folder``; a model's size is bounded by its parameters."""
    spark = model._sparkSession if hasattr(model, "_sparkSession") else None
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    model.write().save(path)
    from pyspark.sql import SparkSession

    rows = (spark or SparkSession.getActiveSession()).read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        C("treeID").alias("tree"), "id", "prediction", "impurityStats", C("rawCount").alias("rows"), C("leftChild").alias("left"), C("rightChild").alias("right"), C("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), C("split.numCategories").alias("kinds")
    ).toPandas().sort_values(["tree", "id"])
    if (rows["kinds"] > 0).any():
        raise ValueError("splits by category are not kept as thresholds")
    roots = np.flatnonzero(np.diff(rows["tree"].to_numpy(), prepend=-1))
    begin = np.repeat(roots, np.diff(np.append(roots, len(rows))))
    place = lambda x: np.where(x >= 0, x + begin, -1)
    boosted = not hasattr(model, "getImpurity") or model.getImpurity() == "variance"
    stats = None if boosted else np.stack(rows["impurityStats"].to_numpy())
    value = rows["prediction"].to_numpy(float) if boosted else stats[:, 1] / np.maximum(stats.sum(1), 1e-300)
    return Trees(rows["feature"].to_numpy(np.int32), rows["threshold"].fillna(0).to_numpy(float), place(rows["left"].to_numpy()), place(rows["right"].to_numpy()), rows["rows"].to_numpy(np.int64), value, roots)


def leaves(trees: Trees, x: np.ndarray) -> np.ndarray:
    """For each row and tree the leaf it ends in."""
    at = np.broadcast_to(trees.roots, (len(x), len(trees.roots))).copy()
    lines = np.arange(len(x))[:, None]
    while True:
        inner = trees.left[at] >= 0
        if not inner.any():
            return at
        goes_left = x[lines, np.maximum(trees.feature[at], 0)] <= trees.threshold[at]
        at = np.where(inner, np.where(goes_left, trees.left[at], trees.right[at]), at)


def packs(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of trees whose bytes stay within a limit; a larger tree is a range of its own."""
    out, begin, held = [], 0, 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > limit:
            out.append((begin, k))
            begin, held = k, 0
        held += size
    return [*out, (begin, len(sizes))] if sizes else out


def _per_tree(trees: Trees) -> list[int]:
    ends = np.append(trees.roots[1:], len(trees.feature))
    return ((ends - trees.roots) * (trees.bytes / max(1, len(trees.feature)))).astype(int).tolist()


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _features(df: DataFrame) -> Column:
    return vector_to_array("features").alias("x")


def tree_probabilities(df: DataFrame, trees: Trees, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """(keys, tree, prob): one row for each row of df (with ``features``) and tree, the tree's share of class 1."""
    spark, kinds, out = df.sparkSession, dict(df.dtypes), None
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tree int, prob double"
    for begin, end in packs(_per_tree(trees), limit):
        held = spark.sparkContext.broadcast(trees.part(begin, end))

        def run(batches: Iterator[pa.RecordBatch], held=held, begin=begin) -> Iterator[pa.RecordBatch]:
            own = held.value
            step = max(1, AT_ONCE // len(own.roots))
            for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
                prob = own.value[leaves(own, _matrix(batch, len(keys)))]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), len(own.roots)))
                number = np.tile(np.arange(begin, begin + len(own.roots), dtype=np.int32), batch.num_rows)
                yield pa.record_batch([*[batch.column(k).take(rows) for k in range(len(keys))], pa.array(number), pa.array(prob.ravel())], [*keys, "tree", "prob"])

        made = df.select(*keys, _features(df)).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out


def detailed_votes(probabilities: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """By row and threshold how many trees are above it for class 1 (gt_true) or class 0 (gt_false), the rest (lt_true, lt_false), as shares, with the scaled log ratios."""
    level = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("level")
    each = probabilities.select(*keys, "prob", level).groupBy(*keys, "level").agg(F.count("*").alias("trees"), F.count_if(C("prob") > C("level")).alias("gt_true"), F.count_if(1 - C("prob") > C("level")).alias("gt_false"))
    both = each.withColumns({"lt_true": C("trees") - C("gt_true"), "lt_false": C("trees") - C("gt_false")})
    ratio = lambda a, b: F.round(F.log((C(a) + 1e-10) / (C(b) + 1e-10)) / 27, 2)
    ratios = {"ratio_gt": ratio("gt_true", "gt_false"), "ratio_lt": ratio("lt_true", "lt_false")}
    return both.withColumns(ratios).withColumns({x: F.round(C(x) / C("trees"), 2) for x in ("gt_true", "gt_false", "lt_true", "lt_false")})


def score_many(df: DataFrame, models: dict[str, tuple], folder: str, slack: float = 0.1, limit: int = LIMIT) -> DataFrame:
    """(code, ts, label, model, prob, margin): rows that each model (name: (model, threshold)) scores at its threshold less ``slack`` or better.

    One scan for all models whose nodes fit the limit together.
    """
    spark = df.sparkSession
    names = list(models)
    arrays = [nodes_of(m, folder) for m, _ in models.values()]
    weights = [np.array(m.treeWeights) for m, _ in models.values()]
    boosted = np.array([not hasattr(m, "getImpurity") or m.getImpurity() == "variance" for m, _ in models.values()])
    cuts = np.array([t for _, t in models.values()])
    out = None
    for begin, end in packs([a.bytes for a in arrays], limit):
        held = spark.sparkContext.broadcast((joined(arrays[begin:end]), np.cumsum([0, *[len(a.roots) for a in arrays[begin : end - 1]]]), np.concatenate(weights[begin:end])))

        def run(batches: Iterator[pa.RecordBatch], held=held, begin=begin, end=end) -> Iterator[pa.RecordBatch]:
            trees, first, weight = held.value
            step = max(1, AT_ONCE // len(trees.roots))
            for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
                values = trees.value[leaves(trees, _matrix(batch, 3))]
                sums = np.add.reduceat(values * weight, first, axis=1)
                prob = np.where(boosted[begin:end], 1 / (1 + np.exp(-2 * sums)), sums / np.add.reduceat(weight, first))
                margin = prob - cuts[begin:end]
                row, model = np.nonzero(margin >= -slack)
                named = pa.array([names[begin + k] for k in range(end - begin)]).take(pa.array(model))
                take = pa.array(row)
                yield pa.record_batch([*[batch.column(k).take(take) for k in range(3)], named, pa.array(prob[row, model]), pa.array(margin[row, model])], ["code", "ts", "label", "model", "prob", "margin"])

        kinds = dict(df.dtypes)
        made = df.select("code", "ts", "label", _features(df)).mapInArrow(run, f"code {kinds['code']}, ts {kinds['ts']}, label double, model string, prob double, margin double")
        out = made if out is None else out.unionByName(made)
    return out


def cut_leaves(trees: Trees, depths: list[int], splits: list[int]) -> np.ndarray:
    """(nodes, depths, splits): where the cut trees end. A node is a leaf at the depth, with fewer rows than a split needs, or over two leaves that say the same, as Spark drops those."""
    levels, at = [], trees.roots
    while len(at):
        levels.append(at)
        inner = at[trees.left[at] >= 0]
        at = np.concatenate((trees.left[inner], trees.right[inner]))
    ends = np.repeat((trees.left < 0)[:, None, None], len(depths), 1).repeat(len(splits), 2)
    says = trees.value > 0.5
    for level in range(len(levels) - 1, -1, -1):
        own = levels[level]
        ends[own] |= (level >= np.array(depths))[:, None] | (trees.rows[own][:, None, None] < np.array(splits))
        inner = own[trees.left[own] >= 0]
        left, right = trees.left[inner], trees.right[inner]
        ends[inner] |= ends[left] & ends[right] & (says[left] == says[right])[:, None, None]
    return ends


def cell_values(trees: Trees, ends: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(rows, trees, depths, splits): class-1 shares of the trees cut as ``cut_leaves`` says."""
    at = np.broadcast_to(trees.roots, (len(x), len(trees.roots))).copy()
    lines = np.arange(len(x))[:, None]
    out = np.zeros((*at.shape, *ends.shape[1:]))
    going = np.ones(out.shape, bool)
    while True:
        here = going & ends[at]
        out[here] = np.broadcast_to(trees.value[at][:, :, None, None], out.shape)[here]
        going &= ~here
        if not going.any():
            return out
        goes_left = x[lines, np.maximum(trees.feature[at], 0)] <= trees.threshold[at]
        at = np.where(trees.left[at] < 0, at, np.where(goes_left, trees.left[at], trees.right[at]))


def forest_grid(train: DataFrame, folder: str, trees: list[int], depths: list[int], splits: list[int], leaf_rows: list[int], folds: int = 3, seed: int = 7, **more) -> DataFrame:
    """(trees, depth, split, leaf, tp, fp, fn, tn, recall, precision) of every cell of a grid, by cross-validation.

    train: (features, label, weight). One forest is fitted for each leaf size and fold, with the most trees and
    the greatest depth. A smaller number of trees is a prefix of it; a smaller depth, or more rows for a split, is
    the same tree cut off (and pruned as Spark does), as what a node does doesn't depend on how the tree goes on. So a grid of a x b x c x d
    cells takes d fits a fold, and one scan of each fold's test rows judges all cells. Depths count up to Spark's 30.
    """
    spark = train.sparkSession
    depths, most = sorted({min(d, DEEPEST) for d in depths}), max(trees)
    counts = np.array(sorted(trees))
    keyed = train.withColumn("_fold", F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(folds))).persist()
    out = None
    try:
        for leaf in leaf_rows:
            for fold in range(folds):
                model = RandomForestClassifier(weightCol="weight", numTrees=most, maxDepth=max(depths), minInstancesPerNode=leaf, seed=seed, **more).fit(keyed.filter(C("_fold") != fold))
                fitted = nodes_of(model, folder)
                held = spark.sparkContext.broadcast((fitted, cut_leaves(fitted, depths, splits)))

                def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                    own, ends = held.value
                    step = max(1, AT_ONCE // (most * len(depths) * len(splits)))
                    total = np.zeros((2, 2, len(counts), len(depths), len(splits)), np.int64)
                    for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
                        sums = cell_values(own, ends, _matrix(batch, 1)).cumsum(1)[:, counts - 1]
                        says = sums > counts[:, None, None] / 2
                        label = batch.column(0).to_numpy(zero_copy_only=False) == 1
                        for is_, rows in ((0, says[~label]), (1, says[label])):
                            total[is_, 1] += rows.sum(0)
                            total[is_, 0] += (~rows).sum(0)
                    a, b, c = np.indices(total.shape[2:]).reshape(3, -1)
                    columns = [counts[a], np.array(depths)[b], np.array(splits)[c], total[1, 1, a, b, c], total[0, 1, a, b, c], total[1, 0, a, b, c], total[0, 0, a, b, c]]
                    yield pa.record_batch([pa.array(x.astype(np.int64)) for x in columns], ["trees", "depth", "split", "tp", "fp", "fn", "tn"])

                test = keyed.filter(C("_fold") == fold).select("label", _features(keyed))
                summed = test.mapInArrow(run, "trees long, depth long, split long, tp long, fp long, fn long, tn long").groupBy("trees", "depth", "split").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])
                # a row a cell, whatever the table's size, so that the fits needn't be kept
                made = spark.createDataFrame(summed.withColumn("leaf", F.lit(leaf).cast("long")).toPandas())
                out = made if out is None else out.unionByName(made)
    finally:
        keyed.unpersist()
    cells = out.groupBy("trees", "depth", "split", "leaf").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])
    return cells.withColumns({"recall": F.try_divide("tp", C("tp") + C("fn")), "precision": F.try_divide("tp", C("tp") + C("fp"))})


def best_cell(cells: DataFrame) -> dict:
    """The cell with the highest recall of the true class; ties: higher precision, then the smaller forest."""
    return cells.orderBy(F.desc("recall"), F.desc("precision"), "trees", "depth", F.desc("split"), F.desc("leaf")).first().asDict()
