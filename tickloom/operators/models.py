"""Training of tree models and preparation of their features (Spark ML)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, StandardScaler, UnivariateFeatureSelector, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that may be inputs: numbers and booleans, without labels (fwd_...), keys and prices."""
    keep = {"double", "float", "int", "bigint", "boolean"}
    return [c for c, t in df.dtypes if t in keep and not c.startswith(("fwd_", "label", "_")) and c not in {"rn", "open", "high", "low", "close", "prev_close"}]


def assemble(df: DataFrame, columns: list[str], label) -> DataFrame:
    filled = df.select("code", "ts", *[F.coalesce(C(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], label.cast("double").alias("label"))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


def balance(df: DataFrame) -> DataFrame:
    """Weights that give both classes the same total."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    weights = counts.crossJoin(total).select("label", (C("all") / (C("k") * C("n"))).alias("weight"))
    return df.join(F.broadcast(weights), "label")


def forest(train: DataFrame, trees: int, depth: int, leaf: int = 1, seed: int = 7, **more):
    """A random forest of one parameter set; forests.forest_grid finds a good one."""
    return RandomForestClassifier(weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed, **more).fit(train)


def gradient_boosting(train: DataFrame, rounds: int = 10, depth: int = 3, seed: int = 7):
    return GBTClassifier(weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed).fit(train)


def _chosen(columns: list[str], best: int) -> list:
    """Stages to ``chosen``: mean fill, scale, best features by F test."""
    return [
        Imputer(inputCols=columns, outputCols=[f"{c}_filled" for c in columns]),
        VectorAssembler(inputCols=[f"{c}_filled" for c in columns], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        UnivariateFeatureSelector(featuresCol="scaled", outputCol="chosen", labelCol="label", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(best),
    ]


def preprocess(columns: list[str], best: int = 10, components: int = 5) -> Pipeline:
    """Mean fill, scale, best features by F test, a fixed number of principal components."""
    return Pipeline(stages=[*_chosen(columns, best), PCA(inputCol="chosen", outputCol="features", k=components)])


def preprocess_by_variance(train: DataFrame, columns: list[str], best: int = 10, share: float = 0.95) -> PipelineModel:
    """As ``preprocess``, fitted, with as many components as it takes to keep ``share`` of the variance of the chosen features.

    The components are fitted once, all of them, and the first ones are kept.
    """
    first = Pipeline(stages=_chosen(columns, best)).fit(train)
    chosen = first.transform(train)
    every = PCA(inputCol="chosen", outputCol="components", k=min(best, len(columns))).fit(chosen)
    kept = every.explainedVariance.toArray().cumsum()
    k = min(len(kept), int((kept < share - 1e-12).sum()) + 1)
    return PipelineModel([*first.stages, every, VectorSlicer(inputCol="components", outputCol="features", indices=list(range(k)))])


def eliminate_features(train: DataFrame, columns: list[str], least: int, share: float = 0.2, seed: int = 7) -> list[str]:
    """Drop the least important features, a share at a time, until ``least`` are left."""
    left = list(columns)
    while len(left) > least:
        data = VectorAssembler(inputCols=left, outputCol="features").transform(train.drop("features"))
        weights = RandomForestClassifier(weightCol="weight", numTrees=10, maxDepth=4, seed=seed).fit(data).featureImportances.toArray()
        n = max(least, len(left) - max(1, int(len(left) * share)))
        left = [c for _, c in sorted(zip(-weights, left, strict=True))[:n]]
    return left


def eliminate_by_folds(train: DataFrame, columns: list[str], step: float = 0.01, folds: int = 3, least: int = 1, seed: int = 7) -> tuple[list[str], dict[int, float]]:
    """The features to keep, and the mean accuracy over the folds by number of features.

    In each fold the least important features go, ``step`` of all at a time (one at least), and each number of
    features is judged on the rows left out. The number with the best mean (the smaller in a tie) is then
    reached by the same elimination on all rows.
    """
    drop = max(1, int(step * len(columns)))
    sizes = sorted({*range(len(columns), least - 1, -drop), least}, reverse=True)
    keyed = train.drop("features").withColumn("_fold", F.pmod(F.xxhash64("code", "ts"), F.lit(folds))).persist()
    judge = MulticlassClassificationEvaluator(metricName="accuracy")

    def down(rows: DataFrame, to: int, test: DataFrame | None) -> tuple[list[str], dict[int, float]]:
        left, found = list(columns), {}
        for size in [n for n in sizes if n >= to]:
            if size < len(left):
                left = [c for _, c in sorted(zip(-weights, left, strict=True), key=lambda x: x[0])][:size]
            if test is None and size == to:
                return left, found
            made = VectorAssembler(inputCols=left, outputCol="features")
            model = RandomForestClassifier(weightCol="weight", numTrees=10, maxDepth=4, seed=seed).fit(made.transform(rows))
            weights = model.featureImportances.toArray()
            if test is not None:
                found[size] = judge.evaluate(model.transform(made.transform(test)))
        return left, found

    try:
        scores: dict[int, list[float]] = {}
        for fold in range(folds):
            for size, score in down(keyed.filter(C("_fold") != fold), least, keyed.filter(C("_fold") == fold))[1].items():
                scores.setdefault(size, []).append(score)
        means = {size: sum(x) / len(x) for size, x in scores.items()}
        best = min(means, key=lambda size: (-round(means[size], 12), size))
        return down(keyed, best, None)[0], means
    finally:
        keyed.unpersist()
