"""Preprocessing, MLlib models, search over temporal folds, calibration, out-of-fold predictions, importances."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators.boosting import fit_softmax
from aerolith.operators.panel import fit_medians, impute

#: The order of seasons.
SEASONS = ("winter", "spring", "summer", "autumn")
#: The search spaces, under MLlib's names. A depth without limit is MLlib's largest, 30.
_TREES = {
    "maxIter": (100, 300, 500, 800), "maxDepth": (3, 5, 7, 9), "stepSize": (0.01, 0.05, 0.1), "subsamplingRate": (0.7, 0.8, 1.0),
    "minInstancesPerNode": (1, 3, 5), "featureSubsetStrategy": ("0.7", "0.8", "1.0"),
}
GRIDS = {
    "elastic_net": {"regParam": (0.001, 0.01, 0.1, 1.0, 10.0, 100.0), "elasticNetParam": (0.1, 0.5, 0.7, 0.9)},
    "boosted": _TREES,
    "forest": {"numTrees": (100, 300, 500), "maxDepth": (10, 20, 30), "minInstancesPerNode": (2, 5, 10)},
    "logistic": {"c": (0.01, 0.1, 1.0, 10.0)},
    "forest_classes": {"numTrees": (100, 300, 500, 800), "maxDepth": (10, 20, 30), "minInstancesPerNode": (1, 2, 5)},
    "boosted_classes": _TREES,
}
#: Most combinations that a search tries; larger spaces are sampled.
MOST_TRIED = 50


def ordinal(c: str, order: Sequence[str]) -> Column:
    """Place of a value in the order, -1 for others."""
    return (F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0)) - 1).cast("double")


def fit_categories(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted values of categorical columns; seasons keep their own order. A few values a column."""
    return {c: list(SEASONS) if c == "season" else sorted(r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().collect()) for c in columns}


def prepared(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Fits medians, categories and scaling on train; the function adds `features` to any rows."""
    medians, categories = fit_medians(train, list(numeric)), fit_categories(train, categorical)
    coded = lambda df: impute(df, medians).withColumns({f"{c}_code": ordinal(c, order) for c, order in categories.items()})
    parts = [VectorAssembler(inputCols=list(numeric), outputCol="_numeric", handleInvalid="keep")]
    if scale:
        parts.append(StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True))
    parts.append(VectorAssembler(inputCols=["_scaled" if scale else "_numeric", *(f"{c}_code" for c in categories)], outputCol="features", handleInvalid="keep"))
    model = Pipeline(stages=parts).fit(coded(train))
    return lambda df: model.transform(coded(df)).drop("_numeric", "_scaled")


def regressor(kind: str, seed: int = 42, **params):
    made = {"elastic_net": LinearRegression, "boosted": GBTRegressor, "forest": RandomForestRegressor}[kind]
    fixed = {"standardization": False} if kind == "elastic_net" else {"seed": seed}
    return made(labelCol="log_target", predictionCol="log_predicted", **fixed, **params)


def fit_regressor(train: DataFrame, kind: str, **params) -> Callable[[DataFrame], DataFrame]:
    """Trained on log1p of pm10; the function adds `predicted`, and has the fitted model as `model`."""
    model = regressor(kind, **params).fit(train.withColumn("log_target", F.log1p("pm10")))

    def add(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("predicted", F.expm1("log_predicted")).drop("log_predicted")

    add.model = model
    return add


def balanced(rows: DataFrame, label: str = "class_id") -> DataFrame:
    """rows with weight n / (classes * rows of the class)."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a row a class
    total = sum(counts.values())
    weight = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(total / (len(counts) * n))) for k, n in counts.items()))
    return rows.withColumn("weight", weight[F.col(label)])


def _binary(train: DataFrame, target: Column, **params):
    rows = train.withColumn("_y", target.cast("double"))
    return GBTClassifier(labelCol="_y", weightCol="weight", seed=42, **params).fit(balanced(rows, "_y"))


def _probability(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def fit_classifier(train: DataFrame, kind: str, classes: int = 4, **params) -> Callable[[DataFrame], DataFrame]:
    """The function adds `proba`, an array by class id. Kinds: logistic, forest, boosted (softmax over all classes), ordinal."""
    if kind in ("logistic", "forest"):
        weighted = balanced(train).withColumn("_y", F.col("class_id").cast("double"))
        if kind == "logistic":
            total = weighted.agg(F.sum("weight")).first()[0]
            made = LogisticRegression(family="multinomial", elasticNetParam=0.5, regParam=1 / (params.pop("c", 1.0) * total), **params)
        else:
            made = RandomForestClassifier(seed=42, **params)
        model = made.setParams(labelCol="_y", weightCol="weight").fit(weighted)
        ids = F.sequence(F.lit(0), F.lit(model.numClasses - 1))
        return lambda df: model.transform(df).withColumn("proba", C.ordered_probabilities(vector_to_array("probability"), ids, classes)).drop("rawPrediction", "probability", "prediction")
    if kind == "boosted":
        return fit_softmax(balanced(train), classes, weight="weight", **params)
    models = [_binary(train, F.col("class_id") > k, **params) for k in range(classes - 1)]

    def add(df: DataFrame) -> DataFrame:
        names = [f"_p{k}" for k in range(len(models))]
        for name, model in zip(names, models):
            df = _probability(model, df, name)
        return df.withColumn("proba", C.frank_hall([F.col(n) for n in names])).drop(*names)

    return add


def choices(grid: dict[str, Sequence], most: int | None = None, seed: int = 42) -> list[dict]:
    """All combinations of a grid, or a random part of them."""
    every = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    return every if most is None or most >= len(every) else random.Random(seed).sample(every, most)


def search(folds: DataFrame, fit: Callable[[DataFrame, dict], Callable[[DataFrame], DataFrame]], score: Callable[[DataFrame], float], grid: list[dict], k: int = 5, threads: int = 2) -> tuple[dict, list[tuple[dict, float]]]:
    """The parameters of the best mean score over expanding folds (val_fold), and all scores. Ties go to the first."""

    def one(params: dict) -> float:
        return sum(score(fit(folds.where(F.col("val_fold") < f), params)(folds.where(F.col("val_fold") == f))) for f in range(1, k + 1)) / k

    with ThreadPoolExecutor(threads) as pool:
        scores = list(pool.map(one, grid))
    best = max(range(len(grid)), key=lambda i: (scores[i], -i))
    return grid[best], list(zip(grid, scores))


def searched(folds: DataFrame, kind: str, fit: Callable[[DataFrame, dict], Callable[[DataFrame], DataFrame]], score: Callable[[DataFrame], float], grid: dict[str, Sequence] | None = None, k: int = 5, most: int = MOST_TRIED, threads: int = 2) -> tuple[dict, list[tuple[dict, float]]]:
    """search() over the space of a kind (GRIDS), or over another grid."""
    return search(folds, fit, score, choices(grid or GRIDS[kind], most), k, threads)


def f1_macro(rows: DataFrame) -> float:
    """Macro f1 of the likeliest class of proba."""
    from aerolith.operators import metrics

    matrix = metrics.confusion(rows.withColumns({"_p": C.argmax("proba"), "_k": F.lit(0)}), "class_id", "_p", ["_k"])
    return metrics.macro(matrix, ["_k"]).first()["f1_macro"]


def negative_rmse(rows: DataFrame) -> float:
    e = F.col("predicted") - F.col("pm10")
    found = rows.agg(F.sqrt(F.avg(e * e))).first()[0]
    return -float("inf") if found is None else -found


def isotonic(rows: DataFrame, classes: int = 4) -> Callable[[DataFrame], DataFrame]:
    """Isotonic calibration of each class on rows with proba and class_id; scaled to sum 1."""
    models = []
    for k in range(classes):
        part = rows.select(F.get("proba", F.lit(k)).alias("p"), (F.col("class_id") == k).cast("double").alias("label"))
        models.append(IsotonicRegression(featuresCol="p", labelCol="label").fit(part))

    def add(df: DataFrame) -> DataFrame:
        for k, model in enumerate(models):
            df = model.setPredictionCol(f"_c{k}").setFeaturesCol("_p").transform(df.withColumn("_p", F.get("proba", F.lit(k)))).drop("_p")
        total = sum((F.col(f"_c{k}") for k in range(1, classes)), F.col("_c0"))
        out = F.when(total > 0, F.array(*(F.col(f"_c{k}") / total for k in range(classes)))).otherwise(F.col("proba"))
        return df.withColumn("proba", out).drop(*(f"_c{k}" for k in range(classes)))

    return add


def averaged(scorers: Sequence[Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """The mean of several scorers' proba."""

    def add(df: DataFrame) -> DataFrame:
        for i, s in enumerate(scorers):
            df = s(df).withColumnRenamed("proba", f"_a{i}")
        out = df.withColumn("proba", F.transform(F.arrays_zip(*(f"_a{i}" for i in range(len(scorers)))), lambda z: sum((z[f"_a{i}"] for i in range(1, len(scorers))), z["_a0"]) / len(scorers)))
        return out.drop(*(f"_a{i}" for i in range(len(scorers))))

    return add


def calibrated_classifier(folds: DataFrame, kind: str, k: int = 5, **params) -> Callable[[DataFrame], DataFrame]:
    """For each temporal fold a classifier of the rows before it, calibrated on the fold; the mean of all."""
    made = []
    for f in range(1, k + 1):
        base = fit_classifier(folds.where(F.col("val_fold") < f), kind, **params)
        fixed = isotonic(base(folds.where(F.col("val_fold") == f)))
        made.append(lambda df, base=base, fixed=fixed: fixed(base(df)))
    return averaged(made)


def out_of_fold(folds: DataFrame, regress: Callable[[DataFrame], Callable], classify: Callable[[DataFrame], Callable], k: int = 5) -> DataFrame:
    """Predictions for each row of folds 1 to k by models of the rows before its fold; a ValueError if rows are lost."""
    out = None
    for f in range(1, k + 1):
        before, now = folds.where(F.col("val_fold") < f), folds.where(F.col("val_fold") == f)
        scored = classify(before)(regress(before)(now))
        out = scored if out is None else out.unionByName(scored)
    if out.count() != folds.where("val_fold > 0").count():
        raise ValueError("out-of-fold rows are incomplete")
    return out


def permuted_copies(rows: DataFrame, features: Sequence[str], repeats: int = 10, seed: int = 42, keys: Sequence[str] = ("station_id", "day"), bucket: int = 1024) -> DataFrame:
    """rows with _copy: 0 as they are, and one copy a feature and repeat (feature i, repeat r: i * repeats + r + 1) with that feature's values permuted.

    Rows are dealt by hash into buckets of about `bucket`. In a bucket each copy stands in a random order of its own, and each row takes
    the value of the next one, the last that of the first. The rows are shuffled once, before they are copied.
    """
    n = max(1, -(-rows.count() // bucket))
    tasks = min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n))).repartition(tasks, "_b")
    copies = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(len(features) * repeats))))
    order = Window.partitionBy("_b", "_copy").orderBy(F.xxhash64(F.lit(seed), F.col("_copy"), *keys))
    values = F.struct(*features)
    moved = copies.withColumn("_v", F.coalesce(F.lead(values).over(order), F.first(values).over(order)))
    chosen = F.floor((F.col("_copy") - 1) / repeats)  # -1 for the copy 0
    return moved.withColumns({f: F.when(chosen == i, F.col("_v")[f]).otherwise(F.col(f)) for i, f in enumerate(features)}).drop("_b", "_v")


def negative_rmse_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    e = F.col("predicted") - F.col("pm10")
    return rows.groupBy(*keys).agg((-F.sqrt(F.avg(e * e))).alias("score"))


def f1_macro_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    from aerolith.operators import metrics

    matrix = metrics.confusion(rows.withColumn("_p", C.argmax("proba")), "class_id", "_p", keys)
    return metrics.macro(matrix, keys).select(*keys, F.col("f1_macro").alias("score"))


def permutation_importance(rows: DataFrame, features: Sequence[str], add: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, Sequence[str]], DataFrame], repeats: int = 10, seed: int = 42, top: int = 15, keys: Sequence[str] = ("station_id", "day")) -> list[tuple[str, float, float]]:
    """feature, mean and deviation of the drop in score when its values are permuted, the largest first, ties in the order given.

    `add` predicts, `score` gives one row of `score` for each value of the keys it is given. All copies are predicted by one
    transform and scored by one aggregate: a row a copy reaches the driver.
    """
    scored = score(add(permuted_copies(rows, features, repeats, seed, keys)), ["_copy"])
    found = {r["_copy"]: r["score"] for r in scored.collect()}
    if not found:
        return []
    out = []
    for i, f in enumerate(features):
        drops = [found[0] - found[i * repeats + r + 1] for r in range(repeats)]
        mean = sum(drops) / repeats
        out.append((f, mean, (sum((d - mean) ** 2 for d in drops) / repeats) ** 0.5))
    return sorted(out, key=lambda r: -r[1])[:top]


def native_importance(model, names: Sequence[str], top: int = 15) -> list[tuple[str, float]]:
    """A tree model's importances, or a linear model's absolute coefficients."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return sorted(((n, abs(float(v))) for n, v in zip(names, values.toArray())), key=lambda r: -r[1])[:top]
