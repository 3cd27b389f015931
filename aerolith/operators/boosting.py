"""One boosted model of several classes: softmax gradients, and a regression tree a class and round.

A class's tree is fitted to gradient / hessian with the hessian as the rows' weight. Then the mean of a leaf is the Newton step
sum(gradient) / sum(hessian), and the gain of a split is that of the second-order loss, so MLlib's trees grow as they should. Scores so
far are a column of a table in the shared folder, written anew each round, so the plan does not grow with the rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.sources.scratch import discard, fresh_path

#: The least hessian of a row; it bounds the steps of rows that are nearly certain.
LEAST = 1e-3


def softmax(raw: Column) -> Column:
    """Probabilities of an array of scores."""
    powers = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, v: s + v))


def log_loss(rows: DataFrame, label: str = "class_id", weight: str | None = None) -> float:
    """Weighted mean of -ln of the true class's entry of proba."""
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.agg(F.sum(-w * F.log(F.get("proba", F.col(label).cast("int")))) / F.sum(w)).first()[0]


def ensemble(spark: SparkSession, trees: list, step: float) -> GBTRegressionModel:
    """The sum of `step` times each tree's prediction, as one model."""
    kind = spark._jvm.org.apache.spark.ml.regression
    gateway = spark.sparkContext._gateway
    made, weights = gateway.new_array(kind.DecisionTreeRegressionModel, len(trees)), gateway.new_array(gateway.jvm.double, len(trees))
    for i, t in enumerate(trees):
        made[i], weights[i] = t._java_obj, step
    return GBTRegressionModel(kind.GBTRegressionModel(f"boosted-{id(made)}", made, weights))


def with_scores(df: DataFrame, models: list[GBTRegressionModel], raw: str) -> DataFrame:
    """df with an array of each model's prediction."""
    names = [f"_s{k}" for k in range(len(models))]
    for name, model in zip(names, models):
        df = model.setFeaturesCol("features").setPredictionCol(name).transform(df)
    return df.withColumn(raw, F.array(*names)).drop(*names)


def fit_softmax(train: DataFrame, classes: int = 4, maxIter: int = 100, stepSize: float = 0.1, seed: int = 42, label: str = "class_id", weight: str | None = None, **tree) -> Callable[[DataFrame], DataFrame]:
    """Trained on features, the label and an optional weight; the function adds `proba`, and has the losses on train after each round as `losses`.

    Rows with a label outside 0 to classes - 1, or none, take no part. Without rows, a ValueError. A class that never occurs gets
    a falling probability, never zero. `tree` holds the parameters of RandomForestRegressor.
    """
    spark = train.sparkSession
    y, w = F.col(label).cast("int"), F.col(weight) if weight else F.lit(1.0)
    rows = train.where(y.between(0, classes - 1)).select("features", y.alias("_y"), w.cast("double").alias("_w"))
    if rows.isEmpty():
        raise ValueError("no rows to train on")

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = fresh_path(spark, "boosting")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    table, path = kept(rows.withColumn("_raw", F.array(*[F.lit(0.0)] * classes)))
    trees, losses = [[] for _ in range(classes)], []

    def grown(number: int, k: int):
        p = F.get("_p", F.lit(k))
        hessian = F.greatest(2 * p * (1 - p), F.lit(LEAST))
        aims = table.withColumn("_p", softmax(F.col("_raw"))).select("features", (((F.col("_y") == k).cast("double") - p) / hessian).alias("_g"), (F.col("_w") * hessian).alias("_h"))
        settings = {"featureSubsetStrategy": "all", "maxDepth": 5, **tree}
        forest = RandomForestRegressor(numTrees=1, bootstrap=False, featuresCol="features", labelCol="_g", weightCol="_h", predictionCol="_t", seed=seed + number, **settings)
        return forest.fit(aims).trees[0]

    for number in range(maxIter):
        with ThreadPoolExecutor(min(4, classes)) as pool:
            new = list(pool.map(lambda k, number=number: grown(number, k), range(classes)))
        for k, t in enumerate(new):
            trees[k].append(t)
        moved = with_scores(table, [ensemble(spark, [t], stepSize) for t in new], "_step")
        previous = path
        table, path = kept(moved.withColumn("_raw", F.zip_with("_raw", "_step", lambda a, b: a + b)).drop("_step"))
        discard(spark, previous)
        losses.append(log_loss(table.withColumn("proba", softmax(F.col("_raw"))), "_y", "_w"))
    discard(spark, path)
    models = [ensemble(spark, t, stepSize) for t in trees]

    def add(df: DataFrame) -> DataFrame:
        return with_scores(df, models, "_raw").withColumn("proba", softmax(F.col("_raw"))).drop("_raw")

    add.losses = losses
    return add
