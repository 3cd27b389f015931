"""Regression, classification and calibration measures, tuning and selection of strategies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import columns as C


def _errors(y: str, p: str) -> tuple[Column, Column]:
    e = F.col(p) - F.col(y)
    return F.sqrt(F.avg(e * e)), F.avg(F.abs(e))


def regression(rows: DataFrame, y: str = "pm10", p: str = "predicted") -> DataFrame:
    """rmse, mae, r2, n."""
    rmse, mae = _errors(y, p)
    return rows.agg(rmse.alias("rmse"), mae.alias("mae"), (1 - rmse * rmse / F.var_pop(y)).alias("r2"), F.count(F.lit(1)).alias("n"))


def regression_by_class(rows: DataFrame, y: str = "pm10", p: str = "predicted", labels: Sequence[str] = C.LABELS) -> DataFrame:
    """rmse, mae, n of each true class; absent classes have n 0."""
    rmse, mae = _errors(y, p)
    found = rows.withColumn("class_id", C.alert_class(y)).groupBy("class_id").agg(rmse.alias("rmse"), mae.alias("mae"), F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame(list(enumerate(labels)), "class_id int, label string")
    return names.join(found, "class_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def regression_near_thresholds(rows: DataFrame, y: str = "pm10", p: str = "predicted", delta: float = 5.0, thresholds: Sequence[float] = C.THRESHOLDS) -> DataFrame:
    """rmse, n of rows within delta of each threshold; a row may count for several."""
    rmse, _ = _errors(y, p)
    near = rows.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.abs(F.col(y) - t) <= delta)))
    return near.groupBy("threshold").agg(rmse.alias("rmse"), F.count(F.lit(1)).alias("n"))


def residuals(rows: DataFrame, y: str = "pm10", p: str = "predicted") -> DataFrame:
    """day, mean and deviation (ddof 0) of the residual."""
    e = F.col(y) - F.col(p)
    return rows.groupBy("day").agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.count(F.lit(1)).alias("n"))


def residual_summary(rows: DataFrame, y: str = "pm10", p: str = "predicted") -> DataFrame:
    """mean and deviation (ddof 0) of all residuals, their number and ends."""
    e = F.col(y) - F.col(p)
    return rows.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.count(e).alias("n"), F.min(e).alias("low"), F.max(e).alias("high"))


def residual_density(rows: DataFrame, y: str = "pm10", p: str = "predicted", bins: int = 50) -> DataFrame:
    """bin (from 0, empty ones too), low, high, n, density, and normal: that of a normal law of the same mean and deviation at the bin's middle.

    The bins are of equal width from the smallest to the largest residual, which closes the last; equal residuals get a width of 1
    around them, and normal is null. Without residuals there are no rows.
    """
    found = residual_summary(rows, y, p).first()
    if not found["n"]:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, n long, density double, normal double")
    ends = (found["low"], found["high"]) if found["high"] > found["low"] else (found["low"] - 0.5, found["high"] + 0.5)
    width = (ends[1] - ends[0]) / bins
    e = F.col(y) - F.col(p)
    counted = rows.where(e.isNotNull()).groupBy(F.least(F.floor((e - ends[0]) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    low, n = F.lit(ends[0]) + F.col("bin") * width, F.coalesce("n", F.lit(0))
    z = (low + width / 2 - found["mean"]) / found["std"] if found["std"] else None
    normal = F.exp(-z * z / 2) / (found["std"] * math.sqrt(2 * math.pi)) if found["std"] else F.lit(None).cast("double")
    return every.join(counted, "bin", "left").select("bin", low.alias("low"), (low + width).alias("high"), n.alias("n"), (n / (found["n"] * width)).alias("density"), normal.alias("normal"))


def confusion(rows: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def per_class(matrix: DataFrame, classes: int = 4) -> DataFrame:
    """class_id, precision, recall, f1 (0 where undefined), support from (y, p, n)."""
    ids = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("class_id"))
    hit = F.sum(F.when((F.col("y") == F.col("class_id")) & (F.col("p") == F.col("class_id")), F.col("n")).otherwise(0))
    said = F.sum(F.when(F.col("p") == F.col("class_id"), F.col("n")).otherwise(0))
    true = F.sum(F.when(F.col("y") == F.col("class_id"), F.col("n")).otherwise(0))
    sums = matrix.join(F.broadcast(ids), (F.col("y") == F.col("class_id")) | (F.col("p") == F.col("class_id"))).groupBy("class_id").agg(hit.alias("hit"), said.alias("said"), true.alias("support"))
    full = ids.join(sums, "class_id", "left").na.fill(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return full.select("class_id", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def alert_rates(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """accuracy and the rates of severe errors (two classes or more), over- and under-alerts from (y, p, n)."""
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    y, p = F.col("y"), F.col("p")
    return matrix.groupBy(*keys).agg(share(y == p).alias("accuracy"), share(F.abs(y - p) >= 2).alias("severe"), share(p > y).alias("over"), share(p < y).alias("under"))


def exploded_matrix(stored: DataFrame, column: str = "matrix") -> DataFrame:
    """(y, p, n) of a stored matrix column: array of rows of counts."""
    rows = stored.select(F.posexplode(column).alias("y", "row"))
    return rows.select("y", F.posexplode("row").alias("p", "n"))


def completed(stored: DataFrame, column: str = "matrix", classes: int = 4) -> DataFrame:
    """stored with accuracy, severe, over and under filled in from its matrix where they are null or have no column.

    Known values stay. A matrix that is null, not classes x classes, or without counts fills nothing.
    """
    matrix = F.col(column)
    cells = F.flatten(F.transform(matrix, lambda row, y: F.transform(row, lambda n, p: F.struct(y.alias("y"), p.alias("p"), n.cast("double").alias("n")))))
    count = lambda test: F.aggregate(F.filter(cells, test), F.lit(0.0), lambda s, c: s + c["n"])
    total = count(lambda c: F.lit(True))
    sound = (F.size(matrix) == classes) & F.forall(matrix, lambda row: F.size(row) == classes) & (total > 0)
    tests = {"accuracy": lambda c: c["y"] == c["p"], "severe": lambda c: F.abs(c["y"] - c["p"]) >= 2, "over": lambda c: c["p"] > c["y"], "under": lambda c: c["p"] < c["y"]}
    filled = {name: F.when(sound, count(test) / total) for name, test in tests.items()}
    return stored.withColumns({name: F.coalesce(F.col(name), value) if name in stored.columns else value for name, value in filled.items()})


def overrides(rows: DataFrame, final: str, reference: str) -> DataFrame:
    """Rows whose final class differs from the reference, and that are above it."""
    a, b = F.col(final), F.col(reference)
    return rows.agg(F.count_if(a != b).alias("n_overrides"), F.avg((a != b).cast("double")).alias("override_rate"), F.count_if(a > b).alias("n_escalations"), F.avg((a > b).cast("double")).alias("escalation_rate"))


def edges(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def bin_of(p: Column, bins: int, lower: bool = False) -> Column:
    """Bin of a probability: [lo, hi) with the last closed, or, with lower, inner edges in the bin below."""
    inner = edges(bins)[1:-1]
    return sum((((p > e) if lower else (p >= e)).cast("int") for e in inner), F.lit(0))


def reliability(rows: DataFrame, truth: str, proba: str, bins: int = 10, lower: bool = False) -> DataFrame:
    """class_id, bin, mean probability, share of the class, n."""
    long = rows.select(F.col(truth).alias("_truth"), F.posexplode(proba).alias("class_id", "p"))
    is_class = (F.col("_truth") == F.col("class_id")).cast("double")
    return long.groupBy("class_id", bin_of(F.col("p"), bins, lower).alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg(is_class).alias("share"), F.count(F.lit(1)).alias("n"))


def calibration_error(rows: DataFrame, truth: str, proba: str, bins: int = 10) -> DataFrame:
    table = reliability(rows, truth, proba, bins)
    return table.groupBy("class_id").agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))


def macro(matrix: DataFrame, keys: Sequence[str], classes: int = 4) -> DataFrame:
    """f1_macro, severe, over and the recall of the last class for each key, from (keys, y, p, n)."""
    hit = [F.sum(F.when((F.col("y") == k) & (F.col("p") == k), F.col("n")).otherwise(0)) for k in range(classes)]
    said = [F.sum(F.when(F.col("p") == k, F.col("n")).otherwise(0)) for k in range(classes)]
    true = [F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)) for k in range(classes)]
    f1 = [F.when(s + t > 0, 2 * h / (s + t)).otherwise(0.0) for h, s, t in zip(hit, said, true)]
    severe = F.sum(F.when(F.abs(F.col("y") - F.col("p")) >= 2, F.col("n")).otherwise(0)) / F.sum("n")
    over = F.sum(F.when(F.col("p") > F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")
    recall = F.when(true[-1] > 0, hit[-1] / true[-1]).otherwise(0.0)
    return matrix.groupBy(*keys).agg((sum(f1[1:], f1[0]) / classes).alias("f1_macro"), severe.alias("severe"), over.alias("over"), recall.alias("recall_worst"))


def tune(rows: DataFrame, deltas: Sequence[float] = (3.0, 5.0, 7.0), least: Sequence[float] = (0.25, 0.35, 0.45), alpha: float = 1.0, beta: float = 0.5, flat: float = 0.005, truth: str = "truth", predicted: str = "predicted", proba: str = "proba") -> DataFrame:
    """delta, least, f1_macro, severe, over, recall_worst, score of every pair of the hybrid rule, place 1 for the best, and whether the grid is flat.

    Ties in score go to the larger f1_macro, then recall of the worst class, then fewer severe and fewer over-alerts, then the
    smaller delta, then the larger probability. A grid whose scores span less than `flat` tells nothing.

    Each row meets the few pairs in place and is counted at once, so at most 16 rows a pair and task are shuffled.
    """
    grid = F.array(*(F.struct(F.lit(d).alias("delta"), F.lit(p).alias("least")) for d in deltas for p in least))
    tried = rows.withColumn("g", F.explode(grid)).select("*", "g.*")
    final = C.hybrid_decision(predicted, proba, F.col("delta"), F.col("least"))["class_final"]
    scores = macro(confusion(tried.withColumn("final", final), truth, "final", ["delta", "least"]), ["delta", "least"])
    scores = scores.withColumn("score", F.col("f1_macro") - alpha * F.col("severe") - beta * (1 - F.col("recall_worst")))
    best = Window.orderBy(F.desc("score"), F.desc("f1_macro"), F.desc("recall_worst"), "severe", "over", "delta", F.desc("least"))  # a row a pair
    every = Window.partitionBy(F.lit(1))
    return scores.withColumns({"place": F.row_number().over(best), "is_flat": F.max("score").over(every) - F.min("score").over(every) < flat})


def rank_candidates(metrics: DataFrame, admitted: Sequence[str], gap: float = 0.005) -> DataFrame:
    """The best admitted model by f1_macro, and the runner-up if it is within the gap."""
    w = Window.orderBy(F.desc("f1_macro"), "model")  # a row a model
    ranked = metrics.where(F.col("model").isin(*admitted)).withColumns({"place": F.row_number().over(w), "best": F.max("f1_macro").over(Window.partitionBy(F.lit(1)))})
    return ranked.where((F.col("place") == 1) | ((F.col("place") == 2) & (F.col("best") - F.col("f1_macro") <= gap))).select("model", "f1_macro", "place")


def select_strategy(metrics: DataFrame, most_severe: float = 0.025, least_recall: float = 0.65, tie: float = 0.005) -> DataFrame:
    """One row: whether a strategy is fit for production, which one, else the best candidate of research, and what fails.

    Of the strategies within both limits the simplest within `tie` of the best f1_macro is selected. If there is none, nothing is
    selected, and the candidate is the best of those within the severe limit, else of all. `failed` names the limits that no strategy
    meets, or `both` where each is met but never together. Strategies without f1_macro take no part; missing measures fail.
    """
    known = metrics.where("f1_macro is not null")
    c1, c2 = F.coalesce(F.col("severe") <= most_severe, F.lit(False)), F.coalesce(F.col("recall_worst") >= least_recall, F.lit(False))
    one = Window.partitionBy(F.lit(1))  # a row a strategy
    judged = known.withColumns({"c1": c1, "c2": c2, "ok": c1 & c2})
    judged = judged.withColumns({f"any_{c}": F.max(c).over(one) for c in ("c1", "c2", "ok")} | {"top": F.max(F.when(F.col("ok"), F.col("f1_macro"))).over(one)})
    tied = F.col("ok") & (F.col("f1_macro") >= F.col("top") - tie)
    pool = F.when(F.col("any_ok"), tied).when(F.col("any_c1"), F.col("c1")).otherwise(True)
    order = [F.desc(pool), F.when(F.col("any_ok"), F.col("complexity")), F.desc("f1_macro"), "strategy"]
    chosen = judged.withColumn("place", F.row_number().over(Window.orderBy(*order))).where("place = 1")
    failed = F.concat_ws(",", F.when(~F.col("any_c1"), "severe"), F.when(~F.col("any_c2"), "recall"), F.when(F.col("any_c1") & F.col("any_c2"), "both"))
    return chosen.select(
        F.col("any_ok").alias("production_ready"), F.when(F.col("any_ok"), F.col("strategy")).alias("selected"), F.when(~F.col("any_ok"), F.col("strategy")).alias("candidate"),
        "f1_macro", "severe", "recall_worst", F.when(~F.col("any_ok"), failed).otherwise("").alias("failed"),
    )


def comparison(metrics: DataFrame, order: Sequence[str], most_severe: float = 0.025, least_recall: float = 0.65) -> DataFrame:
    """All strategies with the limits that they fail (missing measures fail), listed ones first in their order, then by name."""
    fails = [F.when(F.coalesce("severe", F.lit(1.0)) > most_severe, "C1-FAIL"), F.when(F.coalesce("recall_worst", F.lit(0.0)) < least_recall, "C2-FAIL")]
    tag = F.concat_ws(" ", *fails)
    listed = F.array_position(F.array(*map(F.lit, order)), F.col("strategy")).cast("int")
    place = F.row_number().over(Window.orderBy(F.when(listed == 0, len(order) + 1).otherwise(listed), "strategy"))  # a row a strategy
    return metrics.withColumns({"tag": F.when(tag == "", "PASS").otherwise(tag), "place": place})


def deltas(metrics: DataFrame, base: str) -> DataFrame:
    """Differences of each strategy's measures from the base strategy's."""
    b = metrics.where(F.col("strategy") == base).select(*(F.col(c).alias(f"_{c}") for c in ("f1_macro", "severe", "recall_worst")))
    return metrics.join(F.broadcast(b)).select("strategy", *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in ("f1_macro", "severe", "recall_worst")))
