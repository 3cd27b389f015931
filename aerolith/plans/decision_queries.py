"""Queries of decision rules, metrics, selection and serving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import metrics, serve
from aerolith.plans import adapters as A
from aerolith.plans.panel_queries import raw_panel, rounded
from aerolith.plans.registry import query


def judged(spark, d) -> DataFrame:
    p = A.predictions(spark, d)
    return p.withColumns({"truth": C.alert_class("pm10"), **C.hybrid_decision("predicted", "proba", 5.0, 0.35)})


def strategies(spark, d) -> DataFrame:
    """Measures of three ways to a class: by value, by model, hybrid."""
    rows = judged(spark, d)
    long = rows.select("truth", F.explode(F.create_map(F.lit("value"), "class_by_value", F.lit("model"), "class_by_model", F.lit("hybrid"), "class_final")).alias("strategy", "p"))
    complexity = F.when(F.col("strategy") == "value", 1).when(F.col("strategy") == "model", 2).otherwise(3)
    return metrics.macro(metrics.confusion(long, "truth", "p", ["strategy"]), ["strategy"]).withColumn("complexity", complexity)


_LONG = "SELECT truth, class_by_value AS p, 'value' AS strategy FROM final UNION ALL SELECT truth, class_by_model, 'model' FROM final UNION ALL SELECT truth, class_final, 'hybrid' FROM final"
_F1 = " + ".join(f"coalesce(2 * count(*) FILTER (truth = {k} AND p = {k}) / nullif(count(*) FILTER (truth = {k}) + count(*) FILTER (p = {k}), 0), 0)" for k in range(4))
_MACRO = f"({_F1}) / 4 AS f1_macro, count(*) FILTER (abs(truth - p) >= 2) / count(*) AS severe, count(*) FILTER (p > truth) / count(*) AS over, coalesce(count(*) FILTER (truth = 3 AND p = 3) / nullif(count(*) FILTER (truth = 3), 0), 0) AS recall_worst"
_STRATEGIES = f"SELECT strategy, CASE strategy WHEN 'value' THEN 1 WHEN 'model' THEN 2 ELSE 3 END AS complexity, {_MACRO} FROM ({_LONG}) GROUP BY 1"


@query("SELECT row_id, truth, class_by_value, class_by_model, round(distance, 5) AS distance, distance <= 5 AS near, class_by_value <> class_by_model AS differ, severe_class, round(proba[severe_class + 1], 5) AS severe_probability, distance <= 5 AND class_by_value <> class_by_model AND proba[severe_class + 1] >= 0.35 AS prudential, escalated, class_final, CASE WHEN distance > 5 THEN 'regression' WHEN class_by_value = class_by_model THEN 'hybrid_agreement' WHEN proba[severe_class + 1] >= 0.35 THEN 'hybrid_override' ELSE 'hybrid_no_override' END AS source FROM final")
def decide_hybrid(spark, d):
    return rounded(judged(spark, d).drop("station_id", "day", "pm10", "predicted", "proba"))


@query("SELECT row_id, CAST(round(1000 * p[1]) AS BIGINT) AS a, CAST(round(1000 * p[4]) AS BIGINT) AS d FROM (SELECT row_id, list_transform(r, lambda x: CASE WHEN list_sum(r) > 0 THEN x / list_sum(r) ELSE x END) AS p FROM (SELECT row_id, [least(greatest(a, 0), 1) FOR a IN [1 - w[1] / 101, w[1] / 101 - w[2] / 101, w[2] / 101 - w[3] / 101, w[3] / 101]] AS r FROM weights))")
def decide_ordinal(spark, d):
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    k = F.col("o_orderkey")
    exceed = [((k * m) % 101 + 1) / 101 for m in (7, 13, 29)]
    p = C.frank_hall(exceed)
    rows = o.join(c, o.o_custkey == c.c_custkey).select(k.alias("row_id"), p.alias("p"))
    return rows.select("row_id", F.round(1000 * F.get("p", F.lit(0))).cast("long").alias("a"), F.round(1000 * F.get("p", F.lit(3))).cast("long").alias("d"))


@query("SELECT row_id, round(proba[3], 5) AS p0, 0.0 AS p1, round(proba[1], 5) AS p2, round(proba[2], 5) AS p3 FROM predictions")
def decide_ordered_probabilities(spark, d):
    p = A.predictions(spark, d)
    out = C.ordered_probabilities(F.slice("proba", 1, 3), F.array(F.lit(2), F.lit(3), F.lit(0)))
    return rounded(p.select("row_id", out.alias("p")).select("row_id", *(F.get("p", F.lit(i)).alias(f"p{i}") for i in range(4))))


@query("SELECT round(sqrt(avg((predicted - pm10) * (predicted - pm10))), 5) AS rmse, round(avg(abs(predicted - pm10)), 5) AS mae, round(1 - avg((predicted - pm10) * (predicted - pm10)) / var_pop(pm10), 5) AS r2, count(*) AS n FROM predictions")
def metric_regression(spark, d):
    return rounded(metrics.regression(A.predictions(spark, d)))


@query("SELECT truth AS class_id, CASE truth WHEN 0 THEN 'verde' WHEN 1 THEN 'giallo' WHEN 2 THEN 'arancio' ELSE 'rosso' END AS label, round(sqrt(avg((predicted - pm10) * (predicted - pm10))), 5) AS rmse, round(avg(abs(predicted - pm10)), 5) AS mae, count(*) AS n FROM judged GROUP BY 1")
def metric_by_class(spark, d):
    return rounded(metrics.regression_by_class(A.predictions(spark, d)))


@query("SELECT t AS threshold, round(sqrt(avg((predicted - pm10) * (predicted - pm10))), 5) AS rmse, count(*) AS n FROM predictions JOIN (SELECT unnest([20.0::DOUBLE, 35, 50]) AS t) ON abs(pm10 - t) <= 5 GROUP BY 1")
def metric_near_thresholds(spark, d):
    return rounded(metrics.regression_near_thresholds(A.predictions(spark, d)))


@query("SELECT day, round(avg(pm10 - predicted), 5) AS mean, round(stddev_pop(pm10 - predicted), 5) AS std, count(*) AS n FROM predictions GROUP BY 1")
def metric_residuals(spark, d):
    return rounded(metrics.residuals(A.predictions(spark, d)))


_RESIDUALS = "SELECT min(pm10 - predicted) AS lo, (max(pm10 - predicted) - min(pm10 - predicted)) / 50 AS w, avg(pm10 - predicted) AS m, stddev_pop(pm10 - predicted) AS s, count(*) AS c FROM predictions"


@query("SELECT round(avg(pm10 - predicted), 5) AS mean, round(stddev_pop(pm10 - predicted), 5) AS std, count(*) AS n, round(min(pm10 - predicted), 5) AS low, round(max(pm10 - predicted), 5) AS high FROM predictions")
def metric_residual_summary(spark, d):
    return rounded(metrics.residual_summary(A.predictions(spark, d)))


@query(f"""SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 5) + 0.0 AS low, round(lo + i * w + w, 5) + 0.0 AS high, coalesce(n, 0) AS n, round(coalesce(n, 0) / (c * w), 5) AS density, round(exp(-power((lo + i * w + w / 2 - m) / s, 2) / 2) / (s * sqrt(2 * pi())), 5) AS normal
 FROM (SELECT unnest(generate_series(0, 49)) AS i) CROSS JOIN ({_RESIDUALS}) LEFT JOIN (SELECT least(floor((pm10 - predicted - lo) / w), 49) AS b, count(*) AS n FROM predictions, ({_RESIDUALS}) GROUP BY 1) ON i = b""")
def metric_residual_density(spark, d):
    """Fifty bins of the residuals, with the normal law beside them."""
    out = rounded(metrics.residual_density(A.predictions(spark, d)))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("low", "high")})  # no negative zero


@query("SELECT truth AS y, class_final AS p, count(*) AS n FROM final GROUP BY 1, 2")
def metric_confusion(spark, d):
    return rounded(metrics.confusion(judged(spark, d), "truth", "class_final"))


@query(" UNION ALL ".join(f"SELECT {k} AS class_id, round(coalesce(count(*) FILTER (truth = {k} AND class_final = {k}) / nullif(count(*) FILTER (class_final = {k}), 0), 0), 5) AS precision, round(coalesce(count(*) FILTER (truth = {k} AND class_final = {k}) / nullif(count(*) FILTER (truth = {k}), 0), 0), 5) AS recall, round(coalesce(2 * count(*) FILTER (truth = {k} AND class_final = {k}) / nullif(count(*) FILTER (truth = {k}) + count(*) FILTER (class_final = {k}), 0), 0), 5) AS f1, count(*) FILTER (truth = {k}) AS support FROM final" for k in range(4)))
def metric_per_class(spark, d):
    return rounded(metrics.per_class(metrics.confusion(judged(spark, d), "truth", "class_final")))


_RATES = "SELECT round(avg(CASE WHEN truth = class_final THEN 1 ELSE 0 END), 5) AS accuracy, round(avg(CASE WHEN abs(truth - class_final) >= 2 THEN 1 ELSE 0 END), 5) AS severe, round(avg(CASE WHEN class_final > truth THEN 1 ELSE 0 END), 5) AS over, round(avg(CASE WHEN class_final < truth THEN 1 ELSE 0 END), 5) AS under FROM final"


@query(_RATES)
def metric_alert_rates(spark, d):
    return rounded(metrics.alert_rates(metrics.confusion(judged(spark, d), "truth", "class_final")))


@query(_RATES)
def metric_rates_of_matrix(spark, d):
    counts = metrics.confusion(judged(spark, d), "truth", "class_final")
    cell = lambda y, p: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("n"))), F.lit(0))
    stored = counts.agg(F.array(*(F.array(*(cell(y, p) for p in range(4))) for y in range(4))).alias("matrix"))
    return rounded(metrics.alert_rates(metrics.exploded_matrix(stored)))


_SHARE = "CASE WHEN station_id % 5 = 0 THEN NULL ELSE round(avg(CASE WHEN {} THEN 1 ELSE 0 END), 5) END"


@query(f"""SELECT station_id, CASE WHEN station_id % 2 = 0 THEN -1 ELSE {_SHARE.format('truth = class_final')} END AS accuracy, {_SHARE.format('abs(truth - class_final) >= 2')} AS severe,
 {_SHARE.format('class_final > truth')} AS over, CASE WHEN station_id % 3 = 0 THEN -2 ELSE {_SHARE.format('class_final < truth')} END AS under FROM final GROUP BY station_id""")
def metric_completed(spark, d):
    """Stored matrices of stations, some with rates of their own, which stay, and some of another shape, which fill nothing."""
    cell = lambda y, p: F.count_if((F.col("truth") == y) & (F.col("class_final") == p))
    row = lambda y: F.array(*(cell(y, p) for p in range(4)))
    stored = judged(spark, d).groupBy("station_id").agg(F.array(*map(row, range(4))).alias("whole"))
    stored = stored.select("station_id", F.when(F.col("station_id") % 5 == 0, F.slice("whole", 1, 3)).otherwise(F.col("whole")).alias("matrix"), F.when(F.col("station_id") % 2 == 0, -1.0).alias("accuracy"), F.when(F.col("station_id") % 3 == 0, -2.0).alias("under"))
    return rounded(metrics.completed(stored).drop("matrix"))


@query("SELECT count(*) FILTER (class_final <> class_by_value) AS n_overrides, round(avg(CASE WHEN class_final <> class_by_value THEN 1 ELSE 0 END), 5) AS override_rate, count(*) FILTER (class_final > class_by_value) AS n_escalations, round(avg(CASE WHEN class_final > class_by_value THEN 1 ELSE 0 END), 5) AS escalation_rate FROM final")
def metric_overrides(spark, d):
    return rounded(metrics.overrides(judged(spark, d), "class_final", "class_by_value"))


_BINS = "SELECT truth, k - 1 AS class_id, proba[k] AS p FROM judged, (SELECT unnest([1, 2, 3, 4]) AS k)"
_BIN = "CAST(" + " + ".join(f"CAST(p {{}} {i / 10}::DOUBLE AS INTEGER)" for i in range(1, 10)) + " AS BIGINT)"
_REL = "SELECT class_id, {} AS bin, avg(p) AS mean_p, avg(CASE WHEN truth = class_id THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM ({}) GROUP BY 1, 2"
_UPPER = _REL.format(_BIN.replace("{}", ">="), _BINS)
_LOWER = _REL.format(_BIN.replace("{}", ">"), _BINS)


@query(f"SELECT class_id, round(sum(n * abs(mean_p - share)) / sum(n), 5) AS ece FROM ({_UPPER}) GROUP BY 1")
def metric_calibration_error(spark, d):
    return rounded(metrics.calibration_error(judged(spark, d), "truth", "proba"))


@query(f"SELECT class_id, bin, round(mean_p, 5) AS mean_p, round(share, 5) AS share, n FROM ({_LOWER})")
def metric_reliability(spark, d):
    return rounded(metrics.reliability(judged(spark, d), "truth", "proba", lower=True))


@query("SELECT round(sqrt(avg((predicted - pm10) * (predicted - pm10))), 5) AS rmse FROM judged WHERE truth = 3")
def metric_worst_class(spark, d):
    return rounded(metrics.regression(judged(spark, d).where("truth = 3")).select("rmse"))


@query(f"SELECT strategy, complexity, round(f1_macro, 5) AS f1_macro, round(severe, 5) AS severe, round(over, 5) AS over, round(recall_worst, 5) AS recall_worst FROM ({_STRATEGIES})")
def select_metrics(spark, d):
    return rounded(strategies(spark, d))


_TRIED = "SELECT truth, delta, least, CASE WHEN distance <= delta AND class_by_model > class_by_value AND proba[class_by_model + 1] >= least THEN class_by_model ELSE class_by_value END AS p FROM judged, (SELECT unnest([3.0::DOUBLE, 5, 7]) AS delta), (SELECT unnest([0.25::DOUBLE, 0.35, 0.45]) AS least)"


@query(f"""SELECT delta, least, round(f1_macro, 5) AS f1_macro, round(severe, 5) AS severe, round(over, 5) AS over, round(recall_worst, 5) AS recall_worst, round(score, 5) AS score,
 row_number() OVER (ORDER BY score DESC, f1_macro DESC, recall_worst DESC, severe, over, delta, least DESC) AS place, max(score) OVER () - min(score) OVER () < 0.005 AS is_flat
 FROM (SELECT *, f1_macro - severe - 0.5 * (1 - recall_worst) AS score FROM (SELECT delta, least, {_MACRO} FROM ({_TRIED}) GROUP BY 1, 2))""")
def select_tuned(spark, d):
    return rounded(metrics.tune(judged(spark, d).select("truth", "predicted", "proba")))


@query(f"SELECT strategy AS model, round(f1_macro, 5) AS f1_macro, place FROM (SELECT strategy, f1_macro, row_number() OVER (ORDER BY f1_macro DESC, strategy) AS place, max(f1_macro) OVER () AS best FROM ({_STRATEGIES}) WHERE strategy IN ('value', 'hybrid')) WHERE place = 1 OR (place = 2 AND best - f1_macro <= 0.005)")
def select_candidates(spark, d):
    return rounded(metrics.rank_candidates(strategies(spark, d).withColumnRenamed("strategy", "model"), ["value", "hybrid"]))


def _selection(severe: float, recall: float) -> str:
    flagged = f"SELECT *, severe <= {severe} AS c1, recall_worst >= {recall} AS c2 FROM ({_STRATEGIES})"
    every = f"SELECT bool_or(c1) AS any1, bool_or(c2) AS any2, bool_or(c1 AND c2) AS all_ok, max(f1_macro) FILTER (c1 AND c2) AS top FROM ({flagged})"
    return f"""SELECT all_ok AS production_ready, CASE WHEN all_ok THEN strategy END AS selected, CASE WHEN NOT all_ok THEN strategy END AS candidate, round(f1_macro, 5) AS f1_macro, round(severe, 5) AS severe,
 round(recall_worst, 5) AS recall_worst, CASE WHEN all_ok THEN '' WHEN any1 AND any2 THEN 'both' WHEN any1 THEN 'recall' WHEN any2 THEN 'severe' ELSE 'severe,recall' END AS failed FROM ({flagged}), ({every})
 WHERE CASE WHEN all_ok THEN c1 AND c2 AND f1_macro >= top - 0.005 WHEN any1 THEN c1 ELSE true END ORDER BY CASE WHEN all_ok THEN complexity END, f1_macro DESC, strategy LIMIT 1"""


@query(_selection(0.025, 0.65))
def select_strategy(spark, d):
    return rounded(metrics.select_strategy(strategies(spark, d)))


@query(_selection(0.9, 0.1))
def select_strategy_wide(spark, d):
    """Limits that all strategies meet: the simplest of the tied is selected."""
    return rounded(metrics.select_strategy(strategies(spark, d), 0.9, 0.1))


@query(_selection(0.3, 0.99))
def select_strategy_recall(spark, d):
    """A recall that none has: a candidate within the severe limit."""
    return rounded(metrics.select_strategy(strategies(spark, d), 0.3, 0.99))


@query(f"SELECT strategy, CASE WHEN severe > 0.025 AND recall_worst < 0.65 THEN 'C1-FAIL C2-FAIL' WHEN severe > 0.025 THEN 'C1-FAIL' WHEN recall_worst < 0.65 THEN 'C2-FAIL' ELSE 'PASS' END AS tag, row_number() OVER (ORDER BY CASE WHEN strategy = 'value' THEN 1 ELSE 2 END, strategy) AS place FROM ({_STRATEGIES})")
def select_comparison(spark, d):
    return rounded(metrics.comparison(strategies(spark, d), ["value"]).select("strategy", "tag", "place"))


@query(f"SELECT a.strategy, round(a.f1_macro - b.f1_macro, 5) + 0.0 AS f1_macro_delta, round(a.severe - b.severe, 5) + 0.0 AS severe_delta, round(a.recall_worst - b.recall_worst, 5) + 0.0 AS recall_worst_delta FROM ({_STRATEGIES}) a, ({_STRATEGIES}) b WHERE b.strategy = 'value'")
def select_deltas(spark, d):
    return rounded(metrics.deltas(strategies(spark, d), "value"))


_WEEK = "w7d AS (SELECT DISTINCT day FROM daily_target ORDER BY day DESC LIMIT 7)"


@query("SELECT DISTINCT day FROM daily_target ORDER BY day DESC LIMIT 7")
def serve_latest_days(spark, d):
    return serve.latest_days(A.daily_target(spark, d))


@query("SELECT p.station_id, count(DISTINCT t.day) AS valid_days, max(t.day) AS last_valid, CASE WHEN count(DISTINCT t.day) >= 6 THEN 'ok' WHEN count(DISTINCT t.day) >= 3 THEN 'partial' ELSE 'stale' END AS quality FROM provinces p LEFT JOIN daily_target t ON p.station_id = t.station_id AND t.day IN (SELECT DISTINCT day FROM daily_target ORDER BY day DESC LIMIT 7) GROUP BY 1")
def serve_quality(spark, d):
    rows = A.daily_target(spark, d)
    return rounded(serve.data_quality(A.provinces(spark, d), rows.join(serve.latest_days(rows), "day", "left_semi")))


@query("SELECT max(day) AS day FROM daily_target")
def serve_latest_day(spark, d):
    rows = A.daily_target(spark, d)
    return serve.latest_day(rows.where("station_id % 2 = 0"), rows.where("station_id % 2 = 1"))


@query("""SELECT station_id, day, round(coalesce(max(CASE WHEN s = 0 THEN pm10 END), max(CASE WHEN s = 1 THEN pm10 END), max(CASE WHEN s = 2 THEN pm10 END)), 5) AS pm10 FROM (
 SELECT station_id, day, pm10, 0 AS s FROM filled WHERE station_id % 2 = 0 UNION ALL SELECT station_id, day, pm10 + 1, 1 FROM filled WHERE day NOT IN (SELECT day FROM filled WHERE station_id % 2 = 0 AND pm10 IS NOT NULL AND day BETWEEN DATE '1998-01-01' AND DATE '1998-02-28')
 UNION ALL SELECT station_id, day, 1.0, 2 FROM filled WHERE station_id % 5 = 0) WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-02-28' GROUP BY 1, 2""")
def serve_recent_window(spark, d):
    from aerolith.operators import panel

    f = panel.fill_days(A.daily_target(spark, d))
    none = f.sparkSession.createDataFrame([], "station_id long, day date, temp_mean double")
    out = serve.recent_window(f.where("station_id % 2 = 0"), f.withColumn("pm10", F.col("pm10") + 1), f.where("station_id % 5 = 0").withColumn("pm10", F.lit(1.0)), none, "1998-01-01", "1998-02-28")
    return rounded(out.select("station_id", "day", "pm10"))


@query("""SELECT station_id, day, round(CASE WHEN pm10 > 0 THEN pm10 END, 5) AS pm10, CASE WHEN NOT pm10 > 0 OR pm10 IS NULL THEN NULL WHEN pm10 < 20 THEN 'verde' WHEN pm10 < 35 THEN 'giallo' WHEN pm10 < 50 THEN 'arancio' ELSE 'rosso' END AS alert_class FROM (
 SELECT station_id, day, pm10 FROM daily_target WHERE day < DATE '1999-01-01' + CAST(station_id AS INTEGER) UNION ALL
 SELECT w.station_id, w.day, w.pm10 - 10 FROM daily_target w LEFT JOIN (SELECT station_id, max(day) AS cut FROM daily_target WHERE day < DATE '1999-01-01' + CAST(station_id AS INTEGER) GROUP BY 1) c ON w.station_id = c.station_id WHERE cut IS NULL OR w.day > cut)
 WHERE day BETWEEN DATE '1998-06-01' AND DATE '1999-06-30'""")
def serve_history(spark, d):
    rows = A.daily_target(spark, d)
    store = rows.where(F.col("day") < F.date_add(F.lit("1999-01-01").cast("date"), F.col("station_id").cast("int")))
    return rounded(serve.history(store, rows.withColumn("pm10", F.col("pm10") - 10), "1998-06-01", "1999-06-30"))


@query("SELECT station_id, arg_max(round(pm10, 5), day) AS pm10, max(day) AS last_day FROM daily_target GROUP BY 1")
def serve_latest_metadata(spark, d):
    rows = A.daily_target(spark, d).withColumn("last_day", F.col("day"))
    return rounded(serve.latest_metadata(rows, ["pm10", "last_day"]))


@query("SELECT station_id, day, round(pm10, 5) AS pm10 FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS k FROM daily_target) WHERE k <= 8")
def serve_last_rows(spark, d):
    return rounded(serve.last_rows(A.daily_target(spark, d)))


@query("""SELECT station_id, round(arg_max(temp_mean, day), 4) AS lag1, round(max(CASE WHEN k = 2 THEN temp_mean END), 4) AS lag2, round(CASE WHEN count(temp_mean) FILTER (k <= 3) = 3 THEN avg(temp_mean) FILTER (k <= 3) END, 4) AS roll3
 FROM (SELECT station_id, day, temp_mean, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS k FROM daily_weather) WHERE k <= 8 GROUP BY 1""")
def serve_positional_lags(spark, d):
    from aerolith.operators import daily

    w = daily.daily_weather(A.hourly_weather(spark, d)).select("station_id", "day", "temp_mean")
    arrays = serve.ordered_values(serve.last_rows(w), ["temp_mean"])
    return rounded(arrays.select("station_id", *(v.alias(k) for k, v in serve.positional(F.col("temp_mean")).items())), 4)


@query("""SELECT station_id, round(max(CASE WHEN v = 1 THEN f END), 4) AS pm10_lag1, round(max(CASE WHEN v = 2 THEN f END), 4) AS pm10_lag2,
 round(CASE WHEN count(f) FILTER (k <= 7) >= 3 THEN avg(f) FILTER (k <= 7) END, 4) AS pm10_roll7, round(CASE WHEN count(f) FILTER (k <= 3) >= 2 THEN avg(f) FILTER (k <= 3) END, 4) AS pm10_roll3,
 round(max(CASE WHEN v = 1 THEN f END) - max(CASE WHEN v = 2 THEN f END), 4) AS pm10_diff FROM (
 SELECT *, CASE WHEN f IS NOT NULL THEN count(f) OVER (PARTITION BY station_id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS v FROM (
 SELECT *, last_value(pm10 IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM (
 SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS k FROM filled) WHERE k <= 8)) GROUP BY 1""")
def serve_lag_context(spark, d):
    from aerolith.operators import panel

    arrays = serve.ordered_values(serve.last_rows(panel.fill_days(A.daily_target(spark, d))), ["pm10"])
    return rounded(arrays.select("station_id", *(v.alias(k) for k, v in serve.pm10_context(F.col("pm10")).items())), 4)


@query("SELECT station_id FROM daily_target WHERE day = (SELECT max(day) FROM daily_target)")
def serve_live_stations(spark, d):
    rows = A.daily_target(spark, d)
    return serve.stations_with_value(rows, str(serve.latest_day(rows).first()["day"]))


def serving(spark, d):
    """Recent rows, weather of two days ahead (one of them missing for some), quality, and metadata (missing for some) of the stations."""
    rows = raw_panel(spark, d).join(A.pollutants(spark, d), ["station_id", "day"], "left")
    recent = serve.last_rows(rows).where("station_id % 11 <> 10")
    last = recent.groupBy("station_id").agg(F.max("day").alias("day"), *(F.max_by(c, "day").alias(c) for c in serve.AHEAD))
    ahead = last.select("station_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("i"), *(c for c in last.columns if c != "station_id"))
    ahead = ahead.withColumns({
        "day": F.date_add("day", F.col("i")), "temp_mean": F.coalesce("temp_mean", F.lit(12.0)) + F.col("i"), "pressure_mean": F.lit(1010.0) + F.col("station_id"), "wind_speed_mean": F.col("station_id") / 10.0,
        "blh_min": F.when(F.col("station_id") % 6 != 5, F.lit(90.0) * F.col("i")),
    }).where("not (station_id % 9 = 4 and i = 2)").drop("i")
    quality = serve.data_quality(A.provinces(spark, d), recent, ok=3, partial=1)
    metadata = A.provinces(spark, d).join(A.proximity(spark, d), "station_id", "left").where("station_id <> 8")
    return recent, ahead, quality, metadata


def stand_in(rows: DataFrame) -> DataFrame:
    """A score by rule instead of a model, so that SQL can say it."""
    value = 0.7 * F.coalesce("pm10_lag1", F.lit(25.0)) + 0.2 * F.coalesce("pm10_roll3", F.lit(10.0)) + 0.3 * F.col("temp_mean") + 0.001 * F.coalesce("no2_mean", F.lit(0.0))
    by_day = F.when(F.col("weekday") % 2 == 0, F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))).otherwise(F.array(*map(F.lit, (0.1, 0.6, 0.2, 0.1))))
    return rows.withColumns({"predicted": value, "proba": by_day})


_RECENT = "SELECT r.*, p.no2_mean FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS k FROM lagged) r LEFT JOIN pollutants p ON r.station_id = p.station_id AND r.day = p.day WHERE k <= 8 AND r.station_id % 11 <> 10"
_SERVED = """recent AS ({recent}),
quality AS (SELECT p.station_id, count(DISTINCT r.day) AS valid_days, CASE WHEN count(DISTINCT r.day) >= 3 THEN 'ok' WHEN count(DISTINCT r.day) >= 1 THEN 'partial' ELSE 'stale' END AS quality FROM provinces p LEFT JOIN recent r ON p.station_id = r.station_id AND r.pm10 IS NOT NULL GROUP BY 1),
ahead AS (SELECT station_id, i, day + CAST(i AS INTEGER) AS day, coalesce(temp_mean, 12.0) + i AS temp_mean, 1010.0::DOUBLE + station_id AS pressure_mean, station_id / 10 AS wind_speed_mean, wind_speed_max, blh_mean,
  CASE WHEN station_id % 6 <> 5 THEN 90.0::DOUBLE * i END AS blh_min, precip_sum FROM recent, (SELECT unnest([1, 2]) AS i) WHERE k = 1 AND NOT (station_id % 9 = 4 AND i = 2)),
meta AS (SELECT p.*, q.dist_industrial_km FROM provinces p LEFT JOIN proximity q ON p.station_id = q.station_id WHERE p.station_id <> 8),
reasons AS (SELECT q.*, CASE WHEN m.station_id IS NULL THEN 'unknown' WHEN q.quality = 'stale' OR h.station_id IS NULL THEN 'stale' WHEN coalesce(a.n, 0) < 2 THEN 'no_weather' END AS reason FROM quality q
  LEFT JOIN meta m ON q.station_id = m.station_id LEFT JOIN (SELECT DISTINCT station_id FROM recent) h ON q.station_id = h.station_id LEFT JOIN (SELECT station_id, count(*) AS n FROM ahead GROUP BY 1) a ON q.station_id = a.station_id),
rows1 AS (SELECT station_id, day, pm10, pressure_mean, wind_speed_mean, blh_mean, temp_mean, no2_mean FROM recent),"""
_STEP = """fill{i} AS (SELECT *, last_value(pm10 IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS k FROM rows{i}),
count{i} AS (SELECT *, CASE WHEN f IS NOT NULL THEN count(f) OVER (PARTITION BY station_id ORDER BY k) END AS v FROM fill{i}),
lags{i} AS (SELECT station_id, max(f) FILTER (v = 1) AS pm10_lag1, max(f) FILTER (v = 2) AS pm10_lag2, CASE WHEN count(f) FILTER (k <= 7) >= 3 THEN avg(f) FILTER (k <= 7) END AS pm10_roll7,
  CASE WHEN count(f) FILTER (k <= 3) >= 2 THEN avg(f) FILTER (k <= 3) END AS pm10_roll3, max(pressure_mean) FILTER (k = 1) AS pressure_mean_lag1, max(no2_mean) FILTER (k = 1) AS no2_mean,
  CASE WHEN count(wind_speed_mean) FILTER (k <= 3) = 3 THEN avg(wind_speed_mean) FILTER (k <= 3) END AS wind_speed_roll3 FROM count{i} GROUP BY 1),
made{i} AS (SELECT a.*, {i} AS horizon, l.* EXCLUDE (station_id), r.quality, r.valid_days, l.pm10_lag1 - l.pm10_lag2 AS pm10_diff, CAST(month(a.day) IN (10, 11, 12, 1, 2, 3) AS INTEGER) AS heating_season, m.province, m.dist_industrial_km,
  CASE WHEN month(a.day) IN (12, 1, 2) THEN 'winter' WHEN month(a.day) IN (3, 4, 5) THEN 'spring' WHEN month(a.day) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
  CASE WHEN a.blh_min IS NOT NULL THEN a.pressure_mean > 1013.25 AND a.wind_speed_mean < 1.5 AND a.blh_min < 500 END AS stagnation_flag,
  CASE WHEN a.blh_min IS NOT NULL THEN 1 / (greatest(a.wind_speed_mean, 0.1) * greatest(a.blh_min, 10) * (1 + coalesce(a.precip_sum, 0))) END AS stagnation_index,
  0.7 * coalesce(l.pm10_lag1, 25.0) + 0.2 * coalesce(l.pm10_roll3, 10.0) + 0.3 * a.temp_mean + 0.001 * coalesce(l.no2_mean, 0.0) AS predicted,
  CASE WHEN (isodow(a.day) - 1) % 2 = 0 THEN [0.1, 0.2, 0.3, 0.4] ELSE [0.1, 0.6, 0.2, 0.1] END AS proba
  FROM ahead a JOIN reasons r ON a.station_id = r.station_id AND r.reason IS NULL JOIN lags{i} l ON a.station_id = l.station_id JOIN meta m ON a.station_id = m.station_id WHERE a.i = {i})"""
_NEXT = "rows2 AS (SELECT * FROM rows1 UNION ALL SELECT station_id, day, predicted, pressure_mean, wind_speed_mean, blh_mean, temp_mean, no2_mean FROM made1)"
_FORECAST = f"""WITH {_SERVED.format(recent=_RECENT)} {_STEP.format(i=1)}, {_NEXT}, {_STEP.format(i=2)},
ruled AS (SELECT *, CASE WHEN predicted < 20 THEN 0 WHEN predicted < 35 THEN 1 WHEN predicted < 50 THEN 2 ELSE 3 END AS v, list_position(proba, list_max(proba)) - 1 AS c, least(abs(predicted - 20), abs(predicted - 35), abs(predicted - 50)) <= 5 AS near
  FROM (SELECT * FROM made1 UNION ALL SELECT * FROM made2)),
judged2 AS (SELECT *, proba[greatest(v, c) + 1] >= 0.35 AS sure FROM ruled)
SELECT station_id, day, horizon, quality, valid_days, coalesce((SELECT count(*) FROM recent r WHERE r.station_id = j.station_id AND r.day = j.day - horizon AND r.pm10 IS NOT NULL) > 0, false) AS live, round(predicted, 2) AS predicted,
 CASE WHEN near AND v <> c AND sure AND c > v THEN c ELSE v END AS class_final, CASE WHEN NOT near THEN 'regression' WHEN v = c THEN 'hybrid_agreement' WHEN sure THEN 'hybrid_override' ELSE 'hybrid_no_override' END AS source,
 round(temp_mean, 5) AS temp_mean, round(pm10_lag1, 5) AS pm10_lag1, round(pm10_lag2, 5) AS pm10_lag2, round(pm10_roll3, 5) AS pm10_roll3, round(pm10_roll7, 5) AS pm10_roll7, round(pm10_diff, 5) AS pm10_diff, round(pressure_mean, 5) AS pressure_mean,
 round(pressure_mean_lag1, 5) AS pressure_mean_lag1, round(wind_speed_mean, 5) AS wind_speed_mean, round(wind_speed_max, 5) AS wind_speed_max, round(wind_speed_roll3, 5) AS wind_speed_roll3, round(blh_mean, 5) AS blh_mean, round(blh_min, 5) AS blh_min,
 round(precip_sum, 5) AS precip_sum, round(stagnation_index, 9) AS stagnation_index, round(no2_mean, 5) AS no2_mean, CAST(NULL AS DOUBLE) AS o3_mean, CAST(heating_season AS DOUBLE) AS heating_season, dist_industrial_km, stagnation_flag, season, province FROM judged2 j"""


@query(f"SELECT * FROM ({_FORECAST})")
def serve_forecast(spark, d):
    """Two days ahead for every station that is not refused, with all drivers shown; the second day rests on the first day's unrounded value."""
    out = serve.forecast(*serving(spark, d), stand_in).forecasts
    return rounded(out.select(*(c for c in out.columns if c not in ("weather_used", "drivers")), "drivers.*"), 5, stagnation_index=9)


@query(f"SELECT * FROM (WITH {_SERVED.format(recent=_RECENT)} one AS (SELECT 1) SELECT station_id, reason, quality, valid_days FROM reasons WHERE reason IS NOT NULL)")
def serve_refused(spark, d):
    """Stations without metadata, with stale rows, or without the weather asked for."""
    return serve.forecast(*serving(spark, d), stand_in).refused


@query(f"SELECT 'strategy' AS kind, arg_max(strategy, f1_macro) AS best FROM ({_STRATEGIES}) UNION ALL SELECT 'worst class', arg_max(strategy, recall_worst) FROM ({_STRATEGIES})")
def select_best(spark, d):
    """The best strategy by f1_macro and by the recall of the worst class."""
    rows = strategies(spark, d)
    best = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.max_by("strategy", c).alias("best"))
    return rows.agg(F.array(best("strategy", "f1_macro"), best("worst class", "recall_worst")).alias("b")).select(F.inline("b"))


_QUALITY = "SELECT p.station_id, count(DISTINCT t.day) AS valid_days, max(t.day) AS last_valid, CASE WHEN count(DISTINCT t.day) >= 6 THEN 'ok' WHEN count(DISTINCT t.day) >= 3 THEN 'partial' ELSE 'stale' END AS quality FROM provinces p LEFT JOIN daily_target t ON p.station_id = t.station_id AND t.day > (SELECT max(day) FROM daily_target) - 60 GROUP BY 1"
_LIVE = "SELECT station_id FROM daily_target WHERE day > (SELECT max(day) FROM daily_target) - 30 GROUP BY 1 HAVING count(*) % 2 = 0"


def recent_quality(spark, d) -> tuple[DataFrame, DataFrame]:
    """Quality over the last 60 days, and some stations taken as live."""
    rows = A.daily_target(spark, d)
    last = F.lit(rows.agg(F.max("day")).first()[0])
    live = rows.where(F.col("day") > F.date_sub(last, 30)).groupBy("station_id").count().where("count % 2 = 0").select("station_id")
    return serve.data_quality(A.provinces(spark, d), rows.where(F.col("day") > F.date_sub(last, 60))), live


@query(f"SELECT p.station_id, p.station_name, p.province, p.municipality, round(p.altitude, 5) AS altitude, round(p.lat, 5) AS lat, round(p.lng, 5) AS lng, q.valid_days, q.last_valid, q.quality, l.station_id IS NOT NULL AS is_live FROM provinces p LEFT JOIN ({_QUALITY}) q ON p.station_id = q.station_id LEFT JOIN ({_LIVE}) l ON p.station_id = l.station_id WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL")
def serve_station_list(spark, d):
    return rounded(serve.station_list(A.provinces(spark, d), *recent_quality(spark, d)))


_LAST_CLASS = "SELECT station_id, CASE WHEN v < 20 THEN 0 WHEN v < 35 THEN 1 WHEN v < 50 THEN 2 ELSE 3 END AS k FROM (SELECT station_id, arg_max(pm10, day) AS v FROM daily_target WHERE station_id % 4 <> 2 GROUP BY 1)"


@query(f"SELECT p.station_id, CASE k WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'orange' WHEN 3 THEN 'red' ELSE 'grey' END AS fill, CASE quality WHEN 'ok' THEN 'solid' WHEN 'partial' THEN 'dashed' ELSE 'dotted' END AS border FROM provinces p LEFT JOIN ({_QUALITY}) q ON p.station_id = q.station_id LEFT JOIN ({_LAST_CLASS}) c ON p.station_id = c.station_id WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL")
def serve_map_rows(spark, d):
    """Stations with the class of their last day as a forecast; some have none."""
    last = A.daily_target(spark, d).where("station_id % 4 <> 2").groupBy("station_id").agg(F.max_by("pm10", "day").alias("v"))
    forecasts = last.select("station_id", F.lit(1).alias("horizon"), C.class_of_prediction("v").alias("class_final"))
    return serve.map_rows(serve.station_list(A.provinces(spark, d), *recent_quality(spark, d)), forecasts)


_LAG8 = "SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY day DESC) AS k FROM (SELECT w.*, t.pm10, p.no2_mean FROM daily_weather w LEFT JOIN daily_target t ON w.station_id = t.station_id AND w.day = t.day LEFT JOIN pollutants p ON w.station_id = p.station_id AND w.day = p.day) WHERE pressure_mean IS NOT NULL"
_LAGGED = ", ".join(f"round(max({c}) FILTER (k = {i}), 4) AS {c}_lag{i}" for c in ("pressure_mean", "wind_speed_mean", "blh_mean", "temp_mean") for i in (1, 2))
_ROLLED = ", ".join(f"round(CASE WHEN count({c}_mean) FILTER (k <= 3) = 3 THEN avg({c}_mean) FILTER (k <= 3) END, 4) AS {c}_roll3" for c in ("pressure", "wind_speed"))
_SAME = ", ".join(f"round(max({c}) FILTER (k = 1), 4) AS {c}" for c in ("humidity_mean", "dewpoint_mean", "precip_sum", "pressure_mean", "cloud_cover_mean", "wind_speed_mean", "wind_speed_max", "radiation_mean", "blh_mean", "blh_min", "fog_hours", "no2_mean"))
_TURNS = ", ".join(f"round({f}({c} * 2 * pi() / {n}), 4) AS {name}_{f}" for name, c, n in (("month", "month", 12), ("weekday", "weekday", 7)) for f in ("sin", "cos"))


@query(f"""SELECT f.*, {_TURNS}, CAST(month IN (10, 11, 12, 1, 2, 3) AS INTEGER) AS heating_season, CAST(weekday >= 5 AS INTEGER) AS is_weekend,
 CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, p.province, p.altitude, p.lat, p.lng, q.dist_industrial_km, round(g1, 4) AS pm10_lag1, round(g2, 4) AS pm10_lag2, round(g1 - g2, 4) AS pm10_diff, round(g7, 4) AS pm10_roll7, round(g3, 4) AS pm10_roll3
 FROM (SELECT station_id, max(day) + 1 AS day, month(max(day) + 1) AS month, isodow(max(day) + 1) - 1 AS weekday, round(max(temp_mean) FILTER (k = 1) + 1, 4) AS temp_mean, {_SAME}, {_LAGGED}, {_ROLLED}, CAST(NULL AS DOUBLE) AS o3_mean, CAST(NULL AS DOUBLE) AS no2_max, CAST(NULL AS DOUBLE) AS o3_max,
 CAST(round(max(pressure_mean) FILTER (k = 1), 6) > 1013.25 AND round(max(wind_speed_mean) FILTER (k = 1), 6) < 1.5 AND round(max(blh_min) FILTER (k = 1), 6) < 500 AS INTEGER) AS stagnation_flag,
 round(1 / (greatest(max(wind_speed_mean) FILTER (k = 1), 0.1) * greatest(max(blh_min) FILTER (k = 1), 10) * (1 + coalesce(max(precip_sum) FILTER (k = 1), 0))), 9) AS stagnation_index FROM ({_LAG8}) WHERE k <= 8 GROUP BY 1) f
 JOIN provinces p ON f.station_id = p.station_id LEFT JOIN proximity q ON f.station_id = q.station_id
 JOIN (SELECT station_id, max(f) FILTER (v = 1) AS g1, max(f) FILTER (v = 2) AS g2, CASE WHEN count(f) FILTER (k <= 7) >= 3 THEN avg(f) FILTER (k <= 7) END AS g7, CASE WHEN count(f) FILTER (k <= 3) >= 2 THEN avg(f) FILTER (k <= 3) END AS g3 FROM (
  SELECT *, CASE WHEN f IS NOT NULL THEN count(f) OVER (PARTITION BY station_id ORDER BY k) END AS v FROM (
  SELECT *, last_value(pm10 IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM ({_LAG8}) WHERE k <= 8)) GROUP BY 1) g ON f.station_id = g.station_id""")
def serve_future_features(spark, d):
    """All columns of the feature rows of the day after each station's last weather day, with that day's weather one degree warmer."""
    from aerolith.operators import daily

    w = daily.daily_weather(A.hourly_weather(spark, d)).where("pressure_mean is not null").join(A.daily_target(spark, d), ["station_id", "day"], "left").join(A.pollutants(spark, d), ["station_id", "day"], "left")
    last = w.groupBy("station_id").agg(F.max("day").alias("day"), *(F.max_by(c, "day").alias(c) for c in serve.AHEAD))
    ahead = last.withColumns({"day": F.date_add("day", 1), "temp_mean": F.col("temp_mean") + 1})
    metadata = A.provinces(spark, d).join(A.proximity(spark, d), "station_id", "left")
    return rounded(serve.future_features(w, ahead, metadata), 4, stagnation_index=9)
