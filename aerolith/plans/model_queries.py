"""Queries of models, clusterings, the spectral diagnostic, polygons and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import cluster, metrics, models, serve, silhouettes, spatial, spectral, splits
from aerolith.operators.neighbours import eps_degrees
from aerolith.plans import adapters as A
from aerolith.plans.panel_queries import modelled, rounded
from aerolith.plans.registry import query
from aerolith.sources import days
from aerolith.sources.scratch import fresh_path, written
from aerolith.streaming import jobs

NUMERIC = ["pm10_lag1", "pm10_lag2", "pm10_roll3", "pm10_roll7", "month_sin", "month_cos", "temp_mean", "wind_speed_mean"]

#: Radius of neighbours among whole embeddings: the median distance to the third neighbour on the small tables.
EPS = 1.17


def split_rows(spark, d) -> DataFrame:
    rows = splits.valid_targets(modelled(spark, d).where("pm10_lag1 is not null or pm10_roll7 is not null"))
    folds = splits.temporal_folds(splits.temporal_split(written(rows.select("station_id", "day", "season", "pm10", "class_id", *NUMERIC), "targets")))
    return written(folds, "model-rows")


def points(spark, d) -> DataFrame:
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query()
def spectral_eigenvalues(spark, d):
    return rounded(spectral.diagnostic(modelled(spark, d), NUMERIC)["eigenvalues"])


@query()
def spectral_loadings(spark, d):
    out = spectral.diagnostic(modelled(spark, d), NUMERIC, iterations=0)["loadings"]  # loadings have no part in the null spectra
    return rounded(out.withColumn("loading", F.abs("loading")), 4)


@query()
def spectral_null_models(spark, d):
    """The largest eigenvalues under each null model."""
    rows = written(modelled(spark, d).select("station_id", "day", *NUMERIC), "spectral")
    out = None
    for name in spectral.NULLS:
        one = spectral.diagnostic(rows, NUMERIC, null=name)["summary"].withColumn("null_model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_LIMITED = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in NUMERIC[:4])
_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in NUMERIC[:4])
_SCALED = f"SELECT station_id, day, {_Z} FROM (SELECT station_id, day, {_LIMITED} FROM modelled)"


@query("SELECT unnest(['pm10_lag1', 'month_sin', 'temp_mean']) AS column_name FROM (SELECT count(DISTINCT pm10_lag1) > 1 AND count(DISTINCT month) > 1 AND count(DISTINCT temp_mean) > 1 AS varied FROM modelled) WHERE varied")
def spectral_features(spark, d):
    """Usable features among some that are constant or never known."""
    rows = modelled(spark, d).withColumns({"same": F.lit(1.0), "none": F.lit(None).cast("double"), "endless": F.lit(float("inf"))})
    return spark.createDataFrame([(c,) for c in spectral.usable_features(rows, ["pm10_lag1", "same", "month_sin", "none", "endless", "temp_mean"])], "column_name string")


@query(f"SELECT station_id, day, {', '.join(f'round({c}, 4) AS {c}' for c in NUMERIC[:4])} FROM ({_SCALED})")
def spectral_standardised(spark, d):
    z, names = spectral.standardised(modelled(spark, d), NUMERIC[:4])
    return rounded(z.select("station_id", "day", *names), 4)


_SQUARES = " + ".join(f"power(corr({a}, {b}), 2)" for a in NUMERIC[:4] for b in NUMERIC[:4])


@query(f"SELECT 4 AS n_features, count(*) AS n_rows, round(power(1 - sqrt(4 / count(*)), 2), 5) AS mp_low, round(power(1 + sqrt(4 / count(*)), 2), 5) AS mp_high, 4.0 AS total, round({_SQUARES}, 3) AS squares FROM ({_SCALED})")
def spectral_moments(spark, d):
    """Bounds, and the sums of the eigenvalues and of their squares, which are those of the correlation matrix."""
    out = spectral.diagnostic(modelled(spark, d), NUMERIC[:4], iterations=0)
    sums = out["eigenvalues"].agg(F.round(F.sum("eigenvalue"), 5).alias("total"), F.round(F.sum(F.col("eigenvalue") ** 2), 3).alias("squares"))
    return rounded(out["summary"].select("n_features", "n_rows", "mp_low", "mp_high").join(sums))


@query()
def model_regression(spark, d):
    """Elastic net on the log target: measures on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    features = models.prepared(train, NUMERIC, ["season"], scale=True)
    scored = models.fit_regressor(features(train), "elastic_net", regParam=0.01, elasticNetParam=0.5)(features(test))
    return metrics.regression(scored)


@query()
def model_forest_search(spark, d):
    """Two depths of a forest over two expanding folds, then the better one on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'").drop("val_fold"), rows.where("split = 'test'")
    features = models.prepared(train, NUMERIC)
    folds = splits.temporal_folds(features(train), 2)
    fit = lambda part, p: models.fit_regressor(part, "forest", numTrees=10, **p)
    best, _ = models.search(folds, fit, models.negative_rmse, [{"maxDepth": 3}, {"maxDepth": 6}], k=2)
    return metrics.regression(fit(features(train), best)(features(test)))


@query()
def model_ordinal(spark, d):
    """Frank-Hall classifier: class measures on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    features = models.prepared(train, NUMERIC)
    scored = models.fit_classifier(features(train), "ordinal", maxIter=5)(features(test))
    return metrics.per_class(metrics.confusion(scored.withColumn("p", C.argmax("proba")), "class_id", "p"))


@query()
def model_calibrated(spark, d):
    """Logistic classifier, isotonic calibration by fold: calibration error on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'").drop("val_fold"), rows.where("split = 'test'")
    features = models.prepared(train, NUMERIC, scale=True)
    folds = splits.temporal_folds(features(train), 2)
    return metrics.calibration_error(models.calibrated_classifier(folds, "logistic", k=2, maxIter=20)(features(test)), "class_id", "proba")


_TRAIN = "SELECT * FROM (SELECT * FROM split WHERE pm10_lag1 IS NOT NULL OR pm10_roll7 IS NOT NULL) WHERE split = 'train'"
_CODE = "CASE alert_class WHEN 'verde' THEN 0 WHEN 'giallo' THEN 1 WHEN 'arancio' THEN 2 ELSE 3 END"


@query(f"SELECT {_CODE} AS class_id, count(*) AS n, round((SELECT count(*) FROM modelled) / ((SELECT count(DISTINCT alert_class) FROM modelled) * count(*)), 5) AS weight, round(sum(ln(1 + pm10)), 2) AS log_total FROM modelled GROUP BY 1")
def model_weights(spark, d):
    """Balanced weights, and sums of the log target, by class."""
    rows = models.balanced(splits.valid_targets(modelled(spark, d)))
    return rounded(rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.round(F.sum(F.log1p("pm10")), 2).alias("log_total")))


@query("""SELECT season, province, CASE season WHEN 'winter' THEN 0 WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 ELSE 3 END AS season_code, coalesce(code, -1) AS province_code, n FROM
 (SELECT season, CASE WHEN m.station_id % 6 = 0 THEN 'elsewhere' ELSE province END AS province, count(*) AS n FROM modelled m JOIN provinces p ON m.station_id = p.station_id GROUP BY 1, 2) LEFT JOIN
 (SELECT province, row_number() OVER (ORDER BY province) - 1 AS code FROM (SELECT DISTINCT province FROM provinces WHERE station_id IN (SELECT station_id FROM modelled WHERE station_id % 6 <> 0))) USING (province)""")
def model_codes(spark, d):
    """Ordinal codes of season and province; a province that training never saw is -1."""
    rows = modelled(spark, d).join(A.provinces(spark, d).select("station_id", "province"), "station_id")
    orders = models.fit_categories(rows.where("station_id % 6 <> 0"), ["season", "province"])
    named = rows.withColumn("province", F.when(F.col("station_id") % 6 == 0, "elsewhere").otherwise(F.col("province")))
    coded = named.withColumns({f"{c}_code": models.ordinal(c, order).cast("long") for c, order in orders.items()})
    return rounded(coded.groupBy("season", "province", "season_code", "province_code").agg(F.count(F.lit(1)).alias("n")))


@query()
def model_boosted(spark, d):
    """Boosted regression over a small grid of its own (the whole space has 1,296 combinations), on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    features = models.prepared(train, NUMERIC)
    fit = lambda part, p: models.fit_regressor(part, "boosted", maxIter=10, stepSize=0.1, **p)
    best, _ = models.searched(splits.temporal_folds(features(train).drop("val_fold"), 2), "boosted", fit, models.negative_rmse, {"maxDepth": (3, 5), "subsamplingRate": (0.8,)}, k=2)
    return metrics.regression(fit(features(train), best)(features(test)))


@query()
def model_class_search(spark, d):
    """The logistic classifier's strength by macro f1 over temporal folds: all four of its space, and class measures of the best."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    features = models.prepared(train, NUMERIC, scale=True)
    fit = lambda part, p: models.fit_classifier(part, "logistic", maxIter=20, **p)
    best, _ = models.searched(splits.temporal_folds(features(train).drop("val_fold"), 2), "logistic", fit, models.f1_macro, k=2)
    return metrics.per_class(metrics.confusion(fit(features(train), best)(features(test)).withColumn("p", C.argmax("proba")), "class_id", "p"))


@query()
def model_tree_classes(spark, d):
    """Forest and boosted classifiers: macro measures on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    features = models.prepared(train, NUMERIC)
    out = None
    for kind, params in (("forest", {"numTrees": 20, "maxDepth": 10}), ("boosted", {"maxIter": 5})):
        scored = models.fit_classifier(features(train), kind, **params)(features(test)).withColumns({"p": C.argmax("proba"), "model": F.lit(kind)})
        one = metrics.macro(metrics.confusion(scored, "class_id", "p", ["model"]), ["model"])
        out = one if out is None else out.unionByName(one)
    return out


@query()
def model_out_of_fold(spark, d):
    """Out-of-fold predictions of a forest and a calibrated classifier, and the hybrid rule tuned on them."""
    train = split_rows(spark, d).where("split = 'train'").drop("val_fold")
    features = models.prepared(train, NUMERIC, scale=True)
    folds = written(splits.temporal_folds(train, 4), "folds")
    regress = lambda part: models.fit_regressor(part, "forest", numTrees=20, maxDepth=6)
    classify = lambda part: models.calibrated_classifier(splits.temporal_folds(part.drop("val_fold"), 2), "logistic", k=2, maxIter=20)
    scored = models.out_of_fold(features(folds), regress, classify, 4).select("station_id", "day", F.col("class_id").alias("truth"), "predicted", "proba")
    return rounded(metrics.tune(written(scored, "out-of-fold")))


@query()
def model_importance(spark, d):
    """Permutation and native importances of a forest on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'"), written(rows.where("split = 'test'"), "test")
    features = models.prepared(train, NUMERIC)
    fitted = models.fit_regressor(features(train), "forest", numTrees=20, maxDepth=6)
    found = models.permutation_importance(test, NUMERIC, lambda part: fitted(features(part)), models.negative_rmse_by)
    native = dict(models.native_importance(fitted.model, NUMERIC))
    return rounded(spark.createDataFrame([(f, m, s, native[f]) for f, m, s in found], "feature string, mean_drop double, std_drop double, native double"))


@query()
def model_class_importance(spark, d):
    """Permutation importances of the logistic classifier by macro f1 on the test side."""
    rows = split_rows(spark, d)
    train, test = rows.where("split = 'train'"), written(rows.where("split = 'test'"), "test")
    features = models.prepared(train, NUMERIC, ["season"], scale=True)
    fitted = models.fit_classifier(features(train), "logistic", maxIter=20)
    found = models.permutation_importance(test, [*NUMERIC, "season"], lambda part: fitted(features(part)), models.f1_macro_by)
    return rounded(spark.createDataFrame(found, "feature string, mean_drop double, std_drop double"))


@query()
def serve_model_forecast(spark, d):
    """Two days ahead for every station by trained models: a forest for the value, a logistic classifier for the class."""
    from aerolith.plans.decision_queries import serving

    names = ["pm10_lag1", "pm10_lag2", "pm10_roll3", "pm10_roll7", "month_sin", "month_cos", "temp_mean", "wind_speed_mean", "stagnation_index"]
    panel_rows = written(modelled(spark, d).where("pm10_lag1 is not null"), "panel")
    train = splits.valid_targets(panel_rows)
    features = models.prepared(train, names, ["season"], scale=True)
    regress, classify = models.fit_regressor(features(train), "forest", numTrees=20, maxDepth=8), models.fit_classifier(features(train), "logistic", maxIter=20)
    recent, weather, quality, metadata = serving(spark, d)
    score = lambda rows: classify(regress(features(rows)))
    out = serve.forecast(recent, weather, quality, metadata, score).forecasts
    return out.select("station_id", "day", "horizon", "predicted", "class_final", "source", F.to_json("drivers").alias("drivers"))


@query()
def cluster_choice(spark, d):
    """KMeans and Ward for 2 to 8 clusters of scaled station profiles, with silhouettes, and the one chosen."""
    from aerolith.operators import profiles
    from aerolith.plans.statistics_queries import panel_profiles

    full = profiles.impute_by_province(panel_profiles(spark, d).fillna({"dist_industrial_km": 0.0}))
    scaled = profiles.robust_scaled(full)
    rows = written(scaled.select(F.col("station_id").alias("id"), F.array(*profiles.FEATURES).alias("x")), "profiles")
    found = [("kmeans", k, s, n) for k, _, s, n in cluster.kmeans_grid(rows)] + [("ward", k, s, n) for k, s, n in cluster.ward_grid(rows)]
    best = cluster.choose(found)
    return rounded(spark.createDataFrame([(m, k, s, min(n), (m, k) == best[:2]) for m, k, s, n in found], "method string, k int, silhouette double, smallest int, chosen boolean"))


def _silhouettes(distance: str) -> str:
    pairs = f"SELECT CAST(a.vec_id AS BIGINT) AS id, CAST(a.label AS BIGINT) AS cluster, b.label AS other, avg({distance}) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label >= 0 AND b.label >= 0 GROUP BY 1, 2, 3"
    means = f"SELECT id, cluster, max(m) FILTER (cluster = other) AS a, min(m) FILTER (cluster <> other) AS b FROM ({pairs}) GROUP BY 1, 2"
    return f"SELECT id, cluster, round(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM ({means})"


_APART = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def labelled(spark, d) -> DataFrame:
    return points(spark, d).join(A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), "id")


@query(_silhouettes(_APART))
def cluster_silhouettes(spark, d):
    """The silhouette of every embedding under its label."""
    return rounded(silhouettes.silhouettes(labelled(spark, d)))


@query(_silhouettes(f"power({_APART}, 2)"))
def cluster_silhouettes_squared(spark, d):
    """The same by squared distances, from sums over the clusters alone."""
    return rounded(silhouettes.silhouettes(labelled(spark, d), squared=True))


@query()
def cluster_dbscan_grid(spark, d):
    """Density clusters of the embeddings for the grid of radii."""
    return rounded(spark.createDataFrame(cluster.dbscan_grid(points(spark, d)), "eps double, n_clusters long, n_noise long, silhouette double"))


@query()
def cluster_kmeans(spark, d):
    labelled, _ = cluster.kmeans(points(spark, d), 4)
    return labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def cluster_ward(spark, d):
    return cluster.ward(points(spark, d), 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_NEAR = f"""SELECT CAST(a.vec_id AS BIGINT) AS id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
 AND list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= {EPS} GROUP BY 1"""


@query(_NEAR)
def cluster_eps_neighbours(spark, d):
    return eps_degrees(points(spark, d), EPS)


@query(f"SELECT n + 1 AS degree, count(*) AS n_points FROM ({_NEAR}) GROUP BY 1")
def cluster_eps_neighbours_whole(spark, d):
    """How many points have how many points within eps, themselves included."""
    degrees = eps_degrees(points(spark, d), EPS).select((F.col("n") + 1).alias("degree"))
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n_points"))


_PAIRS = f"SELECT CAST(a.vec_id AS BIGINT) AS a, CAST(b.vec_id AS BIGINT) AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= {EPS}"


@query(f"""SELECT * FROM (WITH RECURSIVE pairs AS MATERIALIZED ({_PAIRS}), core AS (SELECT a AS id FROM pairs GROUP BY 1 HAVING count(*) >= 2),
links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reached AS (SELECT id, id AS root FROM core UNION SELECT l.b, r.root FROM reached r JOIN links l ON r.id = l.a),
named AS (SELECT id, min(root) AS root FROM reached GROUP BY 1), edges AS (SELECT a AS id, arg_min(root, b) AS edge FROM pairs JOIN named ON b = id GROUP BY 1)
SELECT CAST(e.vec_id AS BIGINT) AS id, coalesce(n.root, g.edge, -1) AS cluster FROM embeddings e LEFT JOIN named n ON e.vec_id = n.id LEFT JOIN edges g ON e.vec_id = g.id)""")
def cluster_dbscan(spark, d):
    return cluster.dbscan(points(spark, d), EPS, 3).select("id", "cluster")


@query()
def cluster_pca(spark, d):
    scores, _ = cluster.pca(points(spark, d))
    return scores.select("id", *(F.round(F.get("scores", F.lit(i)), 5).alias(f"pc{i + 1}") for i in range(2)))


@query()
def source_zone_distance(spark, d):
    """Stations' distance to square zones around the suppliers' places."""
    k = F.col("s_suppkey")
    x, y = 9 + k % 50 * 0.03, 45 + (k % 10) * 0.1
    corner = lambda a, b: F.struct((x + a * 0.005).alias("lon"), (y + b * 0.005).alias("lat"))
    zones = A.table(spark, d, "supplier").select(k.alias("zone_id"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))
    return rounded(spatial.zone_distance(A.stations(spark, d), zones, 10_000.0))


def stream_of(spark, d, *more: str) -> DataFrame:
    """The readings of the events table as a stream of its files."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return e.select(F.col("user_id").alias("station_id"), F.xxhash64("user_id", "event_type").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), "value", *more)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The final table of a stream that has read all there is."""
    spark = stream.sparkSession
    path, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT user_id AS station_id, CAST(ts AS DATE) AS day, round(avg(value), 5) AS value_mean, round(max(value), 5) AS value_max, count(*) AS n FROM events WHERE value > 0 GROUP BY 1, 2")
def stream_daily(spark, d):
    return rounded(drained(jobs.daily(stream_of(spark, d)), "complete"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS n_stations FROM (SELECT DISTINCT user_id, event_type, ts FROM events)")
def stream_dedup(spark, d):
    out = drained(jobs.deduplicated(stream_of(spark, d)), "append")
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("station_id").alias("n_stations"))


@query("SELECT user_id AS station_id, CAST(ts AS DATE) + CAST(k AS INTEGER) AS until, round(avg(value), 5) AS value_mean FROM events, (SELECT unnest(generate_series(1, 7)) AS k) WHERE value > 0 GROUP BY 1, 2")
def stream_sliding(spark, d):
    return rounded(drained(jobs.sliding(stream_of(spark, d)), "complete"))


@query("SELECT user_id AS station_id, date_trunc('month', ts)::DATE AS day, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT user_id, event_type, ts, max(value) AS value FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
def stream_rewritten_days(spark, d):
    """Readings merged into a table by day; of repeated readings the largest stays."""
    path = fresh_path(spark, "rewritten")
    jobs.rewrite_days(stream_of(spark, d), path, fresh_path(spark, "rewritten-state")).awaitTermination()
    out = days.read(spark, path)
    return rounded(out.groupBy("station_id", F.trunc("day", "month").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("SELECT status, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT user_id, event_type, ts, CASE WHEN bool_or(event_id % 3 = 0) THEN 'VA' ELSE 'NRT' END AS status, coalesce(max(value) FILTER (event_id % 3 = 0), max(value)) AS value FROM events GROUP BY 1, 2, 3) GROUP BY 1")
def stream_priority(spark, d):
    """Validated readings replace provisional ones of the same sensor and time."""
    path = fresh_path(spark, "priority")
    status = F.when(F.col("event_id") % 3 == 0, "VA").otherwise("NRT")
    jobs.upsert_by_priority(stream_of(spark, d, "event_id").withColumn("status", status).drop("event_id"), path, fresh_path(spark, "priority-state")).awaitTermination()
    return rounded(days.read(spark, path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


_GAPS = "SELECT user_id AS station_id, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 DAY THEN 1 ELSE 0 END AS begins FROM events WHERE value > 100 WINDOW w AS (PARTITION BY user_id ORDER BY ts)"


@query(f"SELECT station_id, min(ts) AS begins, max(ts) + INTERVAL 2 DAY AS ends, count(*) AS n, round(max(value), 5) AS value_max FROM (SELECT *, sum(begins) OVER (PARTITION BY station_id ORDER BY ts) AS episode FROM ({_GAPS})) GROUP BY station_id, episode")
def stream_episodes(spark, d):
    out = drained(jobs.exceedances(stream_of(spark, d), limit=100.0), "complete")
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("begins", "ends")}))


@query("SELECT user_id AS station_id, count(*) FILTER (value > 0) AS n, coalesce(max(ts) FILTER (value > 0), TIMESTAMP '1970-01-01') AS last_valid FROM events GROUP BY 1")
def stream_staleness(spark, d):
    """Readings and last valid time of each station as the stream last told them, before any fell silent."""
    found = drained(jobs.staleness(stream_of(spark, d)), "update")
    return found.where("not stale").groupBy("station_id").agg(F.max("n").alias("n"), F.max("last_valid").cast("timestamp_ntz").alias("last_valid"))
