"""Hand-computed cases of rules, features, splits and guards."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import columns as C
from aerolith.operators import cluster, ingest, kernels, metrics, models, panel, profiles, serve, spatial, spectral, splits
from aerolith.plans import adapters as A
from aerolith.plans import model_queries, registry
from aerolith.sources import days, files, scratch


def day(i):
    return datetime.date(2025, 1, 1) + datetime.timedelta(days=i)


def test_alert_bins(spark):
    rows = spark.createDataFrame([(v,) for v in (19.9, 20.0, 34.9, 35.0, 49.9, 50.0, -1.0, float("nan"), None)], "v double")
    assert [r[0] for r in rows.select(C.alert_class("v")).collect()] == [0, 1, 1, 2, 2, 3, None, None, None]


def test_hybrid_rule(spark):
    p = [0.1, 0.8, 0.05, 0.05]
    rows = spark.createDataFrame([(19.0, p), (17.0, p), (42.0, p), (51.0, [0.1, 0.1, 0.75, 0.05])], "v double, p array<double>")
    out = rows.select(*(v.alias(k) for k, v in C.hybrid_decision("v", "p", 2.0, 0.7).items())).collect()
    assert [r.class_by_value for r in out] == [0, 0, 2, 3]
    assert [r.class_final for r in out] == [1, 0, 2, 3]
    assert [r.escalated for r in out] == [True, False, False, False]


def test_hybrid_sources(spark):
    """Outside the zone the regression speaks even if both agree; inside it a sure severe class overrides, be it the regression's own."""
    cases = [
        (10.0, [0.9, 0.05, 0.03, 0.02], "regression", 0), (10.0, [0.1, 0.8, 0.05, 0.05], "regression", 0), (19.0, [0.9, 0.05, 0.03, 0.02], "hybrid_agreement", 0),
        (19.0, [0.2, 0.7, 0.05, 0.05], "hybrid_override", 1), (19.0, [0.4, 0.1, 0.1, 0.4], "hybrid_agreement", 0), (21.0, [0.55, 0.4, 0.03, 0.02], "hybrid_override", 1),
        (21.0, [0.8, 0.1, 0.05, 0.05], "hybrid_no_override", 1), (19.0, [0.3, 0.33, 0.2, 0.17], "hybrid_no_override", 0),
    ]
    rows = spark.createDataFrame([(i, v, p) for i, (v, p, _, _) in enumerate(cases)], "i int, v double, p array<double>")
    d = C.hybrid_decision("v", "p", 3.0, 0.35)
    got = {r.i: r for r in rows.select("i", d["source"].alias("source"), d["class_final"].alias("final"), d["prudential"].alias("prudential"), d["escalated"].alias("escalated")).collect()}
    assert [(got[i].source, got[i].final) for i in range(len(cases))] == [c[2:] for c in cases]
    assert [i for i in got if got[i].prudential] == [3, 5] and [i for i in got if got[i].escalated] == [3]


def strategy_rows(spark, rows):
    return spark.createDataFrame(rows, "strategy string, complexity int, f1_macro double, severe double, recall_worst double")


def test_selection(spark):
    one = lambda rows: metrics.select_strategy(strategy_rows(spark, rows)).first()
    good = one([("c", 3, 0.700, 0.01, 0.7), ("a", 1, 0.696, 0.02, 0.9), ("b", 2, 0.99, 0.03, 0.9), ("d", 0, 0.60, 0.0, 0.8)])
    assert (good.production_ready, good.selected, good.candidate, good.failed) == (True, "a", None, "")
    within = one([("a", 1, 0.5, 0.01, 0.2), ("b", 2, 0.6, 0.02, 0.1), ("c", 3, 0.9, 0.2, 0.9)])
    assert (within.production_ready, within.selected, within.candidate, within.failed) == (False, None, "b", "both")
    none = one([("a", 1, 0.5, 0.1, 0.2), ("b", 2, 0.6, 0.2, 0.1), ("c", 0, None, 0.0, 1.0)])
    assert (none.candidate, none.failed) == ("b", "severe,recall")
    assert one([("a", 1, 0.5, 0.01, 0.2), ("b", 2, 0.6, 0.2, None)]).failed == "recall"


def test_comparison(spark):
    rows = strategy_rows(spark, [("z", 1, 0.5, 0.01, 0.8), ("a", 1, 0.5, 0.5, 0.1), ("m", 1, 0.5, 0.0, None), ("b", 1, 0.5, None, 0.9)])
    got = sorted((r.place, r.strategy, r.tag) for r in metrics.comparison(rows, ["m", "z"]).collect())
    assert got == [(1, "m", "C2-FAIL"), (2, "z", "PASS"), (3, "a", "C1-FAIL C2-FAIL"), (4, "b", "C1-FAIL")]


def test_tuning_goes_by_recall_before_severe_errors(spark):
    rows = spark.createDataFrame([(3, 49.0, [0.1, 0.1, 0.2, 0.6])] * 4 + [(0, 10.0, [0.9, 0.05, 0.03, 0.02])] * 4, "truth int, predicted double, proba array<double>")
    out = {(r.delta, r.least): r for r in metrics.tune(rows).collect()}
    assert all(r.score == pytest.approx(r.f1_macro - r.severe - 0.5 * (1 - r.recall_worst)) and r.is_flat for r in out.values())
    assert out[3.0, 0.45].place == 1  # all alike: the smallest delta, then the largest probability


@pytest.mark.parametrize("values, expected", [
    # One gap: the value before it stands in, so the last three known values are 6, 9, 9 and all eight places but the oldest count.
    ([2.0, 4.0, 4.0, None, 8.0, 6.0, 9.0, None], (9.0, 9.0, (4 + 4 + 4 + 8 + 6 + 9 + 9) / 7, 8.0, 0.0)),
    # A gap of three: two days are filled, the last is not; two known values of three are enough for roll3.
    ([1.0, 3.0, 5.0, 7.0, 11.0, None, None, None], (11.0, 11.0, (3 + 5 + 7 + 11 + 11 + 11) / 6, 11.0, 0.0)),
    ([None, None, None, None, None, None, None, 6.5], (6.5, None, None, None, None)),
])
def test_lag_context(spark, values, expected):
    row = spark.createDataFrame([(values,)], "a array<double>").select(*(v.alias(k) for k, v in serve.pm10_context(F.col("a")).items())).first()
    got = [row.pm10_lag1, row.pm10_lag2, row.pm10_roll7, row.pm10_roll3, row.pm10_diff]
    assert [g is None for g in got] == [e is None for e in expected]
    assert [g for g in got if g is not None] == pytest.approx([e for e in expected if e is not None])


def test_positional_lags_with_missing_last(spark):
    row = spark.createDataFrame([([3.0, 8.0, None],)], "a array<double>").select(*(v.alias(k) for k, v in serve.positional(F.col("a")).items())).first()
    assert (row.lag1, row.lag2, row.roll3) == (None, 8.0, None)


def test_sanitise_keeps_rows(spark):
    rows = spark.createDataFrame([("a", "7.25", "VA"), ("a", "-999", "VA"), ("b", "3", "NV"), ("b", "-0", "VA"), ("b", "1,5", "VA"), ("b", None, "VA")], "sensor_id string, value string, status string")
    assert [r.value for r in ingest.sanitised(rows).collect()] == [7.25, None, None, None, None, None]


def test_empty_allow_list(spark):
    rows, none = spark.createDataFrame([(1,)], "sensor_id long"), spark.createDataFrame([], "sensor_id long")
    assert ingest.allowed(rows, none).count() == 0 and ingest.allowed(rows, none, strict=False).count() == 1


def panel_rows(spark, days=20, stations=3):
    return spark.createDataFrame([(s, day(d), 10.0 * d + s) for d in range(days) for s in range(stations)], "station_id long, day date, pm10 double")


def test_gap_fill_lags_and_no_look_ahead(spark):
    rows = panel_rows(spark, 8, 2).where("not (station_id = 1 and dayofmonth(day) in (3, 4, 5))")
    add = lambda df: panel.with_lags(panel.fill_days(df).withColumns({c: F.lit(1.0) for c in panel.LAGGED}))
    out = {(r.station_id, r.day): r for r in add(rows).collect()}
    assert len(out) == 16 and out[1, day(3)].pm10 is None and out[1, day(2)].pm10_lag1 == 11.0
    assert out[0, day(7)].pm10_roll7 == 30.0 and out[0, day(0)].pm10_roll7 is None and out[0, day(2)].pressure_roll3 is None and out[0, day(3)].pressure_roll3 == 1.0
    changed = {(r.station_id, r.day): r for r in add(rows.withColumn("pm10", F.when(F.col("day") < day(6), F.col("pm10")).otherwise(999.0))).collect()}
    assert all(changed[k].pm10_lag1 == out[k].pm10_lag1 and changed[k].pm10_roll7 == out[k].pm10_roll7 for k in out if k[1] <= day(6))


def test_imputable_names():
    assert panel.imputable(["station_id", "altitude", "blh_mean", "co_mean", "season", "x_lag1", "pressure_roll3", "month_sin"]) == ["blh_mean", "co_mean", "x_lag1", "pressure_roll3"]


def test_column_half_missing_is_kept(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "k long, a double, b double")
    assert panel.drop_sparse_columns(rows, keep=("k",)).columns == ["k", "a"]


def test_medians_come_from_train(spark):
    train, test = (spark.createDataFrame([(v,) for v in x], "temp_mean double") for x in ([-4.0, None, 1.0, 2.0, 8.0], [500.0, None, 700.0]))
    medians = panel.fit_medians(train)
    assert medians == {"temp_mean": 1.5} and [r[0] for r in panel.impute(test, medians).collect()] == [500.0, 1.5, 700.0]
    assert panel.fit_medians(spark.createDataFrame([(1.0,)], "temp_mean double")) == {}


def test_stagnation_with_missing_inputs(spark):
    rows = spark.createDataFrame([(1020.0, 1.0, 300.0), (1020.0, None, 300.0), (1000.0, 1.0, None), (1000.0, 1.0, 300.0)], "p double, w double, b double")
    assert [r[0] for r in rows.select(C.stagnation_flag(F.col("p"), F.col("w"), F.col("b"))).collect()] == [1, None, None, 0]


def test_split_and_folds(spark):
    rows = splits.temporal_split(panel_rows(spark))
    assert rows.where("split = 'train'").select("day").distinct().count() == 14
    splits.assert_holdout(rows)
    splits.assert_stations(rows)
    folds = splits.temporal_folds(panel_rows(spark, 30, 2))
    splits.assert_folds(folds)
    assert {r.val_fold: r.n_rows for r in splits.fold_summary(folds).collect()} == {f: 10 for f in range(6)}
    with pytest.raises(ValueError):
        splits.temporal_folds(panel_rows(spark, 4, 1))
    with pytest.raises(ValueError):
        splits.temporal_split(panel_rows(spark, 1, 2))


def test_guards(spark):
    rows = spark.createDataFrame([(1, day(2), "train"), (1, day(3), "train"), (1, day(3), "test"), (2, day(4), "test")], "station_id long, day date, split string")
    with pytest.raises(ValueError):
        splits.assert_holdout(rows)
    with pytest.raises(ValueError):
        splits.assert_stations(rows)
    manifest = spark.createDataFrame([("a", "x", "y", 42, 5), ("b", "z", "y", 42, 5)], "model string, split_signature string, fold_signature string, seed int, k int")
    with pytest.raises(ValueError, match="split_signature"):
        splits.assert_manifests(manifest)


def test_signature_ignores_order(spark):
    rows = splits.temporal_split(panel_rows(spark))
    assert splits.signature(rows, "split").first() == splits.signature(rows.orderBy(F.rand(1)).repartition(3), "split").first()


def test_choice():
    assert cluster.choose([("kmeans", 3, 0.9, [15, 2, 50]), ("kmeans", 2, 0.5, [56, 11]), ("ward", 2, 0.5, [40, 27])])[:2] == ("kmeans", 2)


def test_dbscan(spark):
    rows = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 0.5, 1.0, 10, 10.4, 10.8, 50])], "id long, x array<double>")
    assert {r.id: r.cluster for r in cluster.dbscan(rows, 0.6, 3).collect()} == {0: 1, 1: 1, 2: 1, 3: 4, 4: 4, 5: 4, 6: -1}


def test_chi2_tail():
    assert profiles.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert profiles.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert profiles.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)


def test_shifts_keep_the_diagonal(spark):
    rows = spark.createDataFrame([(s, day(i), float((i * 7 + s) % 11), float((i * 5 + s) % 13), float(i % 3)) for s in range(3) for i in range(20)], "station_id long, day date, a double, b double, c double")
    out = spectral.diagnostic(rows, ["a", "b", "c"], iterations=5)
    values = [r.eigenvalue for r in out["eigenvalues"].collect()]
    assert sum(values) == pytest.approx(3.0)
    again = spectral.diagnostic(rows.repartition(5), ["a", "b", "c"], iterations=5)
    assert [r.null_p95 for r in again["eigenvalues"].collect()] == pytest.approx([r.null_p95 for r in out["eigenvalues"].collect()])


def to_segments(p, lines):
    a, b = lines[:, :2], lines[:, 2:]
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.hypot(*(p - a - t[:, None] * d).T).min()


def shifted_grams(z, shifts):
    return [(w.T @ w).ravel() for w in (np.column_stack([np.roll(z[:, j], s) for j, s in enumerate(row)]) for row in shifts)]


def test_global_shifts_and_shuffles(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(57, 3))
    rows = spark.createDataFrame([(i // 10, day(i % 10), *map(float, z[i])) for i in range(57)], "station_id long, day date, a double, b double, c double").repartition(4)
    got = {r.iteration: r.gram for r in kernels.global_shift_gram(rows, ["a", "b", "c"], "station_id", "day", 6, chunk=8).collect()}
    shifts = [[kernels.shift_of(0, i, "", c, 57) if i else 0 for c in "abc"] for i in range(7)]
    assert all(got[i] == pytest.approx(list(g)) for i, g in enumerate(shifted_grams(z, shifts))) and len(got) == 7
    for bucket in (7, 1000):
        mixed = {r.iteration: np.array(r.gram).reshape(3, 3) for r in kernels.shuffled_gram(rows, ["a", "b", "c"], "station_id", "day", 4, bucket=bucket).collect()}
        assert all(np.diag(mixed[i]) == pytest.approx(np.diag(z.T @ z)) for i in mixed) and mixed[0] == pytest.approx(z.T @ z) and mixed[1] != pytest.approx(mixed[2])


def test_zone_distance(spark):
    ring = [{"lon": 9.0 + a, "lat": 45.0 + b} for a, b in ((0, 0), (0.01, 0), (0.01, 0.01), (0, 0.01))]
    zones = spark.createDataFrame([(1, ring)], "zone_id long, ring array<struct<lon: double, lat: double>>")
    stations = spark.createDataFrame([(1, 45.005, 9.005), (2, 45.005, 9.02), (3, None, 9.0)], "station_id long, lat double, lng double")
    out = {r.station_id: r.dist_km for r in spatial.zone_distance(stations, zones).collect()}
    assert out[1] == 0.0 and out[2] == pytest.approx(0.788, abs=0.005) and 3 not in out


def test_polygons_against_all_edges(spark):
    """Zones of very different size, one far away, one inside another: the distance to all edges, 0 by the parity of edges."""
    rng = np.random.default_rng(3)
    shapes = [(rng.uniform(0, 100, 2), r) for r in (0.3, 0.5, 2, 7, 20)] + [(np.array([400.0, 50]), 1), (np.array([50.0, 50]), 3), (np.array([50.0, 50]), 1)]
    lines = []
    for z, (c, r) in enumerate(shapes):
        angle = np.sort(rng.uniform(0, 2 * np.pi, 7))
        ring = c + r * np.column_stack((np.cos(angle), np.sin(angle)))
        lines += [(z, *map(float, (*a, *b))) for a, b in zip(ring, np.roll(ring, -1, 0))]
    places = np.vstack((rng.uniform(-20, 120, (60, 2)), [[50, 50], [50.2, 50], [1000, 1000]]))
    edges = np.array([x[1:] for x in lines])

    def expected(p):
        cut = (edges[:, 1] > p[1]) != (edges[:, 3] > p[1])
        right = [c and p[0] < (e[2] - e[0]) * (p[1] - e[1]) / (e[3] - e[1]) + e[0] for c, e in zip(cut, edges)]
        odd = {x[0] for x in lines if sum(r for r, y in zip(right, lines) if y[0] == x[0]) % 2}
        return 0.0 if odd else to_segments(p, edges)

    stations = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "station_id long, x double, y double")
    table = spark.createDataFrame(lines, "zone_id long, ax double, ay double, bx double, by double")
    got = {r.station_id: r.distance for r in spatial.polygon_distance(stations, table, 4.0).collect()}
    assert got == pytest.approx({i: expected(p) for i, p in enumerate(places)}, abs=1e-9) and 0 in got.values()
    assert spatial.polygon_distance(stations, table.limit(0), 4.0).count() == 0 and spatial.polygon_distance(stations.limit(0), table, 4.0).count() == 0


def test_nearest_of_clustered_points(spark):
    rng = np.random.default_rng(4)
    points = np.vstack((rng.normal(0, 0.01, (300, 2)), rng.normal(50, 3, (50, 2)), [[-300.0, 0]]))
    places = np.vstack((rng.uniform(-60, 60, (40, 2)), [[-290.0, 3]], [[900.0, 900]]))
    frame = lambda p, names: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], names)
    got = {r.station_id: r.distance for r in spatial.nearest_point(frame(places, "station_id long, x double, y double"), frame(points, "k long, x double, y double"), 1.0).collect()}
    assert got == pytest.approx({i: np.hypot(*(points - p).T).min() for i, p in enumerate(places)}, abs=1e-9)


def test_osm_polygons(spark):
    node = "struct<lat: double, lon: double>"
    g = [{"lat": 1.0, "lon": 2.0}] * 4
    rows = spark.createDataFrame([(1, "way", g, None), (2, "way", g[:3], None), (3, "relation", None, [{"role": "outer", "type": "way", "geometry": g}, {"role": "inner", "type": "way", "geometry": g}, {"role": "outer", "type": "node", "geometry": g}])],
                                 f"id long, type string, geometry array<{node}>, members array<struct<role: string, type: string, geometry: array<{node}>>>")
    assert sorted(r.zone_id for r in files.osm_polygons(rows).collect()) == [1, 3]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "2025-01-01.json").write_text('[{"sensor_id": "1", "ts": "2025-01-01T00:00:00.000", "value": "3.5", "status": "VA"}, {"sensor_id": "1", "ts": "2025-01-01T00:00:00.000", "value": "4", "status": "VA"}]')
    (tmp_path / "2025-01-02.json").write_text("{broken")
    rows = files.read_measurements(spark, f"file://{tmp_path}/*.json")
    first = ingest.first_wins(ingest.normalised(rows), ["sensor_id", "ts"], ["file", "position"])
    assert [r.value for r in first.collect()] == [3.5]
    out = f"file://{tmp_path}/panel"
    days.overwrite(panel_rows(spark, 3, 2), out)
    days.overwrite(panel_rows(spark, 1, 1).withColumn("pm10", F.lit(-1.0)), out)
    assert days.read(spark, out).count() == 5


def test_models(spark):
    rows = spark.createDataFrame([(s, day(i), float(i % 10), 5.0 * (i % 10) + s, int(i % 10 > 4)) for s in range(2) for i in range(40)], "station_id long, day date, x double, pm10 double, class_id int")
    add = models.prepared(rows, ["x"], scale=True)
    scored = models.fit_regressor(add(rows), "elastic_net", regParam=0.0)(add(rows))
    assert scored.where("predicted is null or isnan(predicted)").count() == 0
    proba = models.fit_classifier(add(rows), "logistic", classes=4)(add(rows)).first().proba
    assert sum(proba) == pytest.approx(1.0) and proba[3] == 0.0


def test_nearest_point_takes_all_suppliers(spark, data, tmp_path):
    for name in ("customer", "nation"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.range(95, 160, 5).select(F.col("id").alias("s_suppkey")).where("id >= 100").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.station_id: r.distance for r in registry.queries()["source_nearest_point"](spark, str(tmp_path)).collect()}
    points = np.array([(9 + k % 61 * 0.03, 45 + k % 10 * 0.1) for k in range(100, 160, 5)])
    places = {r.station_id: (r.lng, r.lat) for r in A.stations(spark, str(tmp_path)).collect()}
    assert got and got == pytest.approx({i: np.hypot(*(points - p).T).min() for i, p in places.items()}, abs=1e-5)


def test_neighbours_of_whole_embeddings(spark, data):
    rows = A.table(spark, data, "embeddings").select("vec_id", "embedding").collect()
    assert {len(r.x) for r in model_queries.points(spark, data).collect()} == {len(rows[0].embedding)}
    x = np.array([r.embedding for r in rows], float)
    n = (np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= model_queries.EPS).sum(1) - 1
    got = {r.id: r.n for r in registry.queries()["cluster_eps_neighbours"](spark, data).collect()}
    assert got == {r.vec_id: k for r, k in zip(rows, n.tolist()) if k}
    assert registry.queries()["cluster_dbscan"](spark, data).count() == len(rows)
    for name in ("cluster_kmeans", "cluster_ward", "cluster_pca"):
        assert registry.queries()[name](spark, data).count()


def test_jdbc(spark):
    """A table of an embedded database, read in parallel ranges of its key."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url, driver = "jdbc:derby:memory:readings;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("id as sensor_id", "id * 0.5D as value").write.format("jdbc").options(url=url, dbtable="readings", driver=driver).mode("overwrite").save()
    rows = files.read_jdbc(spark, url, "readings", "SENSOR_ID", 0, 100, 4, driver=driver)
    assert rows.rdd.getNumPartitions() == 4 and rows.agg(F.count("*"), F.sum("value")).first()[:] == (100, 2475.0)


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_dominant_class_ties_go_to_the_lower_class(spark):
    rows = spark.createDataFrame([(1, "verde"), (1, "arancio"), (2, "rosso"), (2, "arancio"), (2, None), (3, "rosso"), (3, "giallo"), (3, "rosso")], "station_id long, alert_class string")
    assert {r.station_id: r.alert_class for r in profiles.dominant_class(rows).collect()} == {1: "verde", 2: "arancio", 3: "rosso"}


def test_stagnation_by_the_lowest_mixing_height(spark):
    rows = spark.createDataFrame([(1020.0, 0.05, 800.0, 4.0, None), (1020.0, 2.0, 800.0, None, 1.0), (1020.0, 2.0, None, 100.0, 1.0)], "pressure_mean double, wind_speed_mean double, blh_mean double, blh_min double, precip_sum double")
    assert [r.stagnation_index for r in panel.with_stagnation(rows).collect()] == [pytest.approx(1 / (0.1 * 10)), None, pytest.approx(1 / (2 * 100 * 2))]


def test_forecast_by_hand(spark):
    """The second day rests on the first day's unrounded value; refused stations come with the reason; statics and pollutants are there."""
    recent = spark.createDataFrame([(s, day(k), float(10 + k) if k != 6 else None, 1000.0 + k, 40.0 + k) for s in (1, 2, 3) for k in range(8)], "station_id long, day date, pm10 double, pressure_mean double, no2_mean double")
    weather = spark.createDataFrame([(s, day(8 + k), 1020.0 + k, 1.0, 50.0) for s in (1, 2, 4) for k in range(2)] + [(3, day(8), 1.0, 1.0, 1.0)], "station_id long, day date, pressure_mean double, wind_speed_mean double, blh_min double")
    quality = spark.createDataFrame([(1, "ok", 7), (2, "stale", 1), (3, "ok", 7), (4, "ok", 7), (5, "ok", 7)], "station_id long, quality string, valid_days long")
    metadata = spark.createDataFrame([(s, "P", 120.0) for s in (1, 2, 3, 4)], "station_id long, province string, altitude double")
    score = lambda rows: rows.withColumns({"predicted": F.col("pm10_lag1") + 1 / 3, "proba": F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))})
    out = serve.forecast(recent, weather, quality, metadata, score)
    first, second = sorted(out.forecasts.collect(), key=lambda r: r.horizon)
    assert {r.station_id: r.reason for r in out.refused.collect()} == {2: "stale", 3: "no_weather", 4: "stale", 5: "unknown"}
    # Known values are 10..15, 15 again for the gap, 17.
    assert (first.predicted, first.drivers.pm10_lag1, first.drivers.pm10_lag2, first.live, first.day) == (17.33, 17.0, 15.0, True, day(8))
    assert second.drivers.pm10_lag1 == 17 + 1 / 3 and second.drivers.pm10_lag2 == 17.0 and second.predicted == 17.67
    assert second.drivers.pm10_roll3 == pytest.approx((15 + 17 + 17 + 1 / 3) / 3) and second.drivers.pm10_roll7 == pytest.approx((12 + 13 + 14 + 15 + 15 + 17 + 17 + 1 / 3) / 7)
    assert (second.drivers.pressure_mean_lag1, second.drivers.pressure_mean, second.drivers.no2_mean, second.drivers.province, second.drivers.stagnation_flag, second.weather_used.wind_speed_mean) == (1020.0, 1021.0, 47.0, "P", True, 1.0)
    assert len(second.drivers) == 22 and first.drivers.stagnation_index == pytest.approx(1 / 50) and first.drivers.o3_mean is None
