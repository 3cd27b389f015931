"""Exploratory statistics where classes are absent."""

import time

from pyspark.sql import functions as F

from aerolith.operators import eda
from aerolith.plans import registry


def test_classes_that_occur(spark, data, tmp_path):
    """Without verde and rosso days the query has no rows of them, like its SQL, and the balance is that of the others."""
    for name in ("customer", "lineitem"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{data}/orders.parquet")
    price = "case when o_custkey in (select c_custkey from c where c_nationkey < 3) then 150000.0 else 200000.0 end"
    spark.read.parquet(f"{data}/customer.parquet").createOrReplaceTempView("c")
    orders.createOrReplaceTempView("o")
    spark.sql(f"select * except (o_totalprice), {price} as o_totalprice from o").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.alert_class: (r.n, r.pct, r.balance) for r in registry.queries()["eda_classes"](spark, str(tmp_path)).collect()}
    assert set(got) == {"giallo", "arancio"}
    low, high = sorted(n for n, _, _ in got.values())
    assert {b for _, _, b in got.values()} == {round(low / high, 5)} and abs(sum(p for _, p, _ in got.values()) - 100) < 1e-4


def test_labels_that_do_not_occur(spark):
    rows = spark.createDataFrame([("verde",), ("verde",), ("rosso",)], "alert_class string")
    assert {r.alert_class: r.n for r in eda.class_distribution(rows).collect()} == {"verde": 2, "giallo": 0, "arancio": 0, "rosso": 1}
    assert {r.alert_class: (r.n, r.balance) for r in eda.class_distribution(rows, None).collect()} == {"verde": (2, 0.5), "rosso": (1, 0.5)}


def test_values_are_evaluated_once(spark):
    """Values that come out otherwise at a second evaluation, as sums in another order do, lie between the ends that were found."""
    early = F.udf(lambda i: float(i) - time.time(), "double").asNondeterministic()
    got = {r.bin: r.n for r in eda.histogram(spark.range(100).select(early("id").alias("v")), "v", 10).collect()}
    assert min(got) == 0 and max(got) == 9 and sum(got.values()) == 100
