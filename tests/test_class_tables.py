"""Tables with one row per class meet the rows where these lie: a shuffle by class would put most rows into one task."""

import pytest
from pyspark.sql import functions as F

from entitywatch.operators import alerts as al
from entitywatch.operators import explain as ex
from entitywatch.operators import models as mo
from entitywatch.operators import profiles as pr

PARTS = 6


@pytest.fixture
def without_small_tables(spark):
    """Spark takes no table for small by itself, as it doesn't when sizes are not known in time."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def rows(spark):
    rare = F.col("id") % 20 == 0
    table = spark.range(600).select(
        F.col("id").alias("event_id"), F.when(rare, "brute_force").otherwise("normal").alias("label"),
        F.when(rare, "service_account").otherwise("user").alias("entity_type"), (F.col("id") * 1.0).alias("a"), rare.cast("int").alias("y"),
        F.array(F.array(F.col("id") * 1.0, rare.cast("double"))).alias("sequence"), F.lit(1.0).alias("decay"))
    return table.repartition(PARTS)


def _sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]


def test_joins_by_class_leave_rows_where_they_are(spark, rows, without_small_tables):
    weighted = al.with_class_weight(rows)
    weights = spark.createDataFrame([("normal", [2.0])], "label string, weights array<double>")
    told = ex.linear_contributions(rows, weights, F.array(F.lit(1.0)), ["a"], "label")
    typed = pr.with_cohort(rows, pr.fit_cohorts(rows, ["a"]))
    for found in (weighted, told, typed):
        sizes = _sizes(found)
        assert sum(sizes) == 600 and len(sizes) == PARTS and max(sizes) <= 110


def test_both_passes_of_the_detector_leave_rows_where_they_are(rows, without_small_tables, monkeypatch):
    seen, fit = [], mo.LogisticRegression.fit
    monkeypatch.setattr(mo.LogisticRegression, "fit", lambda self, data: seen.append(_sizes(data)) or fit(self, data))
    mo.fit_detector(rows)
    assert len(seen) == 2 and all(sum(s) == 600 and len(s) == PARTS and max(s) <= 110 for s in seen)


def test_forest_rows_are_dealt_evenly_and_in_a_fixed_order(spark, rows, without_small_tables, monkeypatch):
    seen = []
    monkeypatch.setattr(mo.RandomForestClassifier, "fit", lambda self, data: seen.append(data))
    monkeypatch.setattr(mo, "FOREST_ROWS", 20)
    for table in (rows, rows.coalesce(1)):
        mo.fit_classifier(al.with_class_weight(table), names=["a"], weight="weight")
    for data in seen:
        sizes = _sizes(data)
        cores = spark.sparkContext.defaultParallelism
        assert sum(sizes) == 600 and max(sizes) <= 40 and len(sizes) >= min(30, cores)
        assert data.columns == ["x", "y", "w"]
        assert data.rdd.glom().collect() == data.rdd.glom().collect()
