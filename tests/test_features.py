"""Functions, baselines, features and profiles on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitywatch import functions as fn
from entitywatch.fixed import FEATURES, REASONS
from entitywatch.operators import baseline as bl
from entitywatch.operators import features as ft
from entitywatch.operators import models as mo
from entitywatch.operators import profiles as pr


def _values(spark, rows, layout, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, layout).select(*columns).collect()]


def test_parse_geo(spark):
    rows = [(None,), ("London",), ("X|north|2",), ("Paris|48.8566|2.3522",), ("a|1|2|3",)]
    got = _values(spark, rows, "g string", fn.parse_geo("g")["lat"], fn.parse_geo("g")["lon"])
    assert got == [(None, None), (None, None), (None, None), (48.8566, 2.3522), (None, None)]


def test_off_hours(spark):
    rows = [(f"2024-03-02 {h:02d}:30:00",) for h in range(24)]
    got = _values(spark, rows, "t string", fn.is_off_hours(F.col("t").cast("timestamp")), fn.is_weekend(F.col("t").cast("timestamp")))
    assert [h for h, (off, _) in enumerate(got) if off] == [0, 1, 2, 3, 4, 5, 23]
    assert all(weekend for _, weekend in got)


def test_reason_texts_round_half_to_even(spark):
    values = [0.5, 1.5, 2.5, 9.9, 10.0]
    names = [("access_freq_5min", "abnormally high access frequency ({} events in 5 min)"),
             ("time_since_last_access_sec", "unusually {} time since last access ({}s)")]
    rows = [(name, v) for name, _ in names for v in values]
    got = [r[0] for r in _values(spark, rows, "n string, v double", fn.reason_text("n", "v"))]
    whole = ["0", "2", "2", "10", "10"]
    assert got[:5] == [names[0][1].format(w) for w in whole]
    assert got[5:] == [names[1][1].format(d, w) for d, w in zip(["short"] * 4 + ["long"], whole)]


def test_every_feature_has_a_text_and_others_get_a_default(spark):
    assert sorted(REASONS) == sorted(FEATURES)
    got = _values(spark, [("shoe_size", 4.5), ("session_duration_zscore", -1.26)], "n string, v double", fn.reason_text("n", "v"))
    assert got == [("elevated shoe_size (4.5)",), ("session duration -1.3 standard deviations from normal",)]


def test_command_functions(spark):
    rows = [(None,), ("",), ("  ",), ("ls",), ("ls; cat ;",), (";",)]
    got = _values(spark, rows, "c string", fn.command_count("c"), fn.command_tokens("c"))
    assert got == [(0, []), (0, []), (0, []), (1, ["ls"]), (3, ["ls", "cat"]), (2, [])]


def test_codes_and_labels(spark):
    got = _values(spark, [("user",), ("robot",), (None,)], "t string", fn.encode("t", ["service", "user"]))
    assert got == [(1,), (-1,), (-1,)]
    got = _values(spark, [(0,), (7,), (8,), (-1,)], "i int", fn.index_to_label("i"))
    assert got == [("normal",), ("insider_drift",), ("unknown",), ("unknown",)]


def test_clean_and_missing(spark):
    rows = spark.createDataFrame([(float("inf"), 1), (float("nan"), None), (-float("inf"), 3), (None, 4), (2.5, 5)], "a double, b int")
    assert [tuple(r) for r in ft.clean(rows, ["a", "b"]).collect()] == [(0.0, 1.0), (0.0, 0.0), (0.0, 3.0), (0.0, 4.0), (2.5, 5.0)]
    assert tuple(ft.missing_counts(rows, ["a", "b"]).first()) == (2, 1)


def test_most_common_breaks_ties_by_value(make_log):
    log = make_log({"auth": "token"}, {"auth": "password"}, {"auth": "token", "entity_id": "usr_2"}, {"auth": None, "entity_id": "usr_3"})
    rows = bl.usual_places(log).orderBy("entity_id").collect()
    assert [(r.entity_id, r.home_auth) for r in rows] == [("usr_1", "password"), ("usr_2", "token"), ("usr_3", None)]


def test_incremental_fit_equals_fit_on_everything(make_log):
    a = make_log({"resource": "r1"}, {"resource": "r2", "commands": "x;y"})
    b = make_log({"resource": "r2", "commands": "y; z"}, {"resource": None, "entity_id": "usr_2"})
    both = bl.known_values(a.unionByName(b))
    grown = bl.extend_known(bl.known_values(a), b)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, grown.collect()))


def test_novelty_flags(make_log, column):
    train = make_log({"resource": "r1", "device": "d1", "commands": "ls;cat"}, {"device": "d2", "entity_id": "usr_2"})
    later = make_log(
        {"resource": "r1", "device": "d1", "commands": "ls"}, {"resource": "r9", "device": "d2", "commands": "ls; nc ;"},
        {"resource": None, "device": None, "commands": ""}, {"resource": "r1", "device": "d3", "commands": "nc;rm", "at": 5},
    )
    rows = ft.build_features(later, bl.fit_baseline(train))
    names = "resource_novelty_score", "fingerprint_mismatch", "new_device_flag", "command_seq_novelty", "command_seq_length"
    assert column(rows, *names) == [(0, 0, 0, 0, 1), (1, 1, 0, 0.5, 3), (0, 0, 0, 0, 0), (0, 1, 1, 1, 2)]


@pytest.mark.parametrize("limit", [None, 2])
def test_features_keep_every_row_in_order(make_log, limit):
    log = make_log(*[{"at": i * 50, "entity_id": f"usr_{i % 3 % 2}", "geo": None if i % 4 else "A|1|2"} for i in range(12)])
    rows = ft.build_features(log, bl.fit_baseline(log), limit=limit)
    assert rows.columns == [*ft.IDS, *FEATURES]
    found = rows.collect()
    assert sorted(r.event_id for r in found) == list(range(12))
    assert all(math.isfinite(r[name]) for r in found for name in FEATURES)


def test_single_event_has_no_spread(make_log, column):
    log = make_log({"duration": 7.0})
    assert column(ft.build_features(log, bl.fit_baseline(log)), "session_duration_zscore", "access_freq_7d") == [(0.0, 1.0)]


NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    chance = np.random.default_rng(5)
    rows = [(i, f"e{i % 3}", "user" if i % 3 else "edge_device", *map(float, chance.normal(size=3) * [1, 10, 0.1])) for i in range(90)]
    rows.append((90, "alone", "user", 1.0, 2.0, 3.0))
    return spark.createDataFrame(rows, "event_id long, entity_id string, entity_type string, a double, b double, c double")


def test_inverse_covariance(points):
    stats = {r.entity_id: r for r in pr.fit_entity_stats(points, NAMES).collect()}
    rows = points.toPandas()
    for entity in ("e0", "e1", "e2"):
        cov = np.cov(rows[rows.entity_id == entity][NAMES].to_numpy().T) + 1e-5 * np.eye(3)
        assert np.allclose(np.array(stats[entity].inverse) @ cov, np.eye(3), atol=1e-6)
    assert np.allclose(stats["alone"].inverse, np.eye(3))


def test_profile_score_of_mean_and_of_strangers(spark, points):
    stats = pr.fit_entity_stats(points, NAMES)
    mean = stats.filter("entity_id = 'e1'").first()["mean"]
    rows = spark.createDataFrame([(1, "e1", *mean), (2, "nobody", 0.0, 0.0, 0.0)], "event_id long, entity_id string, a double, b double, c double")
    scores = {r.event_id: r.profile_score for r in pr.score_profile(rows, stats, NAMES).collect()}
    assert scores[1] == pytest.approx(0.0, abs=1e-9) and scores[2] == 0.5


@pytest.mark.parametrize("n,share", [(9, 0), (10, 0), (30, 0.5), (49, 0.975), (50, 1), (60, 1)])
def test_cold_start_blend(spark, n, share):
    rows = spark.createDataFrame([(n, [10.0], [0.0])], "n int, own array<double>, cohort array<double>")
    assert rows.select(pr.blend("own", "cohort", F.col("n"))).first()[0] == [pytest.approx(10 * share)]
    rows = spark.createDataFrame([(n, None, [3.0])], "n int, own array<double>, cohort array<double>")
    assert rows.select(pr.blend("own", "cohort", F.col("n"))).first()[0] == [3.0]


def test_normal_rows_fall_back_to_all(spark):
    rows = spark.createDataFrame([("normal",), ("brute_force",)], "label string")
    assert [r.label for r in pr.normal_rows(rows).collect()] == ["normal"]
    assert pr.normal_rows(rows.filter("label <> 'normal'")).count() == 1


def test_reconstruction_error_falls_with_components(points):
    errors = []
    for k in (1, 2, 3):
        scored = mo.score_reconstruction(points, mo.fit_reconstruction(points, k, NAMES), NAMES)
        errors.append(scored.agg(F.avg("reconstruction_score")).first()[0])
    assert errors[0] > errors[1] > errors[2]
    assert errors[2] == pytest.approx(0.0, abs=1e-9)


def test_padding(make_log):
    log = make_log(*[{"at": i} for i in range(12)], *[{"at": i, "entity_id": "usr_2", "event_id": 20 + i} for i in range(3)])
    rows = log.withColumn("x", F.col("event_id").cast("double"))
    full = mo.build_sequences(rows, names=["x"])
    assert sorted(r.event_id for r in full.collect()) == [9, 10, 11]
    padded = {r.event_id: [e[0] for e in r.sequence] for r in mo.build_sequences(rows, pad=True, names=["x"]).collect()}
    assert len(padded) == 15 and all(len(s) == 10 for s in padded.values())
    assert padded[21] == [20.0] * 9 + [21.0] and padded[11] == [float(i) for i in range(2, 12)]
