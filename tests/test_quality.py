"""Evaluation, alerts, models, explanations and storage."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from entitywatch.fixed import FEATURES, LABELS
from entitywatch.operators import alerts as al
from entitywatch.operators import evaluation as ev
from entitywatch.operators import explain as ex
from entitywatch.operators import lookups as lk
from entitywatch.operators import manifold as mf
from entitywatch.operators import models as mo
from entitywatch.operators import nearest as near
from entitywatch.operators import profiles as pr
from entitywatch.session import fresh_path, materialize, release
from entitywatch.sources import tables as tb

TIES = [(0.9, 1), (0.9, 0), (0.8, 1), (0.5, 0), (0.5, 1), (0.5, 0), (0.2, 0), (0.2, 0), (0.1, 1), (0.0, 0)]


def _scored(spark, pairs):
    rows = [(i, s, y, int(s > 0.5)) for i, (s, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "event_id long, score double, y_true int, y_pred int")


def _auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def _precision(pairs):
    total, gained, hits = sum(y for _, y in pairs), 0.0, 0
    for score in sorted({s for s, _ in pairs}, reverse=True):
        reached = [y for s, y in pairs if s >= score]
        gained += (sum(reached) - hits) / total * sum(reached) / len(reached)
        hits = sum(reached)
    return gained


def test_detection_measures_with_ties(spark):
    row = ev.evaluate_detection(_scored(spark, TIES)).first()
    assert row.precision == pytest.approx(2 / 3) and row.recall == pytest.approx(0.5)
    assert row.auc_roc == pytest.approx(_auc(TIES)) and row.auc_pr == pytest.approx(_precision(TIES))
    assert row.fpr_at_1_percent_budget == pytest.approx(1 / 6)


def test_one_class_gives_zero(spark):
    row = ev.evaluate_detection(_scored(spark, [(0.1, 0), (0.2, 0), (0.3, 0), (0.4, 0)])).first()
    assert row[:5] == (0.0, 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("groups", [2, 5, 32])
def test_totals_do_not_depend_on_parts(spark, groups):
    chance = np.random.default_rng(1)
    values = np.unique(np.concatenate([chance.random(60), 0.5 + chance.random(60) * 1e-6, [0.0, 1.0]]))
    counts = spark.createDataFrame([(float(v), i + 1) for i, v in enumerate(values)], "score double, n long")
    got = ev.running_totals(counts, "score", ["n"], groups=groups).orderBy("score").collect()
    assert [r.cum_n for r in got] == np.cumsum(range(1, len(values) + 1)).tolist()
    down = ev.running_totals(counts, "score", ["n"], descending=True, groups=groups).orderBy(F.desc("score")).collect()
    assert [r.cum_n for r in down] == np.cumsum(range(len(values), 0, -1)).tolist()


def test_crowded_scores_are_cut_evenly(spark):
    pairs = [(1 - 1e-4 * i / 3000, i % 3 == 0) for i in range(3000)]
    rows = _scored(spark, [(s, int(y)) for s, y in pairs])
    running = ev.running_totals(ev.score_counts(rows), "score", ["pos", "neg"], groups=4)
    assert running.agg(F.max("cum_pos"), F.max("cum_neg"), F.max("all_pos")).first() == (1000, 2000, 1000)
    sample = [(s, int(y)) for s, y in pairs]
    assert ev.auc_roc(rows).first()[0] == pytest.approx(_auc(sample[::10] if len(sample) < 100 else sample))


def test_rows_without_a_score_take_no_part(spark):
    rows = _scored(spark, [(0.9, 1), (0.2, 0)])
    extra = spark.createDataFrame([(7, None, 0, 0), (8, None, 1, 0)], rows.schema)
    both = rows.unionByName(extra)
    assert ev.auc_roc(both).first()[0] == 1.0 and ev.average_precision(both).first()[0] == 1.0
    assert ev.roc_points(both).count() == 2
    assert [(r.bin, r.n) for r in ev.score_histogram(both, "score").orderBy("bin").collect()] == [(10, 1), (45, 1)]
    assert ev.evaluate_detection(both).first().auc_roc == 1.0


def test_rows_without_a_label_keep_their_place(spark):
    rows = spark.createDataFrame([(1, "normal", 1.0), (2, None, 2.0), (3, "normal", 3.0)], "event_id long, label string, a double")
    got = {r.event_id: r.weight for r in al.with_class_weight(rows).collect()}
    assert got == {1: 0.75, 2: 1.5, 3: 0.75}
    weights = spark.createDataFrame([("normal", [2.0])], "label string, weights array<double>")
    told = ex.linear_contributions(rows, weights, F.array(F.lit(1.0)), ["a"], "label").collect()
    assert {r.event_id: r.contributions for r in told} == {1: [0.0], 2: [0.0], 3: [4.0]}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantile_is_exact(spark, q):
    values = [s for s, _ in TIES]
    assert ev.exact_quantile(_scored(spark, TIES), "score", q).first()[0] == pytest.approx(np.percentile(values, 100 * q))


def test_split_puts_ties_into_test(make_log):
    log = make_log(*[{"at": min(i, 7)} for i in range(10)])
    got = {r.event_id: r.is_test for r in ev.time_split(log).collect()}
    assert [i for i, test in got.items() if test] == [7, 8, 9]


def test_classes_absent_on_one_side(spark):
    rows = spark.createDataFrame([("normal", "normal"), ("normal", "insider_drift"), ("brute_force", "normal")], "label string, pred_label string")
    got = {r.label: (r.support, r.precision, r.recall, r.f1) for r in ev.class_quality(rows).collect()}
    assert got == {"normal": (2, 0.5, 0.5, 0.5), "insider_drift": (0, 0.0, 0.0, 0.0), "brute_force": (1, 0.0, 0.0, 0.0)}
    assert ev.confusion_matrix(rows).columns == ["true_label", *sorted(LABELS)]


def test_queue_ranks_a_page(spark):
    rows = spark.createDataFrame([(i, "brute_force", "normal", i / 100) for i in range(80)],
                                 "event_id long, predicted_attack_type string, true_label string, risk_score double")
    page = al.alert_queue(rows, min_score=0.1, by="risk_score").orderBy("rank").collect()
    assert [r.event_id for r in page] == list(range(79, 50, -1))
    assert al.alert_queue(rows, by="true_label").count() == 0
    assert al.queue_filter(rows, [], 0.5).count() == 30 and al.queue_filter(rows, ["insider_drift"]).count() == 0


def test_largest_values_and_reasons(spark):
    rows = spark.createDataFrame([(1, -5.0, 0.005, 3.0)], "event_id long, hour_of_day double, is_weekend double, access_freq_24hr double")
    names = ["hour_of_day", "is_weekend", "access_freq_24hr"]
    top = al.top_values(rows, 2, names=names).orderBy("rank").collect()
    assert [(r.feature, r.value) for r in top] == [("hour_of_day", -5.0), ("access_freq_24hr", 3.0)]
    told = ex.top_reasons(rows.withColumn("contributions", F.array(F.lit(0.1), F.lit(-0.4), F.lit(0.2))), 2, names).first()
    assert told.top_features == ["is_weekend", "access_freq_24hr"]
    assert told.top_reason == "Flagged due to: access occurred on weekend; elevated 24-hour access volume (3 events)"


def test_overlap(spark):
    ids = lambda *n: spark.createDataFrame([(i,) for i in n], "event_id long")
    assert tuple(al.overlap(ids(1, 2, 3), ids(2, 3, 4, 5)).first()) == (2, 1, 2, 0.4)


def test_stable_order_ignores_partitioning(spark):
    rows = spark.range(200).withColumnRenamed("id", "event_id")
    a = [r[0] for r in al.stable_order(rows.repartition(7)).collect()]
    assert a == [r[0] for r in al.stable_order(rows.coalesce(1)).collect()]
    assert a != sorted(a) and a != [r[0] for r in al.stable_order(rows, 7).collect()]


def test_recent_slice(make_log):
    log = make_log({"at": 0}, {"at": 86400}, {"at": 86401}, {"at": 2 * 86400})
    assert sorted(r.event_id for r in lk.recent(log, 1).collect()) == [2, 3]


NAMES = ["a", "b"]


def _blobs(spark):
    chance = np.random.default_rng(3)
    rows = []
    for i in range(260):
        label = "normal" if i < 200 else ("brute_force" if i < 240 else "insider_drift")
        centre = {"normal": (0, 0), "brute_force": (6, 0), "insider_drift": (0, 6)}[label]
        rows.append((i, label, *(float(c + x) for c, x in zip(centre, chance.normal(size=2)))))
    return spark.createDataFrame(rows, "event_id long, label string, a double, b double")


@pytest.mark.parametrize("block_rows", [4000, 40, 9])
def test_neighbours_are_exact_at_every_size(spark, block_rows):
    rows = _blobs(spark)
    points = {r.event_id: (r.label, np.array([r.a, r.b])) for r in rows.collect()}
    found = mo.neighbours(rows, names=NAMES, block_rows=block_rows).collect()
    assert sorted(r.event_id for r in found) == sorted(points)
    for label in ("normal", "brute_force", "insider_drift"):
        own = [r.position for r in found if r.label == label]
        assert sorted(own) == list(range(len(own)))
    for r in found:
        label, point = points[r.event_id]
        gaps = sorted((float(np.linalg.norm(p - point)), i) for i, (c, p) in points.items() if c == label and i != r.event_id)
        assert [float(np.linalg.norm(np.array(n) - point)) for n in r.neighbours] == pytest.approx([g for g, _ in gaps[:5]])


def test_reference_points_prune_in_many_dimensions(spark):
    """Rows spread over 26 dimensions, a few of them wide: found exactly, and few blocks are looked into."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(1500, 26)) * np.array([100.0] * 3 + [1.0] * 23)
    rows = spark.createDataFrame([(i, "normal" if i % 50 else None, *map(float, p)) for i, p in enumerate(points)], "event_id long, label string, " + ", ".join(f"{n} double" for n in FEATURES))
    share = {r.label: r for r in near.visited_share(rows, block_rows=25).collect()}
    assert share["normal"].blocks >= 60 and share["normal"].visited < 0.2 and share[None].visited <= 1
    found = near.neighbours(rows, block_rows=25).collect()
    assert len(found) == 1500
    for r in found:
        own = np.array([i for i in range(1500) if (i % 50 == 0) == (r.label is None) and i != r.event_id])
        gaps = np.sort(np.sqrt(((points[own] - points[r.event_id]) ** 2).sum(axis=1)))[:5]
        assert [float(np.linalg.norm(np.array(n) - points[r.event_id])) for n in r.neighbours] == pytest.approx(gaps.tolist())


def test_rows_of_blocks_with_few_others_do_not_visit_all_cells(spark):
    """Blocks of some four rows hold too few for five neighbours: the windows of the cells still tell how far these may lie."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 2)) * np.array([1000.0, 1.0])
    ids = [i // 2 if i < 40 else i for i in range(600)]  # some ids twice: no row has itself or its namesake as neighbour
    rows = spark.createDataFrame([(i, "normal", *map(float, p)) for i, p in zip(ids, points)], "event_id long, label string, a double, b double")
    assert near.visited_share(rows, names=NAMES, block_rows=4).first().visited < 0.3
    found = {r.event_id: r for r in near.neighbours(rows, names=NAMES, block_rows=4).collect()}
    for i in range(40, 600):
        gaps = np.sort(np.sqrt(((np.delete(points, i, 0) - points[i]) ** 2).sum(axis=1)))[:5]
        assert [float(np.linalg.norm(np.array(n) - points[i])) for n in found[i].neighbours] == pytest.approx(gaps.tolist())


@pytest.mark.parametrize("rows", [[(1, "a", 0.0, 0.0)], [(i, "a", 1.0, 1.0) for i in range(60)], []])
def test_neighbours_of_single_and_equal_rows(spark, rows):
    table = spark.createDataFrame(rows, "event_id long, label string, a double, b double")
    found = near.neighbours(table, names=NAMES, block_rows=10).collect()
    assert sorted(len(r.neighbours) for r in found) == [min(5, len(rows) - 1)] * len(rows)
    assert sorted(r.position for r in found) == list(range(len(rows)))


@pytest.mark.parametrize("block_rows", [4000, 9])
def test_oversampling_fills_classes_between_neighbours(spark, block_rows):
    rows = _blobs(spark)
    made = mo.oversample(rows, names=NAMES, block_rows=block_rows)
    assert {r.label: r.n for r in al.label_counts(made).collect()} == {"normal": 200, "brute_force": 200, "insider_drift": 200}
    base = {r.event_id: np.array([r.a, r.b]) for r in rows.collect()}
    near = {r.event_id: [np.array(n) for n in r.neighbours] for r in mo.neighbours(rows.filter("label <> 'normal'"), names=NAMES, block_rows=block_rows).collect()}
    for r in made.filter("synthetic").collect():
        point, start = np.array([r.a, r.b]), base[r.event_id]
        gaps = [abs((end - start)[0] * (point - start)[1] - (end - start)[1] * (point - start)[0]) for end in near[r.event_id]]
        assert min(gaps) < 1e-9
    again = mo.oversample(rows.repartition(5), names=NAMES, block_rows=block_rows)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, again.collect()))


def test_too_small_classes_are_left_alone(spark):
    rows = _blobs(spark).filter("label = 'normal' OR event_id IN (201, 202, 203, 204, 205)")
    assert mo.oversample(rows, names=NAMES).count() == 205


def test_forest_and_its_attribution(spark):
    rows = _blobs(spark)
    model = mo.fit_classifier(rows, names=NAMES, trees=10)
    told = ex.explain(rows, model, 2, NAMES).collect()
    assert sum(r.predicted_attack_type == r.label for r in told) > 240
    for r in told:
        assert sum(r.probabilities) == pytest.approx(1.0) and r.confidence == max(r.probabilities)
        assert r.base + sum(r.contributions) == pytest.approx(r.confidence, abs=1e-9)
        assert set(r.shap_values) == set(NAMES) and len(r.top_features) == 2
    shares = [r.importance for r in mo.feature_importance(spark, model, NAMES).collect()]
    assert sum(shares) == pytest.approx(1.0) and shares == sorted(shares, reverse=True)
    one = ex.explain_alert(rows, model, 210, NAMES).collect()
    assert [(r.event_id, r.attack_type) for r in one] == [(210, "brute_force")]


def test_path_sums_of_a_tree_are_those_of_its_steps(spark):
    shares = np.random.default_rng(5).dirichlet(np.ones(3), 7)
    feature, threshold = np.array([1, 0, -1, -1, 1, -1, -1]), np.array([0.5, 0.2, 0.0, 0.0, 0.8, 0.0, 0.0])
    left, right = np.array([1, 2, -1, -1, 5, -1, -1]), np.array([4, 3, -1, -1, 6, -1, -1])
    parts, depth = ex._leaf_parts((feature, threshold, left, right, shares), 2)
    assert depth == 2
    np.testing.assert_allclose(parts[6, 1], [0, shares[6, 1] - shares[0, 1], shares[0, 1]])  # both steps split on 1
    np.testing.assert_allclose(parts[2, 0], [shares[2, 0] - shares[1, 0], shares[1, 0] - shares[0, 0], shares[0, 0]])
    stump = (np.array([-1]), np.array([0.0]), np.array([-1]), np.array([-1]), np.array([[0.25, 0.5, 0.25]]))
    attribute = ex.tree_contributions([(feature, threshold, left, right, shares), stump], 2).func
    points, classes = pd.Series([[0.1, 0.9], [0.2, 0.5], [float("nan"), 0.3]]), pd.Series([1, 0, 2])
    for told, leaf, c in zip(attribute(points, classes), (6, 2, 3), classes):
        np.testing.assert_allclose(told, (parts[leaf, c] + [0, 0, (0.25, 0.5, 0.25)[c]]) / 2)


def test_detector_finds_a_planted_signal(spark, make_log):
    events = [{"at": i * 60 + e, "event_id": e * 60 + i, "entity_id": f"usr_{e}"} for e in range(8) for i in range(60)]
    rows = make_log(*events).withColumn("y", (F.col("event_id") % 60 % 7 == 0).cast("int"))
    rows = rows.withColumns({"a": F.col("y") * 2.0 + F.pmod(F.xxhash64("event_id"), F.lit(100)) / 100, "b": F.lit(1.0)})
    model = mo.fit_detector(mo.with_age(mo.build_sequences(rows, names=NAMES)))
    scored = mo.score_detector(mo.build_sequences(rows, pad=True, names=NAMES), model)
    assert scored.count() == 480
    assert scored.filter("risk_score < 0 OR risk_score > 1").count() == 0
    assert ev.auc_roc(scored, "risk_score", "y").first()[0] > 0.95


def test_validation_looks_at_the_latest_rows(spark, make_log):
    events = [{"at": i * 60 + e, "event_id": e * 100 + i, "entity_id": f"usr_{e}"} for e in range(6) for i in range(80)]
    rows = make_log(*events).withColumn("y", (F.col("event_id") % 100 % 7 == 0).cast("int"))
    rows = rows.withColumns({name: F.lit(1.0) for name in FEATURES}).withColumn(FEATURES[0], F.col("y") * 2.0)
    sequences = mo.with_age(mo.build_sequences(rows))
    earlier, latest = mo.validation_slice(sequences, 0.1)
    assert earlier.agg(F.max("timestamp")).first()[0] < latest.agg(F.min("timestamp")).first()[0]
    assert 0 < latest.count() <= 0.11 * sequences.count()
    row = mo.validate_detector(sequences).first()
    assert row.auc_roc > 0.95 and row.auc_pr > 0.9


def test_intermediate_tables_can_be_released(spark):
    table = materialize(spark.range(3), "some")
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(path) and release(spark) >= 1 and not os.path.exists(path)


def test_tables_survive_a_round_trip(spark, make_log):
    log = make_log({"commands": "", "geo": 'Say "hi"|1|2'}, {"commands": None, "duration": None, "at": 0.25, "resource": "a,b"})
    for fmt in ("csv", "parquet"):
        path = fresh_path(spark, "log")
        tb.write_table(log, path, fmt)
        assert sorted(map(tuple, tb.read_access_log(spark, path, fmt).collect())) == sorted(map(tuple, log.collect()))


def test_alerts_are_kept_by_day(spark, make_log):
    log = make_log({"at": 0}, {"at": 86400})
    alerts = log.select("event_id", "entity_id", "timestamp", F.lit("normal").alias("true_label"), F.lit(0.5).alias("risk_score"),
                        F.lit("normal").alias("predicted_attack_type"), F.lit("x").alias("top_reason"), *[F.lit(1.0).alias(n) for n in FEATURES])
    path = fresh_path(spark, "alerts")
    tb.write_alerts(alerts, path)
    assert sorted(map(tuple, tb.read_alerts(spark, path).drop("date").collect())) == sorted(map(tuple, alerts.collect()))
    plan = spark.read.parquet(path).filter("date = DATE '2024-03-05'")
    assert plan.count() == 1 and len(plan.inputFiles()) >= 1


def test_metrics_document(spark):
    assert tb.read_metrics(spark, fresh_path(spark, "none")).first()[0] == "{}"
    path = fresh_path(spark, "metrics")
    tb.write_metrics(spark.createDataFrame([('{"detection":{"f1":0.5}}',)], "metrics string"), path)
    assert tb.read_metrics(spark, path).select(F.get_json_object("metrics", "$.detection.f1")).first()[0] == "0.5"


def test_stored_sketches_answer_for_any_days(spark):
    rng = np.random.default_rng(5)
    values = [(int(d), float(v)) for d, v in zip(rng.integers(0, 6, 20_000), rng.gamma(0.3, 50, 20_000))] + [(2, None)] * 9
    table = spark.createDataFrame(values, "day int, v double").withColumn("timestamp", F.timestamp_seconds(F.col("day") * 86_400 + 5))
    path = fresh_path(spark, "sketches")
    ev.sketch_days(table, "v").write.parquet(path)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for since, until, days in ((None, None, range(6)), ("1970-01-02", "1970-01-05", range(1, 4)), ("1970-01-06", None, range(5, 6))):
        own = np.sort([v for d, v in values if d in days and v is not None])
        (row,) = ev.sketched_quantiles(spark.read.parquet(path), shares, since=since, until=until).collect()
        assert row.n == len(own)
        for q, x in zip(shares, row.quantiles):
            assert np.searchsorted(own, x, "left") / len(own) - ev.SKETCH_ERROR <= q <= np.searchsorted(own, x, "right") / len(own) + ev.SKETCH_ERROR
    assert ev.sketched_quantiles(ev.sketch_days(table.limit(0), "v"), shares).count() == 0


def test_merged_moments_equal_a_fit_on_all(spark):
    rng = np.random.default_rng(8)
    rows = [(f"usr_{min(i % 7, 4)}", i % 3, *(1e4 + rng.normal(size=3))) for i in range(60)] + [("once", 0, 1.0, 2.0, 3.0), ("new", 2, 4.0, 5.0, 6.0)]
    table = spark.createDataFrame([(e, p, *map(float, x)) for e, p, *x in rows], "entity_id string, part int, a double, b double, c double")
    names = ["a", "b", "c"]
    parts = [pr.entity_moments(table.filter(F.col("part") == p), names) for p in range(3)]
    merged = pr.merge_moments(pr.merge_moments(*parts[:2]), parts[2])
    got = {r.entity_id: r for r in pr.moment_stats(merged).collect()}
    want = {r.entity_id: r for r in pr.fit_entity_stats(table, names).collect()}
    assert set(got) == set(want) and got["once"].events == 1
    for key, r in want.items():
        assert got[key].events == r.events and got[key].mean == pytest.approx(r.mean, rel=1e-12)
        assert got[key].std == (pytest.approx(r.std, rel=1e-9) if r.events > 1 else r.std)
        assert np.array(got[key].inverse) == pytest.approx(np.array(r.inverse), rel=1e-7)
    assert pr.merge_moments(*[p.limit(0) for p in parts]).count() == 0


def test_rows_off_a_ring_stand_out(spark):
    """The middle of a ring is off the surface, which no linear components can tell; values against a second computation."""
    rng = np.random.default_rng(2)
    angle = rng.uniform(0, 2 * np.pi, 500)
    ring = np.stack([np.cos(angle), np.sin(angle), 0 * angle], axis=1) * 3 + rng.normal(scale=0.1, size=(500, 3))
    middle = rng.normal(scale=0.4, size=(40, 3))
    points = np.concatenate([ring, middle])
    rows = spark.createDataFrame([(i, int(i >= 500), *map(float, p)) for i, p in enumerate(points)], "event_id long, y_true int, a double, b double, c double")
    names, fitted, asked = ["a", "b", "c"], rows.filter("event_id < 400"), rows.filter("event_id >= 400")
    model = mf.fit_manifold(fitted, k=12, width=1.0, names=names, waves=128)
    scored = mf.score_manifold(asked, model, names)
    assert ev.auc_roc(scored, "manifold_score").first()[0] > 0.98
    linear = mo.score_reconstruction(asked, mo.fit_reconstruction(fitted, 2, names), names)
    assert ev.auc_roc(linear, "reconstruction_score").first()[0] < 0.8
    waves = mf.waves_of(points, ring[:400].mean(axis=0), ring[:400].std(axis=0), model.directions, model.shifts)
    gaps = waves - waves[:400].mean(axis=0)
    leading = np.linalg.eigh(gaps[:400].T @ gaps[:400])[1][:, -12:]
    want = (gaps**2).sum(axis=1) - ((gaps @ leading) ** 2).sum(axis=1)
    assert [r.manifold_error for r in scored.orderBy("event_id").collect()] == pytest.approx(want[400:].tolist(), abs=1e-9)


def test_bad_rows_are_kept_apart(spark, make_log):
    log = make_log({"event_id": 1, "commands": "ls,cat"}, {"event_id": 2, "entity_id": None}, {"event_id": 3, "commands": None})
    path = fresh_path(spark, "mixed")
    tb.write_table(log, path, "csv")
    spark.createDataFrame([("entity_id of the header",), ("x,usr_1,user",)], "value string").coalesce(1).write.mode("append").text(path)
    good, rejected = tb.read_checked(spark, path, log.schema, ("event_id", "entity_id"))
    assert sorted(map(tuple, good.collect())) == sorted(tuple(r) for r in log.collect() if r.event_id != 2)
    found = {r.reason: r.text for r in rejected.collect()}
    assert found["unreadable"] == "x,usr_1,user" and '"event_id":2' in found["no entity_id"] and len(found) == 2
    assert tb.read_checked(spark, path, log.schema)[0].count() == 3
