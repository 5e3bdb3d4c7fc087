"""Queries over baselines, windows, features, profiles and rules."""

from __future__ import annotations

from .. import functions as fn
from ..fixed import CITIES, DAY, FEATURES, HOUR, MINUTE, RESOURCES, TYPICAL_SCHEMES
from ..operators import alerts as al
from ..operators import baseline as bl
from ..operators import evaluation as ev
from ..operators import explain as ex
from ..operators import features as ft
from ..operators import lookups as lk
from ..operators import models as mo
from ..operators import profiles as pr
from ..operators import rules as ru
from ..operators.windows import sweep
from ..session import materialize
from .common import *

SPLIT = 20  # rows above which the `_split` queries cut an entity into time chunks


def over(width: int) -> str:
    return f"(PARTITION BY entity_id ORDER BY us RANGE BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


ORDER = "(PARTITION BY entity_id ORDER BY us, event_id)"
STEP = f"""step AS (SELECT *, lag(us) OVER {ORDER} AS pus, lag(lat) OVER {ORDER} AS plat, lag(lon) OVER {ORDER} AS plon FROM base)"""
MOVE = f"""moves AS (SELECT *, CASE WHEN pus IS NULL THEN 0.0 ELSE (us - pus) / 1000000.0 END AS waited,
  {haversine_sql('plat', 'plon', 'lat', 'lon')} AS moved_km FROM step),
speeds AS (SELECT *, CASE WHEN waited > 0 THEN moved_km / (waited / 3600.0) ELSE 0.0 END AS kmh FROM moves)"""


def mix(column: str, name: str) -> str:
    """Distinct count and entropy over a day, with days as equi-join key: an event looks at its day and the one before."""
    return f"""{name}_counts AS MATERIALIZED (SELECT a.event_id, b.{column} AS v, count(*) AS n
    FROM (SELECT event_id, entity_id, us, us // {DAY} - back AS day FROM base CROSS JOIN range(0, 2) AS r(back)) a
    JOIN (SELECT entity_id, us, us // {DAY} AS day, {column} FROM base WHERE {column} IS NOT NULL) b
    ON a.entity_id = b.entity_id AND a.day = b.day AND b.us > a.us - {DAY} AND b.us <= a.us GROUP BY a.event_id, b.{column}),
{name} AS MATERIALIZED (SELECT event_id, count(*) AS breadth, -sum(p * ln(p)) AS entropy FROM (
    SELECT event_id, n / sum(n) OVER (PARTITION BY event_id) AS p FROM {name}_counts) GROUP BY event_id)"""


RESOURCE_MIX, GEO_MIX = mix("resource_accessed", "rmix"), mix("geo_location", "gmix")
ROLLING = f"""rolling AS (SELECT event_id, count(*) OVER {over(5 * MINUTE)} AS f5, count(*) OVER {over(HOUR)} AS f1h,
  count(*) OVER {over(DAY)} AS f24, count(*) OVER {over(7 * DAY)} AS f7d,
  CAST(sum(failed) OVER {over(5 * MINUTE)} AS BIGINT) AS x5, CAST(sum(failed) OVER {over(HOUR)} AS BIGINT) AS x1h FROM base)"""
NOVEL = """novel AS (SELECT b.event_id, CASE WHEN k.value IS NULL AND b.resource_accessed IS NOT NULL THEN 1 ELSE 0 END AS resource,
  CASE WHEN d.value IS NULL AND b.device_fingerprint IS NOT NULL THEN 1 ELSE 0 END AS device,
  CASE WHEN b.device_fingerprint IS NOT NULL AND b.device_fingerprint NOT IN
    (SELECT device_fingerprint FROM train WHERE device_fingerprint IS NOT NULL) THEN 1 ELSE 0 END AS anywhere
  FROM base b LEFT JOIN known k ON k.entity_id = b.entity_id AND k.kind = 'resource' AND k.value = b.resource_accessed
  LEFT JOIN known d ON d.entity_id = b.entity_id AND d.kind = 'device' AND d.value = b.device_fingerprint)"""
COMMAND = """tokens AS (SELECT event_id, entity_id, trim(c) AS c FROM (
    SELECT event_id, entity_id, unnest(string_split(command_sequence, ';')) AS c FROM base) WHERE trim(c) <> ''),
command_novelty AS (SELECT t.event_id, avg(CASE WHEN k.value IS NULL THEN 1.0 ELSE 0.0 END) AS ratio FROM tokens t
  LEFT JOIN known k ON k.entity_id = t.entity_id AND k.kind = 'command' AND k.value = t.c GROUP BY t.event_id)"""
AWAY = haversine_sql("hlat", "hlon", "lat", "lon")
ZSCORE = "coalesce((session_duration - dmean) / CASE WHEN dstd = 0 THEN 1.0 ELSE dstd END, 0.0)"
VALUES = {
    "hour_of_day": "hour(ts)",
    "day_of_week": "isodow(ts) - 1",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END",
    "is_off_hours": "CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 1 ELSE 0 END",
    "time_since_last_access_sec": "waited",
    "access_freq_5min": "f5",
    "access_freq_1hr": "f1h",
    "access_freq_24hr": "f24",
    "access_freq_7d": "f7d",
    "geo_velocity_kmh": "kmh",
    "geo_distance_km": AWAY,
    "geo_entropy": "gmix.entropy",
    "resource_novelty_score": "novel.resource",
    "resource_breadth": "rmix.breadth",
    "resource_entropy": "rmix.entropy",
    "failed_auth_count_5min": "x5",
    "failed_auth_count_1hr": "x1h",
    "auth_method_changed": "CASE WHEN auth_method <> hauth THEN 1 ELSE 0 END",
    "session_duration_zscore": ZSCORE,
    "session_duration_raw": "session_duration",
    "fingerprint_mismatch": "novel.device",
    "new_device_flag": "novel.anywhere",
    "command_seq_length": "CASE WHEN trim(command_sequence) = '' THEN 0 ELSE len(string_split(command_sequence, ';')) END",
    "command_seq_novelty": "coalesce(ratio, 0.0)",
    "entity_type_encoded": "CASE entity_type WHEN 'user' THEN 0 WHEN 'service_account' THEN 1 WHEN 'edge_device' THEN 2 ELSE -1 END",
    "auth_method_encoded": "CASE auth_method WHEN 'password' THEN 0 WHEN 'token' THEN 1 WHEN 'certificate' THEN 2 WHEN 'biometric' THEN 3 ELSE -1 END",
}
KILOMETRES = {"geo_velocity_kmh": 3, "geo_distance_km": 3}
FEATURE_TABLE = "feature AS (SELECT event_id, s.entity_id, entity_type, ts, us, " + ", ".join(
    f"CAST({VALUES[n]} AS DOUBLE) AS {n}" for n in FEATURES
) + """ FROM speeds s JOIN rolling USING (event_id) JOIN rmix USING (event_id) JOIN gmix USING (event_id) JOIN novel USING (event_id)
  LEFT JOIN command_novelty USING (event_id) LEFT JOIN home_geo hg ON hg.entity_id = s.entity_id
  LEFT JOIN home_auth ha ON ha.entity_id = s.entity_id LEFT JOIN spread sp ON sp.entity_id = s.entity_id)"""
FEATURE_PARTS = [BASE, TRAIN, KNOWN, HOMES, SPREAD, STEP, MOVE, ROLLING, RESOURCE_MIX, GEO_MIX, NOVEL, COMMAND, FEATURE_TABLE]


def rounded(names, digits: int = 6, **special: int) -> str:
    return ", ".join(f"round({n}, {special.get(n, digits)}) + 0.0 AS {n}" for n in names)


def feature_rows(spark, sf_dir):
    log = access_log(spark, sf_dir)
    return ft.build_features(log, stored(log))


def labelled_features(spark, sf_dir):
    return al.attach_truth(feature_rows(spark, sf_dir), truth(spark, sf_dir))


def features(spark, sf_dir, limit=None):
    log = access_log(spark, sf_dir)
    options = {} if limit is None else {"limit": limit}
    return tidy(ft.build_features(log, stored(log), ["event_id", "entity_id"], **options), **KILOMETRES)


FEATURES_SQL = sql(f"SELECT event_id, entity_id, {rounded(FEATURES, **KILOMETRES)} FROM feature", *FEATURE_PARTS)


def fastest_moves(spark, sf_dir):
    """The 50 fastest consecutive moves."""
    rows = ft.movement(access_log(spark, sf_dir)).orderBy(F.desc("geo_velocity_kmh"), "event_id").limit(50)
    return tidy(rows.select("event_id", "entity_id", "moved_km", "geo_velocity_kmh"), 3)


FASTEST = sql(
    "SELECT event_id, entity_id, round(moved_km, 3) + 0.0 AS moved_km, round(kmh, 3) + 0.0 AS geo_velocity_kmh FROM speeds "
    "ORDER BY kmh DESC, event_id LIMIT 50", BASE, STEP, MOVE)


def movement(spark, sf_dir, limit=2_000_000):
    rows = ft.movement(access_log(spark, sf_dir), limit=limit)
    names = "event_id", "time_since_last_access_sec", "moved_km", "geo_velocity_kmh"
    return tidy(rows.select(*names), moved_km=3, geo_velocity_kmh=3)


MOVEMENT = sql(
    "SELECT event_id, round(waited, 6) + 0.0 AS time_since_last_access_sec, round(moved_km, 3) + 0.0 AS moved_km, "
    "round(kmh, 3) + 0.0 AS geo_velocity_kmh FROM speeds", BASE, STEP, MOVE)


def rolling(spark, sf_dir, limit=2_000_000):
    rows = ft.rolling_counts(access_log(spark, sf_dir), limit)
    return tidy(rows.select("event_id", *ft.FREQUENCIES, *ft.FAILURES))


ROLLING_SQL = sql("""SELECT event_id, f5 AS access_freq_5min, f1h AS access_freq_1hr, f24 AS access_freq_24hr, f7d AS access_freq_7d,
  x5 AS failed_auth_count_5min, x1h AS failed_auth_count_1hr FROM rolling""", BASE, ROLLING)


def variety(spark, sf_dir, limit=2_000_000):
    rows = ft.variety(access_log(spark, sf_dir), limit)
    return tidy(rows.select("event_id", "resource_breadth", "resource_entropy", "geo_breadth", "geo_entropy"))


VARIETY_SQL = sql("""SELECT event_id, rmix.breadth AS resource_breadth, round(rmix.entropy, 6) + 0.0 AS resource_entropy,
  gmix.breadth AS geo_breadth, round(gmix.entropy, 6) + 0.0 AS geo_entropy FROM rmix JOIN gmix USING (event_id)""",
  BASE, RESOURCE_MIX, GEO_MIX)


def duration_zscore(spark, sf_dir):
    return tidy(ft.duration_zscore(access_log(spark, sf_dir)).select("event_id", "session_duration_zscore"))


def fitted_zscore(spark, sf_dir):
    log = access_log(spark, sf_dir)
    rows = ft.duration_zscore(log, bl.duration_spread(train_part(log)))
    return tidy(rows.select("event_id", "session_duration_zscore"))


SMALL = ["hour_of_day", "session_duration", "k_value"]


def small_features(spark, sf_dir):
    """Three plain numbers per event, for exact checks of the array operators."""
    return scored_log(spark, sf_dir).select(
        "event_id",
        "entity_id",
        "entity_type",
        "timestamp",
        "label",
        "pred_label",
        F.hour("timestamp").cast("double").alias("hour_of_day"),
        "session_duration",
        (F.col("risk_score") * 10).alias("k_value"),
    )


SMALL_TABLE = """small AS (SELECT event_id, entity_id, entity_type, epoch_us(ts) AS us, label, pred_label, CAST(hour(ts) AS DOUBLE) AS hour_of_day,
  session_duration, risk_score * 10 AS k_value FROM access_log)"""


def sequence_sums(spark, sf_dir, pad=False, limit=2_000_000):
    """Sequences folded to position-weighted sums, which pin down every value and its place."""
    rows = mo.build_sequences(small_features(spark, sf_dir), pad=pad, names=SMALL, limit=limit)

    def folded(place):
        weighted = F.transform("sequence", lambda event, i: F.get(event, F.lit(place)) * (i + 1))
        return F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x)

    folded = [folded(place).alias(name) for place, name in enumerate(SMALL)]
    return tidy(rows.select("event_id", "event_number", *folded), 4)


def _sequence_sql(pad: bool) -> str:
    numbered = f"numbered AS (SELECT *, row_number() OVER {ORDER} AS rn FROM small)"
    if pad:
        body = """SELECT a.event_id, a.rn AS event_number, {sums} FROM numbered a, range(1, 11) AS p(pos)
  JOIN numbered b ON b.entity_id = a.entity_id AND b.rn = greatest(a.rn - 10 + p.pos, 1) GROUP BY a.event_id, a.rn"""
    else:
        body = """SELECT a.event_id, a.rn AS event_number, {sums} FROM numbered a, range(1, 11) AS p(pos)
  JOIN numbered b ON b.entity_id = a.entity_id AND b.rn = a.rn - 10 + p.pos WHERE a.rn >= 10 GROUP BY a.event_id, a.rn"""
    body = body.replace("FROM numbered a, range(1, 11) AS p(pos)", "FROM numbered a CROSS JOIN range(1, 11) AS p(pos)")
    sums = ", ".join(f"round(sum(b.{n} * p.pos), 4) + 0.0 AS {n}" for n in SMALL)
    return sql(body.format(sums=sums), SMALL_TABLE, numbered, scores=True)


def ages(spark, sf_dir):
    rows = mo.with_age(sweep(access_log(spark, sf_dir), number="event_number"))
    return tidy(rows.select("event_id", "age", "decay"))


AGES = sql(f"""SELECT event_id, n - rn AS age, round(pow(0.95, n - rn), 6) + 0.0 AS decay FROM (
  SELECT event_id, count(*) OVER (PARTITION BY entity_id) AS n, row_number() OVER {ORDER} AS rn FROM base)""", BASE)


def numbers(spark, sf_dir, limit=2_000_000):
    return tidy(sweep(access_log(spark, sf_dir), number="event_number", limit=limit).select("event_id", "event_number"))


NUMBERS = sql(f"SELECT event_id, row_number() OVER {ORDER} AS event_number FROM base", BASE)


def time_split(spark, sf_dir):
    return tidy(ev.time_split(access_log(spark, sf_dir)).select("event_id", "is_test"))


def known(spark, sf_dir):
    return bl.known_values(train_part(access_log(spark, sf_dir)))


def known_counts(spark, sf_dir):
    return tidy(known(spark, sf_dir).groupBy("entity_id", "kind").agg(F.count(F.lit(1)).alias("n")))


def homes(spark, sf_dir):
    return tidy(bl.usual_places(train_part(access_log(spark, sf_dir))))


def devices(spark, sf_dir):
    return bl.global_devices(train_part(access_log(spark, sf_dir)))


def extended(spark, sf_dir):
    log = access_log(spark, sf_dir)
    first = bl.known_values(train_part(log))
    later = log.filter(F.col("timestamp") >= F.lit(TRAIN_UNTIL).cast("timestamp"))
    return bl.extend_known(first, later)


def home_distance(spark, sf_dir):
    log = ft.with_position(access_log(spark, sf_dir))
    rows = ft.home_distance(log, fitted(log))
    return tidy(rows.select("event_id", "geo_distance_km", "auth_method_changed"), geo_distance_km=3)


def unseen(spark, sf_dir):
    log = access_log(spark, sf_dir)
    base = fitted(log)
    rows = bl.mark_unseen(
        log, bl.known_of(base, "resource", "resource_accessed"), "resource_accessed", "resource_novelty_score"
    )
    rows = rows.join(bl.device_flags(log, base), ["entity_id", "device_fingerprint"], "left")
    rows = rows.fillna(0, ["fingerprint_mismatch", "new_device_flag"])
    return tidy(rows.select("event_id", "resource_novelty_score", "fingerprint_mismatch", "new_device_flag"))


def command_novelty(spark, sf_dir):
    log = access_log(spark, sf_dir)
    rows = log.join(bl.command_novelty(log, fitted(log)), ["entity_id", "command_sequence"], "left")
    return tidy(rows.select("event_id", F.coalesce("command_seq_novelty", F.lit(0.0)).alias("command_seq_novelty")))


def entity_stats(spark, sf_dir):
    means = pr.entity_means(small_features(spark, sf_dir), SMALL)
    flat = [F.get(a, F.lit(i)).alias(f"{a}_{n}") for a in ("mean", "std") for i, n in enumerate(SMALL)]
    return tidy(means.select("entity_id", "events", *flat))


STATS_SQL = sql("SELECT entity_id, count(*) AS events, " + ", ".join(
    [f"round(avg({n}), 6) + 0.0 AS mean_{n}" for n in SMALL] + [f"round(stddev_samp({n}), 6) + 0.0 AS std_{n}" for n in SMALL]
) + " FROM small GROUP BY entity_id", SMALL_TABLE, scores=True)


def covariances(spark, sf_dir):
    rows = small_features(spark, sf_dir)
    found = pr.entity_covariance(rows, pr.entity_means(rows, SMALL), SMALL)
    cells = [
        F.get(F.get("covariance", F.lit(i)), F.lit(j)).alias(f"c{i}{j}") for i in range(3) for j in range(3)
    ]
    return tidy(found.select("entity_id", *cells), 4)


COVARIANCES = sql("SELECT entity_id, " + ", ".join(
    f"round(covar_samp({a}, {b}), 4) + 0.0 AS c{i}{j}" for i, a in enumerate(SMALL) for j, b in enumerate(SMALL)
) + " FROM small GROUP BY entity_id", SMALL_TABLE, scores=True)

COFACTORS = [["c11*c22 - c12*c12", "c02*c12 - c01*c22", "c01*c12 - c02*c11"],
             ["", "c00*c22 - c02*c02", "c01*c02 - c00*c12"], ["", "", "c00*c11 - c01*c01"]]
QUADRATIC = " + ".join(
    f"{1 if i == j else 2} * d{i} * d{j} * ({COFACTORS[i][j]})" for i in range(3) for j in range(i, 3)
)
PROFILE = f"""moments AS (SELECT entity_id, {', '.join(f'avg({n}) AS m{i}' for i, n in enumerate(SMALL))},
  {', '.join(f"covar_samp({SMALL[i]}, {SMALL[j]}) + {1e-5 if i == j else 0.0} AS c{i}{j}" for i in range(3) for j in range(i, 3))}
  FROM small WHERE us < epoch_us(TIMESTAMP '{TRAIN_UNTIL}') GROUP BY entity_id),
gaps AS (SELECT event_id, c00, c01, c02, c11, c12, c22, {', '.join(f'{n} - m{i} AS d{i}' for i, n in enumerate(SMALL))}
  FROM small LEFT JOIN moments USING (entity_id)),
profile AS (SELECT event_id, coalesce(1 - exp(-sqrt(greatest(0.0, ({QUADRATIC}) /
  (c00*(c11*c22 - c12*c12) - c01*(c01*c22 - c12*c02) + c02*(c01*c12 - c11*c02))))), 0.5) AS profile_score FROM gaps)"""


def profile_scores(spark, sf_dir):
    rows = small_features(spark, sf_dir)
    return tidy(pr.score_profile(rows, pr.fit_entity_stats(train_part(rows), SMALL), SMALL).select("event_id", "profile_score"), 5)


def combined_scores(spark, sf_dir):
    rows = small_features(spark, sf_dir)
    both = pr.score_profile(rows, pr.fit_entity_stats(train_part(rows), SMALL), SMALL)
    both = both.withColumn("reconstruction_score", fn.saturate(F.col("k_value") / 10))
    return tidy(both.select("event_id", pr.combine().alias("baseline_score")), 5)


def cohorts(spark, sf_dir):
    found = pr.fit_cohorts(small_features(spark, sf_dir), SMALL)
    flat = [F.get("cohort_mean", F.lit(i)).alias(f"mean_{n}") for i, n in enumerate(SMALL)]
    return tidy(found.select(F.coalesce("entity_type", F.lit("everyone")).alias("cohort"), "events", *flat))


COHORTS = sql("SELECT coalesce(entity_type, 'everyone') AS cohort, count(*) AS events, " + ", ".join(
    f"round(avg({n}), 6) + 0.0 AS mean_{n}" for n in SMALL
) + " FROM small GROUP BY GROUPING SETS ((entity_type), ())", SMALL_TABLE, scores=True)


def cohort_lookup(spark, sf_dir):
    """Cohorts learned without edge devices, which then fall back to everyone."""
    rows = small_features(spark, sf_dir)
    learned = pr.fit_cohorts(rows.filter(F.col("entity_type") != "edge_device"), SMALL)
    flat = [F.get("cohort_mean", F.lit(i)).alias(f"mean_{n}") for i, n in enumerate(SMALL)]
    return tidy(pr.with_cohort(rows, learned).select("event_id", *flat))


COHORT_LOOKUP = sql("SELECT s.event_id, " + ", ".join(
    f"round(coalesce(c.mean_{n}, g.mean_{n}), 6) + 0.0 AS mean_{n}" for n in SMALL
) + " FROM small s LEFT JOIN typed c USING (entity_type) CROSS JOIN everyone g", SMALL_TABLE, *[
    f"{name} AS (SELECT {key} {', '.join(f'avg({n}) AS mean_{n}' for n in SMALL)} FROM small WHERE entity_type <> 'edge_device' {group})"
    for name, key, group in (("typed", "entity_type,", "GROUP BY entity_type"), ("everyone", "", ""))
], scores=True)


def cold_start(spark, sf_dir):
    rows = small_features(spark, sf_dir)
    numbered = sweep(rows, number="event_number")
    scores = pr.score_cold_start(numbered, pr.entity_means(train_part(rows), SMALL), pr.fit_cohorts(rows, SMALL), SMALL)
    return tidy(scores.select("event_id", "event_number", "cold_start_score"))


_ALPHA = "greatest(0.0, least(1.0, (rn - 10) / 40.0))"
_DISTANCE = " + ".join(
    f"pow({n} - CASE WHEN o.m_{n} IS NULL THEN c.m_{n} ELSE {_ALPHA} * o.m_{n} + (1 - {_ALPHA}) * c.m_{n} END, 2)" for n in SMALL
)
_MEANS = ", ".join(f"avg({n}) AS m_{n}" for n in SMALL)
COLD_START = sql(f"""SELECT event_id, rn AS event_number, round(1 - exp(-sqrt({_DISTANCE})), 6) + 0.0 AS cold_start_score
  FROM (SELECT *, row_number() OVER {ORDER} AS rn FROM small) LEFT JOIN own o USING (entity_id) JOIN cohort c USING (entity_type)""",
  SMALL_TABLE, f"own AS (SELECT entity_id, {_MEANS} FROM small WHERE us < epoch_us(TIMESTAMP '{TRAIN_UNTIL}') GROUP BY entity_id)",
  f"cohort AS (SELECT entity_type, {_MEANS} FROM small GROUP BY entity_type)", scores=True)


def distant_places(spark, sf_dir):
    return tidy(lk.distant_places(access_log(spark, sf_dir)), 3)


_CITY_ROWS = ", ".join(f"('{c}', {a}, {o})" for c, a, o in CITIES)
DISTANT = sql(f"""SELECT city, events, far_city, round(km, 3) + 0.0 AS distance_km FROM (
  SELECT p.*, far_city, {haversine_sql('lat', 'lon', 'clat', 'clon')} AS km
  FROM (SELECT city, lat, lon, count(*) AS events FROM base GROUP BY city, lat, lon) p
  CROSS JOIN (VALUES {_CITY_ROWS}) AS c(far_city, clat, clon)) WHERE km > 5000""", BASE)


def unused_resources(spark, sf_dir):
    return lk.unused_resources(access_log(spark, sf_dir))


_RESOURCE_ROWS = ", ".join(f"('{r}')" for r in RESOURCES)
UNUSED = sql(f"""SELECT e.entity_id, r.resource_accessed FROM (SELECT DISTINCT entity_id FROM access_log) e
  CROSS JOIN (VALUES {_RESOURCE_ROWS}) AS r(resource_accessed) ANTI JOIN access_log l
  ON l.entity_id = e.entity_id AND l.resource_accessed = r.resource_accessed""")


def untypical(spark, sf_dir):
    return lk.untypical_resources(access_log(spark, sf_dir))


UNTYPICAL = sql("SELECT DISTINCT entity_type, resource_accessed FROM access_log WHERE NOT ("
  + " OR ".join(
      f"(entity_type = '{t}' AND split_part(resource_accessed, '://', 1) IN ({', '.join(repr(x) for x in s)}))"
      for t, s in TYPICAL_SCHEMES.items()) + ")")


def brute_force(spark, sf_dir, limit=2_000_000):
    return tidy(ru.brute_force(access_log(spark, sf_dir), 2, 2 * DAY, None, limit))


BRUTE = sql(f"""SELECT entity_id, source_ip, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY entity_id, source_ip ORDER BY us) AS run FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY entity_id, source_ip ORDER BY us) <= {2 * DAY} THEN 0 ELSE 1 END AS fresh
    FROM base WHERE failed = 1)) GROUP BY entity_id, source_ip, run HAVING count(*) >= 2""", BASE)


def travel(spark, sf_dir):
    return tidy(ru.impossible_travel(access_log(spark, sf_dir)), 3)


TRAVEL = sql(f"""SELECT event_id, entity_id, pus AS start_us, us AS end_us, round(moved_km, 3) + 0.0 AS moved_km,
  round(kmh, 3) + 0.0 AS geo_velocity_kmh FROM speeds WHERE us - pus <= {30 * MINUTE} AND moved_km > 5000""", BASE, STEP, MOVE)


def stuffing(spark, sf_dir):
    return tidy(ru.credential_stuffing(access_log(spark, sf_dir), 3, 6 * HOUR, 0.3))


STUFFING = sql(f"""SELECT us // {6 * HOUR} * {6 * HOUR} AS start_us, source_ip, count(DISTINCT entity_id) AS entities, count(*) AS events,
  round(avg(failed), 6) + 0.0 AS failure_ratio FROM base GROUP BY 1, 2 HAVING count(DISTINCT entity_id) >= 3 AND avg(failed) >= 0.3""", BASE)


def stuffing_sliding(spark, sf_dir, limit=2_000_000):
    found = ru.credential_stuffing_sliding(access_log(spark, sf_dir), 3, 6 * HOUR, 0.3, limit)
    return tidy(found.withColumn("entities", F.col("entities").cast("bigint")).withColumn("events", F.col("events").cast("bigint")))


STUFFING_SLIDING = sql(f"""SELECT event_id, source_ip, us AS end_us, entities, events, round(ratio, 6) + 0.0 AS failure_ratio FROM (
  SELECT event_id, source_ip, us, count(DISTINCT entity_id) OVER w AS entities, count(*) OVER w AS events, avg(failed) OVER w AS ratio FROM base
  WINDOW w AS (PARTITION BY source_ip ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW)) WHERE entities >= 3 AND ratio >= 0.3""", BASE)


def lateral(spark, sf_dir, limit=2_000_000):
    log = access_log(spark, sf_dir)
    return tidy(ru.lateral_movement(log, fitted(log), 2, 3 * DAY, limit))


LATERAL = sql(f"""SELECT entity_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY us) AS run FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY entity_id ORDER BY us) <= {3 * DAY} THEN 0 ELSE 1 END AS fresh
    FROM base b ANTI JOIN known k ON k.entity_id = b.entity_id AND k.kind = 'resource' AND k.value = b.resource_accessed))
  GROUP BY entity_id, run HAVING count(*) >= 2""", BASE, TRAIN, KNOWN)


def spoofing(spark, sf_dir):
    log = access_log(spark, sf_dir)
    return tidy(ru.device_spoofing(log, fitted(log)))


SPOOFING = sql("""SELECT b.event_id, b.entity_id, b.device_fingerprint,
  CASE WHEN split_part(b.device_fingerprint, '|', 1) NOT IN (SELECT split_part(device_fingerprint, '|', 1) FROM train) THEN 1 ELSE 0 END AS new_os,
  CASE WHEN split_part(b.device_fingerprint, '|', 3) NOT IN (SELECT split_part(device_fingerprint, '|', 3) FROM train) THEN 1 ELSE 0 END
    AS new_protocol
  FROM base b ANTI JOIN known k ON k.entity_id = b.entity_id AND k.kind = 'device' AND k.value = b.device_fingerprint""", BASE, TRAIN, KNOWN)


def slow(spark, sf_dir):
    return tidy(ru.low_and_slow(access_log(spark, sf_dir), 2))


SLOW = sql(f"""SELECT entity_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days, CAST(sum(n) AS BIGINT) AS events FROM (
  SELECT entity_id, day, n, day - row_number() OVER (PARTITION BY entity_id ORDER BY day) AS island FROM (
    SELECT entity_id, us // {DAY} AS day, count(*) AS n FROM base
    WHERE resource_accessed LIKE 'file://%' AND hour(ts) BETWEEN 0 AND 4 GROUP BY 1, 2)) GROUP BY entity_id, island HAVING count(*) >= 2""", BASE)


def drift(spark, sf_dir):
    log = access_log(spark, sf_dir)
    early = log.filter(F.col("timestamp") < F.lit("2024-01-08").cast("timestamp"))
    return tidy(ru.insider_drift(log, bl.fit_baseline(early), 2))


DRIFT = sql(f"""SELECT entity_id, start_us, end_us, weeks, CAST(resources AS BIGINT) AS resources FROM (
  SELECT entity_id, end_us, min(start_us) OVER w AS start_us, count(*) OVER w AS weeks, sum(n) OVER w AS resources FROM (
    SELECT entity_id, first_us // {7 * DAY} AS week, count(*) AS n, min(first_us) AS start_us, max(first_us) AS end_us FROM (
      SELECT b.entity_id, b.resource_accessed, min(us) AS first_us FROM base b
      ANTI JOIN (SELECT * FROM base WHERE ts < TIMESTAMP '2024-01-08') k
        ON k.entity_id = b.entity_id AND k.resource_accessed = b.resource_accessed GROUP BY 1, 2) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY entity_id ORDER BY week RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE weeks >= 2""", BASE)


def alert_table(spark, sf_dir):
    """Scores travel with the log, so the alert rows are a projection."""
    log = scored_log(spark, sf_dir)
    found = ["label", "pred_label", "risk_score"]
    rows = ft.build_features(log, stored(log), ["event_id", "entity_id", "timestamp", *found])
    rows = rows.withColumnsRenamed({"label": "true_label", "pred_label": "predicted_attack_type"})
    told = ex.explain_by_importance(rows, ["geo_velocity_kmh", "access_freq_24hr", "time_since_last_access_sec"])
    return tidy(al.build_alerts(told).drop("timestamp"), **KILOMETRES)


ALERT_TABLE = sql(f"""SELECT event_id, entity_id, label AS true_label, risk_score, pred_label AS predicted_attack_type,
  'Flagged due to: impossible geo-velocity (' || format('{{:.0f}}', geo_velocity_kmh) || ' km/h between consecutive logins); elevated 24-hour access volume ('
  || format('{{:.0f}}', access_freq_24hr) || ' events); unusually ' || CASE WHEN time_since_last_access_sec < 10 THEN 'short' ELSE 'long' END
  || ' time since last access (' || format('{{:.0f}}', time_since_last_access_sec) || 's)' AS top_reason,
  {rounded(FEATURES, **KILOMETRES)} FROM feature JOIN (SELECT event_id, label, pred_label, risk_score FROM access_log) USING (event_id)""",
  *FEATURE_PARTS, scores=True)


def projection(spark, sf_dir):
    rows = labelled_features(spark, sf_dir)
    return tidy(rows.select("event_id", "label", *FEATURES), **KILOMETRES)


PROJECTION = sql(f"""SELECT event_id, label, {rounded(FEATURES, **KILOMETRES)} FROM feature
  JOIN (SELECT event_id, label FROM access_log) USING (event_id)""", *FEATURE_PARTS, scores=True)


def top_values(spark, sf_dir):
    return tidy(al.top_values(feature_rows(spark, sf_dir)), 3)


_UNPIVOT = " UNION ALL ".join(f"SELECT event_id, {i} AS place, '{n}' AS feature, {n} AS value FROM feature" for i, n in enumerate(FEATURES))
TOP_VALUES = sql(f"""SELECT event_id, rank, feature, round(value, 3) + 0.0 AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, place) AS rank FROM ({_UNPIVOT}) WHERE abs(value) > 0.01)
  WHERE rank <= 10""", *FEATURE_PARTS)


def scaler(spark, sf_dir):
    rows = pr.normal_rows(small_features(spark, sf_dir))
    found = mo.fit_scaler(rows, SMALL)
    return tidy(found.select(*[F.get(a, F.lit(i)).alias(f"{a}_{n}") for a in ("mean", "std") for i, n in enumerate(SMALL)]))


SCALER = sql("SELECT " + ", ".join([f"round(avg({n}), 6) + 0.0 AS mean_{n}" for n in SMALL]
  + [f"round(stddev_pop({n}), 6) + 0.0 AS std_{n}" for n in SMALL]) + " FROM small WHERE label = 'normal'", SMALL_TABLE, scores=True)


def _class_weights(rows):
    """Weights of a diagonal linear scorer: distance of the class mean in units of variance."""
    whole = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in SMALL], *[F.var_pop(n).alias(f"v_{n}") for n in SMALL]).first()
    weights = F.array(*[(F.avg(n) - whole[f"m_{n}"]) / whole[f"v_{n}"] for n in SMALL])
    return rows.groupBy("label").agg(weights.alias("weights")), F.array(*[F.lit(whole[f"m_{n}"]) for n in SMALL])


def linear_attribution(spark, sf_dir):
    rows = small_features(spark, sf_dir)
    weights, means = _class_weights(rows)
    found = ex.linear_contributions(rows.drop("label"), weights, means, SMALL)
    return tidy(found.select("event_id", *[F.get("contributions", F.lit(i)).alias(f"c_{n}") for i, n in enumerate(SMALL)]))


WEIGHTS = "whole AS (SELECT " + ", ".join(f"avg({n}) AS m_{n}, var_pop({n}) AS v_{n}" for n in SMALL) + " FROM small),\nweights AS (SELECT label AS cls, " + ", ".join(
    f"(avg({n}) - max(m_{n})) / max(v_{n}) AS w_{n}" for n in SMALL) + " FROM small CROSS JOIN whole GROUP BY label)"
ATTRIBUTION = sql("SELECT event_id, " + ", ".join(f"round(w_{n} * ({n} - m_{n}), 6) + 0.0 AS c_{n}" for n in SMALL)
  + " FROM small JOIN weights ON cls = pred_label CROSS JOIN whole", SMALL_TABLE, WEIGHTS, scores=True)


def reasons(spark, sf_dir):
    """Reasons from linear contributions of three features that have texts."""
    rows = small_features(spark, sf_dir)
    weights, means = _class_weights(rows)
    found = ex.linear_contributions(rows.drop("label"), weights, means, SMALL)
    names = ["hour_of_day", "session_duration_raw", "resource_breadth"]
    named = found.withColumnsRenamed(dict(zip(SMALL[1:], names[1:])))
    return tidy(ex.top_reasons(named, 2, names).select("event_id", "top_features", "top_reason"))


_TEXT = {
    "hour_of_day": "'access at unusual hour (' || format('{:.0f}', value) || ':00)'",
    "session_duration_raw": "'session duration of ' || format('{:.0f}', value) || ' seconds'",
    "resource_breadth": "'unusual breadth of resources accessed (' || format('{:.0f}', value) || ' distinct resources)'",
}
_PARTS = " UNION ALL ".join(
    f"SELECT event_id, {i} AS place, '{name}' AS name, CAST({n} AS DOUBLE) AS value, w_{n} * ({n} - m_{n}) AS c FROM small JOIN weights ON cls = pred_label CROSS JOIN whole"
    for i, (n, name) in enumerate(zip(SMALL, _TEXT)))
REASONS = sql(f"""SELECT event_id, string_agg(name, ',' ORDER BY r) AS top_features, 'Flagged due to: ' || string_agg(
  CASE name {' '.join(f"WHEN '{n}' THEN {t}" for n, t in _TEXT.items())} END, '; ' ORDER BY r) AS top_reason
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(c) DESC, place) AS r FROM ({_PARTS})) WHERE r <= 2 GROUP BY event_id""",
  SMALL_TABLE, WEIGHTS, scores=True)


def fallback_reasons(spark, sf_dir):
    log = ft.calendar(access_log(spark, sf_dir))
    rows = ex.explain_by_importance(log, names=FEATURES[:4])
    return tidy(rows.select("event_id", "top_features", "top_reason"))


FALLBACK = sql("""SELECT event_id, 'hour_of_day,day_of_week,is_weekend' AS top_features, 'Flagged due to: access at unusual hour (' ||
  CAST(hour(ts) AS VARCHAR) || ':00); access on unusual day of week; access occurred on weekend' AS top_reason FROM access_log""")


# The same operators over all 26 features.


def full_features(spark, sf_dir):
    """All features with labels, which travel with the log."""
    log = scored_log(spark, sf_dir)
    return ft.build_features(log, stored(log), [*ft.IDS, "label", "pred_label"])


TOLD = """told AS MATERIALIZED (SELECT f.*, l.label, l.pred_label FROM feature f JOIN (SELECT event_id, label, pred_label FROM access_log) l USING (event_id))"""
FULL_PARTS = [*FEATURE_PARTS, TOLD]


def full_stats(spark, sf_dir):
    means = pr.entity_means(full_features(spark, sf_dir))
    flat = [F.get(a, F.lit(i)).alias(f"{a}_{n}") for a in ("mean", "std") for i, n in enumerate(FEATURES)]
    return tidy(means.select("entity_id", "events", *flat), 3)


FULL_STATS = sql("SELECT entity_id, count(*) AS events, " + ", ".join(
    [f"round(avg({n}), 3) + 0.0 AS mean_{n}" for n in FEATURES] + [f"round(stddev_samp({n}), 3) + 0.0 AS std_{n}" for n in FEATURES]
) + " FROM feature GROUP BY entity_id", *FEATURE_PARTS)


def full_covariances(spark, sf_dir):
    """Per entity the covariances of every feature with the next, and all variances."""
    rows = full_features(spark, sf_dir)
    found = pr.entity_covariance(rows, pr.entity_means(rows))
    cells = [F.get(F.get("covariance", F.lit(i)), F.lit(j)).alias(f"c_{i}_{j}") for i in range(26) for j in (i, (i + 1) % 26)]
    return tidy(found.select("entity_id", *cells), 1)


FULL_COVARIANCES = sql("SELECT entity_id, " + ", ".join(
    f"round(covar_samp({FEATURES[i]}, {FEATURES[j]}), 1) + 0.0 AS c_{i}_{j}" for i in range(26) for j in (i, (i + 1) % 26)
) + " FROM feature GROUP BY entity_id", *FEATURE_PARTS)


def full_scaler(spark, sf_dir):
    found = mo.fit_scaler(pr.normal_rows(full_features(spark, sf_dir)))
    return tidy(found.select(*[F.get(a, F.lit(i)).alias(f"{a}_{n}") for a in ("mean", "std") for i, n in enumerate(FEATURES)]), 3)


FULL_SCALER = sql("SELECT " + ", ".join([f"round(avg({n}), 3) + 0.0 AS mean_{n}" for n in FEATURES]
  + [f"round(CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1.0 END, 3) + 0.0 AS std_{n}" for n in FEATURES])
  + " FROM told WHERE label = 'normal'", *FULL_PARTS, scores=True)


def full_sequences(spark, sf_dir):
    """Padded sequences of all features, folded to position-weighted sums."""
    rows = mo.build_sequences(full_features(spark, sf_dir), pad=True)

    def folded(place):
        weighted = F.transform("sequence", lambda event, i: F.get(event, F.lit(place)) * (i + 1))
        return F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x)

    return tidy(rows.select("event_id", "event_number", *[folded(i).alias(n) for i, n in enumerate(FEATURES)]), 2)


FULL_SEQUENCES = sql("SELECT a.event_id, a.rn AS event_number, " + ", ".join(f"round(sum(b.{n} * p.pos), 2) + 0.0 AS {n}" for n in FEATURES)
  + """ FROM numbered a CROSS JOIN range(1, 11) AS p(pos) JOIN numbered b ON b.entity_id = a.entity_id AND b.rn = greatest(a.rn - 10 + p.pos, 1)
  GROUP BY a.event_id, a.rn""", *FEATURE_PARTS, f"numbered AS MATERIALIZED (SELECT *, row_number() OVER {ORDER} AS rn FROM feature)")


def full_cohorts(spark, sf_dir):
    found = pr.fit_cohorts(full_features(spark, sf_dir))
    flat = [F.get("cohort_mean", F.lit(i)).alias(f"mean_{n}") for i, n in enumerate(FEATURES)]
    return tidy(found.select(F.coalesce("entity_type", F.lit("*")).alias("entity_type"), *flat), 3)


FULL_COHORTS = sql("SELECT coalesce(entity_type, '*') AS entity_type, " + ", ".join(f"round(avg({n}), 3) + 0.0 AS mean_{n}" for n in FEATURES)
  + " FROM feature GROUP BY GROUPING SETS ((entity_type), ())", *FEATURE_PARTS)


MERGED = ["hour_of_day", "session_duration_raw", "access_freq_24hr"]


def merged_profiles(spark, sf_dir):
    """Means and covariances of entities from three parts in time, each summed up by itself and then merged."""
    rows = materialize(feature_rows(spark, sf_dir), "features")
    day = F.to_date("timestamp")
    spans = (day < "2024-01-10", (day >= "2024-01-10") & (day < "2024-01-29"), day >= "2024-01-29")
    parts = [pr.entity_moments(rows.filter(span), MERGED) for span in spans]
    merged = pr.merge_moments(pr.merge_moments(*parts[:2]), parts[2])
    product = lambda i, j: F.get(F.get("products", F.lit(i)), F.lit(j)) / F.when(F.col("events") > 1, F.col("events") - 1)
    means = [F.get("mean", F.lit(i)).alias(f"mean_{n}") for i, n in enumerate(MERGED)]
    spreads = [product(i, i).alias(f"var_{n}") for i, n in enumerate(MERGED)]
    return tidy(merged.select("entity_id", "events", *means, *spreads, product(0, 1).alias("cov_hour_duration")), 4)


MERGED_PROFILES = sql("SELECT entity_id, count(*) AS events, " + ", ".join(
    f"round(avg({n}), 4) + 0.0 AS mean_{n}, round(var_samp({n}), 4) + 0.0 AS var_{n}" for n in MERGED)
  + f", round(covar_samp({MERGED[0]}, {MERGED[1]}), 4) + 0.0 AS cov_hour_duration FROM feature GROUP BY 1", *FEATURE_PARTS)


QUERIES = {
    "a4_a5_merged_profiles": (merged_profiles, MERGED_PROFILES),
    "a4_entity_stats_full": (full_stats, FULL_STATS),
    "a5_covariance_full": (full_covariances, FULL_COVARIANCES),
    "a6_cohorts_full": (full_cohorts, FULL_COHORTS),
    "a16_scaler_full": (full_scaler, FULL_SCALER),
    "w9_padded_sequences_full": (full_sequences, FULL_SEQUENCES),
    "m1_features": (features, FEATURES_SQL),
    "m1_features_split": (lambda s, d: features(s, d, SPLIT), FEATURES_SQL),
    "p7_j1_labelled_features": (projection, PROJECTION),
    "p14_alert_table": (alert_table, ALERT_TABLE),
    "f6_command_novelty": (
        command_novelty,
        sql("SELECT event_id, round(coalesce(ratio, 0.0), 6) + 0.0 AS command_seq_novelty FROM base LEFT JOIN command_novelty USING (event_id)",
            BASE, TRAIN, KNOWN, COMMAND),
    ),
    "w1_w3_movement": (movement, MOVEMENT),
    "w1_w3_movement_split": (lambda s, d: movement(s, d, SPLIT), MOVEMENT),
    "w2_w4_rolling_counts": (rolling, ROLLING_SQL),
    "w2_w4_rolling_counts_split": (lambda s, d: rolling(s, d, SPLIT), ROLLING_SQL),
    "w5_w6_variety": (variety, VARIETY_SQL),
    "w5_w6_variety_split": (lambda s, d: variety(s, d, SPLIT), VARIETY_SQL),
    "w7_duration_zscore": (
        duration_zscore,
        sql(f"SELECT event_id, round({ZSCORE}, 6) + 0.0 AS session_duration_zscore FROM base LEFT JOIN spread USING (entity_id)", BASE, SPREAD),
    ),
    "w7_fitted_zscore": (
        fitted_zscore,
        sql(f"SELECT event_id, round({ZSCORE}, 6) + 0.0 AS session_duration_zscore FROM base LEFT JOIN spread USING (entity_id)",
            BASE, TRAIN, SPREAD.replace("FROM base", "FROM train")),
    ),
    "w8_sequences": (sequence_sums, _sequence_sql(False)),
    "w9_padded_sequences": (lambda s, d: sequence_sums(s, d, True), _sequence_sql(True)),
    "w9_padded_sequences_split": (lambda s, d: sequence_sums(s, d, True, SPLIT), _sequence_sql(True)),
    "w10_age": (ages, AGES),
    "w12_time_split": (
        time_split,
        sql("""SELECT event_id, CASE WHEN ts >= (SELECT ts FROM access_log ORDER BY ts, event_id
  LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM access_log)) THEN 1 ELSE 0 END AS is_test FROM access_log"""),
    ),
    "w13_event_number": (numbers, NUMBERS),
    "w13_event_number_split": (lambda s, d: numbers(s, d, SPLIT), NUMBERS),
    "a1_known_values": (known, sql("SELECT entity_id, kind, value FROM known", BASE, TRAIN, KNOWN)),
    "a1_known_counts": (known_counts, sql("SELECT entity_id, kind, count(*) AS n FROM known GROUP BY entity_id, kind", BASE, TRAIN, KNOWN)),
    "a2_usual_places": (
        homes,
        sql("SELECT entity_id, hlat AS home_lat, hlon AS home_lon, hauth AS home_auth FROM home_geo FULL JOIN home_auth USING (entity_id)",
            BASE, TRAIN, HOMES),
    ),
    "a3_global_devices": (devices, sql("SELECT DISTINCT device_fingerprint AS value FROM train", BASE, TRAIN)),
    "a4_entity_stats": (entity_stats, STATS_SQL),
    "a5_covariance": (covariances, COVARIANCES),
    "a6_cohorts": (cohorts, COHORTS),
    "a16_scaler": (scaler, SCALER),
    "j2_home_distance": (
        home_distance,
        sql(f"""SELECT event_id, round({AWAY}, 3) + 0.0 AS geo_distance_km, CASE WHEN auth_method <> hauth THEN 1 ELSE 0 END AS auth_method_changed
  FROM base LEFT JOIN home_geo USING (entity_id) LEFT JOIN home_auth USING (entity_id)""", BASE, TRAIN, HOMES),
    ),
    "j3_j4_unseen": (
        unseen,
        sql("""SELECT event_id, resource AS resource_novelty_score, device AS fingerprint_mismatch, anywhere AS new_device_flag
  FROM novel""", BASE, TRAIN, KNOWN, NOVEL),
    ),
    "j5_m2_profile_score": (profile_scores, sql("SELECT event_id, round(profile_score, 5) + 0.0 AS profile_score FROM profile", SMALL_TABLE, PROFILE, scores=True)),
    "j6_cohort_fallback": (cohort_lookup, COHORT_LOOKUP),
    "j9_distant_places": (distant_places, DISTANT),
    "j10_unused_resources": (unused_resources, UNUSED),
    "u2_extended_baseline": (extended, sql("SELECT entity_id, kind, value FROM known", BASE, "train AS (SELECT * FROM base)", KNOWN)),
    "u3_untypical_resources": (untypical, UNTYPICAL),
    "m4_combined_score": (
        combined_scores,
        sql("""SELECT event_id, round(0.5 * (1 - exp(-k_value / 10)) + 0.5 * profile_score, 5) + 0.0 AS baseline_score
  FROM small JOIN profile USING (event_id)""", SMALL_TABLE, PROFILE, scores=True),
    ),
    "m5_m6_cold_start": (cold_start, COLD_START),
    "o5_top_values": (top_values, TOP_VALUES),
    "x1_linear_attribution": (linear_attribution, ATTRIBUTION),
    "x2_o4_reasons": (reasons, REASONS),
    "x3_fallback_reasons": (fallback_reasons, FALLBACK),
    "r1_brute_force": (brute_force, BRUTE),
    "r1_brute_force_split": (lambda s, d: brute_force(s, d, 2), BRUTE),
    "r2_impossible_travel": (travel, TRAVEL),
    "r3_credential_stuffing": (stuffing, STUFFING),
    "r3_stuffing_sliding": (stuffing_sliding, STUFFING_SLIDING),
    "r3_stuffing_sliding_split": (lambda s, d: stuffing_sliding(s, d, 20), STUFFING_SLIDING),
    "r4_lateral_movement": (lateral, LATERAL),
    "r5_device_spoofing": (spoofing, SPOOFING),
    "r6_low_and_slow": (slow, SLOW),
    "r7_insider_drift": (drift, DRIFT),
    "o2_fastest_moves": (fastest_moves, FASTEST),
}
