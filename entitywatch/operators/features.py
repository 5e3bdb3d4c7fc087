"""The 26 behavioural features of an access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import functions as fn
from ..fixed import AUTH_METHODS, DAY, ENTITY_TYPES, FEATURES, HOUR, MINUTE, SECOND, WEEK
from . import baseline as bl
from .windows import HOT_ROWS, attach, sized, sweep

FREQUENCIES = {
    "access_freq_5min": 5 * MINUTE,
    "access_freq_1hr": HOUR,
    "access_freq_24hr": DAY,
    "access_freq_7d": WEEK,
}
FAILURES = {"failed_auth_count_5min": 5 * MINUTE, "failed_auth_count_1hr": HOUR}
IDS = ["event_id", "entity_id", "entity_type", "timestamp"]


def calendar(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "hour_of_day": F.hour("timestamp"),
            "day_of_week": fn.day_of_week("timestamp"),
            "is_weekend": fn.is_weekend("timestamp"),
            "is_off_hours": fn.is_off_hours("timestamp"),
        }
    )


def encodings(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "entity_type_encoded": fn.encode("entity_type", ENTITY_TYPES),
            "auth_method_encoded": fn.encode("auth_method", AUTH_METHODS),
        }
    )


def with_position(log: DataFrame) -> DataFrame:
    geo = fn.parse_geo("geo_location")
    return log.withColumns({"lat": geo["lat"], "lon": geo["lon"]})


def _lags() -> dict[str, Column]:
    return {"previous_us": F.unix_micros("timestamp"), "previous_lat": F.col("lat"), "previous_lon": F.col("lon")}


def _movement(rows: DataFrame) -> DataFrame:
    waited = (F.unix_micros("timestamp") - F.col("previous_us")) / F.lit(float(SECOND))
    return (
        rows.withColumn("time_since_last_access_sec", F.coalesce(waited, F.lit(0.0)))
        .withColumn("moved_km", fn.haversine_km("previous_lat", "previous_lon", "lat", "lon"))
        .withColumn("geo_velocity_kmh", fn.velocity_kmh("moved_km", "time_since_last_access_sec"))
    )


def movement(log: DataFrame, limit: int | None = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Time, distance and speed since the previous event of the entity."""
    return _movement(sweep(with_position(log), lags=_lags(), limit=limit, hot=hot))


def _rolling() -> dict[str, tuple[str | None, int]]:
    return {
        **{name: (None, width) for name, width in FREQUENCIES.items()},
        **{name: ("failed", width) for name, width in FAILURES.items()},
    }


def with_failed(log: DataFrame) -> DataFrame:
    return log.withColumn("failed", fn.is_failed("session_duration"))


VARIETY = [
    ("resource_breadth", "resource_entropy", "resource_accessed", DAY),
    ("geo_breadth", "geo_entropy", "geo_location", DAY),
]


def rolling_counts(log: DataFrame, limit: int | None = HOT_ROWS) -> DataFrame:
    return sweep(with_failed(log), sums=_rolling(), limit=limit)


def variety(log: DataFrame, limit: int | None = HOT_ROWS) -> DataFrame:
    """Distinct count and entropy of resources and places over the last 24 hours."""
    return sweep(log, mixes=VARIETY, limit=limit)


def home_distance(log: DataFrame, baseline: bl.Baseline) -> DataFrame:
    """Distance from the usual place and departure from the usual auth method."""
    away = fn.haversine_km("home_lat", "home_lon", "lat", "lon")
    changed = F.coalesce((F.col("auth_method") != F.col("home_auth")).cast("int"), F.lit(0))
    joined = log.join(baseline.homes, "entity_id", "left")
    return joined.withColumns({"geo_distance_km": away, "auth_method_changed": changed}).drop(
        "home_lat", "home_lon", "home_auth"
    )


def duration_zscore(log: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Z-score against the entity's own durations, of this log or of a fitted table."""
    spread = bl.duration_spread(log) if spread is None else spread
    score = fn.zscore("session_duration", "duration_mean", "duration_std")
    return log.join(spread, "entity_id", "left").withColumns(
        {
            "session_duration_zscore": score,
            "session_duration_raw": F.coalesce("session_duration", F.lit(0.0)),
        }
    ).drop("duration_mean", "duration_std")


def clean(rows: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Null, NaN and infinite values become 0; everything becomes a double."""
    types = dict(rows.dtypes)

    def finite(name: str) -> Column:
        if types[name] not in ("double", "float"):
            return F.expr(f"coalesce(cast({name} as double), 0.0D)")
        return F.expr(f"if(abs({name}) < double('infinity'), cast({name} as double), 0.0D)")

    return rows.withColumns({name: finite(name) for name in names})


def missing_counts(rows: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Missing values per feature, in one row."""
    return rows.agg(
        *[F.sum((F.col(n).isNull() | F.isnan(F.col(n).cast("double"))).cast("bigint")).alias(n) for n in names]
    )


def build_features(
    log: DataFrame,
    baseline: bl.Baseline,
    keep: list[str] = IDS,
    limit: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """All features per event, in vector order after the `keep` columns.

    The log is read up to three times, and once more to cut busy entities: for busy entities and the number of tasks (unless `hot` or `tasks`, the results of
    `sized`, are given), for the distinct devices and commands, and for the rows. Ordinary entities need one wide shuffle, by entity: lookups, spreads and all windows work on rows
    that lie together. Hot entities are cut into time chunks, and their lookups are plain joins that adaptive execution
    splits. A stored baseline (`store_baseline`) isn't computed again.
    """
    keep = [c for c in keep if c in log.columns]
    fields = [
        "entity_type",
        "geo_location",
        "resource_accessed",
        "auth_method",
        "session_duration",
        "command_sequence",
        "device_fingerprint",
    ]
    if hot is None and tasks is None and limit is not None:
        hot, tasks = sized(log, "entity_id", limit=limit)
    rows = with_failed(with_position(log.select(*dict.fromkeys([*IDS[:2], "timestamp", *keep, *fields]))))
    looked = bl.lookups(log, baseline)
    wanted = dict(sums=_rolling(), mixes=VARIETY, lags=_lags(), limit=None, tasks=tasks)

    def together(part: DataFrame, table: DataFrame) -> DataFrame:
        own = Window.partitionBy("entity_id")
        found = attach(part, table, bl.LOOKED_UP, tasks=tasks).withColumns(
            {
                "duration_mean": F.avg("session_duration").over(own),
                "duration_std": F.stddev_samp("session_duration").over(own),
            }
        )
        found = _without_history(found.join(baseline.homes, "entity_id", "left"))
        return sweep(found, **wanted, arranged=True, keep=kept)

    def joined(part: DataFrame, table: DataFrame) -> DataFrame:
        found = sweep(part, **wanted, hot=hot, only_hot=True).join(baseline.homes, "entity_id", "left")
        found = found.join(bl.duration_spread(part), "entity_id", "left")
        for column, names in bl.LOOKED_UP.items():
            values = table.filter(F.col(column).isNotNull()).select("entity_id", column, *names)
            found = found.join(values, ["entity_id", column], "left")
        return _without_history(found)

    kept = [*dict.fromkeys([*keep, "timestamp", "lat", "lon"]), *WITHOUT_HISTORY]
    if hot is None:
        found = together(rows, looked)
    else:
        busy = F.broadcast(hot.select("entity_id"))
        cold = together(rows.join(busy, "entity_id", "left_anti"), looked.join(busy, "entity_id", "left_anti"))
        split = joined(rows.join(busy, "entity_id", "left_semi"), looked.join(busy, "entity_id", "left_semi"))
        found = cold.unionByName(split, allowMissingColumns=True)
    return clean(_movement(found)).select(*keep, *FEATURES)


WITHOUT_HISTORY = [
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_off_hours",
    "geo_distance_km",
    "resource_novelty_score",
    "auth_method_changed",
    "session_duration_zscore",
    "session_duration_raw",
    "fingerprint_mismatch",
    "new_device_flag",
    "command_seq_length",
    "command_seq_novelty",
    "entity_type_encoded",
    "auth_method_encoded",
]


def _without_history(rows: DataFrame) -> DataFrame:
    """The features that follow from the event and its lookups alone."""
    return encodings(calendar(rows)).withColumns(
        {
            "geo_distance_km": fn.haversine_km("home_lat", "home_lon", "lat", "lon"),
            "auth_method_changed": F.col("auth_method") != F.col("home_auth"),
            "session_duration_zscore": fn.zscore("session_duration", "duration_mean", "duration_std"),
            "session_duration_raw": F.col("session_duration"),
            "command_seq_length": fn.command_count("command_sequence"),
            "resource_novelty_score": F.col("known").isNull() & F.col("resource_accessed").isNotNull(),
        }
    )


def feature_array(names: list[str] = FEATURES) -> Column:
    return F.array(*[F.col(n) for n in names])
