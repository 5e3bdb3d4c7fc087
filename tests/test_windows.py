"""Windows on small logs, and agreement of cut and uncut keys with brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entitywatch.fixed import DAY, HOUR, MINUTE, SECOND, WEEK
from entitywatch.operators import features as ft
from entitywatch.operators import windows as wd


def test_ties_see_each_other(make_log, column):
    log = make_log(
        {"at": 0, "entity_id": "a"}, {"at": 300, "entity_id": "a"}, {"at": 300, "entity_id": "a"},
        {"at": 360, "entity_id": "a"}, {"at": 0, "entity_id": "b"}, {"at": 60, "entity_id": "b"},
    )
    assert column(ft.rolling_counts(log), "access_freq_5min") == [1, 2, 2, 3, 1, 2]


@pytest.mark.parametrize("name,width", ft.FREQUENCIES.items())
def test_left_bound_is_open(make_log, column, name, width):
    edge = width / SECOND
    log = make_log({"at": 0}, {"at": edge - 1, "event_id": 1}, {"at": edge, "event_id": 2})
    assert column(ft.rolling_counts(log), name) == [1, 2, 2]


def test_failures_are_short_sessions(make_log, column):
    log = make_log({"at": 0, "duration": 1.9}, {"at": 10, "duration": 2.0}, {"at": 20, "duration": None},
                   {"at": 400, "duration": 0.5})
    rows = ft.rolling_counts(log)
    assert column(rows, "failed_auth_count_5min", "failed_auth_count_1hr") == [(1, 1), (1, 1), (1, 1), (1, 2)]


def test_movement_with_missing_and_equal_times(make_log, column):
    london, tokyo = "London|51.5074|-0.1278", "Tokyo|35.6762|139.6503"
    log = make_log(
        {"at": 0, "geo": london}, {"at": 3600, "geo": tokyo}, {"at": 3600, "geo": london}, {"at": 7200, "geo": None},
        {"at": 9000, "geo": "Tokyo|x|y"}, {"at": 9600, "geo": tokyo},
    )
    rows = column(ft.movement(log), "time_since_last_access_sec", "moved_km", "geo_velocity_kmh")
    assert rows[0] == (0.0, 0.0, 0.0)
    assert rows[1][0] == 3600.0 and rows[1][1] == pytest.approx(9558.6, abs=1.0) and rows[1][2] == pytest.approx(rows[1][1])
    assert rows[2][0] == 0.0 and rows[2][1] > 9000 and rows[2][2] == 0.0
    assert [r[1] for r in rows[3:]] == [0.0, 0.0, 0.0]


def _random_log(make_log, seed, events=160):
    chance = random.Random(seed)
    rows, at = [], 0
    for i in range(events):
        at += chance.choice([0, 0, 1, 30, 299, 300, 1800, 3600, 7000, 40000, 86400])
        rows.append({
            "at": at, "event_id": i, "entity_id": chance.choice(["hot", "hot", "hot", "cold"]),
            "duration": chance.choice([0.5, 1.9, 2.0, 50.0, None]), "resource": chance.choice(["r1", "r2", "r3", "r4", None]),
            "geo": chance.choice(["A|1|2", "B|50|60", "C|0|-100", None]),
        })
    return rows, make_log(*rows)


def _trailing(rows, row, seconds):
    return [r for r in rows if r["entity_id"] == row["entity_id"] and row["at"] - seconds < r["at"] <= row["at"]]


def _entropy(values):
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    return -sum(n / total * math.log(n / total) for n in counts.values()) if counts else 0.0


@pytest.mark.parametrize("limit", [None, 3, 20, 1000])
@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_equals_brute_force(make_log, column, limit, seed):
    rows, log = _random_log(make_log, seed)
    rolling = column(ft.rolling_counts(log, limit), *ft.FREQUENCIES, *ft.FAILURES)
    variety = column(ft.variety(log, limit), "resource_breadth", "resource_entropy", "geo_breadth", "geo_entropy")
    for row, counts, mixes in zip(rows, rolling, variety):
        expected = [len(_trailing(rows, row, w // SECOND)) for w in (5 * MINUTE, HOUR, DAY, WEEK)]
        for w in (5 * MINUTE, HOUR):
            expected.append(sum((r["duration"] or 9) < 2.0 for r in _trailing(rows, row, w // SECOND)))
        assert list(counts) == expected
        day = _trailing(rows, row, DAY // SECOND)
        for field, breadth, entropy in (("resource", mixes[0], mixes[1]), ("geo", mixes[2], mixes[3])):
            values = [r[field] for r in day]
            assert breadth == len({v for v in values if v is not None})
            assert entropy == pytest.approx(_entropy(values), abs=1e-8)


@pytest.mark.parametrize("limit", [None, 4])
def test_lags_numbers_and_sequences(make_log, column, limit):
    rows, log = _random_log(make_log, 3, 80)
    lagged = column(
        wd.sweep(log, lags={"before": F.col("event_id")}, number="n", limit=limit), "before", "n"
    )
    sequences = column(wd.trailing(log, F.col("event_id"), 4, limit=limit), "sequence", "event_number")
    for row, (before, n), (sequence, number) in zip(rows, lagged, sequences):
        own = [r["event_id"] for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])) if r["entity_id"] == row["entity_id"]]
        spot = own.index(row["event_id"])
        assert n == number == spot + 1
        assert before == (own[spot - 1] if spot else None)
        assert sequence == own[max(0, spot - 3) : spot + 1]


@pytest.mark.parametrize("limit", [None, 3])
def test_sessions_equal_brute_force(make_log, limit):
    rows, log = _random_log(make_log, 4)
    found = wd.sessions(log, 1800 * SECOND, limit=limit)
    expected = []
    for entity in ("hot", "cold"):
        times = sorted(r["at"] for r in rows if r["entity_id"] == entity)
        run = [times[0]]
        for at in times[1:]:
            if at - run[-1] > 1800:
                expected.append((entity, run[-1] - run[0], len(run)))
                run = []
            run.append(at)
        expected.append((entity, run[-1] - run[0], len(run)))
    got = [(r.entity_id, (r.end_us - r.start_us) // SECOND, r.events) for r in found.collect()]
    assert sorted(got) == sorted(expected)


def test_hot_keys_are_counted(make_log):
    log = make_log(*[{"at": i} for i in range(30)], {"at": 5, "entity_id": "usr_2", "event_id": 99})
    hot = wd.hot_keys(log, limit=10).collect()
    assert [(r.entity_id, r._width) for r in hot] == [("usr_1", HOUR * 10 // 30)]
    assert wd.hot_keys(log, limit=30) is None


def test_rows_of_a_task_are_bounded(make_log, monkeypatch):
    """The windows' tasks grow in number with the rows, not in size."""
    monkeypatch.setattr(wd, "TASK_ROWS", 10)
    log = make_log(*[{"at": i, "event_id": i, "entity_id": f"usr_{i % 50}"} for i in range(200)])
    assert wd.sized(log) == (None, 20)
    for rows in (wd.sweep(log, number="n"), wd.sweep(log, sums={"n": (None, 60)}), wd.trailing(log, F.col("event_id"), 3), wd.sessions(log, 60)):
        assert rows.rdd.getNumPartitions() == 20


def test_scattered_rows_of_a_hot_key_get_wide_chunks(make_log):
    log = make_log(*[{"at": 36000 * i, "entity_id": "usr_1"} for i in range(80)])
    width = wd.hot_keys(log, limit=20).first()._width
    sizes = Counter(36000 * i * SECOND // width for i in range(80))
    assert max(sizes.values()) <= 20 and len(sizes) <= 8  # 10 hours, the busiest hour at full length, would make 40


def test_chunks_hold_less_than_a_task(make_log, monkeypatch):
    monkeypatch.setattr(wd, "CHUNK_ROWS", 5)
    log = make_log(*[{"at": 3600 * i, "entity_id": "usr_1"} for i in range(40)])
    assert wd.hot_keys(log, limit=30).first()._width <= 5 * HOUR


def test_many_hot_keys_are_stored(make_log, column, monkeypatch):
    rows, log = _random_log(make_log, 3)
    names = [*ft.FREQUENCIES, *ft.FAILURES]
    expected = column(ft.rolling_counts(log, None), *names)
    monkeypatch.setattr(wd, "COLLECTED_KEYS", 0)
    assert wd.hot_keys(log, limit=3).inputFiles()
    assert column(ft.rolling_counts(log, 3), *names) == expected
