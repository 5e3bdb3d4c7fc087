"""Each rule at its limit and just below it."""

import pytest

from entitywatch.operators import baseline as bl
from entitywatch.operators import rules as ru

DAY = 86400


@pytest.mark.parametrize("limit", [None, 3])
def test_brute_force(make_log, limit):
    tries = [{"at": 10 * i, "duration": 0.5} for i in range(10)]
    assert [r.events for r in ru.brute_force(make_log(*tries), limit=limit).collect()] == [10]
    assert ru.brute_force(make_log(*tries[:9]), limit=limit).count() == 0
    late = [*tries[:5], *[{**t, "at": t["at"] + 1} for t in tries[5:]]]
    assert ru.brute_force(make_log(*late), limit=limit).count() == 0
    other = [{**t, "auth": "token"} for t in tries]
    assert ru.brute_force(make_log(*other), limit=limit).count() == 0


def test_impossible_travel(make_log):
    first = {"geo": "London|51.5074|-0.1278"}
    far, near = "Tokyo|35.6762|139.6503", "Paris|48.8566|2.3522"
    assert ru.impossible_travel(make_log(first, {"at": 1800, "geo": far})).count() == 1
    assert ru.impossible_travel(make_log(first, {"at": 1801, "geo": far})).count() == 0
    assert ru.impossible_travel(make_log(first, {"at": 600, "geo": near})).count() == 0


def test_credential_stuffing(make_log):
    tries = [{"at": i, "entity_id": f"usr_{i}", "duration": 0.5 if i < 16 else 9.0} for i in range(20)]
    found = ru.credential_stuffing(make_log(*tries)).collect()
    assert [(r.entities, r.failure_ratio) for r in found] == [(20, 0.8)]
    assert ru.credential_stuffing(make_log(*tries[:19])).count() == 0
    assert ru.credential_stuffing(make_log({**tries[0], "duration": 9.0}, *tries[1:])).count() == 0


def test_credential_stuffing_over_the_edge_of_a_window(make_log):
    tries = [{"at": 590 + i, "event_id": i, "entity_id": f"usr_{i}", "duration": 0.5 if i < 16 else 9.0} for i in range(20)]
    log = make_log(*tries, {"at": 591, "event_id": 99, "entity_id": None})
    assert ru.credential_stuffing(log).count() == 0
    for limit in (None, 5):
        found = ru.credential_stuffing_sliding(log, limit=limit).collect()
        assert [(r.event_id, r.entities, r.events, r.failure_ratio) for r in found] == [(19, 20, 20, 0.8)]
    far = make_log(*tries[:19], {**tries[19], "at": 591 + 600})
    assert ru.credential_stuffing_sliding(far).count() == 0


def test_lateral_movement(make_log):
    base = bl.fit_baseline(make_log({"resource": "home"}))
    steps = [{"at": 300 * i, "resource": f"r{i}"} for i in range(5)]
    assert ru.lateral_movement(make_log(*steps), base).count() == 1
    assert ru.lateral_movement(make_log(*steps[:4]), base).count() == 0
    assert ru.lateral_movement(make_log(*steps[:4], {"at": 1200, "resource": "home"}), base).count() == 0
    assert ru.lateral_movement(make_log(*steps[:4], {"at": 1201, "resource": "r9"}), base).count() == 0


def test_device_spoofing(make_log):
    base = bl.fit_baseline(make_log({"device": "Linux|aa|ssh"}, {"device": "Mac|bb|ssh", "entity_id": "usr_2"}))
    log = make_log({"device": "Linux|aa|ssh"}, {"device": "Mac|bb|ssh"}, {"device": "TempleOS|cc|telnet"}, {"device": None})
    found = {r.event_id: (r.new_os, r.new_protocol) for r in ru.device_spoofing(log, base).collect()}
    assert found == {1: (0, 0), 2: (1, 1)}


def test_low_and_slow(make_log):
    night = 15 * 3600  # midnight after the fixture's start
    nights = [{"at": night + DAY * i + 4 * 3600, "resource": "file://x"} for i in range(7)]
    found = ru.low_and_slow(make_log(*nights)).collect()
    assert [(r.days, r.last_day - r.first_day) for r in found] == [(7, 6)]
    assert ru.low_and_slow(make_log(*nights[:6])).count() == 0
    late = {**nights[6], "at": nights[6]["at"] + 3600}
    assert ru.low_and_slow(make_log(*nights[:6], late)).count() == 0
    gap = {**nights[6], "at": nights[6]["at"] + DAY}
    assert ru.low_and_slow(make_log(*nights[:6], gap)).count() == 0


def test_insider_drift(make_log):
    base = bl.fit_baseline(make_log({"resource": "home"}))
    two = make_log({"resource": "r1"}, {"at": 8 * DAY, "resource": "r2"}, {"at": 9 * DAY, "resource": "home"})
    assert [(r.weeks, r.resources) for r in ru.insider_drift(two, base).collect()] == [(2, 2)]
    again = make_log({"resource": "r1"}, {"at": 8 * DAY, "resource": "r1"})
    assert ru.insider_drift(again, base).count() == 0
    apart = make_log({"resource": "r1"}, {"at": 50 * DAY, "resource": "r2"})
    assert ru.insider_drift(apart, base).count() == 0
