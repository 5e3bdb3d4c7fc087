"""The context tree against a plain computation, and a signal that lies in the order of actions alone."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from entitywatch.fixed import FEATURES
from entitywatch.operators import evaluation as ev
from entitywatch.operators import models as mo
from entitywatch.operators import order

ROUNDS = {"attack": "abc", "normal": "acb"}


def _cycles(spark, entities=16, events=30):
    """Entities that use a, b and c equally often; attacks go round the other way. Every third event is left out of the
    round by a coin, so that no single pair gives them away."""
    pick, rows = random.Random(4), []
    for e in range(entities):
        kind = "attack" if e % 2 else "normal"
        for block in range(events // 3):
            turn = list(ROUNDS[kind])
            if pick.random() < 0.3:
                pick.shuffle(turn)
            rows += [(len(rows) + k, f"usr_{e}", block * 3 + k, c, int(kind == "attack")) for k, c in enumerate(turn)]
    log = spark.createDataFrame(rows, "event_id long, entity_id string, at long, resource string, y int")
    return log.withColumn("timestamp", F.timestamp_seconds(F.col("at") * 60 + 1_700_000_000))


def _auc(rows):
    return ev.auc_roc(rows.withColumnRenamed("y", "y_true"), "risk_score").scalar()


def test_order_alone_tells_held_out_entities_apart(spark):
    log = _cycles(spark)
    held_out = F.substring("entity_id", 5, 2).cast("int") >= 10
    steps = order.with_context(log, "resource")
    scored = order.score_order(steps.filter(held_out), order.fit_contexts(steps.filter(~held_out)))
    assert scored.filter("event_number > 10").select(_auc(scored.filter("event_number > 10"))).first()[0] > 0.95
    # the linear model sees the same actions as one number each of the last ten rows
    codes = {"a": 0.0, "b": 1.0, "c": 2.0}
    coded = log.withColumn("code", F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("resource")))
    rows = mo.build_sequences(coded, names=["code"])
    model = mo.fit_detector(mo.with_age(rows.filter(~held_out)))
    flat = mo.score_detector(rows.filter(held_out), model)
    assert flat.select(_auc(flat)).first()[0] < 0.8


def _plain(events, order_):
    """Evidence by nested counts; events: (entity, action, y) in order, all used for the fit."""
    count, past, steps = defaultdict(lambda: [Counter(), Counter()]), defaultdict(list), []
    for entity, action, y in events:
        action = order.NO_ACTION if action is None else action
        context = tuple(past[entity][-order_:])
        steps.append((context, action))
        for n in range(len(context) + 1):
            count[context[len(context) - n :]][y][action] += 1
        past[entity].append(action)
    actions = len(set(count[()][0]) | set(count[()][1]))

    def probability(context, action, y):
        p = 1 / (actions + 1)
        for n in range(len(context) + 1):
            own = count[context[len(context) - n :]][y]
            if own:
                p = (own[action] + len(own) * p) / (sum(own.values()) + len(own))
        return p

    return [math.log(probability(c, a, 1) / probability(c, a, 0)) for c, a in steps]


@pytest.mark.parametrize("limit", [None, 8])
def test_evidence_against_the_plain_computation(spark, limit):
    pick = random.Random(9)
    events = [(f"usr_{pick.randint(0, 2)}", pick.choice(["x", "y", "z", None]), pick.randint(0, 1)) for _ in range(70)]
    rows = [(i, e, a, y) for i, (e, a, y) in enumerate(events)]
    log = spark.createDataFrame(rows, "event_id long, entity_id string, resource string, y int")
    log = log.withColumn("timestamp", F.timestamp_seconds(F.col("event_id") * 7 + 1_700_000_000))
    steps = order.with_context(log, "resource", limit=limit)
    scored = order.score_order(steps, order.fit_contexts(steps), n=1, limit=limit)
    got = [r.evidence for r in scored.orderBy("event_id").collect()]
    assert got == pytest.approx(_plain(events, order.ORDER), abs=1e-9)


def test_tables_without_rows_or_attacks(spark):
    log = _cycles(spark, 2, 6)
    steps = order.with_context(log.filter("y = 0"), "resource")
    tree = order.fit_contexts(steps)
    unseen = order.with_context(log.withColumn("resource", F.lit("new")), "resource")
    assert order.score_order(unseen, tree).filter("risk_score between 0 and 1").count() == 12
    nothing = order.fit_contexts(steps.limit(0))
    assert {round(r.risk_score, 9) for r in order.score_order(steps, nothing).collect()} == {0.5}
