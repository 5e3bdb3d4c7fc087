"""Scores for the order of an entity's actions: a variable-order Markov model held as a context tree.

A node of the tree is a context (up to ORDER actions before an event, the nearest last) with the counts of the actions
that followed it, among normal events and among attacks. An action's probability in a context is its share there,
mixed with its probability in the next shorter context, which weighs as much as the context has different followers.
The evidence of an event is the log ratio of its probability after attacks' counts and after normal ones; the risk adds
up the evidence of the entity's last events. Sets of actions alone leave no trace in it: only their order does.

Fitting and scoring work on distinct (context, action) pairs with counts; events are shuffled for their windows and
joined once. Null actions are an action of their own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import SEQUENCE_LENGTH
from ..session import materialize
from .windows import HOT_ROWS, trailing

ORDER = 3
NO_ACTION = "none"


class ContextTree(NamedTuple):
    followers: DataFrame  # context, action, normal, attack
    contexts: DataFrame  # context, normal, attack, kinds_normal, kinds_attack
    prior: DataFrame  # one row: actions, log_odds


def with_context(log: DataFrame, action: str, order: int = ORDER, limit: int | None = HOT_ROWS) -> DataFrame:
    """Add `action` as text and `context`, the entity's last `order` actions before it, fewer at its start."""
    rows = trailing(log, F.coalesce(F.col(action).cast("string"), F.lit(NO_ACTION)), order + 1, limit=limit)
    return rows.withColumns({
        "action": F.element_at("sequence", -1),
        "context": F.slice("sequence", F.lit(1), F.size("sequence") - 1),
    }).drop("sequence")


def _suffixes() -> Column:
    """The context, and all shorter ones that end like it, down to the empty one."""
    return F.transform(
        F.sequence(F.lit(0), F.size("context")),
        lambda n: F.slice("context", F.size("context") - n + 1, n),
    )


def fit_contexts(steps: DataFrame, label: str = "y") -> ContextTree:
    """The tree of all contexts of `steps`, which has `context`, `action` and 0 or 1 in `label`."""
    y = F.col(label)
    pairs = steps.groupBy("context", "action").agg(
        F.sum(F.when(y == 0, 1).otherwise(0)).alias("normal"), F.sum(F.when(y == 1, 1).otherwise(0)).alias("attack")
    )
    nodes = pairs.select(F.explode(_suffixes()).alias("context"), "action", "normal", "attack")
    followers = materialize(nodes.groupBy("context", "action").agg(F.sum("normal").alias("normal"), F.sum("attack").alias("attack")), "followers")
    kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"kinds_{c}") for c in ("normal", "attack")]
    contexts = materialize(followers.groupBy("context").agg(F.sum("normal").alias("normal"), F.sum("attack").alias("attack"), *kinds), "contexts")
    root = followers.filter(F.size("context") == 0)
    odds = F.log((F.coalesce(F.sum("attack"), F.lit(0)) + 1) / (F.coalesce(F.sum("normal"), F.lit(0)) + 1))
    return ContextTree(followers, contexts, materialize(root.agg(F.count(F.lit(1)).alias("actions"), odds.alias("log_odds")), "prior"))


def _probability(side: str) -> Column:
    """From the empty context up: own share, and the shorter context's probability by the number of kinds."""
    base = F.lit(1.0) / (F.col("actions") + 1)
    n, total, kinds = (lambda x: x[side]), (lambda x: x[f"all_{side}"]), (lambda x: x[f"kinds_{side}"])
    return F.aggregate("path", base, lambda p, x: F.when(total(x) > 0, (n(x) + kinds(x) * p) / (total(x) + kinds(x))).otherwise(p))


def pair_evidence(pairs: DataFrame, tree: ContextTree) -> DataFrame:
    """`evidence` of each distinct (context, action)."""
    nodes = pairs.select("context", "action", F.explode(_suffixes()).alias("node"))
    own = tree.followers.withColumnRenamed("context", "node")
    whole = tree.contexts.select(F.col("context").alias("node"), *[F.col(c).alias(f"all_{c}") for c in ("normal", "attack")], "kinds_normal", "kinds_attack")
    fields = ("normal", "attack", "all_normal", "all_attack", "kinds_normal", "kinds_attack")
    found = nodes.join(own, ["node", "action"], "left").join(whole, "node", "left")
    step = F.struct(F.size("node").alias("depth"), *[F.coalesce(c, F.lit(0)).alias(c) for c in fields])
    paths = found.groupBy("context", "action").agg(F.array_sort(F.collect_list(step)).alias("path"))  # ORDER + 1 nodes at most
    paths = paths.withColumn("actions", tree.prior.select("actions").scalar())
    return paths.select("context", "action", F.log(_probability("attack") / _probability("normal")).alias("evidence"))


def score_order(steps: DataFrame, tree: ContextTree, n: int = SEQUENCE_LENGTH, limit: int | None = HOT_ROWS) -> DataFrame:
    """Add `evidence` of the entity's last `n` events and `risk_score`, the chance of an attack that it leaves."""
    told = pair_evidence(steps.select("context", "action").distinct(), tree)
    rows = trailing(steps.drop("event_number").join(told, ["context", "action"]), F.col("evidence"), n, limit=limit)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("evidence", total).drop("sequence")
    return rows.withColumn("risk_score", 1 / (1 + F.exp(-(F.col("evidence") + tree.prior.select("log_odds").scalar()))))
