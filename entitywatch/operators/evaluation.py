"""Detection and classification quality.

Curves need running totals over all scores. Rows are first counted per distinct score; the distinct scores are then cut
at approximate quantiles into ordered parts of about equal size, however the scores crowd, so that no window ever runs
in one task over the whole table. All detection measures follow from one such table, in one pass over the rows.

Rows without a score take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import ALERT_BUDGET, HOUR, LABELS, RISK_BINS, RISK_THRESHOLD

#: Parts on each of two levels: values are cut into GROUPS * GROUPS parts.
GROUPS = 16


def running_totals(
    counts: DataFrame, value: str, columns: list[str], descending: bool = False, groups: int = GROUPS
) -> DataFrame:
    """Add inclusive running totals `cum_*` over the order of a distinct `value`, and the totals `all_*`.

    The values are cut into groups * groups parts. Part totals (a few hundred rows) give each part its starting point.
    """
    steps = groups * groups
    shares = [i / steps for i in range(1, steps)]
    cuts = counts.agg(F.percentile_approx(value, shares, 20 * steps).alias("c")).scalar()
    placed = counts.withColumn("_cuts", cuts)
    # which group of cuts a value lies behind, and how many cuts of that group
    ends = F.transform(F.sequence(F.lit(1), F.lit(groups - 1)), lambda g: F.get("_cuts", g * groups - 1))
    group = F.size(F.filter(ends, lambda c: c < F.col(value)))
    placed = placed.withColumn("_group", group)
    own = F.slice("_cuts", F.col("_group") * groups + 1, F.lit(groups - 1))
    part = F.col("_group") * groups + F.size(F.filter(own, lambda c: c < F.col(value)))
    placed = placed.withColumn("_part", part).drop("_cuts", "_group")
    order = F.desc("_part") if descending else F.asc("_part")
    ahead = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = (
        placed.groupBy("_part")
        .agg(*[F.sum(c).alias(c) for c in columns])
        .select(
            F.col("_part"),
            *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_start_{c}") for c in columns],
            *[F.sum(c).over(whole).alias(f"all_{c}") for c in columns],
        )
    )
    inside = Window.partitionBy("_part").orderBy(F.desc(value) if descending else F.asc(value))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in columns])
    return summed.join(starts, "_part").select(
        *counts.columns,
        *[(F.col(f"_start_{c}") + F.col(f"_in_{c}")).alias(f"cum_{c}") for c in columns],
        *[F.col(f"all_{c}") for c in columns],
    )


def count_values(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def _quantile_ends(q: float, value: str, upto: Column, total: Column, *carried: str) -> tuple[Column, Column, Column]:
    """Aggregates over running totals: the structs at the ranks around the quantile, and the share between them."""
    spot = (total - 1).cast("double") * F.lit(float(q))
    item = F.struct(value, *carried)
    return F.min(F.when(upto > F.floor(spot), item)), F.min(F.when(upto > F.ceil(spot), item)), F.max(spot - F.floor(spot))


def exact_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row `quantile`: linear interpolation between the two nearest ranks."""
    running = running_totals(count_values(df, value), value, ["n"])
    below, above, share = _quantile_ends(q, value, F.col("cum_n"), F.col("all_n"))
    ends = running.agg(below.alias("below"), above.alias("above"), share.alias("share"))
    low, high = F.col(f"below.{value}"), F.col(f"above.{value}")
    return ends.select((low + (high - low) * F.col("share")).alias("quantile"))


#: Size of a quantile sketch. Ranks read from merged sketches are off by no more than SKETCH_ERROR of the rows, in all but 1 of 100 reads.
SKETCH_K, SKETCH_ERROR = 400, 0.008


def sketch_days(df: DataFrame, value: str, *keys: str, time: str = "timestamp", k: int = SKETCH_K) -> DataFrame:
    """`date`, `keys`, `n` and `sketch`: a mergeable quantile sketch of each day's values, some kilobytes each.

    Rows without a value take no part, nor do days without any.
    """
    known = df.filter(F.col(value).isNotNull()).select(F.to_date(time).alias("date"), *keys, F.col(value).cast("double").alias("_value"))
    return known.groupBy("date", *keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_value", k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, shares: list[float], *keys: str, since=None, until=None, k: int = SKETCH_K) -> DataFrame:
    """`n` and `quantiles` over the days from `since` to before `until`, from stored sketches alone; the log isn't read."""
    days = sketches
    if since is not None:
        days = days.filter(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.filter(F.col("date") < F.lit(until).cast("date"))
    merged = days.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    found = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in shares])
    return merged.filter("n > 0").select(*keys, "n", found.alias("quantiles"))


def time_split(df: DataFrame, test_share: float = 0.2, time: str = "timestamp") -> DataFrame:
    """Add `is_test`: the latest share of rows. Rows at the cutting time go to the test part.

    Rows are counted per hour, and only those of the hour where the cut falls per microsecond.
    """
    rows = df.withColumn("_us", F.unix_micros(time))
    known = rows.where(F.col("_us").isNotNull()).select("_us")
    hourly = known.groupBy(F.floor(F.col("_us") / HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    running = running_totals(hourly, "hour", ["n"])
    first_test = F.floor(F.col("all_n") * F.lit(1.0 - test_share))
    found = running.agg(
        F.min(F.when(F.col("cum_n") > first_test, F.struct("hour", (first_test - F.col("cum_n") + F.col("n")).alias("skip")))).alias("x")
    )
    hour, skip = found.select("x.hour").scalar(), found.select("x.skip").scalar()
    inside = known.where(F.floor(F.col("_us") / HOUR) == hour).groupBy("_us").agg(F.count(F.lit(1)).alias("n"))
    cut = running_totals(inside, "_us", ["n"]).agg(F.min(F.when(F.col("cum_n") > skip, F.col("_us"))).alias("cut")).scalar()
    return rows.withColumn("is_test", F.col("_us") >= cut).drop("_us")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def _tally(condition: Column, name: str) -> Column:
    return F.sum(condition.cast("bigint")).alias(name)


def binary_quality(scored: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Precision, recall and F1; 0 where undefined."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return scored.agg(_tally(y & p, "tp"), _tally(~y & p, "fp"), _tally(y & ~p, "fn")).select(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1")
    )


def score_counts(scored: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(truth) == 1
    known = scored.where(F.col(score).isNotNull())
    return known.groupBy(F.col(score).alias("score")).agg(_tally(y, "pos"), _tally(~y, "neg"))


def _curve(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """Positives and negatives at or above each distinct score, and of all."""
    return running_totals(score_counts(scored, score, truth), "score", ["pos", "neg"], descending=True)


def _sides() -> tuple[Column, Column]:
    """All positives and negatives, as aggregates over the curve."""
    return F.max("all_pos"), F.max("all_neg")


def _auc() -> Column:
    """An aggregate over the curve; wins against negatives below, ties counting half."""
    pos, neg = _sides()
    wins = F.col("pos") * (F.col("all_neg") - F.col("cum_neg") + F.col("neg") / 2)
    return F.coalesce(_ratio(F.sum(wins), pos.cast("double") * neg), F.lit(0.0))


def _precision_area() -> Column:
    pos, neg = _sides()
    gain = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return F.coalesce(F.when((pos > 0) & (neg > 0), F.sum(gain) / pos), F.lit(0.0))


def auc_roc(scored: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; 0 with one class only."""
    return _curve(scored, score, truth).agg(_auc().alias("auc_roc"))


def average_precision(scored: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Step-wise area under precision over recall; 0 with one class only."""
    return _curve(scored, score, truth).agg(_precision_area().alias("auc_pr"))


def roc_points(scored: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """False and true positive rate at each distinct score taken as threshold."""
    return _curve(scored, score, truth).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )


def pr_points(scored: DataFrame, score: str = "score", truth: str = "y_true") -> DataFrame:
    """Precision and recall at each distinct score taken as threshold."""
    return _curve(scored, score, truth).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )


def flag_budget(scored: DataFrame, score: str = "score", budget: float = ALERT_BUDGET) -> DataFrame:
    """Add `in_budget`: the score reaches the quantile that leaves the budgeted share; null without a score."""
    threshold = exact_quantile(scored, score, 1.0 - budget).scalar()
    return scored.withColumn("in_budget", (F.col(score) >= threshold).cast("int"))


def _budget_ends(budget: float) -> dict[str, Column]:
    """Aggregates over the curve that say how many negatives reach the budget's quantile."""
    total = F.col("all_pos") + F.col("all_neg")
    upto = total - F.col("cum_pos") - F.col("cum_neg") + F.col("pos") + F.col("neg")
    below, above, share = _quantile_ends(1.0 - budget, "score", upto, total, "cum_neg")
    return {"below": below, "above": above, "share": share, "negatives": _sides()[1]}


def _budget_rate() -> Column:
    """No score lies between the two ends, so the threshold is reached from the upper one, or from both if they meet."""
    low, high = F.col("below.score"), F.col("above.score")
    reached = F.when(low + (high - low) * F.col("share") <= low, F.col("below.cum_neg")).otherwise(F.col("above.cum_neg"))
    return F.coalesce(_ratio(reached, F.col("negatives")), F.lit(0.0))


def fpr_at_budget(
    scored: DataFrame, score: str = "score", truth: str = "y_true", budget: float = ALERT_BUDGET
) -> DataFrame:
    ends = _curve(scored, score, truth).agg(*[c.alias(n) for n, c in _budget_ends(budget).items()])
    return ends.select(_budget_rate().alias("fpr_at_1_percent_budget"))


def flag_risk(scored: DataFrame, score: str = "score", threshold: float = RISK_THRESHOLD) -> DataFrame:
    return scored.withColumn("y_pred", (F.col(score) > threshold).cast("int"))


def evaluate_detection(scored: DataFrame, score: str = "score", budget: float = ALERT_BUDGET) -> DataFrame:
    """All detection measures in one row, from counts per distinct score; columns y_true, y_pred and a score."""
    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        _tally(y, "pos"), _tally(~y, "neg"), _tally(y & p, "hit"), _tally(~y & p, "miss")
    )
    ends = running_totals(counts, "score", ["pos", "neg"], descending=True).agg(
        F.sum("hit").alias("tp"), F.sum("miss").alias("fp"), (_sides()[0] - F.sum("hit")).alias("fn"),
        _auc().alias("auc_roc"), _precision_area().alias("auc_pr"), *[c.alias(n) for n, c in _budget_ends(budget).items()],
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return ends.select(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"),
        "auc_roc", "auc_pr", _budget_rate().alias("fpr_at_1_percent_budget"),
    )


def confusion_counts(scored: DataFrame, truth: str = "label", predicted: str = "pred_label") -> DataFrame:
    return scored.groupBy(F.col(truth).alias("true_label"), F.col(predicted).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(scored: DataFrame, truth: str = "label", predicted: str = "pred_label") -> DataFrame:
    """One row per true label, one column per known label."""
    labels = sorted(LABELS)
    return (
        scored.groupBy(F.col(truth).alias("true_label"))
        .pivot(predicted, labels)
        .count()
        .na.fill(0, labels)
    )


def class_quality(scored: DataFrame, truth: str = "label", predicted: str = "pred_label") -> DataFrame:
    """Support, precision, recall and F1 per class in either the truth or the prediction."""
    n, hit = F.col("n"), F.col("true_label") == F.col("pred_label")
    roles = F.array(
        F.struct(F.col("true_label").alias("label"), n.alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("bigint").alias("support"), n.alias("predicted")),
    )
    found = (
        confusion_counts(scored, truth, predicted)
        .select(F.when(hit, n).otherwise(0).alias("tp"), F.inline(roles))
        .withColumn("tp", F.when(F.col("support") > 0, F.col("tp")).otherwise(0))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    tp = F.col("tp")
    return found.select(
        "label",
        "support",
        _ratio(tp, F.col("predicted")).alias("precision"),
        _ratio(tp, F.col("support")).alias("recall"),
        _ratio(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
    )


def class_summary(scored: DataFrame, truth: str = "label", predicted: str = "pred_label") -> DataFrame:
    """Macro and support-weighted averages over the classes."""
    return class_quality(scored, truth, predicted).agg(
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def score_histogram(df: DataFrame, score: str, by: list[str] = (), bins: int = RISK_BINS) -> DataFrame:
    """Equal bins over 0..1; a score of 1 belongs to the last. Rows without a score are in no bin."""
    spot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(score).isNotNull()).groupBy(*by, spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def metrics_json(detection: DataFrame, classes: DataFrame, summary: DataFrame, counts: DataFrame) -> DataFrame:
    """All measures as one nested JSON text."""
    per_class = classes.agg(F.sort_array(F.collect_list(F.struct("label", "precision", "recall", "f1"))).alias("x"))
    cells = counts.agg(F.sort_array(F.collect_list(F.struct("true_label", "pred_label", "n"))).alias("x"))
    nested = F.struct(
        F.struct(*detection.columns).alias("detection"),
        F.struct(
            *[summary.select(c).scalar().alias(c) for c in summary.columns],
            per_class.scalar().alias("per_class"),
            cells.scalar().alias("confusion"),
        ).alias("classification"),
    )
    return detection.select(F.to_json(nested).alias("metrics"))
