"""Mixing sources to target weights: which documents, and how many words of each, a training mix takes.

Method, Efraimidis-Spirakis sampling. A document with quality weight w gets the key u ** (1 / w), u a uniform number
made from a hash of its id; keys sort the documents of a source, largest first, so that any prefix is a weighted sample
without replacement. A source's target is met by whole epochs first (every document, once for each time the source
fits), then by the prefix of that order whose sizes fill the rest; the document at the edge gives only its first words.

A source may hold most of the rows: the order is cut into ranges by sampled quantiles of (source, key, id, hashes), so
that ranges hold about as many rows each whatever the weights; prefix sums run in each range, and only range totals meet
per source. Sources themselves (one row each) are ranked in one small window.

Defined results: a null source is a source of its own, after all others; a null or empty text has size 0 and is taken
0 times; a null, negative or missing quality weight counts as 1 and weight 0 sorts last; ties go by id and text hash;
repeated rows are separate documents with neighbouring keys; an empty table gives an empty mix; targets whose sources
are all empty are 0. Reruns give the same rows, as keys are hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keyed, materialize, row_key, spread, table

#: Weights by rank of the source, repeating.
CYCLE = (5, 2, 1)
#: No source gives more than this many times its words.
MOST_EPOCHS = 3
#: Rows that one range of the order holds, about; there are as many ranges as shuffle partitions at least.
RANGE_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; 0 for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\f\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " ", -1), "")).cast("long")


def source_targets(sizes: DataFrame, weights: DataFrame | None = None, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    `weights` has (source, weight); without it ranks of the sources give the weights of CYCLE. A source's target is at
    most `most` times its size; the excess goes to the others by weight. The common level L solves
    sum(min(most * size, L * weight)) = total. With sources sorted by most * size / weight it is the largest
    (total - caps so far) / (weights from here), so one pass over the sorted sources finds it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), F.pmod(rank - 1, F.lit(len(CYCLE))) + 1).cast("double"))
    else:
        weights = weights.select(F.col("source").alias("other"), F.col("weight").cast("double").alias("weight"))
        per = per.join(weights, F.col("source").eqNullSafe(F.col("other")), "left").drop("other").fillna(0.0, ["weight"])
    cap = F.col("source_size") * most
    order = Window.orderBy(F.col("weight") <= 0, F.try_divide(cap, F.col("weight")), F.col("source").asc_nulls_last())
    so_far, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(so_far), F.lit(0.0))) / F.nullif(F.sum("weight").over(onwards), F.lit(0.0))
    per = per.withColumn("level", level)
    target = F.least(cap.cast("double"), F.max("level").over(everything) * F.col("weight"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def in_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows with `part`, the number of their range of the order; only rows equal in all columns can't be parted."""
    cut = rows.repartitionByRange(ranges, "source", F.col("sample_key").desc(), "doc_id", "text_hash", "row_key")
    return cut.withColumn("part", F.spark_partition_id())


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: DataFrame | None = None, most: float = MOST_EPOCHS, seed: int = 17, range_rows: int = RANGE_ROWS) -> DataFrame:
    """What the mix takes of each row of `docs` (doc_id, source, text).

    `quality` has (doc_id, quality_weight), `weights` (source, weight). Returns doc_id, source, text_hash, size,
    quality_weight, source_size, target, epochs (complete ones), taken (words), sample_key, row_key.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), row_key(docs).alias("row_key"))
    if quality is None:
        base = base.withColumn("quality_weight", F.lit(1.0))
    else:
        known = quality.where("doc_id is not null").groupBy(F.col("doc_id").alias("known_id")).agg(F.min("quality_weight").alias("known"))
        base = base.join(known, F.col("doc_id") == F.col("known_id"), "left")
        base = base.withColumn("quality_weight", F.when(F.col("known") >= 0, F.col("known").cast("double")).otherwise(1.0)).drop("known", "known_id")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + 0.5) / float(1 << 53)
    key = F.when(F.col("quality_weight") > 0, F.pow(uniform, F.try_divide(F.lit(1.0), F.col("quality_weight")))).otherwise(0.0)
    base = materialize(base.withColumn("sample_key", key), "mix")
    targets = source_targets(base, weights, most).join(base.groupBy(F.col("source").alias("other")).agg(F.count("*").alias("n")), F.col("source").eqNullSafe(F.col("other"))).drop("other")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = materialize(targets, "targets").withColumnRenamed("source", "other")
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(targets.agg(F.sum("n")).first()[0] or 0) // range_rows))
    rows = base.join(targets, F.col("source").eqNullSafe(F.col("other"))).drop("other")
    rows = materialize(in_ranges(rows, ranges), "mix_rows")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words")).select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy(F.col("sample_key").desc(), "doc_id", "text_hash", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    taken = F.col("epochs") * F.col("size") + F.when(F.col("rest") > 0, part).otherwise(0)
    return placed.select("doc_id", "source", "text_hash", "size", "quality_weight", "source_size", "target", "epochs", taken.cast("long").alias("taken"), "sample_key", "row_key")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, quality_weight) from labels (quality 0/1): 2 for good, 0.25 for bad, 1 where it is null."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.25).otherwise(1.0)
    return labels.select("doc_id", weight.alias("quality_weight"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: DataFrame | None = None, most: float = MOST_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of docs: each document as often as it is taken.

    The document at the edge of a target gives its first words, joined by spaces (and n_chars, if there, counts them).
    """
    taken = mix(docs, quality, weights, most).where("taken > 0")
    part = F.col("taken") - F.col("epochs") * F.col("size")
    pieces = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(part > 0, F.array(part)).otherwise(F.expr("array()").cast("array<bigint>")))
    items = F.transform(pieces, lambda words: F.struct(words.alias("words"), F.col("size").alias("of")))
    plan = taken.select("row_key", F.explode(items).alias("__item"))
    rows = spread(keyed(docs), materialize(plan, "mix_plan"))
    words = F.array_remove(F.split(F.translate("text", "\t\n\u000b\f\r", "     "), " ", -1), "")
    cut = F.col("__item.words") < F.col("__item.of")
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(words, 1, F.col("__item.words").cast("int")), " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")
