"""N-gram Jaccard join: every link between documents whose shingle sets overlap by 0.8 or more, and its components.

Method, a metric-space join. The Jaccard distance obeys the triangle inequality, so pivots can stand for regions.
Nearly all distances between documents are 1, where random pivots separate nothing. Pivots are therefore found
through shared shingles:

1. Documents with the same set form a class (distance 0) and go on as one row; `cls` is the hash of the set.
2. Two sets within the radius must share one of their first floor(0.2 n) + 1 shingles in any fixed order. Classes
   that share such a shingle form a region. Its pivot is its smallest class, so that the many shingles of one group
   of copies name the same few pivots. The order puts very common shingles last (a fixed-size count over all
   documents finds them): a passage that stands in many documents then makes no region of them. The rest of the order
   is that of hashes, so the first shingles are a random sample of the set and a partner shares about 0.8 of them; a
   class goes on only if it shares as many as a partner would leave with a chance of 1 - 10**-12 (see `least_shared`).
3. A region is joined recursively: classes within the radius of the pivot link to it and form its group. Classes stay
   as long as the triangle inequality allows them to reach one of another group, i.e. as their distance to the pivot
   differs from that of such a class by no more than the radius. The next pivot is a class without a group; when there
   are none, one of the smallest group, until one group is left.
4. Regions too large for one task are split by hash; every part gets the pivot and does one step of 3 in its own task,
   and the remainder is joined again. If a step removes little, pairs of parts are joined as regions of their own.

Exact but for chances like those of hash collisions (n * n / 2**65 for n classes or the shingles of a pair; 10**-12 for
a link to be overlooked in step 2).

Defined results: null and empty texts have no shingles, link with nothing and are their own component; fewer words
than a shingle give one shingle of the whole sequence; equal doc_ids count as one document where both are linked;
a null doc_id loses against any other as the smallest of its component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import KEY, bitmap, components, in_bitmap, keyed, materialize, row_key, split_by, table, texts
from .text import chunked, mix, shingle_sets, signed

SIZE = 5
#: 100 * intersection >= PERCENT * union
PERCENT = 80
COUNTERS = 1 << 18
BLOCK = 1 << 12
#: Shingles of all members that one task joins; a bound on its memory.
REGION_SHINGLES = 4_000_000


def set_class(shingles: np.ndarray) -> int:
    """The hash of a set."""
    return int(signed(mix(mix(shingles).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))))[0])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_shared(n: int, first: int, ranked: int, percent: int) -> int:
    """How many of its `first` shingles, a random sample of `ranked`, a set of n has in common with any partner.

    A partner lacks at most (1 - percent / 100) * n of them; Serfling's bound for samples without replacement says how
    many of these fall into the sample, but for a chance of 10**-12. At least 1, as the prefix is that long.
    """
    lacking = first * min(1.0, (n - -(-percent * n // 100)) / ranked)
    spread = math.sqrt(first * (1 - (first - 1) / ranked) * 12 * math.log(10) / 2)
    return max(1, math.ceil(first - lacking - spread))


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - 18)).astype(np.int64)


def _survey(size: int):
    """Per document: shingles and class; per task: counts of shingles by slot, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_row = np.zeros(COUNTERS, np.int64), False
        for batch in batches:
            any_row = True
            sizes, classes = [], []
            for _, held in chunked(batch.column("text").to_pylist()):
                sets = list(shingle_sets(held, size))
                counts += np.bincount(_slot(np.concatenate(sets)), minlength=COUNTERS)
                sizes += [len(s) for s in sets]
                classes += [set_class(s) if len(s) else None for s in sets]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "row_key", "n_shingles", "cls", "block", "counts"],
            )
        if any_row:
            n = COUNTERS // BLOCK
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(n, pa.int64())] * 4, pa.array(range(n), pa.int32()),
                 pa.array([counts[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in range(n)], pa.binary())],
                ["doc_id", "row_key", "n_shingles", "cls", "block", "counts"],
            )

    return run


def _add_counts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.int64)
    for part in group["counts"]:
        total += np.frombuffer(part, np.int64)
    return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})


def common_levels(blocks: DataFrame) -> np.ndarray:
    """For each slot 0, or how far its count stands out from the mean (a fixed 256 KB, whatever the corpus)."""
    add = lambda df, *keys: df.groupBy(*keys).applyInPandas(_add_counts, "block int, counts binary")
    counts = np.zeros(COUNTERS, np.int64)
    salted = add(blocks.withColumn("salt", F.spark_partition_id() % 64), "block", "salt")
    for block, part in add(salted, "block").collect():
        counts[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(part, np.int64)
    mean = counts.mean()
    beyond = (counts - mean) / (8 * np.sqrt(mean) + 64)
    return np.where(beyond >= 1, np.log2(np.maximum(beyond, 1)) + 1, 0).astype(np.uint8)


def _prefixes(size: int, percent: int, shared):
    """The first shingles of every class, common ones last; a class once for each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, met = shared.value, set()
        for batch in batches:
            for _, held in chunked(batch.column("text").to_pylist()):
                tokens, owners, common, needs = [], [], [], []
                for shingles in shingle_sets(held, size):
                    if not len(shingles) or (cls := set_class(shingles)) in met:
                        continue
                    met.add(cls)
                    level = levels[_slot(shingles)]
                    first, ranked = prefix_length(len(shingles), percent), int((level == 0).sum())
                    order = slice(first) if ranked == len(shingles) else np.lexsort((shingles, level))[:first]
                    tokens.append(shingles[order])
                    common.append(level[order] > 0)
                    owners.append(np.full(first, cls, np.int64))
                    needs.append(np.full(first, least_shared(len(shingles), first, ranked, percent) if first <= ranked else 1, np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(owners)), pa.array(np.concatenate(common)), pa.array(np.concatenate(needs))],
                        ["token", "cls", "common", "need"],
                    )

    return run


def _sets(size: int, shared):
    """The sets of documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, met = shared.value, set()
        for batch in batches:
            keep = in_bitmap(wanted, batch.column("id_hash").to_numpy(zero_copy_only=False))
            held_all = batch.column("text").filter(pa.array(keep)).to_pylist()
            for _, held in chunked(held_all):
                rows = [(set_class(s), s) for s in shingle_sets(held, size) if len(s)]
                rows = [(cls, s) for cls, s in rows if cls not in met and not met.add(cls)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cls for cls, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], ["cls", "shingles"]
                    )

    return run


def _distances(inverse: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mark: np.ndarray, pivot: int):
    """Intersections of the pivot with all members, and distances."""
    own = inverse[starts[pivot] : starts[pivot] + sizes[pivot]]
    mark[own] = True
    both = np.add.reduceat(mark[inverse], starts, dtype=np.int64)
    mark[own] = False
    union = sizes + sizes[pivot] - both
    return both, union, 1.0 - both / union


def _others(distance: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member the least and the greatest distance of members of other groups; infinite where there are none."""
    ends = []
    for values in (distance, -distance):
        first = int(values.argmin())
        rest = values[group != group[first]]
        ends.append(np.where(group == group[first], rest.min() if rest.size else np.inf, values[first]))
    return ends[0], -ends[1]


def region_links(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a, b) that connect all members within the radius, by pivots in turn.

    Members of one group (0: none yet) are connected already and need no links among themselves. Those that link to a
    pivot come to its group; they are compared on with members of other groups as long as such are within reach.
    """
    radius = 1 - percent / 100 + 1e-9
    links, live = [], np.ones(len(ids), bool)
    guest = np.asarray(group) != 0
    group = np.unique(np.where(guest, group, ids), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    inverse = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(inverse.max()) + 1, bool)
    while (left := np.flatnonzero(live)).size and (group[left] != group[left[0]]).any():
        outer = left[~guest[left]]
        if outer.size:
            pivot = outer[0]
        else:  # one of the smallest group
            pivot = left[np.bincount(group[left])[group[left]].argmin()]
        both, union, distance = _distances(inverse, starts, sizes, mark, pivot)
        near = live & (100 * both >= percent * union) & (group != group[pivot])
        links += [(int(ids[pivot]), int(x)) for x in ids[near]]
        if near.any():
            group[np.isin(group, group[near])] = group[pivot]
        live[pivot] = False
        guest |= near
        left = np.flatnonzero(live)
        if left.size:  # a member can only reach others at a distance to the pivot like its own
            low, high = _others(distance[left], group[left])
            live[left] = (distance[left] >= low - radius) & (distance[left] <= high + radius)
        if 2 * live.sum() < len(live) and live.any():
            kept = np.flatnonzero(live)
            inverse = np.concatenate([inverse[starts[k] : starts[k] + sizes[k]] for k in kept])
            ids, sizes, guest, group, live = ids[kept], sizes[kept], guest[kept], group[kept], live[kept]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return links


def _join_region(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", kind="stable")
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        links = region_links(group["cls"].to_numpy(), sets, group["grp"].to_numpy(np.int64), percent)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _pivot_step(percent: int):
    """One pivot against one part of a large region: rows (cls, group, near, distance)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pivot = np.frombuffer(group["pivot_set"].iloc[0], np.uint64)
        both = np.array([np.isin(np.frombuffer(s, np.uint64), pivot, assume_unique=True).sum() for s in group["shingles"]], np.int64)
        union = group["n"].to_numpy() + len(pivot) - both
        return pd.DataFrame({"region": group["region"], "pivot": group["pivot"], "pivot_grp": group["pivot_grp"], "cls": group["cls"], "grp": group["grp"],
                             "near": 100 * both >= percent * union, "distance": 1.0 - both / union})

    return run


def _strip_large(members: DataFrame, sets: DataFrame, percent: int, limit: int):
    """Split off what one task can't hold. Returns members of regions that fit, and link tables found on the way."""
    fits, found, before = [], [], None
    radius = 1 - percent / 100 + 1e-9
    kind = F.when(F.col("grp") == 0, F.col("cls")).otherwise(F.col("grp"))
    while True:
        weighed = members.join(sets.select("cls", "n"), "cls")
        totals = weighed.groupBy("region").agg(
            F.sum("n").alias("total"), F.min(F.struct(F.col("grp") != 0, "cls", "grp")).alias("first"), F.min(kind).alias("low"), F.max(kind).alias("high"),
            (F.count(F.lit(1)) + F.count(F.when(F.col("grp") == 0, 1))).alias("work"))
        totals = materialize(totals.where("low <> high").select("region", "total", "work", F.col("first.cls").alias("pivot"), F.col("first.grp").alias("pivot_grp")), "regions")
        fits.append(members.join(totals.where(F.col("total") <= limit).select("region"), "region"))
        large = totals.where(F.col("total") > limit)
        state = large.agg(F.sum("work")).first()[0]
        if not state:
            return fits, found
        if before is not None and state > 0.9 * before:
            parts = F.ceil(2 * F.col("total") / limit).cast("int")
            split = members.join(large.select("region", "total"), "region").withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            fits.append(split.select(F.xxhash64("region", F.least("part", "other"), F.greatest("part", "other")).alias("region"), "cls", "grp").distinct())
            return fits, found
        before = state
        pivots = large.select("region", "total", "pivot", F.when(F.col("pivot_grp") == 0, F.col("pivot")).otherwise(F.col("pivot_grp")).alias("pivot_grp"))
        pivots = pivots.join(sets.select(F.col("cls").alias("pivot"), F.col("shingles").alias("pivot_set")), "pivot")
        parts = F.ceil(2 * F.col("total") / limit)
        spread = members.join(pivots, "region").join(sets, "cls").withColumn("part", F.pmod(F.xxhash64("cls"), parts))
        step = materialize(
            spread.groupBy("region", "part").applyInPandas(_pivot_step(percent), "region long, pivot long, pivot_grp long, cls long, grp long, near boolean, distance double"), "step")
        step = step.where("cls <> pivot")
        found.append(step.where("near").select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
        # what links to the pivot, and the groups of such members, come to the pivot's group
        merged = step.where("near and grp <> 0").select("region", "grp", F.lit(True).alias("joins")).distinct()
        step = step.join(merged, ["region", "grp"], "left")
        step = step.withColumn("grp", F.when(F.col("joins") | F.col("near"), F.col("pivot_grp")).otherwise(F.col("grp")))
        ends = step.groupBy("region", "grp").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
        other = ends.select(F.col("region").alias("_region"), F.col("grp").alias("_grp"), "low", "high")
        edge = ends.select("region", "grp").join(other, (F.col("region") == F.col("_region")) & ((F.col("grp") == 0) | (F.col("grp") != F.col("_grp"))))
        edge = edge.groupBy("region", "grp").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        members = materialize(
            step.join(edge, ["region", "grp"]).where(F.col("distance").between(F.col("low") - radius, F.col("high") + radius)).select("region", "cls", "grp"), "members")


def _regions(tokens: DataFrame) -> DataFrame:
    """Shingles that two classes or more have, with the smallest of these classes as region.

    Groups of rare shingles are small, so one shuffle and a window do. For common ones minima combine before the
    shuffle, and adaptive execution can split the join.
    """
    keep = ["token", "cls", "common", "need", "region"]
    rare = tokens.where("not common").select("token", "cls", "common", "need", F.expr("min(cls) over (partition by token) as region"), F.expr("max(cls) over (partition by token) as last"))
    often = tokens.where("common").groupBy("token").agg(F.min("cls").alias("region"), F.max("cls").alias("last"))
    often = tokens.where("common").join(often, "token")
    return rare.where("region <> last").select(keep).union(often.where("region <> last").select(keep))


def _enough(tokens: DataFrame) -> DataFrame:
    """The rows of classes that share as many shingles as a partner needs; a class that several tasks met counts once."""
    once = tokens.repartition("cls").dropDuplicates(["cls", "token"])
    return once.withColumn("shared", F.expr("count(*) over (partition by cls)")).where("shared >= need").drop("shared", "region")


def jaccard_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, region_shingles: int = REGION_SHINGLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with class, links between classes, components of classes) of a table with doc_id and text."""
    spark = docs.sparkSession
    rows = texts(docs, row_key(docs).alias("row_key"))
    survey = materialize(rows.mapInArrow(_survey(size), "doc_id long, row_key long, n_shingles long, cls long, block int, counts binary"), "survey")
    known = survey.where("block is null").select("doc_id", "row_key", "n_shingles", "cls")
    levels = spark.sparkContext.broadcast(common_levels(survey.where("block is not null").select("block", "counts")))
    tokens = materialize(rows.select("text").mapInArrow(_prefixes(size, percent, levels), "token long, cls long, common boolean, need int"), "prefixes")
    tokens = materialize(_enough(_regions(tokens)), "shared")
    tokens = _regions(_enough(_regions(tokens)))
    members = materialize(tokens.select("region", "cls").distinct().withColumn("grp", F.lit(0).cast("long")), "members")
    wanted = members.select("cls").distinct()
    chosen = known.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(wanted, "cls", "left_semi").select(F.xxhash64("doc_id").alias("id_hash"))
    bits = spark.sparkContext.broadcast(bitmap(chosen, "id_hash"))
    sets = rows.select("text", F.xxhash64("doc_id").alias("id_hash")).mapInArrow(_sets(size, bits), "cls long, shingles binary")
    sets = materialize(sets.dropDuplicates(["cls"]).join(wanted, "cls", "left_semi").withColumn("n", (F.length("shingles") / 8).cast("long")), "sets")
    fits, found = _strip_large(members, sets, percent, region_shingles)
    for part in fits:
        found.append(part.join(sets.select("cls", "shingles"), "cls").groupBy("region").applyInPandas(_join_region(percent), "a long, b long"))
    links = found[0]
    for part in found[1:]:
        links = links.union(part)
    links = materialize(links.distinct(), "links")
    return known, links, components(links)


def document_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Per document: doc_id, row_key, n_shingles, class, component_id, and the row_key of the component's smallest row."""
    known, _, found = jaccard_join(docs, size, percent, region_shingles)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    classes = known.where("cls is not null").groupBy("cls").agg(F.min(order).alias("least"))
    rooted = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = rooted.join(named, "root").select("cls", "first")
    joined = known.join(named, "cls", "left")
    return joined.select("doc_id", "row_key", "n_shingles", "cls", F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.coalesce("first.row_key", "row_key").alias("first_row"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, the one of the smallest id; empty texts stay.

    Only rows that may go are moved: the others, most of them, are told by a bitmap where they lie.
    """
    found = materialize(document_components(docs, size, percent), "components").where("cls is not null")
    gone = found.where("row_key <> first_row").select("row_key").distinct()
    twice = found.where("row_key = first_row").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key")
    sure, maybe = split_by(keyed(docs), gone.union(twice))
    gone, twice = gone.withColumnRenamed("row_key", KEY), twice.withColumnRenamed("row_key", KEY)
    rest = maybe.join(gone, KEY, "left_anti")
    once = rest.join(twice, KEY, "left_semi").dropDuplicates([KEY])
    rest = rest.join(twice, KEY, "left_anti")
    return sure.select(docs.columns).union(rest.select(docs.columns)).union(once.select(docs.columns))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return document_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
