"""Sharding: contiguous shards whose largest is as small as possible, groups never cut.

Method, minimax contiguous partition. Groups (documents with equal text) stand in the order of their text's hash. The
smallest capacity is searched by bisection: a capacity is feasible if a greedy walk, which fills each shard with as many
whole groups as fit, needs no more shards than there are. The cuts of the walk at the smallest feasible capacity are
the shards.

At scale the walk never sees all groups. Prefix sums run within blocks of the order; the driver holds one start per
block (at most BLOCKS of them). A step of the walk asks for the last group that ends within reach: one aggregate over the
blocks in question answers it for many capacities at once, so that every round of the search divides the range by
FAN + 1.

Defined results: a null text counts as an empty one; size is bytes plus 1, so every row counts; equal texts are one
group and are never cut, so a group larger than an even share makes its shard that much larger; an empty table gives no
rows; repeated rows are separate rows of the same group; rows of one doc_id with different texts may part.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window, functions as F

from .common import keyed, materialize, row_key, spread, table

BLOCKS = 4096
#: Capacities that one pass tests.
FAN = 15
#: Rows that one window of slots holds, about.
SLOT_ROWS = 20_000


class _Walk:
    """Greedy walks over the blocks of group ends, for several capacities at a time."""

    def __init__(self, groups: DataFrame, starts: list[tuple[int, int]], total: int, shards: int) -> None:
        self.groups, self.total, self.shards = groups, total, shards
        self.blocks, self.begins = [b for b, _ in starts], [s for _, s in starts]

    def cuts(self, capacities: list[int]) -> dict[int, list[int] | None]:
        """For each capacity the ends of its shards, or None if the shards don't suffice."""
        spark = self.groups.sparkSession
        found: dict[int, list[int] | None] = {c: [] for c in capacities}
        at = dict.fromkeys(capacities, 0)
        for _ in range(self.shards):
            asks = []
            for c in [c for c in capacities if found[c] is not None and at[c] < self.total]:
                reach = at[c] + c
                if reach >= self.total:
                    found[c].append(self.total)
                    at[c] = self.total
                else:
                    asks.append((c, self.blocks[bisect.bisect_right(self.begins, reach) - 1], reach))
            if not asks:
                break
            asked = spark.createDataFrame(asks, "capacity long, block int, reach long")
            near = self.groups.where(F.col("block").isin(sorted({b for _, b, _ in asks})))
            ends = near.join(F.broadcast(asked), "block").where("end <= reach").groupBy("capacity").agg(F.max("end").alias("end"))
            last = {row["capacity"]: row["end"] for row in ends.collect()}
            for c, block, _ in asks:
                end = last.get(c, self.begins[self.blocks.index(block)])
                if end <= at[c]:
                    found[c] = None
                else:
                    found[c].append(end)
                    at[c] = end
        return {c: cuts if cuts is not None and at[c] >= self.total else None for c, cuts in found.items()}


def minimax_cuts(groups: DataFrame, starts: list[tuple[int, int]], total: int, largest: int, shards: int) -> list[int]:
    """Ends of the shards at the smallest capacity that needs no more than `shards`."""
    walk = _Walk(groups, starts, total, shards)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    best = None
    while best is None or low < high:
        tries = sorted({low + (high - low) * k // (FAN + 1) for k in range(FAN + 1)} | ({high} if best is None else set()))
        cuts = walk.cuts(tries)
        feasible = [c for c in tries if cuts[c] is not None]
        if feasible:
            high, best = feasible[0], cuts[feasible[0]]
        low = min(high, max([low - 1, *(c for c in tries if c < high)]) + 1)
    return best


def shard(docs: DataFrame, shards: int = 8, blocks: int = BLOCKS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (from 0, gapless in each shard), the key of its group and row_key, for doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_md5"), row_key(docs).alias("row_key"))
    rows = materialize(rows.withColumn("block", F.pmod(F.conv(F.substring("text_md5", 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")), "sizes")
    groups = rows.groupBy("block", "text_md5").agg(F.sum("size").alias("size"))
    run = Window.partitionBy("block").orderBy("text_md5")
    groups = materialize(groups.withColumn("end", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))), "groups")
    sums = groups.groupBy("block").agg(F.sum("size").alias("words"), F.max("size").alias("largest")).orderBy("block").collect()
    starts, total = [], 0
    for row in sums:
        starts.append((row["block"], total))
        total += row["words"]
    spark = docs.sparkSession
    begins = spark.createDataFrame(starts, "block int, begin long")
    groups = groups.join(F.broadcast(begins), "block").select("block", "text_md5", "size", (F.col("begin") + F.col("end")).alias("end"))
    groups = materialize(groups, "group_ends")
    cuts = minimax_cuts(groups, starts, total, max(r["largest"] for r in sums), shards) if sums else []
    number = sum((F.when(F.col("end") > cut, 1).otherwise(0) for cut in cuts[:-1]), F.lit(0))
    placed = rows.join(groups.select("text_md5", number.alias("shard")), "text_md5")
    return with_slots(placed, slot_rows)


def with_slots(placed: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Number the rows of each shard from 0. Rows are numbered in parts by hash; only part totals meet per shard."""
    many = placed.groupBy(F.col("block").alias("b")).agg(F.ceil(F.count("*") / slot_rows).alias("parts"))
    placed = materialize(placed.join(many, F.col("block") == F.col("b")).drop("b").withColumn("part", F.pmod(F.xxhash64("doc_id", "row_key"), F.col("parts")).cast("int")).drop("parts"), "placed")
    before = Window.partitionBy("shard").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "block", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "block", "part").orderBy("text_md5", "doc_id", "row_key")) - 1
    return placed.withColumn("inside", inside).join(counts, ["shard", "block", "part"]).select("doc_id", "size", "text_crc32", "text_md5", "row_key", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with shard and slot, in place of columns of these names."""
    plan = shard(docs, shards).select("row_key", F.struct("shard", "slot").alias("__item"))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    return spread(keyed(docs), materialize(plan, "shard_plan")).select(*kept, F.col("__item.shard").alias("shard"), F.col("__item.slot").alias("slot"))


def op7_shard(spark, sf_dir: str) -> DataFrame:
    done = shard(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
