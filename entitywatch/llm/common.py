"""What several operators share: input columns, Bloom bitmaps of fixed size, connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

__all__ = ["materialize", "texts", "table", "bitmap", "in_bitmap", "row_key", "KEY", "keyed", "split_by", "spread", "components"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text as UTF-8 bytes, without the other columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def bitmap(df: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A Bloom bitmap of 2**bits bits over a long column, made on the executors.

    It always has the same size (0.5 MB for 22), whatever the table; it only spares rows a later join would drop.
    """
    at = F.pmod(F.col(column), F.lit(1 << bits))
    words = (
        df.where(F.col(column).isNotNull())
        .select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("mask"))
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for word, mask in words.toLocalIterator():
        out[word] = mask
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each 64-bit value may be in the bitmap."""
    at = values.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def row_key(df: DataFrame):
    """A hash of all columns: equal for equal rows only (but for a chance of 2**-64 a pair)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").isNull() for c in df.columns])


def split_by(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a keyed table that are surely not among the keys' row_key, the others), told apart where they lie."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap(keys, "row_key"))

    @F.pandas_udf("boolean")
    def maybe(values: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, values.to_numpy(np.int64)))

    return df.where(~maybe(F.col(KEY))), df.where(maybe(F.col(KEY)))


#: Name of the row key in tables with all columns of the input.
KEY = "__row_key"


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn(KEY, row_key(df))


#: Rows of a plan with one key beyond which the key's rows are dealt to several tasks.
HOT_COPIES = 1000


def spread(df: DataFrame, plan: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """Rows of a keyed table once for each row (row_key, __item) of a stored plan, with column __item.

    The plan's rows of a key stand for all equal rows together, so of equal rows one is spread. Nothing is gathered:
    one row per key meets the plan's rows in a join. A key with more than `hot` rows in the plan goes to several tasks:
    its one row is repeated for every `hot` of them, and each of the plan's rows meets one of these.
    """
    plan = plan.withColumnRenamed("row_key", KEY)
    first = F.row_number().over(Window.partitionBy(KEY).orderBy(KEY))

    def one(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__first", first).where("__first = 1")

    many = materialize(plan.groupBy(F.col(KEY).alias("row_key")).agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot_copies")
    if many.isEmpty():
        return one(df).join(plan, KEY)
    rare, often = split_by(df, many)
    deal = many.select(F.col("row_key").alias(KEY), F.ceil(F.col("n") / hot).alias("__deals"))
    dealt = plan.join(deal, KEY).withColumn("__deal", F.floor(F.rand(7) * F.col("__deals"))).drop("__deals")
    copies = one(often).join(deal, KEY).withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__deals") - 1))).drop("__deals")
    cold = plan.join(deal, KEY, "left_anti")
    return one(rare).join(cold, KEY).unionByName(one(often).join(cold, KEY)).unionByName(copies.join(materialize(dealt, "dealt"), [KEY, "__deal"]).drop("__deal"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest node that links reach.

    Alternating large and small stars; each round is an aggregate and a join, written to the shared folder.
    Rounds grow with the logarithm of the longest chain. Minima combine before the shuffle, and adaptive
    execution splits the join where one node has very many links. Null ends are ignored.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).where("a <> b").distinct()
        now = materialize(small, "edges")
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
