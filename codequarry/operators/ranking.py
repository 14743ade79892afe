"""Ranks: global without a single-task sort, top rows per group, size penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import kept


def size_penalty(estimated_chars: Column) -> Column:
    """10 points per 1000 characters, 200 at most."""
    return F.least(F.lit(200), F.floor(estimated_chars / 1000) * 10).cast("int")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with its place in the whole order, from 1. Rows are range-partitioned; a row's
    place is its place in the partition after the sizes of the partitions before, so no task
    sorts more than its range. ``order`` must be total for the result to be unique."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id is the partition's number above 33 bits of place.
    ranged = kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offsets = F.array(*(F.lit(b).cast("long") for b in before or [0]))
    place = F.get(offsets, part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return ranged.withColumn(name, place).drop("_at")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts each task's groups to k before shuffling."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")
