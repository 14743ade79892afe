"""Timings: statistics by group, and regressions against a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timing_stats(runs: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """Number, mean, median, least, most and population deviation of ``value`` by group."""
    v = F.col(value)
    stats = {"avg": F.avg(v), "median": F.median(v), "min": F.min(v), "max": F.max(v), "stddev": F.stddev_pop(v)}
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.round(s, digits).alias(f"{name}_{value}") for name, s in stats.items()))


def regressions(now: DataFrame, base: DataFrame, keys: list[str], value: str, percent: float, digits: int = 6) -> DataFrame:
    """What both have, with the change in percent and whether it is worse by more than ``percent``."""
    both = now.select(*keys, F.col(value).alias("_now")).join(base.select(*keys, F.col(value).alias("_base")), keys)
    delta = (F.col("_now") - F.col("_base")) / F.col("_base") * 100
    return both.select(*keys, F.round(delta, digits).alias("delta_pct"), (delta > percent).alias("regression"))


def by_category(results: DataFrame, category: str, name: str, value: str) -> DataFrame:
    """(category, results, total, slowest): one row a category, its slowest result named."""
    return results.groupBy(category).agg(
        F.count(F.lit(1)).alias("results"), F.round(F.sum(value), 6).alias("total"), F.max_by(name, F.struct(F.col(value), F.col(name))).alias("slowest")
    )
