"""Greedy selection under budgets: in rank order, a row is taken iff it still fits every cap,
and selection goes on after one that doesn't."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .ranking import global_rank
from .scratch import kept

#: Ranked rows looked at in one round of a whole-table selection; keys that are sent to every task.
ROUND, BROADCAST_ROWS = 4096, 100_000


def _fits(used: Column, row: Column, costs: list[str], caps: list[int]) -> Column:
    ok = F.lit(True)
    for k, (cost, cap) in enumerate(zip(costs, caps, strict=True)):
        ok = ok & (used[f"u{k}"] + row[cost] <= cap)
    return ok


def select_per_group(df: DataFrame, keys: list[str], order: str, costs: list[str], caps: list[int], key: str) -> DataFrame:
    """Kept rows' ``key`` for each group: one ordered fold over the group's (order, cost) pairs.

    Groups are requests, whose candidates are few. Rows beyond a cap by themselves never fit
    and don't travel; of costs nothing but numbers does. ``order`` is a total order.
    """
    eligible = df
    for cost, cap in zip(costs, caps, strict=True):
        eligible = eligible.where(F.col(cost) <= cap)
    row = F.struct(F.col(order).alias("o"), F.col(key).alias("k"), *(F.col(c).cast("long").alias(c) for c in costs))
    start = F.struct(
        *(F.lit(0).cast("long").alias(f"u{k}") for k in range(len(costs))),
        F.array().cast(f"array<{dict(df.dtypes)[key]}>").alias("kept"),
    )

    def step(used: Column, one: Column) -> Column:
        taken = F.struct(
            *((used[f"u{k}"] + one[c]).alias(f"u{k}") for k, c in enumerate(costs)),
            F.concat(used["kept"], F.array(one["k"])).alias("kept"),
        )
        return F.when(_fits(used, one, costs, caps), taken).otherwise(used)

    folded = eligible.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("f"))
    return folded.select(*keys, F.explode("f.kept").alias(key), *(F.col(f"f.u{k}").alias(f"used_{c}") for k, c in enumerate(costs)))


def select_within_budget(
    df: DataFrame, order: list[tuple[str, bool]], costs: list[str], caps: list[int], key: str
) -> DataFrame:
    """Rows of ``df`` kept under the caps, with ``pick`` (their place) and ``used_<cost>``.
    ``order``: (column, whether descending), total and free of nulls.

    One request over any number of rows: every round reads the best ``ROUND`` rows that may
    still fit (a distributed top-k), takes what fits, and lowers the budgets. Rows that can't
    fit any more never come back, so rounds are few. What is held on the driver is bounded by
    ``ROUND`` and by the budget itself: every row that takes part costs something. Rows of no
    cost always fit and never meet the driver; a null cost never does.
    """
    df = kept(df)
    free = reduce(and_, (F.col(c) == 0 for c in costs)) if min(caps) >= 0 else F.lit(False)
    may = df.where(~free).select(*dict.fromkeys([key, *(c for c, _ in order), *costs]))
    left, chosen, after = list(caps), [], None
    sort = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    while True:
        able = may if after is None else may.where(_beyond(order, after))
        for cost, cap in zip(costs, left, strict=True):
            able = able.where(F.col(cost) <= cap)
        rows = able.orderBy(*sort).limit(ROUND).collect()
        for r in rows:
            if all(r[c] <= cap for c, cap in zip(costs, left, strict=True)):
                left = [cap - r[c] for c, cap in zip(costs, left, strict=True)]
                chosen.append((r[key],))
        if len(rows) < ROUND:
            break
        after = rows[-1]
    keys = df.sparkSession.createDataFrame(chosen, f"`{key}` {dict(df.dtypes)[key]}")
    taken = df.where(~free).join(F.broadcast(keys) if len(chosen) <= BROADCAST_ROWS else keys, key, "left_semi")
    used = {f"used_{c}": F.lit(cap - rest).cast("long") for c, cap, rest in zip(costs, caps, left, strict=True)}
    ranked = global_rank(taken.unionByName(df.where(free)), sort, "pick")
    return ranked.select(key, *(c for c in df.columns if c != key), F.col("pick").cast("int").alias("pick"), *(v.alias(n) for n, v in used.items()))


def _beyond(order: list[tuple[str, bool]], last: Row) -> Column:
    """Rows after ``last`` in the order."""
    out, equal = F.lit(False), F.lit(True)
    for name, down in order:
        out = out | (equal & ((F.col(name) < F.lit(last[name])) if down else (F.col(name) > F.lit(last[name]))))
        equal = equal & (F.col(name) == F.lit(last[name]))
    return out
