"""Exact duplicates by skew-safe combining (DataFrame functions only).

Copies are first combined inside each task, then in salted digest groups, then the salt
winners globally. Every one of the three combines compares the full normalised text (it is
part of the grouping key), the digest only places it. A group that holds a third of all
rows reaches a shuffle as one row per map task and leaves the salted step as one row per
salt, so no task ever sees the whole group.

Rows find their group by digest; digests that very many rows have are sent to every task, so
their rows stay where they are (``join_counted``). Which row stays is decided by row, not by
id: of rows that tie on the largest id exactly one.

Defined results: a null text counts as empty; of equal texts one row has ``kept`` true, a row
of the largest id; where that id repeats, or all ids are null (``keep_id`` is then null), it is
one of those rows. Ids may be of any type that has an order. An empty table gives an empty
result; ``exact_groups`` reads no other column, ``drop_exact_copies`` passes all of them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, join_counted, row_columns, whole_row


def _normalised(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _digest(norm: Column | str) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _groups(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """(_digest, _keep, _n): of each text its largest id and its number of rows."""
    norm = docs.select(F.col(id_col).alias("_id"), _normalised(text_col).alias("_norm")).withColumn("_digest", _digest("_norm"))
    # Map-side combining makes one row per text and task; the salt is the task's number, so
    # the merge of a huge group is dealt over `salts` reducers.
    salted = (
        norm.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("_digest", "_salt", "_norm")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    # Dealt by digest alone, so that the content groups and the collision check share one shuffle.
    winners = (
        salted.repartition("_digest")
        .groupBy("_digest", "_norm")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    )
    groups = winners.groupBy("_digest").agg(F.first("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
    # Rows find their group by digest, which moves no text. Two texts under one SHA-256 would
    # make that wrong, so the job stops instead.
    collision = F.raise_error(F.lit("two different texts share a SHA-256 digest"))
    return checkpointed(groups.select("_digest", "_keep", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(collision.cast("long")).alias("_n")))


def _marked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (_id, _digest and others) with _keep, _n and _first: whether it is the row that stays."""
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # Light rows, kept: a row has one number, and texts are hashed once, not for each part of the join.
    rows = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))
    joined = checkpointed(join_counted(rows, groups, ["_digest"], "_n", total))
    tied = joined.where(F.col("_id").eqNullSafe(F.col("_keep"))).select("_digest", "_at")
    first = tied.groupBy("_digest").agg(F.min("_at").alias("_at"))
    return joined.join(first.select("_at", F.lit(True).alias("_first")), "_at", "left")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: its id, the id that stays (the largest), the group's size,
    whether this row stays, and the SHA-256 of the normalised text."""
    rows = docs.select(F.col(id_col).alias("_id"), _digest(_normalised(text_col)).alias("_digest"))
    return _marked(rows, _groups(docs, id_col, text_col, salts)).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_first").isNotNull().alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row of each text, with all its columns: of those with the largest id."""
    groups = _groups(docs, id_col, text_col, salts)
    rows = docs.select(whole_row(docs), F.col(id_col).alias("_id"), _digest(_normalised(text_col)).alias("_digest"))
    # Only rows that may stay go further: as many as there are texts, unless ids tie.
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    may = join_counted(rows, groups, ["_digest"], "_n", total).where(F.col("_id").eqNullSafe(F.col("_keep")))
    may = checkpointed(may.select("_row", "_digest").withColumn("_at", F.monotonically_increasing_id()))
    first = may.groupBy("_digest").agg(F.min("_at").alias("_at"))
    return may.join(first.select("_at"), "_at", "left_semi").select(*row_columns(docs))
