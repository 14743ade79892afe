"""Helpers shared by the corpus operators: inputs, shared scratch space, session settings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII capitals and what they become; other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder, by whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else. Where bytes and code points agree in number the
    text is ASCII, and the much faster ``lower`` does the same."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where the session
    names none, a folder of this machine serves, but only if everything runs on it, as in tests."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if here:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(here)
        return here
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="codequarry-checkpoint-"))
    return context.getCheckpointDir()


#: Whether the shuffles of an action go at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that losing an executor costs
    no more than the tasks it was running. Spark drops the files with the last use. The shuffles
    that led there aren't needed any more and go at once, not when the driver next collects garbage;
    a plan takes that from the setting in force when it is made, hence the selection."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared folder for files that an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as the struct ``_row``, so that an operator's own names can't
    clash with any of them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def row_columns(df: DataFrame, made: list[str] | tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` out of ``_row`` again, without those that the operator makes: a
    made name wins over an input column of that name (compared without case, as Spark does)."""
    taken = {m.lower() for m in made}
    return [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c.lower() not in taken]


#: A key with more than one in this many of all rows is heavy; fewer keys than that can be.
HEAVY = 10_000


def is_heavy(rows: str, total: int) -> Column:
    return F.col(rows) * HEAVY > F.lit(total)


def join_counted(left: DataFrame, counted: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of ``left``, of ``total`` rows, with ``counted``: one row per key, whose
    column ``rows`` says how many rows of ``left`` have it. Heavy keys, fewer than ``HEAVY`` of
    them whatever the input's size, are sent to every task and their rows stay where they are;
    the rest is shuffled, where no key can fill a task. ``counted`` is read three times."""
    heavy = F.broadcast(counted.where(is_heavy(rows, total)))
    light = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return left.join(heavy, keys).unionByName(light.join(counted.where(~is_heavy(rows, total)), keys))
