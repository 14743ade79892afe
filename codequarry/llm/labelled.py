"""What the two text classifiers share: the training rows and the logistic function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def id_crc(id_col: str) -> Column:
    """crc32 of the id written out as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(_text, _y) of at most ``limit`` labelled ids that aren't held out: those with the
    smallest hashes, so the choice doesn't hang on order or partitions. An id labelled 0 and 1
    at once isn't used; of rows that repeat an id one is, that of the smallest hash of its text."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out)
    agreed = usable.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("int").alias("_y"), F.max(label).cast("int").alias("_other"))
    chosen = checkpointed(agreed.where("_y = _other").select("_id", "_y").orderBy(F.xxhash64("_id"), "_id").limit(limit))
    # At most `limit` pairs of numbers, whatever the tables' size.
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id")
    one = found.groupBy("_id").agg(F.min_by(F.struct("_text", "_y"), F.xxhash64("_text")).alias("_one"))
    return one.select("_one._text", "_one._y")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
