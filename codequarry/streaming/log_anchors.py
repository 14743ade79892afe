"""Diagnostics of a log that is still being written, as a stream of anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.parsing import LOG_REACH, log_line, log_path


def stream_anchors(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(path, line, start_line, end_line, ts): each place once within the watermark, from a
    stream of (ts, line). State is dropped as the watermark passes."""
    found = lines.withWatermark("ts", delay).select("ts", log_path(F.col("line")).alias("path"), log_line(F.col("line")).alias("line"))
    once = found.where("path IS NOT NULL").dropDuplicatesWithinWatermark(["path", "line"])
    return once.select("path", "line", F.greatest(F.lit(1), F.col("line") - LOG_REACH).alias("start_line"), (F.col("line") + LOG_REACH).alias("end_line"), "ts")
