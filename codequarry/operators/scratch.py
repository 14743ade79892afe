"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in reliable storage (``spark.checkpoint.dir``; a folder of the
    driver's own only where the session names none and all runs on one machine). What has been
    kept already, and nothing done to since, is returned as it is."""
    if df._jdf.queryExecution().logical().getClass().getSimpleName() == "LogicalRDD":
        return df
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="codequarry-"))
    return df.checkpoint(eager=True)
