"""Diffs of a repository's revisions, as lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from codequarry.functions.parsing import parse_diff

from .config import UsageError


def diff_text(root: str, revision: str) -> str:
    if revision.startswith("-"):
        raise UsageError(f"not a revision: {revision}")
    done = subprocess.run(["git", "-C", root, "diff", revision, "-U3", "--no-color"], capture_output=True, text=True, check=False)
    if done.returncode:
        raise UsageError(f"git diff {revision}: {done.stderr.strip()}")
    return done.stdout


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    """(line_no, line) of a text held on the driver."""
    return spark.createDataFrame(list(enumerate(text.replace("\r\n", "\n").split("\n"), 1)), "line_no long, line string")


def hunks(spark: SparkSession, text: str) -> DataFrame:
    return parse_diff(text_lines(spark, text))
