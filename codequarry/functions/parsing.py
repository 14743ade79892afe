"""Logs and diffs as column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a log line may look like, in the order tried; then the groups of path and line.
_PATH = r"[A-Za-z0-9_\-./\\]+?"
LOG_PATTERNS = (
    (r"at .+? \(([^)]+?\.(tsx|ts|jsx|js)):(\d+):(\d+)\)", 1, 3),
    (rf"(?:FAIL|PASS|❯|›)\s+({_PATH}\.(tsx|ts|jsx|js))(?::(\d+))?", 1, 3),
    (rf"({_PATH}\.py):(\d+):\s*(?:error|warning|note):", 1, 2),
    (rf"({_PATH}\.py):(\d+):(\d+)\s*-\s*(?:error|warning|information):", 1, 2),
    (r"File \"([^\"]+\.py)\", line (\d+)", 1, 2),
    (rf"({_PATH}\.(tsx|ts|jsx|js)):(\d+)(?::(\d+))?", 1, 3),
    (rf"({_PATH}\.py):(\d+)(?::(\d+))?", 1, 2),
)
LOG_REACH = 3


def _cascade(line: Column, which: int) -> Column:
    out = F.lit(None).cast("string")
    for pattern, *groups in reversed(LOG_PATTERNS):
        out = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, groups[which])).otherwise(out)
    return out


def log_path(line: Column) -> Column:
    return _cascade(line, 0)


def log_line(line: Column) -> Column:
    """The line number; 1 where the pattern gives none."""
    found = _cascade(line, 1)
    return F.when(found == "", 1).otherwise(found.cast("int"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(path, line, start_line, end_line), each path and line once, from (line_no, line)."""
    found = lines.select("line_no", log_path(F.col("line")).alias("path"), log_line(F.col("line")).alias("at")).where("path IS NOT NULL")
    return found.groupBy("path", "at").agg(F.min("line_no").alias("line_no")).select(
        "path", F.col("at").alias("line"), F.greatest(F.lit(1), F.col("at") - LOG_REACH).alias("start_line"),
        (F.col("at") + LOG_REACH).alias("end_line"), "line_no",
    )


def parse_diff(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(path, start_line, end_line) of the hunks of a unified diff, from (line_no, line), for
    each diff named by ``keys``. The file in force is carried forward over the lines; its header
    may or may not have the prefix ``b/``. Without keys the lines are one diff, in one task."""
    line, keys = F.col("line"), keys or []
    # /dev/null ends a file: an empty name, dropped below.
    named = F.btrim(F.substr(line, F.lit(5)), F.lit(" \t\r"))
    plain = F.when(named.startswith("b/"), F.substr(named, F.lit(3))).otherwise(named)
    marker = F.when(line.startswith("+++ "), F.when(named == "/dev/null", "").otherwise(plain))
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("path", F.last(marker, ignorenulls=True).over(order))
    hunk = r"^@@[^+]*\+([0-9]+)(?:,([0-9]+))?"
    start = F.regexp_extract(line, hunk, 1).cast("int")
    count = F.regexp_extract(line, hunk, 2)
    length = F.when(count == "", 1).otherwise(count.cast("int"))
    return carried.where(line.rlike(hunk) & (F.col("path") != "")).select(
        *keys, "path", start.alias("start_line"), F.greatest(start, start + length - 1).alias("end_line"), "line_no"
    )
