"""Table functions for SQL users: a log or a diff as one text, its places as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .parsing import LOG_PATTERNS, LOG_REACH


@udtf(returnType="path string, line int, start_line int, end_line int, line_no int")
class ParseLog:
    """``SELECT * FROM parse_log('...')``: each place once, as ``parse_log`` does for lines."""

    def eval(self, text: str) -> Iterator[tuple]:
        seen = set()
        for n, said in enumerate((text or "").replace("\r\n", "\n").split("\n"), 1):
            for pattern, *groups in LOG_PATTERNS:
                if m := re.search(pattern, said):
                    path, line = m[groups[0]], int(m[groups[1]] or 1)
                    if (path, line) not in seen:
                        seen.add((path, line))
                        yield path, line, max(1, line - LOG_REACH), line + LOG_REACH, n
                    break


@udtf(returnType="path string, start_line int, end_line int, line_no int")
class ParseDiff:
    """``SELECT * FROM parse_diff('...')``: the hunks of a unified diff."""

    def eval(self, text: str) -> Iterator[tuple]:
        path = ""
        for n, said in enumerate((text or "").replace("\r\n", "\n").split("\n"), 1):
            if said.startswith("+++ "):
                path = said[4:].strip(" \t\r")
                path = "" if path == "/dev/null" else path.removeprefix("b/")
            elif said.startswith("@@") and path and (m := re.match(r"@@[^+]*\+([0-9]+)(?:,([0-9]+))?", said)):
                start, length = int(m[1]), int(m[2] or 1)
                yield path, start, max(start, start + length - 1), n


def register(spark: SparkSession) -> None:
    """Make ``parse_log`` and ``parse_diff`` known to the session's SQL."""
    spark.udtf.register("parse_log", ParseLog)
    spark.udtf.register("parse_diff", ParseDiff)
