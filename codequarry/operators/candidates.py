"""Candidates of a bundle: merging by id, ranking, header snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import size_penalty

#: Scores by kind of evidence and by import distance.
SCORES = {
    "definition": 1000, "diagnostic": 950, "diff hunk": 850, "entry": 800, "diff file": 800, "reference": 700, "context": 700,
    "barrel": 120, "config": 110, "test": 100,
}
DISTANCE_SCORES = (250, 150, 50)
HEADER_LINES, CHARS_PER_LINE = 80, 80


def distance_score(distance: Column) -> Column:
    return F.when(distance == 1, DISTANCE_SCORES[0]).when(distance == 2, DISTANCE_SCORES[1]).otherwise(DISTANCE_SCORES[2])


def candidate_id(path: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.concat(path, F.lit(":file"))).otherwise(F.concat_ws("", path, F.lit(":"), start, F.lit("-"), end))


def ordered_union(df: DataFrame, id_col: str, reasons: str, seq: str) -> DataFrame:
    """(id, reasons): the distinct reasons of each id in the order they were first given. Each
    reason is reduced to its first place before any are gathered, so an id gathers as many
    entries as it has different reasons, however many rows."""
    given = df.select(F.col(id_col), F.col(seq).alias("_s"), F.posexplode(reasons).alias("_p", "_r"))
    first = given.groupBy(id_col, "_r").agg(F.min(F.struct("_s", "_p")).alias("_at"))
    gathered = F.array_sort(F.collect_list(F.struct("_at", "_r")))
    return first.groupBy(id_col).agg(F.transform(gathered, lambda x: x["_r"]).alias(reasons))


def merge_candidates(df: DataFrame, id_col: str = "id", seq: str = "seq") -> DataFrame:
    """One row per id: highest score, anchor if any is, reasons in order, the rest as first given."""
    rest = [c for c in df.columns if c not in (id_col, "score", "reasons", "anchor", seq)]
    one = df.groupBy(id_col).agg(
        F.max("score").alias("score"),
        F.bool_or("anchor").alias("anchor"),
        F.min(seq).alias(seq),
        F.min_by(F.struct(*rest), F.col(seq)).alias("_rest"),
    )
    said = F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons")
    return one.join(ordered_union(df, id_col, "reasons", seq), id_col, "left").select(id_col, "score", "anchor", said, seq, "_rest.*")


def with_penalty(df: DataFrame) -> DataFrame:
    return df.withColumn("score", (F.col("score") - size_penalty(F.col("estimated_chars"))).cast("int"))


def rank_order() -> list[tuple[str, bool]]:
    """Best first: score, snippets before files, path as read aloud, line, order given.
    The columns ``_file`` and ``_path`` come from ``ranked_columns``."""
    return [("score", True), ("_file", False), ("_path", False), ("_line", False), ("seq", False)]


def ranked_columns(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("_file", F.when(F.col("kind") == "file", 1).otherwise(0))
        .withColumn("_path", F.collate("path", "UNICODE"))
        .withColumn("_line", F.coalesce("start_line", F.lit(0)))
    )


def header_snippets(df: DataFrame, budget_chars: int) -> DataFrame:
    """For anchor files over half the budget: their first lines, at 200 points less."""
    header = df.where(F.col("anchor") & (F.col("kind") == "file") & (F.col("estimated_chars") > budget_chars / 2))
    made = {
        "kind": F.lit("snippet"), "start_line": F.lit(1), "end_line": F.lit(HEADER_LINES),
        "score": (F.col("score") - 200).cast("int"), "anchor": F.lit(False),
        "reasons": F.concat("reasons", F.array(F.lit("header snippet"))),
        "estimated_chars": F.lit(HEADER_LINES * CHARS_PER_LINE).cast("long"),
    }
    header = header.withColumns(made)
    return with_penalty(header.withColumn("id", candidate_id(F.col("path"), F.col("start_line"), F.col("end_line"))))
