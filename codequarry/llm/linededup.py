"""Line dedup by range-partitioned hashes and per-document bitmaps (DataFrame functions only).

A line's key is the line stripped of white space at both ends with A-Z lower-cased; keys
found in at least ``min_docs`` documents lose all their lines (or, with ``keep_first``, all
but the first in document order).

Only hashes travel: lines are range-partitioned by (key hash, document) and sorted by
position within, so a very common line spans as many partitions as it fills; streaming over
that order marks each document's first occurrence, and only the marks are summed per key.
Lines of very common keys meet their counts without a shuffle by key (``join_counted``). The
lines of frequent keys come back per document as a compressed bitmap: the 64-line words
that are not zero. Text is joined with its bitmap once, by document.

Defined results: a null or empty text is one empty line; keys under ``min_chars`` code
points are never dropped; a document is a row's (id, text), so identical repeated rows count
once and lose the same lines, while a null id is an id like any other; an empty table gives
an empty result; an input column whose name clashes with an output column gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, checkpointed, is_heavy, join_counted, partitions, row_columns, whole_row

#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _with_record(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with ``_id``, and ``_t``: a hash that tells rows of the same id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(whole_row(docs), F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_t", F.xxhash64("_text"))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_h, _g, _id, _t, _pos) of every line whose key may be dropped; two hashes with
    different seeds, 128 bits, stand for the key."""
    return (
        _with_record(docs, id_col, text_col)
        .select("_id", "_t", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
        .select("_id", "_t", "_pos", _key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g"), "_id", "_t", "_pos")
    )


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
) -> DataFrame:
    """(_id, _t, words) of each document that loses lines. Bit b of word w says whether line
    64 w + b is kept; words of which every line is kept are left out."""
    # Hashes of lines, read several times below; splitting and normalising texts costs far more.
    lines = checkpointed(_lines(docs, id_col, text_col, min_chars))
    total = lines.count()
    record = ("_h", "_g", "_id", "_t")
    ordered = lines.repartitionByRange(partitions(docs.sparkSession), *record)
    first = F.row_number().over(Window.partitionBy(*record).orderBy("_pos")) == 1
    # Heavy keys are kept whether frequent or not: a document may repeat its own line very often.
    counted = checkpointed(
        ordered.withColumn("_first", first)
        .groupBy("_h", "_g")
        .agg(
            F.count_if("_first").alias("_docs"),
            F.count(F.lit(1)).alias("_rows"),
            F.min(F.struct("_id", "_t", "_pos")).alias("_at"),
        )
        .where((F.col("_docs") >= min_docs) | is_heavy("_rows", total))
    )
    lost = join_counted(lines, counted, ["_h", "_g"], "_rows", total).where(F.col("_docs") >= min_docs)
    if keep_first:
        lost = lost.where(~F.struct("_id", "_t", "_pos").eqNullSafe(F.col("_at")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_pos") % 64)
    words = lost.groupBy("_id", "_t", F.shiftright("_pos", 6).alias("w")).agg(F.bit_or(bit).alias("_lost"))
    return words.groupBy("_id", "_t").agg(
        F.collect_list(F.struct("w", F.bitwise_not("_lost").alias("bits"))).alias("words")
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
) -> DataFrame:
    """``docs`` with their texts cut down to the kept lines, and n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first).select(
        F.col("_id").alias("_bid"), F.col("_t").alias("_bt"), "words"
    )
    records = _with_record(docs, id_col, text_col)
    joined = records.join(
        bitmaps.hint("shuffle_hash"),
        records["_id"].eqNullSafe(F.col("_bid")) & (records["_t"] == F.col("_bt")),
        "left",
    )
    lines = F.split("_text", "\n", -1)
    # One long per 64 lines, so that a line finds its bit by index.
    by_word = F.map_from_entries("words")
    last = F.array_max(F.map_keys(by_word))
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(-1).cast("long")))
    shown = joined.withColumn("_dense", F.when(F.col("words").isNotNull(), dense))
    is_kept = lambda line, i: F.call_function(
        "bit_get", F.coalesce(F.get("_dense", F.call_function("div", i, F.lit(64)).cast("int")), F.lit(-1).cast("long")), i % 64
    ) == 1
    lost = F.aggregate(
        "words", F.lit(0).cast("long"), lambda n, w: n + F.lit(64) - F.bit_count(w["bits"])
    )
    made = [text_col, "n_lines", "n_dropped"]
    return shown.select(
        *row_columns(docs, made),
        F.when(F.col("words").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(lines, is_kept), "\n")).alias(text_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0).cast("long")).alias("n_dropped"),
    )


def line_dedup_digest(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the SHA-256 of what is kept."""
    return dedup_lines(docs.select("doc_id", "text"), **options).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )
