"""A training corpus from raw documents: five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read back as the next one's documents. All but the last return the columns of ``documents``.

Defined results, for every stage: rows are documents, whatever their ids - null and repeated
ids are rows like others; columns beyond those of ``documents`` are passed on, whatever their
names (the last stage returns its own); an empty table gives an empty one; missing ``labels``
reject nothing, missing ``benchmark`` items contaminate nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import decontam, jaccard, linededup, packing, quality
from codequarry.llm.common import new_folder, table
from codequarry.shipping import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones. A null text
    is judged as an empty one; equal rows are judged alike; with no labels, or labels of one
    kind alone, every score is their mean, and 0.5 without any."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; ``n_chars`` is counted
    again. A null text becomes an empty one. A document whose every line goes is left with an
    empty text; rows equal in id and text count as one document and lose the same lines."""
    ship(spark)
    cut = linededup.dedup_lines(docs, min_docs=10)
    lengths = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return cut.withColumns(lengths).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share word 5-grams to a similarity of 0.8, directly or over others, one
    stays: that of the smallest id, of equal ids or of unknown ones alone any one row. Texts
    without words link with nothing and stay."""
    ship(spark)
    return jaccard.drop_near_copies(docs, words=5, similarity=(80, 100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a word in twenty or more lies in passages of test items go. Texts
    without words, null ones among them, stay."""
    ship(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of what is left, one row per piece. An empty or null text is its end id alone."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Classifier and packing are beyond SQL; tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
