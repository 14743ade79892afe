"""A Parquet index of parsed files that is brought up to date by what changed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from codequarry import __version__
from codequarry.extract.index import parse_files
from codequarry.functions.text import content_hash
from codequarry.operators.scratch import kept
from codequarry.sources.config import Config
from codequarry.sources.edge_json import read_edges, write_edges


def store_key(root: str, config: Config) -> str:
    """Names the store of a root under a configuration and a version of this package."""
    seen = json.dumps([config.ignore, config.import_roots], sort_keys=True)
    return hashlib.sha1(f"{root}|{hashlib.sha1(seen.encode()).hexdigest()}|{__version__}".encode()).hexdigest()


def _load(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def _last(spark: SparkSession, folder: str) -> int:
    pointer = _load(spark, f"{folder}/pointer")
    return pointer.agg(F.max("generation")).first()[0] if pointer is not None else 0


def compare(known: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of files against the stored ones. Files of the stored size and time count
    as unchanged; of the others the contents are hashed and decide."""
    old = known.select("path", F.col("size").alias("_size"), F.col("mtime_ms").alias("_mtime"), F.col("hash").alias("_hash"))
    same = (F.col("size") == F.col("_size")) & (F.col("mtime_ms") == F.col("_mtime"))
    # Only evaluated where size or time differ.
    status = (
        F.when(F.col("_hash").isNull(), "added").when(F.col("size").isNull(), "removed").when(same, "unchanged")
        .when(content_hash(F.col("content")) == F.col("_hash"), "unchanged").otherwise("changed")
    )
    return files.select("path", "size", "mtime_ms", "content").join(old, "path", "full_outer").select("path", status.alias("status"))


def refresh(files: DataFrame, folder: str) -> DataFrame:
    """Bring the store at ``folder`` up to date with ``files`` and return its records.

    Only files that are new or whose content changed are parsed; records of others are
    carried over, those of removed files go. A generation is written beside the last one and
    then named by a pointer, so a failure leaves the old one in force.
    """
    spark = files.sparkSession
    last = _last(spark, folder)
    base = f"{folder}/generation={last}"
    if not last:
        records = parse_files(files)
    else:
        diff = kept(compare(spark.read.parquet(f"{base}/files"), files))
        if diff.where("status <> 'unchanged'").isEmpty():
            return spark.read.parquet(f"{base}/records")
        same = diff.where("status = 'unchanged'").select("path")
        fresh = files.join(same, "path", "left_anti")
        records = spark.read.parquet(f"{base}/records").join(same, "path", "left_semi").unionByName(parse_files(fresh))
    new = f"{folder}/generation={last + 1}"
    hashed = files.select("path", "size", "mtime_ms", content_hash(F.col("content")).alias("hash"))
    hashed.write.mode("overwrite").parquet(f"{new}/files")
    records.write.mode("overwrite").parquet(f"{new}/records")
    spark.range(1).select(F.lit(last + 1).alias("generation")).write.mode("append").parquet(f"{folder}/pointer")
    return spark.read.parquet(f"{new}/records")


def status(files: DataFrame, folder: str) -> DataFrame:
    """(path, status) of the files against the store: what a refresh would parse."""
    last = _last(files.sparkSession, folder)
    if not last:
        return files.select("path", F.lit("added").alias("status"))
    return compare(files.sparkSession.read.parquet(f"{folder}/generation={last}/files"), files)


def save_edges(edges: DataFrame, folder: str) -> None:
    """Keep resolved import edges (src, dst, edge_type) beside the records, as JSON by file."""
    write_edges(edges).write.mode("overwrite").parquet(f"{folder}/generation={_last(edges.sparkSession, folder)}/edges")


def stored_edges(spark: SparkSession, folder: str) -> DataFrame | None:
    """The edges of the generation in force, if they were kept."""
    return load_edges(spark, folder) if _load(spark, f"{folder}/generation={_last(spark, folder)}/edges") is not None else None


def load_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that were kept last; those in the older form are read as well."""
    stored = spark.read.parquet(f"{folder}/generation={_last(spark, folder)}/edges")
    return read_edges(stored, F.concat(F.lit("{"), F.to_json(F.array("src")).substr(F.lit(2), F.length(F.to_json(F.array("src"))) - 2), F.lit(":"), F.col("targets"), F.lit("}")))
