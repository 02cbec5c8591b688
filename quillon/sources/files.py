"""Corpora of .md, .txt and .tex files as documents, and sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T

SUFFIXES = ("md", "txt", "tex")
#: What Spark lists at all, so that other files are never opened.
GLOB = "*.{" + ",".join(x for s in SUFFIXES for x in (s, s.upper())) + "}"


def documents(spark: SparkSession, paths: str | list[str], keep_frontmatter: bool = True) -> DataFrame:
    """doc_id (a hash of the path), path, text of the files of SUFFIXES under paths; raises where there are none."""
    rows = spark.read.option("pathGlobFilter", GLOB).text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    text = F.col("text") if keep_frontmatter else T.markup_step(F.col("text"), "strip_frontmatter")
    rows = rows.select(F.xxhash64("path").alias("doc_id"), "path", text.alias("text"))
    if not rows.take(1):
        raise FileNotFoundError(f"no file of {', '.join(SUFFIXES)} under {paths}")
    return rows


def one(spark: SparkSession, text: str) -> DataFrame:
    """A given text as a document."""
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def norms(spark: SparkSession, path: str) -> DataFrame:
    """lemma, concreteness of a (gzipped) CSV with a header."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.lower("lemma").alias("lemma"), F.col("concreteness").cast("double").alias("concreteness"))


def write(features: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Feature rows as JSON lines, or as CSV without the columns that hold JSON."""
    if kind == "csv":
        features.drop(*(c for c in features.columns if c.endswith("_json"))).write.csv(path, header=True)
    else:
        features.write.option("ignoreNullFields", "false").json(path)
