"""Command line: `python -m quillon slop|check|analyze|score|profiles ...`.

Each command is a function from a session and its arguments to a relation, which
is printed as JSON lines, as text, or written under --out.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import annotate, features, lexical, report, rubric, rules, tagged, tells
from quillon.sources import files
from quillon.sources.profiles import Profiles

#: Rubrics by name: their dimensions, and what finds.
RUBRICS = {
    "slop": (rubric.SLOP, lambda docs, norm: tells.findings(docs, norm, annotate.rhythm(docs))),
    "schimel": (rubric.SCHIMEL, lambda docs, norm: _schimel(_prose(docs))),
    "density": (rubric.DENSITY, lambda docs, norm: _density(_prose(docs))),
}


def _prose(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", T.prepared(F.col("text")))


def _schimel(docs: DataFrame) -> DataFrame:
    return rules.findings(docs).unionByName(tagged.findings(annotate.tokens(docs), docs))


def _density(docs: DataFrame) -> DataFrame:
    return tagged.density(annotate.tokens(docs), docs, lexical.zipf(docs))


def _profile(spark: SparkSession, root: str, name: str, bucket: str) -> DataFrame:
    rows = Profiles(spark, root).table().where((F.col("profile") == name) & (F.col("bucket") == bucket))
    return rows.select(F.xxhash64("name").alias("doc_id"), "text")


def check(spark: SparkSession, path: str, rubric_name: str, as_text: bool = False, root: str | None = None, profile: str | None = None) -> DataFrame:
    """A rubric's verdicts for the files under path, by a profile's own norm if one is named (slop alone has one)."""
    docs = files.documents(spark, path)
    weights, find = RUBRICS[rubric_name]
    norm = None
    if profile and rubric_name == "slop":
        own = _profile(spark, root, profile, "exemplars")
        norm = tells.baseline(own).unionByName(tells.norm_of(annotate.rhythm(own)))
    found = find(docs, norm)
    out = rubric.result(docs, found, weights)
    out = rubric.render(out, found, rubric_name, weights) if as_text else out
    return docs.select("doc_id", "path").join(out, "doc_id").drop("doc_id")


def analyze(spark: SparkSession, path: str) -> DataFrame:
    docs = files.documents(spark, path)
    return docs.select("doc_id", "path").join(features.analyze(docs), "doc_id").drop("doc_id")


def score(spark: SparkSession, path: str, root: str, profile: str) -> DataFrame:
    """The voice report of the files under path against a profile's exemplars, without vectors."""
    docs = files.documents(spark, path)
    contrast = _profile(spark, root, profile, "contrast")
    out = report.voice_report(docs, _profile(spark, root, profile, "exemplars"), contrast if contrast.take(1) else None)
    return docs.select("doc_id", "path").join(out, "doc_id").drop("doc_id")


def profiles(spark: SparkSession, root: str, add: str | None = None, bucket: str = "exemplars", path: str | None = None) -> DataFrame:
    """The profiles under root, after adding the files under path to one."""
    if add:
        docs = files.documents(spark, path)
        Profiles(spark, root).add(add, bucket, docs.select(F.element_at(F.split("path", "/"), -1).alias("name"), "text"))
    return Profiles(spark, root).summary()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quillon")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("slop", "check", "analyze", "score"):
        one = commands.add_parser(name)
        one.add_argument("path")
        one.add_argument("--out", help="a folder for the rows as JSON lines")
        if name != "analyze":
            one.add_argument("--root", help="where the profiles are")
            one.add_argument("--profile", required=name == "score")
        if name in ("slop", "check"):
            one.add_argument("--text", action="store_true", help="reports to read")
        if name == "check":
            one.add_argument("--rubric", choices=sorted(RUBRICS), default="schimel")
    one = commands.add_parser("profiles")
    one.add_argument("root")
    one.add_argument("--add")
    one.add_argument("--bucket", default="exemplars")
    one.add_argument("--path")
    return out


def rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command in ("slop", "check"):
        return check(spark, a.path, "slop" if a.command == "slop" else a.rubric, a.text, a.root, a.profile)
    if a.command == "score":
        return score(spark, a.path, a.root, a.profile)
    return analyze(spark, a.path) if a.command == "analyze" else profiles(spark, a.root, a.add, a.bucket, a.path)


def main(given: list[str] | None = None) -> int:
    a = parser().parse_args(given)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    found = rows(spark, a)
    if getattr(a, "out", None):
        files.write(found, a.out)
        return 0
    text = F.concat_ws("\n", "path", "report", F.lit("")) if getattr(a, "text", False) else F.to_json(F.struct(*found.columns), {"ignoreNullFields": "false"})
    for row in found.select(text.alias("line")).toLocalIterator():  # a partition at a time
        print(row["line"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
