"""What every rubric does with its findings: dimensions, overall score, verdict, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T

# Penalties by severity, order of severities, weights of dimensions.
PENALTY = {"high": 0.25, "medium": 0.10, "low": 0.05}
RANK = {"high": 0, "medium": 1, "low": 2}
SLOP = {"diction": 1.0, "construction": 1.0, "rhythm": 1.0, "formatting": 1.0}
SCHIMEL = {"opening": 1.25, "challenge": 1.25, "resolution": 1.25, "flow": 1.25, "paragraphs": 1.0, "sentences": 1.0, "clarity": 1.0}
DENSITY = {"density": 1.0, "jargon": 1.0}
DECISIVE = ("challenge", "resolution", "opening")


def _by(severity: str, values: dict) -> F.Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col(severity) == name, F.lit(value)).otherwise(out)
    return out


def together(*found: DataFrame, by: str = "rule") -> DataFrame:
    """All rows of relations with the same columns, dealt by doc_id and `by` behind the union.

    Spark takes a union of relations dealt alike by doc_id for dealt itself, and leaves out shuffles
    that its readers need; adaptive execution may then deal some of the relations anew. None of them
    is dealt by `by`, so this shuffle stays, and what groups or ranks by both needs no other.
    """
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.repartition("doc_id", by)


def result(docs: DataFrame, findings: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, overall, verdict, dim_<name>, findings (count) for each of docs.

    A rule costs its dimension one penalty, that of its first finding, however
    many findings it has.
    """
    by_rule = findings.groupBy("doc_id", "dimension", "rule").agg(
        F.min_by(_by("severity", PENALTY), "ord").alias("penalty"), F.max((F.col("severity") == "high").cast("int")).alias("high"), F.count(F.lit(1)).alias("n")
    )
    lost = by_rule.groupBy("doc_id").agg(
        F.sum("n").alias("findings"),
        F.max(F.when(F.col("dimension").isin(*DECISIVE), F.col("high")).otherwise(0)).alias("decisive"),
        *(F.sum(F.when(F.col("dimension") == d, F.col("penalty"))).alias(f"lost_{d}") for d in weights),
    )
    # the sum of penalties is rounded, since its order isn't fixed
    dims = {d: F.greatest(F.lit(0.0), 1 - F.round(F.coalesce(f"lost_{d}", F.lit(0.0)), 6)) for d in weights}
    rows = docs.select("doc_id").join(lost, "doc_id", "left").select("doc_id", *(c.alias(f"dim_{d}") for d, c in dims.items()), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("decisive", F.lit(0)).alias("decisive"))
    overall = sum(F.col(f"dim_{d}") * w for d, w in weights.items()) / sum(weights.values())
    rows = rows.withColumn("overall", overall)
    verdict = F.when((F.col("overall") < 0.55) | (F.col("decisive") == 1), "fail").when(F.col("overall") < 0.75, "warn").otherwise("pass")
    return rows.select("doc_id", F.round("overall", 6).alias("overall"), verdict.alias("verdict"), *(F.round(f"dim_{d}", 6).alias(f"dim_{d}") for d in weights), "findings")


def ranked(findings: DataFrame) -> DataFrame:
    """findings with place: their order by severity, then as they were found."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(_by("severity", RANK), "ord")))


def _two(x: F.Column) -> F.Column:
    """A number from 0 to 1 with two digits, rounded from its exact binary value, ties to even."""
    scaled = (x * F.lit(float(2**52))).cast("long") * 100
    whole, rest = F.shiftright(scaled, 52), scaled.bitwiseAND(F.lit(2**52 - 1))
    up = (rest > 2**51) | ((rest == 2**51) & (whole % 2 == 1))
    whole = whole + up.cast("long")
    return F.format_string("%d.%02d", F.floor(whole / 100), whole % 100)


def render(results: DataFrame, findings: DataFrame, rubric: str, weights: dict[str, float]) -> DataFrame:
    """doc_id, report: the verdict, the dimensions and the first five findings as text."""
    top = ranked(findings).where("place <= 5").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "paragraph", "dimension", "rule", "message"))).alias("top"))
    place = lambda f: F.coalesce(F.concat(F.lit("P"), f["paragraph"].cast("string")), f["dimension"])
    lines = F.transform("top", lambda f: F.concat(F.lit("- "), place(f), F.lit(": "), f["rule"], F.lit("; "), f["message"]))
    head = F.concat(F.lit(f"{rubric}: "), F.upper("verdict"), F.lit(" ("), _two(F.col("overall")), F.lit(")"))
    dims = [F.concat(F.rpad(F.lit(d), 12, " "), F.lit(" "), _two(F.col(f"dim_{d}"))) for d in weights]
    found = F.when(F.size("top") > 0, F.concat(F.lit("\n\nTop findings\n"), F.concat_ws("\n", lines))).otherwise(F.lit(""))
    return results.join(top, "doc_id", "left").select("doc_id", F.concat(head, F.lit("\n\n"), F.concat_ws("\n", *dims), F.coalesce(found, F.lit(""))).alias("report"))


def dashboard(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """rule, n, per_1000_words, severity (the most frequent; of equals the gravest) over a corpus."""
    words = docs.agg(F.sum(T.tokens(F.col("text"))).alias("words"))
    by = findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", _by("severity", RANK))
    rules = by.groupBy("rule").agg(F.sum("n").alias("n"), F.max_by("severity", F.struct("n", -F.col("rank"))).alias("severity"))
    return rules.crossJoin(F.broadcast(words)).select("rule", "n", F.round(F.lit(1000.0) * F.col("n") / F.greatest("words", F.lit(1)), 4).alias("per_1000_words"), "severity")
