"""Markers of formulaic prose: counts, rates, corpus norms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import rubric


#: The tells that text alone shows; `annotate.rhythm` has the two that need parts of speech.
PLAIN = (*P.TELLS, "staccato_run")
#: Places in reports.
ORDER = {name: i for i, name in enumerate(P.TELL_META)}


def _count(name: str) -> Column:
    return T.short_runs(F.col("sents")) if name == "staccato_run" else T.count(F.col("body"), P.TELLS[name])


def _first(name: str) -> Column:
    return T.first_short_run(F.col("sents")) if name == "staccato_run" else T.trim(T.first(F.col("body"), P.TELLS[name]))


def _bodies(docs: DataFrame, text: str = "text") -> DataFrame:
    rows = docs.select("doc_id", T.body(F.col(text)).alias("body"))
    return rows.select("doc_id", "body", T.worded(F.col("body")).alias("sents"))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' doc_id with the body, its sentences and words and a count for each tell of text alone: one scan, no shuffle."""
    return _bodies(docs, text).select("doc_id", "body", "sents", T.words(F.col("body")).alias("words"), *(_count(name).alias(name) for name in PLAIN))


def rates(docs: DataFrame) -> DataFrame:
    """doc_id, tell_<name>: occurrences per 1000 words."""
    return counts(docs).select("doc_id", *(T.per_1000(F.col(n), F.col("words")).alias(f"tell_{n}") for n in PLAIN))


@F.arrow_udf(IntegerType())
def _likely(body: pa.Array) -> pa.Array:
    """A bit for each of P.TELLS, set where its loose pattern is found."""
    bits = np.zeros(len(body), np.int32)
    for i, pattern in enumerate(P.TELLS.values()):
        bits |= pc.match_substring_regex(body, pattern.loose).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int32) << i
    return pa.array(bits)


def sifted(docs: DataFrame) -> DataFrame:
    """`rates` for many long documents: a tell is counted where RE2, by a looser pattern in an Arrow batch, finds that it may occur."""
    rows = docs.select("doc_id", T.body(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "body", _likely("body").alias("likely"), T.sentence_lengths(F.col("body")).alias("lengths"))
    counted = {name: F.when(F.col("likely").bitwiseAND(1 << i) != 0, _count(name)).otherwise(F.lit(0).cast("long")) for i, name in enumerate(P.TELLS)}
    counted["staccato_run"] = T.short_runs_of(F.col("lengths"))
    words = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    rows = rows.select("doc_id", words.alias("words"), *(counted[name].alias(name) for name in PLAIN))
    return rows.select("doc_id", *(T.per_1000(F.col(n), F.col("words")).alias(f"tell_{n}") for n in PLAIN))


def long(docs: DataFrame) -> DataFrame:
    """doc_id, tell, ord, n, rate, span (the first match): a row for each tell of text alone and each document."""
    found = counts(docs)
    each = [
        F.struct(
            F.lit(name).alias("tell"), F.lit(ORDER[name]).alias("ord"), F.col(name).alias("n"),
            T.per_1000(F.col(name), F.col("words")).alias("rate"),
            F.when(F.col(name) > 0, F.substring(_first(name), 1, 220)).otherwise(F.lit("")).alias("span"),
        )
        for name in PLAIN
    ]
    return found.select("doc_id", F.inline(F.array(*each)))


def one(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, n, rate of one tell."""
    rows = _bodies(docs).select("doc_id", _count(name).alias("n"), T.words(F.col("body")).alias("words"))
    return rows.select("doc_id", "n", T.per_1000(F.col("n"), F.col("words")).alias("rate"))


def baseline(docs: DataFrame) -> DataFrame:
    """tell, mean, std: a corpus' norm of each tell (population deviation), from one pass of partial aggregates.

    A corpus without documents has no norm: reading it raises an error.
    """
    wide = rates(docs).agg(F.count(F.lit(1)).alias("n"), *(f(f"tell_{n}").alias(f"{k}_{n}") for n in PLAIN for k, f in (("mean", F.avg), ("std", F.stddev_pop))))
    wide = wide.where(F.assert_true(F.col("n") > 0, F.lit("a norm needs a corpus of at least one document")).isNull())
    each = [F.struct(F.lit(n).alias("tell"), F.col(f"mean_{n}").alias("mean"), F.col(f"std_{n}").alias("std")) for n in PLAIN]
    return wide.select(F.inline(F.array(*each)))


def norm_of(rows: DataFrame) -> DataFrame:
    """tell, mean, std of rows as `long` has them."""
    return rows.groupBy("tell").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"))


def meta(what: int, tell: Column) -> Column:
    """Label (0), dimension (1) or prior weight (2) of a tell."""
    arms = [F.lit(x) for name, m in P.TELL_META.items() for x in (name, m[what])]
    return F.create_map(*arms)[tell]


def findings(docs: DataFrame, norm: DataFrame | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """doc_id, ord, severity, dimension, rule, paragraph, sentence, span, message of the tells that fire.

    Without a norm each tell that occurs fires, by its prior weight; with one (see
    `baseline`) those whose rate lies more than a deviation above it. tagged has the tells
    that need parts of speech (`annotate.rhythm` of the same documents).
    """
    rows = long(docs) if tagged is None else rubric.together(long(docs), tagged, by="tell")
    rows = rows.where("n > 0")
    count = F.concat(F.col("n").cast("string"), F.lit("× "), meta(0, F.col("tell")))
    if norm is None:
        prior = meta(2, F.col("tell"))
        severity = F.when(prior >= 0.5, "high").when(prior >= 0.3, "medium").otherwise("low")
        message = F.concat(count, F.lit(" — reads like a machine's habit; vary it or leave it out."))
    else:
        scale = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
        rows = rows.join(F.broadcast(norm), "tell")  # a row a tell
        rows = rows.withColumn("z", (F.col("rate") - F.col("mean")) / scale).where("z > 1")
        severity = F.when(F.col("z") >= 3, "high").when(F.col("z") >= 2, "medium").otherwise("low")
        how = F.when(F.col("z") >= 3, "far above").when(F.col("z") >= 2, "well above").otherwise("above")
        message = F.concat(count, F.lit(" — "), how, F.lit(" your corpus norm; use it less."))
    return rows.select(
        "doc_id", "ord", severity.alias("severity"), meta(1, F.col("tell")).alias("dimension"), F.col("tell").alias("rule"),
        F.lit(None).cast("long").alias("paragraph"), F.lit(None).cast("long").alias("sentence"), "span", message.alias("message"),
    )
