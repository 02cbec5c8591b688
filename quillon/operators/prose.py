"""Derived relations of documents: paragraphs, sentences, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T


def paragraphs(docs: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, pi, para: the paragraphs of at least `least` words, numbered among themselves."""
    return docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"), least)).alias("pi", "para"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pi, si, sent: the sentences of each paragraph."""
    return paragraphs(docs).select("doc_id", "pi", F.posexplode(T.sentences(F.col("para"))).alias("si", "sent"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, paras, n, opening, resolution, challenge (the index, or null; of equal scores the first).

    Arrays stay with their document, so nothing is shuffled.
    """
    rows = docs.select("doc_id", "text", T.paragraphs(F.col("text")).alias("paras"))
    rows = rows.withColumn("n", F.size("paras").cast("long"))
    end = F.least("n", F.greatest(F.lit(2), F.floor((F.col("n") + 2) / 3)))
    scores = F.transform(F.slice("paras", 1, end.cast("int")), lambda p: T.count(p, P.RULES["challenge"]))
    rows = rows.withColumn("scores", F.when(F.col("n") > 0, scores))
    best = F.array_max("scores")
    return rows.select(
        "doc_id", "text", "paras", "n",
        F.array_join(F.slice("paras", 1, 2), "\n\n").alias("opening"),
        F.coalesce(F.when(F.col("n") > 0, F.element_at("paras", -1)), F.lit("")).alias("resolution"),
        F.when(best > 0, F.array_position("scores", best) - 1).alias("challenge"),
    )
