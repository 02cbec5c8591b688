"""What a draft's author reads: every group of axes against a corpus, and the moves that would help, as one row a draft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import lexical, structure, tells, voice

#: The axes of raw markup.
MARKUP = (
    "struct_heading_count", "struct_max_heading_depth", "struct_code_char_ratio", "struct_list_item_ratio", "struct_ordered_list_ratio", "struct_bullet_list_ratio",
    "struct_table_count", "struct_frontmatter_field_count", "struct_line_count", "struct_inline_code_char_ratio", "struct_external_ref_count",
)


def _axes(docs: DataFrame, axes: dict[str, Column]) -> DataFrame:
    return docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("axis"), c.alias("value")) for n, c in axes.items()))))


def hedge_values(docs: DataFrame) -> DataFrame:
    """doc_id, axis, value of hedges and boosters."""
    return _axes(docs, {n.removesuffix("_rate"): c for n, c in lexical.hedge_metric(F.col("text")).items()})


def fw_values(docs: DataFrame) -> DataFrame:
    """doc_id, axis, value of the closed classes of words."""
    return _axes(docs, lexical.function_words(F.col("text")))


def own_norm(values: DataFrame) -> DataFrame:
    """axis, mean, spread of a corpus' values, without a prior."""
    return values.groupBy("axis").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """A group of axes as one array a document: a report's rows are few by construction."""
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def moves(docs: DataFrame, exemplars: DataFrame, contrast: DataFrame | None = None) -> DataFrame:
    """id, place, name, move: the tells that a draft should use less, against exemplars.

    Without contrast every tell is trusted; with it, as far as it tells the two apart, and by its own prior at least.
    """
    rate = lambda d: tells.long(d).select("doc_id", F.concat(F.lit("tell_"), "tell").alias("name"), F.col("rate").alias("value"))
    own = rate(exemplars)
    norm = own.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    if contrast is None:
        weights = norm.select("name", F.lit(1.0).alias("confidence"))
    else:
        both = own.withColumn("y", F.lit(1.0)).unionByName(rate(contrast).withColumn("y", F.lit(0.0)))
        weights = voice.floored(voice.confidence(both))
    spread = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    z = rate(docs).join(F.broadcast(norm), "name").select(F.col("doc_id").alias("id"), "name", ((F.col("value") - F.col("mean")) / spread).alias("z"))  # a row a tell
    return voice.direction(z, weights)


def voice_report(docs: DataFrame, exemplars: DataFrame, contrast: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """doc_id, direction, markdown, hedge, fw, and of judged (`voice.judged` of the drafts' vectors) distance, normalized, on_voice.

    Markup is read raw, everything else from plain prose. A draft of which nothing
    is off has an empty direction.
    """
    plain = lambda d: d.select("doc_id", T.prepared(F.col("text")).alias("text"))
    draft, corpus = plain(docs), plain(exemplars)
    columns = ("axis", "value", "reference_mean", "z", "direction")
    markup = voice.axis_report(structure.long(docs, list(MARKUP)), own_norm(structure.long(exemplars, list(MARKUP))))
    out = docs.select("doc_id").join(_listed(moves(draft, corpus, plain(contrast) if contrast is not None else None).withColumnRenamed("id", "doc_id"), "direction", "place", "name", "move"), "doc_id", "left")
    groups = {"markdown": markup, "hedge": voice.prior_report(hedge_values(draft), hedge_values(corpus)), "fw": voice.prior_report(fw_values(draft), fw_values(corpus))}
    for name, rows in groups.items():
        out = out.join(_listed(rows, name, *columns), "doc_id", "left")
    if judged is not None:
        out = out.join(judged.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.withColumn("direction", F.coalesce("direction", F.array().cast("array<struct<place:bigint,name:string,move:string>>")))
