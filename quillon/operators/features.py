"""One row of features for each document, and the features that only that row has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import lexical, structure

#: Words that a draw for HD-D holds.
DRAW = 42


def _spread(rows: DataFrame, *names: str) -> DataFrame:
    """rows with <name>_mean, <name>_median and <name>_std (population deviation) of arrays of numbers; null for an empty one.

    The means are columns before the deviations read them: within the lambda they would be added up anew for each number.
    """
    n = {name: F.size(name) for name in names}
    rows = rows.select("*", *((F.aggregate(name, F.lit(0.0), lambda t, x: t + x) / F.nullif(n[name], F.lit(0))).alias(f"{name}_mean") for name in names), *(F.sort_array(name).alias(f"{name}_ordered") for name in names))
    for name in names:
        mean, ordered = F.col(f"{name}_mean"), F.col(f"{name}_ordered")
        middle = (F.get(ordered, F.floor((n[name] - 1) / 2).cast("int")) + F.get(ordered, F.floor(n[name] / 2).cast("int"))) / 2.0
        squares = F.aggregate(name, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / F.nullif(n[name], F.lit(0))  # noqa: B023
        rows = rows.withColumns({f"{name}_median": F.when(n[name] > 0, middle), f"{name}_std": F.sqrt(squares)})
    return rows


def descriptive(docs: DataFrame) -> DataFrame:
    """doc_id, 14 columns desc_<name>: counts, and mean, median and deviation of the lengths of words and sentences and of syllables.

    Words are runs of letters and digits, syllables groups of vowels (one at least).
    An empty text has counts of 0 and no lengths.
    """
    rows = docs.select("doc_id", T.every(F.lower(F.col("text")), P.Pattern(r"[\p{L}\p{N}]+")).alias("w"), F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: T.sentences(p))).alias("s"))
    rows = rows.select(
        "doc_id", "w", F.size("s").cast("long").alias("sentences"), F.transform("w", lambda x: F.length(x)).alias("token_length"),
        F.transform("s", lambda x: T.count(x, P.Pattern(r"[\p{L}\p{N}]+"))).alias("sentence_length"),
        F.transform("w", lambda x: F.greatest(F.lit(1), F.regexp_count(x, F.lit("[aeiouy]+")))).alias("syllables_per_token"),
    )
    lengths = ("token_length", "sentence_length", "syllables_per_token")
    rows = _spread(rows.withColumn("unique", F.size(F.array_distinct("w")).cast("long")), *lengths)
    n = F.size("w").cast("long")
    columns = {
        "n_tokens": n, "n_unique_tokens": F.col("unique"), "proportion_unique_tokens": F.col("unique") / F.nullif(n, F.lit(0)), "n_characters": F.aggregate("token_length", F.lit(0).cast("long"), lambda t, x: t + x), "n_sentences": F.col("sentences"),
        **{f"{name}_{of}": F.col(f"{name}_{of}") for name in lengths for of in ("mean", "median", "std")},
    }
    return rows.select("doc_id", *(c.alias(f"desc_{name}") for name, c in columns.items()))


def front_matter_json(text: Column) -> Column:
    """The flat `key: value` lines of the front matter as JSON, in their order; {} without any."""
    return F.to_json(structure._frontmatter(text))


def plain_replacements_json(text: Column) -> Column:
    """The long words that a text has, each with its plain one, in the list's order, as JSON; []."""
    line = lexical.spaced(text)
    pairs = [F.when(line.contains(lexical.phrase(long)), F.array(F.lit(long), F.lit(short))) for long, short in P.PLAIN_WORDS.items()]
    return F.to_json(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def hdd(docs: DataFrame) -> DataFrame:
    """doc_id, hdd: the different words expected in a draw of DRAW words of a document, over DRAW; null for fewer words.

    Words are counted by document before the formula sees them, so a row is a different word.
    """
    words = docs.select("doc_id", F.explode(T.every(F.lower(F.col("text")), P.WORD)).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    kinds = words.groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("kinds"))
    size = kinds.groupBy("doc_id").agg(F.sum(F.col("c") * F.col("kinds")).alias("n"))
    n, c = F.col("n").cast("double"), F.col("c")
    missed = F.aggregate(F.sequence(F.lit(0), F.lit(DRAW - 1)), F.lit(1.0), lambda t, i: t * F.greatest(n - c - i, F.lit(0.0)) / (n - i))
    each = kinds.join(size, "doc_id").where(F.col("n") >= DRAW).groupBy("doc_id").agg((F.sum(F.col("kinds") * (1 - missed)) / DRAW).alias("hdd"))
    return docs.select("doc_id").join(each, "doc_id", "left")


def analyze(docs: DataFrame) -> DataFrame:
    """doc_id and every feature of text alone: structure, dictionaries, closed classes, stance, as one projection without a shuffle."""
    text = F.col("text")
    prose = T.strip_markup(text)
    stance = lexical.hedge_metric(F.col("prose"))
    rows = docs.select("doc_id", "text", prose.alias("prose"))
    return rows.select(
        "doc_id", *(c.alias(n) for n, c in structure.columns(text).items()), structure.prose_ratio(text).alias("struct_prose_ratio"),
        front_matter_json(text).alias("frontmatter_json"),
        *(c.alias(n) for n, c in lexical.dictionary(F.col("prose")).items()), plain_replacements_json(F.col("prose")).alias("dict_plain_replacements_json"),
        *(c.alias(f"fw_{n}") for n, c in lexical.function_words(F.col("prose")).items()), *(c.alias(n) for n, c in stance.items()),
    )
