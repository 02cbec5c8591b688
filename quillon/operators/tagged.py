"""Findings of rules that need parts of speech: the rest of the scientific rubric, and the density rubric.

They take `annotate.tokens` of the documents, or a relation of its schema from
another tagger. Findings have the columns of `rules.findings`, and their order
follows that of the text rules, so that both are joined by `unionByName`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import annotate, lexical, rubric, rules

#: Severity, dimension and message of each rule.
SCHIMEL = {
    "noun_trains": ("low", "clarity", "Several trains of three or more nouns; uncouple them with verbs and prepositions."),
    "passive_voice": ("low", "sentences", "%d passive verbs in %d sentences; name who acts."),
    "comma_splice": ("medium", "sentences", "A comma alone joins two clauses; use a full stop or a conjunction."),
    "word_repetition": ("medium", "clarity", "One word sounds again and again here; keep that only where it is meant."),
    "defensive_claim": ("medium", "clarity", "The authors say what they don't do; say what they do."),
    "verbless_sentence": ("low", "sentences", "No verb carries this sentence."),
    "buried_verb_core": ("medium", "sentences", "Ten words or more part the subject from its verb; bring them together."),
}
#: Frequent words that an expression may hold.
COMMON = 20_000
DENSITY = {
    "padding_paragraph": ("low", "density", "Fewer content words than elsewhere in the text; cut or merge."),
    "jargon_cluster": ("medium", "jargon", "Rare words crowd this sentence: %s"),
}


def _found(rows: DataFrame, rule: str, table: dict, paragraph: Column, sentence: Column, span: Column, message: Column | None = None) -> DataFrame:
    """A rule's findings, not yet counted."""
    severity, dimension, said = table[rule]
    return rows.select(
        "doc_id", F.lit(severity).alias("severity"), F.lit(dimension).alias("dimension"), F.lit(rule).alias("rule"),
        paragraph.cast("long").alias("paragraph"), sentence.cast("long").alias("sentence"), F.substring(span, 1, 220).alias("span"),
        (F.lit(said) if message is None else message).alias("message"),
    )


def _placed(found: list[DataFrame], table: dict, first: int) -> DataFrame:
    """At most ten findings of each rule in a document, in the order of their places: one shuffle for all rules."""
    rows = rubric.together(*found)
    order = F.create_map(*(F.lit(x) for i, rule in enumerate(table) for x in (rule, first + i)))
    place = F.row_number().over(Window.partitionBy("doc_id", "rule").orderBy(F.asc_nulls_first("paragraph"), F.asc_nulls_first("sentence"), "span"))
    rows = rows.withColumn("place", place).where(F.col("place") <= rules.MOST)
    return rows.select("doc_id", (order[F.col("rule")] * 1000 + F.col("place")).alias("ord"), "severity", "dimension", "rule", "paragraph", "sentence", "span", "message")


def findings(annotated: DataFrame | None, docs: DataFrame) -> DataFrame:
    """doc_id, ord, severity, dimension, rule, paragraph, sentence, span, message of the rules in SCHIMEL.

    Without a relation of tokens the rule tagger's are taken, whose marks are made where it tags.
    """
    at, none, nothing = F.col("pi") + 1, rules.none(), F.lit("")
    leading = lexical.leading_words(docs).select("doc_id", "word", F.lit(True).alias("leads"))
    bursts = lexical.repeated(docs).join(leading, ["doc_id", "word"], "left")
    kept = F.when(F.col("leads"), F.lit(" The whole text leans on this word, so it may be meant.")).otherwise(nothing)
    rows = [
        _found(bursts, "word_repetition", SCHIMEL, at, none, F.col("span"), F.concat(F.lit(SCHIMEL["word_repetition"][2]), kept)),
        _marked(annotate.marks(docs) if annotated is None else annotate.marks_of(annotated)),
    ]
    return _placed(rows, SCHIMEL, len(rules.TEXT_RULES))


def _marked(rows: DataFrame) -> DataFrame:
    """Findings of the rules that look at one sentence's tags, not yet counted, from its marks: a document's findings leave its partition together."""
    fits = annotate.MARKED
    here = F.when(F.size("rules") > 0, F.struct("rules", "pi", "si", "span"))
    by = rows.groupBy("doc_id").agg(F.sum("trains").alias("trains"), F.sum("passives").alias("passives"), F.count(F.lit(1)).alias("sentences"), F.collect_list(here).alias("found"))
    none = rules.none()
    whole = lambda rule, message: F.array(F.struct(F.lit(rule).alias("rule"), none.alias("paragraph"), none.alias("sentence"), F.lit("").alias("span"), message.alias("message")))
    nothing = F.array().cast("array<struct<rule:string,paragraph:bigint,sentence:bigint,span:string,message:string>>")
    said = F.create_map(*(F.lit(x) for rule in fits for x in (rule, SCHIMEL[rule][2])))
    each = F.flatten(F.transform("found", lambda f: F.transform(f["rules"], lambda r: F.struct(r.alias("rule"), (f["pi"] + 1).cast("long").alias("paragraph"), (f["si"] + 1).cast("long").alias("sentence"), f["span"].alias("span"), said[r].alias("message")))))
    trains = F.when(F.col("trains") > 2, whole("noun_trains", F.lit(SCHIMEL["noun_trains"][2]))).otherwise(nothing)
    passives = F.when(F.expr(annotate.MANY_PASSIVES), whole("passive_voice", F.format_string(SCHIMEL["passive_voice"][2], F.col("passives"), F.col("sentences")))).otherwise(nothing)
    found = by.select("doc_id", F.inline(F.concat(each, trains, passives)))
    # of a paragraph's buried verbs only the first counts
    first = F.row_number().over(Window.partitionBy("doc_id", "rule", "paragraph").orderBy("sentence"))
    found = found.withColumn("first", first).where((F.col("rule") != "buried_verb_core") | (F.col("first") == 1))
    severity, dimension = (F.create_map(*(F.lit(x) for rule, meta in SCHIMEL.items() for x in (rule, meta[k])))[F.col("rule")] for k in (0, 1))
    return found.select("doc_id", severity.alias("severity"), dimension.alias("dimension"), "rule", "paragraph", "sentence", "span", "message")


def defined_acronyms(docs: DataFrame) -> DataFrame:
    """doc_id, word: abbreviations that stand within parentheses, and so are spelled out before."""
    inside = F.flatten(F.transform(T.every(F.col("text"), P.Pattern(r"\([^)]*\)")), lambda g: T.every(g, P.WORD)))
    return docs.select("doc_id", F.explode(F.array_distinct(F.filter(inside, lambda w: w.rlike("^[A-Z]{2,}$")))).alias("word"))


def jargon(annotated: DataFrame, docs: DataFrame, frequencies: DataFrame, rare: float = 3.0, least: int = 3) -> DataFrame:
    """doc_id, pi, si, sent (its first 220 characters), n, words of sentences with `least` different words rarer than `rare`.

    frequencies has a word's zipf value; a word that it lacks is as rare as can
    be. Names, abbreviations that the text defines and the words that it leans on
    don't count. Words at or above the bound are what is looked up, before
    anything else is joined, so frequent words end there: within the row if there
    are at most COMMON of them, by a join beyond that.
    """
    common = frequencies.where((F.col("zipf") >= rare) & F.col("word").isNotNull()).select("word")
    few = [r.word for r in common.limit(COMMON + 1).collect()]
    within = len(few) <= COMMON
    words = F.filter("tokens", lambda t: (t["pos"] != "PROPN") & (F.length(t["text"]) >= 4) & (~t["lower"].isin(*few) if within and few else F.lit(True)) & t["text"].rlike(r"(?U)^\p{L}+$"))
    rows = annotated.select("doc_id", "pi", "si", F.substring("sent", 1, 220).alias("sent"), F.array_distinct(F.transform(words, lambda t: F.struct(t["lower"].alias("word"), t["lemma"].alias("lemma"), t["text"].alias("text")))).alias("t"))
    rows = rows.where(F.size("t") >= least)  # spellings of one word are counted as one at the end
    if not within:
        kept = rows.select("doc_id", "pi", "si", F.explode("t").alias("t")).join(common, F.col("t.word") == F.col("word"), "left_anti")
        rows = kept.groupBy("doc_id", "pi", "si").agg(F.collect_list("t").alias("t")).join(rows.drop("t"), ["doc_id", "pi", "si"])
    # a document's exceptions are few, and come to its sentences as two arrays
    defined = defined_acronyms(docs).groupBy("doc_id").agg(F.collect_list("word").alias("defined"))
    leading = lexical.leading_words(docs).groupBy("doc_id").agg(F.collect_list("word").alias("leading"))
    rows = rows.join(defined.join(leading, "doc_id", "full"), "doc_id", "left")
    none = F.array().cast("array<string>")
    counts = F.filter("t", lambda t: ~F.array_contains(F.coalesce("defined", none), t["text"]) & ~F.array_contains(F.coalesce("leading", none), t["lemma"]))
    found = rows.select("doc_id", "pi", "si", "sent", F.array_sort(F.array_distinct(F.transform(counts, lambda t: t["word"]))).alias("words")).where(F.size("words") >= least)
    return found.select("doc_id", "pi", "si", "sent", F.size("words").cast("long").alias("n"), "words")


def density(annotated: DataFrame, docs: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Findings of the density rubric: padded paragraphs, and sentences that rare words crowd."""
    paras = rules.prose.paragraphs(docs).select("doc_id", "pi", F.substring("para", 1, 220).alias("para"))
    padded = annotate.padding(annotated).join(paras, ["doc_id", "pi"])
    crowded = jargon(annotated, docs, frequencies)
    names = F.format_string(DENSITY["jargon_cluster"][2], F.array_join("words", ", "))
    found = [
        _found(padded, "padding_paragraph", DENSITY, F.col("pi") + 1, rules.none(), F.col("para")),
        _found(crowded, "jargon_cluster", DENSITY, F.col("pi") + 1, F.col("si") + 1, F.col("sent"), names),
    ]
    return _placed(found, DENSITY, 0)
