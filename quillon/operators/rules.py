"""Rules of scientific writing that need text alone, as one relation of findings.

Each rule is a relation doc_id, sub (the order within the rule), paragraph,
sentence (both from 1, or null), span, message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import prose, rubric

#: Findings of one rule that a report holds.
MOST = 10
R = P.RULES
#: What a report says of each rule; two of them have figures.
MESSAGES = {
    "opening_problem_present": "The first paragraph names no problem that readers should care about.",
    "opening_not_method_first": "The first paragraph speaks more of methods than of what they are for.",
    "challenge_present": "Nowhere is it said which question or difficulty the text takes on.",
    "objective_only_challenge": "This lists aims; ask the question, or say what isn't known.",
    "weak_resolution": "The end asks for more work instead of saying what was learned.",
    "caveat_closing": "The last sentence is a reservation; move it up and end on the finding.",
    "undefined_acronyms": "This abbreviation is never spelled out.",
    "overloaded_sentence": "%d words and %d commas in one sentence: make it two or three.",
    "number_ladder": "%d figures in one paragraph: a table would carry them better.",
    "overclaim_words": "A strong claim: keep the word only if the evidence reaches that far.",
    "latinate_diction": "A long word where a short one would do.",
    "coy_predicate": "This points to the claim without making it; say what it is.",
    "appositive_colon": "Two clauses hang on one colon; give each its own sentence.",
    "orphan_pronoun": "The opening pronoun stands alone; add the noun that it means.",
    "deadwood": "These words say nothing; take them out.",
    "citation_as_subject": "The authors are the subject here; let the finding be it and cite at the end.",
    "expletive_opening": "An empty subject opens the sentence; begin with who or what acts.",
    "significance_without_magnitude": "Significance without a size; state how large the effect is.",
    "preposition_chain": "One 'of' leads to the next; break the chain.",
    "metadiscourse_frame": "The sentence announces its finding; state the finding alone.",
}


def none() -> Column:
    return F.lit(None).cast("long")


def _span(c: Column) -> Column:
    return F.substring(c, 1, 220)


def _located(rows: DataFrame, sub, paragraph, sentence, span, message: str | Column) -> DataFrame:
    said = F.lit(message) if isinstance(message, str) else message
    return rows.select("doc_id", F.array(*sub).alias("sub"), paragraph.cast("long").alias("paragraph"), sentence.cast("long").alias("sentence"), _span(span).alias("span"), said.alias("message"))


def each_match(pattern: str, message: str, most: int = 220) -> Callable[[DataFrame], DataFrame]:
    """A finding for each match in a sentence."""

    def rule(docs: DataFrame) -> DataFrame:
        rows = prose.sentences(docs).select("doc_id", "pi", "si", F.posexplode(T.every(F.col("sent"), R[pattern])).alias("k", "m"))
        return _located(rows, [F.col(c) for c in ("pi", "si", "k")], F.col("pi") + 1, F.col("si") + 1, F.substring("m", 1, most), message)

    return rule


def each_sentence(pattern: str, message: str, but: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A finding for each sentence that matches, and doesn't match `but`."""

    def rule(docs: DataFrame) -> DataFrame:
        rows = prose.sentences(docs).where(T.has(F.col("sent"), R[pattern]))
        if but:
            rows = rows.where(~T.has(F.col("sent"), R[but]))
        return _located(rows, [F.col("pi"), F.col("si")], F.col("pi") + 1, F.col("si") + 1, F.col("sent"), message)

    return rule


def _sections(docs: DataFrame) -> DataFrame:
    return prose.sections(docs)


def _document(rows: DataFrame, paragraph: Column, span: Column, message: str) -> DataFrame:
    return _located(rows, [F.lit(0)], paragraph, none(), span, message)


def opening_problem_present(docs: DataFrame) -> DataFrame:
    rows = _sections(docs).where(T.count(F.col("opening"), R["problem"]) == 0)
    return _document(rows, F.lit(1), F.col("opening"), MESSAGES["opening_problem_present"])


def opening_not_method_first(docs: DataFrame) -> DataFrame:
    rows = _sections(docs).where(T.count(F.col("opening"), R["method"]) > T.count(F.col("opening"), R["problem"]))
    return _document(rows, F.lit(1), F.col("opening"), MESSAGES["opening_not_method_first"])


def challenge_present(docs: DataFrame) -> DataFrame:
    return _document(_sections(docs).where("challenge is null"), none(), F.lit(""), MESSAGES["challenge_present"])


def objective_only_challenge(docs: DataFrame) -> DataFrame:
    rows = _sections(docs).where("challenge is not null").withColumn("said", F.get("paras", F.col("challenge").cast("int")))
    low = F.lower("said")
    rows = rows.where(T.has(F.col("said"), R["objective"]) & ~F.col("said").contains("?") & ~low.contains("hypothes") & ~low.contains("whether"))
    return _document(rows, F.col("challenge") + 1, F.col("said"), MESSAGES["objective_only_challenge"])


def weak_resolution(docs: DataFrame) -> DataFrame:
    rows = _sections(docs).where(T.has(F.col("resolution"), R["weak_end"]))
    return _document(rows, F.col("n"), F.col("resolution"), MESSAGES["weak_resolution"])


def caveat_closing(docs: DataFrame) -> DataFrame:
    rows = _sections(docs).where("n > 0").withColumn("closing", F.element_at(T.sentences(F.col("resolution")), -1))
    rows = rows.where(T.has(F.col("closing"), R["hedge_close"]))
    return _document(rows, F.col("n"), F.col("closing"), MESSAGES["caveat_closing"])


def undefined_acronyms(docs: DataFrame) -> DataFrame:
    """Acronyms that no paragraph has within parentheses, at their first bare place."""
    rows = prose.paragraphs(docs).where(T.has(F.col("para"), R["acronym"]))
    acronyms = F.filter(T.every(F.col("para"), R["acronym"]), lambda a: ~a.isin(*P.ACRONYMS_KNOWN))
    inside = F.flatten(F.transform(T.every(F.col("para"), P.Pattern(r"\([^)]*\)")), lambda g: T.every(g, R["acronym"])))
    # a paragraph's sentences are looked through within its row, so that no text is shuffled
    rows = rows.select("doc_id", "pi", acronyms.alias("acronyms"), inside.alias("inside"), T.sentences(F.col("para")).alias("sents"))
    rows = rows.select("doc_id", "pi", "inside", "sents", F.posexplode("acronyms").alias("k", "ac"))
    holds = F.array_position(F.transform("sents", lambda s: s.contains(F.col("ac"))), True)
    found = rows.select("doc_id", "ac", F.array_contains("inside", F.col("ac")).alias("inside"), F.struct("pi", "k", (F.nullif(holds, F.lit(0)) - 1).alias("si")).alias("at"))
    by = found.groupBy("doc_id", "ac").agg(F.max("inside").alias("defined"), F.min("at").alias("at")).where("not defined")
    first = by.select("doc_id", "ac", "at.pi", "at.k", "at.si")
    return _located(first, [F.col("pi"), F.col("k")], F.col("pi") + 1, F.coalesce("si", F.lit(0)) + 1, F.col("ac"), MESSAGES["undefined_acronyms"])


def _density(pattern: str, high: float, low: float) -> Callable[[DataFrame], DataFrame]:
    def rule(docs: DataFrame) -> DataFrame:
        rate = T.per_1000(T.count(F.col("text"), R[pattern]), T.tokens(F.col("text")))
        return docs.select("doc_id", rate.alias("rate")).where(F.col("rate") > low).select("doc_id", "rate", F.when(F.col("rate") > high, "medium").otherwise("low").alias("severity"))

    return rule


fuzzy_verb_density = _density("fuzzy", 6, 4)
nominalization_density = _density("nominal", 35, 25)


def overloaded_sentence(docs: DataFrame) -> DataFrame:
    rows = prose.sentences(docs).withColumn("w", T.tokens(F.col("sent"))).withColumn("c", F.length("sent") - F.length(F.replace("sent", F.lit(","))))
    rows = rows.where("w > 45 or c >= 4")
    said = F.format_string(MESSAGES["overloaded_sentence"], F.col("w"), F.col("c"))
    return _located(rows, [-F.col("w"), -F.col("c"), F.col("pi"), F.col("si")], F.col("pi") + 1, none(), F.col("sent"), said)


def number_ladder(docs: DataFrame) -> DataFrame:
    rows = prose.paragraphs(docs).withColumn("c", T.count(F.col("para"), R["statistic"])).where("c >= 6")
    said = F.format_string(MESSAGES["number_ladder"], F.col("c"))
    return _located(rows, [-F.col("c"), F.col("pi")], F.col("pi") + 1, none(), F.col("para"), said)


def _first_of_each(rows: DataFrame, message: str, span: Column) -> DataFrame:
    """rows: doc_id, pi, si, k, word; a finding at each word's first place."""
    first = rows.groupBy("doc_id", "word").agg(F.min(F.struct("pi", "si", "k")).alias("at")).select("doc_id", "word", "at.pi", "at.si", "at.k")
    first = first.withColumn("shown", span)
    return _located(first, [F.col(c) for c in ("pi", "si", "k")], F.col("pi") + 1, F.col("si") + 1, F.col("shown"), message)


def overclaim_words(docs: DataFrame) -> DataFrame:
    rows = prose.sentences(docs).select("doc_id", "pi", "si", F.posexplode(T.every(F.col("sent"), R["overclaim"])).alias("k", "m"))
    return _first_of_each(rows.withColumn("word", F.lower("m")), MESSAGES["overclaim_words"], F.col("word"))


#: Runs of five letters and hyphens or more that begin as a word with a plain one, or have four vowel groups and no nominalization's end: other words never leave the pattern.
LATINATE = (
    rf"(?i)(?<![a-z-])-*+((?={'|'.join(P.PLAIN_WORDS)})[a-z][a-z-]{{4,}}+"
    r"|(?=(?:[b-df-hj-np-tv-xz-]*+[aeiouy]++){4})[a-z][a-z-]{4,}+(?<!(?:tion|sion|ment|ity|ance|ence|ness)s?))"
)


def latinate_diction(docs: DataFrame) -> DataFrame:
    """Words with a known plain one, and words of four vowel groups that don't end as nominalizations do."""
    rows = prose.sentences(docs).select("doc_id", "pi", "si", F.posexplode(F.regexp_extract_all("sent", F.lit(LATINATE), F.lit(1))).alias("k", "m"))
    rows = rows.withColumn("word", F.lower("m"))
    plain = F.lit(None).cast("string")
    for stem, short in reversed(P.PLAIN_WORDS.items()):
        plain = F.when(F.col("word").startswith(stem), F.lit(short)).otherwise(plain)
    shown = F.coalesce(F.concat("word", F.lit(" → "), plain), F.col("word"))
    return _first_of_each(rows, MESSAGES["latinate_diction"], shown)


#: rule -> severity, dimension, relation; in report order. Densities have their own severity column.
TEXT_RULES: dict[str, tuple[str, str, Callable[[DataFrame], DataFrame]]] = {
    "opening_problem_present": ("high", "opening", opening_problem_present),
    "opening_not_method_first": ("medium", "opening", opening_not_method_first),
    "challenge_present": ("high", "challenge", challenge_present),
    "objective_only_challenge": ("high", "challenge", objective_only_challenge),
    "weak_resolution": ("high", "resolution", weak_resolution),
    "undefined_acronyms": ("medium", "clarity", undefined_acronyms),
    "fuzzy_verb_density": ("", "sentences", fuzzy_verb_density),
    "nominalization_density": ("", "sentences", nominalization_density),
    "caveat_closing": ("medium", "resolution", caveat_closing),
    "overloaded_sentence": ("medium", "sentences", overloaded_sentence),
    "number_ladder": ("low", "clarity", number_ladder),
    "coy_predicate": ("medium", "clarity", each_match("coy", MESSAGES["coy_predicate"])),
    "appositive_colon": ("low", "sentences", each_sentence("appositive_colon", MESSAGES["appositive_colon"])),
    "orphan_pronoun": ("low", "clarity", each_sentence("orphan_start", MESSAGES["orphan_pronoun"])),
    "overclaim_words": ("medium", "clarity", overclaim_words),
    "deadwood": ("low", "clarity", each_match("deadwood", MESSAGES["deadwood"])),
    "latinate_diction": ("low", "clarity", latinate_diction),
    "citation_as_subject": ("low", "clarity", each_match("citation_subject", MESSAGES["citation_as_subject"], 120)),
    "expletive_opening": ("low", "sentences", each_sentence("expletive", MESSAGES["expletive_opening"])),
    "significance_without_magnitude": ("low", "clarity", each_sentence("significant", MESSAGES["significance_without_magnitude"], "magnitude")),
    "preposition_chain": ("low", "sentences", each_match("of_chain", MESSAGES["preposition_chain"])),
    "metadiscourse_frame": ("low", "clarity", each_match("metadiscourse", MESSAGES["metadiscourse_frame"])),
}
DENSITY_MESSAGES = {
    "fuzzy_verb_density": ("Very many verbs that name no action.", "Many verbs that name no action."),
    "nominalization_density": ("Very many actions are written as nouns.", "Many actions are written as nouns."),
}


def rule(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, severity, paragraph, sentence, span, place of one rule's findings, at most MOST a document."""
    severity, _, relation = TEXT_RULES[name]
    rows = relation(docs)
    if name in DENSITY_MESSAGES:
        return rows.select("doc_id", "severity", none().alias("paragraph"), none().alias("sentence"), F.lit("").alias("span"), F.lit(1).cast("long").alias("place"), F.when(F.col("severity") == "medium", DENSITY_MESSAGES[name][0]).otherwise(DENSITY_MESSAGES[name][1]).alias("message"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("sub")).cast("long")).where(F.col("place") <= MOST)
    return rows.select("doc_id", F.lit(severity).alias("severity"), "paragraph", "sentence", "span", "place", "message")


def _struct(i: int, sub: list, paragraph, sentence, span: Column) -> Column:
    sub = [*sub, *[F.lit(0)] * (4 - len(sub))]
    return F.struct(F.lit(i).alias("i"), F.array(*(x.cast("long") for x in sub)).alias("sub"), paragraph.cast("long").alias("paragraph"), sentence.cast("long").alias("sentence"), _span(span).alias("span"))


def _each(matches: Column, i: int, most: int) -> Column:
    pi, si = F.col("pi"), F.col("si")
    return F.transform(matches, lambda m, k: _struct(i, [pi, si, k], pi + 1, si + 1, F.substring(m, 1, most)))


def _in_sentences(docs: DataFrame, order: dict[str, int]) -> DataFrame:
    """Findings of all rules that look at one sentence at a time: one scan, one explode of sentences."""
    sent, pi, si = F.col("sent"), F.col("pi"), F.col("si")
    nothing = F.array().cast("array<struct<i:int,sub:array<bigint>,paragraph:bigint,sentence:bigint,span:string>>")
    found = []
    for name, pattern, most in SENTENCE_MATCHES:
        found.append(_each(T.every(sent, R[pattern]), order[name], most))
    for name, pattern, but in SENTENCE_WHOLE:
        fits = T.has(sent, R[pattern]) & (~T.has(sent, R[but]) if but else F.lit(True))
        found.append(F.when(fits, F.array(_struct(order[name], [pi, si], pi + 1, si + 1, sent))).otherwise(nothing))
    w, c = T.tokens(sent), F.length(sent) - F.length(F.replace(sent, F.lit(",")))
    found.append(F.when((w > 45) | (c >= 4), F.array(_struct(order["overloaded_sentence"], [-w, -c, pi, si], pi + 1, none(), sent))).otherwise(nothing))
    return prose.sentences(docs).select("doc_id", F.inline(F.concat(*found)))


def _in_sections(docs: DataFrame, order: dict[str, int]) -> DataFrame:
    """Findings of all rules that look at a document's opening, challenge and resolution: one scan, no shuffle."""
    opening, resolution, n = F.col("opening"), F.col("resolution"), F.col("n")
    said = F.coalesce(F.get("paras", F.col("challenge").cast("int")), F.lit(""))
    closing = F.coalesce(F.element_at(T.sentences(resolution), -1), F.lit(""))
    problem, method = T.count(opening, R["problem"]), T.count(opening, R["method"])
    only = T.has(said, R["objective"]) & ~said.contains("?") & ~F.lower(said).contains("hypothes") & ~F.lower(said).contains("whether")
    rate = {name: T.per_1000(T.count(F.col("text"), R[p]), T.tokens(F.col("text"))) for name, p, _, _ in DENSITIES}
    cases = {
        "opening_problem_present": (problem == 0, F.lit(1), opening),
        "opening_not_method_first": (method > problem, F.lit(1), opening),
        "challenge_present": (F.col("challenge").isNull(), none(), F.lit("")),
        "objective_only_challenge": (only, F.col("challenge") + 1, said),
        "weak_resolution": (T.has(resolution, R["weak_end"]), n, resolution),
        "caveat_closing": ((n > 0) & T.has(closing, R["hedge_close"]), n, closing),
    }
    found = [F.when(fits, _struct(order[name], [], paragraph, none(), span)) for name, (fits, paragraph, span) in cases.items()]
    # a density's span says its severity until the end
    found += [F.when(rate[name] > low, _struct(order[name], [], none(), none(), F.when(rate[name] > high, "medium").otherwise("low"))) for name, _, high, low in DENSITIES]
    ladder = F.transform("paras", lambda p, i: F.struct(i.alias("i"), T.count(p, R["statistic"]).alias("c"), p.alias("p")))
    ladders = F.transform(F.filter(ladder, lambda x: x["c"] >= 6), lambda x: _struct(order["number_ladder"], [-x["c"], x["i"]], x["i"] + 1, none(), x["p"]))
    return prose.sections(docs).select("doc_id", F.inline(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), ladders)))


#: Rules by how they look at sentences; densities with their upper and lower bound.
SENTENCE_MATCHES = (
    ("coy_predicate", "coy", 220), ("deadwood", "deadwood", 220), ("citation_as_subject", "citation_subject", 120),
    ("preposition_chain", "of_chain", 220), ("metadiscourse_frame", "metadiscourse", 220),
)
SENTENCE_WHOLE = (
    ("appositive_colon", "appositive_colon", None), ("orphan_pronoun", "orphan_start", None),
    ("expletive_opening", "expletive", None), ("significance_without_magnitude", "significant", "magnitude"),
)
DENSITIES = (("fuzzy_verb_density", "fuzzy", 6, 4), ("nominalization_density", "nominal", 35, 25))
WORD_RULES = ("undefined_acronyms", "overclaim_words", "latinate_diction")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, ord, severity, dimension, rule, paragraph, sentence, span, message of all text rules, in report order.

    Documents are scanned five times for 22 rules: once for what needs a
    sentence, once for what needs sections, and once for each rule of words.
    """
    order = {name: i for i, name in enumerate(TEXT_RULES)}
    words = {name: TEXT_RULES[name][2](docs) for name in WORD_RULES}
    by_word = [r.select("doc_id", F.lit(order[n]).alias("i"), F.transform("sub", lambda x: x.cast("long")).alias("sub"), "paragraph", "sentence", "span") for n, r in words.items()]
    rows = rubric.together(_in_sentences(docs, order), _in_sections(docs, order), *by_word, by="i")
    place = F.row_number().over(Window.partitionBy("doc_id", "i").orderBy("sub"))
    rows = rows.withColumn("place", place).where(F.col("place") <= MOST)
    names = F.array(*(F.lit(n) for n in TEXT_RULES))
    severities = F.array(*(F.lit(v[0]) for v in TEXT_RULES.values()))
    dimensions = F.array(*(F.lit(v[1]) for v in TEXT_RULES.values()))
    density = F.get(names, "i").isin(*(d[0] for d in DENSITIES))
    rule = F.get(names, "i")
    of_rule = F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv))
    graver = F.create_map(*(F.lit(x) for k, v in DENSITY_MESSAGES.items() for x in (k, v[0])))
    lesser = F.create_map(*(F.lit(x) for k, v in DENSITY_MESSAGES.items() for x in (k, v[1])))
    figures = [-F.get("sub", F.lit(0)), -F.get("sub", F.lit(1))]
    message = (
        F.when(density, F.when(F.col("span") == "medium", graver[rule]).otherwise(lesser[rule]))
        .when(rule == "overloaded_sentence", F.format_string(MESSAGES["overloaded_sentence"], *figures))
        .when(rule == "number_ladder", F.format_string(MESSAGES["number_ladder"], figures[0]))
        .otherwise(of_rule[rule])
    )
    return rows.select(
        "doc_id", (F.col("i") * 1000 + F.col("place")).alias("ord"), F.when(density, F.col("span")).otherwise(F.get(severities, "i")).alias("severity"),
        F.get(dimensions, "i").alias("dimension"), F.get(names, "i").alias("rule"), "paragraph", "sentence", F.when(density, F.lit("")).otherwise(F.col("span")).alias("span"), message.alias("message"),
    )
