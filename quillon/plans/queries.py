"""Registered queries with their SQL: text, markup, tells, rubrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import prose, rubric, rules, tells
from quillon.plans import fixtures, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, text: str | None = None) -> None:
    QUERIES[name] = query
    if text:
        SQL[name] = text


def on_text(name: str, column: Callable[[Column], Column], text: str | None) -> None:
    """A query doc_id, value over the spiked documents; text: the SQL expression over text."""
    register(
        name,
        lambda spark, d: fixtures.documents(spark, d).select("doc_id", column(F.col("text")).alias("value")),
        text and f"with {sql.SPIKED} select doc_id, {text} as value from spiked",
    )


def on_docs(name: str, relation: Callable[[DataFrame], DataFrame], text: str | None) -> None:
    register(name, lambda spark, d: relation(fixtures.documents(spark, d)), text)


# Splitting and markup
on_docs("split_paragraphs", lambda d: prose.paragraphs(d).select("doc_id", F.col("pi").cast("long").alias("pi"), "para"), f"with {sql.PARAS} select doc_id, pi, para from paras")
on_docs("split_sentences", lambda d: prose.sentences(d).select("doc_id", F.col("pi").cast("long").alias("pi"), F.col("si").cast("long").alias("si"), "sent"), f"with {sql.SENTS} select doc_id, pi, si, sent from sents")
on_text("split_paragraphs_long", lambda t: F.to_json(T.paragraphs(t, 15)), None)
on_text("strip_frontmatter_strict", T.body, sql.body("text"))
LOOKAROUND = ("unwrap_italic_star", "unwrap_italic_underscore")  # RE2 can't say these; tests hold them against examples
for _name in P.MARKUP:
    on_text(_name, lambda t, n=_name: T.markup_step(t, n), None if _name in LOOKAROUND else sql.without("text", *P.MARKUP[_name]))
_PORTABLE = [(n, s) for n, s in P.MARKUP.items() if n not in LOOKAROUND]
on_text("strip_markup", T.strip_markup, None)
on_text("strip_markup_portable", lambda t: T.trim(T.chain(t, [s for _, s in _PORTABLE])), sql.trim(sql.chain("text", [s for _, s in _PORTABLE])))
for _name, _steps in {
    "unwrap_quote_list": ("unwrap_quote", "unwrap_bullet_list", "unwrap_ordered_list"),
    "strip_footnote": ("strip_footnote_def", "strip_footnote_ref"),
    "strip_table": ("strip_table_separator", "strip_table_row"),
}.items():
    on_text(_name, lambda t, s=_steps: T.chain(t, [P.MARKUP[n] for n in s]), sql.chain("text", [P.MARKUP[n] for n in _steps]))
on_text("unwrap_emphasis", lambda t: T.chain(t, [P.MARKUP[n] for n in ("unwrap_bold_star", "unwrap_bold_underscore", "unwrap_strike", *LOOKAROUND)]), None)
register(
    "pages_without_tags",
    lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.markup_step(T.markup_step(F.col("html"), "strip_html_comment"), "strip_html_tag").alias("value")),
    f"select page_id, {sql.chain('html', [P.MARKUP['strip_html_comment'], P.MARKUP['strip_html_tag']])} as value from pages",
)
on_text("clean_extracted_text", T.clean, sql.trim(sql.chain("text", P.CLEAN)))
on_text("looks_like_latex", T.looks_like_latex, sql.has("text", P.LATEX_MARK))
on_text("strip_latex_noise", T.strip_latex, sql.chain("text", P.LATEX_NOISE))
on_text("normalize_detex", T.normalize_detex, sql.trim(sql.chain("text", P.DETEX)))
on_text("detex_text", T.plain_tex, None)
on_text("preprocess_runtime_text", T.prepared, None)
on_text("slug_filename", T.file_name, f"coalesce(nullif(regexp_replace(regexp_replace(lower({sql.trim('text')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'document')")
on_docs(
    "normalize_profile_name",
    lambda d: d.select("doc_id", T.profile_name(F.col("text")).alias("value"), T.valid_profile_name(F.col("text")).alias("valid")),
    f"with {sql.SPIKED}, n as (select doc_id, replace(lower({sql.trim('text')}), ' ', '-') as value from spiked) select doc_id, value, regexp_matches(value, '^[a-z0-9][a-z0-9_-]*$') as valid from n",
)
on_docs(
    "split_frontmatter",
    lambda d: d.select("doc_id", T.front_matter(F.col("text")).alias("front"), T.after_front_matter(F.col("text")).alias("body")),
    f"""with {sql.SPIKED}, p as (select doc_id, text, case when starts_with(text, '---' || chr(10)) then instr(text, chr(10) || '---' || chr(10)) else 0 end as at_ from spiked)
select doc_id, case when at_ > 0 then left(text, at_ + 4) else '' end as front, {sql.trim("case when at_ > 0 then substr(text, at_ + 5) else text end")} as body from p""",
)
_BOOK = "concat('Licence. *** START OF THE PROJECT GUTENBERG EBOOK ', doc_id, ' ***', text, '*** end of this Project Gutenberg eBook ', doc_id, ' *** More licence.')"
on_docs(
    "strip_gutenberg",
    lambda d: d.select("doc_id", T.chain(F.expr(_BOOK), P.BOOK).alias("value")),
    f"with {sql.SPIKED} select doc_id, {sql.chain(_BOOK, P.BOOK)} as value from spiked",
)
on_text("word_count", T.words, f"len({sql.words('text')})")

# Tells
for _name in P.TELLS:
    on_docs(f"tell_{_name}", lambda d, n=_name: tells.one(d, n), f"with {sql.COUNTS} select doc_id, {_name} as n, {sql.per_1000(_name, 'words')} as rate from counts")
on_docs("tell_rates", tells.rates, f"with {sql.COUNTS}, {sql.RATED} select doc_id, {', '.join(f'rate_{n} as tell_{n}' for n in tells.PLAIN)} from rated")
on_docs("tell_occurrences", lambda d: tells.long(d).where("n > 0").select("doc_id", "tell", "n", "span"), f"with {sql.LONG} select doc_id, tell, n, span from long where n > 0")
on_docs(
    "tell_baseline",
    lambda d: tells.baseline(d).select("tell", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std")),
    f"with {sql.COUNTS}, {sql.RATED}, {sql.NORM} select tell, round(mean, 9) as mean, round(std, 9) as std from norm",
)

# The slop rubric
_FINDING = "doc_id, ord, severity, dimension, rule, paragraph, sentence, span, message"
_RESULT = f"doc_id, overall, verdict, {', '.join(f'dim_{d}' for d in rubric.SLOP)}, findings"


def slop(docs: DataFrame) -> DataFrame:
    """The verdict of the slop rubric for each document."""
    return rubric.result(docs, tells.findings(docs), rubric.SLOP)


on_docs("slop_absolute", tells.findings, f"with {sql.ABSOLUTE} select {_FINDING} from findings")
on_docs("slop_relative", lambda d: tells.findings(d, tells.baseline(d)), f"with {sql.RELATIVE} select {_FINDING} from findings")
on_docs("slop_result", slop, f"with {sql.ABSOLUTE}, {sql.result(rubric.SLOP)} select {_RESULT} from results")
on_docs("slop_relative_result", lambda d: rubric.result(d, tells.findings(d, tells.baseline(d)), rubric.SLOP), f"with {sql.RELATIVE}, {sql.result(rubric.SLOP)} select {_RESULT} from results")


def flag_rate(docs: DataFrame) -> DataFrame:
    """lang, paragraphs, flagged, rate: the share of paragraphs of 15 words or more with a tell."""
    paras = docs.select("lang", F.explode(T.paragraphs(F.col("text"), 15)).alias("para"))
    fires = sum(T.has(F.col("para"), p).cast("int") for p in P.TELLS.values()) > 0
    by = paras.groupBy("lang").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(fires.cast("long")).alias("flagged"))
    return by.withColumn("rate", F.round(F.lit(100.0) * F.col("flagged") / F.col("paragraphs"), 6))


on_docs(
    "flag_rate",
    flag_rate,
    f"""with {sql.SPIKED}, p as (select lang, unnest({sql.paragraph_list('text', 15)}) as para from spiked)
select lang, count(*) as paragraphs, sum(case when {' or '.join(sql.has('para', p) for p in P.TELLS.values())} then 1 else 0 end)::bigint as flagged,
  round(100.0::double * sum(case when {' or '.join(sql.has('para', p) for p in P.TELLS.values())} then 1 else 0 end) / count(*), 6) as rate from p group by lang""",
)
on_docs(
    "rank_findings",
    lambda d: rubric.ranked(tells.findings(d)).select("doc_id", "rule", F.col("place").cast("long").alias("place")),
    f"with {sql.ABSOLUTE} select doc_id, rule, row_number() over (partition by doc_id order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, ord) as place from findings",
)
on_docs("render_text", lambda d: rubric.render(slop(d), tells.findings(d), "slop", rubric.SLOP), f"""with {sql.ABSOLUTE}, {sql.result(rubric.SLOP)},
ranked as (select *, row_number() over (partition by doc_id order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, ord) as place from findings),
top as (select doc_id, string_agg('- ' || dimension || ': ' || rule || '; ' || message, chr(10) order by place) as lines from ranked where place <= 5 group by doc_id)
select doc_id, 'slop: ' || upper(verdict) || ' (' || printf('%.2f', overall) || ')' || chr(10) || chr(10) ||
  {" || chr(10) || ".join(f"rpad('{d}', 12, ' ') || ' ' || printf('%.2f', dim_{d})" for d in rubric.SLOP)} ||
  coalesce(chr(10) || chr(10) || 'Top findings' || chr(10) || lines, '') as report from results left join top using (doc_id)""")
on_docs("rubric_dashboard", lambda d: rubric.dashboard(d, tells.findings(d)), f"""with {sql.ABSOLUTE},
by_ as (select rule, severity, count(*) as n, case severity when 'high' then 0 when 'medium' then 1 else 2 end as rank from findings group by rule, severity),
total as (select sum({sql.tokens('text')}) as words from spiked)
select rule, sum(n)::bigint as n, round(1000.0::double * sum(n) / greatest(max(words), 1), 4) as per_1000_words, max_by(severity, n * 10 - rank) as severity from by_, total group by rule""")

# Rules of scientific writing that need text alone
_R = P.RULES
_PLACED = "select doc_id, '{severity}' as severity, paragraph, sentence, left(span, 220) as span, place from (select *, row_number() over (partition by doc_id order by {order}) as place from ({rows}) x) y where place <= 10"


def _rule(name: str, ctes: str, rows: str, order: str) -> None:
    severity = rules.TEXT_RULES[name][0]
    on_docs(name, lambda d: rules.rule(d, name).drop("message"), f"with {ctes} " + _PLACED.format(severity=severity, order=order, rows=rows))


def _matches(name: str, pattern: str, most: int = 220) -> None:
    each = f"(select doc_id, pi, si, generate_subscripts(m, 1) as k, unnest(m) as hit from (select doc_id, pi, si, regexp_extract_all(sent, {sql.pattern(_R[pattern])}) as m from sents) a)"
    _rule(name, sql.SENTS, f"select doc_id, pi, si, k, pi + 1 as paragraph, si + 1 as sentence, left(hit, {most}) as span from {each} b", "pi, si, k")


def _whole(name: str, condition: str) -> None:
    _rule(name, sql.SENTS, f"select doc_id, pi, si, pi + 1 as paragraph, si + 1 as sentence, sent as span from sents where {condition}", "pi, si")


def _section(name: str, paragraph: str, span: str, condition: str) -> None:
    _rule(name, sql.SECTIONS, f"select doc_id, {paragraph}::bigint as paragraph, null::bigint as sentence, {span} as span from sections where {condition}", "doc_id")


_section("opening_problem_present", "1", "opening", f"{sql.count('opening', _R['problem'])} = 0")
_section("opening_not_method_first", "1", "opening", f"{sql.count('opening', _R['method'])} > {sql.count('opening', _R['problem'])}")
_section("challenge_present", "null", "''", "challenge is null")
_section("objective_only_challenge", "challenge + 1", "paras[challenge + 1]", f"challenge is not null and {sql.has('paras[challenge + 1]', _R['objective'])} and not contains(paras[challenge + 1], '?') and not contains(lower(paras[challenge + 1]), 'hypothes') and not contains(lower(paras[challenge + 1]), 'whether')")
_section("weak_resolution", "n", "resolution", sql.has("resolution", _R["weak_end"]))
_section("caveat_closing", "n", f"{sql.sentence_list('resolution')}[-1]", f"n > 0 and {sql.has(sql.sentence_list('resolution') + '[-1]', _R['hedge_close'])}")
_rule(
    "undefined_acronyms",
    f"""{sql.SENTS}, found as (select doc_id, pi, para, unnest(w) as ac, generate_subscripts(w, 1) as k from (select doc_id, pi, para,
  list_filter({sql.words('para')}, lambda w: regexp_full_match(w, '[A-Z]{{2,}}')) as w from paras) a),
marked as (select *, len(list_filter(regexp_extract_all(para, '\\([^)]*\\)'), lambda g: list_contains({sql.words('g')}, ac))) > 0 as inside from found
  where ac not in ({', '.join(map(sql.quoted, P.ACRONYMS_KNOWN))})),
bare as (select doc_id, ac, min(pi * 1000000 + k) filter (where not inside) as at_ from marked group by doc_id, ac having not bool_or(inside))""",
    """select doc_id, at_, at_ // 1000000 + 1 as paragraph, coalesce((select min(si) from sents s where s.doc_id = bare.doc_id and s.pi = at_ // 1000000 and contains(sent, ac)), 0) + 1 as sentence, ac as span from bare""",
    "at_",
)
for _name, _pattern, _high, _low in (("fuzzy_verb_density", "fuzzy", 6, 4), ("nominalization_density", "nominal", 35, 25)):
    _rate = sql.per_1000(sql.count("text", _R[_pattern]), sql.tokens("text"))
    on_docs(_name, lambda d, n=_name: rules.rule(d, n).drop("message"), f"with {sql.SPIKED} select doc_id, case when {_rate} > {_high} then 'medium' else 'low' end as severity, null::bigint as paragraph, null::bigint as sentence, '' as span, 1::bigint as place from spiked where {_rate} > {_low}")
_rule("overloaded_sentence", sql.SENTS, f"select doc_id, pi, si, pi + 1 as paragraph, null::bigint as sentence, sent as span, {sql.tokens('sent')} as w, len(sent) - len(replace(sent, ',', '')) as c from sents where {sql.tokens('sent')} > 45 or len(sent) - len(replace(sent, ',', '')) >= 4", "w desc, c desc, pi, si")
_rule("number_ladder", sql.PARAS, f"select doc_id, pi, pi + 1 as paragraph, null::bigint as sentence, para as span, {sql.count('para', _R['statistic'])} as c from paras where {sql.count('para', _R['statistic'])} >= 6", "c desc, pi")
for _name, _pattern, _most in (("coy_predicate", "coy", 220), ("deadwood", "deadwood", 220), ("citation_as_subject", "citation_subject", 120), ("preposition_chain", "of_chain", 220), ("metadiscourse_frame", "metadiscourse", 220)):
    _matches(_name, _pattern, _most)
for _name, _pattern in (("appositive_colon", "appositive_colon"), ("orphan_pronoun", "orphan_start"), ("expletive_opening", "expletive")):
    _whole(_name, sql.has("sent", _R[_pattern]))
_whole("significance_without_magnitude", f"{sql.has('sent', _R['significant'])} and not {sql.has('sent', _R['magnitude'])}")
_rule(
    "overclaim_words",
    f"{sql.SENTS}, w as (select doc_id, lower(hit) as word, min(pi * 1000000000 + si * 100000 + k) as at_ from (select doc_id, pi, si, unnest(m) as hit, generate_subscripts(m, 1) as k from (select doc_id, pi, si, regexp_extract_all(sent, {sql.pattern(_R['overclaim'])}) as m from sents) a) b group by 1, 2)",
    "select doc_id, at_, at_ // 1000000000 + 1 as paragraph, at_ % 1000000000 // 100000 + 1 as sentence, word as span from w",
    "at_",
)
_plain = "case " + " ".join(f"when starts_with(word, '{stem}') then '{short}'" for stem, short in P.PLAIN_WORDS.items()) + " end"
_rule(
    "latinate_diction",
    f"{sql.SENTS}, w as (select doc_id, lower(hit) as word, min(pi * 1000000000 + si * 100000 + k) as at_ from (select doc_id, pi, si, unnest(m) as hit, generate_subscripts(m, 1) as k from (select doc_id, pi, si, regexp_extract_all(sent, '[A-Za-z][A-Za-z-]{{4,}}') as m from sents) a) b group by 1, 2)",
    f"select doc_id, at_, at_ // 1000000000 + 1 as paragraph, at_ % 1000000000 // 100000 + 1 as sentence, word || coalesce(' → ' || {_plain}, '') as span from w where {_plain} is not null or (not regexp_matches(word, '(?:tion|sion|ment|ity|ance|ence|ness)s?$') and len(regexp_extract_all(word, '[aeiouy]+')) >= 4)",
    "at_",
)
on_docs("detect_sections", lambda d: prose.sections(d).select(*["doc_id", F.col("n").alias("n"), F.coalesce(F.col("challenge"), F.lit(-1)).cast("long").alias("challenge"), F.length("opening").cast("long").alias("opening"), F.length("resolution").cast("long").alias("resolution")]), f"with {sql.SECTIONS} select doc_id, n, coalesce(challenge, -1)::bigint as challenge, len(opening) as opening, len(resolution) as resolution from sections")
on_docs(
    "citation_density",
    lambda d: prose.paragraphs(d).select("doc_id", F.col("pi").cast("long").alias("pi"), (T.count(F.col("para"), _R["citation"]) / F.greatest(T.tokens(F.col("para")), F.lit(1))).alias("value")),
    f"with {sql.PARAS} select doc_id, pi, {sql.count('para', _R['citation'])}::double / greatest({sql.tokens('para')}, 1) as value from paras",
)
_ALL = " union all ".join(
    f"select doc_id, {i * 1000}::bigint + place as ord, severity, '{dimension}' as dimension, '{rule}' as rule, paragraph, sentence, span from ({SQL[rule]}) q{i}"
    for i, (rule, (_, dimension, _)) in enumerate(rules.TEXT_RULES.items())
)
_SCHIMEL = f"doc_id, overall, verdict, {', '.join(f'dim_{d}' for d in rubric.SCHIMEL)}, findings"
on_docs("schimel_findings", lambda d: rules.findings(d).withColumn("ord", F.col("ord").cast("long")).drop("message"), _ALL)
on_docs("schimel_result", lambda d: rubric.result(d, rules.findings(d), rubric.SCHIMEL), f"with {sql.SPIKED}, findings as ({_ALL}), {sql.result(rubric.SCHIMEL)} select {_SCHIMEL} from results")
on_docs("schimel_report", lambda d: (lambda found: rubric.render(rubric.result(d, found, rubric.SCHIMEL), found, "schimel", rubric.SCHIMEL))(rules.findings(d)), None)
