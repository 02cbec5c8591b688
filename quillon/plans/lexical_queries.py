"""Registered queries of structure features, dictionaries and token statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import patterns as P
from quillon.operators import features, lexical, report, structure, tells, voice
from quillon.plans import fixtures, sql
from quillon.plans.queries import on_docs

_S = sql.SPIKED
_T = "[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"


def _round(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Doubles to six digits; a nudge takes them off the halves, which engines round apart."""
    return df.select(*(F.round(F.col(c) + nudge, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _chars(parts: str) -> str:
    return f"coalesce(list_sum(list_transform({parts}, lambda x: len(x))), 0)"


def _all(text: str, p: P.Pattern, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {sql.pattern(p)}, {group})"


def _lines(p: P.Pattern) -> str:
    return f"len(list_filter(string_split(text, chr(10)), lambda x: {sql.has('x', p)}))"


def _share(n: str, of: str, empty: str) -> str:
    return f"round(case when {of} > 0 then ({n})::double / {of} else {empty} end, 6)"


_FILLED = "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')))"
_PARAS = f"list_filter(string_split_regex({sql.without(sql.without('text', P.FRONTMATTER), P.FENCE)}, '\\n[ \\t]*\\n'), lambda p: regexp_matches(p, '\\S'))"
_HEAD = "list_filter(string_split(regexp_extract(text, '(?s)\\A---[ \\t]*\\n(.*?)\\n---[ \\t]*\\n?', 1), chr(10)), lambda x: regexp_matches(x, '^[A-Za-z_][\\w-]*:'))"


def _field(name: str) -> str:
    return f"coalesce(trim(regexp_replace(list_filter({_HEAD}, lambda x: starts_with(x, '{name}:'))[1], '^[^:]*:', '')), '')"


_DESC = _field("description")
_DESC_TOKENS = f"len(regexp_extract_all({_DESC}, '{_T}'))"
STRUCTURE = {
    "struct_heading_count": sql.count("text", P.HEADING),
    "struct_max_heading_depth": f"coalesce(list_max(list_transform({_all('text', P.HEADING, 1)}, lambda x: len(x))), 0)",
    "struct_code_char_ratio": _share(_chars(_all("text", P.FENCE)), "len(text)", "null"),
    "struct_list_item_ratio": _share(f"{_lines(P.ORDERED_LINE)} + {_lines(P.BULLET_LINE)}", _FILLED, "null"),
    "struct_ordered_list_ratio": _share(_lines(P.ORDERED_LINE), _FILLED, "0"),
    "struct_bullet_list_ratio": _share(_lines(P.BULLET_LINE), _FILLED, "0"),
    "struct_table_count": sql.count("text", P.TABLE_SEPARATOR),
    "struct_frontmatter_field_count": f"len({_HEAD})",
    "struct_line_count": "case when len(text) > 0 then len(string_split(text, chr(10))) else 0 end",
    "struct_inline_code_char_ratio": _share(_chars(_all(sql.without("text", P.FENCE), P.INLINE_CODE, 1)), "len(text)", "0"),
    "struct_external_ref_count": f"{sql.count(sql.without('text', P.LINK, '$1'), P.EXTERNAL_REF)} + coalesce(list_sum(list_transform({_all('text', P.LINK, 2)}, lambda x: {sql.count('x', P.EXTERNAL_REF)})), 0)",
    "struct_named_section_present": f"case when {sql.has('text', P.NAMED_SECTION)} then 1 else 0 end",
    "struct_name_format_valid": f"case when regexp_matches({_field('name')}, '^[a-z0-9-]{{1,64}}$') then 1 else 0 end",
    "struct_long_paragraph_ratio": _share(f"len(list_filter({_PARAS}, lambda p: len(regexp_extract_all(p, '[.!?]+')) > 6))", f"len({_PARAS})", "0"),
    "fm_desc_present": f"case when len({_DESC}) > 0 then 1 else 0 end",
    "fm_desc_tokens": _DESC_TOKENS,
    "fm_desc_when_clause": f"case when {sql.has(_DESC, P.WHEN_CLAUSE)} then 1 else 0 end",
    "fm_desc_or_count": f"len(regexp_extract_all({_DESC}, '(?i)\\bor\\b'))",
    "fm_desc_wildcard_per_token": _share(sql.count(_DESC, P.WILDCARD), _DESC_TOKENS, "0"),
    "dict_contrastive_example_count": _lines(P.CONTRASTIVE),
}


def _feature(name: str):
    return lambda d: _round(d.select("doc_id", structure.columns(F.col("text"))[name].alias("value")))


for _name, _text in STRUCTURE.items():
    on_docs(_name, _feature(_name), f"with {_S} select doc_id, {_text if 'round' in _text else f'({_text})::bigint'} as value from spiked")
on_docs("struct_prose_ratio", lambda d: _round(d.select("doc_id", structure.prose_ratio(F.col("text")).alias("value"))), None)
on_docs("analyze_structure", lambda d: _round(structure.features(d)), None)

# Markdown axes against their own corpus
_AXES = [n for n in STRUCTURE if n.startswith("struct_")][:11]


def _markdown(docs: DataFrame) -> DataFrame:
    values = structure.long(docs, _AXES)
    std = F.stddev_pop("value")
    reference = values.groupBy("axis").agg(F.avg("value").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("spread"))
    return _round(voice.axis_report(values, reference))


on_docs("markdown_report", _markdown, None)
on_docs("metric_markdown", lambda d: _round(structure.long(d, _AXES)), f"with {_S} " + " union all ".join(f"select doc_id, '{n}' as axis, round(coalesce(({STRUCTURE[n]})::double, 0), 6) as value from spiked" for n in _AXES))
on_docs("metric_tells", lambda d: _round(tells.long(d).select("doc_id", "tell", "rate")), f"with {sql.LONG} select doc_id, tell, round(rate, 6) as rate from long")

# Dictionaries over plain tokens
_TOKENS = f"tok as (select doc_id, text, regexp_extract_all(lower(text), '{_T}') as t from spiked), line as (select doc_id, text, t, ' ' || array_to_string(t, '  ') || ' ' as line from tok)"


def _matches(entries: tuple[str, ...]) -> str:
    """The number of places where an entry starts, by comparing slices of the token list."""
    singles = [e for e in entries if len(lexical.phrase(e).split()) == 1]
    out = f"len(list_filter(t, lambda x: x in ({', '.join(map(sql.quoted, singles))})))"
    for e in entries:
        if e not in singles:
            parts = lexical.phrase(e).split()
            hit = " and ".join(f"t[i + {k}] = {sql.quoted(p)}" for k, p in enumerate(parts))
            out += f" + len(list_filter(range(1, len(t) + 1), lambda i: {hit}))"
    return out


_DICTIONARY = {f"dict_{name}_per_1k": _matches(entries) for name, entries in L.LEXICONS.items()} | {
    "dict_second_person_per_1k": _matches(P.SECOND_PERSON[:3] + P.SECOND_PERSON[4:]),
    "dict_cross_reference_per_1k": sql.count("text", P.CROSS_REFERENCE),
    "dict_allcaps_directive_per_1k": f"len(list_filter({sql.words('text')}, lambda w: w in ({', '.join(sql.quoted(x) for x in P.DIRECTIVES if x.isalpha())})))",
    "dict_plain_replacement_per_1k": _matches(tuple(P.PLAIN_WORDS)),
}


def _rate(name: str):
    return lambda d: _round(d.select("doc_id", lexical.dictionary(F.col("text"))[name].alias("value")))


for _name, _text in _DICTIONARY.items():
    on_docs(_name, _rate(_name), f"with {_S}, {_TOKENS} select doc_id, round(case when len(t) > 0 then ({_text})::double / len(t) * 1000 else 0 end, 6) as value from line")
_WORDS = f"w as (select doc_id, text, {sql.words('lower(text)')} as w from spiked)"


def _in(members: tuple[str, ...]) -> str:
    return f"len(list_filter(w, lambda x: x in ({', '.join(map(sql.quoted, members))})))"


_CLASSES = {"first_person_sg": L.FIRST_PERSON, "article": L.ARTICLES, "preposition": L.PREPOSITIONS, "conjunction": L.CONJUNCTIONS, "pronoun": L.PRONOUNS}
on_docs("metric_fw", lambda d: _round(d.select("doc_id", *(c.alias(n) for n, c in lexical.function_words(F.col("text")).items()))), f"with {_S}, {_WORDS} select doc_id, {', '.join(f'round({sql.per_1000(_in(m), "len(w)")}, 6) as {n}' for n, m in _CLASSES.items())} from w")
on_docs("metric_hedge", lambda d: _round(d.select("doc_id", *(c.alias(n) for n, c in lexical.hedge_metric(F.col("text")).items()))), f"with {_S}, {_TOKENS} select doc_id, round({sql.per_1000('(' + _matches(L.HEDGE_METRIC) + ')', f'len({sql.words("text")})')}, 6) as hedge_rate, round({sql.per_1000('(' + _matches(L.BOOSTER_METRIC) + ')', f'len({sql.words("text")})')}, 6) as booster_rate from line")
on_docs(
    "fw_derive_reference",
    lambda d: _round(d.select(F.posexplode(F.array(*lexical.function_words(F.col("text")).values())).alias("axis", "x")).groupBy("axis").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).select(F.col("axis").cast("long").alias("axis"), "mean", "std")),
    f"with {_S}, {_WORDS}, r as (" + " union all ".join(f"select {i} as axis, {sql.per_1000(_in(m), 'len(w)')} as x from w" for i, m in enumerate(_CLASSES.values())) + ") select axis::bigint as axis, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from r group by axis",
)



# Reports of axes that have a prior
def _prior_report(ctes: str, values: dict[str, str], table: str) -> str:
    v = " union all ".join(f"select doc_id, '{n}' as axis, {x} as value from {table}" for n, x in values.items())
    p = ", ".join(f"('{n}', {m}::double, {s}::double, {k}::double)" for n, (m, s, k) in voice.PRIORS.items())
    return f"""with {ctes}, v as ({v}), p(axis, pm, ps, k) as (values {p}),
r as (select axis, n / (n + k) * m + (1 - n / (n + k)) * pm as mean, n / (n + k) * s + (1 - n / (n + k)) * ps as spread from (select axis, avg(value) as m, stddev_pop(value) as s, count(*) as n from v group by axis) c join p using (axis)),
z as (select doc_id, axis, value, mean, (value - mean) / case when spread = 0 then 1 else spread end as z from v join r using (axis))
select doc_id, axis, round(value, 6) as value, round(mean, 6) as reference_mean, round(z, 6) as z, case when z >= 0.5 then 'fewer' when z <= -0.5 then 'more' else '' end as direction from z"""


on_docs("hedge_report", lambda d: _round(voice.prior_report(report.hedge_values(d))), _prior_report(f"{_S}, {_TOKENS}", {n: sql.per_1000(f"({_matches(e)})", f"len({sql.words('text')})") for n, e in (("hedge", L.HEDGE_METRIC), ("booster", L.BOOSTER_METRIC))}, "line"))
on_docs("fw_report", lambda d: _round(voice.prior_report(report.fw_values(d))), _prior_report(f"{_S}, {_WORDS}", {n: sql.per_1000(_in(m), "len(w)") for n, m in _CLASSES.items()}, "w"))

_SYL = "len(regexp_extract_all(x, '[aeiouy]+'))"
on_docs("readability", lambda d: _round(lexical.readability(d), 1e-9), f"""with {sql.SENTS}, s as (select doc_id, count(*) as sents from sents group by doc_id),
w as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from spiked),
r as (select w.doc_id, len(w) as n, greatest(coalesce(sents, 0), 1) as sents, coalesce(list_sum(list_transform(w, lambda x: greatest(1, {_SYL}))), 0)::double as syl,
  coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::bigint as chars, len(list_filter(w, lambda x: {_SYL} >= 3)) as poly, len(list_filter(w, lambda x: len(x) > 6)) as long,
  greatest(len(w), 1)::double as top from w left join s on w.doc_id = s.doc_id)
select doc_id, n as desc_tokens, sents as desc_sentences, chars as desc_characters, round(206.835 - 1.015 * (n::double / sents) - 84.6 * syl / top + 1e-9, 6) as flesch_reading_ease,
  round(0.39 * (n::double / sents) + 11.8 * syl / top - 15.59 + 1e-9, 6) as flesch_kincaid_grade, round(1.043 * sqrt(30.0::double * poly / sents) + 3.1291 + 1e-9, 6) as smog,
  round(0.4 * (n::double / sents + 100.0::double * poly / top) + 1e-9, 6) as gunning_fog, round(4.71 * chars / top + 0.5 * (n::double / sents) - 21.43 + 1e-9, 6) as automated_readability_index,
  round(5.89 * chars / top - 29.6 * sents / top - 15.8 + 1e-9, 6) as coleman_liau_index, round(n::double / sents + 100.0::double * long / top + 1e-9, 6) as lix, round(long::double / sents + 1e-9, 6) as rix from r""")
on_docs("read_long_sentence_ratio", lambda d: _round(lexical.prose.sentences(d).groupBy("doc_id").agg(F.avg((F.size(lexical.tokens(F.col("sent"))) > 25).cast("double")).alias("value"))), f"with {sql.SENTS} select doc_id, round(avg(case when len(regexp_extract_all(sent, '{_T}')) > 25 then 1.0 else 0.0 end)::double, 6) as value from sents group by doc_id")
on_docs("tell_staccato_run", lexical.staccato, f"""with {sql.SENTS}, n as (select doc_id, pi, si, len({sql.words('sent')}) as n from sents),
k as (select *, row_number() over (partition by doc_id order by pi, si) as k from n where n > 0),
i as (select doc_id, k - row_number() over (partition by doc_id order by pi, si) as island from k where n < 8),
r as (select doc_id, count(*) as runs from (select doc_id, island from i group by 1, 2 having count(*) >= 3) x group by doc_id)
select s.doc_id, coalesce(runs, 0) as runs from spiked s left join r on s.doc_id = r.doc_id""")
_STOP = ", ".join(map(sql.quoted, lexical.STOP))
_POS = "pos as (select doc_id, unnest(t) as word, generate_subscripts(t, 1) as pos from line)"
on_docs("leading_words", lexical.leading_words, f"""with {_S}, {_TOKENS}, {_POS},
alpha as (select * from pos where regexp_matches(word, '^\\p{{L}}+$')), big as (select doc_id from alpha group by doc_id having count(*) >= 300),
g as (select doc_id, word, pos - lag(pos) over (partition by doc_id, word order by pos) as gap from alpha where doc_id in (select doc_id from big) and word not in ({_STOP})),
f as (select doc_id, word, count(*) as count, round(stddev_pop(gap) / avg(gap), 6) as score, stddev_pop(gap) / avg(gap) as raw from g group by 1, 2)
select doc_id, place, word, count, score from (select *, row_number() over (partition by doc_id order by score desc, word) as place from f where count >= 4 and raw >= 1.3) x where place <= 10""")
on_docs("word_repetition", lambda d: lexical.repeated(d).select("doc_id", F.col("pi").cast("long").alias("pi"), "word", "span"), f"""with {sql.PARAS},
c as (select doc_id, pi, list_filter(regexp_extract_all(lower(para), '{_T}'), lambda w: len(w) >= 4 and regexp_matches(w, '^\\p{{L}}+$') and w not in ({_STOP})) as c from paras),
k as (select doc_id, pi, unnest(c) as word, generate_subscripts(c, 1) - 1 as k from c),
h as (select *, lead(k, 2) over (partition by doc_id, pi, word order by k) as last from k),
b as (select doc_id, pi, min_by(word, greatest(0, last - 19) * 1000000 + k) as word from h where last - k < 20 group by 1, 2),
n as (select *, lead(word) over (partition by doc_id, pi order by k) as nxt from k)
select doc_id, pi, word, word as span from b union all
select distinct doc_id, pi, word, word || ' / ' || nxt as span from n where word <> nxt and len(word) >= 7 and left(word, 7) = left(nxt, 7)""")
on_docs("coh_lemma_overlap_adj", lambda d: _round(lexical.overlap(d)), f"""with {sql.SENTS},
o as (select doc_id, row_number() over (partition by doc_id order by pi, si) as k, list_distinct(list_filter({sql.words('lower(sent)')}, lambda w: w not in ({_STOP}))) as c from sents),
p as (select a.doc_id, case when len(list_distinct(list_concat(a.c, b.c))) = 0 then 0 else len(list_filter(a.c, lambda x: list_contains(b.c, x)))::double / len(list_distinct(list_concat(a.c, b.c))) end as j from o a join o b on a.doc_id = b.doc_id and b.k = a.k + 1)
select s.doc_id, round(avg(j), 6) as overlap from spiked s left join p on s.doc_id = p.doc_id group by s.doc_id""")
_ZIPF = f"""{_WORDS}, u as (select doc_id, unnest(w) as word from w), z as (select word, log10(1e9::double * count(*) / (select count(*) from u)) as zipf from u group by word)"""
on_docs("lex_zipf_mean", lambda d: _round(lexical.zipf_mean(d)), f"with {_S}, {_ZIPF} select doc_id, round(avg(zipf), 6) as zipf_mean from u join z using (word) where word not in ({_STOP}) group by doc_id")
on_docs("jargon_cluster", lambda d: lexical.jargon(d, fixtures.frequencies(d)).select("doc_id", F.col("pi").cast("long").alias("pi"), F.col("si").cast("long").alias("si"), "n"), f"""with {sql.SENTS}, {_ZIPF},
r as (select doc_id, pi, si, unnest(list_distinct(regexp_extract_all(lower(sent), '\\p{{L}}{{4,}}'))) as word from sents)
select doc_id, pi, si, count(*) as n from r join z using (word) where zipf - {fixtures.SCARCER} < 3.0 group by 1, 2, 3 having count(*) >= 3""")
on_docs("chunk_words", lexical.chunks, f"""with {_S}, w as (select doc_id, regexp_extract_all(text, '\\S+') as w from spiked),
c as (select doc_id, w, unnest(range(0, len(w) // 1000)) as chunk from w) select doc_id, chunk, array_to_string(w[chunk * 1000 + 1:chunk * 1000 + 1000], ' ') as text from c""")


# Features of the one row a document
def _stats(values: str, name: str) -> str:
    return ", ".join(f"round(list_aggregate({values}, '{f}')::double, 6) as desc_{name}_{n}" for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop")))


on_docs("desc_all", lambda d: _round(features.descriptive(d)), f"""with {sql.SENTS}, s as (select doc_id, list(len(regexp_extract_all(sent, '[\\p{{L}}\\p{{N}}]+'))) as sizes from sents group by doc_id),
w as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from spiked),
r as (select w.doc_id, w, sizes, list_transform(w, lambda x: len(x)) as lengths, list_transform(w, lambda x: greatest(1, {_SYL})) as syl from w left join s on w.doc_id = s.doc_id)
select doc_id, len(w) as desc_n_tokens, len(list_distinct(w)) as desc_n_unique_tokens, round(len(list_distinct(w))::double / nullif(len(w), 0), 6) as desc_proportion_unique_tokens,
  coalesce(list_sum(lengths), 0)::bigint as desc_n_characters, coalesce(len(sizes), 0) as desc_n_sentences, {_stats("lengths", "token_length")}, {_stats("sizes", "sentence_length")}, {_stats("syl", "syllables_per_token")} from r""")
on_docs("lex_hdd", lambda d: _round(features.hdd(d)), f"""with {_S}, u as (select doc_id, unnest({sql.words('lower(text)')}) as word from spiked),
c as (select doc_id, word, count(*) as c from u group by 1, 2), n as (select doc_id, sum(c)::double as n from c group by 1),
h as (select doc_id, sum(1 - list_aggregate(list_transform(range(0, {features.DRAW}), lambda i: greatest(n - c - i, 0) / (n - i)), 'product')) / {features.DRAW} as hdd from c join n using (doc_id) where n >= {features.DRAW} group by doc_id)
select doc_id, round(hdd, 6) as hdd from spiked left join h using (doc_id)""")
on_docs("frontmatter_json", lambda d: d.select("doc_id", features.front_matter_json(F.col("text")).alias("value")), f"""with {_S}
select doc_id, '{{' || array_to_string(list_transform({_HEAD}, lambda x: to_json(split_part(x, ':', 1))::varchar || ':' || to_json(trim(regexp_replace(x, '^[^:]*:', '')))::varchar), ',') || '}}' as value from spiked""")
_PAIRS = " , ".join(f"case when contains(line, {sql.quoted(lexical.phrase(a))}) then '[\"{a}\",\"{b}\"]' end" for a, b in P.PLAIN_WORDS.items())
on_docs("dict_plain_replacements_json", lambda d: d.select("doc_id", features.plain_replacements_json(F.col("text")).alias("value")), f"with {_S}, {_TOKENS} select doc_id, '[' || array_to_string(list_filter([{_PAIRS}], lambda x: x is not null), ',') || ']' as value from line")
on_docs("analyze", lambda d: _round(features.analyze(d)), None)
