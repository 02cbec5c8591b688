"""Pieces of ANSI SQL (with RE2 patterns) that say what the operators compute."""

from __future__ import annotations

from quillon.functions import patterns as P
from quillon.functions.patterns import Pattern
from quillon.plans.fixtures import SPIKED


def quoted(text: str) -> str:
    """A string literal; characters that differ between dialects are spelled by their code."""
    return "'" + text.replace("'", "''") + "'"


def pattern(p: Pattern) -> str:
    return quoted(p.re2)


def words(text: str) -> str:
    return f"regexp_extract_all({text}, {pattern(P.WORD)})"


def count(text: str, p: Pattern) -> str:
    if p in (P.RULES["nominal"], P.RULES["acronym"]):  # \b and \w know ASCII only there
        whole = Pattern(p.regex.replace(r"\b", "").replace(r"\w", r"[\p{L}\p{N}_]"), p.flags)
        return f"len(list_filter({words(text)}, lambda w: regexp_full_match(w, {pattern(whole)})))"
    return f"len(regexp_extract_all({text}, {pattern(p)}))"


def has(text: str, p: Pattern) -> str:
    return f"regexp_matches({text}, {pattern(p)})"


def without(text: str, p: Pattern, to: str = "") -> str:
    to = quoted(to.replace("$", "\\")) if "\n" not in to else " || ".join("chr(10)" if x == "\n" else quoted(x.replace("$", "\\")) for x in _split(to))
    return f"regexp_replace({text}, {pattern(p)}, {to}, 'g')"


def _split(text: str) -> list[str]:
    out: list[str] = []
    for part in text.split("\n"):
        out += [part, "\n"] if part else ["\n"]
    return out[:-1]


def chain(text: str, steps) -> str:
    for p, to in steps:
        text = without(text, p, to)
    return text


def trim(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '\\S+'))"


def body(text: str) -> str:
    return without(text, P.FRONTMATTER_STRICT)


def per_1000(n: str, of: str) -> str:
    return f"(1000.0::double * {n} / greatest({of}, 1))"


def paragraph_list(text: str, least: int = 1) -> str:
    return f"list_transform(list_filter(string_split_regex({text}, '\\n\\s*\\n'), lambda p: {tokens('p')} >= {least}), lambda p: {trim('p')})"


def sentence_list(text: str, least: int = 1) -> str:
    split = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_transform(list_filter({split}, lambda s: {tokens('s')} >= {least}), lambda s: {trim('s')})"


PARAS = f"""{SPIKED},
listed as (select doc_id, text, {paragraph_list('text')} as paras from spiked),
paras as (select doc_id, generate_subscripts(paras, 1) - 1 as pi, unnest(paras) as para from listed)"""
SENTS = f"""{PARAS},
sents as (select doc_id, pi, generate_subscripts(s, 1) - 1 as si, unnest(s) as sent from (select doc_id, pi, {sentence_list('para')} as s from paras) x)"""
SECTIONS = f"""{PARAS},
scored as (select doc_id, text, paras, len(paras) as n,
  list_transform(paras[1:least(len(paras), greatest(2, (len(paras) + 2) // 3))], lambda p: {count('p', P.RULES['challenge'])}) as scores from listed),
sections as (select doc_id, text, paras, n, array_to_string(paras[1:2], chr(10) || chr(10)) as opening, coalesce(paras[n], '') as resolution,
  case when list_max(scores) > 0 then list_position(scores, list_max(scores)) - 1 end as challenge from scored)"""

PLAIN = (*P.TELLS, "staccato_run")
_WORDED = f"list_filter(flatten(list_transform({paragraph_list('body')}, lambda q: {sentence_list('q')})), lambda x: {has('x', P.WORD)})"
_LENGTHS = f"array_to_string(list_transform(sents, lambda x: case when len({words('x')}) < 8 then 's' else 'l' end), '')"
COUNTS = f"""{SPIKED},
bodies as (select doc_id, {body('text')} as body from spiked),
lengths as (select doc_id, body, sents, {_LENGTHS} as lengths from (select doc_id, body, {_WORDED} as sents from bodies) x),
counts as (select doc_id, body, sents, lengths, len({words('body')}) as words, {', '.join(f'{count("body", p)} as {n}' for n, p in P.TELLS.items())}, len(regexp_extract_all(lengths, 's{{3,}}')) as staccato_run from lengths)"""


def first_tell(name: str) -> str:
    if name == "staccato_run":
        return "case when strpos(lengths, 'sss') > 0 then array_to_string(sents[strpos(lengths, 'sss'):strpos(lengths, 'sss') + 2], ' ') else '' end"
    return trim(f"regexp_extract(body, {pattern(P.TELLS[name])})")


def meta_values() -> str:
    """tell, ord, label, dimension, prior of the tells that text alone shows."""
    rows = ", ".join(f"({quoted(n)}, {i}, {quoted(m[0])}, {quoted(m[1])}, {m[2]}::double)" for i, (n, m) in enumerate(P.TELL_META.items()) if n in PLAIN)
    return f"meta(tell, ord, label, dimension, prior) as (values {rows})"


LONG = f"""{COUNTS}, {meta_values()},
found as ({' union all '.join(f"select doc_id, {quoted(n)} as tell, {n} as n, {per_1000(n, 'words')} as rate, left({first_tell(n)}, 220) as span from counts" for n in PLAIN)}),
long as (select doc_id, found.tell, ord, n, rate, span, label, dimension, prior from found join meta using (tell))"""
NORM = f"norm as ({' union all '.join(f'select {quoted(n)} as tell, avg(rate_{n}) as mean, stddev_pop(rate_{n}) as std from rated' for n in PLAIN)})"
RATED = f"rated as (select doc_id, {', '.join(f'{per_1000(n, "words")} as rate_{n}' for n in PLAIN)} from counts)"
ABSOLUTE = f"""{LONG},
findings as (select doc_id, ord, case when prior >= 0.5 then 'high' when prior >= 0.3 then 'medium' else 'low' end as severity, dimension, tell as rule,
  null::bigint as paragraph, null::bigint as sentence, span, n || '× ' || label || ' — reads like a machine''s habit; vary it or leave it out.' as message from long where n > 0)"""
RELATIVE = f"""{LONG}, {RATED}, {NORM},
z as (select *, (rate - mean) / case when std = 0 then 1 else std end as z from long join norm using (tell) where n > 0),
findings as (select doc_id, ord, case when z >= 3 then 'high' when z >= 2 then 'medium' else 'low' end as severity, dimension, tell as rule,
  null::bigint as paragraph, null::bigint as sentence, span, n || '× ' || label || ' — ' ||
  case when z >= 3 then 'far above' when z >= 2 then 'well above' else 'above' end || ' your corpus norm; use it less.' as message from z where z > 1)"""


def result(weights: dict[str, float], docs: str = "spiked") -> str:
    """CTEs from findings to results."""
    dims = ", ".join(f"greatest(0, 1 - round(coalesce(sum(penalty) filter (where dimension = '{d}'), 0), 6)) as dim_{d}" for d in weights)
    overall = " + ".join(f"dim_{d} * {w}" for d, w in weights.items())
    return f"""by_rule as (select doc_id, dimension, rule, min_by(case severity when 'high' then 0.25::double when 'medium' then 0.10::double else 0.05::double end, ord) as penalty,
  max(case when severity = 'high' then 1 else 0 end) as high, count(*) as n from findings group by doc_id, dimension, rule),
dims as (select d.doc_id, {dims}, coalesce(sum(n), 0)::bigint as findings,
  coalesce(max(high) filter (where dimension in ('challenge', 'resolution', 'opening')), 0) as decisive from {docs} d left join by_rule b on d.doc_id = b.doc_id group by d.doc_id),
results as (select doc_id, round(({overall}) / {sum(weights.values())}::double, 6) as overall,
  case when ({overall}) / {sum(weights.values())} < 0.55 or decisive = 1 then 'fail' when ({overall}) / {sum(weights.values())} < 0.75 then 'warn' else 'pass' end as verdict,
  {', '.join(f'round(dim_{d}, 6) as dim_{d}' for d in weights)}, findings from dims)"""
