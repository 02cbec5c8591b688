"""Registered queries of paper clean-up, with the SQL of the predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.operators import papers
from quillon.plans import sql
from quillon.plans.queries import on_docs

_CLEANED = f"""{sql.SPIKED}, cleaned as (select doc_id, {sql.trim(sql.chain('text', P.CLEAN))} as text from spiked),
listed as (select doc_id, {sql.paragraph_list('text')} as paras from cleaned),
p as (select doc_id, generate_subscripts(paras, 1) - 1 as pi, unnest(paras) as para from listed)"""


def _starts(prefixes: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"starts_with(lower(para), {sql.quoted(p)})" for p in prefixes) + ")"


def _marks(mark: str) -> str:
    return f"(len(para) - len(replace(para, '{mark}', '')))"


_WORDS = "regexp_extract_all(para, '\\S+')"
_SQL = {
    "looks_like_prose": f"len(para) >= 180 and not {_starts(P.NOT_PROSE_PREFIXES)} and len(regexp_extract_all(para, '\\p{{L}}'))::double / greatest(len(regexp_extract_all(para, '\\S')), 1) >= 0.6 and len(list_filter({_WORDS}, lambda w: len(w) = 1)) <= greatest(12, len({_WORDS}) // 5)",
    "is_heading": f"len(para) <= 100 and {sql.has('para', P.PAPER_HEADING)} and not ends_with(para, '.')",
    "looks_like_metadata": f"""{_starts((*P.METADATA_PREFIXES, 'fig. ', 'figure ', 'reports '))} or {' or '.join(f"contains(lower(para), '{x}')" for x in papers.PHRASES)} or (contains(para, '@') and len(para) < 500)
  or ({_marks(',')} >= 5 and {_marks('.')} <= 2 and len(para) < 500) or ({' + '.join(f"contains(lower(para), '{x}')::int" for x in papers.INSTITUTIONS)} >= 3 and {_marks(',')} >= 4) or ({sql.has('para', papers.NAMES_ONLY)} and len({_WORDS}) < 30)""",
}
for _name, _column in {"looks_like_prose": "prose", "is_heading": "heading", "looks_like_metadata": "metadata"}.items():
    on_docs(_name, lambda d, c=_column: papers.judged(d).select("doc_id", F.col("pi").cast("long").alias("pi"), F.col(c).alias("value")), f"with {_CLEANED} select doc_id, pi, {_SQL[_name]} as value from p")
on_docs("extract_prose_excerpt", papers.excerpts, None)

_LINE_WORDS = "regexp_extract_all(line, '\\S+')"
_LOW = sql.trim("line")
on_docs(
    "looks_like_metadata_line",
    lambda d: d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", F.col("i").cast("long").alias("i"), papers.looks_like_metadata_line(F.col("line")).alias("value")),
    f"""with {sql.SPIKED}, l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from spiked)
select doc_id, i, {_LOW} = '' or {' or '.join(f"starts_with(lower({_LOW}), {sql.quoted(p)})" for p in P.METADATA_PREFIXES)} or (contains(line, '@') and len(line) < 300) or {' or '.join(f"contains(lower({_LOW}), {sql.quoted(p)})" for p in papers.LINE_PHRASES)}
  or (len(line) < 120 and {sql.has('line', papers.NAMES_LINE)} and len({_LINE_WORDS}) > 0 and len(list_filter({_LINE_WORDS}, lambda w: left(w, 1) <> lower(left(w, 1)))) >= greatest(2.0, len({_LINE_WORDS}) * 0.6) and not ends_with(line, '.')) as value from l""",
)
on_docs("normalize_paragraph", lambda d: papers.judged(d).select("doc_id", F.col("pi").cast("long").alias("pi"), papers.normalize_paragraph(F.col("para")).alias("value")), None)
on_docs("strip_title_author_preamble", lambda d: d.select("doc_id", papers.strip_title_author_preamble(F.col("text"), F.lit("")).alias("value")), None)
on_docs("cleanup_paper_markdown", papers.cleanup, None)
