"""The registered queries of the pipeline operators, with their SQL where SQL can express them.

Each query is thin: it applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, lattice_dedup, near_dedup, packing, pii, sentence_pieces, substring_dedup, token_counts, toxicity, url_filter
from quillon.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding])
    and list_bool_or([x <> 0 for x in embedding])),
u as (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(id, other) as (select vec_id, vec_id from embeddings
  union select r.id, l.b from reach r join links l on r.other = l.a)
select id as vec_id, (select count(*) from links l where l.a = id) as n_links, min(other) as component_id, id = min(other) as kept
from reach group by id
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
with d as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from d group by text)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.text) as text_sha256
from d join g on d.text = g.text
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
p as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
win as (select doc_id, unnest(range(1, len(words) - 18)) as i, words from w where len(words) >= 20),
keyed as (select doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) as k from win),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from keyed) x where r > 1),
marks as (select doc_id, i, 1 as d from later union all select doc_id, i + 20, -1 from later),
sums as (select doc_id, i, sum(d) as d from marks group by doc_id, i),
cover as (select p.doc_id, p.i, p.word, coalesce(sum(s.d) over (partition by p.doc_id order by p.i), 0) > 0 as gone
  from p left join sums s on p.doc_id = s.doc_id and p.i = s.i),
kept as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
  string_agg(word, ' ' order by i) filter (where not gone) as text from cover group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.outcomes(table(spark, sf_dir, "labels")))


def _strength_sql(level: str) -> str:
    return f"""
select case when c is null or not (over_ > 0 and room > 0) then {url_filter.MOST}::double
  else greatest({url_filter.LEAST}::double, least({url_filter.MOST}::double, 1 / (over_ / room) - 1)) end as k from (
  select c, sq - sy * sy / s1 - (sy / s1) * (1 - sy / s1) * (c - 1) as over_,
    (sy / s1) * (1 - sy / s1) * (s1 - s2 / s1 - (c - 1)) as room
  from (select sum(n::double) as s1, sum(n::double * n) as s2, sum(good::double) as sy,
      sum(good::double * good / n) as sq, count(*)::double as c from {level} where n > 0) x) y
"""


def _rules_sql(what: int) -> str:
    arms = []
    for rule in sorted(url_filter.RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule[1].partition("/")
        arms.append(f"when ends_with('.' || host, '.{name}') and starts_with(path, '{slash}{rest}') then '{rule[what]}'")
    return "case " + " ".join(arms) + " end"


OP9_SQL = f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
o as (select doc_id as page_id, 1 - max(case when coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 then 1 else 0 end) as good
  from labels where quality is not null or toxic is not null group by doc_id),
hosts as (select host, count(good) as n, coalesce(sum(good), 0)::bigint as good,
  array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain,
  list_extract(string_split(host, '.'), -1) as suffix
  from p left join o on p.page_id = o.page_id group by host),
domains as (select domain, suffix, sum(n)::bigint as n, sum(good)::bigint as good from hosts group by domain, suffix),
suffixes as (select suffix, sum(n)::bigint as n, sum(good)::bigint as good from domains group by suffix),
m0 as (select (coalesce(sum(good), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) as m0 from suffixes),
k1 as ({_strength_sql('suffixes')}), k2 as ({_strength_sql('domains')}), k3 as ({_strength_sql('hosts')}),
m1 as (select suffix, (k * m0 + good) / (k + n) as m1 from suffixes, m0, k1),
m2 as (select domain, (k * m1 + good) / (k + n) as m2 from domains join m1 using (suffix), k2),
m3 as (select host, n, k, (k * m2 + good) / (k + n) as mean from hosts join m2 using (domain), k3),
r as (select host, mean, mean + {url_filter.Z}::double * sqrt(mean * (1 - mean) / (k + n + 1)) as upper_ from m3)
select page_id, host, path, {_rules_sql(1)} as rule,
  coalesce({_rules_sql(0)}, case when upper_ < {url_filter.FLOOR} then 'block' else 'allow' end) as verdict,
  round(mean, 6) as good_rate, round(upper_, 6) as upper
from p left join r using (host)
"""

def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_lattice_dedup": op3_lattice_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
}
SQL = {"op3_lattice_dedup": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op9_url_filter": OP9_SQL}
