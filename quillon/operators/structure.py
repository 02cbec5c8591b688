"""Structure of raw markup, one row of features a document, from expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T


def _chars(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + F.length(x))


def _lines(text: Column, pattern: P.Pattern) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: T.has(x, pattern))).cast("long")


def _share(n: Column, of: Column, empty: float | None) -> Column:
    return F.when(of > 0, n / of).otherwise(F.lit(empty).cast("double"))


def _frontmatter(text: Column) -> Column:
    """Front matter as a map of its flat `key: value` lines."""
    head = F.regexp_extract(text, r"(?ds)\A---[ \t]*\n(.*?)\n---[ \t]*\n?", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))))


def columns(text: Column) -> dict[str, Column]:
    """name -> column of the features of raw text; null where a share of nothing has no value."""
    n = F.length(text)
    lines = F.split(text, "\n")
    filled = F.size(F.filter(lines, lambda x: T.tokens(x) > 0))
    ordered, bullets = _lines(text, P.ORDERED_LINE), _lines(text, P.BULLET_LINE)
    bare = T.without(text, P.FENCE)
    paras = F.filter(F.split(T.without(T.without(text, P.FRONTMATTER), P.FENCE), r"\n[ \t]*\n"), lambda p: T.tokens(p) > 0)
    long = F.size(F.filter(paras, lambda p: F.regexp_count(p, F.lit("[.!?]+")) > 6))
    front = _frontmatter(text)
    description = F.coalesce(front["description"], F.lit(""))
    described = F.length(description) > 0
    depth = F.array_max(F.transform(T.every(text, P.HEADING, 1), F.length))
    in_links = F.aggregate(T.every(text, P.LINK, 2), F.lit(0).cast("long"), lambda k, x: k + T.count(x, P.EXTERNAL_REF))
    tokens = T.count(description, P.Pattern(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))
    return {
        "struct_heading_count": T.count(text, P.HEADING),
        "struct_max_heading_depth": F.coalesce(depth, F.lit(0)).cast("long"),
        "struct_code_char_ratio": _share(_chars(T.every(text, P.FENCE)), n, None),
        "struct_list_item_ratio": _share(ordered + bullets, filled, None),
        "struct_ordered_list_ratio": _share(ordered, filled, 0.0),
        "struct_bullet_list_ratio": _share(bullets, filled, 0.0),
        "struct_table_count": T.count(text, P.TABLE_SEPARATOR),
        "struct_frontmatter_field_count": F.size(F.map_keys(front)).cast("long"),
        "struct_line_count": F.when(n > 0, F.size(lines)).otherwise(0).cast("long"),
        "struct_inline_code_char_ratio": _share(_chars(T.every(bare, P.INLINE_CODE, 1)), n, 0.0),
        "struct_external_ref_count": T.count(T.without(text, P.LINK, "$1"), P.EXTERNAL_REF) + in_links,
        "struct_named_section_present": T.has(text, P.NAMED_SECTION).cast("long"),
        "struct_name_format_valid": F.coalesce(front["name"].rlike("^[a-z0-9-]{1,64}$"), F.lit(False)).cast("long"),
        "struct_long_paragraph_ratio": _share(long, F.size(paras), 0.0),
        "fm_desc_present": described.cast("long"),
        "fm_desc_tokens": tokens,
        "fm_desc_when_clause": T.has(description, P.WHEN_CLAUSE).cast("long"),
        "fm_desc_or_count": T.count(description, P.Pattern(r"\bor\b", "i")),
        "fm_desc_wildcard_per_token": _share(T.count(description, P.WILDCARD), tokens, 0.0),
        "dict_contrastive_example_count": _lines(text, P.CONTRASTIVE),
    }


def prose_ratio(text: Column) -> Column:
    return _share(F.length(T.strip_markup(text)), F.length(text), None)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and all structure features."""
    return docs.select("doc_id", *(c.alias(n) for n, c in columns(F.col("text")).items()), prose_ratio(F.col("text")).alias("struct_prose_ratio"))


def long(docs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """doc_id, axis, value: the features as rows, null as 0."""
    each = columns(F.col("text"))
    rows = docs.select("doc_id", *(F.coalesce(each[n].cast("double"), F.lit(0.0)).alias(n) for n in names or each))
    return rows.unpivot("doc_id", names or list(each), "axis", "value")
