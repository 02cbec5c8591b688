"""Prose of extracted papers: predicates on paragraphs as columns, and the excerpt of abstract and introduction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions import text as T

# What marks a paragraph as metadata.
PHRASES = ("downloaded from", "all rights reserved", "created from", "proquest", "manuscript received", "corresponding editor")
INSTITUTIONS = ("university", "department", "institute", "school", "center", "centre", "laboratory")
NAMES_ONLY = P.Pattern(r"^[A-Za-z0-9*†‡◁⋄ ,()\-]+$")
ABSTRACT = re.compile(r"^abstract\b[:.]?\s*", re.I)
INTRODUCTION = re.compile(r"^(?:\d+(?:\.\d+)*)?\s*introduction\b[:.]?\s*", re.I)  # fixed, as is ABSTRACT
LETTER, SINGLE = P.Pattern(r"\p{L}"), P.Pattern(r"(?:^|\s)\S(?=\s|$)")


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark)))


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.lower(text).startswith(p)
    return out


def looks_like_prose(text: Column) -> Column:
    """180 characters or more, mostly letters, few one-character tokens, no caption's or list's start."""
    singles = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) == 1))
    letters = T.count(text, LETTER) / F.greatest(F.regexp_count(text, F.lit(r"(?U)\S")), F.lit(1))
    return (F.length(text) >= 180) & ~_starts(text, P.NOT_PROSE_PREFIXES) & (letters >= 0.6) & (singles <= F.greatest(F.lit(12), F.floor(T.tokens(text) / 5)))


def is_heading(text: Column) -> Column:
    return (F.length(text) <= 100) & T.has(text, P.PAPER_HEADING) & ~text.endswith(".")


def looks_like_metadata(text: Column) -> Column:
    low, commas = F.lower(text), _count(text, ",")
    said = F.lit(False)
    for phrase in PHRASES:
        said = said | low.contains(phrase)
    places = sum(low.contains(w).cast("int") for w in INSTITUTIONS)
    short = F.length(text) < 500
    return (
        _starts(text, (*P.METADATA_PREFIXES, "fig. ", "figure ", "reports ")) | said | (text.contains("@") & short)
        | ((commas >= 5) & (_count(text, ".") <= 2) & short) | ((places >= 3) & (commas >= 4)) | (T.has(text, NAMES_ONLY) & (T.tokens(text) < 30))
    )


# What an extracted line of a paper's head or foot says, and what stands within its paragraphs.
LINE_PHRASES = ("copyright", "all rights reserved", "created from", "proquest", "tel.:", "fax:")
NAMES_LINE = P.Pattern(r"^[A-Za-z0-9*†‡◁⋄ ,()\-:/&.]+$")
BOILERPLATE = (
    P.Pattern(r"\bShared first authorship\.\s*", "i"), P.Pattern(r"\bKeywords:\s*[^.]+\.?", "i"), P.Pattern(r"[∗*†‡]+\s*Equal contribution\.\s*", "i"),
    P.Pattern(r"[∗*†‡]+\s*Corresponding author:.*", "i"), P.Pattern(r"^\d+(?:\.\d+)*\.\s+Introduction\s+", "i"), P.Pattern(r"\s+\*\s*$"),
)
SENTENCE_LIKE = P.Pattern(r"[A-Z][a-z]+(?: [a-z][A-Za-z\-]+){1,8} (?:is|are|was|were|has|have|can|may|will|should|could|would|must)\b")


def looks_like_metadata_line(line: Column) -> Column:
    """An empty line, a contact, a notice, or a short line of names without a full stop."""
    low = F.lower(T.trim(line))
    said = F.lit(False)
    for phrase in LINE_PHRASES:
        said = said | low.contains(phrase)
    words = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))))
    named = (F.length(line) < 120) & T.has(line, NAMES_LINE) & (F.size(words) > 0) & (capital >= F.greatest(F.lit(2.0), F.size(words) * 0.6)) & ~line.endswith(".")
    return (low == "") | _starts(low, P.METADATA_PREFIXES) | (line.contains("@") & (F.length(line) < 300)) | said | named


def normalize_paragraph(para: Column) -> Column:
    """A paragraph's lines joined, without lines of metadata and boilerplate, up to its last full stop, if it has one."""
    lines = F.filter(F.transform(F.split(para, "\n"), T.trim), lambda x: ~looks_like_metadata_line(x))
    text = F.array_join(lines, " ")
    for pattern in BOILERPLATE:
        text = T.without(text, pattern)
    whole = F.regexp_extract(text, r"(?s)\A(.+[.!?]).*?\z", 1)
    cut = F.when(text.rlike(r"[.!?][\])\"']?\z") | (whole == ""), text).otherwise(whole)
    return T.trim(F.regexp_replace(cut, r"(?U)\s{2,}", " "))


def strip_title_author_preamble(para: Column, title: Column) -> Column:
    """A paragraph without the title, and without what stands before "abstract" or, after figures or many commas, before its first sentence."""
    head = F.lower(F.substr(para, F.lit(1), F.length(T.trim(title)))) == F.lower(T.trim(title))
    bare = F.when((title != "") & head, F.regexp_replace(F.substr(para, F.length(T.trim(title)) + 1), r"(?U)\A\s+", "")).otherwise(para)
    abstract, first = F.instr(F.lower(bare), "abstract "), F.regexp_instr(bare, F.lit(SENTENCE_LIKE.java))
    before = F.substr(bare, F.lit(1), F.greatest(first - 1, F.lit(0)))
    names = before.rlike("[0-9]") | (_count(before, ",") >= 3)
    return F.when(abstract > 1, F.substr(bare, abstract)).when((first > 1) & names, F.substr(bare, first)).otherwise(bare)


def cleanup(docs: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, text: the front matter as it is, a blank line, and the excerpt of the rest."""
    body = docs.select("doc_id", T.after_front_matter(F.col("text")).alias("text"))
    front = docs.select("doc_id", T.front_matter(F.col("text")).alias("front"))
    text = F.when(F.col("front") == "", F.col("excerpt")).otherwise(F.concat(T.trim(F.col("front")), F.lit("\n\n"), F.col("excerpt")))
    return front.join(excerpts(body, most), "doc_id").select("doc_id", text.alias("text"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, pi, para, prose, heading, metadata of each paragraph of the cleaned text."""
    rows = docs.select("doc_id", F.posexplode(T.paragraphs(T.clean(F.col("text")))).alias("pi", "para"))
    para = F.col("para")
    return rows.select("doc_id", "pi", "para", looks_like_prose(para).alias("prose"), is_heading(para).alias("heading"), looks_like_metadata(para).alias("metadata"))


def _excerpt(rows: list[dict], most: int) -> list[str]:
    """Paragraphs of an abstract (two at most) and an introduction (`most`); else the first prose; else the longest."""
    start = next((i for i, r in enumerate(rows) if r["prose"] or ABSTRACT.match(r["para"]) or INTRODUCTION.match(r["para"])), len(rows))
    rows = [r for r in rows[start:] if not r["metadata"]]
    opening = next((i for i, r in enumerate(rows) if INTRODUCTION.match(r["para"])), None)
    out: list[str] = []
    for r in rows[: len(rows) if opening is None else opening]:
        if ABSTRACT.match(r["para"]):
            out += [x] if (x := ABSTRACT.sub("", r["para"], count=1).strip()) else []
        elif len(out) == 1 and r["prose"]:
            out.append(r["para"])
    if opening is not None:
        taken = 0
        for r in rows[opening:]:
            if INTRODUCTION.match(r["para"]):
                said = INTRODUCTION.sub("", r["para"], count=1).strip()
                if len(said) >= 180:
                    out.append(said)
                    taken += 1
                continue
            if r["heading"] or taken >= most:
                break
            if r["prose"]:
                out.append(r["para"])
                taken += 1
    return out or [r["para"] for r in rows if r["prose"]][: most + 2] or sorted((r["para"] for r in rows), key=len, reverse=True)[:most]


def excerpts(docs: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, excerpt: the abstract and introduction of each document, without metadata; front matter is dropped.

    A document's paragraphs are judged by expressions and walked once in an Arrow batch.
    """
    body = docs.select("doc_id", T.markup_step(F.col("text"), "strip_frontmatter").alias("text"))
    paras = T.paragraphs(T.clean(F.col("text")))
    each = F.transform(paras, lambda p: F.struct(p.alias("para"), looks_like_prose(p).alias("prose"), is_heading(p).alias("heading"), looks_like_metadata(p).alias("metadata")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ["\n\n".join(_excerpt(rows, most)) for rows in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["doc_id", "excerpt"])

    return body.select("doc_id", each.alias("p")).mapInArrow(run, "doc_id long, excerpt string")
