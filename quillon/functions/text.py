"""Columns over text: markup, clean-up, splitting, counting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import patterns as P
from quillon.functions.patterns import Pattern


def count(text: Column, pattern: Pattern) -> Column:
    """Matches of a pattern, as a long."""
    return F.regexp_count(text, F.lit(pattern.java)).cast("long")


def has(text: Column, pattern: Pattern) -> Column:
    return text.rlike(pattern.java)


def every(text: Column, pattern: Pattern, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern.java), F.lit(group))


def first(text: Column, pattern: Pattern) -> Column:
    return F.regexp_extract(text, pattern.java, 0)


def without(text: Column, pattern: Pattern, to: str = "") -> Column:
    return F.regexp_replace(text, pattern.java, to)


def chain(text: Column, steps: Iterable[tuple[Pattern, str]]) -> Column:
    for pattern, to in steps:
        text = without(text, pattern, to)
    return text


def trim(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def words(text: Column) -> Column:
    """Words of letters, digits and underscores."""
    return count(text, P.WORD)


def tokens(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return count(text, P.NON_SPACE)


def per_1000(n: Column, of: Column) -> Column:
    return F.lit(1000.0) * n / F.greatest(of, F.lit(1))


def body(text: Column) -> Column:
    """Raw text without its front matter."""
    return without(text, P.FRONTMATTER_STRICT)


def markup_step(text: Column, name: str) -> Column:
    return without(text, *P.MARKUP[name])


def strip_markup(text: Column) -> Column:
    return trim(chain(text, P.MARKUP.values()))


def clean(text: Column) -> Column:
    return trim(chain(text, P.CLEAN))


def looks_like_latex(text: Column) -> Column:
    return has(text, P.LATEX_MARK)


def strip_latex(text: Column) -> Column:
    return chain(text, P.LATEX_NOISE)


def normalize_detex(text: Column) -> Column:
    return trim(chain(text, P.DETEX))


def plain_tex(text: Column) -> Column:
    """LaTeX source as text, by expressions alone: macros go, their arguments stay."""
    text = strip_latex(text)
    for regex, to in ((r"\$\$?[^$]*\$\$?", " noun "), (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", ""), (r"[{}~]", " "), (r"\\.", " ")):
        text = without(text, Pattern(regex), to)
    return normalize_detex(text)


def prepared(text: Column) -> Column:
    """Text before scoring: LaTeX source is made plain, other text only cleaned."""
    return clean(F.when(looks_like_latex(text), plain_tex(text)).otherwise(text))


def _worded(text: Column, least: int) -> Column:
    """Whether text has at least `least` words; for one of them nothing needs to be counted."""
    return has(text, P.NON_SPACE) if least == 1 else tokens(text) >= least


def paragraphs(text: Column, least: int = 1) -> Column:
    """Trimmed paragraphs of at least `least` words."""
    return F.transform(F.filter(F.split(text, r"(?dU)\n\s*\n"), lambda p: _worded(p, least)), trim)


def sentences(paragraph: Column, least: int = 1) -> Column:
    """Trimmed sentences of at least `least` words."""
    return F.transform(F.filter(F.split(paragraph, r"(?dU)(?<=[.!?])\s+"), lambda s: _worded(s, least)), trim)


def worded(text: Column) -> Column:
    """The sentences of all paragraphs that hold a word."""
    return F.filter(F.flatten(F.transform(paragraphs(text), lambda p: sentences(p))), lambda s: has(s, P.WORD))


def _lengths(sents: Column, short: int) -> Column:
    """A letter for each sentence: s for one of fewer than `short` words, l for any other."""
    return F.array_join(F.transform(sents, lambda s: F.when(words(s) < short, "s").otherwise("l")), "")


def short_runs(sents: Column, least: int = 3, short: int = 8) -> Column:
    """Runs of `least` or more sentences of fewer than `short` words, each counted once: a fold within the row, without a shuffle."""
    return F.regexp_count(_lengths(sents, short), F.lit(f"s{{{least},}}")).cast("long")


def sentence_lengths(text: Column) -> Column:
    """The words of each sentence that has any, over all paragraphs, from one split: those of `worded`."""
    return F.filter(F.transform(F.split(text, r"(?dU)\n\s*\n|(?<=[.!?])\s+"), words), lambda n: n > 0)


def short_runs_of(lengths: Column, least: int = 3, short: int = 8) -> Column:
    """`short_runs` of sentences' lengths."""
    return F.regexp_count(F.array_join(F.transform(lengths, lambda n: F.when(n < short, "s").otherwise("l")), ""), F.lit(f"s{{{least},}}")).cast("long")


def first_short_run(sents: Column, least: int = 3, short: int = 8) -> Column:
    """The first `least` sentences of the first such run, or nothing."""
    at = F.instr(_lengths(sents, short), "s" * least)
    return F.when(at > 0, F.array_join(F.slice(sents, F.greatest(at, F.lit(1)), least), " ")).otherwise(F.lit(""))


def _cut(text: Column) -> Column:
    """Where the line that closes the front matter begins (its line feed, from 1); 0 without front matter."""
    return F.when(text.startswith("---\n"), F.instr(text, "\n---\n")).otherwise(0)


def front_matter(text: Column) -> Column:
    """The front matter with its two lines of dashes, or nothing."""
    return F.when(_cut(text) > 0, F.substr(text, F.lit(1), _cut(text) + 4)).otherwise(F.lit(""))


def after_front_matter(text: Column) -> Column:
    return trim(F.when(_cut(text) > 0, F.substr(text, _cut(text) + 5)).otherwise(text))


def slug(name: Column) -> Column:
    """A file name: lower-case runs of letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_name(name: Column) -> Column:
    """The slug of a whole name, "document" if nothing of it is left."""
    return F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("document"))


def profile_name(name: Column) -> Column:
    """A name as profiles have it; `valid_profile_name` says whether it may be one."""
    return F.replace(F.lower(trim(name)), F.lit(" "), F.lit("-"))


def valid_profile_name(name: Column) -> Column:
    return profile_name(name).rlike(r"\A[a-z0-9][a-z0-9_-]*\z")
