"""Counts over plain tokens: words and single marks, lower-cased."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import patterns as P
from quillon.functions import text as T
from quillon.operators import prose

TOKEN = P.Pattern(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")
STOP = tuple(dict.fromkeys(L.ARTICLES + L.PREPOSITIONS + L.CONJUNCTIONS + L.PRONOUNS + ("is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "not", "no")))
_STOP = frozenset(STOP)


def tokens(text: Column) -> Column:
    return T.every(F.lower(text), TOKEN)


def spaced(text: Column) -> Column:
    """Tokens with a space on either side of each, so that neighbours share none."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), "  "), F.lit(" "))


def phrase(entry: str) -> str:
    """A lexicon entry as `spaced` writes it: its words and hyphens are tokens of their own."""
    return " " + "  ".join(re.findall(r"\w+|[^\w\s]", entry)) + " "


def matches(text: Column, entries: tuple[str, ...]) -> Column:
    """Places where an entry starts: single words by one alternation, phrases each by itself, since they may overlap."""
    line = spaced(text)
    single = [e for e in entries if len(phrase(e).split()) == 1]
    total = F.regexp_count(line, F.lit(" (?:" + "|".join(single) + ") "))
    for e in entries:
        if e not in single:
            total = total + F.regexp_count(line, F.lit(phrase(e)))
    return total.cast("long")


def per_1k(n: Column, text: Column) -> Column:
    size = F.size(tokens(text))
    return F.when(size > 0, n / size * 1000).otherwise(F.lit(0.0))


def dictionary(text: Column) -> dict[str, Column]:
    """Rates per 1000 tokens by name."""
    out = {f"dict_{name}_per_1k": per_1k(matches(text, entries), text) for name, entries in L.LEXICONS.items()}
    out["dict_second_person_per_1k"] = per_1k(matches(text, P.SECOND_PERSON[:3] + P.SECOND_PERSON[4:]), text)
    out["dict_cross_reference_per_1k"] = per_1k(T.count(text, P.CROSS_REFERENCE), text)
    out["dict_allcaps_directive_per_1k"] = per_1k(F.size(F.filter(T.every(text, P.WORD), lambda w: w.isin(*(d for d in P.DIRECTIVES if d.isalpha())))), text)
    out["dict_plain_replacement_per_1k"] = per_1k(matches(text, tuple(P.PLAIN_WORDS)), text)
    return out


def function_words(text: Column) -> dict[str, Column]:
    """Rates per 1000 words of closed classes, a token counting for the first class that has it."""
    words = T.every(F.lower(text), P.WORD)
    classes = {"first_person_sg": L.FIRST_PERSON, "article": L.ARTICLES, "preposition": L.PREPOSITIONS, "conjunction": L.CONJUNCTIONS, "pronoun": L.PRONOUNS}
    return {name: T.per_1000(_members(words, members), F.size(words)) for name, members in classes.items()}


def _members(words: Column, members: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*members)))


def hedge_metric(text: Column) -> dict[str, Column]:
    """Hedges and boosters per 1000 words."""
    words = T.words(text)
    return {"hedge_rate": T.per_1000(matches(text, L.HEDGE_METRIC), words), "booster_rate": T.per_1000(matches(text, L.BOOSTER_METRIC), words)}


def syllables(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+"))))


def readability(docs: DataFrame) -> DataFrame:
    """doc_id, counts and the usual indices, from words, sentences and vowel groups."""
    words = T.every(F.lower(F.col("text")), P.Pattern(r"[\p{L}\p{N}]+"))
    rows = docs.select("doc_id", words.alias("w"), F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: T.sentences(p))).alias("s"))
    rows = rows.select(
        "doc_id", F.size("w").alias("n"), F.greatest(F.size("s"), F.lit(1)).alias("sents"), syllables(F.col("w")).alias("syl"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"),
        F.size(F.filter("w", lambda x: F.regexp_count(x, F.lit("[aeiouy]+")) >= 3)).alias("poly"),
        F.size(F.filter("w", lambda x: F.length(x) > 6)).alias("long"),
    )
    n, s = F.col("n"), F.col("sents")
    some = F.greatest(n, F.lit(1))
    per = n / s
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("desc_tokens"), s.cast("long").alias("desc_sentences"), F.col("chars").alias("desc_characters"),
        (206.835 - 1.015 * per - 84.6 * F.col("syl") / some).alias("flesch_reading_ease"),
        (0.39 * per + 11.8 * F.col("syl") / some - 15.59).alias("flesch_kincaid_grade"),
        (1.043 * F.sqrt(30.0 * F.col("poly") / s) + 3.1291).alias("smog"),
        (0.4 * (per + 100.0 * F.col("poly") / some)).alias("gunning_fog"),
        (4.71 * F.col("chars") / some + 0.5 * per - 21.43).alias("automated_readability_index"),
        (5.89 * F.col("chars") / some - 29.6 * s / some - 15.8).alias("coleman_liau_index"),
        (per + 100.0 * F.col("long") / some).alias("lix"), (F.col("long") / s).alias("rix"),
    )


def staccato(docs: DataFrame, least: int = 3, short: int = 8) -> DataFrame:
    """doc_id, runs: runs of `least` or more sentences of fewer than `short` words, each counted once."""
    return docs.select("doc_id", T.worded(F.col("text")).alias("s")).select("doc_id", T.short_runs(F.col("s"), least, short).alias("runs"))


def _coded(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The list of each word, its number in the vocabulary, and the vocabulary of a batch."""
    flat = words.flatten().dictionary_encode()
    lists = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    return lists, flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


def _flags(vocabulary: list[str], fits: Callable[[str], bool]) -> np.ndarray:
    return np.fromiter((fits(w) for w in vocabulary), bool, len(vocabulary))


def leading_words(docs: DataFrame, least: int = 300, occurrences: int = 4, score: float = 1.3, most: int = 10) -> DataFrame:
    """doc_id, word, count, score of content words whose places cluster: the deviation of their gaps over the mean.

    A document's words stay in their row; the gaps of a batch are taken at once from arrays of its words' numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, code, vocabulary = _coded(batch.column(1))
            if not len(doc):
                continue
            place = np.arange(len(doc))
            alpha = _flags(vocabulary, str.isalpha)
            content = alpha & ~_flags(vocabulary, _STOP.__contains__)
            big = np.bincount(doc, weights=alpha[code], minlength=batch.num_rows) >= least
            kept = content[code] & big[doc]
            doc, code, place = doc[kept], code[kept], place[kept]
            if not len(doc):
                continue
            order = np.lexsort((place, code, doc))
            doc, code, place = doc[order], code[order], place[order]
            start = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])[0]
            count = np.diff(np.r_[start, len(doc)])
            start, count = start[count >= max(occurrences, 2)], count[count >= max(occurrences, 2)]
            found = []
            for at, n in zip(start.tolist(), count.tolist(), strict=True):
                gaps = np.diff(place[at : at + n])
                if (value := gaps.std() / gaps.mean()) >= score:
                    found.append((doc[at], vocabulary[code[at]], n, value))
            if found:
                rows, word, n, value = zip(*found, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(word), pa.array(n, pa.int64()), pa.array(value, pa.float64())], ["doc_id", "word", "count", "score"])

    rows = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    found = rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, word string, count long, score double").withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "word"))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("doc_id", "place", "word", "count", "score")


def _repetitions(docs: DataFrame, window: int, repeats: int, stem: int) -> DataFrame:
    """doc_id, pi, word, span, burst of each paragraph: its burst, and its pairs of neighbours that share a stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            para, code, vocabulary = _coded(batch.column(2))
            kept = _flags(vocabulary, lambda w: len(w) >= 4 and w.isalpha() and w not in _STOP)[code] if len(code) else np.zeros(0, bool)
            para, code = para[kept], code[kept]
            if not len(para):
                continue
            k = np.arange(len(para)) - np.r_[0, np.cumsum(np.bincount(para, minlength=batch.num_rows))][para]
            order = np.lexsort((k, code, para))
            p, c, at = para[order], code[order], k[order]
            far = repeats - 1
            found = []
            if len(p) > far:
                hit = np.nonzero((p[far:] == p[: len(p) - far]) & (c[far:] == c[: len(p) - far]) & (at[far:] - at[: len(p) - far] < window))[0]
                # the window that starts first, and in it the word that comes first
                start = np.maximum(0, at[hit + far] - (window - 1))
                hit = hit[np.lexsort((at[hit], start, p[hit]))]
                hit = hit[np.r_[True, p[hit][1:] != p[hit][:-1]]] if len(hit) else hit
                found += [(p[h], vocabulary[c[h]], vocabulary[c[h]], True) for h in hit.tolist()]
            stems: dict[str, int] = {}
            shared = np.array([stems.setdefault(w[:stem], len(stems)) if len(w) >= stem else -1 for w in vocabulary])
            pairs = np.nonzero((para[1:] == para[:-1]) & (code[1:] != code[:-1]) & (shared[code[1:]] == shared[code[:-1]]) & (shared[code[1:]] >= 0))[0]
            found += dict.fromkeys((para[h], vocabulary[code[h]], f"{vocabulary[code[h]]} / {vocabulary[code[h + 1]]}", False) for h in pairs.tolist())
            if found:
                rows, word, span, burst = zip(*found, strict=True)
                rows = pa.array(rows, pa.int64())
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(word), pa.array(span), pa.array(burst)], ["doc_id", "pi", "word", "span", "burst"])

    rows = prose.paragraphs(docs).select("doc_id", "pi", tokens(F.col("para")).alias("w"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, pi int, word string, span string, burst boolean")


def bursts(docs: DataFrame, window: int = 20, repeats: int = 3) -> DataFrame:
    """doc_id, pi, word: the first word of each paragraph that occurs `repeats` times within `window` content words."""
    return _repetitions(docs, window, repeats, 7).where("burst").select("doc_id", "pi", "word")


def repeated(docs: DataFrame, stem: int = 7) -> DataFrame:
    """doc_id, pi, word, span: the bursts, and each two neighbouring content words that differ but share their first `stem` letters."""
    return _repetitions(docs, 20, 3, stem).drop("burst")


def overlap(docs: DataFrame) -> DataFrame:
    """doc_id, overlap: the mean Jaccard overlap of neighbouring sentences' content words; null for fewer than two sentences."""
    content = lambda s: F.array_distinct(F.filter(T.every(F.lower(s), P.WORD), lambda w: ~w.isin(*STOP)))
    sets = F.transform(F.flatten(F.transform(T.paragraphs(F.col("text")), lambda p: T.sentences(p))), content)
    rows = docs.select("doc_id", sets.alias("s"))
    pairs = F.zip_with(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))))
    return rows.select("doc_id", F.when(F.size("s") >= 2, F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / (F.size("s") - 1)).alias("overlap"))


def zipf(docs: DataFrame) -> DataFrame:
    """word, zipf: log10 of a word's occurrences in a thousand million words of the corpus itself."""
    by = docs.select(F.explode(T.every(F.lower(F.col("text")), P.WORD)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("word", F.log10(F.lit(1e9) * F.col("n") / F.col("total")).alias("zipf"))


def zipf_mean(docs: DataFrame) -> DataFrame:
    """doc_id, mean zipf of content words."""
    words = docs.select("doc_id", F.explode(T.every(F.lower(F.col("text")), P.WORD)).alias("word")).where(~F.col("word").isin(*STOP))
    counted = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(zipf(docs), "word").groupBy("doc_id").agg((F.sum(F.col("n") * F.col("zipf")) / F.sum("n")).alias("zipf_mean"))


def jargon(docs: DataFrame, frequencies: DataFrame | None = None, rare: float = 3.0, least: int = 3) -> DataFrame:
    """doc_id, pi, si, n of sentences with `least` different rare words of four letters or more, whatever their part of speech.

    frequencies: word, zipf; the corpus' own without it. `tagged.jargon` leaves names out.
    """
    words = prose.sentences(docs).select("doc_id", "pi", "si", F.explode(F.array_distinct(T.every(F.lower(F.col("sent")), P.Pattern(r"\p{L}{4,}")))).alias("word"))
    uncommon = (zipf(docs) if frequencies is None else frequencies).where(F.col("zipf") < rare)
    return words.join(uncommon, "word").groupBy("doc_id", "pi", "si").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def chunks(docs: DataFrame, size: int = 1000) -> DataFrame:
    """doc_id, chunk, text: runs of `size` words; what is left at the end is dropped."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("w"))
    n = F.floor(F.size("w") / size).cast("int")
    rows = rows.where(F.size("w") >= size).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.slice("w", F.col("chunk") * size + 1, size), " ").alias("text"))
