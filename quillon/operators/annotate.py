"""A rule tagger, so that rules of parts of speech run where no statistical tagger is installed.

`tokens` gives each document an array of sentences, each an array of tokens
(text, lower, lemma, pos, tag). Closed classes come first, then suffixes, then
capital letters, then nouns. It runs in Arrow batches; everything on top of it
is expressions. A relation of the same schema from another tagger fits as well.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import lexicons as L
from quillon.functions import patterns as P
from quillon.functions import text as T

TOKEN_TYPE = "struct<text:string,lower:string,lemma:string,pos:string,tag:string>"
SCHEMA = f"doc_id long, pi int, si int, sent string, tokens array<{TOKEN_TYPE}>"
_NAMES = ("text", "lower", "lemma", "pos", "tag")
_TOKEN = re.compile(r"\w+(?=n't\b)|n't\b|\w+|[^\w\s]")
_AUX = {"is": "VBZ", "are": "VBP", "was": "VBD", "were": "VBD", "be": "VB", "been": "VBN", "being": "VBG", "am": "VBP", "has": "VBZ", "have": "VBP", "had": "VBD", "do": "VBP", "does": "VBZ", "did": "VBD"}
_MODAL = {"can", "could", "may", "might", "must", "shall", "should", "will", "would"}
_PAST = {"made": "make", "found": "find", "said": "say", "went": "go", "kept": "keep", "held": "hold", "left": "leave", "ran": "run", "rose": "rise", "fell": "fall", "gave": "give", "took": "take", "came": "come", "got": "get", "knew": "know", "saw": "see", "sat": "sit", "met": "meet", "led": "lead", "lost": "lose", "built": "build", "began": "begin", "wrote": "write", "told": "tell", "stood": "stand"}
_VERBS = {"run", "make", "say", "go", "keep", "hold", "leave", "rise", "fall", "give", "take", "come", "get", "know", "see", "sit", "meet", "lead", "lose", "build", "begin", "write", "tell", "stand", "claim", "lack", "fail", "show", "argue", "suggest", "report", "find", "use", "need", "want", "think", "believe", "work", "help", "hit", "stop", "win"}
#: Words whose part of speech depends on the word after them, however they are written.
_LOOKS_AHEAD = {"".join(w) for low in ("to", "this", "that", "these", "those") for w in itertools.product(*((c, c.upper()) for c in low))}
_ABSTRACT = ("answer", "direction", "point", "shape", "tension", "question", "idea", "thing", "story", "truth")


def lemma(word: str, pos: str) -> str:
    """The base form by irregular list, then by taking suffixes off."""
    if word in _AUX:
        return "be" if word in ("is", "are", "was", "were", "be", "been", "being", "am") else "have" if word in ("has", "have", "had") else "do"
    if word in _PAST:
        return _PAST[word]
    if word == "n't":
        return "not"
    if pos in ("NOUN", "VERB") and len(word) > 3:
        if word.endswith("ies") and len(word) > 4:
            return word[:-3] + "y"
        if word.endswith(("sses", "shes", "ches", "xes")):
            return word[:-2]
        if word.endswith("s") and not word.endswith(("ss", "us", "is")):
            return word[:-1]
    if pos == "VERB":
        for end in ("ing", "ed"):
            if word.endswith(end) and len(word) > len(end) + 2:
                stem = word[: -len(end)]
                if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                    return stem[:-1]
                return stem if stem in _VERBS or not stem.endswith(("at", "iz", "us", "v", "c", "g", "os")) else stem + "e"
    return word


#: What tag() remembers of words in their surroundings; emptied when it holds this many.
REMEMBERED = 200_000
_tagged: dict[tuple, tuple[str, str, str, str, str]] = {}


def tag(words: list[str]) -> list[tuple[str, str, str, str, str]]:
    """text, lower, lemma, pos, tag of the words of a sentence.

    They depend on the word, the part of speech before it and the word after it, so most have been seen before.
    """
    out: list[tuple[str, str, str, str, str]] = []
    pos = fine = None
    last = len(words) - 1
    for k, word in enumerate(words):
        key = (word, pos, fine, words[k + 1] if k < last and word in _LOOKS_AHEAD else "", k < last)
        found = _tagged.get(key)
        if found is None:
            if len(_tagged) >= REMEMBERED:
                _tagged.clear()
            found = _tagged[key] = _tag(out, words, k)
        out.append(found)
        pos, fine = found[3], found[4]
    return out


def _tag(out: list[tuple[str, str, str, str, str]], words: list[str], k: int) -> tuple[str, str, str, str, str]:
    """What tag() says of the word at k; out has the words before it."""
    word = words[k]
    low = word.lower()
    before = out[-1] if out else None
    if not any(c.isalnum() for c in word) and low != "n't":
        pos, fine = "PUNCT", word
    elif low in _AUX:
        pos, fine = "AUX", _AUX[low]
    elif low in _MODAL:
        pos, fine = "AUX", "MD"
    elif low in ("not", "n't"):
        pos, fine = "PART", "RB"
    elif low in L.ARTICLES:
        pos, fine = "DET", "DT"
    elif low == "to" and k + 1 < len(words) and words[k + 1].lower() in _VERBS:
        pos, fine = "PART", "TO"
    elif low in ("this", "that", "these", "those") and k + 1 < len(words) and words[k + 1].lower() not in _AUX and words[k + 1].isalpha():
        pos, fine = "DET", "DT"
    elif low in L.PRONOUNS:
        pos, fine = "PRON", "PRP"
    elif low in ("my", "your", "his", "her", "its", "our", "their", "no", "some", "any", "all", "every", "each"):
        pos, fine = "DET", "DT"
    elif low in ("and", "or", "but", "nor", "yet"):
        pos, fine = "CCONJ", "CC"
    elif low in L.CONJUNCTIONS:
        pos, fine = "SCONJ", "IN"
    elif low in L.PREPOSITIONS:
        pos, fine = "ADP", "IN"
    elif word[0].isdigit():
        pos, fine = "NUM", "CD"
    elif low in _PAST:
        pos, fine = "VERB", "VBN" if before and before[3] == "AUX" and before[4] != "MD" else "VBD"
    elif word[0].isupper() and k and word.isalpha():
        pos, fine = "PROPN", "NNP"
    elif low.endswith("ly") and len(low) > 4:
        pos, fine = "ADV", "RB"
    elif low.endswith("ing") and len(low) > 5:
        noun = before is not None and before[3] in ("DET", "ADJ")
        pos, fine = ("NOUN", "NN") if noun else ("VERB", "VBG")
    elif low.endswith("ed") and len(low) > 4:
        pos, fine = "VERB", "VBN" if before and (before[3] == "AUX" or before[3] == "ADV") else "VBD"
    elif low in _VERBS:
        noun = before is not None and before[3] in ("DET", "ADJ", "ADP")
        pos, fine = ("NOUN", "NN") if noun else ("VERB", "VB" if before is None or before[4] in ("MD", "TO", "RB") else "VBP")
    elif low.endswith("s") and lemma(low, "VERB") in _VERBS and not (before and before[3] in ("DET", "ADJ", "ADP")):
        pos, fine = "VERB", "VBZ"
    elif low.endswith(("ous", "ful", "ive", "able", "ible", "ic", "al", "less")):
        pos, fine = "ADJ", "JJ"
    else:
        pos, fine = "NOUN", "NN"
    return word, low, lemma(low, pos), pos, fine


def _sentences(docs: DataFrame) -> DataFrame:
    paras = docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pi", "para"))
    return paras.select("doc_id", "pi", F.posexplode(T.sentences(F.col("para"))).alias("si", "sent"))


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pi, si, sent, tokens: a row for each sentence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = [], [0]
            for sent in batch.column(3).to_pylist():
                flat += tag(_TOKEN.findall(sent))
                ends.append(len(flat))
            columns = zip(*flat, strict=True) if flat else [()] * len(_NAMES)
            found = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], list(_NAMES))
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["doc_id", "pi", "si", "sent", "tokens"])

    return _sentences(docs).mapInArrow(run, SCHEMA)


_FINITE = {"VBP", "VBZ", "VBD", "MD"}
_US, _NO = ("we", "our", "us"), ("not", "no", "never", "cannot", "neither", "nor", "n't", "without", "fail", "lack")
_ITEM = r"^(?:[-*•]|[0-9][.)])"
#: Patterns over lines of a letter for each token; the same in Java and in Python.
_TRAIN, _PASSIVE, _SPLICE, _BURIED = "n{%d,}", "ba?p", r"sd*v[^,]*,(?!c)d*s(?:d|s)*v", "^[^sv]*s[^v]{%d,}v"


def _letters(token: tuple[str, str, str, str, str]) -> tuple:
    """What the rules of one sentence read of a token: its letter in the lines of trains, passives, splices and buried verbs; whether it is one of us, a negation, a finite verb, letters."""
    text, lower, lemma, pos, tag = token
    noun, finite = pos in ("NOUN", "PROPN"), tag in _FINITE
    return (
        "n" if noun else ".",
        "b" if lemma == "be" else "p" if tag == "VBN" else "a" if pos == "ADV" else ".",
        "," if text == "," else "c" if pos in ("CCONJ", "SCONJ") else "s" if noun or pos == "PRON" else "v" if finite else "d" if pos in ("DET", "ADJ", "ADV") else ".",
        "v" if finite else "s" if noun or pos == "PRON" else ".",
        lower in _US or lemma in _US, lower in _NO or lemma in _NO, finite or pos == "AUX", text.isalpha(),
    )


class _Codes(dict):
    """A token -> a character for what the rules read of it; a character's four letters are in `lines`, the characters that have a flag in `having`."""

    def __init__(self):
        super().__init__()
        self.code: dict[tuple, str] = {}
        self.lines: tuple[dict[int, str], ...] = ({}, {}, {}, {})
        self.having: tuple[set[str], ...] = (set(), set(), set(), set())

    def __missing__(self, token: tuple[str, str, str, str, str]) -> str:
        said = _letters(token)
        code = self.code.get(said)
        if code is None:
            code = self.code[said] = chr(33 + len(self.code))
            for line, letter in zip(self.lines, said[:4], strict=True):
                line[ord(code)] = letter
            for having, flag in zip(self.having, said[4:], strict=True):
                if flag:
                    having.add(code)
        if len(self) >= 2 * REMEMBERED:
            self.clear()
        self[token] = code
        return code


_codes = _Codes()
#: The rules of `marks` that a sentence may break, in the order in which it names them.
MARKED = ("comma_splice", "defensive_claim", "verbless_sentence", "buried_verb_core")
MARKS = "doc_id long, pi int, si int, span string, rules array<string>, trains int, passives int"


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, pi, si, span, rules, trains, passives of each sentence: what `marks_of` reads of `tokens`, made where they are tagged, so that no token is sent to the JVM."""
    splice, buried, train, passive, item = (re.compile(x) for x in (_SPLICE, _BURIED % 9, _TRAIN % 3, _PASSIVE, _ITEM))

    def read(sent: str) -> tuple[list[str], int, int]:
        code = "".join(map(_codes.__getitem__, tag(_TOKEN.findall(sent))))
        (nouns, verbs, clauses, places), (us, no, finite, alpha) = (code.translate(x) for x in _codes.lines), _codes.having
        has = set(code)
        lacks = has.isdisjoint(finite) and sum(c in alpha for c in code) >= 5 and not item.match(sent)
        fits = ("," in clauses and splice.search(clauses) is not None, not has.isdisjoint(us) and not has.isdisjoint(no), lacks, len(places) > 9 and buried.match(places) is not None)
        return [r for r, fit in zip(MARKED, fits, strict=True) if fit], len(train.findall(nouns)), len(passive.findall(verbs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(read, batch.column(3).to_pylist()))
            rules, trains, passives = zip(*found, strict=True) if found else ((), (), ())
            kept = [sent[:220] if broken else "" for sent, broken in zip(batch.column(3).to_pylist(), rules, strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(kept, pa.string()), pa.array(rules, pa.list_(pa.string())), pa.array(trains, pa.int32()), pa.array(passives, pa.int32())], ["doc_id", "pi", "si", "span", "rules", "trains", "passives"])

    return _sentences(docs).mapInArrow(run, MARKS)


def marks_of(annotated: DataFrame) -> DataFrame:
    """The same of a relation of tokens, whichever tagger made it; a span is empty where no rule is broken."""
    of = F.filter(F.array(*(F.when(c, F.lit(rule)) for rule, c in zip(MARKED, (splices(), defends(), lacks_verb(), buries()), strict=True))), lambda r: r.isNotNull())
    rows = annotated.select("doc_id", "pi", "si", "sent", of.alias("rules"), trains().alias("trains"), passives().alias("passives"))
    return rows.select("doc_id", "pi", "si", F.when(F.size("rules") > 0, F.substring("sent", 1, 220)).otherwise("").alias("span"), "rules", "trains", "passives")


def _is(field: str, *values: str):
    return lambda t: t[field].isin(*values)


def _words() -> Column:
    return F.filter("tokens", lambda t: t["pos"] != "PUNCT")


def _opens_on_verb() -> Column:
    return F.coalesce(F.get(_words(), F.lit(0))["tag"].isin("VBD", "VBZ", "VBP", "VBG"), F.lit(False))


def _says_nothing() -> Column:
    w = _words()
    noun = F.get(F.filter(w, _is("pos", "NOUN")), F.lit(0))["lower"]
    return F.coalesce((F.size(w) <= 8) & ~F.exists(w, _is("pos", "PROPN")) & F.exists(w, _is("pos", "VERB", "AUX")) & noun.isin(*_ABSTRACT), F.lit(False))


def dropped_subject(annotated: DataFrame) -> DataFrame:
    """Sentences that open on a finite verb or participle."""
    return annotated.where(_opens_on_verb()).select("doc_id", "pi", "si", "sent")


def empty_punch(annotated: DataFrame) -> DataFrame:
    """Sentences of at most eight words, without names, with a verb, whose first noun is abstract."""
    return annotated.where(_says_nothing()).select("doc_id", "pi", "si", "sent")


def rhythm(docs: DataFrame) -> DataFrame:
    """doc_id, tell, ord, n, rate, span (the first) of the two tells that need parts of speech.

    A row for either tell and each document, as `tells.long` has them for the others.
    """
    bodies = docs.select("doc_id", T.body(F.col("text")).alias("text"))
    rules = {"empty_punch": _says_nothing(), "dropped_subject": _opens_on_verb()}
    marked = tokens(bodies).select("doc_id", F.struct("pi", "si").alias("at"), "sent", *(c.alias(n) for n, c in rules.items()))
    sums = [x for n in rules for x in (F.count_if(n).alias(f"n_{n}"), F.min_by("sent", F.when(F.col(n), F.col("at"))).alias(f"span_{n}"))]
    found = bodies.select("doc_id", T.words(F.col("text")).alias("words")).join(marked.groupBy("doc_id").agg(*sums), "doc_id", "left")
    each = [
        F.struct(
            F.lit(n).alias("tell"), F.lit(list(P.TELL_META).index(n)).alias("ord"), F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias("n"),
            T.per_1000(F.coalesce(f"n_{n}", F.lit(0)), F.col("words")).alias("rate"),
            F.when(F.col(f"n_{n}") > 0, F.substring(F.col(f"span_{n}"), 1, 220)).otherwise(F.lit("")).alias("span"),
        )
        for n in rules
    ]
    return found.select("doc_id", F.inline(F.array(*each)))


def trains(least: int = 3) -> Column:
    """Runs of `least` or more nouns in a sentence."""
    line = F.concat_ws("", F.transform("tokens", lambda t: F.when(t["pos"].isin("NOUN", "PROPN"), "n").otherwise(".")))
    return F.regexp_count(line, F.lit(_TRAIN % least))


def noun_trains(annotated: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, trains: runs of `least` or more nouns."""
    by = annotated.select("doc_id", trains(least).alias("n"))
    return by.groupBy("doc_id").agg(F.sum("n").alias("trains"))


def passives() -> Column:
    """Forms of be before a participle in a sentence, an adverb between them at most."""
    line = F.concat_ws("", F.transform("tokens", lambda t: F.when(t["lemma"] == "be", "b").when(t["tag"] == "VBN", "p").when(t["pos"] == "ADV", "a").otherwise(".")))
    return F.regexp_count(line, F.lit(_PASSIVE))


#: Passives of a document that are too many for its sentences.
MANY_PASSIVES = "passives > greatest(2, 0.2 * sentences)"


def passive_voice(annotated: DataFrame) -> DataFrame:
    """doc_id, passives, sentences of documents with too many passives."""
    rows = annotated.select("doc_id", passives().alias("n"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("passives"), F.count(F.lit(1)).alias("sentences")).where(MANY_PASSIVES)


def defends() -> Column:
    """Whether a sentence has a first person plural and a negation."""
    forms = F.array_union(F.transform("tokens", lambda t: t["lower"]), F.transform("tokens", lambda t: t["lemma"]))
    us = F.array(*map(F.lit, _US))
    no = F.array(*map(F.lit, _NO))
    return F.arrays_overlap(forms, us) & F.arrays_overlap(forms, no)


def defensive_claim(annotated: DataFrame) -> DataFrame:
    """Sentences with a first person plural and a negation."""
    return annotated.where(defends()).select("doc_id", "pi", "si", "sent")


def lacks_verb(least: int = 5) -> Column:
    """Whether a sentence of `least` words, no list item, has no finite verb."""
    finite = F.exists("tokens", lambda t: t["tag"].isin("VBP", "VBZ", "VBD", "MD") | (t["pos"] == "AUX"))
    alpha = F.size(F.filter("tokens", lambda t: t["text"].rlike(r"(?U)^\p{L}+$")))
    return (alpha >= least) & ~finite & ~F.col("sent").rlike(_ITEM)


def verbless(annotated: DataFrame, least: int = 5) -> DataFrame:
    """Sentences of `least` words without a finite verb, list items aside."""
    return annotated.where(lacks_verb(least)).select("doc_id", "pi", "si", "sent")


def splices() -> Column:
    """Whether a sentence has a subject and its verb on both sides of a comma that no conjunction follows."""
    line = F.concat_ws("", F.transform("tokens", lambda t: F.when(t["text"] == ",", ",").when(t["pos"].isin("CCONJ", "SCONJ"), "c").when(t["pos"].isin("PRON", "NOUN", "PROPN"), "s").when(t["tag"].isin("VBP", "VBZ", "VBD", "MD"), "v").when(t["pos"].isin("DET", "ADJ", "ADV"), "d").otherwise(".")))
    return line.rlike(_SPLICE)


def comma_splice(annotated: DataFrame) -> DataFrame:
    """Sentences with a subject and its verb on both sides of a comma that no conjunction follows."""
    return annotated.where(splices()).select("doc_id", "pi", "si", "sent")


def buries(gap: int = 10) -> Column:
    """Whether a sentence's subject stands `gap` tokens or more before its verb."""
    line = F.concat_ws("", F.transform("tokens", lambda t: F.when(t["tag"].isin("VBP", "VBZ", "VBD", "MD"), "v").when(t["pos"].isin("NOUN", "PROPN", "PRON"), "s").otherwise(".")))
    return line.rlike(_BURIED % (gap - 1))


def buried_verb(annotated: DataFrame, gap: int = 10) -> DataFrame:
    """The first sentence of a paragraph whose subject stands `gap` tokens or more before its verb."""
    rows = annotated.where(buries(gap))
    return rows.groupBy("doc_id", "pi").agg(F.min("si").alias("si"), F.min_by("sent", "si").alias("sent"))


def padding(annotated: DataFrame, least: int = 30, below: float = 0.08) -> DataFrame:
    """Paragraphs whose share of content words lies `below` the document's mean, among those of `least` words."""
    alpha = F.filter("tokens", lambda t: t["text"].rlike(r"(?U)^\p{L}+$"))
    content = F.filter(alpha, _is("pos", "NOUN", "PROPN", "VERB", "ADJ", "ADV"))
    by = annotated.select("doc_id", "pi", F.size(alpha).alias("n"), F.size(content).alias("c")).groupBy("doc_id", "pi").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    by = by.where(F.col("n") >= least).withColumn("ratio", F.col("c") / F.col("n"))
    means = by.groupBy("doc_id").agg(F.avg("ratio").alias("mean"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    return by.join(means, "doc_id").where(F.col("ratio") < F.col("mean") - below).select("doc_id", "pi", "ratio")


def pos_rates(annotated: DataFrame) -> DataFrame:
    """doc_id, pos, rate: the share of each part of speech among all tokens."""
    by = annotated.select("doc_id", F.explode("tokens.pos").alias("pos")).groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    total = by.groupBy("doc_id").agg(F.sum("n").alias("total"))
    return by.join(total, "doc_id").select("doc_id", "pos", (F.col("n") / F.col("total")).alias("rate"))


def imperative_ratio(annotated: DataFrame) -> DataFrame:
    """doc_id, ratio of sentences that open on a base verb and aren't questions."""
    hit = (F.get(_words(), F.lit(0))["tag"] == "VB") & ~F.col("sent").endswith("?")
    return annotated.groupBy("doc_id").agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("ratio"))


def concreteness(annotated: DataFrame, norms: DataFrame) -> DataFrame:
    """doc_id, mean, coverage of content lemmas rated in norms (lemma, concreteness); no hits: 0.

    norms is a word list (tens of thousands of rows), broadcast by Spark if its size allows.
    """
    words = annotated.select("doc_id", F.explode(F.filter("tokens", _is("pos", "NOUN", "PROPN", "VERB", "ADJ", "ADV"))).alias("t")).select("doc_id", "t.lemma")
    rated = words.join(norms, "lemma", "left")
    return rated.groupBy("doc_id").agg(F.coalesce(F.avg("concreteness"), F.lit(0.0)).alias("mean"), F.avg(F.col("concreteness").isNotNull().cast("double")).alias("coverage"))


def _factors(words: list[str], threshold: float) -> float:
    """Runs of words whose share of different ones falls under the threshold; the rest counts in part."""
    factors, seen, n = 0.0, set(), 0
    for w in words:
        seen.add(w)
        n += 1
        if len(seen) / n < threshold:
            factors, seen, n = factors + 1, set(), 0
    return factors + ((1 - len(seen) / n) / (1 - threshold) if n else 0.0)


def mtld(docs: DataFrame, threshold: float = 0.72) -> DataFrame:
    """doc_id, value: lexical diversity, the words over the number of runs, forwards and backwards.

    A fold over each document's words, in Arrow batches: as an expression its sets would be arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch.column(1).to_pylist():
                ways = [_factors(w, threshold) for w in (words, words[::-1])]
                out.append(sum(len(words) / f if f else 0.0 for f in ways) / 2)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "value"])

    return docs.select("doc_id", T.every(F.lower(F.col("text")), P.WORD).alias("w")).mapInArrow(run, "doc_id long, value double")
