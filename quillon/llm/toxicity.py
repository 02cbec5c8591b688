"""Toxicity by votes of the nearest labelled examples.

Terms are a text's words, lower-cased, and their first four to six letters, so
that forms of one stem meet. A bounded sample of labelled rows (SAMPLE, those of
the smallest hash) is dealt to examples and to calibration, by another hash. All
texts become TF-IDF vectors over all terms of the examples: 1 + log of the
term's frequency, its inverse document frequency over all documents, and its
relevance, the root of the likelihood ratio (G-squared) of the examples' labels
given the term. So every word counts, for either label, and words that say
little about it count little.

A text's nearest examples are found exactly by cosine in a block-max inverted
index. Postings of terms that few examples have are added up first; then the best
weight of each common term in each block of examples bounds what the block can
still gain, blocks are searched from the highest bound down, and those whose
bound doesn't reach the worst of the K best are never searched. Votes of the
nearest, weighted by squared cosine, and a little of the base rate make a raw
score, which logistic regression on the calibration rows, whose labels neither
vote nor weight terms, turns into the probability of label 1.

Defined results: a null text counts as empty; texts without any term of an
example get the base rate. A row's own example (same doc_id) never votes for it;
ties between examples go to the smaller doc_id. Repeated rows are scored each;
repeated labels of a doc_id count as toxic if any is; null labels and null ids
teach nothing. Without examples of both labels no term has relevance, and every
text gets the base rate (0.5 pseudo-counts). An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Remembered, checkpointed, give_back, only, text_or_empty

#: Labelled rows that examples and calibration rows are taken from, at most; one in CALIBRATION of them calibrates.
SAMPLE, CALIBRATION = 4_000, 4
#: Neighbours that vote, examples in a block of the index, weight of the base rate in votes.
K, BLOCK, BASE_WEIGHT = 10, 64, 0.25
#: Terms that more than one in COMMON examples have are searched by blocks; blocks that are searched before the others are judged.
COMMON, FIRST = 10, 4
#: Texts that are searched for together.
TOGETHER = 128
EVIDENCE = 3
_WORD = re.compile(r"\w+")
#: Runs of characters that a worker remembers.
MOST = 500_000


def terms_of(word: str) -> tuple[str, ...]:
    n = len(word)
    if n > 6:
        return word, "^" + word[:4], "^" + word[:5], "^" + word[:6]
    return (word, "^" + word[:4], "^" + word[:5])[: max(1, n - 3)]


class TermIds(Remembered):
    """A run of non-space characters, in lower case -> its place in a list of the terms of its words that are in the vocabulary.

    The terms stand end to end in one array of numbers, so that those of a text are taken at once.
    """

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.place = np.zeros(len(vocabulary), dtype=np.int64)
        self.terms, self.start = array("q"), array("q", [0])

    def clear(self) -> None:
        super().clear()
        self.terms, self.start = array("q"), array("q", [0])

    def __missing__(self, run: str) -> int:
        # a run of letters and digits is a word as it is
        self.terms.extend([i for w in ((run,) if run.isalnum() else _WORD.findall(run)) for t in terms_of(w) if (i := self.vocabulary.get(t)) is not None])
        self.start.append(len(self.terms))
        found = len(self.start) - 2
        if len(run) <= 64:
            self[run] = found
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's different terms, and how often each occurs."""
        if len(self.start) > MOST or len(self.terms) > 8 * MOST:  # between texts, so that places stay good within one
            self.clear()
        runs = text.lower().split()
        run = np.fromiter(map(self.__getitem__, runs), dtype=np.int64, count=len(runs))
        start = np.frombuffer(self.start, dtype=np.int64)
        first, n = start[run], start[run + 1] - start[run]
        ends = np.cumsum(n)
        ids = np.frombuffer(self.terms, dtype=np.int64)[np.repeat(first - ends + n, n) + np.arange(ends[-1])] if len(ends) and ends[-1] else np.zeros(0, dtype=np.int64)
        at = np.arange(len(ids))
        self.place[ids] = at
        last = self.place[ids]  # one place for each term
        once = last == at
        return ids[once], np.bincount(last, minlength=len(ids))[once]


def g_squared(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """The likelihood ratio statistics of a of n against b of m."""
    p = (a + b) / (n + m)

    def part(k: np.ndarray, of: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.where(k > 0, k * np.log(k / (of * p)), 0.0)
            miss = np.where(k < of, (of - k) * np.log((of - k) / (of * (1 - p))), 0.0)
        return hit + miss

    return np.maximum(2 * (part(a, n) + part(b, m)), 0.0)


class Index:
    """TF-IDF vectors of labelled examples behind a block-max inverted index."""

    def __init__(self, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, term: np.ndarray, count: np.ndarray):
        """weight: of each term; ids, labels: of each example; example, term, count: a row for each term of an example."""
        value = (1 + np.log(count)) * weight[term]
        keep = value > 0
        example, term, value = example[keep], term[keep], value[keep]
        value = value / np.sqrt(np.bincount(example, value * value, minlength=len(ids)))[example]
        # examples that share their heaviest term share blocks, which makes their bounds tight
        heaviest = np.full(len(ids), -1, dtype=np.int64)
        by_value = np.lexsort((-term, value))
        heaviest[example[by_value]] = term[by_value]
        place = np.empty(len(ids), dtype=np.int32)
        place[np.lexsort((ids, heaviest))] = np.arange(len(ids))
        del by_value
        self.weight, self.examples = weight, len(ids)
        self.size = -(-len(ids) // BLOCK) * BLOCK
        order = np.argsort(place)
        self.ids, self.labels = np.append(ids[order], np.zeros(self.size - len(ids), dtype=np.int64)), np.append(labels[order], np.zeros(self.size - len(ids)))
        example = place[example]
        having = np.bincount(term, minlength=len(weight))
        common = np.flatnonzero(having > max(1, len(ids) // COMMON))
        self.row = np.full(len(weight), -1, dtype=np.int64)  # of a common term
        self.row[common] = np.arange(len(common))
        is_common = self.row[term] >= 0
        dense = np.zeros((self.size, len(common)))
        dense[example[is_common], self.row[term[is_common]]] = value[is_common]
        #: of each block its examples' weights of common terms, and the best of them
        self.blocks = dense.reshape(self.size // BLOCK, BLOCK, len(common))
        self.top = np.ascontiguousarray(self.blocks.max(axis=1))
        rare = np.flatnonzero(~is_common)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.posting, self.posted = example[rare], value[rare]
        self.start = np.searchsorted(term[rare], np.arange(len(weight) + 1))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        terms, w = terms[w > 0], w[w > 0]
        return terms, w / math.sqrt(float(w @ w)) if len(w) else w

    def _rare(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Each example's cosine as far as rare terms make it: their postings, end to end."""
        a, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.posting[at], self.posted[at] * np.repeat(w, n), minlength=self.size)

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], but: list[int | None], k: int = K) -> list[list[tuple[float, int, float]]]:
        """For each text (terms, counts): cosine, doc_id, label of the k nearest examples, exactly; those of cosine 0 are none.

        but: the doc_id of each text, whose own examples are none either. A block is searched for all texts that need it together.
        """
        if not self.size:
            return [[] for _ in texts]
        score, query = np.zeros((len(texts), self.size)), np.zeros((len(texts), self.top.shape[1]))
        for i, (terms, counts) in enumerate(texts):
            terms, w = self.unit(terms, counts)
            common = self.row[terms] >= 0
            query[i, self.row[terms[common]]] = w[common]
            score[i] = self._rare(terms[~common], w[~common])
            if but[i] is not None:
                score[i, self.ids == but[i]] = -2.0  # below all others, whatever is added
        by_block = score.reshape(len(texts), -1, BLOCK)  # a view
        bound = by_block.max(axis=2) + query @ self.top.T
        first = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        wanted = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(wanted, first, True, axis=1)
        self._search(by_block, query, wanted)
        # what the k-th best has by now; adding the other blocks' common terms makes it no smaller
        least = np.partition(score, -k, axis=1)[:, -k] if self.size > k else np.zeros(len(texts))
        self._search(by_block, query, ~wanted & (bound >= least[:, None] - 1e-9))
        out = []
        for row in np.round(score, 12):
            hit = np.flatnonzero(row > 0)
            if len(hit) > k:
                hit = hit[row[hit] >= np.partition(row[hit], -k)[-k]]
            order = hit[np.lexsort((self.ids[hit], -row[hit]))][:k]
            out.append(list(zip(np.minimum(row[order], 1.0).tolist(), self.ids[order].tolist(), self.labels[order].tolist(), strict=True)))
        return out

    def _search(self, by_block: np.ndarray, query: np.ndarray, wanted: np.ndarray) -> None:
        """Adds what common terms make of the cosines, in the wanted blocks of each text."""
        for b in np.flatnonzero(wanted.any(axis=0)).tolist():
            of = np.flatnonzero(wanted[:, b])
            by_block[of, b] += query[of] @ self.blocks[b].T


def logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of the labels' log-odds on x by Newton's method, drawn to 1 and 0 by `ridge` pseudo-rows."""
    beta = np.array([1.0, 0.0])
    rows = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        gradient = rows.T @ (p - y) + ridge * (beta - [1.0, 0.0])
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2), gradient)
        beta = beta - step
        if abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


class Model:
    def __init__(self, vocabulary: dict[str, int], index: Index):
        self.terms, self.index = TermIds(vocabulary), index
        toxic = float(index.labels.sum())
        self.base = (toxic + 0.5) / (index.examples + 1)
        self.slope, self.offset = 1.0, 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"terms": self.terms.vocabulary}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"terms": TermIds(state["terms"])}

    def nearest(self, texts: list[str], ids: list[int | None]) -> list[list[tuple[float, int, float]]]:
        return self.index.nearest([self.terms.counts(t) for t in texts], ids)

    def raw(self, found: list[tuple[float, int, float]]) -> float:
        votes = [(c * c, y) for c, _, y in found]
        return (sum(w * y for w, y in votes) + BASE_WEIGHT * self.base) / (sum(w for w, _ in votes) + BASE_WEIGHT)

    def score(self, texts: list[str], ids: list[int | None]) -> Iterator[tuple[float, list[tuple[float, int, float]]]]:
        """Score and nearest examples of each text."""
        for found in self.nearest(texts, ids):
            yield 1 / (1 + math.exp(-(self.slope * logit(self.raw(found)) + self.offset))) if found else self.base, found


def _parts(batch: pa.RecordBatch, id_at: int, text_at: int) -> Iterator[tuple[list[str], list[int | None]]]:
    """Texts and ids of a batch, TOGETHER at a time."""
    for a in range(0, batch.num_rows, TOGETHER):
        yield [t or "" for t in batch.column(text_at).slice(a, TOGETHER).to_pylist()], batch.column(id_at).slice(a, TOGETHER).to_pylist()


def held_out(id_col):
    """Whether a row is kept from learning: the CRC-32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def taught(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, calibrates of the labelled rows that may be learned from, `most` at most: those of the smallest hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    few = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return few.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(CALIBRATION)) == 0)


def _example_terms(examples: DataFrame) -> DataFrame:
    """doc_id, toxic, terms, counts of examples (doc_id, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found: dict[str, int] = {}
                for word in _WORD.findall(batch.column(2)[i].as_py().lower()):
                    for t in terms_of(word):
                        found[t] = found.get(t, 0) + 1
                yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([list(found)], pa.list_(pa.string())), pa.array([list(found.values())], pa.list_(pa.int64()))], ["doc_id", "toxic", "terms", "counts"])

    return examples.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms array<string>, counts array<long>")


def _frequencies(rows: DataFrame, terms: Callable[[], TermIds], size: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and how many have each term, added up by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total, n = terms(), 0, np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += batch.num_rows
            for text in batch.column(0):
                n[ids.counts(text.as_py())[0]] += 1
        if total:
            found = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.append(found, -1)), pa.array(np.append(n[found], total))], ["term", "n"])

    counted = rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    frequency = np.zeros(size)
    frequency[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), frequency


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Callable[[], Model]:
    """The model, as a function that tasks call for it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = checkpointed(rows.join(F.broadcast(checkpointed(taught(labels, sample))), "doc_id"))  # at most `sample` rows of three values are broadcast
    examples = _example_terms(known.where("not calibrates")).toArrow().sort_by([("doc_id", "ascending")])
    ids, toxic = examples.column("doc_id").to_numpy(), examples.column("toxic").to_numpy().astype(float)
    terms = examples.column("terms").combine_chunks()
    count = examples.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    coded = pc.dictionary_encode(terms.flatten())
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    example = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(terms.offsets.to_numpy()))
    term, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary.to_pylist()
    del examples, terms, coded  # the driver holds a row for each term of an example once
    n, m = int(toxic.sum()), int(len(toxic) - toxic.sum())
    weight, size = np.zeros(len(words)), len(words)
    numbers = {t: i for i, t in enumerate(words)}
    del words
    if n and m:
        vocabulary = spark.sparkContext.broadcast(numbers)
        pos = np.bincount(term, toxic[example], minlength=size)
        total, frequency = _frequencies(rows, lambda: _terms(vocabulary), size)
        vocabulary.destroy()
        weight = np.sqrt(g_squared(pos, n, np.bincount(term, minlength=size) - pos, m)) * (np.log((1 + total) / (1 + frequency)) + 1)
    shared = spark.sparkContext.broadcast(Model(numbers, Index(weight, ids, toxic, example, term, count)))
    del numbers, weight, example, term, count  # tasks have the model; the driver needs it no more
    give_back(spark)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            found = [f for texts, ids in _parts(batch, 0, 2) for f in model.nearest(texts, ids)]
            yield pa.record_batch([pa.array([model.raw(f) if f else None for f in found], pa.float64()), batch.column(1)], ["raw", "toxic"])

    asked = known.where("calibrates").select("doc_id", "toxic", "text").mapInArrow(votes, "raw double, toxic int").where("raw is not null").orderBy("raw", "toxic").toArrow()
    slope, offset = 1.0, 0.0
    if asked.num_rows:
        slope, offset = fit_logistic(np.array([logit(p) for p in asked.column("raw").to_pylist()]), asked.column("toxic").to_numpy().astype(float))

    def fitted() -> Model:
        model = _model(shared)
        model.slope, model.offset = slope, offset
        return model

    return fitted


def _terms(vocabulary) -> TermIds:
    """A worker's term ids under a broadcast vocabulary."""
    if _held.get("vocabulary") is not vocabulary.value:
        _held.clear()
        _held.update(vocabulary=vocabulary.value, terms=TermIds(vocabulary.value))
    only(_held["terms"])
    return _held["terms"]


def _model(shared) -> Model:
    _held.clear()
    only(shared.value.terms)
    return shared.value


#: What a worker holds of the vocabulary it used last.
_held: dict[str, object] = {}


SCHEMA = "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the nearest examples) for each row of docs."""
    fitted = fit(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted()
        for batch in batches:
            scores, evidence = [], []
            for texts, ids in _parts(batch, 0, 1):
                for s, near in model.score(texts, ids):
                    scores.append(s)
                    evidence.append([{"doc_id": i, "cosine": c, "toxic": int(y)} for c, i, y in near[:EVIDENCE]])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, _EVIDENCE)], ["doc_id", "score", "evidence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows whose score reaches 0.5; all columns stay, and no row is shuffled."""
    fitted = fit(docs, labels, sample)
    at = [f.name for f in docs.schema].index("text"), [f.name for f in docs.schema].index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted()
        for batch in batches:
            keep = [s < 0.5 for texts, ids in _parts(batch, at[1], at[0]) for s, _ in model.score(texts, ids)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
