"""Repeated passages, by level-wise doubling of word windows.

Windows of the first length (10 words) that occur once are given up; those that
repeat are extended to twice the length, until the full one (20 words) is
reached. At a level below the full length, each full window is stood for by that
of its windows of the level's length which has the smallest hash: where a full
window repeats, so does this one, so that a sixth of all windows suffices and
none is missed. Windows are counted by hash and document, pre-aggregated, and
only documents with repeated ones are read again for the next level.

The full length is counted by two 64-bit hashes; within one document the first
of them tells its windows apart. A word is removed if a window
that covers it also starts earlier: in a smaller doc_id, or further up in its
own document. A document whose words are those of one with a smaller doc_id
needs no windows: each of its windows starts earlier.

The joins are on window hashes and on doc_id, and may be split by adaptive
execution; texts move only for documents that a level has left.

Defined results: words are runs of characters other than space and U+0009 to
U+000D; a null text has none, and a document of fewer than 20 loses none. Rows
that share a doc_id are versions of one document, none of them earlier than
another; rows without an id come after all others and are versions of one
document. Repeated rows each get their row. An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, only, sized
from quillon.llm.words import WORDS, runs, sliding_min

LENGTH, FIRST = 20, 10
#: Stands for the id of rows without one.
NO_ID = 2**63 - 1


def levels(first: int = FIRST, length: int = LENGTH) -> list[int]:
    """first, twice that, ..., length."""
    out = [first]
    while out[-1] < length:
        out.append(out[-1] * 2)
    if out[-1] != length or first == length:
        raise ValueError("the full length is the first, doubled once or more")
    return out


def standing(words: np.ndarray, level: int, length: int) -> np.ndarray:
    """For each full window, the smallest hash of its windows of the level's length."""
    each = runs(words, level)
    return sliding_min(each, length - level + 1) if len(words) >= length else each[:0]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))


def _first_level(rows: DataFrame, level: int, length: int) -> DataFrame:
    """id, n_words, words_sha256, hashes (of the windows that stand for full ones), own (one may repeat here), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(WORDS)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                n, shas, hashes, own = [], [], [], []
                for text in part.column(1):
                    words = text.as_py().split()
                    n.append(len(words))
                    shas.append(_sha(words))
                    found = WORDS.of(words)
                    hashes.append(np.unique(standing(found, level, length)))
                    each = runs(found, level)
                    own.append(len(words) > length and len(np.unique(each)) < len(each))
                flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
                offsets = pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, _signed(flat)), pa.array(own, pa.bool_())], ["id", "n_words", "words_sha256", "hashes", "own"])

    return rows.mapInArrow(run, "id long, n_words long, words_sha256 string, hashes array<long>, own boolean")


def _repeated(found: DataFrame) -> DataFrame:
    """id, hash of the found (id, hash) that more than one row has."""
    repeated = found.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash")
    return found.join(repeated, "hash", "left_semi")


def _with_texts(rows: DataFrame, per_id: DataFrame) -> DataFrame:
    """per_id joined to the texts of its ids; other texts are left out before anything moves, if the ids are few."""
    return rows.join(sized(per_id.select("id")), "id", "left_semi").join(per_id, "id")


def _next_level(rows: DataFrame, alive: DataFrame, level: int, above: int, length: int) -> DataFrame:
    """id, hash at the level `above` of the windows whose hash at `level` is alive (id, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = WORDS.of(batch.column(1)[i].as_py().split())
                live = batch.column(2)[i].values.to_numpy().view(np.uint64)
                found = np.unique(standing(words, above, length)[np.isin(standing(words, level, length), live)])
                yield pa.record_batch([pa.array([batch.column(0)[i].as_py()] * len(found), pa.int64()), _signed(found)], ["id", "hash"])

    return _with_texts(rows, alive).select("id", "text", "hashes").mapInArrow(run, "id long, hash long")


def _full_windows(rows: DataFrame, alive: DataFrame, level: int, length: int) -> DataFrame:
    """id, a, b: the two hashes of the different full windows whose hash at `level` is alive (id, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = WORDS.of(batch.column(1)[i].as_py().split())
                live = batch.column(2)[i].values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(standing(words, level, length), live))
                if len(at):
                    a, first = np.unique(runs(words, length)[at], return_index=True)
                    b = runs(words, length, 1)[at][first]
                    yield pa.record_batch([pa.array(np.full(len(a), batch.column(0)[i].as_py())), _signed(a), _signed(b)], ["id", "a", "b"])

    return _with_texts(rows, alive).select("id", "text", "hashes").mapInArrow(run, "id long, a long, b long")


def covered(windows: np.ndarray, earlier: np.ndarray, length: int) -> np.ndarray:
    """For each word of a document, whether a window that starts earlier covers it.

    windows: the hash of each window, in order; earlier: those that other documents have earlier.
    """
    starts = np.isin(windows, earlier)
    _, first = np.unique(windows, return_index=True)
    later = np.ones(len(windows), dtype=bool)
    later[first] = False
    starts = np.flatnonzero(starts | later)
    change = np.zeros(len(windows) + length, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change)[: len(windows) + length - 1] > 0


def _removed(rows: DataFrame, earlier: DataFrame, length: int) -> DataFrame:
    """id, words_sha256, n_removed, kept_sha256 of documents with windows that start earlier (id, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().split()
                earlier = batch.column(2)[i].values.to_numpy().view(np.uint64)
                gone = np.zeros(len(words), dtype=bool)
                if len(words) >= length:
                    gone = covered(runs(WORDS.of(words), length), earlier, length)
                out.append((_sha(words), int(gone.sum()), _sha([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True))], ["id", "words_sha256", "n_removed", "kept_sha256"])

    return _with_texts(rows, earlier).select("id", "text", "windows").mapInArrow(run, "id long, words_sha256 string, n_removed long, kept_sha256 string").distinct()


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    rows = _rows(docs, id_col, text_col)
    steps = levels(first, length)
    seen = checkpointed(_first_level(rows, steps[0], length))
    # a document whose words stand under a smaller id: nothing of it stays but what is too short
    smallest = seen.groupBy("words_sha256").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("words_sha256", "least")
    smallest = sized(checkpointed(smallest), 100_000)
    marked = seen.join(smallest, "words_sha256", "left").withColumn("copy", F.coalesce(F.col("least") < F.col("id"), F.lit(False)))
    summary = marked.select("id", "n_words", "words_sha256", "copy")
    found = marked.where("not copy").select("id", F.explode("hashes").alias("hash"))
    for level, above in zip(steps, steps[1:], strict=False):
        alive = checkpointed(_repeated(found).groupBy("id").agg(F.collect_set("hash").alias("hashes")))
        if above == length:
            break
        found = _next_level(rows, alive, level, above, length)
    # made twice, for the smallest id and for what comes later: cheaper than keeping all windows
    windows = _full_windows(rows, alive, level, length)
    least = windows.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("a", "b", "least")
    later = windows.join(least, ["a", "b"]).where("id > least").groupBy("id").agg(F.collect_set("a").alias("windows"))
    # windows may repeat within one document alone
    own = seen.where("own").select("id").distinct()
    earlier = checkpointed(later.join(own, "id", "full_outer").select("id", F.coalesce("windows", F.array().cast("array<long>")).alias("windows")))
    removed = _removed(rows, earlier, length)
    short = F.col("n_words") < length
    result = summary.join(removed, ["id", "words_sha256"], "left")
    return result.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words",
        F.when(F.col("copy") & ~short, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy") & ~short, F.lit(_sha([]))).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
