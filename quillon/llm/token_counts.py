"""Token counts under a unigram vocabulary, without making the tokens: count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece that occurs in a chunk of
text; dynamic programming over the chunk's positions carries the best score and
the number of pieces of the path that has it. Ties follow the tokenizers
library's unigram model: pieces are tried from the earliest start, and a later
one replaces an earlier only if its score is larger, so of equal paths the one
whose last piece is longest wins. A character that is no piece costs the lowest
score less 10, and counts as its UTF-8 bytes where the vocabulary has byte
pieces, else a run of such characters counts as one. Scores add up in double
precision.

Any list of pieces with scores may be counted with; `pieces_of` takes one from a
sentencepiece model file, whatever the model's own type (specials and byte
pieces never match text).

Defined results: a null text counts as empty, which has no tokens and score 0.
Rows are independent, so ids may be null or repeated; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.chunks import LONGEST, MOST, chunk_keys, crosses, escaped
from quillon.llm.common import Remembered, only, text_or_empty

UNKNOWN_PENALTY = 10.0
#: Vocabularies larger than this are not sent along with tasks.
PIECES = 1_000_000


def pieces_of(model_path: str) -> tuple[tuple[str, float], ...]:
    lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
    normal = (i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)))
    return tuple((lib.id_to_piece(i), lib.get_score(i)) for i in normal)


class UnigramCounter:
    def __init__(self, pieces: tuple[tuple[str, float], ...], byte_pieces: bool = True):
        if crosses(p for p, _ in pieces):
            raise ValueError("spaces inside pieces are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self.seen = Remembered()

    def chunk(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over one escaped chunk."""
        n, unknown = len(text), self.unknown
        score: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        odd = [False] * (n + 1)  # whether the path ends in an unknown character
        ends = self.automaton.iter(text)
        end, (length, weight) = next(ends, (n, (0, 0.0)))
        for at in range(1, n + 1):
            best, pieces, single = None, 0, False
            while end == at - 1:  # pieces that end here come longest first, so from the earliest start
                start = at - length
                if best is None or score[start] + weight > best:
                    best, pieces = score[start] + weight, count[start] + 1
                single = single or length == 1
                end, (length, weight) = next(ends, (n, (0, 0.0)))
            if not single and (best is None or score[at - 1] + unknown > best):
                best = score[at - 1] + unknown
                odd[at] = True
                if self.byte_pieces:
                    pieces = count[at - 1] + len(text[at - 1].encode())
                else:
                    pieces = count[at - 1] + (not odd[at - 1])
            score[at], count[at] = best, pieces
        return count[n], score[n]

    def __call__(self, text: str) -> tuple[int, float]:
        seen, found = self.seen, []
        for key in chunk_keys(text):
            if (had := seen.get(key)) is None:
                had = self.chunk(escaped(key))
                if len(key) <= LONGEST:
                    if len(seen) > MOST:
                        seen.clear()
                    seen[key] = had
            found.append(had)
        return sum([f[0] for f in found]), float(sum([f[1] for f in found]))


_counters: dict[bytes, UnigramCounter] = {}


def count_tokens(docs: DataFrame, pieces: tuple[tuple[str, float], ...], byte_pieces: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score for each row of docs."""
    if len(pieces) > PIECES:
        raise ValueError(f"more than {PIECES} pieces")
    name = hashlib.sha256(repr((pieces, byte_pieces)).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters[name] = UnigramCounter(pieces, byte_pieces)
        counter = _counters[name]
        only(counter.seen)
        for batch in batches:
            texts = batch.column(1)
            found = [counter(t) for a in range(0, len(texts), 500) for t in texts.slice(a, 500).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")
