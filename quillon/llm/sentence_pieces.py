"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The agenda holds every adjacent pair of symbols whose concatenation is a piece,
by score and then from the left; the best pair is merged until none is left.
`agenda` does so with a heap for one chunk; `agendas` runs the agendas of many
chunks of one length in step, each round merging every chunk's best pair, so
that numpy does the work. Chunks (see `chunks`) are encoded once and remembered.
Every chunk that a worker hasn't yet seen is checked against the sentencepiece
library, batch by batch; a difference raises.

Characters outside the vocabulary become byte pieces, or the unknown piece where
the vocabulary has none. Decoding concatenates the pieces of ids, spaces
restored and the dummy one taken off; runs of byte pieces are decoded as UTF-8,
each invalid byte as U+FFFD.

Defined results: a null text counts as empty, which has no ids and decodes to
the empty text. Rows are independent, so ids may be null or repeated; an empty
table gives no rows; other columns, whatever their names, are not read. The
model file's path is a parameter; its bytes (under a megabyte, checked) go to
the executors with the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.chunks import LONGEST, MOST, SPACE, chunk_keys, crosses, escaped, slices
from quillon.llm.common import Remembered, only, text_or_empty

#: Chunks longer than this take the heap; shorter ones of one length go in step.
IN_STEP = 40
#: A model file larger than this is not sent along with tasks.
MODEL_BYTES = 16_000_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a serialized protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """The vocabulary of a serialized BPE model, with its agenda and decoder."""

    def __init__(self, proto: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        lib, n = self.library, self.library.get_piece_size()
        sections = dict(_fields(proto))
        trainer, normalizer = dict(_fields(sections.get(2, b""))), dict(_fields(sections.get(3, b"")))
        # trainer: 3 model type (2: BPE); normalizer: 2 character map, 3 dummy prefix, 4 extra spaces removed, 5 spaces escaped
        if trainer.get(3, 1) != 2 or normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model must be a BPE one that keeps its text as it is, but for a dummy space in front")
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(lib.is_unused(i) for i in range(n)) or crosses(self.id_of):
            raise ValueError("unused pieces, and spaces inside pieces, are not supported")
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.control = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        self.symbol_of = dict(self.id_of)  # pieces, then characters that occur in pieces only
        for piece in self.id_of:
            for c in piece:
                self.symbol_of.setdefault(c, len(self.pieces) + len(self.symbol_of))
        self.char_of = {i: c for c, i in self.symbol_of.items() if i >= len(self.pieces)}
        scores = {p: lib.get_score(i) for p, i in self.id_of.items()}
        self.rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.score = {p: self.rank_of[s] for p, s in scores.items()}  # 0 is the best
        self.size = max(self.symbol_of.values()) + 2
        merges = {}
        for piece, made in self.id_of.items():
            for i in range(1, len(piece)):
                if (a := self.symbol_of.get(piece[:i])) is not None and (b := self.symbol_of.get(piece[i:])) is not None:
                    merges[a * self.size + b] = (self.score[piece], made)
        keys = np.array(sorted(merges), dtype=np.int64)
        self.merge_keys = np.append(keys, np.iinfo(np.int64).max)
        self.merge_rank = np.array([merges[k][0] for k in keys.tolist()] + [0], dtype=np.int64)
        self.merge_made = np.array([merges[k][1] for k in keys.tolist()] + [0], dtype=np.int64)
        self.none = len(self.rank_of)  # rank of a pair that makes no piece
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]

    def encode_symbols(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            if (i := self.id_of.get(s)) is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk, by a heap of its adjacent pairs."""
        score = self.score
        symbols: list[str] = list(chunk)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(score[p], i, i + 1, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in score]
        heapify(heap)
        while heap:
            _, i, j, piece = heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue  # one of them has been merged since
            symbols[i], symbols[j] = piece, ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (p := piece + symbols[k]) in score:
                    heappush(heap, (score[p], i, k, p))
            if (h := left[i]) >= 0 and (p := symbols[h] + piece) in score:
                heappush(heap, (score[p], h, i, p))
        return self.encode_symbols([s for s in symbols if s])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair of symbols makes; symbols under 0 make nothing."""
        key = a * self.size + b
        at = np.searchsorted(self.merge_keys, key)
        hit = (self.merge_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.merge_rank[at], self.none), self.merge_made[at]

    def agendas(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that all have one length, their agendas worked off in step."""
        n, width = len(chunks), len(chunks[0])
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).reshape(n, width)
        known, where = np.unique(points, return_inverse=True)
        # a character outside the vocabulary is a symbol under 0 that tells which one it is
        codes = np.array([self.symbol_of.get(chr(c), -1 - int(c)) for c in known.tolist()], dtype=np.int64)
        symbols = codes[where].reshape(n, width)
        rank = np.full((n, width), self.none, dtype=np.int64)
        made = np.zeros((n, width), dtype=np.int64)
        if width > 1:
            r, m = self._pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
            rank[:, :-1], made[:, :-1] = r.reshape(n, -1), m.reshape(n, -1)
        out: list[list[int]] = [[]] * n
        live, length = np.arange(n), width
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            over = rank[row, best] == self.none
            if over.any():
                for i, found in zip(live[over].tolist(), symbols[over, :length].tolist(), strict=True):
                    out[i] = found
                stay = ~over
                live, symbols, rank, made, best = live[stay], symbols[stay], rank[stay], made[stay], best[stay]
                row = np.arange(len(live))
                if not len(live):
                    break
            # merge at best: the symbols and pairs after it move one to the left
            symbols[row, best] = made[row, best]
            after = np.arange(length - 1)[None, :] + (np.arange(length - 1)[None, :] > best[:, None])
            symbols = np.take_along_axis(symbols, after, 1)
            rank, made = np.take_along_axis(rank, after, 1), np.take_along_axis(made, after, 1)
            length -= 1
            rank[:, length - 1] = self.none
            for at in (best - 1, best):
                some = (at >= 0) & (at < length - 1)
                i, j = row[some], at[some]
                rank[i, j], made[i, j] = self._pairs(symbols[i, j], symbols[i, j + 1])
        limit = len(self.pieces)
        return [s if 0 <= min(s) and max(s) < limit else self._spelled(s) for s in out]

    def _spelled(self, symbols: list[int]) -> list[int]:
        """Ids of symbols of which some are no pieces but characters."""
        out = []
        for s in symbols:
            out += [s] if 0 <= s < len(self.pieces) else self.encode_symbols([chr(-1 - s) if s < 0 else self.char_of[s]])
        return out

    def encode_chunks(self, keys: list[str]) -> list[list[int]]:
        by_length: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            by_length.setdefault(len(key), []).append(i)
        out: list[list[int]] = [[]] * len(keys)
        for length, at in by_length.items():
            if length >= IN_STEP or len(at) < 8:
                for i in at:
                    out[i] = self.agenda(escaped(keys[i]))
            else:
                for i, found in zip(at, self.agendas([escaped(keys[i]) for i in at]), strict=True):
                    out[i] = found
        return out

    def decode_chunk(self, ids: list[int]) -> str:
        """The text of ids that a chunk may hold, with its leading space."""
        id_byte = self.id_byte
        if id_byte.keys().isdisjoint(ids):
            return "".join([self.plain[i] for i in ids if i not in self.control])
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in id_byte:
                run.append(id_byte[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            if i is not None and i not in self.control:
                out.append(self.plain[i])
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_chunks(chunk_keys(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return self.decode_chunk(ids).removeprefix(" ")


@lru_cache(1)
def _model(proto: bytes) -> PieceModel:
    return PieceModel(proto)


class Encoder:
    """Texts to ids and back, chunk by chunk; what a chunk became is remembered by `form`."""

    def __init__(self, model: PieceModel, form: Callable[[list[int]], object], check: bool):
        self.model, self.form, self.check = model, form, check
        self.seen = Remembered()

    def learn(self, keys: list[str]) -> dict[str, object]:
        found = self.model.encode_chunks(keys)
        # the library puts the dummy space before a text itself; what it makes of the empty text is not that space
        if self.check and found != self.model.library.encode([k or SPACE for k in keys], num_threads=1) and any(
            ids != self.model.library.encode(k) for k, ids in zip(keys, found, strict=True) if k
        ):
            raise RuntimeError("the agenda and the sentencepiece library differ")
        return {k: self.form(ids) for k, ids in zip(keys, found, strict=True)}

    def __call__(self, texts: list[str]) -> Iterator[list[object]]:
        """For each text, the forms of its chunks."""
        for a, b in slices(texts):
            split = [chunk_keys(t) for t in texts[a:b]]
            fresh: set[str] = set()
            for keys in split:
                fresh.update(keys)
            if len(self.seen) > MOST:
                self.seen.clear()
            now = self.learn(list(fresh - self.seen.keys()))
            self.seen.update((k, v) for k, v in now.items() if len(k) <= LONGEST)
            long = {k: v for k, v in now.items() if len(k) > LONGEST}
            for keys in split:
                if long and not long.keys().isdisjoint(keys):
                    yield [long[k] if k in long else self.seen[k] for k in keys]
                else:
                    yield list(map(self.seen.__getitem__, keys))


_encoders: dict[tuple, Encoder] = {}


def _encoder(proto: bytes, name: str, form: Callable, check: bool) -> Encoder:
    key = (hashlib.sha256(proto).digest(), name, check)
    if key not in _encoders:
        model = _model(proto)
        _encoders[key] = Encoder(model, form(model), check)
    only(_encoders[key].seen)
    return _encoders[key]


def _proto(spark, path: str) -> bytes:
    with open(path, "rb") as f:
        proto = f.read(MODEL_BYTES + 1)
    if len(proto) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return proto


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for each row of docs."""
    proto = _proto(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(proto, "ids", lambda model: lambda ids: (ids, model.decode_chunk(ids)), check)
        for batch in batches:
            ids, decoded = [], []
            for forms in encoder(batch.column(1).to_pylist()):
                ids.append([i for part, _ in forms for i in part])
                decoded.append("".join([text for _, text in forms]).removeprefix(" "))
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs: `encode` without its long arrays."""
    proto = _proto(docs.sparkSession, model_path)

    def form(model: PieceModel) -> Callable:
        return lambda ids: (",".join(map(str, ids)), model.decode_chunk(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(proto, "digests", form, check)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for forms in encoder(batch.column(1).to_pylist()):
                ids = ",".join([f[0] for f in forms])
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha("".join([f[1] for f in forms]).removeprefix(" ").encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
