"""Hierarchical multi-length packing of token ids into training sequences.

Each document is its ids and an end id. Full windows of the longest context are
cut from it; what remains is routed to the smallest tier of context sizes that
holds it. Tiers are packed from the longest down: each window takes a document
of its own tier, and what is left of it is filled from the shorter tiers, the
largest that fits first; the last gap takes the head of a shorter document,
whose rest goes back to its tier. So windows are full, and at the end of a
partition what is left over is cut at powers of two, which need no padding.
Sequences are dealt to step groups, longest first, each to the group of its
block that has the fewest tokens so far.

Documents are tokenized and packed where they are read, without a shuffle. A
task holds the ids of one block of documents (BLOCK_TOKENS) and of those that
the block before left over (less than one window). Sequence ids carry the
task's partition, so a task that is run again gives the same rows.

Words repeat, so the ids of text between single spaces are remembered; the ids
are those that the tokenizers library has for the whole text, since the splitting
pattern always has a border before a space that follows and precedes other
characters. Texts that spell an added token (such as an end of text) are given to
the library whole, which makes it one id.

Defined results: a null text counts as empty and is the end id alone. Rows are
independent, so ids may be null or repeated; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import Remembered, only, text_or_empty

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BLOCK_TOKENS = 1_000_000
STEP_SEQUENCES = 8
#: Chunks of text that a worker remembers, and the longest of them.
MOST, LONGEST = 600_000, 64
#: Whether an array of "I" has the bytes that are asked for.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Marks that often follow a word. Letters under this one are split alike by all versions of Unicode.
MARKS, LATIN = ".,;:!?", "\u0250"
#: A tokenizer file larger than this is not sent along with tasks.
FILE_BYTES = 16_000_000
#: A space between other characters: pieces always have a border before it.
_BORDER = re.compile(r"(?<=\S) (?=\S)")


class ByteTokenizer:
    """Little-endian 32-bit ids of texts, by the tokenizers library, under a file with a byte-level BPE model."""

    def __init__(self, file: str):
        made = json.loads(file)
        model, split = made["model"], made["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("dropout") or made["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level BPE tokenizer without normalizer, prefix space and dropout is needed")
        self.library = Tokenizer.from_str(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t["content"] for t in made["added_tokens"]]
        self.pieces, self.merged = self.library.pre_tokenizer.pre_tokenize_str, self.library.model.tokenize
        self.space = self.pieces(" ")[0][0]  # a space as the vocabulary writes it
        #: letters as the vocabulary writes their bytes
        self.written = {i: self.pieces(chr(i))[0][0] for i in range(ord(LATIN)) if chr(i).isalpha()}
        self.seen, self.marks = Remembered(), {}

    def _pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    def _word(self, key: str) -> bytes:
        """Ids of a space and what follows it up to the next border."""
        if key.isalpha():  # one piece
            if key.isascii():
                return self._pack([t.id for t in self.merged(self.space + key)])
            if max(key) < LATIN:
                return self._pack([t.id for t in self.merged(self.space + key.translate(self.written))])
        return self._pack([t.id for piece, _ in self.pieces(" " + key) for t in self.merged(piece)])

    def _chunk(self, key: str) -> bytes:
        """The same; marks after letters are pieces of their own, and remembered apart."""
        word = key.rstrip(MARKS)
        if len(word) == len(key) or not word.isalpha():
            return self._word(key)
        marks = key[len(word) :]
        if (after := self.marks.get(marks)) is None:
            after = self._pack([t.id for t in self.merged(marks)])
            if len(marks) <= 2:
                self.marks[marks] = after
        return (self.seen.get(word) or self._word(word)) + after

    def _learned(self, key: str) -> bytes:
        ids = self._chunk(key)
        if len(key) <= LONGEST and _within(key):
            if len(self.seen) > MOST:
                self.seen.clear()
            self.seen[key] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):  # added tokens are found before anything is split
            return self._pack(self.library.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        found = list(map(self.seen.get, rest))
        if first[-1:].isspace() or (None in found and not all(map(_within, (k for k, ids in zip(rest, found, strict=True) if ids is None)))):
            # what is remembered has no white space at its ends, so here is a space beside other white space
            first, *rest = _BORDER.split(text)
            found = list(map(self.seen.get, rest))
        if None in found:
            found = [self._learned(key) if ids is None else ids for key, ids in zip(rest, found, strict=True)]
        return self._pack(self.library.encode(first, add_special_tokens=False).ids) + b"".join(found)


def _within(key: str) -> bool:
    """Whether white space may stand in the key only, and not at its ends."""
    return bool(key) and not key[0].isspace() and not key[-1].isspace()


_tokenizers: dict[bytes, ByteTokenizer] = {}


class Document:
    """A document of a block: its ids with the end id."""

    __slots__ = ("doc_id", "ids", "tokens")

    def __init__(self, doc_id: int | None, ids: bytes):
        self.doc_id, self.ids, self.tokens = doc_id, ids, len(ids) // 4


#: length, number (a tie-break), document, start
Item = tuple[int, int, Document, int]


class Packer:
    """Packs blocks of documents; `rows` has what is packed so far, as pieces."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers are different powers of two, from the longest down")
        self.tiers, self.next = tiers, partition << 32
        self.left: list[Item] = []
        self.rows: list[tuple] = []
        self.made = 0
        self.sequences: list[tuple[int, int, list[Item]]] = []  # length, tier, pieces

    def _tier(self, length: int) -> int:
        return next(i for i in reversed(range(len(self.tiers))) if length <= self.tiers[i])

    def _item(self, length: int, doc: Document, start: int) -> Item:
        self.made += 1
        return length, self.made, doc, start

    def _sequence(self, items: list[Item], tier: int) -> None:
        self.sequences.append((sum(i[0] for i in items), tier, items))

    def block(self, docs: Iterable[Document], last: bool = False) -> None:
        pools: list[list[Item]] = [[] for _ in self.tiers]
        longest = self.tiers[0]
        for item in self.left:
            insort(pools[self._tier(item[0])], item)
        for doc in docs:
            full = doc.tokens // longest
            for k in range(full):
                self._sequence([self._item(longest, doc, k * longest)], 0)
            if rest := doc.tokens - full * longest:
                pools[self._tier(rest)].append(self._item(rest, doc, full * longest))
        for pool in pools:
            pool.sort(key=lambda x: x[:2])
        self.left = []
        for tier, size in enumerate(self.tiers):
            while pools[tier]:
                items, gap = [pools[tier].pop()], 0
                gap = size - items[0][0]
                while gap and (found := self._filler(pools, tier, gap)):
                    items.append(found)
                    gap -= found[0]
                if gap:  # nothing is left to fill it with
                    self.left += items
                else:
                    self._sequence(items, tier)
        if last:
            self._cut_left()
        self._emit()

    def _filler(self, pools: list[list[Item]], tier: int, gap: int) -> Item | None:
        """The longest document of this tier or a shorter one that fits, else the head of one that doesn't."""
        for pool in pools[tier:]:
            if at := bisect_right(pool, gap, key=lambda x: x[0]):
                return pool.pop(at - 1)
        for t in reversed(range(tier, len(pools))):
            if pools[t]:
                length, _, doc, start = pools[t].pop(0)
                rest = self._item(length - gap, doc, start + gap)
                insort(pools[self._tier(rest[0])], rest, key=lambda x: x[:2])
                return self._item(gap, doc, start)
        return None

    def _cut_left(self) -> None:
        """Sequences of falling powers of two that hold what is left."""
        items, self.left = self.left[::-1], []
        total = sum(i[0] for i in items)
        while total:
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            total -= size
            taken, room = [], size
            while room:
                length, _, doc, start = items.pop()
                if length > room:
                    items.append(self._item(length - room, doc, start + room))
                    length = room
                taken.append(self._item(length, doc, start))
                room -= length
            self._sequence(taken, next((i for i, t in enumerate(self.tiers) if t == size), len(self.tiers) - 1))

    def _emit(self) -> None:
        """Numbers the sequences, deals them to step groups, and makes their rows."""
        self.sequences.sort(key=lambda s: -s[0])
        groups = max(1, round(sum(s[0] for s in self.sequences) / (STEP_SEQUENCES * self.tiers[0])))
        loads = [(0, g) for g in range(groups)]
        first = self.next
        for length, tier, items in self.sequences:
            load, group = loads.pop(0)
            insort(loads, (load + length, group))
            offset = 0
            for n, _, doc, start in items:
                crc = zlib.crc32(memoryview(doc.ids)[4 * start : 4 * (start + n)])
                self.rows.append((doc.doc_id, start, n, crc, doc.tokens, self.next, offset, self.tiers[tier], first + group))
                offset += n
            self.next += 1
        self.sequences = []

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.int64()) for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence.

    Document, start of the piece in its ids, length, CRC-32 of the piece's ids,
    the document's tokens, sequence, offset in the sequence, the sequence's tier
    and its step group.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = f.read(FILE_BYTES + 1)
    if len(file) > FILE_BYTES:
        raise ValueError(f"{tokenizer_path} is larger than {FILE_BYTES} characters")
    name = hashlib.sha256(file.encode()).digest()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _tokenizers:
            _tokenizers[name] = ByteTokenizer(file)
        tokenizer = _tokenizers[name]
        only(tokenizer.seen)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        block, size = [], 0

        def rows() -> pa.RecordBatch:
            columns = zip(*packer.take(), strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, doc_id in enumerate(ids):
                doc = Document(doc_id, tokenizer(batch.column(1)[at].as_py()) + end)
                block.append(doc)
                size += doc.tokens
                if size >= BLOCK_TOKENS:
                    packer.block(block)
                    block, size = [], 0
                    yield rows()
        packer.block(block, last=True)
        if packer.rows:
            yield rows()

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return found.mapInArrow(run, SCHEMA)
