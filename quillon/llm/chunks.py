"""Splitting escaped text where no vocabulary piece can cross, and remembering what the chunks became.

Piece vocabularies write a space as U+2581 and have it only at a piece's start
(or in pieces of nothing else). So a text falls into chunks, each a run of
spaces with the word after it, whose encodings don't depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterable

SPACE = "▁"
#: Chunks longer than this are not remembered, and at most so many are: a worker's memory stays bounded.
LONGEST, MOST = 64, 600_000
#: Characters of text that are handled at a time.
SLICE_CHARS = 2_000_000


def chunk_keys(text: str) -> list[str]:
    """The chunks of a text with its leading dummy space: each its spaces but one, as plain spaces, and its word."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    parts = text.split(" ")
    if text[0] != " " and text[-1] != " " and "  " not in text:
        return parts
    # Each part has one space before it (the dummy one before the first).
    keys, extra = [], 0
    for part in parts:
        if part:
            keys.append(" " * extra + part)
            extra = 0
        else:
            extra += 1
    if extra:
        keys.append(" " * (extra - 1))
    return keys


def escaped(key: str) -> str:
    """The chunk as the vocabulary writes it."""
    return SPACE + key.replace(" ", SPACE)


def crosses(pieces: Iterable[str]) -> bool:
    """Whether a piece has a space after another character, so that chunks would depend on each other."""
    return any(SPACE in p.lstrip(SPACE) for p in pieces)


def slices(texts: list[str]) -> Iterable[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS characters each."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
