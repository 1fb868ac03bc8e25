"""Texts as blocks of word numbers: every block has a dictionary of its own, so words are joined once a block and not once a position."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

#: Words of a block: its numbers are 4 bytes each, and a few arrays of that length are held at a time.
BLOCK_WORDS = 2_500_000
#: Bytes of a text that are split into words at a time.
SLICE_BYTES = 8_000_000
#: Stands for a border inside a text; no UTF-8 text has this byte.
BORDER = b"\xff"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def byte_table(borders: bytes = b"", blanks: bytes = b"") -> bytes:
    """Lower-cases A-Z and turns ``borders`` into the border byte and ``blanks`` into blanks."""
    return bytes(0xFF if c in borders else 32 if c in blanks else _LOWER[c] for c in range(256))


def slices(raw: bytes, cut: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in slices of about ``size`` bytes, each cut at a byte ``cut``; longer where there is none. The cut byte itself goes."""
    size, at = size or SLICE_BYTES, 0
    while len(raw) - at > size:
        end = raw.rfind(cut, at, at + size)
        end = raw.find(cut, at + size) if end < 0 else end
        if end < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:] if at else raw


class Numbering:
    """Words numbered by their first appearance."""

    def __init__(self, *first: bytes) -> None:
        self.of: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)  # a factory that does not hold the dictionary: no cycle keeps it
        self.numbers(list(first))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.__getitem__, words), np.int32, len(words))


def numbered_words(pieces: list[bytes], table: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between blanks of all ``pieces`` after ``table``, each with one blank behind it and numbered by their first appearance; and how many each piece has."""
    data = np.frombuffer(b" ".join([*pieces, b""]).translate(table), np.uint8)
    blank = data == 32
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    n = np.diff(np.searchsorted(ends, np.cumsum([len(p) + 1 for p in pieces]) - 1, side="right"), prepend=0)
    if blank.sum() > len(ends):  # of several blanks the first stays
        keep = ~blank
        keep[ends] = True
        data = data[keep]
        ends = np.flatnonzero(data == 32)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends + 1)), pa.py_buffer(data)])
    return words.dictionary_encode(), n


def block_number(seq: int) -> int:
    """A number for the ``seq``-th block of this task; a table of blocks is written before it is used, so a task that ran twice counts once."""
    return TaskContext.get().partitionId() << 32 | seq


def packed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """Bytes of texts as they lie in the batch; null is empty."""
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a row is a whole block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]
