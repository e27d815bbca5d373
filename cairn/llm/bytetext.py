"""Texts of an Arrow batch as one numpy byte array, with word positions found for all of them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # working arrays stay within a few dozen MB whatever the batch holds


def lookup(predicate: Callable[[int], bool]) -> np.ndarray:
    return np.array([predicate(b) for b in range(256)])


#: Letters, digits and every byte of a non-ASCII character: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower-cased.
IS_WORD = lookup(lambda b: chr(b).isalnum() and b < 128 or b >= 128)
#: Everything but ASCII white space.
IS_DARK = lookup(lambda b: b not in (0x20, 9, 10, 11, 12, 13))
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def regrouped(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``limit`` bytes, for work that gains from seeing more rows at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together; a longer text stands alone."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Block:
    """Some texts laid end to end, with a zero byte before each and after the last.

    ``data``: the bytes; ``at``: where each text starts; ``end``: where each text ends.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.data = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.end = np.cumsum(sizes + 1)
        self.at = self.end - sizes

    def words(self, kind: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word in ``data``, and the number of the first word of each text (one more entry at the end).

        The zero bytes between texts are never of a word kind that matters here, except for IS_DARK,
        which is why they are switched off by place.
        """
        mark = kind[self.data].view(np.int8)
        mark[0] = 0
        mark[self.end] = 0
        step = np.diff(mark)
        begin = np.flatnonzero(step == 1) + 1
        stop = np.flatnonzero(step == -1) + 1
        first = np.searchsorted(begin, np.append(self.at, len(self.data)))
        return begin, stop, first
