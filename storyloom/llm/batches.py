"""Bounded walks over Arrow batches and vectorised word tables.

Shared by the operators that run numpy inside tasks.  A batch is cut into
chunks of whole documents of about ``CHUNK_BYTES`` so that temporary arrays
stay small whatever the batch size; a document longer than that is a chunk of
its own (a row must fit in a task anyway).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
VOCABULARY_ENTRIES = 200_000

_FOLD = bytes(
    (b + 32) if 0x41 <= b <= 0x5A else (b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    for b in range(256))


def folded_words(raw: bytes) -> list[bytes]:
    """Lower-case A-Z and split into words of a-z, 0-9 and non-ASCII characters."""
    return raw.translate(_FOLD).split()


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def chunks(batch: pa.RecordBatch, text_col: str,
           max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of ``batch`` of about ``max_bytes`` of text each, with their texts."""
    column = batch.column(batch.schema.get_field_index(text_col))
    start, n = 0, batch.num_rows
    while start < n:
        stop, size = start, 0
        while stop < n and (stop == start or size < max_bytes):
            size += len(column[stop].as_buffer() or b"") if column[stop].is_valid else 0
            stop += 1
        yield batch.slice(start, stop - start), raw_texts(column.slice(start, stop - start))
        start = stop


class Ids(dict):
    """Word -> small id in order of first sight; exact, local to one task."""

    def __missing__(self, word):
        self[word] = value = len(self)
        return value


def flatten(lists: list[list[bytes]], lookup) -> tuple[np.ndarray, np.ndarray]:
    """All words of a chunk as one array of ``lookup`` values, and the offsets
    of its documents (``len(lists) + 1`` entries)."""
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter((lookup(w) for words in lists for w in words), np.int64, offsets[-1])
    return values, offsets


def owner(offsets: np.ndarray) -> np.ndarray:
    """Document index of every word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each document's words."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(32))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` consecutive values (documents are
    not looked at: mask windows that cross a border with ``inside``)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    v = values.astype(np.uint64)
    h = np.full(n, _MIX[2], np.uint64)
    for k in range(width):
        h = mix64(h * _MIX[0] + v[k:k + n])
    return h


def inside(offsets: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows of ``window_hashes`` lie within one document."""
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    doc = owner(offsets)
    return doc[:n] == doc[width - 1:]


def covered(starts: np.ndarray, widths: np.ndarray | int, n: int) -> np.ndarray:
    """Words under at least one of the given windows."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + widths, -1)
    return np.cumsum(edge[:n]) > 0
