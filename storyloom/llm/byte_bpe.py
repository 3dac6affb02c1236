"""Byte-level BPE as a monoid: encode halves, join them, decode by concatenation.

Two levels use the same idea.

*Text.*  A text is halved down to leaves, each leaf is split into pre-tokens,
and neighbours are joined by splitting a window around the seam again.  Every
branch of the splitting pattern decides a match after reading at most
``LOOKAHEAD`` characters past its end and never looks behind, so pre-tokens
ending that far before the seam stand, and once a new boundary falls on a
boundary of the right half everything after it stands too.  The window grows
until both hold.

*Pre-token.*  A byte string is halved down to ``leaf_bytes``, leaves are merged
by rank, and neighbours are joined by re-encoding a window of tokens around
the seam.  A token sequence is the encoding of its bytes exactly if every two
neighbours are the encoding of theirs; so when a window's first and last
tokens come out unchanged, the tokens outside it have the neighbours they had
and are stable.  Otherwise the window doubles.

Encoded pre-tokens are kept in a bounded memory per task, as packed 32-bit ids.

Defined results: a null text counts as empty and has no ids; special tokens
are ordinary text; repeated rows encode alike; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storyloom.llm import batches

#: Characters past a match's end that the splitting pattern may look at.
LOOKAHEAD = 3
LEAF_CHARS = 8192
LEAF_BYTES = 32
SHORT_BYTES = 64
MEMORY_ENTRIES = 150_000
MAX_RANK_FILE = 32 << 20


def read_rank_file(path: str) -> bytes:
    """The rank file's bytes, read on the driver; refuses an oversized one."""
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError(f"{path}: more than {MAX_RANK_FILE} bytes of ranks")
    return raw


_NONE = 1 << 62


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge neighbours, lowest rank first and leftmost among equals, until no
    two neighbours form a token."""
    return _merge_short(data, ranks) if len(data) <= SHORT_BYTES else _merge_long(data, ranks)


def _merge_short(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By scanning the pair ranks, which is fastest for a few bytes."""
    get, cuts = ranks.get, list(range(len(data) + 1))
    pairs = [get(data[i:i + 2], _NONE) for i in range(len(data) - 1)]
    while pairs and (best := min(pairs)) != _NONE:
        i = pairs.index(best)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(data[cuts[i]:cuts[i + 2]], _NONE)
        if i:
            pairs[i - 1] = get(data[cuts[i - 1]:cuts[i + 1]], _NONE)
    return [ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a queue of pairs."""
    n = len(data)
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
    heapq.heapify(queue)
    alive = [True] * n
    while queue:
        _, i, end = heapq.heappop(queue)
        j = ends[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(data[i:ends[end]])) is not None:
                heapq.heappush(queue, (r, i, ends[end]))
        if (k := before[i]) >= 0 and (r := ranks.get(data[k:end])) is not None:
            heapq.heappush(queue, (r, k, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i:ends[i]]])
        i = ends[i]
    return out


class ByteBpe:
    """Encoder and decoder over one rank file and splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str, leaf_chars: int = LEAF_CHARS,
                 leaf_bytes: int = LEAF_BYTES):
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines()) if t}
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.split = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self._packed: dict[str, bytes] = {}

    # ---- bytes of one pre-token -------------------------------------------

    def tokens(self, data: bytes) -> list[int]:
        """Tokens of a byte string: leaves merged by rank, halves joined."""
        if len(data) <= self.leaf_bytes:
            return merge_by_rank(data, self.ranks)
        half = len(data) // 2
        return self.join_tokens(self.tokens(data[:half]), self.tokens(data[half:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encodings."""
        if not left or not right:
            return left + right
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            again = merge_by_rank(b"".join(self.bytes_of[t] for t in a + b), self.ranks)
            if (len(a) == len(left) or again[0] == a[0]) and (len(b) == len(right) or again[-1] == b[-1]):
                return left[:len(left) - len(a)] + again + right[len(b):]
            width *= 2

    def packed(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        found = self._packed.get(piece)
        if found is None:
            data = piece.encode()
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else self.tokens(data)
            found = pack(f"<{len(ids)}I", *ids)
            if len(self._packed) >= MEMORY_ENTRIES:
                self._packed.clear()
            self._packed[piece] = found
        return found

    # ---- pre-tokens of one text -------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text: leaves split by the pattern, halves joined."""
        if len(text) <= self.leaf_chars:
            return self.split(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """Pre-tokens of the concatenation of two split texts."""
        width = 2
        while True:
            a, b = left[-width:], right[:width]
            seam = sum(map(len, a))
            again = self.split("".join(a) + "".join(b))
            end = seam + sum(map(len, b))
            standing = end if len(b) == len(right) else end - LOOKAHEAD
            if len(a) == len(left) or seam >= LOOKAHEAD:
                starts, at = {}, seam
                for j, piece in enumerate(b):
                    starts[at] = j
                    at += len(piece)
                starts[at] = len(b)
                at = 0
                for i in range(len(again) + 1):
                    if at >= seam and at <= standing and at in starts:
                        return left[:len(left) - len(a)] + again[:i] + right[starts[at]:]
                    if i < len(again):
                        at += len(again[i])
            width *= 2

    # ---- documents ---------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return b"".join(map(self.packed, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids, halves concatenated up the tree."""
        if len(packed) <= 4 * self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        half = len(packed) // 8 * 4
        return self.decode(packed[:half]) + self.decode(packed[half:])


@lru_cache(maxsize=2)
def coder(rank_file: bytes, pattern: str) -> ByteBpe:
    """One coder per task process."""
    return ByteBpe(rank_file, pattern)


def encoded(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text",
            ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col``: the packed ids (little-endian unsigned 32-bit)
    of the whole text.  The rank file is read on the driver and broadcast; its
    size does not depend on the data and is checked."""
    return _mapped(docs, rank_path, pattern, text_col, [(ids_col, T.BinaryType(), pa.binary())],
                   lambda bpe, texts: [[bpe.encode(t.decode()) if t else b"" for t in texts]])


def decoded(docs: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids",
            out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``: the bytes of the packed ids."""
    return _mapped(docs, rank_path, pattern, ids_col, [(out_col, T.BinaryType(), pa.binary())],
                   lambda bpe, packed: [[bpe.decode(p) if p else b"" for p in packed]])


def round_trip_digests(docs: DataFrame, rank_path: str, pattern: str, key_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Per row: number of tokens and digests of the ids and of their decoding."""
    def digest(bpe: ByteBpe, texts):
        packed = [bpe.encode(t.decode()) if t else b"" for t in texts]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [[len(p) // 4 for p in packed], [sha(p) for p in packed], [sha(bpe.decode(p)) for p in packed]]

    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()),
             ("decoded_sha256", T.StringType(), pa.string())]
    out = _mapped(docs.select(key_col, text_col), rank_path, pattern, text_col, added, digest, (text_col,))
    return out


def _mapped(docs: DataFrame, rank_path: str, pattern: str, in_col: str, added, work,
            drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs`` with the columns ``added`` that ``work`` makes of a chunk
    of ``in_col``; a column of the same name is replaced."""
    names = [a[0] for a in added]
    clashing = [c for c in names if c in docs.columns and c != in_col]
    docs = docs.drop(*clashing)
    kept = [c for c in docs.columns if c not in drop and c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(read_rank_file(rank_path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value, pattern)
        for batch in it:
            for part, values in batches.chunks(batch, in_col):
                made = work(bpe, values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept]
                    + [pa.array(m, t) for m, (_, _, t) in zip(made, added)], names=kept + names)

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t, _ in added])
    return docs.mapInArrow(run, schema)
