"""Cross-tokenizer alignment with external spill counting of linked id pairs.

A text is encoded by a byte-level BPE (side A, on a blank and the text) and by a
sentence-piece model (side B, which adds the blank).  Byte offsets where tokens
of both sides end cut the two token rows into groups; every A token of a group is
linked to every B token of it.  An id pair counts the documents that hold it
linked; a link is best if its pair counts as much as any pair of its A id.

Counting is external.

1. *Spill.*  A task gathers (pair, document) records of some thousand documents
   into a run, sorts them and keeps the postings (which documents hold a pair, how
   often) with the documents.  The run's distinct pairs and their local counts are
   cut by the low bits of the A id into ``PARTS`` radix partitions, each a zstd
   stream of sorted blocks.
2. *Merge.*  Per partition, a k-way heap merge of up to ``FAN_IN`` streams sums
   the counts.  More streams than that are merged in rounds.
3. *Back.*  Pairs are sorted by A id first, so an id's greatest count is known
   when its stretch ends.  The totals stream back to each merged stream, down the
   rounds, and last to the runs, as (count, best) aligned with their pairs, where
   they are added up over the postings.

Scale: what is shuffled is a run's distinct pairs, so a pair that all documents
hold costs one record a run and never a list of documents.  A run is bounded by
``RUN_LINKS`` and ``RUN_DOCS`` (but holds one document whole); a merge holds
``FAN_IN`` streams of one partition, bounded by the two vocabularies.  Rounds
follow the logarithm of the number of runs.  Inside a group of more than
``WIDE_GROUP`` links, equal ids are counted first, so a long run of one letter
costs its different ids.  All tables between steps are in the shared folder.

Defined results: a null or empty text, or one whose token bytes on either side
are not a blank and the text (such as a text with the sentence-piece blank mark),
has no tokens: counts 0, groups ''.  Special tokens' strings are plain text.
Every row is a document, also rows equal in key and text.  Of other columns only
those named are read, so none clash; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from struct import calcsize, pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm import batches
from storyloom.session import cut_lineage, forget

PARTS = 256
FAN_IN = 128
RUN_LINKS = 1_500_000
RUN_DOCS = 1 << 16
WIDE_GROUP = 1024
BLOCK_PAIRS = 8192
#: Bits of a record that name the document inside its run.
SLOT_BITS = 20
CHUNK_BYTES = 256 << 10
MAX_MODEL_FILE = 64 << 20
#: Fixed value: how the byte-level pre-tokenizer of a vocabulary file splits text.
BYTE_LEVEL_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Longest text for the rank encoder, whose splitting may backtrack.
RANKED_BYTES = 1 << 20


def read_model_file(path: str) -> bytes:
    """A tokenizer file's bytes, read on the driver; refuses an oversized one."""
    with open(path, "rb") as f:
        raw = f.read(MAX_MODEL_FILE + 1)
    if len(raw) > MAX_MODEL_FILE:
        raise ValueError(f"{path}: more than {MAX_MODEL_FILE} bytes")
    return raw


def byte_letters() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked_encoder(file: dict, letters: dict[str, int]):
    """An encoder that merges by id, if that is what the vocabulary file says:
    plain byte-level splitting, bytes as the first ids and merges in order of the
    ids they make; else None."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = (file.get("normalizer") is None and model["type"] == "BPE" and not model.get("dropout")
             and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
             and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    vocab = model["vocab"]
    first = len(letters)
    if not (plain and all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(merges))
            and sorted(vocab.get(c, -1) for c in letters) == list(range(first))):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in entry): i for entry, i in vocab.items() if i < first + len(merges)}
    return tiktoken.Encoding("side_a", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Tokenizers:
    """Both sides' encoders, the bytes of their tokens and of their ids' text."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(a_file)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_file)
        letters = byte_letters()
        entries = self.a.get_vocab()
        self.ranked = ranked_encoder(json.loads(a_file), letters)
        self.n_a, self.n_b = max(entries.values(), default=-1) + 1, self.b.vocab_size()
        if self.n_a * self.n_b >= 1 << (63 - SLOT_BITS):
            raise ValueError("vocabularies too large for one 64-bit record")
        self.a_bytes = [b""] * self.n_a
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else b""
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.n_b)))]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: an id's text inside a group and as the last of its side
        self.shown = [f"{i}{end}" for i in range(self.n_a) for end in ",|"] + [
            f"{i}{end}" for i in range(self.n_b) for end in ",;"]
        self.per_part = -(-self.n_a // PARTS)

    def encode(self, raw: list[bytes | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides, empty where the text has no tokens."""
        at = [i for i, t in enumerate(raw) if t]
        texts = [raw[i].decode() for i in at]
        a, b = [[] for _ in raw], [[] for _ in raw]
        if texts:
            for i, left, right in zip(at, self.encode_a(texts), self.b.encode(texts, num_threads=1)):
                whole = b" " + raw[i]
                if (b"".join(map(self.a_bytes.__getitem__, left)) == whole
                        and b"".join(map(self.b_bytes.__getitem__, right)) == whole):
                    a[i], b[i] = left, right
        return a, b

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Side A's ids of a blank and each text.  Latin-1 texts, whose characters
        all libraries class alike, go to the rank encoder, which is faster."""
        fast = [self.ranked is not None and len(t) <= RANKED_BYTES and _latin(t) for t in texts]
        slow = self.a.encode_batch([" " + t for t, f in zip(texts, fast) if not f], add_special_tokens=False)
        rest = iter(slow)
        return [self.ranked.encode_ordinary(" " + t) if f else next(rest).ids for t, f in zip(texts, fast)]

    def ordered_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs as numbers whose order is radix partition, A id, B id."""
        return (a % PARTS * self.per_part + a // PARTS) * self.n_b + b

    def ids_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = pairs // self.n_b
        return turned % self.per_part * PARTS + turned // self.per_part, pairs % self.n_b


@lru_cache(maxsize=1)
def tokenizers_of(a_file: bytes, b_file: bytes) -> Tokenizers:
    """One pair of tokenizers per task process."""
    return Tokenizers(a_file, b_file)


# ---- one chunk of documents ---------------------------------------------------

def _offsets(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, … inside each of consecutive stretches of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Aligned:
    """Groups and links of a chunk of documents, on one axis of bytes."""

    def __init__(self, tok: Tokenizers, raw: list[bytes | None]):
        self.tok = tok
        a, b = tok.encode(raw)
        self.a_at, self.b_at = _offsets(a), _offsets(b)
        self.a = np.fromiter(chain.from_iterable(a), np.int64, self.a_at[-1])
        self.b = np.fromiter(chain.from_iterable(b), np.int64, self.b_at[-1])
        a_ends, b_ends = np.cumsum(tok.a_sizes[self.a]), np.cumsum(tok.b_sizes[self.b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        #: tokens of either side before each group, and in all
        self.a_from = np.concatenate(([0], np.searchsorted(a_ends, cuts, "right")))
        self.b_from = np.concatenate(([0], np.searchsorted(b_ends, cuts, "right")))
        self.p, self.q = np.diff(self.a_from), np.diff(self.b_from)
        self.a_group = np.repeat(np.arange(len(cuts)), self.p)
        #: groups before each document, and in all
        self.g_at = np.searchsorted(self.a_from, self.a_at, "left")

    def n_links(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.p * self.q)))
        return np.diff(total[self.g_at])

    def group_texts(self) -> list[str]:
        """Per document ``a1,a2|b1;a3|b2,b3``."""
        b_group = np.repeat(np.arange(len(self.q)), self.q)
        n_a, n_b = len(self.a), len(self.b)
        codes = np.empty(n_a + n_b, np.int64)
        last = np.zeros(n_a, np.int64)
        last[self.a_from[1:] - 1] = 1
        codes[np.arange(n_a) + self.b_from[self.a_group]] = 2 * self.a + last
        last = np.zeros(n_b, np.int64)
        last[self.b_from[1:] - 1] = 1
        codes[np.arange(n_b) + self.a_from[b_group + 1]] = 2 * (self.tok.n_a + self.b) + last
        at = (self.a_at + self.b_at).tolist()
        show = self.tok.shown.__getitem__
        return ["".join(map(show, codes[i:j].tolist()))[:-1] for i, j in zip(at, at[1:])]

    def records(self, first_slot: int) -> tuple[np.ndarray, np.ndarray]:
        """(pair and slot as one number, links) of all groups; numbers may repeat."""
        slot = np.repeat(np.arange(len(self.g_at) - 1) + first_slot, np.diff(self.g_at))
        wide = self.p * self.q > WIDE_GROUP
        q = np.where(wide, 0, self.q)[self.a_group]
        left = np.repeat(np.arange(len(self.a)), q)
        right = self.b_from[self.a_group[left]] + _spread(q)
        pairs = [self.tok.ordered_pairs(self.a[left], self.b[right])]
        slots, links = [slot[self.a_group[left]]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            a, n = np.unique(self.a[self.a_from[g]:self.a_from[g + 1]], return_counts=True)
            b, m = np.unique(self.b[self.b_from[g]:self.b_from[g + 1]], return_counts=True)
            pairs.append(self.tok.ordered_pairs(a[:, None], b[None, :]).ravel())
            links.append((n[:, None] * m[None, :]).ravel())
            slots.append(np.full(len(a) * len(b), slot[g]))
        return np.concatenate(pairs) << SLOT_BITS | np.concatenate(slots), np.concatenate(links)


# ---- runs ---------------------------------------------------------------------

def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values[order], first)


def squeezed(values: np.ndarray) -> bytes:
    """A zstd frame of integers, byte plane by byte plane."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(frame: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


_HEAD = "<II"


def stream_of(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Sorted (pairs, values) as blocks, each two zstd frames behind their sizes."""
    out = []
    for pairs, values in parts:
        for i in range(0, len(pairs), BLOCK_PAIRS):
            steps = pairs[i:i + BLOCK_PAIRS].copy()
            steps[1:] -= pairs[i:i + BLOCK_PAIRS][:-1]
            one, two = squeezed(steps), squeezed(values[i:i + BLOCK_PAIRS])
            out += [pack(_HEAD, len(one), len(two)), one, two]
    return b"".join(out)


def blocks_of(stream: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(stream):
        one, two = unpack_from(_HEAD, stream, at)
        at += calcsize(_HEAD)
        yield np.cumsum(expanded(stream[at:at + one])), expanded(stream[at + one:at + one + two])
        at += one + two


def heap_merge(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of all streams' values by pair, in order.  The heap holds the last
    pair of each stream's block in hand; pairs up to the least of these are
    complete in the blocks in hand."""
    left = [blocks_of(s) for s in streams]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def refill(i: int) -> None:
        if (block := next(left[i], None)) is not None:
            held[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(streams)):
        refill(i)
    while heap:
        bound = heap[0][0]
        done = []
        while heap and heap[0][0] == bound:
            done.append(heapq.heappop(heap)[1])
        taken = []
        for i, (pairs, values) in list(held.items()):
            cut = int(np.searchsorted(pairs, bound, "right"))
            taken.append((pairs[:cut], values[:cut]))
            held[i] = pairs[cut:], values[cut:]
        for i in done:
            del held[i]
            refill(i)
        yield summed(np.concatenate([p for p, _ in taken]), np.concatenate([v for _, v in taken]))


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]], n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, 2 x count + best): an A id's stretch is held until it ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def closed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = pairs // n_b
        first = np.flatnonzero(np.concatenate(([True], side[1:] != side[:-1])))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
        return pairs, 2 * counts + (counts == most)

    for block in blocks:
        held.append(block)
        side = block[0] // n_b
        if side[0] != held[0][0][0] // n_b or side[-1] != side[0]:
            pairs, counts = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(pairs // n_b, side[-1], "left"))
            if cut:
                yield closed(pairs[:cut], counts[:cut])
            held = [(pairs[cut:], counts[cut:])]
    if held:
        yield closed(*(np.concatenate(x) for x in zip(*held)))


_SPILL = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("stream", T.BinaryType())]))
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def spilled(docs: DataFrame, a_path: str, b_path: str, key_col: str, text_col: str,
            keep_groups: bool = False) -> DataFrame:
    """One row per run: its documents as arrays, the postings of its pairs and the
    radix partitions of their counts."""
    files = docs.sparkSession.sparkContext.broadcast((read_model_file(a_path), read_model_file(b_path)))
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    key_type = rows.schema["key"].dataType
    schema = T.StructType(
        [T.StructField("run", T.LongType()), T.StructField("keys", T.ArrayType(key_type))]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in _COUNTS]
        + [T.StructField("groups", T.ArrayType(T.StringType()))]
        + [T.StructField(c, T.BinaryType()) for c in ("holders", "slots", "links")] + [T.StructField("spill", _SPILL)])
    spill_type = pa.list_(pa.struct([("part", pa.int32()), ("stream", pa.binary())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers_of(*files.value)
        number = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        counts: list[np.ndarray] = []
        groups: list[str] = []
        records: list[tuple[np.ndarray, np.ndarray]] = []
        n_docs = n_records = 0

        def made() -> pa.RecordBatch:
            numbers, links = summed(*(np.concatenate(x) for x in zip(*records)))
            pairs, slots = numbers >> SLOT_BITS, numbers & (1 << SLOT_BITS) - 1
            first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
            distinct, holders = pairs[first], np.diff(np.append(first, len(pairs)))
            ends = np.searchsorted(distinct, np.arange(1, PARTS + 1) * tok.per_part * tok.n_b, "left").tolist()
            spill = [{"part": k, "stream": stream_of(iter([(distinct[i:j], holders[i:j])]))}
                     for k, (i, j) in enumerate(zip([0, *ends], ends)) if j > i]
            span = pa.array([0, n_docs], pa.int32())
            table = np.concatenate(counts, axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.ListArray.from_arrays(span, pa.concat_arrays(keys))]
                + [pa.ListArray.from_arrays(span, pa.array(row, pa.int64())) for row in table]
                + [pa.array([groups], pa.list_(pa.string()))]
                + [pa.array([squeezed(x)], pa.binary()) for x in (holders, slots, links)]
                + [pa.array([spill], spill_type)], names=schema.names)

        for batch in it:
            for part, raw in batches.chunks(batch, "text", CHUNK_BYTES):
                chunk = Aligned(tok, raw)
                texts = chunk.group_texts()
                records.append(chunk.records(n_docs))
                groups += texts if keep_groups else [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                counts.append(np.stack((np.diff(chunk.a_at), np.diff(chunk.b_at), np.diff(chunk.g_at), chunk.n_links())))
                keys.append(part.column(0))
                n_docs += part.num_rows
                n_records += len(records[-1][0])
                if n_records >= RUN_LINKS or n_docs >= RUN_DOCS:
                    yield made()
                    number, n_docs, n_records = number + 1, 0, 0
                    keys, counts, groups, records = [], [], [], []
        if n_docs:
            yield made()

    return rows.mapInArrow(run, schema)


# ---- merging and the way back ---------------------------------------------------

_STREAMS = "part int, run long, stream binary"


def _answers(asked: pa.Table, told: pa.Table) -> pa.Table:
    """The told stream's values for the pairs of each asked stream."""
    pairs, values = (np.concatenate(x) for x in zip(*blocks_of(told.column("stream")[0].as_py())))
    found = []
    for stream in asked.column("stream"):
        own = ((p, values[np.searchsorted(pairs, p)]) for p, _ in blocks_of(stream.as_py()))
        found.append(stream_of(own))
    return pa.table([asked.column("part"), asked.column("run"), pa.array(found, pa.binary())],
                    names=["part", "run", "stream"])


def totals(runs: DataFrame, n_b: int, fan_in: int = FAN_IN) -> tuple[DataFrame, list[DataFrame]]:
    """The merged stream of each partition with (2 x count + best), and the
    streams of each round below it, the runs' own first."""
    def merge(last: bool):
        def merged(group: pa.Table) -> pa.Table:
            sums = heap_merge([s.as_py() for s in group.column("stream")])
            stream = stream_of(with_best(sums, n_b) if last else sums)
            return pa.table([group.column("part").slice(0, 1), group.column("parent").slice(0, 1),
                             pa.array([stream], pa.binary())], names=["part", "run", "stream"])
        return merged

    n = runs.count()
    rounds = [runs.select("run", F.inline("spill")).select("part", "run", "stream")]
    while True:
        n = max(1, -(-n // fan_in))
        parent = F.lit(0) if n == 1 else F.pmod(F.xxhash64("run"), F.lit(n))
        rounds[-1] = rounds[-1].withColumn("parent", parent.cast("long"))
        above = cut_lineage(rounds[-1].groupBy("part", "parent").applyInArrow(merge(n == 1), _STREAMS))
        if n == 1:
            return above, rounds
        rounds.append(above)


def answered(top: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(part, run, stream) with the totals for every run's own pairs."""
    told = top
    for asked in reversed(rounds):
        told = (asked.groupBy("part", "parent").cogroup(told.groupBy("part", "run")).applyInArrow(_answers, _STREAMS))
        told = cut_lineage(told) if asked is not rounds[0] else told
    return told


def aligned(docs: DataFrame, a_path: str, b_path: str, key_col: str = "doc_id", text_col: str = "text",
            keep_groups: bool = False, fan_in: int = FAN_IN) -> DataFrame:
    """Per document: ``key_col``, the numbers of tokens, groups and links,
    ``n_best`` (links whose pair counts most for its A id), ``count_sum`` (the
    counts of all links) and ``groups_sha256``, or the ``groups`` themselves."""
    runs = cut_lineage(spilled(docs, a_path, b_path, key_col, text_col, keep_groups))
    n_b = tokenizers_of(read_model_file(a_path), read_model_file(b_path)).n_b
    told = answered(*totals(runs, n_b, fan_in))
    shown = "groups" if keep_groups else "groups_sha256"
    schema = T.StructType(
        [T.StructField(key_col, runs.schema["keys"].dataType.elementType)]
        + [T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")]
        + [T.StructField(shown, T.StringType())])

    def add_up(own: pa.Table, answers: pa.Table) -> pa.Table:
        column = lambda c: own.column(c)[0]
        keys = column("keys").values
        sums = np.zeros((2, len(keys)), np.int64)
        if answers.num_rows:
            order = np.argsort(answers.column("part").to_numpy())
            streams = answers.column("stream").take(pa.array(order))
            values = np.concatenate([v for s in streams for _, v in blocks_of(s.as_py())])
            holders, slots, links = (expanded(column(c).as_py()) for c in ("holders", "slots", "links"))
            values = np.repeat(values, holders)
            np.add.at(sums[0], slots, links * (values & 1))
            np.add.at(sums[1], slots, links * (values >> 1))
        return pa.table([keys, *[column(c).values for c in _COUNTS], pa.array(sums[0]), pa.array(sums[1]),
                         column("groups").values], names=schema.names)

    own = runs.drop("spill")
    return own.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(add_up, schema)


def pair_counts(docs: DataFrame, a_path: str, b_path: str, key_col: str = "doc_id", text_col: str = "text",
                fan_in: int = FAN_IN) -> DataFrame:
    """Every linked pair of the corpus: ``a_id``, ``b_id``, ``n_docs``, ``best``."""
    runs = cut_lineage(spilled(docs, a_path, b_path, key_col, text_col))
    files = read_model_file(a_path), read_model_file(b_path)
    top, _ = totals(runs, tokenizers_of(*files).n_b, fan_in)
    forget(runs)
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers_of(*shared.value)
        for batch in it:
            for stream in batch.column(0):
                for pairs, values in blocks_of(stream.as_py()):
                    a, b = tok.ids_of(pairs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(values >> 1, pa.int64()),
                         pa.array(values & 1 == 1)], names=["a_id", "b_id", "n_docs", "best"])

    return top.select("stream").mapInArrow(listed, "a_id long, b_id long, n_docs long, best boolean")
