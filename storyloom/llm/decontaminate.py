"""Benchmark decontamination by a broadcast hash set of test n-grams.

Every window of ``width`` normalised words of a benchmark item (or the whole
item, if it is shorter) is hashed.  A task maps a chunk's words to the ids of
the benchmark's own vocabulary, hashes the windows whose words are all known,
looks the hashes up, and confirms each hit word by word, so a collision cannot
pass.  Documents are never shuffled.

What is broadcast grows with the benchmark, not with the corpus, and its size
is checked: an index holds at most ``max_index_words`` item words; a larger
benchmark is cut into slices by item, and the documents pass one slice after
the other, written to the shared folder in between, each pass adding its hits.

Defined results: a null or empty text has no words and no hits; items without
words have no windows; repeated items are both reported; an empty benchmark
leaves all documents clean; documents may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm import batches
from storyloom.llm.rows import parked, unparked
from storyloom.session import cut_lineage

WIDTH = 10
MAX_INDEX_WORDS = 2_000_000


@dataclass
class NgramIndex:
    """The windows of one slice of items, ready to ship to tasks."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    tables: list[tuple[int, np.ndarray, np.ndarray, list[list[str]]]] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[str, str]], width: int) -> "NgramIndex":
        """``tables``: per window length the sorted hashes, the word ids of each
        window and the items that hold it."""
        vocabulary = batches.Ids()
        windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [vocabulary[w] for w in batches.folded_words(text.encode())]
            size = min(width, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                windows.setdefault(size, {}).setdefault(tuple(ids[k:k + size]), set()).add(item)
        tables = []
        for size, found in sorted(windows.items()):
            rows = np.array(list(found), np.int64)
            hashes = batches.window_hashes(rows.reshape(-1), size)[::size]
            order = np.argsort(hashes, kind="stable")
            holders = [sorted(x) for x in found.values()]
            tables.append((size, hashes[order], rows[order], [holders[i] for i in order]))
        return cls(dict(vocabulary), tables)

    def hits(self, values: np.ndarray, offsets: np.ndarray):
        """Yield (word position, window length, items) of every occurrence."""
        known = np.concatenate(([0], np.cumsum(values >= 0)))
        for size, hashes, rows, holders in self.tables:
            n = len(values) - size + 1
            if n <= 0:
                continue
            at = np.flatnonzero(batches.inside(offsets, size) & (known[size:] - known[:n] == size))
            if not len(at):
                continue
            grams = values[at[:, None] + np.arange(size)]
            got = batches.window_hashes(grams.reshape(-1), size)[::size]
            low = np.searchsorted(hashes, got, "left")
            high = np.searchsorted(hashes, got, "right")
            for i in np.flatnonzero(high > low):
                for row in range(low[i], high[i]):
                    if np.array_equal(rows[row], grams[i]):
                        yield int(at[i]), size, holders[row]


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan_chunk(index: NgramIndex, texts: list[bytes | None]):
    """Per document of a chunk: number of words, merged hit spans, hit items."""
    get = index.vocabulary.get
    words = [batches.folded_words(t) if t else [] for t in texts]
    values, offsets = batches.flatten(words, lambda w: get(w, -1))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for at, size, holders in index.hits(values, offsets):
        doc = int(np.searchsorted(offsets, at, "right")) - 1
        start = at - int(offsets[doc])
        spans[doc].append((start, start + size))
        items[doc].update(holders)
    return np.diff(offsets), [merged(s) for s in spans], items


def _pass(docs: DataFrame, index: NgramIndex, text_col: str) -> DataFrame:
    """One scan: ``docs`` (with the columns of ``HITS``) plus this slice's hits."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    columns = docs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in batches.chunks(batch, text_col):
                counts, spans, items = scan_chunk(shared.value, texts)
                cols = {c: part.column(i) for i, c in enumerate(columns)}
                old_spans, old_items = cols["hit_spans"].to_pylist(), cols["hit_items"].to_pylist()
                cols["n_words"] = pa.array(counts, pa.int64())
                cols["hit_spans"] = pa.array(
                    [[{"start": a, "end": b} for a, b in merged(new + [(x["start"], x["end"]) for x in old])]
                     for new, old in zip(spans, old_spans)], _SPANS)
                cols["hit_items"] = pa.array(
                    [sorted(new.union(old)) for new, old in zip(items, old_items)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=columns)

    return docs.mapInArrow(run, docs.schema)


def benchmark_slices(benchmark: DataFrame, item_col: str, text_col: str,
                     max_index_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of at most ``max_index_words`` words (one item at
    least); the driver holds one list at a time.

    The number of lists comes from the total size, counted by Spark."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    n = max(1, -(-int(total) // max_index_words))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r.item if r.item is not None else "", r.text) for r in part.collect()]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
              max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (half-open word positions under
    any benchmark window) and ``hit_items`` (sorted as strings)."""
    base = docs.drop(*[c for c in HITS.names if c != text_col])
    out = base.select(
        "*", F.lit(0).cast("long").alias("n_words"),
        F.array().cast(HITS["hit_spans"].dataType).alias("hit_spans"),
        F.array().cast("array<string>").alias("hit_items"))
    first = True
    for items in benchmark_slices(benchmark, item_col, item_text_col, max_index_words):
        out = _pass(out if first else cut_lineage(out), NgramIndex.build(items, width), text_col)
        first = False
    return out


def n_hit():
    """Column: words under a hit span."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def removed(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the words of ``spans`` and what stands between them; a
    line break stays where a span was, so its neighbours do not run together."""
    plain = raw.translate(batches._FOLD)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last:starts[a]])
        last = ends[b - 1]
    return b"\n".join([*out, raw[last:]])


def _cut(found: DataFrame, text_col: str) -> DataFrame:
    """Cut the hit spans out of every text."""
    columns = found.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, texts in batches.chunks(batch, text_col):
                spans = part.column(columns.index("hit_spans")).to_pylist()
                new = [removed(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)]
                cols = list(part.columns)
                cols[columns.index(text_col)] = pa.array(new, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=columns)

    return found.mapInArrow(run, found.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                   max_hit_percent: int = 50,
                   max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """The rows of ``docs`` without benchmark text.

    A document of which over ``max_hit_percent`` of the words are hit goes;
    of the others the hit spans are cut out.  Words can meet across a cut and
    form a window again, so the documents that were cut are scanned until they
    come out clean.  Rows without hits stay as they are."""
    names = {"_text": text_col}
    done, left = None, parked(docs, **names)
    columns = left.columns
    while True:
        found = cut_lineage(with_hits(left, benchmark, "_text", item_col, item_text_col, width, max_index_words))
        clean = found.where(F.size("hit_spans") == 0).select(*columns)
        done = clean if done is None else done.unionByName(clean)
        hit = found.where((F.size("hit_spans") > 0)
                          & (n_hit() * 100 <= F.lit(max_hit_percent) * F.col("n_words")))
        if hit.isEmpty():
            return unparked(done, docs.columns, **names)
        left = _cut(hit, "_text").select(*columns)
