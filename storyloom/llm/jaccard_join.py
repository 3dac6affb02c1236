"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. One scan hashes each document's word n-grams, takes MinHash values and
   folds them into band keys.  The number of bands and rows is chosen for a
   target recall at the threshold.
2. Documents with equal n-gram sets become one node with a number of copies;
   everything below works on nodes.
3. Nodes meet on band keys.  A bucket only ties its members to its least
   member, so a bucket gives one row per member, never pairs; the connected
   components of these ties hold every candidate pair.
4. Components are cut into blocks of at most ``BLOCK`` nodes.  The full n-gram
   sets of two blocks meet in one task, where all intersections are counted as
   matrix products, and every pair is decided exactly.  A task returns per
   node its linked copies and one tie to its local component: rows grow with
   nodes and blocks, not with pairs.
5. Classes are the components of the verified ties.

A component of m nodes costs m / BLOCK copies of each set and m^2 / 2 pair
decisions, spread over (m / BLOCK)^2 / 2 tasks: the price of exact link counts
between different texts.

Words are runs of a-z, 0-9 and non-ASCII characters after lowering A-Z.

Defined results: a text of fewer than ``width`` words is one n-gram; a null or
empty text has none, links to nothing and is a class of its own; repeated rows
and equal sets are links of each other (1.0); null and repeated ids are allowed
(a class is known by its least node; its label is the least id that is not
null, so unrelated classes can share a label); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm import batches
from storyloom.llm.components import components
from storyloom.llm.rows import parked, unparked
from storyloom.session import cut_lineage

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
BLOCK = 256
_COLUMNS = 4096


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int


def banding(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> Banding:
    """Most rows per band (fewest false candidates) for which enough bands fit:
    a pair at the threshold shares a band with probability of ``recall`` or more."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = Banding(bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall; allow more hashes")
    return best


class WordHashes(dict):
    """Word -> 64-bit hash, kept for one task and cleared when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= batches.VOCABULARY_ENTRIES:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


def gram_sets(texts: list[bytes | None], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of every document of a chunk."""
    words = [batches.folded_words(t) if t else [] for t in texts]
    values, offsets = batches.flatten(words, hashes.__getitem__)
    every = batches.window_hashes(values, width)
    out = []
    for i in range(len(texts)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a >= width:
            out.append(np.unique(every[a:b - width + 1]))
        elif b > a:
            out.append(batches.window_hashes(values[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(grams: np.ndarray) -> bytes | None:
    """128-bit address of an n-gram set."""
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


class Sketcher:
    """MinHash values of n-gram sets, folded into band keys."""

    def __init__(self, plan: Banding):
        rng = np.random.Generator(np.random.PCG64(7))
        n = plan.bands * plan.rows
        self.plan = plan
        self.odd = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, np.uint64)

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of band keys per non-empty set."""
        full = [s for s in sets if len(s)]
        if not full:
            return np.zeros((0, self.plan.bands), np.int64)
        grams = np.concatenate(full)
        starts = np.concatenate(([0], np.cumsum([len(s) for s in full])[:-1]))
        keys = np.empty((self.plan.bands, len(full)), np.uint64)
        for band in range(self.plan.bands):
            key = np.full(len(full), band + 1, np.uint64)
            for k in range(band * self.plan.rows, (band + 1) * self.plan.rows):
                x = (grams + self.add[k]) * self.odd[k]
                x ^= x >> np.uint64(32)
                x *= self.odd[k]
                key = batches.mix64(key + np.minimum.reduceat(x, starts))
            keys[band] = key
        return keys.T.view(np.int64)


SKETCH = T.StructType([
    T.StructField("_key", T.StringType()), T.StructField("_t", T.LongType()),
    T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
])


def sketches(docs: DataFrame, key_col: str, text_col: str, width: int, plan: Banding) -> DataFrame:
    """Per row of ``docs``: key, text hash, node and band keys; no text."""
    rows = docs.select(F.col(key_col).alias("_key"), F.xxhash64(text_col).alias("_t"), F.col(text_col).alias("_x"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, hashes = Sketcher(plan), WordHashes()
        for batch in it:
            for part, texts in batches.chunks(batch, "_x"):
                sets = gram_sets(texts, width, hashes)
                made = iter(sketcher.bands(sets).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([node_of(s) for s in sets], pa.binary()),
                     pa.array([next(made) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    names=SKETCH.names)

    schema = T.StructType([T.StructField("_key", docs.schema[key_col].dataType), *SKETCH.fields[1:]])
    return rows.mapInArrow(run, schema)


def candidate_components(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that share a band key with another node."""
    rows = nodes.select("node", F.explode("bands").alias("band"))
    buckets = (rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"))
               .where(F.col("least") != F.col("most")).select("band", "least"))
    ties = rows.join(buckets, "band").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return components(ties)


def linked(sets: list[np.ndarray], split: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a similarity of ``threshold`` or more: within the list,
    or only across ``split`` (first part against the rest)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, doc = grams[order], doc[order]
    first = np.concatenate(([True], grams[1:] != grams[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1  # an n-gram of one set alone is in no intersection
    doc, column = doc[shared], np.cumsum(np.concatenate(([True], np.diff(column[shared]) > 0))) - 1 \
        if shared.any() else column[:0]
    a, b = (slice(0, None), slice(0, None)) if split is None else (slice(0, split), slice(split, None))
    common = np.zeros((len(sizes[a]), len(sizes[b])), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        x, y = np.searchsorted(column, [low, low + _COLUMNS])
        m = np.zeros((len(sets), _COLUMNS), np.float32)
        m[doc[x:y], column[x:y] - low] = 1
        common += m[a] @ m[b].T
    both = common.astype(np.int64)
    union = sizes[a][:, None] + sizes[b][None, :] - both
    # an exact comparison: threshold is a decimal fraction of a thousandth
    i, j = np.nonzero(both * 1000 >= union * round(threshold * 1000))
    if split is None:
        keep = i < j
        return i[keep], j[keep]
    return i, j + split


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each item's component under the links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


#: Which of the two blocks of its group a row belongs to.
SAME, LOWER, HIGHER = 0, 1, 2
VERIFIED = "node binary, root binary, n_links long"


def verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """Decide all pairs of every group of ``blocks`` (group, side, node, copies,
    grams), whose rows of a group arrive together and in order."""
    def decide(rows: list[tuple]) -> pa.RecordBatch | None:
        seen, unique = set(), []
        for side, node, copies, grams in rows:
            if node not in seen:
                seen.add(node)
                unique.append((side, node, copies, np.frombuffer(grams, np.uint64)))
        if len(unique) < 2:
            return None
        unique.sort(key=lambda r: (r[0], r[1]))
        sides = [r[0] for r in unique]
        if sides[0] != SAME and sides[0] == sides[-1]:
            return None  # the other block is empty
        split = None if sides[0] == SAME else sides.count(LOWER)
        i, j = linked([r[3] for r in unique], split, threshold)
        if not len(i):
            return None
        copies = np.array([r[2] for r in unique], np.int64)
        links = np.bincount(i, copies[j], len(unique)) + np.bincount(j, copies[i], len(unique))
        root = local_roots(len(unique), i, j)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([unique[k][1] for k in at], pa.binary()), pa.array([unique[root[k]][1] for k in at], pa.binary()),
             pa.array(links[at].astype(np.int64), pa.int64())], names=["node", "root", "n_links"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in it:
            for g, *row in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if g != group:
                    if len(rows) > 1 and (made := decide(rows)) is not None:
                        yield made
                    group, rows = g, []
                rows.append(row)
        if len(rows) > 1 and (made := decide(rows)) is not None:
            yield made

    return blocks.mapInArrow(run, VERIFIED)


def member_sets(docs: DataFrame, members: DataFrame, key_col: str, text_col: str, width: int) -> DataFrame:
    """``members`` (with ``_key``, ``_t`` of one document each) with their full
    n-gram sets, computed again from the texts of these documents alone.

    ``members`` grows with the corpus, so it is hashed into the partitions of
    the texts at every size and never broadcast."""
    rows = docs.select(F.col(key_col).alias("_dkey"), F.xxhash64(text_col).alias("_dt"), F.col(text_col).alias("_x"))
    found = (rows.join(members.hint("shuffle_hash"), (F.col("_dt") == F.col("_t")) & F.col("_dkey").eqNullSafe(F.col("_key")))
             .select("_x", "node", "root", "copies", "n_blocks"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            for part, texts in batches.chunks(batch, "_x"):
                sets = gram_sets(texts, width, hashes)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "root", "copies", "n_blocks", "grams"])

    return found.mapInArrow(run, "node binary, root binary, copies long, n_blocks int, grams binary")


def jaccard_join(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: key, ``_t`` (text hash), ``n_grams_node``
    (address of its n-gram set, null without words), ``class_node`` (identity of
    its class: the least node of its component, null without words),
    ``class_id`` (least key of its class, a label: classes with null or repeated
    keys can share it) and ``n_links`` (other documents at the threshold or
    above)."""
    plan = banding(threshold, recall)
    rows = cut_lineage(sketches(docs, key_col, text_col, width, plan))
    nodes = (rows.where(F.col("node").isNotNull()).groupBy("node")
             .agg(F.count(F.lit(1)).alias("copies"), F.min("_key").alias("least_key"),
                  F.min(F.struct("_key", "_t")).alias("rep"), F.first("bands").alias("bands")))
    roots = cut_lineage(candidate_components(nodes))
    sizes = roots.groupBy("root").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("n_blocks"))
    members = cut_lineage(roots.join(sizes, "root").join(nodes.select("node", "copies", "rep"), "node")
                          .select("node", "root", "n_blocks", "copies", "rep.*"))
    sets = member_sets(docs, members, key_col, text_col, width)
    mine = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    blocks = (sets.withColumn("mine", mine).withColumn("other", other)
              .select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"),
                      F.when(F.col("mine") == F.col("other"), SAME).when(F.col("mine") < F.col("other"), LOWER)
                      .otherwise(HIGHER).alias("side"),
                      "node", "copies", "grams"))
    verified = cut_lineage(verify(blocks.repartition("g").sortWithinPartitions("g"), threshold))
    links = verified.groupBy("node").agg(F.sum("n_links").alias("links"))
    classes = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = classes.join(nodes.select("node", "least_key"), "node")
    least = named.groupBy("root").agg(F.min("least_key").alias("class_key"))
    per_node = (nodes.select("node", "copies", "least_key")
                .join(links, "node", "left")
                .join(classes.join(least, "root").select("node", "root", "class_key"), "node", "left"))
    per_node = per_node.select(
        "node", F.coalesce("root", "node").alias("class_node"),
        F.coalesce("class_key", "least_key").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("_key", "_t", "node").join(per_node, "node", "left").select(
        F.col("_key").alias(key_col), "_t", F.col("node").alias("n_grams_node"), "class_node",
        F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                  threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without near copies: of every class the document
    with the least (key, text hash) stays.  Rows equal in key and text are one
    document and stay or go together; documents without words stay.

    The documents to drop are known by key and text hash, so texts move only
    in that join."""
    joined = cut_lineage(jaccard_join(docs, key_col, text_col, width, threshold, recall))
    place = F.struct(F.col(key_col).isNull().alias("null_last"), F.col(key_col).alias("k"), F.col("_t").alias("t"))
    classed = joined.where(F.col("n_grams_node").isNotNull() & (F.col("n_links") > 0))
    keep = classed.groupBy("class_node").agg(F.min(place).alias("first"))
    drop = (classed.join(keep, "class_node")
            .where(place != F.col("first"))
            .select(F.col(key_col).alias("_dk"), F.col("_t").alias("_dt")).distinct())
    names = {"_key": key_col, "_text": text_col}
    rows = parked(docs, **names)
    same = F.col("_key").eqNullSafe(F.col("_dk")) & (F.xxhash64("_text") == F.col("_dt"))
    return unparked(rows.join(drop.hint("shuffle_hash"), same, "left_anti"), docs.columns, **names)
