"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Rows are leaves.  Within a group, leaves in order of their key form a tree in
which every ``ARITY`` consecutive nodes become one, until one is left, the
group's subroot; the subroots, in order of the group, form one more tree, whose
last node is the root of the dataset.  A digest is the SHA-256 of its inputs'
text one after the other, child digests as lower-case hexadecimal.

*Storage.*  A tree is cut into aligned blocks of ``LEVELS`` levels, so a block
has at most ``ARITY ** (LEVELS - 1)`` leaves and is one row of the block table.
Inside a block the nodes lie in van Emde Boas order: the upper half of the
levels first, then the subtrees of the lower half one after the other, each laid
out the same way.  ``addresses`` finds a node by arithmetic alone, also in a
ragged last subtree, so nothing is padded.  Block roots are the leaves of the
next tier of blocks, until a tier has one block.

*Scale.*  Leaves are hashed in the scan; what is shuffled after that is a key
and one or two digests.  Positions come from a range partitioning over (group,
key, digest, row number) and the counts of each range, so a group with a third of
all rows is many ranges, and equal rows are split too.  One task holds one block
at a time.  Driver rounds follow the number of tiers, the logarithm of the rows
to the base of 4,096.  Every table between two rounds is written to the shared
folder.

Defined results: a null field counts as ``-`` and is told from every text; the
null group comes first; rows equal in group and key stand in order of their
digest, and rows equal in all three are alike; the one leaf of a group is its
subroot; a null key is never altered by ``altered_where``;
an empty table has no rows.  Only the named columns are read; no name of another
column can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.session import cut_lineage, forget

ARITY = 16
LEVELS = 4
BLOCK_LEAVES = ARITY ** (LEVELS - 1)
ROWS_PER_RANGE = 500_000
_HEX = 64


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its text,
    or ``-`` if null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# ---- layout of a block --------------------------------------------------------

def level_sizes(leaves: int, levels: int) -> list[int]:
    """Nodes on each level, leaves first."""
    return [-(-leaves // ARITY ** k) for k in range(levels)]


def levels_of(leaves: int) -> int:
    """Levels of a whole tree: up to the first level of one node."""
    n = 1
    while -(-leaves // ARITY ** (n - 1)) > 1:
        n += 1
    return n


def addresses(levels: int, leaves: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of ``level`` in a tree of ``levels`` levels
    over ``leaves`` leaves that is laid out in van Emde Boas order."""
    if levels == 1:
        return index
    lower = levels // 2
    upper_leaves = -(-leaves // ARITY ** lower)
    if level >= lower:
        return addresses(levels - lower, upper_leaves, level - lower, index)
    span, per_tree = ARITY ** (lower - 1), ARITY ** (lower - 1 - level)
    tree, inside = index // per_tree, index % per_tree
    before = sum(level_sizes(upper_leaves, levels - lower)) + tree * sum(level_sizes(span, lower))
    place = addresses(lower, span, level, inside)
    ragged = leaves % span
    if ragged:  # the last subtree has leaves of its own number
        last = tree == leaves // span
        place = np.where(last, addresses(lower, ragged, level, np.where(last, inside, 0)), place)
    return before + place


@lru_cache(maxsize=64)
def layout(leaves: int, levels: int) -> tuple[np.ndarray, ...]:
    """Addresses of all nodes, level by level."""
    return tuple(addresses(levels, leaves, k, np.arange(n)) for k, n in enumerate(level_sizes(leaves, levels)))


def stored(leaves: list[str], levels: int) -> tuple[bytes, str]:
    """A block's nodes in van Emde Boas order, and its root."""
    places = layout(len(leaves), levels)
    nodes = np.empty((sum(map(len, places)), _HEX // 2), np.uint8)
    row = leaves
    for k in range(levels):
        if k:
            row = [_digest("".join(row[i:i + ARITY])) for i in range(0, len(row), ARITY)]
        nodes[places[k]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(len(row), -1)
    return nodes.tobytes(), row[0]


class Block:
    """Sibling retrieval in a stored block, below a path to the dataset's root."""

    def __init__(self, nodes: bytes, leaves: int, levels: int, lefts: list[str], rights: list[str]):
        text, self.places, self.levels = nodes.hex(), layout(leaves, levels), levels
        #: hex text of every run of siblings, level by level
        self.runs = []
        for places in self.places[:-1]:
            row = [text[_HEX * a:_HEX * a + _HEX] for a in places.tolist()]
            self.runs.append(["".join(row[i:i + ARITY]) for i in range(0, len(row), ARITY)])
        self.leaves = [text[_HEX * a:_HEX * a + _HEX] for a in self.places[0].tolist()]
        self.above = list(zip(lefts, rights))
        self.inner: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def path(self, index: int, level: int = 0) -> list[tuple[str, str]]:
        """Siblings left and right of a node and its ancestors."""
        if level >= self.levels - 1:
            return self.above
        above = self.inner.get((level, index // ARITY))
        if above is None:
            above = self.inner[level, index // ARITY] = self.path(index // ARITY, level + 1)
        run, at = self.runs[level][index // ARITY], index % ARITY * _HEX
        return [(run[:at], run[at + _HEX:])] + above


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = _digest(left + leaf + right)
    return leaf


# ---- construction ---------------------------------------------------------------

def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) plus ``pos``, 0, 1, 2 … inside each group in the
    order given, and ``n``, the group's rows."""
    rows = cut_lineage(rows.withColumn("tie", F.monotonically_increasing_id()))
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_RANGE))
    by = ["grp", *order, "tie"]
    cut = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    schema = T.StructType([f for f in rows.schema if f.name != "tie"]
                          + [T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for batch in it:
            local = np.empty(batch.num_rows, np.int64)
            for i, group in enumerate(batch.column(batch.schema.get_field_index("grp")).to_pylist()):
                at, last = (at + 1, last) if group == last else (0, group)
                local[i] = at
            names = [c for c in batch.schema.names if c != "tie"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names]
                                             + [pa.array(local)], names=names + ["local"])

    listed = cut.withColumn("part", F.spark_partition_id())
    out = cut_lineage(listed.mapInArrow(number, schema))
    forget(rows)
    counts = out.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"),
                            F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"),
                            F.sum("c").over(Window.partitionBy("grp")).alias("n"))
    joined = out.join(offsets, out["grp"].eqNullSafe(offsets["g"]) & (out["part"] == offsets["p"]))
    return joined.withColumn("pos", F.col("before") + F.col("local")).drop("part", "local", "g", "p", "before")


def blocks_of(placed: DataFrame, carried: list[str]) -> DataFrame:
    """Block table of leaves (grp, pos, n, leaf): one row per block with its nodes
    and root, and the columns ``carried`` as arrays in leaf order."""
    rows = placed.select("grp", (F.col("pos") / BLOCK_LEAVES).cast("long").alias("block"),
                         (F.col("pos") % BLOCK_LEAVES).cast("int").alias("slot"), "n", "leaf", *carried)
    rows = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "slot")
    schema = T.StructType(
        [T.StructField("grp", rows.schema["grp"].dataType), T.StructField("block", T.LongType()),
         T.StructField("sole", T.BooleanType()), T.StructField("leaves", T.IntegerType()),
         T.StructField("levels", T.IntegerType()), T.StructField("nodes", T.BinaryType()),
         T.StructField("root", T.StringType())]
        + [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in carried])

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            leaves = whole.column("leaf").to_pylist()
            sole = whole.column("n")[0].as_py() <= BLOCK_LEAVES
            levels = levels_of(len(leaves)) if sole else LEVELS
            nodes, root = stored(leaves, levels)
            values = [whole.column("grp").slice(0, 1).combine_chunks(), whole.column("block").slice(0, 1).combine_chunks(),
                      pa.array([sole]), pa.array([len(leaves)], pa.int32()), pa.array([levels], pa.int32()),
                      pa.array([nodes], pa.binary()), pa.array([root], pa.string())]
            for c in carried:
                column = pa.concat_arrays(whole.column(c).chunks)
                values.append(pa.ListArray.from_arrays(pa.array([0, len(leaves)], pa.int32()), column))
            return pa.RecordBatch.from_arrays(values, names=schema.names)

        held, key = [], None
        for batch in it:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            start = 0
            for i, here in enumerate(keys):
                if here != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield made(held)
                    held, key, start = [], here, i
            if len(keys) > start:
                held.append(batch.slice(start))
        if held:
            yield made(held)

    return rows.mapInArrow(build, schema)


def tiers(placed: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Block tables from the leaves up, until every group has one block."""
    out = [cut_lineage(blocks_of(placed, carried))]
    while not (open_blocks := out[-1].where(~F.col("sole"))).isEmpty():
        roots = open_blocks.select("grp", F.col("block").alias("pos"), F.col("root").alias("leaf"))
        sizes = open_blocks.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("grp", "g")
        out.append(cut_lineage(blocks_of(roots.join(sizes, F.col("grp").eqNullSafe(F.col("g"))).drop("g"), [])))
    return out


@dataclass
class Manifest:
    """``groups``: block tables of the groups' trees, tier by tier; ``top``: of
    the tree over the subroots, whose blocks list their groups in ``key``."""

    groups: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """The dataset's root: one row, none if there are no rows."""
        return self.top[-1].select("root")

    def subroots(self) -> DataFrame:
        """(grp, subroot) of every group."""
        return subroots(self.groups)


def subroots(group_tiers: list[DataFrame]) -> DataFrame:
    out = None
    for tier in group_tiers:
        sole = tier.where("sole").select("grp", F.col("root").alias("subroot"))
        out = sole if out is None else out.unionByName(sole)
    return out


def build(leaves: DataFrame) -> Manifest:
    """Manifest of leaves (grp, key, leaf, altered)."""
    groups = tiers(numbered(leaves, ["key", "leaf"]), ["key", "altered"])
    over = subroots(groups).select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("leaf"))
    return Manifest(groups, tiers(numbered(over, ["key"]), ["key"]))


# ---- proofs ---------------------------------------------------------------------

_PATH = "lefts array<string>, rights array<string>"


def _child_paths(blocks: DataFrame, key_type: T.DataType | None) -> DataFrame:
    """Per leaf of the given blocks, which have the path above them: its path.
    Leaves are known by ``key`` if it has a type, else by group and position."""
    fields = ([T.StructField("grp", key_type), T.StructField("subroot", T.StringType())] if key_type is not None else
              [blocks.schema["grp"], T.StructField("block", T.LongType()), T.StructField("subroot", T.StringType())])
    schema = T.StructType(fields + [T.StructField("top", T.StringType())] + T._parse_datatype_string(_PATH).fields)
    columns = ["grp", "block", "leaves", "levels", "nodes", "lefts", "rights", "top"]
    columns.append("key" if key_type is not None else "subroot")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names) if c != "key"}
                block = Block(row["nodes"], row["leaves"], row["levels"], row["lefts"], row["rights"])
                for start in range(0, row["leaves"], 512):
                    stop = min(start + 512, row["leaves"])
                    paths = [block.path(k) for k in range(start, stop)]
                    n = stop - start
                    if key_type is not None:
                        keys = batch.column(batch.schema.get_field_index("key"))[i].values.slice(start, n)
                        own = [keys, pa.array(block.leaves[start:stop], pa.string())]
                    else:
                        grp = batch.column(0).slice(i, 1)
                        own = [pa.concat_arrays([grp] * n),
                               pa.array(range(row["block"] * BLOCK_LEAVES + start, row["block"] * BLOCK_LEAVES + stop),
                                        pa.int64()), pa.array([row["subroot"]] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays(
                        own + [pa.array([row["top"]] * n, pa.string()),
                               pa.array([[x for x, _ in p] for p in paths], pa.list_(pa.string())),
                               pa.array([[y for _, y in p] for p in paths], pa.list_(pa.string()))],
                        names=schema.names)

    return blocks.select(columns).mapInArrow(run, schema)


def _with_path(blocks: DataFrame, paths: DataFrame, on: list[str]) -> DataFrame:
    """``blocks`` joined with the paths above them."""
    named = paths.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in paths.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    where = same[0] if len(same) == 1 else same[0] & same[1]
    return blocks.join(named, where).drop(*[f"_{c}" for c in on])


def _group_paths(manifest: Manifest) -> DataFrame:
    """(grp, subroot, top, lefts, rights) of every group."""
    key_type = manifest.top[0].schema["key"].dataType.elementType
    none = F.array().cast("array<string>")
    above = None
    for level in range(len(manifest.top) - 1, -1, -1):
        blocks = manifest.top[level]
        if above is None:
            blocks = blocks.select("*", none.alias("lefts"), none.alias("rights"), F.col("root").alias("top"),
                                   F.lit(None).cast("string").alias("subroot"))
        else:
            blocks = _with_path(blocks, above, ["grp", "block"])
        above = _child_paths(blocks, None if level else key_type)
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, ``siblings`` (the proof: hex text of the
    siblings level by level up to the root), the root folded from the altered leaf,
    or the leaf itself if that is null, and whether it is the root."""
    of_group = cut_lineage(_group_paths(manifest))
    above = None
    for level in range(len(manifest.groups) - 1, -1, -1):
        blocks = manifest.groups[level]
        found = _with_path(blocks.where("sole"), of_group, ["grp"])
        if above is not None:
            found = found.unionByName(_with_path(blocks.where(~F.col("sole")), above, ["grp", "block"]))
        if level:
            above = _child_paths(found, None)
    key_type = found.schema["key"].dataType.elementType
    schema = T.StructType([T.StructField("key", key_type)] + [
        T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        + [T.StructField("verified", T.BooleanType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names) if c != "key"}
                block = Block(row["nodes"], row["leaves"], row["levels"], row["lefts"], row["rights"])
                shown, roots = [], []
                for k, (leaf, altered) in enumerate(zip(block.leaves, row["altered"])):
                    path = block.path(k)
                    shown.append(_digest("".join(x + y for x, y in path)))
                    roots.append(folded(leaf if altered is None else altered, path))
                n = len(roots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("key"))[i].values, pa.array(block.leaves, pa.string()),
                     pa.array([row["subroot"]] * n, pa.string()), pa.array([row["top"]] * n, pa.string()),
                     pa.array(shown, pa.string()), pa.array(roots, pa.string()),
                     pa.array([r == row["top"] for r in roots], pa.bool_())], names=schema.names)

    columns = ["key", "altered", "leaves", "levels", "nodes", "lefts", "rights", "subroot", "top"]
    return found.select(columns).mapInArrow(run, schema)


def altered_where(key: Column) -> Column:
    """Which rows the tamper test alters: 5 divides the checksum of the key's text."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaves_of(docs: DataFrame, fields: list[str], group_col: str = "source", key_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(grp, key, leaf, altered) of ``docs``; ``altered`` is the digest with the
    text's A-Z in lower case where ``altered_where`` holds, else null."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    changed = leaf_digest([low if c == text_col else F.col(c) for c in fields])
    return docs.select(F.col(group_col).alias("grp"), F.col(key_col).alias("key"),
                       leaf_digest([F.col(c) for c in fields]).alias("leaf"),
                       F.when(altered_where(F.col(key_col)), changed).alias("altered"))
