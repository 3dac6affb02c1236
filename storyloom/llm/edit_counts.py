"""Token counts that follow edits.

Each document keeps a segment tree over runs of its pre-tokens: a leaf holds
the characters and tokens of a run, an inner node the sums of its two
children.  An edit descends to the leaves it touches, takes in the context
that the splitting pattern can look at on the left, and splits and encodes
from there until a new boundary falls on an old leaf boundary; the sums on the
way from the changed leaves to the root are then updated.  Text outside that
region is never encoded again.

The tree is three plain array columns beside the text, so it can be written as
Parquet and edited again in a later job.  Edits of a document apply in order;
each gives positions in the text as it stands then, in code points.  Positions
beyond the text are moved to its end.

Defined results: a null text counts as empty; null or no edits leave a document
as it is; a null replacement deletes; repeated rows are separate documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm import batches
from storyloom.llm.byte_bpe import LOOKAHEAD, ByteBpe, coder, read_rank_file

RUN = 32
#: Entries of either memory of pre-tokens in a task process.
COUNTED_PIECES = 250_000
TREE = T.StructType([
    T.StructField("leaf_chars", T.ArrayType(T.LongType())),
    T.StructField("token_sums", T.ArrayType(T.LongType())),
    T.StructField("n_tokens", T.LongType()),
])
EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"
WORK = T.StructType([
    T.StructField("n_edits", T.LongType()),
    T.StructField("n_reencoded_chars", T.LongType()),
])


class CountTree:
    """Segment tree of one document.  Leaf ``i`` sits at ``size + i``; a leaf
    may become empty or hold more than one run after edits."""

    def __init__(self, text: str, leaf_chars: list[int], sums: list[int]):
        self.text, self.leaf_chars, self.sums = text, leaf_chars, sums

    @property
    def size(self) -> int:
        return len(self.sums) // 2

    @classmethod
    def build(cls, text: str, bpe: ByteBpe, run: int = RUN) -> "CountTree":
        chars, tokens = runs(bpe.pieces(text), bpe, run)
        return cls(text, chars, [0] * len(tokens) + tokens).resum()

    def resum(self) -> "CountTree":
        """All inner sums from the leaves."""
        for node in range(self.size - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
        return self

    @property
    def total(self) -> int:
        return self.sums[1] if self.size > 1 else (self.sums[1] if self.sums else 0)

    def set_leaf(self, i: int, chars: int, tokens: int) -> None:
        """New counts of a leaf and of every subtree that holds it."""
        self.leaf_chars[i] = chars
        node = self.size + i
        change = tokens - self.sums[node]
        while node and change:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, replacement: str, bpe: ByteBpe, run: int = RUN) -> int:
        """Apply one edit; returns the number of characters encoded again."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        ends = np.cumsum(self.leaf_chars) if self.leaf_chars else np.zeros(0, np.int64)
        shift = len(replacement) - (end - start)
        new = self.text[:start] + replacement + self.text[end:]
        # first leaf whose start leaves room for what the pattern may look at
        first = int(np.searchsorted(ends, start - LOOKAHEAD, "right")) if start > LOOKAHEAD else 0
        first = min(first, max(0, len(ends) - 1))
        begin = int(ends[first - 1]) if first else 0
        last = min(int(np.searchsorted(ends, end, "right")), max(0, len(ends) - 1))
        while True:
            stop = int(ends[last]) if len(ends) else 0
            at_end = last >= len(ends) - 1
            stop_new = len(new) if at_end else stop + shift
            ahead = new[begin:min(len(new), stop_new + LOOKAHEAD)]
            pieces, at, region = bpe.split(ahead), 0, []
            for piece in pieces:
                if at == stop_new - begin:
                    break
                region.append(piece)
                at += len(piece)
            if at_end or at == stop_new - begin:
                break
            last += 1
        self.text = new
        chars, tokens = runs(region, bpe, run)
        room = last - first + 1
        if not self.leaf_chars or len(chars) > 4 * room:
            leaves = self.sums[self.size:]
            self.leaf_chars[first:last + 1] = chars
            leaves[first:last + 1] = tokens
            self.sums = [0] * len(leaves) + leaves
            self.resum()
        else:
            for k in range(room):
                share = slice(k * len(chars) // room, (k + 1) * len(chars) // room)
                self.set_leaf(first + k, sum(chars[share]), sum(tokens[share]))
        return len(ahead)


class PieceCounts(dict):
    """Pre-token -> number of its tokens, counted at first sight.  A full memory
    becomes the older one, from which pieces seen again come back."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> int:
        if len(self) >= COUNTED_PIECES:
            self.older = dict(self)
            self.clear()
        n = self.older.get(piece)
        if n is None:
            data = piece.encode()
            n = 1 if data in self.bpe.ranks else len(self.bpe.tokens(data))
        self[piece] = n
        return n


@lru_cache(maxsize=2)
def counts_of(bpe: ByteBpe) -> PieceCounts:
    """One memory per coder of a task process."""
    return PieceCounts(bpe)


def runs(pieces: list[str], bpe: ByteBpe, run: int) -> tuple[list[int], list[int]]:
    """Characters and tokens of every ``run`` pre-tokens."""
    chars = list(map(len, pieces))
    tokens = list(map(counts_of(bpe).__getitem__, pieces))
    starts = range(0, len(pieces), run)
    return [sum(chars[k:k + run]) for k in starts], [sum(tokens[k:k + run]) for k in starts]


def _run(docs: DataFrame, rank_path: str, pattern: str, text_col: str, names: list[str],
         fields: list[T.StructField], types: list[pa.DataType], work) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_rank_file(rank_path))
    kept = [c for c in docs.columns if c not in names]

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(shared.value, pattern)
        for batch in it:
            for part, texts in batches.chunks(batch, text_col):
                made = zip(*[work(bpe, t.decode() if t else "", i, part) for i, t in enumerate(texts)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept]
                    + [pa.array(list(m), t) for m, t in zip(made, types)], names=kept + names)

    return docs.mapInArrow(go, T.StructType([docs.schema[c] for c in kept] + fields))


_LONGS = pa.list_(pa.int64())


def with_trees(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``TREE``: the state that edits work on."""
    def work(bpe, text, i, part):
        tree = CountTree.build(text, bpe)
        return tree.leaf_chars, tree.sums, tree.total

    return _run(docs, rank_path, pattern, text_col, TREE.names, TREE.fields, [_LONGS, _LONGS, pa.int64()], work)


def apply_edits(trees: DataFrame, rank_path: str, pattern: str, edits_col: str = "edits",
                text_col: str = "text") -> DataFrame:
    """``trees`` with every row's edits applied to text, tree and count; adds
    the columns of ``WORK`` and drops the edits."""
    def work(bpe, text, i, part):
        get = lambda c: part.column(part.schema.get_field_index(c))[i].as_py()
        tree = CountTree(text, list(get("leaf_chars")), list(get("token_sums")))
        edits = get(edits_col) or []
        again = sum(tree.edit(e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0,
                              e["replacement"] or "", bpe) for e in edits)
        return tree.text, tree.leaf_chars, tree.sums, tree.total, len(edits), again

    fields = [trees.schema[text_col], *TREE.fields, *WORK.fields]
    out = _run(trees, rank_path, pattern, text_col, [f.name for f in fields], fields,
               [pa.string(), _LONGS, _LONGS, pa.int64(), pa.int64(), pa.int64()], work)
    return out.drop(edits_col)


def join_edits(trees: DataFrame, edits: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``trees`` with an ``edits`` column from a table (key, seq, start, end,
    replacement); a document's own edits are one small list, in order of seq."""
    per_doc = (edits.groupBy(key_col)
               .agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("edits"))
               .withColumn("edits", F.transform("edits", lambda e: F.struct(
                   e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"),
                   e["replacement"].alias("replacement")))))
    return trees.join(per_doc, key_col, "left")


def revision_edits(key_col: str = "doc_id", text_col: str = "text") -> Column:
    """Edits derived from the row itself: a cut in the first quarter, a note in
    the middle, an upper-cased stretch in the third quarter, a line at the end."""
    n = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    at = lambda part: F.floor(n * part / 4).cast("long")
    note = F.concat(F.lit(" [rev "), F.coalesce(F.col(key_col).cast("string"), F.lit("-")), F.lit("] "))
    stretch = F.coalesce(F.upper(F.substring(F.col(text_col), (at(3) + 1).cast("int"), F.lit(12))), F.lit(""))
    edit = lambda a, b, r: F.struct(a.alias("start"), b.alias("end"), r.alias("replacement"))
    # last first, so that the positions of the earlier ones still hold
    return F.array(edit(n, n, F.lit("\nEnd.")), edit(at(3), at(3) + 12, stretch),
                   edit(at(2), at(2), note), edit(at(1), at(1) + 7, F.lit(""))).cast(EDITS)
