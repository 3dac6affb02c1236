"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is a language's most frequent character n-grams in order of rank;
a document is given the language whose profile has the smallest out-of-place
distance to the document's own profile: the sum over the document's n-grams of
the difference in rank, or the profile's length where the n-gram is missing.

N-grams of 1 to 3 characters come from lower-cased words between blanks.  An
n-gram is one integer of three 21-bit code points, first character highest, so
a text's n-grams are array shifts, their counts one sort, and their order as
integers the order of the characters.

Training reads every labelled row: tasks sum (language, n-gram) counts before
the shuffle, and only the ``profile_size`` best n-grams of each language reach
the driver.  That is bounded by languages x ``profile_size``; more than
``MAX_LANGUAGES`` labels are refused.

N-grams of a document with equal counts share the better rank, so no order of
characters decides.  Equal distances go to the alphabetically first language.

Defined results: ``und`` with score 0 for a null text, a text without letters,
or when nothing was learned; rows with a null label or null text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm import batches

PROFILE_SIZE = 400
MAX_LANGUAGES = 1000
#: Distinct n-grams that a task holds before it hands its counts on.
HELD_GRAMS = 2_000_000
_BLANK = 32
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_stream(text: str) -> np.ndarray:
    """Code points of the lower-cased words, one blank around each."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    codes = np.where(_letters()[codes], codes, _BLANK)
    codes = np.concatenate(([_BLANK], codes, [_BLANK])).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
    return codes[keep]


def grams(stream: np.ndarray) -> np.ndarray:
    """All n-grams of a letter stream; none runs over a blank inside."""
    one = stream[stream != _BLANK]
    two = stream[:-1] << _BITS | stream[1:]
    three = (stream[:-2] << 2 * _BITS | two[1:])[stream[1:-1] != _BLANK]
    return np.concatenate((one << 2 * _BITS, two << _BITS, three))


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often (or with what weight) they occur."""
    if weights is None:
        values = np.sort(values)
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        return values[first], np.diff(np.append(first, len(values)))
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(weights, first)


def spelled(gram: int) -> str:
    """The characters of an n-gram."""
    codes = (gram >> 2 * _BITS, gram >> _BITS & (1 << _BITS) - 1, gram & (1 << _BITS) - 1)
    return "".join(chr(c) for c in codes if c)


def packed(gram: str) -> int:
    """The integer of an n-gram."""
    codes = [ord(c) for c in gram] + [0] * (3 - len(gram))
    return codes[0] << 2 * _BITS | codes[1] << _BITS | codes[2]


def gram_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(language, n-gram, count) over all rows, summed in the tasks first."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def emit():
            for lang, (values, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()),
                     pa.array([spelled(g) for g in values.tolist()], pa.string()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"])

        for batch in it:
            for part, texts in batches.chunks(batch, "text"):
                streams: dict[str, list[np.ndarray]] = {}
                for lang, raw in zip(part.column(0).to_pylist(), texts):
                    stream = letter_stream(raw.decode())
                    if len(stream) > 1:
                        streams.setdefault(lang, []).append(grams(stream))
                for lang, found in streams.items():
                    values, n = counted(np.concatenate(found))
                    if lang in held:
                        values, n = counted(np.concatenate((held[lang][0], values)),
                                            np.concatenate((held[lang][1], n)))
                    held[lang] = values, n
                if sum(len(v) for v, _ in held.values()) > HELD_GRAMS:
                    yield from emit()
                    held = {}
        yield from emit()

    counts = rows.mapInArrow(run, "lang string, gram string, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
             profile_size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank): the ``profile_size`` most frequent n-grams of each
    language, ranked from 0; equal counts in order of the n-gram."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (gram_counts(labelled, text_col, lang_col)
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= profile_size)
            .select("lang", "gram", (F.col("rank") - 1).alias("rank")))


def collected(profile_rows: DataFrame) -> dict[str, dict[str, int]]:
    """Profiles on the driver: at most languages x profile size small rows; a
    table of more than ``MAX_LANGUAGES`` profiles is refused, not cut."""
    rows = profile_rows.limit(MAX_LANGUAGES * PROFILE_SIZE + 1).collect()
    if len(rows) > MAX_LANGUAGES * PROFILE_SIZE:
        raise ValueError(f"more than {MAX_LANGUAGES} profiles of {PROFILE_SIZE} n-grams")
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        out.setdefault(r.lang, {})[r.gram] = r.rank
    return out


class Ranker:
    """Out-of-place distances of documents to fixed profiles."""

    def __init__(self, learned: dict[str, dict[str, int]], profile_size: int = PROFILE_SIZE):
        self.langs, self.size = sorted(learned), profile_size
        self.known = np.array(sorted({packed(g) for p in learned.values() for g in p}), np.int64)
        #: rank of each known n-gram in each profile, or the penalty; the last
        #: column stands for every other n-gram
        self.ranks = np.full((len(self.langs), len(self.known) + 1), profile_size, np.int64)
        for row, lang in enumerate(self.langs):
            for g, rank in learned[lang].items():
                self.ranks[row, np.searchsorted(self.known, packed(g))] = rank

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        stream = letter_stream(raw.decode()) if raw else ()
        if len(stream) < 2 or not self.langs:
            return "und", 0.0
        found, n = counted(grams(stream))
        ordered = np.sort(n)
        rank = len(n) - np.searchsorted(ordered, n, "right")  # n-grams strictly more frequent
        own = rank < self.size
        found, rank = found[own], rank[own]
        at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        profile = self.ranks[:, np.where(self.known[at] == found, at, len(self.known))]
        away = np.where(profile >= self.size, self.size, np.abs(profile - rank)).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(found)))


def predictions(docs: DataFrame, learned: dict[str, dict[str, int]], text_col: str = "text",
                profile_size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; the text is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(shared.value, profile_size)
        for batch in it:
            got = [ranker.predict(t) for _, texts in batches.chunks(batch, text_col) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept]
                + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=kept + ["lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in kept]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(key_col: str = "doc_id"):
    """Column: rows that must not teach (remainder 2 of the key's checksum)."""
    return F.pmod(F.crc32(F.col(key_col).cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    rows = docs.withColumn("held_out", F.coalesce(held_out(key_col), F.lit(False)))
    learned = collected(profiles(rows.where(~F.col("held_out")), text_col, lang_col))
    return predictions(rows.select(key_col, "held_out", text_col), learned, text_col)
