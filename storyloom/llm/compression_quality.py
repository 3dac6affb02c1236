"""Quality rules from compression: zstandard ratios in bands of length.

A document's ratio is its zstandard size over its UTF-8 size.  Text that
repeats itself compresses far below ordinary prose, random or encoded text far
above; both limits depend on length because a short input cannot compress
well.  The whole document and every fixed chunk of it are measured, each
against the band of its own size, and a document goes when the whole falls
outside its band or when more than ``max_bad_chunks`` of its chunks do.

The bands are fitted on the table at hand unless the caller names them: in each
class of length the median and the quartiles of the ratios of all different
texts and chunks, and limits ``spread`` quartile distances to either side.  No
label is read.  Up to half of a class may be junk before its median moves, and
a text with thousands of copies counts once.  A class with fewer than
``min_fit`` different inputs takes the wide limits of ordinary prose.  The fit
is one job over all rows: ratios leave the tasks as whole numbers of
thousandths, so a histogram of some 20,000 cells at most is all that reaches
the driver, and its result does not depend on partitions or retries.

The base counts (words, symbols, repeated lines and windows) come from the
second pass, a function of one row: no shuffle, no state, and a lost executor
costs its tasks only.

Defined results: a null or empty text has no words, all counts 0, ratios null,
and fails the base rule (fewer than ``min_words`` words); it takes no part in
the fit.  A table without rows fits the wide limits.  Repeated rows are judged
alike.  Input columns stay; a clash with an output column is resolved
in favour of the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from storyloom.llm import batches
from storyloom.llm.rows import parked, unparked

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Allowed zstandard ratios for inputs of up to ``max_bytes`` bytes."""

    max_bytes: float
    low: float
    high: float


#: Greatest sizes of the classes of length, in bytes.
SIZES = (64, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384, 32768, 65536,
         131072, float("inf"))

#: Limits that hold without a fit.  Licence texts and help pages in English lie
#: between 0.25 and 0.74 and fall with length; templates and repeated text lie
#: below 0.2, base 64 above 0.74, long hex above 0.51.  Below 64 bytes the
#: frame's own bytes outweigh the text, so no limit holds.
WIDE = (
    Band(64, 0.0, float("inf")),
    Band(256, 0.40, 1.30),
    Band(1024, 0.30, 0.95),
    Band(4096, 0.25, 0.70),
    Band(12288, 0.22, 0.52),
    Band(float("inf"), 0.18, 0.50),
)


@dataclass(frozen=True)
class QualityRules:
    """Parameters.  ``chunk_bytes`` is the fixed chunk; the last chunk of a
    document may be shorter and is judged by the band of its size.  ``bands``
    of None are fitted; a quartile distance counts as ``least_spread`` of the
    median at least, so a class of like texts keeps some room."""

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    level: int = 3
    chunk_bytes: int = 4096
    max_bad_chunks: float = 0.25
    bands: tuple[Band, ...] | None = None
    spread: float = 8.0
    least_spread: float = 0.01
    min_fit: int = 50


COUNTS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("n_bad_chunks", T.LongType()),
    T.StructField("kept", T.BooleanType()),
])


def band_of(size: float, bands: tuple[Band, ...]) -> Band:
    """The band for inputs of ``size`` bytes."""
    return next(b for b in bands if size <= b.max_bytes)


def outside(size: int, compressed: int, bands: tuple[Band, ...]) -> bool:
    """Whether a ratio leaves the band of its input's size."""
    band = band_of(size, bands)
    return not band.low <= compressed / size <= band.high


def pieces(raw: bytes, chunk_bytes: int) -> list[bytes]:
    """The fixed chunks of a text."""
    return [raw[k:k + chunk_bytes] for k in range(0, len(raw), chunk_bytes)]


def measured(docs: DataFrame, text_col: str, rules: QualityRules) -> DataFrame:
    """``(size_class, ratio, mark)`` of every text and chunk that a limit can
    hold for: class of length, ratio in thousandths, hash of the bytes."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=rules.level).compress
        for batch in it:
            for _, texts in batches.chunks(batch, text_col):
                sizes, ratios, marks = [], [], []
                for raw in texts:
                    parts = pieces(raw or b"", rules.chunk_bytes)
                    for part in [raw, *parts] if len(parts) > 1 else parts:
                        if len(part) > SIZES[0]:
                            sizes.append(len(part))
                            ratios.append(1000 * len(squeeze(part)) // len(part))
                            marks.append(xxhash.xxh3_64_intdigest(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(SIZES, np.array(sizes, np.float64)).astype(np.int32)),
                     pa.array(ratios, pa.int32()), pa.array(np.array(marks, np.uint64).view(np.int64))],
                    names=["size_class", "ratio", "mark"])

    return docs.select(text_col).mapInArrow(run, "size_class int, ratio int, mark long")


def fit_bands(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> tuple[Band, ...]:
    """Bands of all classes of length, from all rows of ``docs``."""
    cells = measured(docs, text_col, rules).distinct().groupBy("size_class", "ratio").count().collect()
    bands = []
    for at, size in enumerate(SIZES):
        wide = band_of(size, WIDE)
        own = sorted((c["ratio"], c["count"]) for c in cells if c["size_class"] == at)
        upto = np.cumsum([n for _, n in own])
        if not own or upto[-1] < rules.min_fit:
            bands.append(Band(size, wide.low, wide.high))
            continue
        low, mid, high = ((own[np.searchsorted(upto, q * upto[-1])][0] + 0.5) / 1000 for q in (0.25, 0.5, 0.75))
        least = rules.least_spread * mid
        bands.append(Band(size, mid - rules.spread * max(mid - low, least), mid + rules.spread * max(high - mid, least)))
    return tuple(bands)


def fitted(docs: DataFrame, text_col: str, rules: QualityRules) -> QualityRules:
    """``rules`` with bands, fitted on ``docs`` where the caller gives none."""
    return rules if rules.bands is not None else replace(rules, bands=fit_bands(docs, text_col, rules))


def repeat_words(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Per document: words under ``width``-word windows that occur twice or more
    in that document.  Equal hashes are confirmed word by word."""
    keep = np.flatnonzero(batches.inside(offsets, width))
    doc = batches.owner(offsets)
    h = batches.mix64(batches.window_hashes(values, width)[keep] + doc[keep].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    first, second = keep[order[:-1]], keep[order[1:]]
    same = h[order[:-1]] == h[order[1:]]
    first, second = first[same], second[same]
    equal = doc[first] == doc[second]
    for k in range(width):
        equal &= values[first + k] == values[second + k]
    starts = np.unique(np.concatenate((first[equal], second[equal])))
    return batches.per_document(batches.covered(starts, width, len(values)), offsets)


def judge(texts: list[bytes | None], rules: QualityRules) -> list[np.ndarray | list]:
    """The columns of ``COUNTS`` for a chunk of documents; ``rules`` have bands."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=rules.level).compress
    docs = [t or b"" for t in texts]
    words = [t.split() for t in docs]
    values, offsets = batches.flatten(words, batches.Ids().__getitem__)
    n_words = np.diff(offsets)
    repeats = repeat_words(values, offsets, rules.window)
    failed = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
    chars, symbols, dup_lines, ratio, n_chunks, n_bad, kept = [], [], [], [], [], [], []
    for i, raw in enumerate(docs):
        blanks = len(raw) - len(raw.translate(None, _SPACE))
        chars.append(len(raw.decode()) - blanks)
        symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
        lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
        whole = len(squeeze(raw)) if raw else 0
        parts = pieces(raw, rules.chunk_bytes)
        if len(parts) > 1:
            bad = sum(outside(len(p), len(squeeze(p)), rules.bands) for p in parts)
        else:
            bad = int(bool(raw) and outside(len(raw), whole, rules.bands))
        ratio.append(whole / len(raw) if raw else None)
        n_chunks.append(len(parts))
        n_bad.append(bad)
        kept.append(bool(raw) and not failed[i] and not outside(len(raw), whole, rules.bands)
                    and bad <= rules.max_bad_chunks * len(parts))
    return [n_words, chars, symbols, dup_lines, repeats, failed, ratio, n_chunks, n_bad, kept]


def with_quality(docs: DataFrame, text_col: str = "text",
                 rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` added to every row."""
    rules = fitted(docs, text_col, rules)
    names = [f.name for f in COUNTS]
    base = docs.select([c for c in docs.columns if c not in names or c == text_col])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in it:
            for part, texts in batches.chunks(batch, text_col):
                added = [pa.array(c, t) for c, t in zip(judge(texts, rules), types)]
                yield pa.RecordBatch.from_arrays(
                    list(part.columns) + added, names=list(part.schema.names) + names)

    schema = T.StructType(list(base.schema.fields) + list(COUNTS.fields))
    return base.mapInArrow(run, schema)


def filter_quality(docs: DataFrame, text_col: str = "text",
                   rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    names = {"_text": text_col}
    kept = with_quality(parked(docs, **names), "_text", rules).where("kept")
    return unparked(kept, docs.columns, **names)
