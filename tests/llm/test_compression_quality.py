import math
import random
import re
from dataclasses import replace

import pytest
import zstandard

from storyloom.llm.compression_quality import SIZES, WIDE, Band, QualityRules, filter_quality, fit_bands, judge, with_quality

RULES = QualityRules()
SPACE = "\x20\x09-\x0D"


def squeezed(b):
    return len(zstandard.ZstdCompressor(level=3).compress(b))


def brute_bands(texts):
    """Bands by sorting the ratios of all different texts and chunks."""
    inputs = set()
    for text in texts:
        raw = (text or "").encode()
        inputs |= {raw} | {raw[k:k + 4096] for k in range(0, len(raw), 4096)}
    bands, least = [], 0
    for size in SIZES:
        ratios = sorted(1000 * squeezed(b) // len(b) for b in inputs if max(least, 64) < len(b) <= size)
        least, n = size, len(ratios)
        wide = next(w for w in WIDE if size <= w.max_bytes)
        low, high = wide.low, wide.high
        if n >= 50:
            q1, q2, q3 = ((ratios[math.ceil(q * n) - 1] + 0.5) / 1000 for q in (0.25, 0.5, 0.75))
            low, high = q2 - 8 * max(q2 - q1, q2 / 100), q2 + 8 * max(q3 - q2, q2 / 100)
        bands.append(Band(size, low, high))
    return bands


def brute(text, bands):
    text = text or ""
    words = re.findall(rf"[^{SPACE}]+", text)
    lines = [x for x in text.split("\n") if re.search(rf"[^{SPACE}]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 5))
    n = len(words)
    failed = n < 10 or 100 * len(hit) > 20 * n
    raw = text.encode()

    def out(b):
        band = next(x for x in bands if len(b) <= x.max_bytes)
        return not band.low <= squeezed(b) / len(b) <= band.high
    parts = [raw[k:k + 4096] for k in range(0, len(raw), 4096)]
    kept = bool(raw) and not failed and not out(raw) and sum(map(out, parts)) <= len(parts) / 4
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            failed, kept)


def check(df):
    got = with_quality(df).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                  "base_failed", "kept").collect()
    assert len(got) == df.count()
    bands = brute_bands([r.text for r in got])
    fit = fit_bands(df)
    assert [b.max_bytes for b in fit] == list(SIZES)
    for one, want in zip(fit, bands):
        assert one.low == pytest.approx(want.low) and one.high == pytest.approx(want.high)
    for r in got:
        if len(r.text or "") < 20_000:
            assert tuple(r[1:]) == brute(r.text, bands), r.text
    return got


def test_brute_force(documents):
    got = check(documents)
    assert {r.kept for r in got} == {True, False}


def test_odd_rows(odd, none):
    check(odd)
    assert with_quality(odd).count() == odd.count()
    out = with_quality(odd)
    assert dict(out.dtypes)["n_words"] == "bigint" and "_t" in out.columns
    assert with_quality(none).count() == 0


def test_filter_keeps_columns(odd, none, documents):
    assert filter_quality(odd).columns == odd.columns and filter_quality(none).columns == odd.columns
    kept = filter_quality(odd).collect()
    assert {r.n_words for r in kept} <= {"clash"}
    assert filter_quality(documents).count() == with_quality(documents).where("kept").count()


def one(spark, text):
    return with_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_repeats_go(spark):
    r = one(spark, "spam and eggs are great " * 400)
    assert not r.kept and r.ratio < 0.1


def noise(size, seed=3):
    import base64
    text = base64.b85encode(random.Random(seed).randbytes(size * 4 // 5)).decode()
    return " ".join(text[k:k + 9] for k in range(0, len(text), 9))


def hex_words(size):
    digits = random.Random(size).randbytes(size // 2).hex()
    return " ".join(digits[k:k + 40] for k in range(0, size, 40))


def test_incompressible_chunk(spark):
    r = one(spark, noise(15_000))
    assert not r.base_failed and not r.kept and r.n_bad_chunks > 0


def verdicts(texts, bands):
    columns = judge([t.encode() for t in texts], replace(RULES, bands=tuple(bands)))
    return list(zip(columns[5], columns[9]))


@pytest.fixture(scope="module")
def table():
    import pyarrow.parquet as pq
    folder = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    texts = {r["doc_id"]: r["text"]
             for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    return label, texts, brute_bands(texts.values())


def test_clean_documents_stay_and_laced_ones_go(table):
    label, texts, bands = table
    ids = [d for d in label if texts.get(d)]
    seen = {v: [k for (failed, k), d in zip(verdicts([texts[d] for d in ids], bands), ids) if label[d] == v and not failed]
            for v in (0, 1)}
    assert all(seen[1]) and len(seen[1]) > 300
    assert sum(not k for k in seen[0]) > len(seen[0]) / 4


@pytest.mark.parametrize("size", [3500, 6000, 10_000, 40_000])
def test_hex_words_go(table, size):
    [(failed, kept)] = verdicts([hex_words(size)], table[2])
    assert not failed and not kept


def test_ordinary_prose_stays(spark):
    """English of another origin than the tables, in a table of its own."""
    from pydoc_data.topics import topics
    texts = sorted(topics.values()) + [noise(9_000), hex_words(9_000), "one more of these same lines\n" * 300]
    rows = with_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    prose = [r.kept for r in rows if r.doc_id < len(topics) and not r.base_failed]
    assert len(prose) > 60 and all(prose)
    assert not any(r.kept for r in rows if r.doc_id >= len(topics))


def test_copies_and_junk_do_not_move_the_fit(spark, table):
    """A text with many copies counts once, and a third of junk moves no limit far."""
    texts = [t for t in table[1].values() if t and 1024 < len(t.encode()) <= 1536]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    at = SIZES.index(1536)
    base = fit_bands(frame(texts))[at]
    assert fit_bands(frame(texts + texts[:1] * 3000).repartition(7))[at] == base
    junk = [noise(1300, k) for k in range(len(texts) // 3)]
    assert fit_bands(frame(texts + junk))[at].low > 0.2
