import hashlib
import re

from pyspark.sql import functions as F

from storyloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=str)


def spark_rows(docs, bench, **kw):
    found = d.with_hits(docs, bench, **kw)
    return sorted(map(tuple, found.select(
        "doc_id", "n_words", d.n_hit(), F.size("hit_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256)).collect()), key=str)


def pairs(df, key):
    return [(r[key], r.text) for r in df.select(key, "text").collect()]


def test_brute_force(documents, benchmark):
    want = brute(pairs(documents, "doc_id"), pairs(benchmark, "item_id"))
    assert spark_rows(documents, benchmark) == want
    assert any(r[2] for r in want)


def test_sliced_benchmark(documents, benchmark):
    want = brute(pairs(documents, "doc_id"), pairs(benchmark, "item_id"))
    assert spark_rows(documents, benchmark, max_index_words=400) == want


def test_odd_rows(spark, odd, none):
    items = [(1, "Quick BROWN fox"), (1, "Quick BROWN fox"), (2, None), (3, ""), (4, "..."), (None, "one"),
             (5, "the lazy dog near the quiet river bank später kam der regen und die")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if k is None else k, t) for k, t in items]
    assert spark_rows(odd, bench) == brute(pairs(odd, "doc_id"), named)
    assert d.with_hits(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert d.with_hits(odd, empty).where(F.size("hit_items") > 0).count() == 0
    cleaned = d.decontaminated(odd, bench)
    assert cleaned.columns == odd.columns
    assert d.with_hits(cleaned, bench).where(F.size("hit_items") > 0).count() == 0
    assert d.decontaminated(none, bench).count() == 0


def test_removal(spark, documents, benchmark):
    items = benchmark.limit(3).collect()
    own = "These words belong to the document and to nothing else at all, so they stay where they are. " * 3
    passage = items[0].text
    rows = [(1, own + passage + " " + own), (2, passage), (3, own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in d.decontaminated(docs, benchmark).collect()}
    assert set(got) == {1, 3} and got[3] == own
    assert passage not in got[1] and words(got[1])[:5] == words(own)[:5]
    assert len(words(got[1])) == 2 * len(words(own))


def test_cut_that_brings_words_together(spark):
    item = "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = " ".join(f"k{i}" for i in range(40)) + " a1 a2 a3 a4 a5 " + item + " a6 a7 a8 a9 a10 end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = d.decontaminated(docs, bench).collect()
    assert [words(r.text)[-1] for r in got] == ["end"] and "a1" not in words(got[0].text)
