import zlib
from collections import Counter

import regex
from pyspark.sql import functions as F

from storyloom.llm import rank_language as rl


def words(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def gram_counts(bag):
    out = Counter()
    for w, n in bag.items():
        p = f" {w} "
        for size in (1, 2, 3):
            for k in range(len(p) - size + 1):
                if p[k:k + size] != " ":
                    out[p[k:k + size]] += n
    return out


def brute(rows):
    bags = {}
    for key, text, lang in rows:
        if lang is not None and text is not None and not is_held(key):
            bags.setdefault(lang, Counter()).update(words(text))
    learned = {}
    for lang, bag in bags.items():
        top = sorted(gram_counts(bag).items(), key=lambda x: (-x[1], x[0].encode()))[:rl.PROFILE_SIZE]
        if top:
            learned[lang] = {g: i for i, (g, _) in enumerate(top)}
    out = []
    for key, text, _ in rows:
        c = gram_counts(Counter(words(text)))
        if not c or not learned:
            out.append((key, is_held(key), "und", 0.0))
            continue
        ranks = {g: sum(1 for v in c.values() if v > n) for g, n in c.items()} if len(c) < 3000 else None
        if ranks is None:
            ordered = sorted(c.values(), reverse=True)
            place = {}
            for i, v in enumerate(ordered):
                place.setdefault(v, i)
            ranks = {g: place[n] for g, n in c.items()}
        own = {g: r for g, r in ranks.items() if r < rl.PROFILE_SIZE}
        away = {lang: sum(abs(p[g] - r) if g in p else rl.PROFILE_SIZE for g, r in own.items())
                for lang, p in learned.items()}
        best = min(sorted(away), key=away.get)
        out.append((key, is_held(key), best, round(1 - away[best] / (rl.PROFILE_SIZE * len(own)), 9)))
    return sorted(out, key=str)


def is_held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


def test_brute_force(documents, odd):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
        got = rl.identify(df).select("doc_id", "held_out", "lang_pred", "score").collect()
        want = brute(rows)
        assert sorted(tuple(r[:3]) for r in map(tuple, got) if r[0] is not None) == sorted(
            r[:3] for r in want if r[0] is not None)
        assert all(abs(a - b) < 1e-8 for a, b in zip(sorted(r.score for r in got), sorted(r[3] for r in want)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rl.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    assert len(got) > 200 and right > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_and_unlabelled(none, odd):
    assert rl.identify(none).count() == 0
    got = rl.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} == {"und"}


def test_key_label_and_source_are_no_inputs(documents):
    learned = rl.collected(rl.profiles(documents))
    a = rl.predictions(documents.select("doc_id", "text"), learned)
    b = rl.predictions(documents.select((F.col("doc_id") + 7).alias("doc_id"), "text"), learned)
    assert Counter((r.lang_pred, r.score) for r in a.collect()) == Counter((r.lang_pred, r.score) for r in b.collect())
