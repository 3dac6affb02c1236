import math
import zlib

import numpy as np
import pytest

from storyloom.llm import quadratic_quality as qq

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def direct_scores(docs, labels):
    """By the covariance, its determinant and its inverse, from all rows at once."""
    x = {k: np.array(qq.statistics((t or "").encode())) for k, t in docs}
    rows = [(x[k], y) for k, y in labels if k in x and zlib.crc32(str(k).encode()) % 5]
    z, y = np.array([r for r, _ in rows]), np.array([c for _, c in rows])
    scale, center = z.std(axis=0) + 1e-3, z.mean(axis=0)
    z = (z - center) / scale
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(cov[c] * (y == c).mean() for c in (0, 1))
    out, shrunk = {}, []
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * pooled
        shrunk.append(0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s)))
    for k, row in x.items():
        row = (row - center) / scale
        g = []
        for c in (0, 1):
            away = row - z[y == c].mean(axis=0)
            g.append(-0.5 * away @ np.linalg.inv(shrunk[c]) @ away - 0.5 * np.linalg.slogdet(shrunk[c])[1])
        logit = (g[1] - g[0]) / len(row) + math.log((y == 1).sum() / (y == 0).sum())
        out[k] = 1 / (1 + math.exp(-max(min(logit, 700), -700)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def scored(tables):
    return {r.doc_id: r for r in qq.classify(*tables).collect()}


def test_against_direct_formula(tables, scored):
    docs, labels = tables
    want = direct_scores([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    assert set(want) == set(scored)
    assert max(abs(want[k] - scored[k].score) for k in want) < 1e-6


def test_held_out_accuracy(tables, scored):
    rows = [(r.quality, scored[r.doc_id]) for r in tables[1].collect() if scored[r.doc_id].held_out]
    assert len(rows) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for _, r in rows)
    assert sum(q == r.predicted for q, r in rows) / len(rows) >= 0.97
    good, bad = [r.score for q, r in rows if q], [r.score for q, r in rows if not q]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.99


def test_predicted_follows_score(scored):
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())


def test_result_types(tables):
    out = qq.classify(*tables)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def test_held_out_labels_do_not_teach(spark, tables, scored):
    """Turning every held-out label around changes no score."""
    docs, labels = tables
    key = qq.F.col("doc_id")
    turned = labels.withColumn("quality", qq.F.when(qq.held_out(key), 1 - qq.F.col("quality")).otherwise(qq.F.col("quality")))
    again = {r.doc_id: r.score for r in qq.classify(docs, turned).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in scored.items())


def test_odd_rows(spark, odd):
    """Nulls, empty and very long texts and repeated rows have scores; equal texts equal ones."""
    labels = spark.createDataFrame(
        [(k, int(k % 2), None) for k in range(1, 15)] + [(2, 1, 0), (2, 1, 0), (None, 1, 0), (3, None, 0), (4, 7, 1)], LABELS)
    got = qq.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1 and len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert all(not r.held_out for r in got if r.doc_id is None)


@pytest.mark.parametrize("kinds, score", [((), 0.5), ((0,), 0.0), ((1,), 1.0)])
def test_missing_classes(spark, odd, kinds, score):
    labels = spark.createDataFrame([(k, c, 0) for k in range(1, 15) for c in kinds], LABELS)
    assert {r.score for r in qq.classify(odd, labels).collect()} == {score}


def test_repeated_keys_count_each_label(spark):
    """n documents and m labels of one key weigh n x m, from n + m rows."""
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(2, "D! E!")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)] * 4 + [(1, 0, 0)] + [(2, 0, 0)], LABELS)
    stats = qq.with_statistics(docs)
    taught = stats.join(qq.label_counts(labels, "doc_id", "quality"), stats.doc_id == qq.F.col("label_key"))
    sums = qq.moments(taught)
    assert taught.count() == 5 and sums[1][0] == 12 and sums[0][0] == 5


def test_constant_statistics_keep_a_model(spark):
    """Classes without any spread: shrinkage leaves a factor to take."""
    docs = spark.createDataFrame([(k, "same words here" if k % 2 else "OTHER! WORDS! THERE!") for k in range(40)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], LABELS)
    assert all(r.predicted == r.doc_id % 2 for r in qq.classify(docs, labels).collect())


def test_empty(spark, none):
    assert qq.classify(none, spark.createDataFrame([], LABELS)).collect() == []
