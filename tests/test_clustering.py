"""Properties against brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators import clustering as cl


def brute_silhouette(xs, labels):
    xs, labels = np.asarray(xs), np.asarray(labels)
    if len(set(labels)) < 2:
        return None
    s = []
    for i, x in enumerate(xs):
        own = labels == labels[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = np.abs(xs[own] - x).sum() / (own.sum() - 1)
        b = min(np.abs(xs[labels == c] - x).mean() for c in set(labels) if c != labels[i])
        s.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(s))


def brute_lloyd(xs, k):
    """Lloyd's steps over the points themselves, to the fixed point."""
    xs = sorted(xs)
    cents = [xs[int((j + 0.5) * len(xs) / k)] for j in range(k)]
    while True:
        lab = [sum((cents[t] + cents[t + 1]) / 2 < x for t in range(k - 1)) for x in xs]
        new = sorted(np.mean([x for x, c in zip(xs, lab) if c == j]) if j in lab else cents[j] for j in range(k))
        if np.allclose(new, cents, atol=1e-12, rtol=0):
            return cents
        cents = new


@pytest.mark.parametrize("slice_values", [100_000, 7, 1])
def test_models_match_lloyd_and_pairs(spark, monkeypatch, slice_values):
    """Whatever slices a group's values are cut into."""
    monkeypatch.setattr(cl, "SLICE_VALUES", slice_values)
    rnd = random.Random(7)
    data = {g: [float(rnd.choice([round(rnd.gauss(0, 1), 1), round(rnd.gauss(5, 1), 1), 2.0])) for _ in range(60)]
            for g in range(3)}
    data[3] = [1.0] * 40  # one value: a single cluster, no score
    rows = [(g, i, x) for g, xs in data.items() for i, x in enumerate(xs)]
    pts = spark.createDataFrame(rows, "g int, id int, x double")
    monkeypatch.setattr(cl, "CENTROIDS_PER_TASK", 5)  # several blocks of k
    got = {(r["g"], r["k"]): r for r in cl.kmeans_models(pts, ["g"]).collect()}
    assert set(got) == {(g, k) for g, xs in data.items() for k in range(2, int(len(xs) / np.sqrt(len(xs))))}
    for (g, k), r in got.items():
        assert np.allclose(r["cents"], brute_lloyd(data[g], k), atol=1e-9)
        lab = [sum((r["cents"][t] + r["cents"][t + 1]) / 2 < x for t in range(k - 1)) for x in data[g]]
        want = brute_silhouette(data[g], lab)
        assert r["score"] is None if want is None else abs(r["score"] - want) < 1e-9


def brute_seeds(xs, k, start):
    """k-means++ seeds over the points in order."""
    xs, out = sorted(xs), []
    for u in np.random.default_rng(start).random(k):
        odds = [min([(x - c) ** 2 for c in out], default=1.0) for x in xs]
        if sum(odds) == 0:
            out.append(out[-1])
            continue
        run, left = 0.0, u * sum(odds)
        for x, w in zip(xs, odds):
            run += w
            if run > left:
                break
        out.append(x)
    return sorted(out)


def steps_from(xs, cents):
    while True:
        lab = [sum((cents[t] + cents[t + 1]) / 2 < x for t in range(len(cents) - 1)) for x in xs]
        new = sorted(np.mean([x for x, c in zip(xs, lab) if c == j]) if j in lab else cents[j] for j in range(len(cents)))
        if np.allclose(new, cents, atol=1e-12, rtol=0):
            return cents
        cents = new


def inertia(xs, cents):
    return sum(min((x - c) ** 2 for c in cents) for x in xs)


def three_groups(spark, rnd):
    data = {g: [round(rnd.gauss(8 * rnd.randint(0, g + 1), 1), 3) for _ in range(45)] for g in range(2)}
    data[2] = [4.0] * 16
    rows = [(g, i, x) for g, xs in data.items() for i, x in enumerate(xs)]
    return data, spark.createDataFrame(rows, "g int, id int, x double")


@pytest.mark.parametrize("slice_values", [100_000, 9])
def test_best_of_several_starts(spark, monkeypatch, slice_values):
    """Every start against brute force, the one of least inertia stays, whatever
    slices a group's values are cut into."""
    monkeypatch.setattr(cl, "SLICE_VALUES", slice_values)
    data, pts = three_groups(spark, random.Random(21))
    got = {(r["g"], r["k"]): r for r in cl.kmeans_models(pts, ["g"], starts=6).collect()}
    assert set(got) == {(g, k) for g, xs in data.items() for k in range(2, int(np.sqrt(len(xs))))}
    for (g, k), r in got.items():
        ends = [steps_from(data[g], brute_seeds(data[g], k, start)) for start in range(6)]
        best = min(inertia(data[g], c) for c in ends)
        assert inertia(data[g], r["cents"]) == pytest.approx(best, abs=1e-6)
        assert any(np.allclose(c, r["cents"], atol=1e-6) for c in ends)
        lab = [sum((r["cents"][t] + r["cents"][t + 1]) / 2 < x for t in range(k - 1)) for x in data[g]]
        want = brute_silhouette(data[g], lab)
        assert r["score"] is None if want is None else abs(r["score"] - want) < 1e-9


def test_starts_drawn_from_cells(spark, monkeypatch):
    """A group of more values than cells: still fixed points of all its values,
    and not worse than the quantiles by much."""
    monkeypatch.setattr(cl, "SLICE_VALUES", 9)
    monkeypatch.setattr(cl, "SEED_CELLS", 12)
    data, pts = three_groups(spark, random.Random(5))
    models = cl.kmeans_models(pts, ["g"], starts=8).collect()
    assert [r for r in models if r["g"] < 2]
    for r in models:
        xs = data[r["g"]]
        assert np.allclose(steps_from(xs, list(r["cents"])), r["cents"], atol=1e-9)
        assert inertia(xs, r["cents"]) <= 1.2 * inertia(xs, brute_lloyd(xs, r["k"])) + 1e-9
    again = cl.kmeans_models(pts.repartition(5), ["g"], starts=8).collect()
    assert sorted((r["g"], r["k"], r["cents"]) for r in models) == sorted((r["g"], r["k"], r["cents"]) for r in again)


def test_sweep_labels_every_point_of_scored_groups(spark):
    rnd = random.Random(3)
    pts = spark.createDataFrame([(g, i, rnd.random() * 10) for g in range(2) for i in range(50)],
                                "g int, id int, x double")
    labels, best = cl.kmeans_sweep(pts, ["g"])
    models = {r["g"]: r for r in best.collect()}
    assert labels.count() == 100
    for r in labels.collect():
        cents = models[r["g"]]["cents"]
        assert r["cluster"] == int(np.argmin([abs(r["x"] - c) for c in cents]))


def test_positions_over_several_slices(spark):
    from storyloom.operators.groups import position_in_group
    rnd = random.Random(9)
    rows = [(g, i, rnd.randint(0, 30)) for g in range(2) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, id int, x int").withColumn("o", F.struct("x", "id"))
    got = position_in_group(df, ["g"], "o", "rank", slice_col="x", rows_per_slice=17).collect()
    for g in range(2):
        want = sorted((x, i) for gg, i, x in rows if gg == g)
        assert [(r["x"], r["id"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == want


def test_top_representatives(spark):
    labels = spark.createDataFrame(
        [(0, i, float(i), 0) for i in range(6)] + [(0, 10 + i, 100.0 + i, 1) for i in range(2)],
        "g int, id int, x double, cluster int")
    cents = spark.createDataFrame([(0, 0, 2.5), (0, 1, 100.5)], "g int, cluster int, mu double")
    reps = cl.top_representatives(labels, cents, ["g"]).orderBy("cluster", "rank").collect()
    # sizes 6 and 2 → mean 4, std 2.83 → n_min 1, n_max 7; cluster 1 has < 3 docs
    assert [(r["cluster"], r["id"]) for r in reps] == [(0, 2), (0, 3), (0, 1), (0, 4), (0, 0), (0, 5)]


def test_pca_1d_against_a_direct_svd(spark):
    """The projection on the first right singular vector, its largest loading positive."""
    rng = np.random.default_rng(12)
    data = {g: rng.normal(size=(n, 4)) * [3, 1, 0.5, 0.2] + g for g, n in ((0, 30), (1, 7), (2, 1))}
    rows = [(g, i, v.tolist()) for g, m in data.items() for i, v in enumerate(m)]
    got = {(r["g"], r["id"]): r["x"] for r in cl.pca_1d(
        spark.createDataFrame(rows, "g int, id int, vec array<double>").repartition(5), ["g"]).collect()}
    for g, m in data.items():
        centred = m - m.mean(axis=0)
        axis = np.linalg.svd(centred)[2][0]
        axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
        want = centred @ axis if len(m) > 1 else np.zeros(1)
        assert np.allclose([got[g, i] for i in range(len(m))], want, atol=1e-9)


def test_a_group_of_many_values_is_one_slice(spark):
    """Beyond 100,000 values a step was a Spark job for every model; a million fit a task."""
    from storyloom.operators import clustering as cl
    points = spark.range(150_000).selectExpr("0 as g", "id * 1.0 as x")
    assert [r.n_slices for r in cl.value_slices(points, ["g"]).collect()] == [1]


def test_blocks_of_models_stay_tasks_of_their_own(spark):
    """Costly groups of few bytes are not merged into one task."""
    points = spark.range(4000).select(F.lit(2020).alias("year"), F.lit("en").alias("category"), "id", (F.col("id") * 7 % 1013).cast("double").alias("x"))
    slices = cl.value_slices(points, ["year", "category"])
    grid = cl.model_grid(points, ["year", "category"])
    seeds = cl.seed_table(slices, grid, ["year", "category"], 5)
    schema = T.StructType([*points.schema.fields[:2], T.StructField("k", T.IntegerType()),
                           T.StructField("cents", T.ArrayType(T.DoubleType())), T.StructField("score", T.DoubleType())])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (cl._models_of_one_slice(slices, grid, ["year", "category"], schema),
                 cl._models_of_one_slice(slices, grid, ["year", "category"], schema, seeds)):
        made.count()
        assert made.rdd.getNumPartitions() == n > 1
