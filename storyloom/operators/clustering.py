"""Clusters (C1-C5) and representative documents.

* C1 ``pca_1d``: per group, centred projection on the first principal axis.
  Partial moment sums (n, Σv, Σvvᵀ) are computed per Arrow batch in
  ``mapInPandas`` and added up per group with MLlib's ``Summarizer`` (a JVM
  aggregate with map-side merge); only a d×d matrix per group reaches the
  small eigen step.  Rows never leave their partitions.
* C2-C4 ``kmeans_models``: every (group, k) model of the sweep, fitted to its
  fixed point and scored over the group's prefix table (distinct values with
  running counts and sums), which is cut into value slices.  The start is the k
  quantiles of the group's points, or the best of several k-means++ starts,
  whose draws are fixed, so runs repeat.
* W2 ``top_representatives``: ranks inside a cluster by slices, so a large
  cluster is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.groups import position_in_group
from storyloom.session import cut_lineage, dealt, forget

# The reference's smallest k and smallest kept cluster size.
MIN_K = 2
MIN_CLUSTER_DOCS = 3


# ---- C1 ---------------------------------------------------------------------

def _key_schema(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def pca_1d(df: DataFrame, keys: Sequence[str], id_col: str = "id",
           vec_col: str = "vec", out: str = "x") -> DataFrame:
    """``(keys…, id, x)`` — projection of each centred vector on its
    group's first principal axis; the largest-magnitude loading is made
    positive so the sign is reproducible.  Groups of one row get ``x = 0``."""
    keys = list(keys)
    key_fields = _key_schema(df, keys)
    part_schema = T.StructType(key_fields + [
        T.StructField("n", T.LongType()),
        T.StructField("s", T.ArrayType(T.DoubleType())),
        T.StructField("ss", T.ArrayType(T.DoubleType()))])

    def partial_moments(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for key, g in pdf.groupby(keys, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                m = np.vstack(g[vec_col].to_numpy()).astype(np.float64)
                row = dict(zip(keys, key))
                row.update(n=len(m), s=m.sum(axis=0).tolist(), ss=(m.T @ m).ravel().tolist())
                yield pd.DataFrame([row])

    parts = df.select(*keys, vec_col).mapInPandas(partial_moments, part_schema)
    sums = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        Summarizer.sum(array_to_vector("s")).alias("s"),
        Summarizer.sum(array_to_vector("ss")).alias("ss"))
    sums = sums.select(*keys, "n", vector_to_array("s").alias("s"),
                       vector_to_array("ss").alias("ss"))

    axis_schema = T.StructType(key_fields + [
        T.StructField("mu", T.ArrayType(T.DoubleType())),
        T.StructField("pc", T.ArrayType(T.DoubleType()))])

    def principal_axis(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            n = int(r["n"])
            s = np.asarray(r["s"], dtype=np.float64)
            d = len(s)
            mu = s / n
            if n < 2:
                pc = np.zeros(d)
            else:
                ss = np.asarray(r["ss"], dtype=np.float64).reshape(d, d)
                cov = (ss - n * np.outer(mu, mu)) / (n - 1)
                _, vecs = np.linalg.eigh(cov)
                pc = vecs[:, -1]
                if pc[np.argmax(np.abs(pc))] < 0:
                    pc = -pc
            out_row = {k: r[k] for k in keys}
            out_row.update(mu=mu.tolist(), pc=pc.tolist())
            rows.append(out_row)
        return pd.DataFrame(rows, columns=[*keys, "mu", "pc"])

    # one row per group: the eigen step runs on d×d matrices only
    axes = sums.groupBy(*keys).applyInPandas(principal_axis, axis_schema)
    proj = F.aggregate(F.zip_with(F.zip_with(vec_col, "mu", lambda v, m: v - m), "pc",
                                  lambda c, p: c * p), F.lit(0.0), lambda a, b: a + b)
    return df.join(axes, keys).select(*keys, id_col, proj.alias(out))


# ---- C2, C3, C4 -------------------------------------------------------------

#: Sum of k of the models that one task fits.
CENTROIDS_PER_TASK = 4_000


def model_grid(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C4's k range per group: ``k = 2 … floor(n / sqrt(n)) - 1`` (n points)."""
    keys = list(keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    kmax = (F.floor(F.col("n") / F.sqrt(F.col("n"))) - 1).cast("int")
    return (sizes.where(kmax >= MIN_K)
            .select(*keys, "n", F.explode(F.sequence(F.lit(MIN_K), kmax)).alias("k")))


def assign(points: DataFrame, cents: DataFrame, keys: Sequence[str], x_col: str = "x") -> DataFrame:
    """Label every point of every given model with its nearest sorted centroid (the
    lower one on exact ties)."""
    mids = F.transform(F.slice("cents", 2, F.size("cents")), lambda c, i: (c + F.element_at("cents", i + 1)) / 2)
    return (points.join(cents.withColumn("_mids", mids), list(keys))
            .withColumn("cluster", F.size(F.filter("_mids", lambda m: m < F.col(x_col)))).drop("_mids"))


#: Distinct values of a slice of a group's line, all that a task holds of it (16 MB,
#: some 100 MB with its running sums and scores).  A step over the slices is a Spark
#: job, one inside a slice some 20 microseconds, so slices are as large as fits.
SLICE_VALUES = 1_000_000


def value_slices(points: DataFrame, keys: Sequence[str], x_col: str = "x") -> DataFrame:
    """A group's points on the line as a prefix table cut into value slices.

    ``keys…, slice, n_slices, xs, ns, top, before_n, before_s, total``: distinct
    values in order and their counts (packed), the slice's largest value, points
    and their sum before the slice, points of the group.  Bounds of slices are
    approximate quantiles of the distinct values.
    """
    keys = list(keys)
    values = cut_lineage(points.groupBy(*keys, F.col(x_col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")))
    wanted = values.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SLICE_VALUES).cast("int").alias("n_slices"))
    large = values.join(wanted.where("n_slices > 1"), keys)
    most = large.agg(F.max("n_slices")).first()[0] or 1
    if most > 1:
        probs = [i / most for i in range(1, most)]
        bounds = cut_lineage(large.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", probs, 10 * most)).alias("bounds")))
        placed = values.join(bounds, keys, "left").withColumn("slice", F.coalesce(
            F.size(F.filter("bounds", lambda v: v < F.col("x"))), F.lit(0))).drop("bounds")
        placed = placed.withColumn("slice", F.when(F.col("slice") < 0, 0).otherwise(F.col("slice")))
    else:
        placed = values.withColumn("slice", F.lit(0))
    schema = T.StructType(_key_schema(points, keys) + [
        T.StructField("slice", T.IntegerType()), T.StructField("xs", T.BinaryType()),
        T.StructField("ns", T.BinaryType()), T.StructField("top", T.DoubleType()),
        T.StructField("points", T.LongType()), T.StructField("sum", T.DoubleType())])

    def pack(group: pa.Table) -> pa.Table:
        x, n = group.column("x").to_numpy(), group.column("n").to_numpy()
        order = np.argsort(x)
        x, n = x[order].astype("<f8"), n[order].astype("<i8")
        rest = [pa.array([x.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([x[-1]]),
                pa.array([int(n.sum())]), pa.array([float((x * n).sum())])]
        return pa.table([group.column(c).slice(0, 1) for c in [*keys, "slice"]] + rest, names=schema.names)

    packed = cut_lineage(placed.groupBy(*keys, "slice").applyInArrow(pack, schema))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = packed.select(*keys, "slice", F.count(F.lit(1)).over(whole).cast("int").alias("n_slices"),
                         F.coalesce(F.sum("points").over(earlier), F.lit(0)).alias("before_n"),
                         F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)).alias("before_s"),
                         F.sum("points").over(whole).alias("total"))
    return packed.drop("points", "sum").join(sums, [*keys, "slice"])


def _prefix(xs: bytes, ns: bytes, before_n: int = 0, before_s: float = 0.0):
    """Values of a slice, and points and their sum up to each of them, from the
    group's first value on; the first entry is what lies before the slice."""
    x, n = np.frombuffer(xs, "<f8"), np.frombuffer(ns, "<i8")
    return x, np.concatenate(([0], np.cumsum(n))) + before_n, np.concatenate(([0.0], np.cumsum(x * n))) + before_s


def _moved(cents: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Centroids after a Lloyd step; an empty cluster keeps its own."""
    return np.sort(np.where(count > 0, total / np.maximum(count, 1), cents))


def _silhouettes(x, cum_n, cum_s, low_n, low_s, high_n, high_s, mean_below, mean_above):
    """C3 of values whose clusters hold the points from ``low`` to ``high``.  The
    mean distance to another interval is the distance to its mean, the nearest one
    is a neighbour, and distances inside a cluster come from the running sums.  A
    point alone in its cluster scores 0."""
    inside = ((cum_n - low_n) * x - (cum_s - low_s)) + ((high_s - cum_s) - (high_n - cum_n) * x)
    size = high_n - low_n
    a = inside / np.maximum(size - 1, 1)
    b = np.minimum(np.abs(x - mean_below), np.abs(x - mean_above))
    most = np.maximum(a, b)
    return np.where((size > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0)


#: Values that stand for a group while its k-means++ starts are drawn.  A group
#: with more distinct values is summed up in as many cells of neighbours.
SEED_CELLS = 100_000


def draw_seeds(x: np.ndarray, n: np.ndarray, k: int, start: int) -> np.ndarray:
    """``k`` k-means++ seeds from the values ``x`` held by ``n`` points, in the
    order of drawing: a point at random, then points with odds by their squared
    distance to the nearest seed.  The first seeds do not depend on ``k``; when no
    value is left that is no seed, the last one repeats."""
    seeds, odds = np.empty(k), n.astype(np.float64)
    near = np.full(len(x), np.inf)
    for j, u in enumerate(np.random.default_rng(start).random(k)):
        upto = np.cumsum(odds)
        if upto[-1] > 0:
            at = np.searchsorted(upto, u * upto[-1], "right")
            seeds[j] = x[min(at, len(x) - 1)]
        else:
            seeds[j:] = seeds[j - 1]
            break
        near = np.minimum(near, (x - seeds[j]) ** 2)
        odds = near * n
    return seeds


def seed_table(slices: DataFrame, grid: DataFrame, keys: Sequence[str], starts: int) -> DataFrame:
    """``keys…, seeds``: per group the seeds of ``starts`` k-means++ starts, each
    as long as the group's largest k; a model takes the first k of them.

    A start is drawn in a task of its own from at most about ``SEED_CELLS`` values
    or cells of a group.  Cells hold neighbouring values of one slice, all alike in
    number, and cover every point; Lloyd's steps then run over the values."""
    keys = list(keys)
    limit = SEED_CELLS
    cell_schema = T.StructType([slices.schema[c] for c in [*keys, "slice", "xs", "ns"]])

    def cells(group: pa.Table) -> pa.Table:
        x, n = (np.frombuffer(group.column(c)[0].as_py(), t) for c, t in (("xs", "<f8"), ("ns", "<i8")))
        wanted = int(np.ceil(len(x) * min(1.0, limit / group.column("values")[0].as_py())))
        first = np.arange(wanted) * len(x) // wanted
        size = np.add.reduceat(n, first)
        mean = x if wanted == len(x) else np.add.reduceat(x * n, first) / size
        return pa.table([group.column(c) for c in [*keys, "slice"]]
                        + [pa.array([mean.astype("<f8").tobytes()]), pa.array([size.astype("<i8").tobytes()])],
                        names=cell_schema.names)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        x, n = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("xs", "<f8"), ("ns", "<i8")))
        head = pdf.iloc[:1][[*keys, "start"]].copy()
        head["seq"] = [draw_seeds(x, n, int(pdf["most"].iloc[0]), int(pdf["start"].iloc[0])).tolist()]
        return head

    values = F.sum(F.octet_length("xs") / 8).over(Window.partitionBy(*keys))
    summed = slices.select(*keys, "slice", "xs", "ns", values.alias("values")).groupBy(*keys, "slice").applyInArrow(
        cells, cell_schema)
    asked = grid.groupBy(*keys).agg(F.max("k").alias("most")).withColumn(
        "start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    schema = T.StructType(_key_schema(slices, keys) + [
        T.StructField("start", T.IntegerType()), T.StructField("seq", T.ArrayType(T.DoubleType()))])
    drawn = dealt(summed.join(asked, keys), *keys, "start").groupBy(*keys, "start").applyInPandas(draw, schema)
    return drawn.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("start", "seq"))), lambda r: r["seq"]).alias("seeds"))


def _fixed_point(row, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's steps from sorted ``cents`` until no value changes its cluster:
    centroids, and where each cluster starts among the values."""
    x, cum_n, cum_s = row
    before = None
    while True:
        at = np.concatenate(([0], np.searchsorted(x, (cents[:-1] + cents[1:]) / 2, "right"), [len(x)]))
        if before is not None and np.array_equal(at, before):
            return cents, at
        cents, before = _moved(cents, np.diff(cum_n[at]), np.diff(cum_s[at])), at


def _between(row, at: np.ndarray) -> float:
    """Squares between clusters: inertia is a constant of the group less this."""
    _, cum_n, cum_s = row
    count = np.diff(cum_n[at])
    off = np.diff(cum_s[at]) - cum_s[-1] / cum_n[-1] * count
    return float((off[count > 0] ** 2 / count[count > 0]).sum())


def _one_slice(row, k: int, seeds=None) -> tuple[np.ndarray, float | None]:
    """Fixed point and mean silhouette of a model whose group is one slice: from
    the quantiles, or the one with the least inertia over the starts of ``seeds``."""
    x, cum_n, cum_s = row
    if seeds is None:
        rank = np.floor((np.arange(k) + 0.5) * cum_n[-1] / k).astype(np.int64)
        cents, at = _fixed_point(row, x[np.searchsorted(cum_n[1:], rank, "right")])
    else:
        ends = [_fixed_point(row, np.sort(np.asarray(seq)[:k])) for seq in seeds]
        cents, at = max(ends, key=lambda e: _between(row, e[1]))
    count, total = np.diff(cum_n[at]), np.diff(cum_s[at])
    full = np.flatnonzero(count > 0)
    if len(full) < 2:
        return cents, None
    low, high = at[full], at[full + 1]
    own = np.repeat(np.arange(len(full)), high - low)
    means = np.concatenate(([np.inf], total[full] / count[full], [np.inf]))
    s = _silhouettes(x, cum_n[1:], cum_s[1:], cum_n[low][own], cum_s[low][own], cum_n[high][own], cum_s[high][own],
                     means[own], means[own + 2])
    return cents, float((s * np.diff(cum_n)).sum() / cum_n[-1])


def _models_of_one_slice(slices: DataFrame, grid: DataFrame, keys: list[str], schema: T.StructType,
                         seeds: DataFrame | None = None) -> DataFrame:
    """Models of groups of one slice: a task fits a block of k."""
    seeded = seeds is not None
    block = F.floor(F.col("k") * (F.col("k") + 1) / (2 * CENTROIDS_PER_TASK)).cast("int")
    blocks = grid.groupBy(*keys, block.alias("_blk")).agg(F.min("k").alias("_k0"), F.max("k").alias("_k1"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, rows = _prefix(pdf["xs"].iloc[0], pdf["ns"].iloc[0]), []
        drawn = pdf["seeds"].iloc[0] if seeded else None
        for k in range(int(pdf["_k0"].iloc[0]), int(pdf["_k1"].iloc[0]) + 1):
            rows.append((*key[:-1], k, *_one_slice(row, k, drawn)))
        return pd.DataFrame(rows, columns=[*keys, "k", "cents", "score"])

    rows = slices.where("n_slices = 1").select(*keys, "xs", "ns").join(blocks, keys)
    return (dealt(rows.join(seeds, keys) if seeded else rows, *keys, "_blk")
            .groupBy(*keys, "_blk").applyInPandas(fit, schema))


def _looked_up(slices: DataFrame, asked: DataFrame, keys: list[str], by_rank: bool) -> DataFrame:
    """For ``asked`` (``keys…, slice, k, j, v``): the value of rank ``v``, or the
    points up to the value ``v`` and their sum (``x``, ``n``, ``s``)."""
    schema = T.StructType([slices.schema[c] for c in keys] + [
        T.StructField("k", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("x", T.DoubleType()),
        T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())])

    def find(own: pa.Table, rows: pa.Table) -> pa.Table:
        x, cum_n, cum_s = _prefix(*(own.column(c)[0].as_py() for c in ("xs", "ns", "before_n", "before_s")))
        v = rows.column("v").to_numpy()
        if by_rank:
            at = np.searchsorted(cum_n[1:], v, "right")
            got = [x[at], np.zeros(len(v), np.int64), np.zeros(len(v))]
        else:
            at = np.searchsorted(x, v, "right")
            got = [v, cum_n[at], cum_s[at]]
        return pa.table([rows.column(c) for c in [*keys, "k", "j"]] + [pa.array(g) for g in got], names=schema.names)

    side = slices.select(*keys, "slice", "xs", "ns", "before_n", "before_s")
    by = [*keys, "slice"]
    return side.groupBy(*by).cogroup(asked.select(*by, "k", "j", F.col("v").cast("double").alias("v")).groupBy(*by)
                                     ).applyInArrow(find, schema)


def _models_of_slices(slices: DataFrame, grid: DataFrame, keys: list[str], begin: DataFrame | None = None) -> DataFrame:
    """Models of groups of several slices.  A Lloyd step of all models is one job:
    their boundaries go to the slices that hold them, and the running counts and
    sums found there come back as one row per model.  ``begin`` (``keys…, k,
    cents``, ``k`` any number of the model) replaces the start from quantiles."""
    wide = slices.where("n_slices > 1")
    lines = cut_lineage(wide.groupBy(*keys).agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("slice", "before_n", "top"))).alias("line")))
    model = [*keys, "k"]
    tops, slots = F.transform("line", lambda r: r["top"]), F.transform("line", lambda r: r["slice"])

    def slice_of(below: Column) -> Column:
        return F.element_at(slots, F.least(below + 1, F.size("line")))

    if begin is None:
        ranks = F.transform(F.sequence(F.lit(0), F.col("k") - 1),
                            lambda j: F.floor((j + 0.5) * F.col("total") / F.col("k")).cast("double"))
        asked = grid.join(lines, keys).select(*model, "line", F.posexplode(ranks).alias("j", "v"))
        asked = asked.withColumn("slice", F.element_at(
            slots, F.size(F.filter("line", lambda r: r["before_n"] <= F.col("v")))))
        start = _looked_up(wide, asked, keys, True).groupBy(*model).agg(
            F.sort_array(F.collect_list(F.struct("j", "x"))).alias("c"))
        start = start.select(*model, F.transform("c", lambda r: r["x"]).alias("cents"))
    else:
        start = begin.join(lines.select(*keys), keys, "left_semi")
    state = cut_lineage(start.select(*model, "cents", F.lit(None).cast("array<bigint>").alias("at"), F.lit(False).alias("done"),
                                     F.lit(None).cast("array<struct<n:bigint,s:double>>").alias("found")))
    sums = cut_lineage(_line_totals(wide, keys))
    while not state.where(~F.col("done")).isEmpty():
        open_models = state.where(~F.col("done"))
        mids = F.transform(F.slice("cents", 2, F.size("cents")),
                           lambda c, i: (c + F.element_at("cents", i + 1)) / 2)
        asked = open_models.join(lines, keys).select(*model, "line", F.posexplode(mids).alias("j", "v"))
        asked = asked.withColumn("slice", slice_of(F.size(F.filter(tops, lambda t: t < F.col("v")))))
        found = _looked_up(wide, asked, keys, False).groupBy(*model).agg(
            F.sort_array(F.collect_list(F.struct("j", "n", "s"))).alias("r"))
        joined = open_models.join(found, model).join(sums, keys)
        bounds = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("s"))),
                          F.transform("r", lambda b: F.struct(b["n"].alias("n"), b["s"].alias("s"))),
                          F.array(F.struct(F.col("all_n").alias("n"), F.col("all_s").alias("s"))))
        stepped = joined.withColumn("found", bounds)
        at = F.transform("found", lambda b: b["n"])
        moved = F.sort_array(F.transform("cents", lambda c, j: F.when(
            F.element_at("found", j + 2)["n"] > F.element_at("found", j + 1)["n"],
            (F.element_at("found", j + 2)["s"] - F.element_at("found", j + 1)["s"])
            / (F.element_at("found", j + 2)["n"] - F.element_at("found", j + 1)["n"])).otherwise(c)))
        same = F.coalesce(F.col("at") == at, F.lit(False))
        stepped = stepped.select(*model, F.when(same, F.col("cents")).otherwise(moved).alias("cents"),
                                 at.alias("at"), same.alias("done"), "found")
        after = cut_lineage(state.where("done").unionByName(stepped))
        forget(state)
        state = after
    return state.select(*model, "cents", "found")


def _line_totals(slices: DataFrame, keys: list[str]) -> DataFrame:
    """``keys…, all_n, all_s``: points of a group and their sum."""
    def last(own: pa.Table) -> pa.Table:
        _, cum_n, cum_s = _prefix(*(own.column(c)[0].as_py() for c in ("xs", "ns", "before_n", "before_s")))
        return pa.table([own.column(c) for c in keys] + [pa.array([int(cum_n[-1])]), pa.array([float(cum_s[-1])])],
                        names=[*keys, "all_n", "all_s"])

    schema = T.StructType([slices.schema[c] for c in keys] + [
        T.StructField("all_n", T.LongType()), T.StructField("all_s", T.DoubleType())])
    top = slices.withColumn("_last", F.max("slice").over(Window.partitionBy(*keys)))
    return top.where("slice = _last").drop("_last").groupBy(*keys, "slice").applyInArrow(last, schema)


def _best_start(models: DataFrame, keys: list[str], starts: int) -> DataFrame:
    """Of models numbered ``k * starts + start`` the one with the least inertia per
    k, the first on ties, under its k."""
    end = F.element_at("found", -1)
    between = F.aggregate(F.sequence(F.lit(1), F.size("cents")), F.lit(0.0), lambda acc, j: acc + F.when(
        F.element_at("found", j + 1)["n"] > F.element_at("found", j)["n"],
        F.pow(F.element_at("found", j + 1)["s"] - F.element_at("found", j)["s"]
              - end["s"] / end["n"] * (F.element_at("found", j + 1)["n"] - F.element_at("found", j)["n"]), F.lit(2))
        / (F.element_at("found", j + 1)["n"] - F.element_at("found", j)["n"])).otherwise(0.0))
    best = models.groupBy(*keys, F.floor(F.col("k") / starts).cast("int").alias("_model")).agg(
        F.max_by(F.struct("cents", "found"), F.struct(between, -F.col("k"))).alias("_b"))
    return best.select(*keys, F.col("_model").alias("k"), "_b.cents", "_b.found")


def _scored_by_slice(slices: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """C3 of models of several slices: every slice scores its own values of the
    clusters that reach into it."""
    model = [*keys, "k"]
    wide = slices.where("n_slices > 1")
    full = F.filter(F.transform(F.sequence(F.lit(1), F.size("cents")), lambda j: F.struct(
        F.element_at("found", j).alias("lo"), F.element_at("found", j + 1).alias("hi"))),
        lambda c: c["hi"]["n"] > c["lo"]["n"])
    mean = lambda c: (c["hi"]["s"] - c["lo"]["s"]) / (c["hi"]["n"] - c["lo"]["n"])
    clusters = models.select(*model, full.alias("cl")).where(F.size("cl") > 1)
    means = F.transform("cl", mean)
    rows = clusters.select(*model, means.alias("means"), F.posexplode("cl").alias("i", "c"))
    far = F.lit(float("inf"))
    rows = rows.select(
        *model, F.col("c.lo.n").alias("lo_n"), F.col("c.lo.s").alias("lo_s"), F.col("c.hi.n").alias("hi_n"),
        F.col("c.hi.s").alias("hi_s"),
        F.when(F.col("i") > 0, F.get("means", F.col("i") - 1)).otherwise(far).alias("below"),
        F.coalesce(F.get("means", F.col("i") + 1), far).alias("above"))
    spans = wide.select(*keys, "slice", "before_n", F.lead("before_n").over(
        Window.partitionBy(*keys).orderBy("slice")).alias("until"), "total")
    lines = spans.groupBy(*keys).agg(F.collect_list(F.struct(
        "slice", F.col("before_n").alias("a"), F.coalesce("until", "total").alias("b"))).alias("line"))
    reach = F.filter("line", lambda r: (r["a"] < F.col("hi_n")) & (r["b"] > F.col("lo_n")))
    asked = rows.join(lines, keys).withColumn("slice", F.explode(F.transform(reach, lambda r: r["slice"]))).drop("line")
    schema = T.StructType([slices.schema[c] for c in keys] + [
        T.StructField("k", T.IntegerType()), T.StructField("part", T.DoubleType())])

    def score(own: pa.Table, asked_rows: pa.Table) -> pa.Table:
        x, cum_n, cum_s = _prefix(*(own.column(c)[0].as_py() for c in ("xs", "ns", "before_n", "before_s")))
        column = {c: asked_rows.column(c).to_numpy() for c in ("k", "lo_n", "lo_s", "hi_n", "hi_s", "below", "above")}
        start = np.searchsorted(cum_n[:-1], np.maximum(column["lo_n"], cum_n[0]), "left")
        stop = np.searchsorted(cum_n[1:], np.minimum(column["hi_n"], cum_n[-1]), "left") + 1
        parts = np.zeros(len(start))
        for r, (i, j) in enumerate(zip(start.tolist(), stop.tolist())):
            s = _silhouettes(x[i:j], cum_n[i + 1:j + 1], cum_s[i + 1:j + 1], *(column[c][r] for c in (
                "lo_n", "lo_s", "hi_n", "hi_s", "below", "above")))
            parts[r] = (s * np.diff(cum_n[i:j + 1])).sum()
        return pa.table([asked_rows.column(c) for c in [*keys, "k"]] + [pa.array(parts)], names=schema.names)

    by = [*keys, "slice"]
    side = wide.select(*by, "xs", "ns", "before_n", "before_s")
    parts = side.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(score, schema)
    totals = wide.groupBy(*keys).agg(F.first("total").alias("total"))
    scores = parts.groupBy(*model).agg(F.sum("part").alias("part")).join(totals, keys)
    scores = scores.select(*model, (F.col("part") / F.col("total")).alias("score"))
    return models.select(*model, "cents").join(scores, model, "left")


def kmeans_models(points: DataFrame, keys: Sequence[str], x_col: str = "x", starts: int = 0) -> DataFrame:
    """``keys…, k, cents, score`` of every model of ``model_grid``: Lloyd's
    steps from the k quantiles until no point changes its cluster, and the exact
    mean silhouette (null with fewer than two clusters that hold points).

    With ``starts`` above 0 that many k-means++ starts (``seed_table``) take the
    place of the quantiles; the one that ends with the least inertia stays, the
    first on ties.

    Points are combined to distinct values before the shuffle.  Groups of up to
    ``SLICE_VALUES`` of them are one slice, and tasks fit blocks of about
    ``CENTROIDS_PER_TASK`` centroids; larger groups are stepped and scored slice
    by slice, all models in the same jobs.  Either way the same lookups in running
    counts and sums give the same centroids.
    """
    keys = list(keys)
    schema = T.StructType(_key_schema(points, keys) + [
        T.StructField("k", T.IntegerType()), T.StructField("cents", T.ArrayType(T.DoubleType())),
        T.StructField("score", T.DoubleType())])
    slices = cut_lineage(value_slices(points, keys, x_col))
    grid = model_grid(points, keys).select(*keys, "k")
    seeds = cut_lineage(seed_table(slices, grid, keys, starts)) if starts else None
    small = _models_of_one_slice(slices, grid, keys, schema, seeds)
    if slices.where("n_slices > 1").isEmpty():
        return small
    if starts:
        begin = grid.join(seeds, keys).select(*keys, "k", F.posexplode("seeds").alias("start", "seq"))
        begin = begin.select(*keys, (F.col("k") * starts + F.col("start")).alias("k"),
                             F.sort_array(F.slice("seq", F.lit(1), F.col("k"))).alias("cents"))
        models = _best_start(_models_of_slices(slices, grid, keys, begin), keys, starts)
    else:
        models = _models_of_slices(slices, grid, keys)
    large = _scored_by_slice(slices, cut_lineage(models), keys)
    return small.unionByName(large)


# ---- C4, W5 -----------------------------------------------------------------

def best_per_group(scores: DataFrame, keys: Sequence[str], model_col: str = "k",
                   score_col: str = "score") -> DataFrame:
    """The model with the highest score per group; the first one on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col(score_col).desc_nulls_last(), model_col)
    return (scores.where(F.col(score_col).isNotNull())
            .withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))


def kmeans_sweep(points: DataFrame, keys: Sequence[str], x_col: str = "x", id_col: str = "id", starts: int = 0):
    """C4: returns ``(labels, best)``; ``starts`` as in ``kmeans_models``.

    ``labels``: ``keys, id, x, k, cluster`` for the chosen k;
    ``best``: ``keys, k, score, cents`` per group.
    """
    keys = list(keys)
    best = cut_lineage(best_per_group(kmeans_models(points, keys, x_col, starts), keys))
    labels = assign(points.select(*keys, id_col, x_col),
                    best.select(*keys, "k", "cents"), keys, x_col).drop("cents")
    return labels, best


# ---- C5, A2, W2 -------------------------------------------------------------

def cluster_sizes(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members per cluster."""
    return labels.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size"))


def rep_bounds(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A2: ``n_min = floor(mean - std)``, ``n_max = ceil(mean + std)`` of the
    cluster sizes of each group (sample std; 0 when there is one cluster)."""
    st = sizes.groupBy(*keys).agg(F.avg("size").alias("_mean"),
                                  F.coalesce(F.stddev_samp("size"), F.lit(0.0)).alias("_std"))
    return st.select(*keys, F.floor(F.col("_mean") - F.col("_std")).cast("bigint").alias("n_min"),
                     F.ceil(F.col("_mean") + F.col("_std")).cast("bigint").alias("n_max"))


def top_representatives(labels: DataFrame, centroids: DataFrame, keys: Sequence[str],
                        x_col: str = "x", id_col: str = "id") -> DataFrame:
    """Per cluster with at least ``max(3, n_min)`` members, the ``n_max``
    members nearest to the centroid (ties by id): ``keys, cluster, rank, id``.

    ``centroids``: ``keys, cluster, mu``.
    """
    keys = list(keys)
    sizes = cluster_sizes(labels, keys)
    bounds = rep_bounds(sizes, keys)
    ok = (sizes.join(bounds, keys)
          .where(F.col("size") >= F.greatest(F.lit(MIN_CLUSTER_DOCS), F.col("n_min"))))
    cand = labels.join(ok.select(*keys, "cluster", "n_max"), [*keys, "cluster"]).join(
        centroids, [*keys, "cluster"])
    cand = cand.withColumn("_d", F.abs(F.col(x_col) - F.col("mu")))
    ranked = position_in_group(cand.withColumn("_o", F.struct("_d", id_col)), [*keys, "cluster"], "_o",
                               "rank", slice_col="_d")
    return (ranked.where(F.col("rank") < F.col("n_max"))
            .select(*keys, "cluster", F.col("rank").cast("bigint").alias("rank"), id_col))


def centroid_table(best: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, cluster, mu`` from the chosen model's centroid array."""
    return best.select(*keys, F.posexplode("cents").alias("cluster", "mu"))
