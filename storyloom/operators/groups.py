"""Group keys and group filters (F1-F5, A1, A2) and in-group positions.

A group is ``(year, category)``.  Group sizes are computed with one partial +
final hash aggregate; the statistics over groups are window aggregates over
that small table (one row per group), so the input is scanned once.  The
kept-group key list is joined with a plain join so AQE can broadcast it at
run time; AQE's skew-join split covers the case of a huge group when it
does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("year", "category")

# Fixed value: label for articles without a category.
MISC_CATEGORY = "Misc"


def fill_category(df: DataFrame, col: str = "category",
                  default: str = MISC_CATEGORY) -> DataFrame:
    """null category → ``Misc``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(default)))


def group_key(df: DataFrame, date_col: str = "date",
              category_col: str = "category") -> DataFrame:
    """F2/M8: add ``year`` (calendar year of the day-cut date).

    Rows without a date belong to no group and are dropped here.
    """
    return (df.where(F.col(date_col).isNotNull())
            .withColumn("year", F.year(F.to_date(F.col(date_col)))))


def group_label(category: str | Column = "category",
                year: str | Column = "year") -> Column:
    """the ``"{category}-{year}"`` label used for output names."""
    c = F.col(category) if isinstance(category, str) else category
    y = F.col(year) if isinstance(year, str) else year
    return F.concat_ws("-", c, y.cast("string"))


def group_counts(df: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """A1: rows per group (partial aggregation before the shuffle)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def count_stats(counts: DataFrame, col: str = "n_rows") -> DataFrame:
    """A2: mean and sample std of the counts; exactly one row."""
    return counts.agg(F.avg(col).alias("mean_n"),
                      F.stddev_samp(col).alias("std_n"))


def group_threshold(mode: str = "std"):
    """F3/F4 threshold: ``floor(|std - mean|)`` or ``floor(mean)``."""
    if mode == "std":
        thr = F.floor(F.abs(F.col("std_n") - F.col("mean_n")))
    elif mode == "mean":
        thr = F.floor(F.col("mean_n"))
    else:
        raise ValueError(f"unknown group filter mode {mode!r}")
    return thr.cast("bigint")


def kept_groups(df: DataFrame, keys: Sequence[str] = GROUP,
                mode: str = "std") -> DataFrame:
    """groups whose size is strictly greater than the threshold.

    Output: keys, ``n_rows``, ``threshold``.  With a single group the sample
    std is null; the group is kept (the reference fails on NaN).
    """
    counts = group_counts(df, keys)
    # statistics over the counts table itself (one row per group, small):
    # one scan of the input feeds both the sizes and the threshold
    everything = Window.partitionBy()
    stats = (counts.withColumn("mean_n", F.avg("n_rows").over(everything))
             .withColumn("std_n", F.stddev_samp("n_rows").over(everything)))
    return (stats.withColumn("threshold", group_threshold(mode))
            .where(F.col("threshold").isNull() | (F.col("n_rows") > F.col("threshold")))
            .drop("mean_n", "std_n"))


def filter_groups(df: DataFrame, keys: Sequence[str] = GROUP,
                  mode: str = "std") -> DataFrame:
    """keep the rows of the kept groups."""
    keep = kept_groups(df, keys, mode).select(*keys)
    return df.join(keep, list(keys), "left_semi")


def filter_categories_mean(df: DataFrame, category_col: str = "category") -> DataFrame:
    """keep rows whose category (over all years) has more rows than
    ``floor(mean)`` of the category sizes; null categories fall out."""
    named = df.where(F.col(category_col).isNotNull())
    return filter_groups(named, [category_col], mode="mean")


def position_in_group(df: DataFrame, keys: Sequence[str], order_col: str,
                      out: str = "id", slice_col: str | None = None,
                      rows_per_slice: int = 10_000) -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order_col``.

    Same result as ``row_number() over (partition by keys order by o) - 1``
    but without sending a whole group to one task.  The number of value ranges
    of ``slice_col`` (default ``order_col``; numeric and order-compatible with
    it) follows the largest group's count, about ``rows_per_slice`` rows each,
    at approximate quantiles; rows are numbered inside each (group, slice) and
    shifted by the sizes of the group's earlier slices.  The quantile bounds are
    computed once and stored, so the slice of a row is a pure function of its
    value — every branch that recomputes it agrees.
    """
    from storyloom.session import cut_lineage
    keys = list(keys)
    v = F.col(slice_col or order_col).cast("double")
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    n_slices = max(1, -(-largest // rows_per_slice))
    if n_slices == 1:  # every group is one slice: its rank is the position
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order_col)) - 1
        return df.withColumn(out, rank.cast("bigint"))
    probs = [i / n_slices for i in range(1, n_slices)]
    bounds = cut_lineage(df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(v, probs, 10000)).alias("_bounds")))
    sliced = (df.join(bounds, keys)
              .withColumn("_slice", F.size(F.filter("_bounds", lambda b: b < v)))
              .drop("_bounds"))
    local = sliced.withColumn(
        "_local", F.row_number().over(
            Window.partitionBy(*keys, "_slice").orderBy(order_col)) - 1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(offsets.select(*keys, "_slice", "_off"),
                       [*keys, "_slice"])
            .withColumn(out, (F.col("_local") + F.col("_off")).cast("bigint"))
            .drop("_slice", "_local", "_off"))


def grouped_articles(articles: DataFrame, mode: str = "std",
                     fill_misc: bool = True) -> DataFrame:
    """S1 → F1 → F2 → F3 (or F4) → in-group id: the pipeline's input rows."""
    df = fill_category(articles) if fill_misc else articles
    if mode == "category_mean":
        # the category sizes count every row, dated or not (as the reference)
        df = group_key(filter_categories_mean(df))
    else:
        df = filter_groups(group_key(df), GROUP, mode)
    return position_in_group(df, GROUP, "seq", "id")
