"""F1-F5, A1, A2 and in-group positions."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from storyloom.operators import groups as grp


def test_filter_groups_threshold(spark):
    rows = [(i, "2020-01-01", "a") for i in range(10)] + \
           [(100 + i, "2020-01-01", "b") for i in range(2)] + \
           [(200 + i, "2021-01-01", None) for i in range(5)]
    df = spark.createDataFrame(rows, "seq int, d string, category string") \
        .withColumn("date", F.to_date("d"))
    dated = grp.group_key(grp.fill_category(df))
    kept = {(r["year"], r["category"]): (r["n_rows"], r["threshold"])
            for r in grp.kept_groups(dated).collect()}
    # sizes 10, 2, 5: mean 5.667, sample std 4.041 → floor(1.626) = 1
    assert kept == {(2020, "a"): (10, 1), (2020, "b"): (2, 1), (2021, "Misc"): (5, 1)}
    kept_mean = {r["category"] for r in grp.kept_groups(dated, mode="mean").collect()}
    assert kept_mean == {"a"}


def test_single_group_is_kept(spark):
    df = spark.createDataFrame([(1, "x", 2020)], "seq int, category string, year int")
    assert grp.kept_groups(df).count() == 1


def test_position_in_group_equals_row_number(spark):
    df = spark.range(0, 5000).select(
        (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("seq"))
    got = grp.position_in_group(df, ["g"], "seq", "pos")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("seq")) - 1)
    assert got.select("g", "seq", "pos").exceptAll(want.select("g", "seq", "pos")).count() == 0
    assert got.count() == 5000


def test_position_in_group_many_slices_one_hot_group(spark):
    # one group holds most rows; many partitions so slicing is exercised
    df = spark.range(0, 200_000, numPartitions=16).select(
        F.when(F.col("id") % 10 == 0, F.lit(1)).otherwise(F.lit(0)).alias("g"),
        (F.xxhash64("id") % 1_000_000_007).alias("seq"))
    got = grp.position_in_group(df, ["g"], "seq", "pos", rows_per_slice=3000)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("seq", F.monotonically_increasing_id())) - 1)
    agg = got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"),
                               F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()
    for r in agg:
        assert r["d"] == r["n"] and r["lo"] == 0 and r["hi"] == r["n"] - 1
    # order respected: pos increases with seq inside each group (distinct seq values)
    distinct_seq = df.groupBy("g", "seq").count().where("count = 1").select("g", "seq")
    g2 = got.join(distinct_seq, ["g", "seq"])
    w2 = want.join(distinct_seq, ["g", "seq"])
    assert g2.select("g", "seq", "pos").exceptAll(w2.select("g", "seq", "pos")).count() == 0
