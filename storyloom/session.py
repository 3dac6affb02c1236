"""Spark session helpers.

The library never creates a session behind the user's back: every operator
takes DataFrames.  These helpers exist for tests, the bench and the entry
module, and for the few places that need a shared folder (lineage cuts).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "storyloom") -> SparkSession:
    """Session for tests / local runs: AQE on, UI off, UTC, Arrow on."""
    builder = (
        SparkSession.builder
        .master(master or os.environ.get("STORYLOOM_MASTER", "local[8]"))
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STORYLOOM_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder.  Only a
    local master, whose executor is the driver, gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="storyloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    read it back: one job, a fresh plan (a leaf scan with real statistics for
    AQE), and data that survives the loss of any executor.  Iterative loops
    call this every step so plans never grow with the number of steps, and
    ``forget`` the table of the step before.
    """
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._scratch_path = path
    return out


def cut_and_swept(df):
    """``cut_lineage`` whose shuffle files go as soon as the table is written, not
    when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(key, before)


def bucketed(df, keys, n: int):
    """``df`` as a table of ``n`` buckets by ``keys`` in the checkpoint folder: reads
    that group by the keys need no shuffle.  ``forget`` deletes it."""
    import uuid
    name = f"storyloom_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
    out = df.sparkSession.table(name)
    out._scratch_path, out._scratch_table = path, name
    return out


def dealt(df, *keys):
    """``df`` by ``keys`` in as many tasks as the session shuffles into.  For groups
    that are small and costly: the engine would merge them by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def forget(df) -> None:
    """Delete the table of a ``cut_lineage`` result that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        if hasattr(df, "_scratch_table"):
            spark.sql(f"DROP TABLE IF EXISTS {df._scratch_table}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
