"""Session and table helpers shared by every query."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    spark = (
        SparkSession.builder.master(master)
        .appName("postsieve")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POSTSIEVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to all cores if it has fewer splits than there are cores.

    For operators that spend much time on a row. A large table has more splits
    than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < cores else df


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns that leaves their computation below it.

    The optimizer would push the condition down with a copy of every expression
    it refers to; a cheap column that is not deterministic stops that.
    """
    return df.withColumn("_fence", F.monotonically_increasing_id()).where(condition & (F.col("_fence") >= 0)).drop("_fence")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir.

    A folder of our own is made only in local mode, where there is one machine (tests);
    on a cluster a session that names none is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="postsieve-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new name below the shared folder, for what a query writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the position of each row in the global order, from one: ranges are sorted apart, their sizes give each its offset."""
    d = cut_lineage(df.repartitionByRange(order).sortWithinPartitions(order)).withColumn("_at", F.monotonically_increasing_id())
    sizes = d.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row per partition
    d = d.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")
    return d.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")
