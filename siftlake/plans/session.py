"""Session settings and the few helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", app: str = "siftlake", memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, skew joins)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.sql.shuffle.partitions", "8")  # local only: a cluster's own setting holds in its session
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """The parquet table `name` under `base`, pruned to `columns` when given."""
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one set, or the one the cluster names in spark.checkpoint.dir.

    Only a local session, where driver and executors share one disk, may do without; a cluster must name a folder.
    """
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith(("local[", "local-cluster[")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="siftlake-"))
    return spark.sparkContext.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for the tables of one operator, below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and written as a table to the shared folder, with the lineage cut.

    A table and not a checkpoint: a checkpoint keeps the size estimates of its plan, which a loop of joins multiplies with
    every round until planning takes longer than the work.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "cut")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Input of one large file in few splits, dealt to as many tasks as there are cores before costly Python work."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
