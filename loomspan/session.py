"""Sessions and shared storage.

Everything that must outlive an executor goes to the folder a cluster names in
``spark.checkpoint.dir``. A private folder is made only where that is unset and driver and
executors are one process (tests); on a cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "loomspan", cores: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a private one only in local mode, if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomspan-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loomspan/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage is cut by
    files that every executor sees. Returns the frame and its path, for :func:`release`.

    zstd: its streams free their buffers when they close, where those of the default codec stay
    outside the heap until a collection comes."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


class Scratch:
    """The scratch tables of one job; what its result no longer reads goes when the job is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        out, path = materialize(df, label)
        self.held.append((out, path))
        return out

    def release(self, *still_read: DataFrame) -> None:
        kept = [h for h in self.held if any(h[0] is df for df in still_read)]
        release(self.spark, *[path for df, path in self.held if not any(df is k for k, _ in kept)])
        self.held = kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; read by Spark alone, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
