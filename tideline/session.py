"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"


def build_session(app_name: str = "tideline", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the benchmark use; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app_name)
        .master(f"local[{cpus or '*'}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus or 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one stands in only where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINT_DIR


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back, which cuts lineage and survives lost executors."""
    return _write(df, f"{checkpoint_root(df.sparkSession)}/tideline/{name}-{uuid.uuid4().hex}")


class Scratch:
    """A folder of intermediate tables below the shared folder; they go when the ``with`` block ends.

    What leaves the block has to be written by ``materialize``, as a result is only computed when it is read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.folder = f"{checkpoint_root(spark)}/tideline/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        return _write(df, f"{self.folder}/{self.count}-{name}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
