"""Session helpers: a local session for tests, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session in UTC, as tests and the benchmark use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillspark-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one the cluster names in spark.checkpoint.dir. Raises ValueError where that is unset: a folder of one
    machine would do in local mode alone, and local_session names one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return conf.rstrip("/")


class Kept:
    """Tables of one operator call, written under the shared folder and read back.

    Writing cuts the lineage at a place that survives the loss of executors. An operator drops what its result doesn't read;
    the tables that its lazy result does read belong to the caller, who closes the Kept that was handed in once the result is
    written. As a context it closes itself.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Remove tables that nothing lazy needs any more."""
        for df in dfs:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._kept_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Remove all tables of this call; what reads them lazily can't be run again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()
