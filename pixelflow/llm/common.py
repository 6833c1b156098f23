"""Shared folder, materialised tables and broadcasts for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pixelflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def new_path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back."""
        path = self.new_path(name)
        df.write.parquet(path)
        # nothing refers to the finished job's shuffles now; a collection on the driver lets Spark's cleaner delete their files
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def collect_shuffles(self) -> None:
        """Let the cleaner delete the last job's shuffles too: its plan is held until its end has been told to all listeners."""
        context = self.spark.sparkContext
        context._jsc.sc().listenerBus().waitUntilEmpty()
        context._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(d)
                path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
