"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a session on one machine (tests) gets a temporary one; on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables below one fresh folder; a table survives lost executors, unlike a local checkpoint.

    Tables that only later steps of an operator read are dropped by it; those that its lazy result reads stay until
    ``release``, which a caller may call when it has written what it wants.
    """

    #: Folders in use.
    folders: list[str] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", []
        self.folders.append(self.at)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back."""
        df.write.option("compression", "zstd").parquet(f"{self.at}/{name}")
        self.made.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        if name in self.made:
            self.made.remove(name)
            _delete(self.spark, f"{self.at}/{name}")

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        for name in [x for x in self.made if x not in names]:
            self.drop(name)


def release(spark: SparkSession) -> None:
    """Delete all tables of all operators that ran so far: their results can't be read any more."""
    while Scratch.folders:
        _delete(spark, Scratch.folders.pop())


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
