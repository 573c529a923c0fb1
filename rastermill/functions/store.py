"""Input tables, and tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


class Scratch:
    """A fresh subfolder of the shared one; `release` deletes it, at the latest when Python ends.

    What reads a saved table reads its files, so release only once results
    made from them are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.release)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return a reader of it, so that lost executors cost no recomputation."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"  # a name may come again
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        atexit.unregister(self.release)
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        except Exception:  # the session has ended: only a local folder can still be reached
            if self.path.startswith("file://"):
                shutil.rmtree(self.path.removeprefix("file://"), ignore_errors=True)
