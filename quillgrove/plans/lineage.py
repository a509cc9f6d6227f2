"""Results that later steps read more than once."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir, which all executors share.

    Model replies are asked for once, and the plan stays small. Only a local session that names no
    folder gets a temporary one; on a cluster, whose executors would not see it, that is an error.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="quillgrove-"))
    return context.getCheckpointDir()


class Rounds:
    """Tables of a loop as Parquet in the same folder: put() writes one, drop() deletes those that no later round reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame, *by: str, name: str = "") -> DataFrame:
        """df written and reread; `by`: a folder for each value of these columns, so that a filter on them reads no others."""
        self.made += 1
        path = f"{self.root}/{name or self.made}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def every(self, name: str, schema) -> DataFrame:
        """All tables put under name/..., as one."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def drop(self, *numbers: int) -> None:
        """Deletes the tables of these numbers (put()'s count), and has Spark delete the shuffle files of what is gone."""
        jvm = self.spark.sparkContext._jvm
        for k in numbers:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{k}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()
