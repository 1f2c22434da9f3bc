"""Written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _folder(context: SparkContext) -> None:
    """Set the checkpoint folder where none is set.

    It is the one that ``spark.checkpoint.dir`` names.  Where nothing is set, a temporary folder serves executors that are threads
    of this process; on a cluster that is an error.
    """
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[0-9*, ]+\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut; rows keep their partition and order."""
    _folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


class Written:
    """Tables in a folder of their own under the checkpoint folder: compressed, read column by column, and gone when no longer needed."""

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        _folder(context)
        self.spark, self.base = spark, f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """``df`` as a table, a partition for each value of its column ``by``."""
        df.write.partitionBy(by).option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def drop(self, name: str, partition: str) -> None:
        """Delete one partition, such as ``flag=true``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}/{partition}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
