"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of applications on one machine that name none.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a new folder of this application, on one machine only.

    On a cluster an unset folder raises ValueError: executors would not see each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="spark-")
        _OWN[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there: its lineage ends, and a lost executor costs nothing."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Work:
    """The intermediate tables of one run of an operator, in a folder of its own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.made = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def settled(self, df: DataFrame, name: str) -> DataFrame:
        """As settled, within this folder."""
        self.made += 1
        path = f"{self.path}/{self.made}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def concluded(self, df: DataFrame, name: str) -> DataFrame:
        """df settled outside; the tables of this run are deleted then."""
        out = settled(df, name)
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        return out


def pieces(df: DataFrame, column: str, bytes_each: int = 8_000_000, least: int = 12) -> int:
    """How many partitions df's column needs at bytes_each; one pass over its lengths."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return int(max(least, -(-total // bytes_each)))
