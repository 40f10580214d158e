"""Tables that a driver loop writes and reads again, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def kept(df: DataFrame) -> DataFrame:
    """df written once and read again: its lineage ends, and a lost executor costs nothing."""
    path = f"{folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """kept, in a folder of one run; tables that are no longer read can be dropped, and go with the run if it fails."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{folder(spark)}/run-{uuid.uuid4().hex}"
        self.held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Store:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind:
            self._delete(self.path)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{len(self.held)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables of this store; others, and None, are left alone."""
        for k, (df, path) in enumerate(self.held):
            if path and any(df is t for t in tables):
                self._delete(path)
                self.held[k] = (df, "")

    def drop_but(self, *tables: DataFrame | None) -> None:
        self.drop(*(df for df, _ in self.held if not any(df is t for t in tables)))

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
