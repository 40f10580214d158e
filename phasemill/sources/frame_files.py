"""Frames in files of fid ranges, as a Spark data source named "frames".

A folder holds Arrow files, one for each task that wrote some, and a manifest that names them with
their smallest and largest fid. Files of tasks that failed or ran twice are not in the manifest.
Filters on fid leave out whole files before any is opened. Paths are URIs that Arrow's file systems
know (file, s3, gs, hdfs); where only Spark reaches a store, Parquet tables are the way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from phasemill.operators import dense

MANIFEST = "manifest.json"


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its Python sources have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameFiles)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(path: str) -> list[dict]:
    """The files of a folder: name, low, high and rows of each; none where nothing was written."""
    system, at = _opened(path)
    if system.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


class FrameFiles(DataSource):
    """Rows with a fid, by default (fid, re, im); another schema is given to read and write."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return dense.SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


@dataclass
class FilePart(InputPartition):
    file: str


class Reader(DataSourceReader):
    """One partition a file whose range of fids may hold what is asked for."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.fields = path, to_arrow_schema(schema)
        self.low, self.high = -(1 << 63), (1 << 63) - 1
        self.some: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of fid to leave out files; Spark still applies all filters to rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("fid",):
                if isinstance(f, In):
                    self.some = set(f.value) if self.some is None else self.some & set(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[FilePart]:
        inside = lambda x: x["low"] <= self.high and x["high"] >= self.low and (self.some is None or any(x["low"] <= v <= x["high"] for v in self.some))
        return [FilePart(x["file"]) for x in listed(self.path) if inside(x)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if partition is None or not getattr(partition, "file", None):
            return
        system, at = _opened(self.path)
        with system.open_input_file(f"{at}/{partition.file}") as f, pa.ipc.open_file(f) as stored:
            for k in range(stored.num_record_batches):
                yield stored.get_batch(k).select(self.fields.names).cast(self.fields)


@dataclass
class Written(WriterCommitMessage):
    entry: dict | None


class Writer(DataSourceArrowWriter):
    """A file a task under a name of its own; the manifest of the files that count is written last."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.fields, self.overwrite = path, to_arrow_schema(schema), overwrite
        if "fid" not in schema.names:
            raise ValueError("rows have no fid")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        name, low, high, rows, out = f"{uuid.uuid4().hex}.arrow", None, None, 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    sink = system.open_output_stream(f"{at}/{name}")
                    out = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                fids = batch.column(batch.schema.get_field_index("fid"))
                if fids.null_count:
                    raise ValueError("a fid is null")
                fids = fids.to_numpy()
                low, high = min(int(fids.min()), fids.max() if low is None else low), max(int(fids.max()), fids.min() if high is None else high)
                rows += batch.num_rows
                out.write_batch(batch)
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(None if out is None else {"file": name, "low": int(low), "high": int(high), "rows": rows})

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        old = listed(self.path)
        entries = [m.entry for m in messages if m is not None and m.entry]
        kept = entries if self.overwrite else old + entries
        with system.open_output_stream(f"{at}/{MANIFEST}.new") as f:
            f.write(json.dumps(sorted(kept, key=lambda x: (x["low"], x["file"]))).encode())
        system.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        if self.overwrite:
            for x in old:
                system.delete_file(f"{at}/{x['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _opened(self.path)
        for m in messages:
            if m is not None and m.entry:
                system.delete_file(f"{at}/{m.entry['file']}")
