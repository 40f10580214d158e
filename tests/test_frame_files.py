import os

import pytest
from pyspark.sql import functions as F

from phasemill.sources import frame_files

SCHEMA = "fid long, re array<double>, im array<double>"


def _frames(spark, fids):
    return spark.createDataFrame([(k,) for k in fids], "fid long").select("fid", F.array(F.col("fid") * 1.5, F.lit(0.1)).alias("re"), F.array(F.lit(0.0), F.col("fid") * -1.0).alias("im"))


def _rows(df):
    return sorted((r.fid, r.re, r.im) for r in df.select("fid", "re", "im").collect())


def test_round_trip_by_ranges(spark, tmp_path):
    frame_files.register(spark)
    given, path = _frames(spark, range(100)), f"file://{tmp_path}/a"
    given.repartitionByRange(5, "fid").write.format("frames").mode("append").save(path)
    files = frame_files.listed(path)
    assert len(files) == 5 and sum(x["rows"] for x in files) == 100 and all(a["high"] < b["low"] for a, b in zip(files, files[1:]))
    back = spark.read.format("frames").load(path)
    assert back.rdd.getNumPartitions() == 5 and _rows(back) == _rows(given)
    assert _rows(back.filter("fid > 90 OR fid = 3")) == _rows(given.filter("fid > 90 OR fid = 3"))
    assert back.select("fid").agg(F.sum("fid")).first()[0] == 4950
    given.limit(0).write.format("frames").mode("append").save(path)
    _frames(spark, [500]).write.format("frames").mode("append").save(path)
    assert spark.read.format("frames").load(path).count() == 101
    _frames(spark, [7]).write.format("frames").mode("overwrite").save(path)
    assert [r[0] for r in _rows(spark.read.format("frames").load(path))] == [7]
    assert sorted(os.listdir(tmp_path / "a")) == sorted([frame_files.MANIFEST, frame_files.listed(path)[0]["file"]])


def test_filters_leave_out_files(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual
    from pyspark.sql.types import StructType

    path = f"file://{tmp_path}"
    (tmp_path / frame_files.MANIFEST).write_text('[{"file": "a", "low": 0, "high": 9}, {"file": "b", "low": 10, "high": 19}, {"file": "c", "low": 20, "high": 29}]')

    def left(*filters):
        reader = frame_files.Reader(path, StructType.fromDDL(SCHEMA))
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [p.file for p in reader.partitions()]

    assert left() == ["a", "b", "c"]
    assert left(GreaterThan(("fid",), 9)) == ["b", "c"] and left(GreaterThan(("fid",), 9), LessThanOrEqual(("fid",), 19)) == ["b"]
    assert left(EqualTo(("fid",), 25)) == ["c"] and left(In(("fid",), (3, 22))) == ["a", "c"] and left(EqualTo(("re",), 1.0)) == ["a", "b", "c"]


def test_failed_writes_leave_no_manifest(spark, tmp_path):
    frame_files.register(spark)
    path = f"file://{tmp_path}/b"
    with pytest.raises(Exception, match="fid"):
        _frames(spark, [1, 2, None, 4]).coalesce(1).write.format("frames").mode("append").save(path)
    assert frame_files.listed(path) == []
    assert spark.read.format("frames").load(path).count() == 0
    with pytest.raises(Exception, match="no fid"):
        spark.range(3).write.format("frames").mode("append").save(path)


def test_other_columns(spark, tmp_path):
    frame_files.register(spark)
    given = spark.createDataFrame([(2, [1.0, 2.0], "x"), (1, None, None)], "fid long, intensity array<double>, note string")
    given.write.format("frames").mode("append").save(f"file://{tmp_path}/c")
    back = spark.read.format("frames").schema("fid long, intensity array<double>").load(f"file://{tmp_path}/c")
    assert sorted(map(tuple, back.collect())) == [(1, None), (2, [1.0, 2.0])]
