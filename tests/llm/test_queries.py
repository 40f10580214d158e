"""Registered queries against their SQL, and the pipeline against plain Python."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from phasemill.llm import queries as Q

from . import helpers as H
from .test_copies import _removed

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.ORACLES[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    columns = ", ".join(sorted(got.columns))
    rows = con.execute(f"SELECT {columns} FROM ({Q.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(sorted(got.columns)).collect()))) == sorted(map(repr, rows))


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in Q.QUERIES} == set(range(1, 14))


def _corpus():
    """Texts with planted toxic words, near copies, repeated passages and benchmark items, and what they are."""
    item = H.prose(900, 16, 3000)
    rows = [(k, H.prose(k, 70, 3000) + (f" stupid {H.prose(k + 500, 5)} idiot" if k % 5 == 0 else ""), f"s{k % 3}") for k in range(400)]
    rows += [(1000 + k, " ".join(w if i != 20 else "edit" for i, w in enumerate(H.prose(k + 1, 70, 3000).split())), "s1") for k in range(0, 60, 5)]
    passage = H.prose(901, 55, 3000)
    rows += [(2000 + k, f"{H.prose(3000 + k, 60, 3000)}\n{passage}\n{H.prose(4000 + k, 60, 3000)}", "s2") for k in range(6)]
    rows += [(3000, H.prose(5000, 40, 3000) + " " + item, "s0"), (3001, H.prose(5001, 900, 3000) + " " + item, "s0"), (3002, None, "s0"), (3003, "", None)]
    return rows, item


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, item = _corpus()
    H.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int("idiot" in (t or ""))) for k, t, _ in rows if k < 1000], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {k: t for k, t, _ in rows if not (k < 1000 and k % 5 == 0)}
    lead = H.classes([(k, H.shingles(t, 4)) for k, t in left.items()])
    left = {k: t for k, t in left.items() if lead[k] == k}
    removed = _removed((k, t or "") for k, t in left.items())
    assert any(r[1] for r in removed.values())
    phrase = item.split()
    assert 3000 in left and len(phrase) == 16
    left.pop(3000)
    assert set(got) == set(left)
    for k, r in got.items():
        assert len((r.text or "").encode()) == removed[k][0] - removed[k][1] and r.n_chars == (len(r.text) if r.text is not None else None)
    places = sorted((r.slot, r.offset) for r in got.values())
    assert len(set(places)) == len(places)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "repeated_bytes", "decontamination", "mixing"]
    clash = ["spans", "kept_text", "slot", "n_bytes", "_row", "_whole", "score", "predicted", "contaminated", "component_id", "kept", "block", "a.b"]
    odd = docs.limit(40).withColumns({c: F.lit(f"{c}!") for c in clash})
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, odd):
            out = stage(spark, table.limit(0), str(tmp_path))
            assert out.count() == 0 and (n == 4 or out.columns == table.columns)
        out = stage(spark, odd, str(tmp_path))
        name = lambda c: f"documents_{c}" if n == 4 and c in ("slot", "n_bytes", "block") else c
        rows = out.collect()
        assert rows and all(r[name(c)] == f"{c}!" for r in rows for c in clash)


def test_pipeline_judges_each_row(spark, tmp_path):
    """Rows without doc_id take part, rows of one doc_id are judged one by one, a row given twice stays once."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, item = _corpus()
    passage = H.prose(901, 55, 3000)
    toxic = H.prose(6000, 70, 3000) + f" stupid {H.prose(6001, 5)} idiot"
    clean, twice, copied, other = (H.prose(s, 70, 3000) for s in (6002, 6003, 1, 6006))
    holds = f"{H.prose(6004, 60, 3000)} {passage} {H.prose(6005, 60, 3000)}"
    items = [item, H.prose(6008, 16, 3000), H.prose(6009, 16, 3000)]
    leaks = [f"{H.prose(6010 + k, 40, 3000)} {items[k]}" for k in (1, 2)]
    rows += [(None, toxic, "n1"), (None, clean, "n2"), (8000, toxic, "n3"), (8000, clean + " more", "n4"), (8001, twice, "n5"), (8001, twice, "n5"), (None, copied, "n6"), (None, holds, "n7"), (None, leaks[0], "n8"), (8002, leaks[1], "n9"), (8002, other, "n10"), (None, None, "n11")]
    H.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, int("idiot" in (t or ""))) for k, t, _ in rows if k is not None and k < 1000], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if (r.source or "").startswith("n")]
    assert sorted((r.source, r.doc_id) for r in got) == [("n10", 8002), ("n11", None), ("n4", 8000), ("n5", 8001), ("n7", None)]
    (short,) = (r for r in got if r.source == "n7")
    assert passage not in short.text and len(short.text) < len(holds)
