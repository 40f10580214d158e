"""Texts of megabytes, in tables whose other columns have the names of results."""

from pyspark.sql import functions as F

from phasemill.llm import backoff_lm, odd_sketch, paragraph_dedup, positional_index, repetition

from . import helpers as H

LONG = "\n".join(H.prose(k, 400, 3000) for k in range(300))  # 120,000 words


def _table(spark):
    item = H.prose(901, 20, 3000)
    rows = [(1, LONG, "a"), (2, LONG.replace("\n", " ", 7) + " end", "a"), (3, H.prose(400, 90, 3000) + "\n" + LONG.split("\n")[5], "b"), (4, f"{LONG} {item}", "b"), (5, None, None)]
    clash = {c: F.lit(f"{c}!") for c in ("n_shingles", "component_id", "kept", "items", "n_words", "spans", "first_doc", "_key", "held_out", "score", "bucket")}
    return H.docs(spark, rows).withColumns(clash), item


def test_long_texts(spark):
    table, item = _table(spark)
    got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(table).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in positional_index.contamination(table, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert found[4] == (120_020, 20, ["7"], False) and found[1][1:] == (0, [], False) and found[5][0] == 0
    lines = {(r.doc, r.line): (r.first_doc, r.first_line) for r in paragraph_dedup.repeated_paragraphs(table).collect()}
    assert lines[3, 1] == (1, 5) and lines[4, 299] == (1, 299) and lines[1, 200] == (1, 200)
    measured = {r.doc_id: (r.n_words, r.n_lines) for r in repetition.repetition_coverage(table).collect()}
    assert measured[1] == (120_000, 300) and measured[5] == (0, 0)
    scored = {r.doc_id: (r.n_tokens, r.held_out) for r in backoff_lm.scores(table, order=2).collect()}
    assert scored[1][0] == 120_001 and scored[5][0] == 1
