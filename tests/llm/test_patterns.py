"""Texts of patterned bytes, which collide in polynomial hashes modulo 2^64, are told apart."""

import zlib

from phasemill.llm import backoff_lm, odd_sketch, positional_index, repetition

from . import helpers as H
from .test_words import morse

X, Y = morse(2048)


def test_repeated_lines(spark):
    rows = [(1, f"{X} a\n{Y} a\n{X} a", "s"), (2, f"{X} b {X} c {Y} b {Y} c", "s")]
    got = {r.doc_id: r for r in repetition.repetition_coverage(H.docs(spark, rows)).collect()}
    assert (got[1].n_dup_lines, got[1].n_words, got[2].n_repeat_words) == (1, 6, 0)


def test_near_duplicates(spark):
    rows = [(1, f"{X} one two three", "s"), (2, f"{Y} one two three", "s"), (3, X, "s"), (4, Y, "s"), (5, f"{X}  one two three", "s")]
    got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(H.docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_benchmark_items(spark):
    docs, items = H.docs(spark, [(1, X, "s"), (2, f"a {Y} b", "s")]), spark.createDataFrame([(1, Y), (2, f"{X} c")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in positional_index.contamination(docs, items).collect()}
    assert got == {1: (0, [], False), 2: (1, ["1"], True)}


def test_known_words(spark):
    keys = [k for k in range(40) if zlib.crc32(str(k).encode()) % 10][:3]
    held = next(k for k in range(40) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(k, f"{X} word", "s") for k in keys] + [(held, f"{Y} word {X}", "s")]
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in backoff_lm.scores(H.docs(spark, rows)).collect()}
    assert got[held] == (4, 3) and got[keys[0]] == (3, 3)
