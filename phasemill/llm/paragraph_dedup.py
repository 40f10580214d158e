"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, removal by components.

A paragraph is a line with enough words. Bands are tuned so that a pair at the least
similarity is missed with a given small probability; colliding paragraphs are joined, their
shingle sets compared exactly, and in each component of links all but the first paragraph,
by document and line, are removed.

repeated_passages takes every line with a word as a paragraph, and besides the blocks of
adjacent short lines, so that passages wrapped into lines are compared as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm import words as W
from phasemill.llm.odd_sketch import Plan, near_duplicates

_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def tuned(percent: int, rows: int, miss: float) -> int:
    """Bands of so many rows with which a pair at the similarity collides nowhere with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def paragraphs(docs: DataFrame, text: str, key: str, least_words: int) -> DataFrame:
    """id (doc, line), text of the lines with so many words; lines count from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in W.blocks(batch.column(1)):
                starts, ends, bounds = W.segment(data, offsets, W.SPACED)
                feeds = np.flatnonzero(data == 10)
                l_starts, l_ends, l_bounds = W.segment(data, offsets, _LINE)
                long = np.flatnonzero(np.searchsorted(starts, l_ends) - np.searchsorted(starts, l_starts) >= least_words)
                row = np.searchsorted(l_bounds, long, side="right") - 1
                number = np.searchsorted(feeds, l_starts[long]) - np.searchsorted(feeds, offsets[row])
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(l_starts[long].tolist(), l_ends[long].tolist(), strict=True)]
                keys = batch.column(0).take(pa.array(first + row))
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([keys, pa.array(number.astype(np.int64))], names=["doc", "line"]), pa.array(texts, pa.string())], names=["id", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).filter(F.col(key).isNotNull()).mapInArrow(W.tidy(cut), f"id struct<doc:{kind},line:long>, text string")


def repeated_paragraphs(docs: DataFrame, text: str = "text", key: str = "doc_id", least_words: int = 20, shingle: int = 5, percent: int = 80, rows: int = 3, miss: float = 1e-4) -> DataFrame:
    """(doc, line, first_doc, first_line, kept) of each paragraph: the first of its component; kept where it is that itself.

    Links: paragraphs with 100 * shared >= percent * all distinct shingles. Rows with a null key or
    text have no paragraphs. Rows given twice are one; different texts of one key share their line
    numbers. Lines and texts of any length are read whole; other columns are not read.
    """
    plan = Plan(shingle=shingle, percent=percent, bands=tuned(percent, rows, miss), rows=rows, samples=64, bits=256, slack=0.3, short=True)
    found = near_duplicates(paragraphs(docs, text, key, least_words), "text", "id", plan)
    return found.select(F.col("id.doc").alias("doc"), F.col("id.line").alias("line"), F.col("component_id.doc").alias("first_doc"), F.col("component_id.line").alias("first_line"), "kept").distinct()


def paragraph_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """One row per row of docs: key, n_paragraphs, n_removed, removed_lines and first_docs (both sorted lists, empty for none).

    first_docs: the documents that keep the first of what is removed. Null, empty and short texts and
    null keys have no paragraphs. See repeated_paragraphs for the rest. No rows give no rows.
    """
    found = repeated_paragraphs(docs, text, key, **limits)
    gone = ~F.col("kept")
    each = found.groupBy(F.col("doc").alias(key)).agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if(gone).alias("n_removed"),
        F.array_sort(F.collect_set(F.when(gone, F.col("line")))).alias("removed_lines"),
        F.array_sort(F.collect_set(F.when(gone, F.col("first_doc")))).alias("first_docs"),
    )
    kind = docs.schema[key].dataType.simpleString()
    zero, none = F.lit(0).cast("long"), F.array()
    return docs.select(key).join(each, key, "left").select(key, F.coalesce("n_paragraphs", zero).alias("n_paragraphs"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("removed_lines", none.cast("array<long>")).alias("removed_lines"), F.coalesce("first_docs", none.cast(f"array<{kind}>")).alias("first_docs"))


def passages(docs: DataFrame, text: str, key: str, short: int) -> DataFrame:
    """id (doc, line, last), text of the lines with a word (line = last) and of the blocks of two or more adjacent lines under so many words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in W.blocks(batch.column(1)):
                starts, _, _ = W.segment(data, offsets, W.SPACED)
                feeds = np.flatnonzero(data == 10)
                l_starts, l_ends, l_bounds = W.segment(data, offsets, _LINE)
                count = np.searchsorted(starts, l_ends) - np.searchsorted(starts, l_starts)
                some = np.flatnonzero(count)
                row = np.searchsorted(l_bounds, some, side="right") - 1
                number = np.searchsorted(feeds, l_starts[some]) - np.searchsorted(feeds, offsets[row])
                brief = count[some] < short
                joined = brief[1:] & brief[:-1] & (row[1:] == row[:-1]) & (number[1:] == number[:-1] + 1)
                edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
                heads, tails = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                every = np.arange(len(some))
                a, b = np.concatenate([every, heads]), np.concatenate([every, tails])
                raw = data.tobytes()
                texts = [raw[x:y].decode() for x, y in zip(l_starts[some[a]].tolist(), l_ends[some[b]].tolist(), strict=True)]
                keys = batch.column(0).take(pa.array(first + row[a]))
                ids = pa.StructArray.from_arrays([keys, pa.array(number[a].astype(np.int64)), pa.array(number[b].astype(np.int64))], names=["doc", "line", "last"])
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["id", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).filter(F.col(key).isNotNull()).mapInArrow(W.tidy(cut), f"id struct<doc:{kind},line:long,last:long>, text string")


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", short: int = 20, shingle: int = 5, percent: int = 80, rows: int = 3, miss: float = 1e-4) -> DataFrame:
    """(doc, line, last, first_doc, first_line, first_last, kept) of each line with a word and each block of short lines.

    Links as in repeated_paragraphs, with no least length: a passage of fewer words than a shingle is
    one shingle. A block may be linked with a line that holds the same words unwrapped. A block and
    its own lines are judged apart.
    """
    plan = Plan(shingle=shingle, percent=percent, bands=tuned(percent, rows, miss), rows=rows, samples=64, bits=256, slack=0.3, short=True)
    found = near_duplicates(passages(docs, text, key, short), "text", "id", plan)
    first = [F.col(f"component_id.{c}").alias(f"first_{c}") for c in ("doc", "line", "last")]
    return found.select("id.doc", "id.line", "id.last", *first, "kept").distinct()


def without_lines(text: str, removed: str):
    """The text without the lines of the given numbers, as a column."""
    lines = F.split(F.col(text), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains(removed, i.cast("long")), F.lit(None)).otherwise(x)), lambda x: x.isNotNull()), "\n")
