"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document: each segment of consecutive documents holds its own
dictionary of term hashes and, per term, the sorted positions at which it stands. A phrase
is found by intersecting the offset-adjusted lists of its terms, the rarest first, so no
posting is ever shuffled; only the phrases travel, broadcast in slices of a bounded size.
The index is written once, with a number for each row, and every slice reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm import words as W
from phasemill.llm.shared import Work

#: Text of a segment of the index.
SEGMENT_BYTES = 1_000_000
#: Words of a phrase that must match in order.
WINDOW = 13
#: Bytes of benchmark text in a slice; each slice is broadcast and takes one pass over the index.
SLICE_BYTES = 2_000_000
INDEX = "keys binary, word_bounds binary, terms binary, term_bounds binary, postings binary"


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per segment of about 1 MB of text: every token of every document as a posting.

    keys: the documents' keys as Arrow IPC; word_bounds: their first words within the segment; terms: sorted
    hashes; term_bounds, postings: each term's sorted word positions. Null and empty texts are
    documents without words. Write the result as Parquet to keep the index.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(1), SEGMENT_BYTES):
                lowered = W.LOWER[data]
                starts, ends, bounds = W.segment(lowered, offsets, W.ALNUM)
                hashes = W.span_hashes(lowered, starts, ends)
                order = np.argsort(hashes, kind="stable").astype(np.int32)
                ordered = hashes[order]
                new = np.ones(len(ordered), dtype=bool)
                new[1:] = ordered[1:] != ordered[:-1]
                at = np.flatnonzero(new)
                keys = pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first)], names=["key"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, keys.schema) as out:
                    out.write_batch(keys)
                parts = [sink.getvalue().to_pybytes(), bounds.astype(np.int64), ordered[at], np.append(at, len(ordered)).astype(np.int64), order]
                yield pa.RecordBatch.from_arrays([pa.array([p if isinstance(p, bytes) else p.tobytes()], pa.binary()) for p in parts], names=["keys", "word_bounds", "terms", "term_bounds", "postings"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(W.tidy(build), INDEX)


@dataclass
class Phrases:
    """Distinct windows of a slice of items: hashes of their terms, 0 beyond their length, and the items that hold each."""

    terms: np.ndarray
    length: np.ndarray
    item_bounds: np.ndarray
    items: list[str]


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """An item with fewer words, but not none, is one window; items without words or id have none."""
    rows: dict[bytes, set[str]] = {}
    for item, text in items:
        data = W.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
        starts, ends, _ = W.segment(data, np.array([0, len(data)]), W.ALNUM)
        hashes = W.span_hashes(data, starts, ends)
        if not len(hashes) or item is None:
            continue
        for i in range(max(1, len(hashes) - window + 1)):
            rows.setdefault(hashes[i : i + window].tobytes(), set()).add(str(item))
    terms = np.zeros((len(rows), window), dtype=np.uint64)
    length = np.zeros(len(rows), dtype=np.int64)
    for n, held in enumerate(rows):
        got = np.frombuffer(held, dtype=np.uint64)
        terms[n, : len(got)] = got
        length[n] = len(got)
    flat = [i for held in rows.values() for i in sorted(held)]
    return Phrases(terms, length, np.cumsum([0, *map(len, rows.values())]), flat)


class Segment:
    """One row of the index, opened for search."""

    def __init__(self, row: dict) -> None:
        self.keys = pa.ipc.open_stream(row["keys"]).read_next_batch().column(0)
        self.bounds = np.frombuffer(row["word_bounds"], dtype=np.int64)
        self.terms = np.frombuffer(row["terms"], dtype=np.uint64)
        self.ends = np.frombuffer(row["term_bounds"], dtype=np.int64)
        self.postings = np.frombuffer(row["postings"], dtype=np.int32)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First posting and number of postings of each term."""
        if not len(self.terms):
            return np.zeros(terms.shape, dtype=np.int64), np.zeros(terms.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return np.where(there, self.ends[at], 0), np.where(there, self.ends[at + 1] - self.ends[at], 0)

    def holds(self, first: np.ndarray, count: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the posting lists (first, count) have the positions: a binary search in all lists at once."""
        low, high = first.copy(), first + count
        while len(low) and (open_ := low < high).any():
            mid = (low + high) >> 1
            less = np.zeros(len(low), dtype=bool)
            less[open_] = self.postings[mid[open_]] < position[open_]
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        out = low < first + count
        out[out] = self.postings[low[out]] == position[out]
        return out

    def exact(self, asked: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence that lies in one document."""
        first, count = self.find(asked.terms)
        used = np.arange(asked.terms.shape[1]) < asked.length[:, None]
        rank = np.where(used, count, np.iinfo(np.int64).max)
        live = np.flatnonzero((rank > 0).all(axis=1) & (asked.length > 0))
        order = np.argsort(rank[live], axis=1, kind="stable")  # rarest terms first
        rarest = order[:, 0]
        many = count[live, rarest]
        which = np.repeat(np.arange(len(live)), many)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        start = self.postings[first[live, rarest][which] + inner].astype(np.int64) - rarest[which]
        row = np.searchsorted(self.bounds, start, side="right") - 1
        ok = start >= 0
        ok[ok] &= start[ok] + asked.length[live[which[ok]]] <= self.bounds[row[ok] + 1]
        which, start = which[ok], start[ok]
        for k in range(1, asked.terms.shape[1]):
            on = asked.length[live[which]] > k
            term = order[which, k]
            ok = ~on
            ok[on] = self.holds(first[live[which[on]], term[on]], count[live[which[on]], term[on]], start[on] + term[on])
            which, start = which[ok], start[ok]
        return live[which], start

    def near(self, asked: Phrases, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) where all terms of the phrase stand among `width` words of one document, in any order."""
        first, count = self.find(asked.terms)
        used = np.arange(asked.terms.shape[1]) < asked.length[:, None]
        rank = np.where(used, count, np.iinfo(np.int64).max)
        live = np.flatnonzero((rank > 0).all(axis=1) & (asked.length > 0))
        order = np.argsort(rank[live], axis=1, kind="stable")
        many = count[live, order[:, 0]]
        which = np.repeat(np.arange(len(live)), many)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        at = self.postings[first[live, order[:, 0]][which] + inner].astype(np.int64)

        def among(which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Which rows have all their terms in the words [low, high)."""
            left = np.arange(len(which))
            for k in range(1, asked.terms.shape[1]):
                on = asked.length[live[which[left]]] > k
                term = order[which[left[on]], k]
                f, c = first[live[which[left[on]]], term], count[live[which[left[on]]], term]
                ok = np.ones(len(left), dtype=bool)
                ok[on] = self.rank_of(f, c, high[left[on]]) > self.rank_of(f, c, low[left[on]])
                left = left[ok]
            return left

        row = np.searchsorted(self.bounds, at, side="right") - 1
        low, high = self.bounds[row], self.bounds[row + 1]
        around = among(which, np.maximum(at - width + 1, low), np.minimum(at + width, high))
        which, at, low, high = which[around], at[around], low[around], high[around]
        found, where = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for back in range(width):  # every stretch of so many words that holds the rarest term
            begin = np.maximum(at - back, low)
            hit = among(which, begin, np.minimum(at - back + width, high))
            found.append(live[which[hit]])
            where.append(begin[hit])
            rest = np.setdiff1d(np.arange(len(which)), hit)
            which, at, low, high = which[rest], at[rest], low[rest], high[rest]
        return np.concatenate(found), np.concatenate(where)

    def rank_of(self, first: np.ndarray, count: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How many postings of each list lie before the position."""
        low, high = first.copy(), first + count
        while len(low) and (open_ := low < high).any():
            mid = (low + high) >> 1
            less = np.zeros(len(low), dtype=bool)
            less[open_] = self.postings[mid[open_]] < position[open_]
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low - first


def slices(items: DataFrame, item: str, text: str, most: int = SLICE_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The items in turn, in lists of at most about `most` bytes of text; one is held at a time."""
    held, size = [], 0
    for row in items.select(F.col(item).alias("a"), F.col(text).alias("b")).toLocalIterator():
        held.append((row.a, row.b))
        size += 100 + len((row.b or "").encode())
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def matches(index: DataFrame, asked: Broadcast, kind: str) -> DataFrame:
    """Per document of the index with a hit: the hit runs of words as (from, to) and the matched items."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg, wanted = Segment(row), asked.value
                phrase, start = seg.exact(wanted)
                end = start + wanted.length[phrase]
                order = np.lexsort((end, start))
                begin, reach = start[order], np.maximum.accumulate(end[order]) if len(order) else end
                doc = np.searchsorted(seg.bounds, begin, side="right") - 1
                new = np.ones(len(begin), dtype=bool)
                new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
                runs = np.flatnonzero(new)
                run_doc, run_from = doc[runs], begin[runs]
                run_to = reach[np.append(runs[1:], len(begin)) - 1] if len(runs) else run_from
                spans: dict[int, list[dict]] = {}
                for d, a, b in zip(run_doc.tolist(), (run_from - seg.bounds[run_doc]).tolist(), (run_to - seg.bounds[run_doc]).tolist(), strict=True):
                    spans.setdefault(d, []).append({"from": a, "to": b})
                found: dict[int, set[str]] = {d: set() for d in spans}
                at = np.searchsorted(seg.bounds, start, side="right") - 1
                for d, p in zip(at.tolist(), phrase.tolist(), strict=True):
                    found[d].update(wanted.items[wanted.item_bounds[p] : wanted.item_bounds[p + 1]])
                yield pa.RecordBatch.from_arrays([seg.keys.take(pa.array(list(spans), pa.int64())), pa.array(list(spans.values()), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array([sorted(x) for x in found.values()], pa.list_(pa.string()))], names=["_key", "spans", "items"])

    return index.mapInArrow(W.tidy(look), f"_key {kind}, spans array<struct<from:long,to:long>>, items array<string>")


def lengths(index: DataFrame, kind: str) -> DataFrame:
    """(_key, n_words) of every document of the index; reads no terms and no postings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, bounds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.ipc.open_stream(keys).read_next_batch().column(0), pa.array(np.diff(np.frombuffer(bounds, dtype=np.int64)))], names=["_key", "n_words"])

    return index.select("keys", "word_bounds").mapInArrow(count, f"_key {kind}, n_words long")


def near_matches(index: DataFrame, asked: Broadcast, width: int, kind: str) -> DataFrame:
    """(_key, item), each pair once per document: all words of a window of the item stand among `width` words of the document."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg, wanted = Segment(row), asked.value
                phrase, at = seg.near(wanted, width)
                doc = np.searchsorted(seg.bounds, at, side="right") - 1
                pairs = sorted({(d, i) for d, p in zip(doc.tolist(), phrase.tolist(), strict=True) for i in wanted.items[wanted.item_bounds[p] : wanted.item_bounds[p + 1]]})
                yield pa.RecordBatch.from_arrays([seg.keys.take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], pa.string())], names=["_key", "item"])

    return index.mapInArrow(W.tidy(look), f"_key {kind}, item string")


def merged(spans: Column) -> Column:
    """Sorted runs (from, to) with those that overlap or touch made one, as a single slice gives them."""

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))
        more = F.when(last["to"] >= s["from"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))
        return F.when(F.size(done) == 0, F.array(s)).otherwise(more)

    return F.aggregate(spans, F.array().cast("array<struct<from:long,to:long>>"), add)


def _numbered_index(docs: DataFrame, text: str, key: str, work: Work) -> tuple[DataFrame, str]:
    """The written index of docs, whose keys are (row, key) with a number for each row, and the type of these."""
    numbered = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("_numbered"), F.col(text).alias("_text"))
    return work.settled(build_index(numbered, "_text", "_numbered"), "index"), numbered.schema["_numbered"].dataType.simpleString()


def _each_slice(benchmark: DataFrame, item: str, item_text: str, look: Callable[[Broadcast], DataFrame], work: Work) -> DataFrame | None:
    """What look finds for each slice of the benchmark, one after the other."""
    found = None
    for part in slices(benchmark, item, item_text):
        asked = benchmark.sparkSession.sparkContext.broadcast(phrases(part))
        got = work.settled(look(asked), "matches")
        asked.unpersist()
        found = got if found is None else found.unionByName(got)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, spans (runs of hit words), items (sorted), n_hit, contaminated.

    contaminated: a hit, and hit words are a twentieth of all or more, 20 * n_hit >= n_words. Null
    and empty texts have no words, texts of any length are read whole. An empty benchmark hits nothing. Rows have numbers in the index, by
    which the matches of all slices of the benchmark are put together, so rows that share a key or
    have none are judged one by one. Other columns are not read. No rows give no rows.
    """
    work = Work(docs.sparkSession, "contamination")
    index, kind = _numbered_index(docs, text, key, work)
    words = lengths(index, kind).select("_key.row", "_key.key", "n_words")
    spans, items = F.array().cast("array<struct<from:long,to:long>>"), F.array().cast("array<string>")
    found = _each_slice(benchmark, item, item_text, lambda asked: matches(index, asked, kind).select("_key.row", "spans", "items"), work)
    if found is None:
        found = words.select("row", spans.alias("spans"), items.alias("items")).limit(0)
    hits = found.groupBy("row").agg(merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    out = words.join(hits, "row", "left").select(F.col("key").alias(key), "n_words", F.coalesce("spans", spans).alias("spans"), F.coalesce("items", items).alias("items"))
    out = out.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return work.concluded(out, "contamination")


def proximity(docs: DataFrame, benchmark: DataFrame, width: int = 20, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item) for each row of docs and item of which all words of a window stand among `width` words of the row, in any order.

    A word that a window holds several times counts once. Rows are judged one by one, as in
    contamination; those without a match, a text or words have no row here, nor have items without
    words or id.
    """
    work = Work(docs.sparkSession, "proximity")
    index, kind = _numbered_index(docs, text, key, work)
    found = _each_slice(benchmark, item, item_text, lambda asked: near_matches(index, asked, width, kind).select("_key.row", "_key.key", "item"), work)
    if found is None:
        found = lengths(index, kind).select("_key.row", "_key.key", F.lit("").alias("item")).limit(0)
    return work.concluded(found.distinct().select(F.col("key").alias(key), F.col("item").alias("item_id")), "proximity")


def items_digest(items: list[str]) -> str:
    """Lower-case hex SHA-256 of the item ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
