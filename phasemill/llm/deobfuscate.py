"""Toxicity of restored text.

Words that look disguised (digits or signs for letters, letters spaced out or parted by
signs, repeated letters) are read as a noisy channel's output: each place of the word is a
small lattice of letters that may have been meant, and Viterbi decoding under a character
trigram model of the whole corpus picks the likeliest word. A logistic model over word and
word-beginning features of the restored text then scores each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.llm import words as W
from phasemill.llm.gam import held_out, sampled
from phasemill.llm.shared import settled

#: Letters that a sign may stand for, as fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h", "€": "e", "£": "l", "¡": "i",
}
#: Letters of other scripts that look like a Latin one, as fixed values.
ALIKE = dict(zip("аеорсухіјѕԁɡαοινκρτ", "aeopcyxijsdgaoivkpt", strict=True))
#: Signs that may merely part letters.
PARTING = set("-._~'`*+/\\,:;^=|#·•​‌‍﻿­")
#: Log-costs of the channel: another letter meant, a sign that parts, a long run of a letter cut, a double letter made single, any letter behind a mask.
SUBSTITUTE, PART, DROP, UNDOUBLE, MASK = -0.7, -0.3, -0.5, -6.0, -2.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False
_OPENING = np.zeros(256, dtype=bool)
_OPENING[list(b"$@!|+")] = True

#: Classes of bytes for the character model: 0 no letter, a to z, bytes that continue a letter, bytes that begin one.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:192] = 28 + np.arange(64)
_CLASS[192:256] = 92 + np.arange(64) % 32
_BITS = 7


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals of Latin-1 in lower case."""
    low = W.LOWER[data]
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[capital] += 32
    return low


def letter_counts(docs: DataFrame, text: str) -> DataFrame:
    """(code, n): trigrams of byte classes over all whole texts; at most 2^21 rows, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (3 * _BITS), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in W.blocks(batch.column(0)):
                c = np.zeros(len(data) + len(offsets) + 1, dtype=np.int64)  # a place without letter between rows
                c[np.arange(len(data)) + 1 + W.row_of(offsets)] = _CLASS[lowered(data)]
                pair = (c[:-1] << _BITS) | c[1:]
                codes = (pair[:-1] << _BITS) | c[2:]
                total += np.bincount(codes[(codes & 0x3FFF) > 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["code", "n"])

    return docs.select(F.col(text)).mapInArrow(W.tidy(count), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Letters:
    """log p(letter | two before), smoothed by shorter histories; a table of 2^21 entries."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        side = 1 << _BITS
        c3 = np.zeros(side**3, dtype=np.float32)
        c3[codes] = counts
        c3 = c3.reshape(side, side, side)
        one = c3.sum(axis=(0, 1)) + 0.5
        p1 = one / one.sum()
        c2 = c3.sum(axis=0)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)).astype(np.float32).ravel()

    def add(self, history: tuple[int, int], letters: bytes) -> tuple[float, tuple[int, int]]:
        total, (a, b) = 0.0, history
        for x in letters:
            c = int(_CLASS[x])
            total += float(self.log[(a << 2 * _BITS) | (b << _BITS) | c])
            a, b = b, c
        return total, (a, b)


def restored(word: str, letters: Letters) -> str:
    """The likeliest word behind a disguised one."""
    runs: list[list] = []
    for ch in word.lower():
        if runs and runs[-1][0] == ch:
            runs[-1][1] += 1
        else:
            runs.append([ch, 1])
    stretched = len(runs) > 2 and 2 * sum(n > 1 for _, n in runs) > len(runs)
    undouble = DROP if stretched else UNDOUBLE
    live: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for ch, n in runs:
        meant = [(ch, 0.0)] if ch.isalpha() and ch not in ALIKE else []
        meant += [(x, SUBSTITUTE) for x in LEET.get(ch, "")] + [(x, SUBSTITUTE) for x in ALIKE.get(ch, "")]
        meant += [(x, MASK) for x in "abcdefghijklmnopqrstuvwxyz" if ch == "*" and n == 1]
        options: dict[str, float] = {}
        for x, cost in meant:
            options[x] = max(options.get(x, -1e9), cost + (0, undouble, DROP)[min(n, 3) - 1])
            if n > 1:
                options[x * 2] = max(options.get(x * 2, -1e9), cost + DROP * (n > 2))
        if ch in PARTING or not meant:
            options[""] = PART if ch in PARTING else 2 * SUBSTITUTE
        then: dict[tuple[int, int], tuple[float, tuple]] = {}
        for x, cost in options.items():
            raw = x.encode()
            for history, (score, path) in live.items():
                more, state = letters.add(history, raw)
                total = score + cost + more
                if state not in then or total > then[state][0]:
                    then[state] = (total, (path, x))
        live = then
    path = max(((s + letters.add(h, b" ")[0], p) for h, (s, p) in live.items()), key=lambda x: x[0])[1]
    parts = []
    while path:
        path, x = path
        parts.append(x)
    return "".join(reversed(parts))


@dataclass(frozen=True)
class Read:
    """Features of a block: row and hash of each, with repeats."""

    rows: np.ndarray
    hashes: np.ndarray


#: Runs of letters within a word that are read as words too.
PARTS = re.compile(r"[^\W\d_]{4,}")
#: Text whose features are counted at a time: each word gives up to six.
TAUGHT_BYTES = 300_000
#: Letters that a spaced-out word may have.
SPACED_LETTERS = range(3, 17)
#: Bytes at a word's beginning that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of whole words and of their beginnings, and the rows of each."""
    hashes, where = [W.rolling_hashes(data, starts, ends)], [rows]
    for n in BEGINNINGS:
        long = np.flatnonzero(ends - starts >= n)
        hashes.append(W.rolling_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n))
        where.append(rows[long])
    return hashes, where


def read(data: np.ndarray, offsets: np.ndarray, letters: Letters, known: dict[str, str]) -> Read:
    """Word features of the restored text of each row; known: words restored before."""
    low = lowered(data)
    starts, ends, bounds = W.segment(low, offsets, W.SPACED)
    rows = W.row_of(bounds)
    solid = _LETTER[low] | _DIGIT[low]
    place = np.arange(len(low) + 1)
    last = np.maximum.accumulate(np.where(np.append(solid, True), place, -1)) if len(low) else place
    core_end = np.maximum(starts, np.minimum(ends, last[ends - 1] + 1)) if len(ends) else ends
    first_of = solid | _OPENING[low]
    after = np.minimum.accumulate(np.where(np.append(first_of, True), place, len(low))[::-1])[::-1]
    core = np.minimum(core_end, after[starts]) if len(starts) else starts
    sums = {}
    triple = np.zeros(len(low), dtype=bool)
    triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[low[2:]] & (low[2:] < 128)
    foreign = (low >= 0xCE) & (low <= 0xD4)
    zero = (low == 0xE2) | (low == 0xEF)
    for name, flags in (("letter", _LETTER[low]), ("solid", solid), ("triple", triple), ("odd", foreign | zero), ("lead", _LEAD[low])):
        held = np.zeros(len(low) + 1, dtype=np.int64)
        np.cumsum(flags, out=held[1:])
        sums[name] = held
    span = lambda n: sums[n][core_end] - sums[n][core]
    size = core_end - core
    ascii_signs = size - span("letter")
    strange = ((span("letter") > 0) & (ascii_signs > 0)) | (span("triple") > 0) | (span("odd") > 0)
    # letters spaced out: three single signs or more in a row
    single = (sums["lead"][core_end] - sums["lead"][core] == 1) & (sums["lead"][ends] - sums["lead"][starts] <= 2)
    edge = np.ones(len(single) + 1, dtype=bool)
    if len(single):
        edge[1:-1] = (single[1:] != single[:-1]) | (rows[1:] != rows[:-1])
    cuts = np.flatnonzero(edge)
    spaced = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if single[a] and b - a >= 3]
    plain = (size > 0) & ~strange
    out_words: list[str] = []
    out_rows: list[int] = []

    def restore(word: str) -> str:
        got = known.get(word)
        if got is None:
            got = restored(word, letters)
            if len(known) < 200_000 and len(word) < 200:
                known[word] = got
        return got

    body = low.tobytes()
    for i in np.flatnonzero(strange):
        word = body[core[i] : core_end[i]].decode(errors="ignore")
        whole = {restore(word), *PARTS.findall(word)} - {""}  # signs may also join words, as in l'un or one-two
        out_words += sorted(whole)
        out_rows += [int(rows[i])] * len(whole)
    for a, b in spaced:  # where the spaced word begins and ends isn't known: all its parts count
        got = restore("".join(body[core[i] : core_end[i]].decode(errors="ignore") for i in range(a, b)))
        parts = {got[i : i + n] for n in SPACED_LETTERS for i in range(len(got) - n + 1)}
        out_words += sorted(parts)
        out_rows += [int(rows[a])] * len(parts)
    hashes, where = _spans(low, core[plain], core_end[plain], rows[plain])
    if out_words:
        raw = [w.encode() for w in out_words]
        stops = np.cumsum([len(r) for r in raw])
        more = _spans(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], stops[:-1]]), stops, np.array(out_rows))
        hashes, where = hashes + more[0], where + more[1]
    return Read(np.concatenate(where), np.concatenate(hashes))


def _distinct(got: Read) -> Read:
    """Each feature of a row once."""
    order = np.lexsort((got.hashes, got.rows))
    rows, hashes = got.rows[order], got.hashes[order]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return Read(rows[first], hashes[first])


class Lookup:
    """Places of hashes in a small sorted list, with a bit table before the search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[hashes >> np.uint64(42)] = True

    def find(self, asked: Read, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, places), each pair once."""
        hit = np.flatnonzero(self.bits[asked.hashes >> np.uint64(42)])
        if not len(hit) or not len(self.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, asked.hashes[hit]), len(self.hashes) - 1)
        ok = self.hashes[at] == asked.hashes[hit]
        both = np.unique(asked.rows[hit[ok]].astype(np.int64) * len(self.hashes) + at[ok])
        return both // len(self.hashes), both % len(self.hashes)


def fit(rows: np.ndarray, places: np.ndarray, y: np.ndarray, width: int, steps: int = 400, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic model on 0/1 features, the last of them for the constant; full-batch Adagrad."""
    w, seen = np.zeros(width + 1), np.full(width + 1, 1e-8)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(mean / (1 - mean))
    for _ in range(steps if len(np.unique(y)) == 2 else 0):
        margin = w[-1] + np.bincount(rows, weights=w[places], minlength=len(y))
        slope = (1 / (1 + np.exp(-margin)) - y) / len(y)
        g = np.append(np.bincount(places, weights=slope[rows], minlength=width), slope.sum())
        g[:-1] += ridge * w[:-1] / len(y)
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = 0.7, sample: int = 20_000, width: int = 4096, least_gain: float = 8.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: key, held_out, score (0 to 1), predicted (score >= threshold) and the carried columns.

    The character model counts all texts. Features are chosen and weighed on about `sample`
    labelled rows at most whose crc32(key as text) mod 3 is not 1: the `width` words and word
    beginnings that tell the labels apart best, of those with a log-likelihood gain of `least_gain`.
    Null and empty texts get the score of a text without any of them, texts of any length are read
    whole; rows with a null key are scored too. Rows whose label is null or not 0 or 1 are not
    learned from; with labels of one kind only, or none, every score is the smoothed share of label
    1. Rows that repeat are scored alike, and a label or a document given twice weighs twice in the
    fit. Columns that aren't carried are not read. No rows give no rows.
    """
    spark = docs.sparkSession
    counted = letter_counts(docs, text).toPandas()
    letters = spark.sparkContext.broadcast(Letters(counted["code"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)))
    marked = labels.select(F.col(key), F.col(label).cast("int").alias("_label")).filter("_label IN (0, 1)").filter(~held_out(key))
    chosen = sampled(marked, key, sample)
    # the sample's size is bounded, so the texts need not be shuffled to meet it
    taught = settled(docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text", "_label"), "taught")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(0), TAUGHT_BYTES):
                got = _distinct(read(data, offsets, letters.value, known))
                y = batch.column(1).slice(first, last - first).to_numpy()[got.rows]
                hashes, inverse = np.unique(got.hashes, return_inverse=True)
                one = np.bincount(inverse, weights=y, minlength=len(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(one), pa.array(np.bincount(inverse, minlength=len(hashes)) - one)], names=["feature", "one", "zero"])

    table = taught.mapInArrow(W.tidy(differences), "feature long, one long, zero long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    counts = chosen.agg(F.sum("_label"), F.count("*")).first()
    ones, total = int(counts[0] or 0), int(counts[1])
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    n, one, zero = F.col("one") + F.col("zero"), F.col("one").cast("double"), F.col("zero").cast("double")
    gain = part(one, n * (ones / max(total, 1))) + part(zero, n * ((total - ones) / max(total, 1)))
    best = table.filter("one + zero >= 4").withColumn("gain", gain).filter(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "feature").limit(width).select("feature").toPandas() if 0 < ones < total else None
    lookup = spark.sparkContext.broadcast(Lookup(np.sort(best["feature"].to_numpy(np.int64).view(np.uint64)) if best is not None else np.zeros(0, dtype=np.uint64)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(0)):
                rows, at = lookup.value.find(read(data, offsets, letters.value, known), last - first)
                ends = np.searchsorted(rows, np.arange(last - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))], names=["label", "places"])

    size = len(lookup.value.hashes)
    seen = taught.mapInArrow(W.tidy(places), "label int, places array<int>").toPandas() if size else None
    y = seen["label"].to_numpy(np.float64) if size else np.array([1.0] * ones + [0.0] * (total - ones))
    lengths = seen["places"].map(len).to_numpy() if size else np.zeros(len(y), dtype=np.int64)
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(p, dtype=np.int64) for p in (seen["places"] if size else []))])
    weights = fit(np.repeat(np.arange(len(y)), lengths), flat, y, size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(2)):
                rows, at = lookup.value.find(read(data, offsets, letters.value, known), last - first)
                got = 1 / (1 + np.exp(-(weights[-1] + np.bincount(rows, weights=weights[at], minlength=last - first))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(got), pa.array((got >= threshold).astype(np.int32)), *(c.slice(first, last - first) for c in batch.columns[3:])], names=[key, "held_out", "score", "predicted", *carry])

    made = T.StructType.fromDDL("held_out boolean, score double, predicted int")
    schema = T.StructType([docs.schema[key], *made.fields, *(docs.schema[c] for c in carry)])
    return docs.select(F.col(key), held_out(key).alias("_held"), F.col(text), *(F.col(c).alias(f"_carry_{n}") for n, c in enumerate(carry))).mapInArrow(W.tidy(score), schema)
