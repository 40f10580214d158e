"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over single features and then over the strongest pairs, add
up to one lookup table per feature and per pair; a document's score is the sum of its bins'
entries. Features come from whole texts in NumPy, without a shuffle. The tables, a few tens
of KB, are fitted on the driver from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm import words as W
from phasemill.llm.shared import settled

FEATURES = [
    "log_words", "log_bytes", "mean_word", "std_word", "longest_word", "upper_share", "digit_share", "symbol_share", "stop_share", "pipe_share", "bang_share", "wide_share",
    "short_words", "one_char_words", "shouted_words", "distinct_words", "top_word", "same_as_before", "repeated_pairs", "repeated_triples", "log_lines", "words_per_line", "dup_lines", "lines_end_stopped",
]


def _share(table: list[int] | bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(table)] = True
    return out


_KINDS = [_share(range(65, 91)), _share(range(48, 58)), _share(b"#*$%&<>@{}[]=\\^~_+/"), _share(b".,;:"), _share(b"|"), _share(b"!?"), _share(range(128, 256))]
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of the rows of one block; a text without words has zeros."""
    starts, ends, bounds = W.segment(data, offsets, W.SPACED)
    size, n, rows = ends - starts, np.diff(bounds), W.row_of(bounds)
    rows_n = len(n)
    some, length = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    count = lambda flags: np.bincount(rows, weights=flags, minlength=rows_n)
    hashes = W.rolling_hashes(data, starts, ends)
    salt = W.mix(np.arange(1, rows_n + 1, dtype=np.uint64))
    total = count(size)
    mean = total / some
    std = np.sqrt(np.maximum(count(size.astype(np.float64) ** 2) / some - mean**2, 0))
    longest = np.zeros(rows_n)
    np.maximum.at(longest, rows, size)
    chars = []
    for kind in _KINDS:
        held = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(kind[data], out=held[1:])
        chars.append((held[offsets[1:]] - held[offsets[:-1]]) / length)
        if kind is _KINDS[0]:
            shouted = (held[ends] - held[starts] >= 2) & (2 * (held[ends] - held[starts]) >= size)
    keys = hashes ^ salt[rows]
    distinct, inverse, often = np.unique(keys, return_inverse=True, return_counts=True)
    first = np.zeros(len(distinct), dtype=np.int64)
    first[inverse] = np.arange(len(keys))
    tops = np.zeros(rows_n)
    np.maximum.at(tops, rows[first], often)
    kinds = np.bincount(rows[first], minlength=rows_n)
    before = np.zeros(len(keys), dtype=bool)
    before[1:] = keys[1:] == keys[:-1]
    repeats = []
    for k in (2, 3):
        windows, whole = W.window_hashes(hashes, bounds, k)
        at = np.flatnonzero(whole)
        more = W.again(windows[at] ^ salt[rows[at]])
        repeats.append(np.bincount(rows[at], weights=more, minlength=rows_n) / np.maximum(np.bincount(rows[at], minlength=rows_n), 1))
    l_starts, l_ends, l_bounds = W.segment(data, offsets, _LINE)
    l_rows, lines = W.row_of(l_bounds), np.diff(l_bounds)
    dup = W.later(W.rolling_hashes(data, l_starts, l_ends) ^ salt[l_rows])
    stopped = np.isin(data[l_ends - 1], np.frombuffer(b'.!?:"', dtype=np.uint8)) if len(l_ends) else np.zeros(0)
    some_lines = np.maximum(lines, 1)
    return np.stack([
        np.log1p(n), np.log1p(np.diff(offsets)), mean, std, longest, *chars,
        count(size <= 3) / some, count(size == 1) / some, count(shouted) / some, kinds / some, tops / some, count(before) / some, *repeats,
        np.log1p(lines), n / some_lines, np.bincount(l_rows, weights=dup, minlength=rows_n) / some_lines, np.bincount(l_rows, weights=stopped, minlength=rows_n) / some_lines,
    ], axis=1)


@dataclass(frozen=True)
class Settings:
    """bins a feature, shallow trees of `leaves` leaves, rounds over features and then over pairs, pairs kept and their bins a side."""

    bins: int = 32
    leaves: int = 3
    rounds: int = 150
    rate: float = 0.15
    pairs: int = 10
    pair_bins: int = 8
    pair_rounds: int = 60
    least_hessian: float = 3.0
    prior: float = 1.0


class AdditiveModel:
    """score(x) = logistic(base + sum of tables[j][bin of x_j] + sum of pair tables)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> None:
        self.s = s
        width = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.pair_bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(mean / (1 - mean)))
        if len(np.unique(y)) < 2:
            return
        bins = self._bins(x, self.edges)
        margin = np.full(len(y), self.base)
        for _ in range(s.rounds):
            for j in range(width):
                g, h = self._slopes(margin, y)
                step = self._tree(np.bincount(bins[j], weights=g, minlength=len(self.tables[j])), np.bincount(bins[j], weights=h, minlength=len(self.tables[j])))
                self.tables[j] += step
                margin += step[bins[j]]
        coarse = self._bins(x, self.coarse)
        sizes = [len(e) + 1 for e in self.coarse]
        g, h = self._slopes(margin, y)
        gains = []
        for i in range(width):
            for j in range(i + 1, width):
                gains.append((self._cross(*self._grids(coarse, sizes, i, j, g, h))[0], i, j))
        self.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[: s.pairs] if gain > 0]
        self.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in self.pairs]
        for _ in range(s.pair_rounds):
            for n, (i, j) in enumerate(self.pairs):
                g, h = self._slopes(margin, y)
                step = self._cross(*self._grids(coarse, sizes, i, j, g, h))[1]
                self.pair_tables[n] += step
                margin += step[coarse[i], coarse[j]]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]

    @staticmethod
    def _slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    def _leaf(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.where(h >= self.s.least_hessian, self.s.rate * g / (h + self.s.prior), 0.0)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of few leaves over ordered bins: each time the cut that gains most."""
        parts = [(0, len(g))]
        cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + self.s.prior)
        for _ in range(self.s.leaves - 1):
            best = (1e-9, -1, -1)
            for n, (a, b) in enumerate(parts):
                cut = np.arange(a + 1, b)
                if len(cut):
                    gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                    k = int(np.argmax(gain))
                    best = max(best, (float(gain[k]), n, int(cut[k])))
            if best[1] < 0:
                break
            a, b = parts[best[1]]
            parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = self._leaf(cg[b] - cg[a], ch[b] - ch[a])
        return out

    @staticmethod
    def _grids(bins: list[np.ndarray], sizes: list[int], i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = bins[i] * sizes[j] + bins[j]
        return tuple(np.bincount(at, weights=v, minlength=sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for v in (g, h))

    def _cross(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The cut of both features into four quadrants that gains most over no cut, and its step."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        if min(g.shape) < 2:
            return 0.0, np.zeros(g.shape)
        quads = []
        for c in (cg, ch):
            a = c[:-1, :-1]
            b = c[:-1, -1:] - a
            d = c[-1:, :-1] - a
            quads.append((a, b, d, c[-1, -1] - a - b - d))
        gain = sum(x**2 / (y + self.s.prior) for x, y in zip(*quads, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + self.s.prior)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        step = np.zeros(g.shape)
        for part, (x, y) in zip(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), zip(*quads, strict=True), strict=True):
            step[part] = self._leaf(x[i, j], y[i, j])
        return float(gain[i, j]), step

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for table, bins in zip(self.tables, self._bins(x, self.edges), strict=True):
            margin += table[bins]
        coarse = self._bins(x, self.coarse)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            margin += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-margin))


def extracted(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key and the FEATURES of each row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(1)):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(x[:, j].astype(np.float32)) for j in range(x.shape[1]))], names=[key, *FEATURES])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(W.tidy(extract), f"`{key}` {kind}, " + ", ".join(f"{n} float" for n in FEATURES))


def held_out(key: str):
    """Whether crc32(key as text) mod 3 is 1; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 1, F.lit(False))


def sampled(labelled: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key: all, where there are no more."""
    n = labelled.count()
    return labelled if n <= most else labelled.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(most / n * (1 << 20)))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = 0.5, sample: int = 60_000, settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: key, held_out, score (0 to 1), predicted (score >= threshold).

    Fitted on about `sample` labelled rows at most whose crc32(key as text) mod 3 is not 1. Null and
    empty texts have all features 0 and get a score like others, texts of any length are read whole;
    rows with a null key are scored too, and rows that repeat alike. Other columns are not read.
    Rows whose label is null or not 0 or 1 are not learned from; with labels of one kind only, or
    none, every score is the smoothed share of label 1. A label or a document given twice weighs
    twice in the fit. No rows give no rows.
    """
    found = settled(extracted(docs, text, key), "features")
    marked = labels.select(F.col(key), F.col(label).cast("double").alias("_label")).filter("_label IN (0, 1)").filter(~held_out(key))
    rows = sampled(found.join(marked, key), key, sample).select(*FEATURES, "_label").toPandas()
    model = AdditiveModel(rows[FEATURES].to_numpy(np.float64), rows["_label"].to_numpy(np.float64), settings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy().astype(np.float64) for n in range(2, 2 + len(FEATURES))], axis=1)
            got = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return found.select(F.col(key), held_out(key).alias("_held"), *FEATURES).mapInArrow(W.tidy(score), f"`{key}` {kind}, held_out boolean, score double, predicted int")
