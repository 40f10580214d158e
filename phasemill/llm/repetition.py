"""Quality rules from repetition coverage.

Rolling hashes of word windows of several lengths mark the characters that lie in repeated
windows; equal line hashes mark those in repeated lines. A document is judged by the share
of its word characters so covered. Everything is per document, so the job has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm import words as W


@dataclass(frozen=True)
class RepetitionRules:
    """Limits on covered shares of a document's word characters."""

    least_words: int = 50
    most_repeat_percent: int = 50
    #: window length in words -> largest share of word characters inside windows found twice or more
    windows: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.25, 10: 0.20})
    #: largest share of characters in lines that repeat an earlier line, and of such lines
    dup_line_chars: float = 0.20
    dup_lines: float = 0.50
    #: largest number of symbols for each word
    symbols: float = 0.30


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, dup_line_share double, window_shares array<double>, base_failed boolean, kept boolean"
#: Symbols that count, as fixed values.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False
_LEAD = np.ones(256, dtype=bool)
_LEAD[0x80:0xC0] = False


def measure(data: np.ndarray, offsets: np.ndarray, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for the rows of one block."""
    starts, ends, bounds = W.segment(data, offsets, W.SPACED)
    hashes, rows = W.span_hashes(data, starts, ends), W.row_of(bounds)
    salt = W.mix(np.arange(1, len(bounds), dtype=np.uint64))
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LEAD[data], out=points[1:])
    chars = points[ends] - points[starts]
    n_words, word_chars = np.diff(bounds), W.per_row(chars, bounds)

    def covered(n: int) -> np.ndarray:
        """Words inside n-word windows that their row holds twice or more."""
        windows, whole = W.window_hashes(hashes, bounds, n)
        at = np.flatnonzero(whole)
        more = W.again(windows[at] ^ salt[rows[at]])
        edge = np.zeros(len(hashes) + 1, dtype=np.int32)
        np.add.at(edge, at[more], 1)
        np.add.at(edge, at[more] + n, -1)
        return np.cumsum(edge[:-1]) > 0

    n_repeat = W.per_row(covered(3), bounds)
    whole = np.maximum(word_chars, 1)
    shares = np.stack([W.per_row(chars * covered(n), bounds) / whole for n in rules.windows], axis=1) if rules.windows else np.zeros((len(n_words), 0))

    l_starts, l_ends, l_bounds = W.segment(data, offsets, _LINE)
    held = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)  # lines with a word
    l_rows = W.row_of(l_bounds)
    line_hash = W.span_hashes(data, l_starts, l_ends)[held] ^ salt[l_rows[held]]
    later = W.later(line_hash)
    size = len(n_words)
    n_dup = np.bincount(l_rows[held][later], minlength=size)
    n_lines = np.bincount(l_rows[held], minlength=size)
    line_chars = (points[l_ends] - points[l_starts])[held]
    dup_chars = np.bincount(l_rows[held], weights=line_chars * later, minlength=size) / np.maximum(np.bincount(l_rows[held], weights=line_chars, minlength=size), 1)

    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    failed = (n_words < rules.least_words) | (100 * n_repeat > rules.most_repeat_percent * n_words)
    good = (dup_chars <= rules.dup_line_chars) & (n_dup <= rules.dup_lines * n_lines) & (n_symbols <= rules.symbols * n_words)
    for k, most in enumerate(rules.windows.values()):
        good &= shares[:, k] <= most
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": n_lines, "dup_line_share": dup_chars, "window_shares": shares, "base_failed": failed, "kept": ~failed & good}


def repetition_coverage(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per row of docs: the key and COLUMNS.

    Null or empty text: no words, all counts 0, base_failed, not kept. A line counts as repeated
    if an earlier line of the same text has the same bytes and it holds a word; the first of them
    does not count. Texts of any length are read whole, one at a time where they are longer than a
    block. Rows with the same key are judged one by one, a null key is kept as it is, and other
    columns are not read. No rows give no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(1)):
                found = measure(data, offsets, rules)
                shares = found.pop("window_shares")
                ends = np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]
                columns = {n: pa.array(v.astype(np.int64) if v.dtype.kind in "iu" else v) for n, v in found.items()}
                columns["window_shares"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(shares.ravel()))
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_share", "window_shares", "base_failed", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(columns[n] for n in names)], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(W.tidy(judge), f"`{key}` {kind}, {COLUMNS}")
