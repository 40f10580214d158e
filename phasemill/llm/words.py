"""Words, lines and their 64-bit hashes from Arrow string columns, in NumPy.

A batch's texts lie end to end in one byte buffer; every function here works on that
buffer with row offsets, so a task's memory is a few times one block of text and no Python
object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at a time; a longer text is a block of its own.
BLOCK_BYTES = 500_000
#: Bytes whose prefix sums are held at a time.
_SPAN = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def release() -> None:
    """Gives freed memory back, for the worker stays while later stages share its executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable) -> Callable:
    """A function of batches that releases memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def tidy_group(work: Callable) -> Callable:
    """The same for a function of one group."""

    def run(group: pa.Table) -> pa.Table:
        out = work(group)
        release()
        return out

    return run


def tidy_pair(work: Callable) -> Callable:
    """The same for a function of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    return run


def _classes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Bytes of the words [^\x20\x09-\x0D]+ and of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
SPACED = _classes((0x20, 0x20), (0x09, 0x0D))
ALNUM = _classes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def segment(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that `inside` marks, never across rows, and each row's bounds among them."""
    held = inside[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = held[:-1]
        after[-1] = False
        after[:-1] = held[1:]
    starts = np.flatnonzero(held & (~before | first[:-1]))
    ends = np.flatnonzero(held & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans may touch, overlap and be of any length.

    A span's pieces of eight bytes are scrambled one by one, each with a constant of its place, and
    summed, so that no pattern of bytes cancels out as it may in a polynomial modulo 2^64.
    """
    sizes = ends - starts
    last = np.cumsum((sizes + 7) // 8)  # the piece after each span's last
    total = np.zeros(len(starts), dtype=np.uint64)
    pieces = int(last[-1]) if len(last) else 0
    for low in range(0, pieces, _SPAN // 8):
        high = min(low + _SPAN // 8, pieces)
        first, stop = (int(x) for x in np.searchsorted(last, [low, high - 1], side="right"))
        cuts = np.minimum(last[first : stop + 1], high) - np.maximum(np.append(last[first - 1] if first else 0, last[first:stop]), low)
        held = np.flatnonzero(cuts)
        of = np.repeat(np.arange(first, stop + 1), cuts)
        place = np.arange(low, high) - (last[of] - (sizes[of] + 7) // 8)
        at = starts[of] + 8 * place
        left = np.minimum(ends[of] - at, 8)
        begin = int(at.min())
        window = np.zeros(int((at + left).max()) - begin + 8, dtype=np.uint8)
        window[:-8] = data[begin : begin + len(window) - 8]
        piece = np.ndarray((len(window) - 7,), dtype="<u8", buffer=window, strides=(1,))[at - begin]
        piece = piece & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        scrambled = mix(piece ^ mix((place + 1).astype(np.uint64)))
        total[first + held] += np.add.reduceat(scrambled, np.cumsum(cuts)[held] - cuts[held])
    return mix(total + sizes.astype(np.uint64) * _BASE)


def rolling_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A cheap hash of spans that overlap much: a polynomial modulo 2^64, of which patterned bytes may collide.

    Only for what a collision does no harm to, such as choosing anchors or hashed features. Spans are
    in order and may touch but a later one never starts before an earlier.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(starts, low + _SPAN)))
        high = int(ends[at:stop].max())
        if high - low > 2 * _SPAN and stop > at + 1:  # one very long span: cut before it
            stop = max(at + 1, at + int(np.argmax(ends[at:stop] > low + 2 * _SPAN)))
            high = int(ends[at:stop].max())
        power, inverse = powers(high - low)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[data[low:high]] * power[: high - low], out=total[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = stop
    return mix(out)


_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64; up to a few MB are kept."""
    global _powers
    if n <= len(_powers[0]):
        return _powers
    size = max(n, 2 * _SPAN + 1)
    made = []
    for base in (_BASE, _INVERSE):
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        made.append(out)
    if size <= 4 * _SPAN:
        _powers = (made[0], made[1])
    return made[0], made[1]


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that begin at each word, and which of them stay within their row."""
    total = len(hashes)
    out = np.zeros(total, dtype=np.uint64)
    if total >= n:
        for k in range(n):
            out[: total - n + 1] = out[: total - n + 1] * _BASE + hashes[k : total - n + 1 + k]
    whole = np.ones(total, dtype=bool)
    whole[max(0, total - n + 1) :] = False
    for k in range(1, n):  # windows that begin less than n words before a row's end
        at = bounds[1:] - k
        whole[at[at >= bounds[:-1]]] = False
    return mix(out), whole


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    more = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        held = keys[order]
        same = held[1:] == held[:-1]
        more[order[1:][same]] = True
        more[order[:-1][same]] = True
    return more


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys are equal to an earlier one."""
    out = np.ones(len(keys), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over each row's words."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word shingles (lower-cased words by white space) as sorted hashes, and the rows' bounds.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    lowered = LOWER[data]
    starts, ends, bounds = segment(lowered, offsets, SPACED)
    hashes = span_hashes(lowered, starts, ends)
    windows, whole = window_hashes(hashes, bounds, n)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    rows, keys = row_of(bounds)[whole], windows[whole]
    if len(short):
        extra = np.array([int(mix(_fold(hashes[bounds[r] : bounds[r + 1]]))[0]) for r in short], dtype=np.uint64)
        rows, keys = np.concatenate([rows, short]), np.concatenate([keys, extra])
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    rows, keys = rows[first], keys[first]
    return keys, np.searchsorted(rows, np.arange(len(offsets)))


def _fold(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1, dtype=np.uint64)
    for h in hashes:
        out = out * _BASE + h
    return out + np.uint64(len(hashes))
