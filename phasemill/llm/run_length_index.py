"""Removal of repeated byte strings with run-length compressed Burrows-Wheeler indexes.

Every 100-byte window is dealt out by its anchor: the 40-byte string within it that has the
smallest hash. A stretch of windows with one anchor travels as two hashes and a place. Where
an anchor stands in several places, as in copies, the bytes of its stretches are brought
together. There, stretches are split by order of place into earlier and later halves, again
and again; the earlier ones are indexed (BWT in runs, suffix-array samples at both ends of
each run), the later ones are streamed against the index for their matching statistics, and
starts that match 100 bytes or more are repeats. All windows of equal content have one
anchor, so nothing is missed.

An anchor with more than MANY_PLACES places, as in large groups of copies, has its equal
stretches told by 64-bit hashes of their bytes before that, in each block and then over all, so that only
one of them is sent; only the different ones meet in the index. An anchor with very many
different stretches would still bring all their bytes to one task: its windows are dealt one
by one instead, by hashes of their bytes, and the first of each stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phasemill.llm import words as W
from phasemill.llm.backoff_lm import pack, unpack
from phasemill.llm.shared import Work, pieces

#: Bytes of a string that counts as repeated, and of an anchor within it.
WINDOW = 100
ANCHOR = 40
#: Bytes of a text that are cut at a time; a longer text is cut in pieces that overlap by WINDOW - 1.
PIECE = 500_000
#: Text whose stretches a block collects before it sends them.
BLOCK_BYTES = 8_000_000
#: Text in a group of documents; there are as many groups of anchors.
GROUP_BYTES = 6_000_000
#: Different stretches of one anchor up to which their bytes meet; the windows of more are dealt by their hashes.
HOT_STRETCHES = 2_000
#: Places of one anchor up to which the index finds all repeats; of more, equal stretches are first told by their hashes.
MANY_PLACES = 2
_PLACE_BITS = 22
#: Shifts that spread a key over its low bits.
_FOLDS = (32, 16, 8)
ENTRY = [("anchor", np.uint64), ("print", np.uint64), ("doc", np.int64), ("row", np.int64), ("start", np.int64), ("count", np.uint8)]
_MARKS = ("doc", "row", "start", "count")


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and hash of the bytes of each stretch of windows with one anchor."""
    n = len(data)
    if n < WINDOW:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),) * 2
    at = np.arange(n - ANCHOR + 1)
    keys = W.rolling_hashes(data, at, at + ANCHOR)
    low = (keys & ~np.uint64((1 << _PLACE_BITS) - 1)) | at.astype(np.uint64)
    width, reach = WINDOW - ANCHOR + 1, 1
    while reach * 2 <= width:  # minima of 2, 4, ... 32 places
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: n - WINDOW + 1], low[width - reach : n - WINDOW + 1 + width - reach])
    place = (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    inside = np.ones(n - WINDOW + 1, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int32)  # windows that would cross into the next row
    ends = offsets[1:-1]
    np.add.at(edge, np.maximum(ends - WINDOW + 1, 0), 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge)[: n - WINDOW + 1] == 0
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    new |= row_start[: len(place)]
    first = np.flatnonzero(new & inside)
    stops = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
    return first, stops - first, keys[place[first]], W.span_hashes(data, first, stops + WINDOW - 1)


def _send(entries: dict[str, np.ndarray], bucket: np.ndarray, kind: int, names: tuple[str, ...], text: list[bytes] | None = None) -> Iterator[tuple]:
    """(kind, bucket, packed columns, bytes) of the entries of each bucket."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for part in np.split(order, at[1:]) if len(order) else []:
        columns = []
        for name in names:
            values = entries[name][part]
            columns.append(pack(np.diff(values, prepend=values.dtype.type(0)) if name == "doc" else values))
        yield kind, int(bucket[part[0]]), columns, b"".join(text[i] for i in part) if text else b""


_PACKED = "kind int, bucket int, columns array<binary>, bytes binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, buckets, columns, raw = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(columns, pa.list_(pa.binary())), pa.array(raw, pa.binary())], names=["kind", "bucket", "columns", "bytes"])


def _received(table: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    kinds = dict(ENTRY)
    out: dict[str, list] = {n: [np.zeros(0, dtype=kinds[n])] for n in names}
    for columns in table.column("columns").to_pylist():
        for name, raw in zip(names, columns, strict=True):
            values = unpack(raw, kinds[name])
            out[name].append(np.cumsum(values, dtype=np.int64) if name == "doc" else values)
    return {n: np.concatenate(v) for n, v in out.items()}


def _group_of(e: dict[str, np.ndarray], groups: int) -> np.ndarray:
    """The group of documents that each entry's key and text hash fall in."""
    x = (e["doc"] ^ e["row"]).view(np.uint64)
    for by in _FOLDS:
        x = x ^ (x >> np.uint64(by))
    return np.mod(x.view(np.int64), groups)


def _group(groups: int) -> Column:
    """The same in Spark; rows without a key go by their text."""
    x = F.coalesce("_doc", F.lit(0)).cast("long").bitwiseXOR(F.col("_row"))
    for by in _FOLDS:
        x = x.bitwiseXOR(F.shiftrightunsigned(x, by))
    return F.pmod(x, F.lit(groups)).cast("int")


def _often(anchor: np.ndarray, counted: np.ndarray, most: int) -> np.ndarray:
    """Which entries, in order of their anchors, have an anchor with more than `most` counted ones."""
    if not len(anchor):
        return np.zeros(0, dtype=bool)
    number = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
    return (np.bincount(number, weights=counted) > most)[number]


def _cut(docs: DataFrame, groups: int, many_places: int) -> DataFrame:
    """Kind 0: stretches by anchor; kind 1: of anchors with many places, stretches that the same block holds earlier, by document."""
    names = tuple(n for n, _ in ENTRY)

    def send(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        e = {n: np.concatenate([h[n] for h in held]) for n in names}
        order = np.lexsort((e["start"], e["row"], e["doc"], e["print"], e["anchor"]))
        a, p = e["anchor"][order], e["print"][order]
        d, s, r = e["doc"][order], e["start"][order], e["row"][order]
        repeat = np.zeros(len(order), dtype=bool)
        repeat[1:] = (a[1:] == a[:-1]) & (p[1:] == p[:-1])
        twin = np.zeros(len(order), dtype=bool)
        twin[1:] = repeat[1:] & (d[1:] == d[:-1]) & (s[1:] == s[:-1]) & (r[1:] == r[:-1])  # the same row given twice: not earlier than itself
        many = _often(a, ~twin, many_places)
        lead = ~repeat | ~twin & ~many
        rows = []
        chosen = np.sort(order[lead])
        sub = {n: e[n][chosen] for n in names}
        rows += _send(sub, (sub["anchor"] % np.uint64(groups)).astype(np.int64), 0, names)
        head = np.maximum.accumulate(np.where(~repeat, np.arange(len(order)), 0))
        twin_of_first = repeat & (d == d[head]) & (s == s[head]) & (r == r[head])
        marked = np.sort(order[~lead & ~twin & ~twin_of_first])
        sub = {n: e[n][marked] for n in _MARKS}
        rows += _send(sub, _group_of(sub, groups), 1, _MARKS)
        return _batch(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for first, last, data, offsets in W.blocks(batch.column(1), PIECE):
                docs_, rows_ = batch.column(0).slice(first, last - first).to_numpy(), batch.column(2).slice(first, last - first).to_numpy()
                if last - first == 1 and len(data) > 2 * PIECE:
                    parts = [(lo, data[lo : lo + PIECE + WINDOW - 1]) for lo in range(0, len(data) - WINDOW + 1, PIECE)]
                    found = [(lo, np.array([0, len(x)]), x) for lo, x in parts]
                else:
                    found = [(0, offsets, data)]
                for lo, bounds, x in found:
                    start, count, anchor, prints = stretches(x, bounds)
                    row = np.searchsorted(bounds, start, side="right") - 1
                    held.append({"anchor": anchor, "print": prints, "doc": docs_[row].astype(np.int64), "row": rows_[row].astype(np.int64), "start": start - bounds[row] + lo, "count": count.astype(np.uint8)})
                    size += len(x)
                if size >= BLOCK_BYTES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return docs.mapInArrow(W.tidy(cut), _PACKED)


def _settle_equal(groups: int, hot: int, many_places: int):
    """For stretches of some anchors: kind 2, places whose bytes must be compared. Of anchors with many places, kind 1, those with an earlier equal one, and only the others compared; kind 3, the same of anchors with more than `hot` to compare. Kind 1 of before passes."""
    names = tuple(n for n, _ in ENTRY)

    def settle(group: pa.Table) -> pa.Table:
        old = pc.equal(group.column("kind"), 1)
        passed, group = group.filter(old), group.filter(pc.invert(old))
        e = _received(group, names)
        order = np.lexsort((e["start"], e["row"], e["doc"], e["print"], e["anchor"]))
        e = {n: v[order] for n, v in e.items()}
        lead = np.ones(len(order), dtype=bool)
        lead[1:] = (e["anchor"][1:] != e["anchor"][:-1]) | (e["print"][1:] != e["print"][:-1])
        twin = ~lead  # the same row given twice
        twin[1:] &= (e["doc"][1:] == e["doc"][:-1]) & (e["start"][1:] == e["start"][:-1]) & (e["row"][1:] == e["row"][:-1])
        many = _often(e["anchor"], ~twin, many_places)
        head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0)) if len(order) else order
        same_place = (e["doc"] == e["doc"][head]) & (e["start"] == e["start"][head]) & (e["row"] == e["row"][head])
        rows = []
        sub = {n: e[n][many & ~lead & ~same_place] for n in _MARKS}
        rows += _send(sub, _group_of(sub, groups), 1, _MARKS)
        compared = np.where(many, lead, ~twin)
        several, most = _often(e["anchor"], compared, 1), _often(e["anchor"], compared, max(1, hot))
        names2 = ("anchor", *_MARKS)
        for kind, ask in ((2, compared & several & ~most), (3, compared & most)):
            sub = {n: e[n][ask] for n in names2}
            rows += _send(sub, _group_of(sub, groups), kind, names2)
        return pa.concat_tables([pa.Table.from_batches([_batch(rows)]), passed.cast(_batch([]).schema)])

    return settle


def symbols(texts: list[bytes], tags: np.ndarray) -> np.ndarray:
    """Bytes of all texts, raised by 256 for each tag and by 1."""
    return np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + 1 + 256 * np.repeat(tags, [len(t) for t in texts])


class RunLengthIndex:
    """Runs of the Burrows-Wheeler transform of texts, each ended by a separator, with suffix-array samples at run ends.

    Texts of different tags have symbols of their own, so that a pattern matches texts of its tag only.
    """

    def __init__(self, texts: list[bytes], tags: np.ndarray) -> None:
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.text = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        inside = np.ones(len(self.text), dtype=bool)
        inside[ends - 1] = False
        self.text[inside] = symbols(texts, tags)
        sa = self._suffixes(ends - 1, max(map(len, texts), default=0) + 1)
        bwt = self.text[sa - 1]
        new = np.ones(len(bwt), dtype=bool)
        new[1:] = bwt[1:] != bwt[:-1]
        new |= bwt == 0  # separators are distinct symbols
        self.start = np.flatnonzero(new)
        stop = np.append(self.start[1:], len(bwt))
        self.head = bwt[self.start]
        self.first, self.last, self.stop = sa[self.start], sa[stop - 1], stop
        size = stop - self.start
        self.run_of = np.repeat(np.arange(len(size)), size)
        by_head = np.argsort(self.head, kind="stable")
        self.by_head, runs = by_head, len(self.head)
        self.sorted_keys = self.head[by_head] * runs + by_head
        before = np.zeros(runs, dtype=np.int64)
        total = np.cumsum(size[by_head]) - size[by_head]
        before[by_head] = total  # rows of smaller symbols and of earlier runs of this one
        self.before = before

    def _suffixes(self, separators: np.ndarray, depth: int) -> np.ndarray:
        """The suffix array by prefix doubling; separators sort before all bytes, in order of place."""
        n = len(self.text)
        rank = self.text + len(separators) - 1
        rank[separators] = np.arange(len(separators))
        there = np.zeros(int(rank.max(initial=-1)) + 1, dtype=bool)
        there[rank] = True
        dense, kinds = (np.cumsum(there) - 1)[rank], int(there.sum()) + 1
        reach = 1
        while reach < 4 and kinds ** (reach + 1) < 1 << 62:  # as many symbols as one number holds
            reach += 1
        rank = np.zeros(n, dtype=np.int64)
        for k in range(reach):
            rank *= kinds
            rank[: max(n - k, 0)] += dense[k:] + 1
        order = np.argsort(rank)
        while True:
            held = rank[order]
            new = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])]) if n else held
            if reach >= depth or not n or new[-1] == n - 1:
                return order
            dense = np.empty(n, dtype=np.int64)
            dense[order] = new
            later = np.zeros(n, dtype=np.int64)
            later[: max(n - reach, 0)] = dense[reach:] + 1
            rank = dense * (n + 1) + later
            order = np.argsort(rank)
            reach *= 2

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, up to most."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(most > 0)
        n = len(self.text)
        while len(live):
            x, y = a[live] + out[live], b[live] + out[live]
            ok = (x < n) & (y < n)
            ok[ok] = (self.text[x[ok]] == self.text[y[ok]]) & (self.text[x[ok]] > 0)
            live = live[ok]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def step(self, row: np.ndarray, place: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of suffixes at `row` (their place in the text, their length) extended to the left by one symbol each."""
        runs = len(self.head)
        run = self.run_of[row]
        jump = np.flatnonzero(self.head[run] != symbol)
        if len(jump):
            at = np.searchsorted(self.sorted_keys, symbol[jump] * runs + run[jump])
            best, best_len = np.full(len(jump), -1), np.full(len(jump), -1)
            to_row, to_place = np.zeros(len(jump), dtype=np.int64), np.zeros(len(jump), dtype=np.int64)
            for side in (-1, 0):  # the end of the nearest such run above, the start of the nearest below
                k = at + side
                there = (k >= 0) & (k < runs)
                there[there] = self.head[self.by_head[k[there]]] == symbol[jump[there]]
                on = np.flatnonzero(there)
                cand = self.by_head[k[on]]
                sample = self.last[cand] if side else self.first[cand]
                got = self.common(sample, place[jump[on]], length[jump[on]])
                better = got > best_len[on]
                on, cand, sample, got = on[better], cand[better], sample[better], got[better]
                best[on], best_len[on], to_place[on] = cand, got, sample
                to_row[on] = self.stop[cand] - 1 if side else self.start[cand]
            found = best >= 0
            hit = jump[found]
            run[hit], row[hit], place[hit], length[hit] = best[found], to_row[found], to_place[found], best_len[found]
            lost = jump[~found]
        else:
            lost = jump
        out_row = self.before[run] + row - self.start[run]
        out_place, out_length = place - 1, length + 1
        out_row[lost], out_place[lost], out_length[lost] = row[lost], place[lost], 0
        return out_row, out_place, out_length

    def statistics(self, patterns: list[bytes], tags: np.ndarray, least: int) -> list[np.ndarray]:
        """Starts in each pattern at which it matches `least` bytes or more of the text; all patterns stream side by side."""
        sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)[order] - 1
        sizes = sizes[order]
        read = symbols(patterns, tags)
        row, length = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        place = np.full(len(sizes), self.first[0], dtype=np.int64)
        which, starts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            row[:live], place[:live], length[:live] = self.step(row[:live].copy(), place[:live].copy(), length[:live].copy(), read[ends[:live] - t])
            hit = np.flatnonzero(length[:live] >= least)
            which.append(order[hit])
            starts.append(sizes[hit] - 1 - t)
        which, starts = np.concatenate(which), np.concatenate(starts)
        by = np.argsort(which, kind="stable")
        return np.split(starts[by], np.searchsorted(which[by], np.arange(1, len(patterns))))


def earlier_matches(anchor: np.ndarray, rank: np.ndarray, texts: list[bytes]) -> list[np.ndarray]:
    """For stretches of some anchors, with their rank by place among those of the anchor: windows that a lower rank holds too."""
    found = [np.zeros(0, dtype=np.int64)] * len(texts)
    windows = np.array([len(t) - WINDOW + 1 for t in texts], dtype=np.int64)
    live = np.arange(len(texts))
    level = 0
    while len(live):
        half = rank[live] >> level
        top = np.zeros(int(anchor.max()) + 1, dtype=np.int64)
        np.maximum.at(top, anchor[live], half)
        earlier = live[(half % 2 == 0) & (half < top[anchor[live]])]
        later = live[half % 2 == 1]
        if len(earlier) and len(later):
            pair = rank >> (level + 1)  # halves of different pairs must not meet
            index = RunLengthIndex([texts[i] for i in earlier], pair[earlier])
            for i, got in zip(later.tolist(), index.statistics([texts[i] for i in later], pair[later], WINDOW), strict=True):
                found[i] = np.union1d(found[i], got)
        done = np.array([len(found[i]) == windows[i] for i in live])
        live = live[~done & (top[anchor[live]] > 0)]
        level += 1
    return found


def _longest_shared(sides: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Longest prefix that each row of bytes shares with another row of its number."""
    width = sides.shape[1]
    order = np.lexsort((np.ascontiguousarray(sides).view(f"S{width}").ravel(), number))
    same = sides[order[1:]] == sides[order[:-1]]
    shared = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    shared[number[order[1:]] != number[order[:-1]]] = 0
    out = np.zeros(len(order), dtype=np.int64)
    out[order[1:]] = shared
    out[order[:-1]] = np.maximum(out[order[:-1]], shared)
    return out


def trimmed(raw: np.ndarray, ends: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one anchor that may share a window, and the part (from, to) of each that may.

    A shared window holds the anchor and what the stretches have in common on either side of it, so
    nothing beyond the longest such parts can match.
    """
    begin = ends - size
    at = np.arange(max(0, len(raw) - ANCHOR + 1))
    owner = np.searchsorted(ends, at, side="right")
    hit = np.flatnonzero((W.rolling_hashes(raw, at, at + ANCHOR) == anchor[owner]) & (at + ANCHOR <= ends[owner]))
    place = np.full(len(ends), -1, dtype=np.int64)
    place[owner[hit][::-1]] = at[hit][::-1]  # the first in each
    reach = np.arange(WINDOW - ANCHOR)
    padded = np.concatenate([raw, np.zeros(1, dtype=np.uint8)])
    sides = []
    for where, inside in ((place[:, None] + ANCHOR + reach, lambda w: w < ends[:, None]), (place[:, None] - 1 - reach, lambda w: w >= begin[:, None])):
        sides.append(_longest_shared(padded[np.where(inside(where), where, len(raw))], np.unique(anchor, return_inverse=True)[1]))
    right, left = sides
    keep = np.flatnonzero(left + ANCHOR + right >= WINDOW)
    low, high = np.maximum(begin, place - left), np.minimum(ends, place + ANCHOR + right)
    keep = keep[high[keep] - low[keep] >= WINDOW]
    return keep, low[keep] - begin[keep], high[keep] - begin[keep]


def _first_windows(e: dict[str, np.ndarray], groups: int) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """The first of equal windows, and kind 1 of the others, in runs."""
    order = np.lexsort((e["start"], e["row"], e["doc"], e["print"], e["anchor"]))
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = (e["anchor"][order[1:]] != e["anchor"][order[:-1]]) | (e["print"][order[1:]] != e["print"][order[:-1]])
    later = order[~lead]
    later = later[np.lexsort((e["start"][later], e["row"][later], e["doc"][later]))]
    doc, row, start = (e[n][later] for n in ("doc", "row", "start"))
    edge = np.ones(len(later), dtype=bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (start[1:] % 128 == 0)  # a count is one byte
    at = np.flatnonzero(edge)
    sub = {"doc": doc[at], "row": row[at], "start": start[at], "count": np.diff(np.append(at, len(later))).astype(np.uint8)}
    chosen = np.sort(order[lead])
    return {n: v[chosen] for n, v in e.items()}, list(_send(sub, _group_of(sub, groups), 1, _MARKS))


def _compare(groups: int):
    """Kind 1 for stretches by their bytes (kind 0) and for windows by their hashes (kind 3). Kind 1 of before passes."""

    def compare(group: pa.Table) -> pa.Table:
        of = lambda kind: group.filter(pc.equal(group.column("kind"), kind))
        windows, passed, group = of(3), of(1), of(0)
        marks = _first_windows(_received(windows, tuple(n for n, _ in ENTRY)), groups)[1]
        held = [pa.Table.from_batches([_batch(marks)]), passed.cast(_batch([]).schema)]
        if not group.num_rows:
            return pa.concat_tables(held)
        e = _received(group, ("anchor", *_MARKS))
        raw = b"".join(group.column("bytes").to_pylist())
        size = e["count"].astype(np.int64) + WINDOW - 1
        ends = np.cumsum(size)
        keep, low, high = trimmed(np.frombuffer(raw, dtype=np.uint8), ends, size, e["anchor"])
        order = np.lexsort((e["start"][keep], e["row"][keep], e["doc"][keep], e["anchor"][keep]))
        keep, low, high = keep[order], low[order], high[order]
        begin = (ends - size)[keep]
        texts = [raw[b + x : b + y] for b, x, y in zip(begin.tolist(), low.tolist(), high.tolist(), strict=True)]
        e = {n: v[keep] for n, v in e.items()}
        new = np.ones(len(order), dtype=bool)
        new[1:] = e["anchor"][1:] != e["anchor"][:-1]
        number = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        found = earlier_matches(number, np.arange(len(order)) - at[number], texts) if len(order) else []
        which = np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64)
        starts = np.concatenate([np.zeros(0, dtype=np.int64), *found]) + low[which]
        edge = np.ones(len(starts), dtype=bool)
        edge[1:] = (which[1:] != which[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, len(starts)))
        sub = {"doc": e["doc"][which[first]], "row": e["row"][which[first]], "start": e["start"][which[first]] + starts[first], "count": count.astype(np.uint8)}
        return pa.concat_tables([pa.Table.from_batches([_batch(list(_send(sub, _group_of(sub, groups), 1, _MARKS)))]), *held])

    return compare


def _by_document(docs: pa.Table, e: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(row of docs, entries of it), for every row of the group."""
    order = np.lexsort((e["start"], e["row"], e["doc"]))
    held = {n: e[n][order] for n in ("doc", "row")}
    for n, (doc, row) in enumerate(zip(docs.column("_doc").to_pylist(), docs.column("_row").to_pylist(), strict=True)):
        if doc is None:
            yield n, order[:0]
            continue
        low, high = np.searchsorted(held["doc"], doc, "left"), np.searchsorted(held["doc"], doc, "right")
        own = held["row"][low:high]
        yield n, order[low + np.searchsorted(own, row, "left") : low + np.searchsorted(own, row, "right")]


def _fetch(groups: int):
    """Kind 0: the bytes of the places that kind 2 asks for, by anchor; kind 3: hashes of the windows that kind 3 asks for, the first of equal ones; kind 1: the others."""
    names = ("anchor", *_MARKS)

    def windows_of(body: bytes, e: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        count = e["count"][at].astype(np.int64)
        which = np.repeat(at, count)
        start = e["start"][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        prints = W.span_hashes(np.frombuffer(body, dtype=np.uint8), start, start + WINDOW)
        return {"anchor": e["anchor"][which], "print": prints, "doc": e["doc"][which], "row": e["row"][which], "start": start, "count": np.ones(len(which), dtype=np.uint8)}

    def fetch(docs: pa.Table, asked: pa.Table) -> pa.Table:
        of = [_received(asked.filter(pc.equal(asked.column("kind"), kind)), names) for kind in (2, 3)]
        e = {n: np.concatenate([x[n] for x in of]) for n in names}
        cold = len(of[0]["doc"])
        texts = docs.column("_text").cast(pa.large_binary()) if docs.num_rows else docs.column("_text")
        taken, raw, done, dealt = [], [], set(), []
        for n, at in _by_document(docs, e) if asked.num_rows else []:
            if len(at) and at[0] not in done:  # a row given twice answers once
                done.add(at[0])
                body = texts[n].as_py()
                if len(hot := at[at >= cold]):
                    dealt.append(windows_of(body, e, hot))
                at = at[at < cold]
                for i in at:
                    s = int(e["start"][i])
                    raw.append(body[s : s + int(e["count"][i]) + WINDOW - 1])
                taken.append(at)
        chosen = np.concatenate([np.zeros(0, dtype=np.int64), *taken])
        sub = {n: e[n][chosen] for n in names}
        rows = list(_send(sub, (sub["anchor"] % np.uint64(groups)).astype(np.int64), 0, names, raw))
        if dealt:
            first, marks = _first_windows({n: np.concatenate([d[n] for d in dealt]) for n, _ in ENTRY}, groups)
            rows += marks + list(_send(first, (W.mix(first["print"]) % np.uint64(groups)).astype(np.int64), 3, tuple(n for n, _ in ENTRY)))
        return pa.Table.from_batches([_batch(rows)])

    return fetch


def _remove(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """The documents of a group without the marked bytes."""
    e = _received(marks, _MARKS)
    out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "spans", "kept_sha256", "kept_text")}
    for n, at in _by_document(docs, e):
        text = docs.column("_text")[n].as_py()
        body = (text or "").encode()
        spans: list[list[int]] = []
        for s, c in zip(e["start"][at].tolist(), e["count"][at].tolist(), strict=True):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], s + c + WINDOW - 1)
            else:
                spans.append([s, s + c + WINDOW - 1])
        parts, last = [], 0
        for a, b in spans:
            parts.append(body[last:a])
            last = b
        kept = b"".join([*parts, body[last:]])
        out["n_bytes"].append(len(body))
        out["n_removed"].append(len(body) - len(kept))
        out["spans"].append([{"from": a, "to": b} for a, b in spans])
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept_text"].append(None if text is None else kept.decode(errors="ignore"))
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.string(), pa.string()]
    return pa.table([docs.column("_doc"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True)), docs.column("_carried")], names=["_doc", *out, "_carried"])


def repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, spans (removed runs, in bytes), kept_sha256, kept_text and the carried columns.

    A byte is removed if it lies in a 100-byte string of its text that also starts earlier: in a
    text of a smaller key or earlier in the same text; this is judged on the input. kept_text is
    the rest without characters that a removed run cut. A null text has no bytes and stays null,
    shorter texts than 100 bytes and null keys are never touched nor compared. The key is an
    integer. A row given twice is one text, of which neither copy is the earlier; different texts
    of one key are told apart and ordered by a 64-bit hash. Carried columns may have any name but
    those of the result. No rows give no rows.
    """
    groups = pieces(docs, text, GROUP_BYTES, 4)
    # extra columns travel as one struct, whatever their names
    whole = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_row"), (F.struct(*(F.col(c) for c in carry)) if carry else F.lit(0)).alias("_carried"))
    slim = whole.drop("_carried")
    work = Work(docs.sparkSession, "repeats")
    sent = _cut(slim.filter("_text IS NOT NULL"), groups, MANY_PLACES)
    first = work.settled(sent.groupBy("bucket").applyInArrow(W.tidy_group(_settle_equal(groups, HOT_STRETCHES, MANY_PLACES)), _PACKED), "equal")
    wanted = slim.withColumn("_group", _group(groups)).groupBy("_group").cogroup(first.filter("kind >= 2").withColumnRenamed("bucket", "_group").groupBy("_group"))
    second = wanted.applyInArrow(W.tidy_pair(_fetch(groups)), _PACKED).groupBy("bucket").applyInArrow(W.tidy_group(_compare(groups)), _PACKED)
    marks = work.concluded(first.filter("kind = 1").union(second), "marks").withColumnRenamed("bucket", "_group")
    made = T.StructType.fromDDL("n_bytes long, n_removed long, spans array<struct<from:long,to:long>>, kept_sha256 string, kept_text string")
    schema = T.StructType([whole.schema["_doc"], *made.fields, whole.schema["_carried"]])
    out = whole.withColumn("_group", _group(groups)).groupBy("_group").cogroup(marks.groupBy("_group")).applyInArrow(W.tidy_pair(_remove), schema)
    return out.select(F.col("_doc").alias(key), "n_bytes", "n_removed", "spans", "kept_sha256", "kept_text", *(F.col(f"_carried.`{c}`").alias(c) for c in carry))
