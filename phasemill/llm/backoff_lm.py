"""Language-model scores from a weighted backoff automaton.

The corpus is cut into blocks of whole documents. Each block sends the sorted hashes of its
distinct n-grams with their training counts to buckets of the hash range; a bucket adds up
the counts of all blocks and answers each block in the order of its question. So a block
gets the part of the model that its texts can reach, however large the model is, and builds
from it an automaton: n-grams are states, arcs carry smoothed log-probabilities, and failure
arcs lead to the longest shorter history. One left-to-right traversal carries the states of
all texts of the block side by side and adds up the weights.

Smoothing: absolute discounting for single words, with the discounted mass on one unknown
word, and a Dirichlet prior of `strength` pseudo-counts from the next shorter history above:
p(w|h) = (c(hw) + strength * p(w|h')) / (c(h) + strength), a proper distribution in which
the failure arc of h weighs strength / (c(h) + strength).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm import words as W
from phasemill.llm.shared import settled

#: Text that a block holds at most, besides the rest of its last Arrow batch.
BLOCK_BYTES = 8_000_000
#: n-grams of all blocks that a bucket is made for; a text has one word in six bytes or fewer.
BUCKET_KEYS = 3_000_000
#: Tokens that a lane of the traversal reads; longer texts take several lanes that begin with the history before them.
LANE = 512
#: Bits of an n-gram's hash. Of 10^12 different n-grams one in a million shares its hash with another; each bit less saves a 45th of what is sent.
KEY_BITS = 60
_END = W.mix(np.array([0xE0F], dtype=np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers from 0 of which small ones are frequent: their bit lengths compressed, then the bits below the first of each length in turn."""
    held = values.astype(np.int64) + 1
    length = np.floor(np.log2(held)).astype(np.uint8)
    head = zstandard.ZstdCompressor(level=3).compress(length.tobytes())
    parts = [np.int64(len(head)).tobytes(), head]
    for n in range(1, int(length.max(initial=0)) + 1):
        low = held[length == n]
        parts.append(np.packbits((low[:, None] >> np.arange(n)) & 1).tobytes())
    return b"".join(parts)


def unpack_numbers(raw: bytes) -> np.ndarray:
    size = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    length = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]), dtype=np.uint8)
    out, at = np.zeros(len(length), dtype=np.int64), 8 + size
    for n in range(1, int(length.max(initial=0)) + 1):
        place = np.flatnonzero(length == n)
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=-(-len(place) * n // 8), offset=at), count=len(place) * n)
        at += -(-len(place) * n // 8)
        out[place] = (1 << n) - 1 + bits.reshape(-1, n).astype(np.int64) @ (1 << np.arange(n))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows of one block, an end token after each row, and the rows' bounds."""
    lowered = W.LOWER[data]
    starts, ends, bounds = W.segment(lowered, offsets, W.SPACED)
    return np.insert(W.span_hashes(lowered, starts, ends), bounds[1:], _END[0]), bounds + np.arange(len(bounds))


class Grams:
    """Distinct k-grams of a sequence of rows: sorted keys, and for each begin of a window its place among them (-1: none)."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, k: int) -> None:
        windows, whole = W.window_hashes(hashes, bounds, k)
        self.keys, inverse = np.unique(windows[whole] >> np.uint64(64 - KEY_BITS), return_inverse=True)
        self.at = np.full(len(hashes), -1, dtype=np.int64)
        self.at[whole] = inverse

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each occurs from the chosen places."""
        return np.bincount(self.at[chosen & (self.at >= 0)], minlength=len(self.keys)).astype(np.uint32)


def cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, equal parts of the hash range, that sorted keys fall in, and the bounds of each among the keys."""
    of = ((keys >> np.uint64(KEY_BITS - 31)) * np.uint64(buckets)) >> np.uint64(31)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
    return of[at].astype(np.int64), np.append(at, len(keys))


def _blocks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of whole documents: their keys, whether they are held out, and their token sequence as numbers of distinct words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys = pa.concat_arrays([pa.concat_arrays([h[0]]) for h in held])
            hashes = np.concatenate([h[2] for h in held])
            lengths = np.concatenate([np.diff(h[3]) for h in held])
            distinct, ids, often = np.unique(hashes, return_inverse=True, return_counts=True)
            by = np.argsort(-often, kind="stable")  # frequent words get small numbers; of one bit length, in order of their hashes
            by = by[np.lexsort((by, np.floor(np.log2(np.arange(1, len(by) + 1)))))]
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = np.arange(len(by))
            distinct, ids = distinct[by], rank[ids]
            batch = pa.RecordBatch.from_arrays([keys, pa.concat_arrays([h[1] for h in held])], names=["key", "held"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            name = np.concatenate([hashes[:4096] + np.arange(min(4096, len(hashes)), dtype=np.uint64), held[0][4]])
            name = W.mix(np.bitwise_xor.reduce(W.mix(name), keepdims=True) + np.uint64(len(ids))).view(np.int64)
            parts = [sink.getvalue().to_pybytes(), pack(lengths.astype(np.int64)), pack(np.diff(distinct, prepend=np.uint64(0))), pack_numbers(ids)]
            return pa.RecordBatch.from_arrays([pa.array(name), *(pa.array([p], pa.binary()) for p in parts)], names=["block", "docs", "lengths", "words", "ids"])

        number = 0
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(2)):
                hashes, bounds = tokens(data, offsets)
                held.append((batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), hashes, bounds, np.array([batch.column(3)[first].as_py() << 32 | number], dtype=np.uint64)))
                number += 1
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    share = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(10)) == 0, F.lit(False))
    return docs.select(F.col(key), share.alias("held"), F.col(text), F.spark_partition_id().alias("part")).mapInArrow(W.tidy(cut), "block long, docs binary, lengths binary, words binary, ids binary")


def _opened(row: dict) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Documents, token hashes and bounds of a block."""
    docs = pa.ipc.open_stream(row["docs"]).read_next_batch()
    distinct = np.cumsum(unpack(row["words"], np.uint64), dtype=np.uint64)
    return docs, distinct[unpack_numbers(row["ids"])], np.concatenate([[0], np.cumsum(unpack(row["lengths"], np.int64))])


def _asked(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Each block's distinct n-grams with their counts in its training documents, by order and bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, hashes, bounds = _opened(row)
                train = ~np.repeat(docs.column(1).to_numpy(zero_copy_only=False), np.diff(bounds))
                for k in range(1, order + 1):
                    grams = Grams(hashes, bounds, k)
                    counts, (some, at) = grams.counts(train), cuts(grams.keys, buckets)
                    parts = list(zip(at[:-1], at[1:], strict=True))
                    columns = [pa.array([row["block"]] * len(some), pa.int64()), pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32())]
                    columns += [pa.array([pack(np.diff(grams.keys[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()), pa.array([pack(counts[a:b]) for a, b in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "k", "bucket", "keys", "counts"])

    return blocks.mapInArrow(W.tidy(ask), "block long, k int, bucket int, keys binary, counts binary")


def _answer(group: pa.Table) -> pa.Table:
    """What other blocks add to each block's training counts, in the order of its keys; known, once, twice: distinct n-grams of the bucket by count, and total."""
    keys = [np.cumsum(unpack(raw.as_py(), np.uint64), dtype=np.uint64) for raw in group.column("keys")]
    counts = np.concatenate([unpack(raw.as_py(), np.uint32) for raw in group.column("counts")])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
    ends = np.cumsum([0, *map(len, keys)])
    answers = [pack(total[inverse[a:b]] - counts[a:b].astype(np.uint64)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    size = group.num_rows
    first = lambda n: pa.array([int(n)] + [0] * (size - 1), pa.int64())
    return pa.table({"block": group.column("block"), "k": group.column("k"), "bucket": group.column("bucket"), "counts": pa.array(answers, pa.binary()), "known": first((total > 0).sum()), "once": first((total == 1).sum()), "twice": first((total == 2).sum()), "total": first(total.sum())})


class Automaton:
    """States 0 (no history) and the n-grams below the highest order that training has; arcs by (state, word)."""

    def __init__(self, grams: list[Grams], counts: list[np.ndarray], hashes: np.ndarray, model: dict) -> None:
        self.order, self.unknown = len(grams), model["unknown"]
        single = np.where(counts[0] > 0, (counts[0] - model["discount"]) / max(model["total"], 1), 0.0)
        self.width = len(grams[0].keys)
        word = grams[0].at
        weight, state_of, base = [], [], 1
        keys, logs, goes = [], [], []
        self.fail, self.back = [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
        for k, (g, c) in enumerate(zip(grams, counts, strict=True), 1):
            there = np.flatnonzero(g.at >= 0)
            example = np.zeros(len(g.keys), dtype=np.int64)
            example[g.at[there]] = there  # a place of each
            seen = c > 0
            states = np.zeros(len(g.keys), dtype=np.int64)
            if k < self.order:
                states[seen] = base + np.arange(seen.sum())
                base += int(seen.sum())
            last = word[example + k - 1]
            if k == 1:
                p, parent = single, np.zeros(len(g.keys), dtype=np.int64)
            else:
                before, shorter = grams[k - 2].at[example], grams[k - 2].at[example + 1]
                parent = state_of[k - 2][before]
                p = (c + model["strength"] * weight[k - 2][shorter]) / (counts[k - 2][before] + model["strength"])
            weight.append(p)
            state_of.append(states)
            if k < self.order:
                suffix = np.zeros(len(g.keys), dtype=np.int64) if k == 1 else state_of[k - 2][grams[k - 2].at[example + 1]]
                self.fail.append(suffix[seen])
                self.back.append(np.log10(model["strength"] / (c[seen] + model["strength"])))
                target = states
            else:
                target = np.zeros(len(g.keys), dtype=np.int64) if k == 1 else state_of[k - 2][grams[k - 2].at[example + 1]]
            keys.append(parent[seen] * self.width + last[seen])
            logs.append(np.log10(p[seen]))
            goes.append(target[seen])
        self.fail, self.back = np.concatenate(self.fail), np.concatenate(self.back)
        keys, logs, goes = np.concatenate(keys), np.concatenate(logs), np.concatenate(goes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.logs, self.goes = keys[order], logs[order], goes[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and weights of one word each, by failure arcs where a state has no arc for it."""
        weight, goal = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        left, at = np.arange(len(state)), state
        while len(left) and len(self.keys):
            asked = at * self.width + word[left]
            found = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            hit = self.keys[found] == asked
            weight[left[hit]] += self.logs[found[hit]]
            goal[left[hit]] = self.goes[found[hit]]
            left, at = left[~hit], at[~hit]
            lost = at == 0
            weight[left[lost]] += self.unknown
            left, at = left[~lost], at[~lost]
            weight[left] += self.back[at]
            at = self.fail[at]
        if not len(self.keys):
            weight += self.unknown
        return goal, weight

    def traverse(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The weight of each token: rows are cut into lanes that advance together, each carrying its state."""
        lengths = np.diff(bounds)
        n_lanes = -(-lengths // LANE)
        inner = np.arange(n_lanes.sum()) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        begin = np.repeat(bounds[:-1], n_lanes) + inner * LANE
        end = np.minimum(begin + LANE, np.repeat(bounds[1:], n_lanes))
        lead = np.where(inner > 0, self.order - 1, 0)  # the history before a later lane
        order = np.argsort(-(end - begin + lead), kind="stable")
        at, end, begin = (begin - lead)[order], end[order], begin[order]
        size = end - at
        state = np.zeros(len(at), dtype=np.int64)
        out = np.zeros(len(words))
        for t in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            place = at[:live] + t
            state[:live], weight = self.step(state[:live], words[place])
            scored = place >= begin[:live]
            out[place[scored]] = weight[scored]
        return out


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = 3, strength: float = 20.0) -> DataFrame:
    """One row per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32(key as text) mod 10 is not 0; a null key is a training row.
    Tokens: lower-cased (A-Z) runs of other than white space and one end token per row, so a null or
    empty text has one token. base_score: log10 of the add-0.1 word model; score: that of the
    automaton of the given order. No rows give no rows; without training rows every token is
    unknown, with weight 0 in score. Rows that repeat count as often as they stand there.
    """
    blocks = settled(_blocks(docs, text, key), "lm-blocks")
    size = blocks.agg(F.sum(F.octet_length("ids") + F.octet_length("words"))).first()[0] or 0
    buckets = int(max(4, -(-size * order // BUCKET_KEYS)))
    answers = settled(_asked(blocks, order, buckets).groupBy("k", "bucket").applyInArrow(W.tidy_group(_answer), "block long, k int, bucket int, counts binary, known long, once long, twice long, total long"), "lm-answers")
    of = answers.filter("k = 1").agg(F.sum("known"), F.sum("once"), F.sum("twice"), F.sum("total")).first()
    known, once, twice, total = (int(x or 0) for x in of)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    unknown = float(np.log10(discount * known / total)) if total else 0.0
    model = {"discount": discount, "total": total, "strength": strength, "unknown": unknown}
    kind = docs.schema[key].dataType.simpleString()

    def score(asked: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        got: dict[int, list] = {}
        for k, b, raw in zip(told.column("k").to_pylist(), told.column("bucket").to_pylist(), told.column("counts").to_pylist(), strict=True):
            got.setdefault(k, []).append((b, raw))
        for row in asked.to_pylist():
            held, hashes, bounds = _opened(row)
            grams = [Grams(hashes, bounds, k) for k in range(1, order + 1)]
            train = ~np.repeat(held.column(1).to_numpy(zero_copy_only=False), np.diff(bounds))
            others = [np.concatenate([np.zeros(0, dtype=np.uint64), *(unpack(raw, np.uint64) for _, raw in sorted(got.get(k, []), key=lambda x: x[0]))]) for k in range(1, order + 1)]
            counts = [(g.counts(train) + more).astype(np.float64) for g, more in zip(grams, others, strict=True)]
            words = grams[0].at
            weights = Automaton(grams, counts, hashes, model).traverse(words, bounds)
            c = counts[0][words]
            base = np.log10((c + 0.1) / (total + 0.1 * (known + 1)))
            sums = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every row has its end token
            out.append(pa.table({key: held.column(0), "held_out": held.column(1), "n_tokens": pa.array(np.diff(bounds)), "n_known": pa.array(sums((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(bounds) - 1, total, dtype=np.int64)), "base_score": pa.array(sums(base)), "score": pa.array(sums(weights))}))
        return pa.concat_tables(out)

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.select("block", "k", "bucket", "counts").groupBy("block")).applyInArrow(W.tidy_pair(score), schema)
