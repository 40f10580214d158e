"""A prefix trie of conversations, built as a burst trie.

Turns are known by 128-bit digests of role and text. Conversations that are the same throughout are
one sequence with a weight. A container holds the suffixes of all sequences under one trie head, as
long rows. One with more rows than a limit bursts: what all its sequences begin with becomes a chain
of nodes, found by one aggregation over its positions, and the rest is dealt to new containers by
the next turn id. So a container of one long conversation, or of many copies, takes one round, and
rounds end when none is left above the limit. The others are dealt to shards, where a task sorts the
sequences of each container and sweeps neighbours for the nodes that they share. Sums over subtrees
are made within a container and carried up from container to container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.llm.shared import Work, settled

#: Rows (turns) of a container that one task sorts and sweeps; a larger one bursts.
LIMIT = 20_000
#: Values of turn, or places of a chain, that are numbered or summed together; as a power of two.
BLOCK_BITS = 12
#: Bytes of joined ids in a row.
PIECE_BYTES = 65_536

_ROWS = ["head", "up", "depth", "cls", "weight", "length", "pos", "tid", "size"]
_NODE = "conv_id long, depth long, parent_conv_id long, turn_id binary, n_bytes long, n_convs long, n_children long, n_leaves long, saved long, end_conv_id long, n_ends long"


class Trie(NamedTuple):
    """nodes (conv_id, depth, parent_conv_id, turn_id, n_bytes, n_convs, n_children, n_leaves, saved, end_conv_id, n_ends), and ends (end_conv_id, conv_id).

    A node is named by the smallest conversation that begins with it and its depth, so its turns are
    the first `depth` ones of conversation conv_id. end_conv_id: the smallest of the n_ends
    conversations that are complete there, by which ends lists them.
    """

    nodes: DataFrame
    ends: DataFrame


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of role and text, of which null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substr(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(1), F.lit(32)))


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, tid, size): each conversation's turns from 0, by turn (null first), equal ones by a hash; size is the UTF-8 bytes of the text.

    Rows without a conversation are left out, rows given twice are two turns. A conversation is
    numbered in blocks of turn values, so that many tasks share a long one; only equal values, or
    null ones, meet in one task, which spills.
    """
    at = F.col(f"`{turn}`").cast("long")
    clean = rows.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), at.alias("turn"), F.coalesce(F.shiftright(at, BLOCK_BITS), F.lit(-(1 << 62))).alias("block"),
        turn_id(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("tid"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("size"),
    )
    own = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "tid")
    counts = clean.groupBy("conv", "block").agg(F.count("*").alias("n"))
    before = counts.select("conv", "block", (F.sum("n").over(Window.partitionBy("conv").orderBy("block")) - F.col("n")).alias("before"))
    placed = clean.withColumn("at", F.row_number().over(own) - 1).join(before, ["conv", "block"])
    return placed.select("conv", (F.col("before") + F.col("at")).alias("pos"), "tid", "size")


def grafted(turns: DataFrame, conversations: DataFrame, family: int, most: int) -> DataFrame:
    """Turns of every conversation with its first h replaced by the first h of its family's head.

    The head of conversation c is c - c % family, and h the crc32 of c in decimal, modulo most. All
    of the head's turns are taken if it has fewer, none if it is absent.
    """
    head = lambda c: F.col(c) - F.col(c) % family
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = turns.filter((F.col("pos") < most - 1) & (F.col("conv") == head("conv"))).withColumnRenamed("conv", "lead")
    sizes = heads.groupBy("lead").agg(F.count("*").alias("held"))
    members = conversations.select("conv", head("conv").alias("lead"))
    first = members.join(heads, "lead").filter(F.col("pos") < h).select("conv", "pos", "tid", "size")
    shift = members.join(sizes, "lead", "left").select("conv", (F.least(F.coalesce("held", F.lit(0)), h) - h).alias("shift"))
    return first.unionByName(turns.filter(F.col("pos") >= h).join(shift, "conv").select("conv", (F.col("pos") + F.col("shift")).alias("pos"), "tid", "size"))


def trie(turns: DataFrame, conversations: DataFrame, limit: int = LIMIT, work: Work | None = None) -> Trie:
    """The trie of conversations (conv), whose turns are (conv, pos, tid, size) with pos from 0 without gaps.

    Every different sequence of first turns is a node, the empty one at depth 0 too. n_convs counts
    the conversations that begin with it, n_children its next turns, n_leaves the childless nodes
    under it, itself included; saved sums (n_convs - 1) * n_bytes under it, the bytes of the last
    turn. Conversations without turns end at the root. No conversations give no rows. Sequences are
    compared by hashes: turn ids of 128 bits, and two of 64 bits and the length for whole ones.
    """
    work = work or Work(conversations.sparkSession, "trie")
    prints = turns.groupBy("conv").agg(F.bit_xor(F.xxhash64("pos", "tid")).alias("a"), F.bit_xor(F.xxhash64("tid", "pos", F.lit(1))).alias("b"), F.count("*").alias("length"))
    members = work.settled(conversations.select("conv").join(prints, "conv", "left").fillna(0, ["a", "b", "length"]), "members")
    classes = work.settled(members.groupBy("length", "a", "b").agg(F.min("conv").alias("cls"), F.count("*").alias("weight")), "classes")
    all_convs, top, n_top = classes.agg(F.sum("weight"), F.min("cls"), F.sum(F.when(F.col("length") == 0, F.col("weight")))).first()
    ends = settled(members.join(classes, ["length", "a", "b"]).select(F.col("cls").alias("end_conv_id"), F.col("conv").alias("conv_id")), "ends")
    if top is None:
        return Trie(work.concluded(turns.sparkSession.createDataFrame([], _NODE), "nodes"), ends)
    filled = classes.filter("length > 0")
    head = filled.agg(F.min("cls")).first()[0]
    rest = work.settled(
        turns.join(filled.select(F.col("cls").alias("conv"), "weight", "length"), "conv").select(F.lit(head).cast("long").alias("head"), F.lit(top).cast("long").alias("up"), F.lit(0).cast("long").alias("depth"), F.col("conv").alias("cls"), "weight", "length", "pos", "tid", "size"),
        "suffixes",
    )
    chains, swept = [], []
    while True:
        sizes = work.settled(rest.groupBy("head").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("head"), "oversized")
        whole = sizes.isEmpty()
        swept.append(work.settled(_swept(rest if whole else rest.join(sizes, "head", "left_anti")), "swept"))
        if whole:
            break
        chain, rest = _burst(rest.join(sizes, "head", "left_semi"), work)
        chains.append(chain)
    below, nodes = _totals(swept[-1]), [s.drop("head", "up", "base") for s in swept]
    for chain, other in zip(chains[::-1], swept[-2::-1], strict=True):
        held = work.settled(_held(chain, below.groupBy("up").agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))), "chain")
        nodes.append(held.drop("head", "up", "base"))
        below = _totals(held).unionByName(_totals(other))
    made = reduce(DataFrame.unionByName, nodes)
    under = made.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    root = under.select(
        F.lit(top).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("long").alias("n_bytes"), F.lit(all_convs).cast("long").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), F.lit(classes.filter("length = 0").agg(F.min("cls")).first()[0]).cast("long").alias("end_conv_id"), F.lit(n_top or 0).cast("long").alias("n_ends"),
    )
    return Trie(work.concluded(made.unionByName(root), "nodes"), ends)


def _burst(rows: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """The chains of nodes that each container's sequences have in common, and the rows of the containers under them."""
    stats = work.settled(rows.groupBy("head", "up", "depth", "pos").agg(F.count("*").alias("n"), F.min("tid").alias("tid"), F.max("tid").alias("high"), F.min("size").alias("size"), F.sum("weight").alias("n_convs")), "positions")
    first = stats.filter("pos = depth").select("head", F.col("n").alias("all"), F.col("n_convs").alias("whole"))
    shared = (F.col("n") == F.col("all")) & (F.col("tid") == F.col("high"))
    seen = stats.join(first, "head")
    common = work.settled(seen.groupBy("head", "depth", "up").agg(F.coalesce(F.min(F.when(~shared, F.col("pos"))), F.max("pos") + 1).alias("common")), "common")
    last = rows.join(common.select("head", "common"), "head").filter("pos = common - 1 AND length = common").select("head", F.col("cls").alias("end_conv_id"), F.col("weight").alias("n_ends"), F.col("pos"))
    chain = seen.join(common.select("head", "common"), "head").filter("pos < common").join(last, ["head", "pos"], "left")
    nodes = work.settled(
        chain.select("head", "up", F.col("depth").alias("base"), "common", "pos", F.col("tid").alias("turn_id"), F.col("size").alias("n_bytes"), F.col("whole").alias("n_convs"), "end_conv_id", F.coalesce("n_ends", F.lit(0)).alias("n_ends")),
        "chain-nodes",
    )
    # the next turn of each sequence tells its new container, named by the smallest sequence there
    left = rows.join(common.select("head", "common"), "head").filter("pos >= common")
    next_turn = left.filter("pos = common").select("head", "cls", F.col("tid").alias("next"))
    named = next_turn.groupBy("head", "next").agg(F.min("cls").alias("new"))
    dealt = next_turn.join(named, ["head", "next"]).select("cls", "new")
    up = F.when(F.col("common") > F.col("depth"), F.col("head")).otherwise(F.col("up"))  # a root that nothing follows alone makes no chain
    below = left.join(dealt, "cls").select(F.col("new").alias("head"), up.alias("up"), F.col("common").alias("depth"), "cls", "weight", "length", "pos", "tid", "size")
    return nodes, work.settled(below, "suffixes")


def _held(chain: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of chains with what is under them; below (up, n, leaves, saved): sums over the containers under each chain."""
    own = chain.withColumns({"w": (F.col("n_convs") - 1) * F.col("n_bytes"), "block": F.shiftright("pos", BLOCK_BITS)})
    blocks = own.groupBy("head", "block").agg(F.sum("w").alias("s"))
    after = blocks.select("head", "block", (F.sum("s").over(Window.partitionBy("head").orderBy(F.desc("block"))) - F.col("s")).alias("after"))
    within = F.sum("w").over(Window.partitionBy("head", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    summed = own.withColumn("within", within).join(after, ["head", "block"]).join(below.withColumnRenamed("up", "head"), "head", "left")
    children = F.when(F.col("pos") + 1 < F.col("common"), F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return summed.select(
        "head", "up", "base", F.col("head").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(F.col("pos") == F.col("base"), F.col("up")).otherwise(F.col("head")).alias("parent_conv_id"), "turn_id", "n_bytes", "n_convs",
        children.alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.col("within") + F.col("after") + F.coalesce("saved", F.lit(0))).alias("saved"), "end_conv_id", "n_ends",
    )


def _totals(nodes: DataFrame) -> DataFrame:
    """(up, leaves, saved) of each container: those of its topmost node."""
    return nodes.filter("depth = base + 1").select("up", F.col("n_leaves").alias("leaves"), "saved")


def _swept(rows: DataFrame) -> DataFrame:
    """Nodes of containers that are sorted and swept in tasks."""
    dealt = rows.select(*_ROWS).repartition("head").sortWithinPartitions("head", "cls", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = batch.column(0).to_numpy()
            cut = int(np.searchsorted(heads, heads[-1]))  # containers before the last one are whole
            if cut or held and held[-1].column(0)[-1].as_py() != heads[0]:
                yield from _sweep(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _sweep(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "head long, up long, base long, " + _NODE)


def _sweep(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Nodes of whole containers, whose rows are in order of head, sequence, place."""
    if not table.num_rows:
        return
    head, up, base, cls, weight, length, pos, size = (table.column(c).to_numpy() for c in ("head", "up", "depth", "cls", "weight", "length", "pos", "size"))
    raw = np.frombuffer(b"".join(table.column("tid").to_pylist()), dtype="S16")
    turns, ids = np.unique(raw, return_inverse=True)
    starts = np.flatnonzero(np.r_[True, (cls[1:] != cls[:-1]) | (head[1:] != head[:-1])])
    counts = np.diff(np.r_[starts, len(cls)])
    keys = ids.astype(">u4").tobytes()
    order = np.array(sorted(range(len(starts)), key=lambda i: (head[starts[i]], keys[4 * starts[i] : 4 * (starts[i] + counts[i])])), dtype=np.int64)
    starts, counts = starts[order], counts[order]
    at = np.r_[0, np.cumsum(counts)]
    row = np.repeat(starts - at[:-1], counts) + np.arange(at[-1])  # rows by sequence in order
    ids, place, of = ids[row], pos[row] - base[row], np.repeat(np.arange(len(starts)), counts)
    # how much of each sequence the one before it begins with too
    before = np.r_[0, at[:-2]][of] + place
    same = (of > 0) & (place < np.r_[0, counts[:-1]][of]) & (head[row] == head[starts[np.maximum(of - 1, 0)]])
    same[same] = ids[same] == ids[before[same]]
    shared = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, place), at[:-1])
    shared = np.minimum(shared, counts)
    fresh = place >= shared[of]
    node = np.zeros(len(row), dtype=np.int64)
    node[fresh] = np.arange(int(fresh.sum()))
    for s in np.flatnonzero(shared):
        node[at[s] : at[s] + shared[s]] = node[at[s - 1] : at[s - 1] + shared[s]]
    made = row[fresh]
    n = len(made)
    parent = np.where(place > 0, np.r_[0, node[:-1]], -1)[fresh]
    n_convs, lowest = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(n_convs, node, weight[row])
    np.minimum.at(lowest, node, cls[row])
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (n_convs - 1) * size[made]
    levels = place[fresh]
    by_level = np.argsort(levels, kind="stable")
    bounds = np.searchsorted(levels[by_level], np.arange(levels.max() + 2))
    for level in range(int(levels.max()), 0, -1):
        some = by_level[bounds[level] : bounds[level + 1]]
        np.add.at(leaves, parent[some], leaves[some])
        np.add.at(saved, parent[some], saved[some])
    ended = pos[row] + 1 == length[row]
    end, n_ends = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    end[node[ended]], n_ends[node[ended]] = cls[row][ended], weight[row][ended]
    above = np.where(parent >= 0, lowest[parent], up[made])
    names = ["head", "up", "base", *(c.split()[0] for c in _NODE.split(", "))]
    tids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(raw[made]).tobytes())]).cast(pa.binary())
    columns = [pa.array(x) for x in (head[made], up[made], base[made], lowest, pos[made] + 1, above)] + [tids] + [pa.array(x) for x in (size[made], n_convs, children.astype(np.int64), leaves, saved)] + [pa.array(end, mask=n_ends == 0), pa.array(n_ends)]
    yield from pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches(10_000)


def joined_digests(ends: DataFrame) -> DataFrame:
    """(end_conv_id, digest): SHA-256, in hexadecimal, of the decimal conv_ids of each end, ascending and comma-joined.

    Ids are sorted by range and joined in pieces by many tasks; what goes through one task for a
    large end are its pieces in order, one at a time, as the digest of a text must.
    """
    ordered = ends.select("end_conv_id", "conv_id").repartitionByRange("end_conv_id", "conv_id").sortWithinPartitions("end_conv_id", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
            cuts = [c for s, e in zip(starts, [*starts[1:], len(keys)], strict=True) for c in range(s, e, PIECE_BYTES // 16)]
            texts = [",".join(map(str, ids[s:e])) for s, e in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[cuts] if cuts else [], pa.int64()), pa.array([part] * len(cuts), pa.int32()), pa.array(range(k, k + len(cuts)), pa.int64()), pa.array(texts, pa.string())], names=["end_conv_id", "part", "k", "ids"])
            k += len(cuts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], names=["end_conv_id", "digest"])
            out = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()])], names=["end_conv_id", "digest"])

    pieces = ordered.mapInArrow(join, "end_conv_id long, part int, k long, ids string")
    return pieces.repartition("end_conv_id").sortWithinPartitions("end_conv_id", "part", "k").select("end_conv_id", "ids").mapInArrow(digest, "end_conv_id long, digest string")


def grafted_trie(rows: DataFrame, family: int = 5, most: int = 9, limit: int = LIMIT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Trie:
    """The trie of conversations that share beginnings by families.

    Rows are numbered as in `numbered` and grafted as in `grafted`; other columns are not read. Null
    roles and texts are empty, rows without conv_id are left out, a row given twice is two turns. A
    conversation of any length is held as rows, never as one value. No rows give no rows.
    """
    work = Work(rows.sparkSession, "trie")
    turns = work.settled(numbered(rows, conv, turn, role, text), "turns")
    conversations = turns.filter("pos = 0").select("conv")
    return trie(work.settled(grafted(turns, conversations, family, most), "grafted"), conversations, limit, work)


def with_digests(found: Trie) -> DataFrame:
    """Nodes with ends_sha256: the digest of the conversations that end at each, that of the empty text for none."""
    several = joined_digests(found.ends.join(found.nodes.filter("n_ends > 1").select("end_conv_id"), "end_conv_id", "left_semi"))
    plain = F.sha2(F.when(F.col("n_ends") == 1, F.col("end_conv_id").cast("string")).otherwise("").cast("binary"), 256)
    few = found.nodes.filter("n_ends < 2").withColumn("ends_sha256", plain)
    return few.unionByName(found.nodes.filter("n_ends > 1").join(several, "end_conv_id").withColumnRenamed("digest", "ends_sha256"))
