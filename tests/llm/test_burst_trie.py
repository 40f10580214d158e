"""The conversation trie against a plain one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from phasemill.llm import burst_trie as B

SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(rows, family=5, most=9):
    """Nodes of all prefixes, member by member."""
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in held.items()}
    if not turns:
        return []
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        rest = c % family if c >= 0 else -(-c % family)
        made[c] = tuple(turns.get(c - rest, [])[:h] + own[h:])
    members = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    for s, who in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(who) - 1) * len(s[-1][1].encode()) if s else 0
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(c for c in members[s] if made[c] == s))).encode()).hexdigest()
    return [(min(who), len(s), min(members[s[:-1]]) if s else None, len(who), len(children.get(s, [])), leaves[s], saved[s], digest(s)) for s, who in members.items()]


def _trie(spark, rows, limit, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"head": F.lit("x"), "tid": F.lit("y"), "a.b": F.lit(1)})
    found = B.with_digests(B.grafted_trie(df, limit=limit, **more))
    return sorted(map(tuple, found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()))


def _talk(seed, n):
    """Conversations of few different turns, so that many share beginnings; some empty, null, repeated or negative."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 400), n):
        turns = rng.choice([None, 0, 5000]), rng.randint(0, 9)
        rows += [(c, t if turns[0] is None else t * (turns[0] or 1), rng.choice(["user", "user", None]), rng.choice(["a", "é", "", None, "long text"]) if t > 1 else "start") for t in range(turns[1])]
    rows += [(900 + k, t, "user", f"t{t}") for k in range(40) for t in range(12)]  # copies
    rows += [(1000 + 5 * k, t, "user", f"t{t}") for k in range(6) for t in range(k + 1)]  # each a beginning of the next
    rows += [(7777, None, "user", "b"), (7777, None, "user", "a"), (7777, -3, None, None), (None, 1, "user", "lost"), (7777, 9000, "user", "z" * 300_000)]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("limit", [2, 30, B.LIMIT])
def test_trie_of_families(spark, limit):
    rows = _talk(limit, 60)
    assert _trie(spark, rows, limit) == sorted(_plain(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(3, 1, "a", "b")], [(0, 0, "u", "x"), (1, 0, "u", "x")], [(2, 0, "u", "x"), (9, 0, "u", "y")]])
def test_few_rows(spark, rows):
    assert _trie(spark, rows, 2) == sorted(_plain(rows))


def test_long_conversation_bursts_into_a_chain(spark):
    """Of 9,000 turns, more than a numbering block and a container hold."""
    rows = [(c, t, "user", f"{t % 7}") for c in (0, 1, 2) for t in range(9000 - c)]
    assert B.numbered(spark.createDataFrame(rows, SCHEMA)).filter("conv = 0").agg(F.max("pos"), F.countDistinct("pos")).first() == (8999, 9000)
    nodes = B.grafted_trie(spark.createDataFrame(rows, SCHEMA), limit=1000).nodes
    assert nodes.count() == 9001 and nodes.filter("n_children = 0").count() == 1 and nodes.filter("n_ends > 0").count() == 3
    assert nodes.filter("depth = 0").first()["saved"] == 2 * 8998 + 1


def test_digests_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(B, "PIECE_BYTES", 64)
    ids = [(e, c) for e in (1, 2, -5) for c in range(-30, 700, abs(e))]
    got = {r.end_conv_id: r.digest for r in B.joined_digests(spark.createDataFrame(ids, "end_conv_id long, conv_id long").repartition(7)).collect()}
    assert got == {e: hashlib.sha256(",".join(str(c) for k, c in ids if k == e).encode()).hexdigest() for e in (1, 2, -5)}
