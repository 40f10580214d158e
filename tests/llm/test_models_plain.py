"""The decoder of op4 and the additive model of op10 against plain versions."""

import itertools
import math

import numpy as np
import pytest

from phasemill.llm import deobfuscate as D
from phasemill.llm import gam

from . import helpers as H


@pytest.fixture(scope="module")
def letters():
    text = H.prose(77, 3000).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    c = np.concatenate([[0], D._CLASS[data], [0]])
    codes, n = np.unique((c[:-2] << 14) | (c[1:-1] << 7) | c[2:], return_counts=True)
    return D.Letters(codes, n)


def _cost(letters, text):
    """log p of a restored word and the space after it, letter by letter."""
    total, a, b = 0.0, 0, 0
    for x in text.encode() + b" ":
        c = int(D._CLASS[x])
        total += float(letters.log[(a << 14) | (b << 7) | c])
        a, b = b, c
    return total


def _channel(word):
    """Of each run of equal signs, what may have been meant and its log-cost."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(word.lower())]
    long = len(runs) > 2 and 2 * sum(n > 1 for _, n in runs) > len(runs)
    for c, n in runs:
        found = {c: 0.0} if c.isalpha() and c not in D.ALIKE else {}
        for x in D.LEET.get(c, "") + D.ALIKE.get(c, ""):
            found[x] = max(found.get(x, -math.inf), D.SUBSTITUTE)
        if c == "*" and n == 1:
            found |= {x: max(found.get(x, -math.inf), D.MASK) for x in "abcdefghijklmnopqrstuvwxyz"}
        out = {}
        for x, cost in found.items():
            out[x] = cost + (0 if n == 1 else (D.DROP if long else D.UNDOUBLE) if n == 2 else D.DROP)
            if n > 1:
                out[x + x] = cost + (D.DROP if n > 2 else 0)
        if c in D.PARTING:
            out[""] = D.PART
        elif not found:
            out[""] = 2 * D.SUBSTITUTE
        yield list(out.items())


@pytest.mark.parametrize("word", ["b4d", "d3-b0", "n0mma", "llloveee", "b*do", "g.a.n.e", "r3nn4", "ba|de", "0€", "é4b", "--", "#", "а5е", "f00d"])
def test_decoder_finds_the_best_of_all_paths(letters, word):
    best = -math.inf
    for path in itertools.product(*_channel(word)):
        best = max(best, sum(cost for _, cost in path) + _cost(letters, "".join(x for x, _ in path)))
    got = D.restored(word, letters)
    cost = max((sum(c for _, c in path) for path in itertools.product(*_channel(word)) if "".join(x for x, _ in path) == got), default=None)
    assert cost is not None and cost + _cost(letters, got) == pytest.approx(best, abs=1e-4)


def test_shallow_trees_and_pairs_by_trying_all_cuts():
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(300, 3)), (rng.random(300) < 0.5).astype(float)
    model = gam.AdditiveModel(x, y, gam.Settings(rounds=2, pair_rounds=1, least_hessian=0.5))
    prior, rate = model.s.prior, model.s.rate
    worth = lambda g, h: g.sum() ** 2 / (h.sum() + prior)
    leaf = lambda g, h: rate * g.sum() / (h.sum() + prior) if h.sum() >= model.s.least_hessian else 0.0
    for _ in range(20):
        n = int(rng.integers(1, 9))
        g, h = rng.normal(size=n), rng.random(n)
        parts = [(0, n)]
        for _ in range(model.s.leaves - 1):
            tried = [(worth(g[a:k], h[a:k]) + worth(g[k:b], h[k:b]) - worth(g[a:b], h[a:b]), p, k) for p, (a, b) in enumerate(parts) for k in range(a + 1, b)]
            if not tried or max(tried)[0] <= 1e-9:
                break
            _, p, k = max(tried)
            parts[p : p + 1] = [(parts[p][0], k), (k, parts[p][1])]
        want = np.concatenate([np.full(b - a, leaf(g[a:b], h[a:b])) for a, b in parts])
        assert np.allclose(model._tree(g, h), want)
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
        tried = []
        for i, j in itertools.product(range(1, 4), range(1, 5)):
            quads = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, 4)) for c, d in ((0, j), (j, 5))]
            tried.append((sum(worth(g[q], h[q]) for q in quads) - worth(g, h), i, j))
        gain, i, j = max(tried)
        got_gain, got = model._cross(g, h)
        want = np.zeros((4, 5))
        for a, b in ((0, i), (i, 4)):
            for c, d in ((0, j), (j, 5)):
                want[a:b, c:d] = leaf(g[a:b, c:d], h[a:b, c:d])
        assert got_gain == pytest.approx(gain) and np.allclose(got, want)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float)
    model = gam.AdditiveModel(x, y)
    assert model.pairs and (0, 1) in model.pairs
    new = rng.normal(size=(50, 4)) * 3
    for row, got in zip(new, model.score(new), strict=True):
        margin = model.base
        for j, table in enumerate(model.tables):
            margin += table[sum(e <= row[j] for e in model.edges[j])]
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            margin += table[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])]
        assert got == pytest.approx(1 / (1 + math.exp(-margin)))
    plain = gam.AdditiveModel(x, y, gam.Settings(pairs=0))
    assert np.mean((model.score(x) > 0.5) == y) > np.mean((plain.score(x) > 0.5) == y)


def test_labels_given_twice_weigh_twice(spark):
    """And texts of any length are scored."""
    rows = [(k, H.prose(k, 60) if k % 2 else "$$$ " * 40 + H.prose(k, 20), "a") for k in range(60)] + [(1000, H.prose(5, 40_000), "a")]
    docs = H.docs(spark, rows).withColumnsRenamed({"source": "score", "lang": "_held"})
    labels = [(k, k % 2) for k in range(60)]
    once, twice = (spark.createDataFrame(x, "doc_id long, quality int") for x in (labels, labels + labels[::2]))
    a, b, c = ({r.doc_id: r.score for r in gam.quality(docs, t).collect()} for t in (once, twice, twice.union(spark.createDataFrame(labels[1::2], "doc_id long, quality int"))))
    assert len(a) == len(b) == 61 and any(a[k] > b[k] for k in a) and all(0 <= v <= 1 for v in [*a.values(), *b.values(), *c.values()])
