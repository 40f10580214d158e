"""Hard negatives against plain integer arithmetic."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemill.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int"


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for size, width in ((1, 3), (300, 64), (70_000, 2500), (1 << 29, 5), (5, 0)):
        a, b = (rng.integers(-size, size + 1, (n, width)) for n in (7, 9))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        primes = N.moduli(max(1, max(sum(int(x) ** 2 for x in u) for u in [*a, *b])))
        assert N.products(N.residues(a, primes), N.residues(b, primes), primes).tolist() == want
    edge = np.array([[125] * 1024, [-125] * 1024, [126] * 1024])
    primes = N.moduli(126 * 126 * 1024)
    assert N.products(N.residues(edge, primes), N.residues(edge, primes), primes).tolist() == (edge @ edge.T).tolist()
    assert len({*N.moduli(10**18)}) == len(N.moduli(10**18)) and math.prod(N.moduli(10**18)) > 2 * 10**18


def test_best_of_ties():
    scores = np.array([[5, 7, 7, 5, 7, -9], [-9, -9, -9, -9, 1, -9]])
    for most in (8, 1 << 60):
        row, column = N.best(scores, 3, most)
        assert sorted(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 4), (1, 4)] if most == 8 else True
        assert {c for r, c in zip(row.tolist(), column.tolist(), strict=True) if r == 0} == {1, 2, 4}


def _plain(rows):
    part = [(n, i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for n, (i, v, l) in enumerate(rows) if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3]))  # noqa: B905, E731
    out = []
    for a in (x for x in part if x[1] % 50 == 0):
        ranked = sorted(((-score(a, b), b[1], b[2] == a[2]) for b in part if b[0] != a[0]))
        for p, i, _ in [x for x in ranked if x[2]][:5]:
            hard = [(-s, j) for s, j, same in ranked if not same and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a[1], i, n + 1, j, -p, s) for n, (s, j) in enumerate(hard)]
    return out


def _rows(seed, n, scale=1.0):
    rng = random.Random(seed)
    rows = [(k, [rng.uniform(-scale, scale) + (scale if k % 3 else 0) for _ in range(6)], k % 4 if k % 2 else 1) for k in range(n)]
    rows += [(1000 + k, [0.5] * 6, k % 3) for k in range(40)] + [(50, [0.5] * 6, 1), (50, [0.5] * 6, 1), (50, [0.25] * 6, 2)]  # ties, one anchor three times
    rows += [(None, [1.0] * 6, 1), (150, None, 1), (200, [1.0] * 6, None), (250, [1.0, None], 1), (300, [math.nan] * 6, 1), (350, [math.inf, 1.0], 1)]
    return [*rows, (400, [], 1), (450, [1.0, 2.0], 1), (-50, [0.75] * 9, 2), (7, [0.0] * 6, 3), (500, [-1.0] * 6, 2)]


def _turned():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize(("anchors", "rows", "scale"), [(N.ANCHORS, N.ROWS, 1.0), (2, 37, 1.0), (3, 50, 1e6)])
def test_hard_negatives(spark, anchors, rows, scale):
    given = _rows(anchors, 160, scale)
    df = spark.createDataFrame(given, SCHEMA).withColumns({"no": F.lit("x"), "score": F.lit("y"), "a.b": F.lit(1)})
    got = N.hard_negatives(df, label=_turned(), anchors=anchors, rows=rows)
    assert sorted(map(tuple, got.collect())) == sorted(_plain(given))


def test_few_rows(spark):
    for rows in ([], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [2.0], 1)], [(1, [1.0], 1)]):
        assert N.hard_negatives(spark.createDataFrame(rows, SCHEMA), label=_turned()).collect() == []
    with pytest.raises(ValueError, match="too large"):
        N.hard_negatives(spark.createDataFrame([(50, [1e12, 1.0], 1)], SCHEMA))
