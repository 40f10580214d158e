"""Hard negatives of anchors by exact integer scores in residue arithmetic.

Vectors become whole numbers, and their inner products are wanted exactly. Each cell of a grid of
anchor groups and row groups multiplies its matrices modulo several small primes in float32, where
sums of residues stay exact, and the Chinese remainder theorem gives the signed scores back. The
number of primes follows from the largest norm in the table. A cell leaves only its best few rows
of each anchor; windows over those select: first an anchor's positives, then, in a second pass of
the grid, the negatives within the score window of each positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasemill.llm.shared import Work
from phasemill.llm.words import tidy_pair

#: Anchors and rows of a group; a cell of both is one task's unit of work.
ANCHORS, ROWS = 2048, 4096
#: Primes are below this; residues lie within half of it.
PRIMES_BELOW = 256
#: Components whose products of residues are summed in float32 without loss: 2^24 over the largest product.
COMPONENTS = (1 << 24) // (PRIMES_BELOW // 2) ** 2
#: Anchors that a cell multiplies at a time.
TILE = 256


def moduli(most: int) -> list[int]:
    """Primes, the largest first, whose product is above 2 * most, so that scores of -most to most are told apart."""
    sieve = np.ones(PRIMES_BELOW, dtype=bool)
    sieve[:2] = False
    for i in range(2, int(PRIMES_BELOW**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > 2 * most:
            break
        out.append(p)
        product *= p
    return out


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """matrix (whole numbers) modulo each prime, as float32 between -p/2 and p/2."""
    out = []
    for p in primes:
        r = np.mod(matrix, p)
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def _nearest(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p between -p/2 and p/2."""
    if x.dtype.kind == "f":
        return x - p * np.rint(x / p)
    r = np.mod(x, p)
    return r - p * (r > p // 2)


def products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of both, from their residues; int64."""
    whole = 1
    for p in primes:
        whole *= p
    kind = np.float64 if whole < 1 << 52 else np.int64
    found, m = None, 1
    for a, b, p in zip(left, right, primes, strict=True):
        c = np.zeros((len(a), len(b)), dtype=np.float32)
        for k in range(0, a.shape[1], COMPONENTS):
            c = _nearest(c + _nearest(a[:, k : k + COMPONENTS] @ b[:, k : k + COMPONENTS].T, np.float32(p)), np.float32(p))
        c = c.astype(kind)
        if found is None:
            found = c
        else:  # the multiple of the primes so far that gives this remainder too
            found = found + m * _nearest(_nearest(c - _nearest(found, p), p) * pow(m, -1, p), p)
        m *= p
    return found.astype(np.int64)


def best(scores: np.ndarray, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k largest scores of each row, equal ones by the smaller column; scores below -most are left out."""
    rows, width = scores.shape
    k = min(k, width)
    if not rows or not k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if (most + 1) * width < 1 << 62:
        keys = scores * width + np.arange(width - 1, -1, -1)
        at = np.argpartition(keys, width - k, axis=1)[:, width - k :]
    else:
        at = np.array([np.lexsort((np.arange(width), -x))[:k] for x in scores])
    row, column = np.repeat(np.arange(rows), k), at.ravel()
    held = scores[row, column] >= -most
    return row[held], column[held]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width), dtype=np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


@dataclass(frozen=True)
class Mining:
    """Every `every`-th id is an anchor; it has so many positives, each with so many negatives whose score is `low` to `high` per cent of the positive's."""

    every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256


def taking_part(vectors: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(no, id, label, v): rows with a label, an id and a vector of finite components, and these as whole numbers floor(scale * x)."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    named = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(finite, F.lit(False)).alias("finite"))
    part = named.filter("id IS NOT NULL AND label IS NOT NULL AND finite")
    return part.select(F.monotonically_increasing_id().alias("no"), "id", "label", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def hard_negatives(vectors: DataFrame, plan: Mining = Mining(), key: str = "vec_id", vector: str = "embedding", label: Column | None = None, anchors: int = ANCHORS, rows: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every anchor's positives.

    An anchor's score with a row is the inner product of both as whole numbers; higher ones come
    first, equal ones by the smaller id. Its positives are its first other rows of its label. Of the
    rows of other labels whose score lies between plan.low and plan.high per cent of a positive's,
    limits included, the first plan.negatives are returned with their rank from 1; none for a
    positive without any.

    Rows with a null id or label, a null vector or a null or non-finite component take no part.
    Vectors of different lengths are multiplied over the components that both have; an empty one
    scores 0. A row given twice is two rows, and an anchor given twice two anchors with equal rows.
    No rows give no rows. Scores of 2^62 or more, which a long may not hold, raise ValueError. Other
    columns are not read.

    All anchors meet all rows, in cells of `anchors` times `rows`; each side is shuffled once for
    every group of the other, and a cell leaves a few rows of each anchor.
    """
    work = Work(vectors.sparkSession, "negatives")
    label = F.col("label") if label is None else label
    table = work.settled(taking_part(vectors, key, vector, label, plan.scale), "rows")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    norm, width, count, n_anchors = table.agg(F.max(square), F.max(F.size("v")), F.count("*"), F.count_if(F.col("id") % plan.every == 0)).first()
    most = int((norm or 0.0) * (1 + 1e-9)) + 1
    if most >= 1 << 62:
        raise ValueError(f"scores up to {most} are too large")
    primes, width = moduli(most), width or 0
    groups_a, groups_r = max(1, -(-n_anchors // anchors)), max(1, -(-count // rows))
    group = lambda n: F.pmod(F.xxhash64("no"), F.lit(n)).cast("int")
    of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = table.withColumns({"g": group(groups_r), "a": of(groups_a)}).select("a", "g", "id", "label", "v")
    chosen = table.filter(F.col("id") % plan.every == 0)
    none = F.lit(None).cast("array<struct<score:bigint,id:bigint>>")

    def cells(asked: DataFrame, work_on, schema: str) -> DataFrame:
        left = asked.withColumns({"a": group(groups_a), "g": of(groups_r)}).select("a", "g", "no", "id", "label", "v", "positives")
        return left.groupBy("a", "g").cogroup(dealt.groupBy("a", "g")).applyInArrow(tidy_pair(work_on), schema)

    def sides(left: pa.Table, right: pa.Table) -> tuple:
        """Numbers and labels of anchors, ids and labels of rows, and the residues of both."""
        return left.column("no").to_numpy(), left.column("label").to_numpy(), right.column("id").to_numpy(), right.column("label").to_numpy(), residues(_matrix(left.column("v"), width), primes), residues(_matrix(right.column("v"), width), primes)

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        # rows of one label lie together, so an anchor is multiplied with those of its own alone
        no, la, ids, lr, a, b = sides(left.sort_by("label"), right.sort_by([("label", "ascending"), ("id", "ascending")]))
        out = []
        for one in np.unique(la):
            (s, e), (f, t) = np.searchsorted(la, [one, one + 1]), np.searchsorted(lr, [one, one + 1])
            for at in range(s, e if t > f else s, TILE):
                end = min(at + TILE, e)
                scores = products([x[at:end] for x in a], [x[f:t] for x in b], primes)
                row, column = best(scores, plan.positives + 1, most)
                out.append((no[at + row], ids[f + column], scores[row, column]))
        return _table(out, ["no", "id", "score"])

    def between(left: pa.Table, right: pa.Table) -> pa.Table:
        no, la, ids, lr, a, b = sides(left, right.sort_by("id"))
        out = []
        wanted = left.column("positives").to_pylist()
        for at in range(0, len(no), TILE):
            end = min(at + TILE, len(no))
            scores = products([x[at:end] for x in a], b, primes)
            other = la[at:end, None] != lr[None, :]
            for j in range(max((len(w) for w in wanted[at:end]), default=0)):
                has = np.array([i for i, w in enumerate(wanted[at:end]) if len(w) > j], dtype=np.int64)
                target = [wanted[at + i][j]["score"] for i in has]
                low = np.array([-(-plan.low * p // 100) for p in target], dtype=np.int64)
                high = np.array([plan.high * p // 100 for p in target], dtype=np.int64)
                some = scores[has]
                some[~other[has] | (some < low[:, None]) | (some > high[:, None])] = -most - 1
                row, column = best(some, plan.negatives, most)
                out.append((no[at + has[row]], np.full(len(row), j, dtype=np.int64), ids[column], some[row, column]))
        return _table(out, ["no", "j", "id", "score"])

    first = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    near = cells(chosen.withColumn("positives", none), same_label, "no long, id long, score long")
    top = near.withColumn("n", F.row_number().over(first("no"))).filter(F.col("n") <= plan.positives + 1)
    listed = top.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("n", "score", "id"))).alias("found"))  # positives + 1 at most
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    with_own = chosen.withColumn("own", own).join(listed, "no")
    # the anchor itself is one of the rows with its id, label and score; these can't be told apart
    itself = F.array_position(F.transform("found", lambda f: (f["id"] == F.col("id")) & (f["score"] == F.col("own"))), True)
    others = F.slice(F.filter("found", lambda _, i: i + 1 != F.col("itself")), 1, plan.positives)
    asked = work.settled(with_own.withColumn("itself", itself).withColumn("positives", F.transform(others, lambda f: F.struct(f["score"].alias("score"), f["id"].alias("id")))).select("no", "id", "label", "v", "positives").filter(F.size("positives") > 0), "anchors")
    hard = cells(asked, between, "no long, j long, id long, score long")
    ranked = hard.withColumn("rank", F.row_number().over(first("no", "j"))).filter(F.col("rank") <= plan.negatives)
    names = asked.select("no", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("j", "positive"))
    out = ranked.join(names, ["no", "j"]).select("anchor_id", F.col("positive.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
    return work.concluded(out, "negatives")


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * len(names)
    return pa.table(dict(zip(names, columns, strict=True)))
