"""MinHash near-duplicates with odd sketches.

Documents with equal shingle sets are one class, known by a number. MinHash values of a
class, in bands, give candidates; the same values, folded into a parity bitmap (an odd
sketch), give a close estimate of high similarities from the population count of an XOR,
which turns most candidates away; the rest is checked on whole sets. The (band, class) rows
are sorted once over the whole table, and rows alone in their bucket, nearly all of them, go
there: only what collides is joined with anything. Within a bucket every class is first
compared with the bucket's smallest one only, so a large group of copies costs one candidate
per member; what a bucket then still holds in several components is compared across them, by
larger odd sketches and then on whole sets, in slices of a bounded size, so that no more than
a link for each component joined leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm import words as W
from phasemill.llm.components import components
from phasemill.llm.shared import Work


@dataclass(frozen=True)
class Plan:
    """Shingle length, least similarity in percent, and the sizes of the sketches.

    A pair at similarity 0.8 shares none of 24 bands of 4 values with probability 3e-6. The sketch
    folds 192 values into 1024 bits; its estimate has a standard deviation of about 0.03 at 0.8, so
    `slack` of 0.2 below the limit loses a true link with probability under 1e-9.
    """

    shingle: int = 4
    percent: int = 80
    bands: int = 24
    rows: int = 4
    samples: int = 192
    bits: int = 1024
    slack: float = 0.2
    #: the larger sketches of what the first comparison leaves: standard deviation about 0.013 at 0.8
    fine_samples: int = 2048
    fine_bits: int = 4096
    fine_slack: float = 0.065
    #: members of a slice of a bucket
    slice: int = 512
    #: shingles of a slice, on average of its members
    slice_shingles: int = 524_288
    #: for short texts: the small sketches serve within a bucket's slices too
    short: bool = False

    def most_bits(self) -> int:
        """Population count of an XOR up to which a pair is checked exactly."""
        return _bits_at(self.percent / 100 - self.slack, self.samples, self.bits)

    def most_fine_bits(self) -> int:
        return _bits_at(self.percent / 100 - self.fine_slack, self.fine_samples, self.fine_bits)


def _bits_at(similarity: float, samples: int, bits: int) -> int:
    """Expected population count at a similarity, rounded up."""
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity))) + 0.999)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(7).integers(0, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return made[0], made[1]


def minima(keys: np.ndarray, bounds: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are not empty, and their MinHash values (samples x rows)."""
    full = np.flatnonzero(np.diff(bounds))
    lows = np.empty((samples, len(full)), dtype=np.uint64)
    if len(full):
        flips, factors = _multipliers(samples)
        room = np.empty(len(keys), dtype=np.uint64)
        for i in range(samples):
            np.bitwise_xor(keys, flips[i], out=room)
            np.multiply(room, factors[i], out=room)
            np.minimum.reduceat(room, bounds[:-1][full], out=lows[i])
    return full, lows


def odd_sketches(full: np.ndarray, lows: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Parity bitmaps (rows x bits/64) of MinHash values: each value flips one bit; empty rows have zeros."""
    odd = np.zeros((rows, bits // 64), dtype=np.uint64)
    for i, low in enumerate(lows):
        at = W.mix(low + np.uint64(i)) % np.uint64(bits)
        odd[full, (at >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (at & np.uint64(63))
    return odd.view(np.int64)


def sketches(keys: np.ndarray, bounds: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (rows x bands) and odd sketches of sets; empty sets get zeros."""
    size = len(bounds) - 1
    full, lows = minima(keys, bounds, plan.samples)
    bands = np.zeros((size, plan.bands), dtype=np.uint64)
    for b in range(plan.bands):
        held = np.full(len(full), b, dtype=np.uint64)
        for r in range(plan.rows):
            held = W.mix(held ^ lows[b * plan.rows + r])
        bands[full, b] = held
    return bands.view(np.int64), odd_sketches(full, lows, size, plan.bits)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def signatures(docs: DataFrame, text: str, key: str, plan: Plan) -> DataFrame:
    """id, tag (a hash of the text), n_shingles, two fingerprints of the whole set, band values b0.. and sketch words o0.. of each row."""
    names = ["id", "tag", "n_shingles", "p", "q", *_numbered("b", plan.bands), *_numbered("o", plan.bits // 64)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(1)):
                keys, bounds = W.shingle_sets(data, offsets, plan.shingle)
                bands, odd = sketches(keys, bounds, plan)
                prints = []
                for salt in (0x51, 0xA7):
                    total = np.zeros(len(keys) + 1, dtype=np.uint64)
                    np.cumsum(W.mix(keys ^ np.uint64(salt)), out=total[1:])
                    prints.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                columns = [pa.array(np.diff(bounds)), *map(pa.array, prints), *map(pa.array, np.ascontiguousarray(bands.T)), *map(pa.array, np.ascontiguousarray(odd.T))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in (0, 2)), *columns], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text)).alias("tag")).mapInArrow(W.tidy(sign), f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def _numbered(name: str, n: int) -> list[str]:
    return [f"{name}{i}" for i in range(n)]


def colliding(banded: DataFrame) -> DataFrame:
    """The rows (bucket, c) whose bucket has another row too, and a few that stand alone at a partition's end.

    One sort of the whole table by bucket and c, so a large bucket spreads over several tasks; each
    reads its rows in order and holds one of them.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple[pa.RecordBatch, int, bool] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            same = bucket[1:] == bucket[:-1]
            keep = np.zeros(len(bucket), dtype=bool)
            keep[1:] |= same
            keep[:-1] |= same
            if pending is None:
                keep[0] = True  # the partition before may hold its bucket
            else:
                row, was, kept = pending
                if was == bucket[0]:
                    keep[0] = kept = True
                if kept:
                    yield row
            yield batch.slice(0, len(keep) - 1).filter(pa.array(keep[:-1]))
            pending = batch.slice(len(keep) - 1), int(bucket[-1]), bool(keep[-1])
        if pending is not None:
            yield pending[0]

    return banded.select("bucket", "c").repartitionByRange("bucket", "c").sortWithinPartitions("bucket", "c").mapInArrow(meet, "bucket long, c long")


def differing(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) of classes whose texts (c, text) have 100 * shared >= percent * all shingles, on whole sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, sizes = [], []
            step = max(1, batch.num_rows * 4_000_000 // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sets = [joined_sets(part.column(k), plan.shingle) for k in (2, 3)]
                rows, keys = (np.concatenate([s[n] for s in sets]) for n in (0, 1))
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                both = (rows[1:] == rows[:-1]) & (keys[1:] == keys[:-1])
                shared.append(np.bincount(rows[1:][both], minlength=part.num_rows))
                sizes.append(np.bincount(rows, minlength=part.num_rows))
            if shared:
                same, total = np.concatenate(shared), np.concatenate(sizes)
                keep = pa.array(100 * same >= plan.percent * (total - same))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    left = pairs.join(texts.select(F.col("c").alias("u"), F.col("text").alias("left")).hint("merge"), "u")
    both = left.join(texts.select(F.col("c").alias("v"), F.col("text").alias("right")).hint("merge"), "v")
    return both.select("u", "v", "left", "right").mapInArrow(W.tidy(check), "u long, v long")


def joined_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the shingle sets of a column."""
    rows, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for first, _, data, offsets in W.blocks(column):
        got, bounds = W.shingle_sets(data, offsets, shingle)
        rows.append(first + W.row_of(bounds))
        keys.append(got)
    return np.concatenate(rows), np.concatenate(keys)


def _fine(texts: DataFrame, plan: Plan) -> DataFrame:
    """c, odd (the larger sketch, of short texts the small one), keys (the whole set) and size of texts (c, text)."""
    samples, bits = (plan.samples, plan.bits) if plan.short else (plan.fine_samples, plan.fine_bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in W.blocks(batch.column(1)):
                keys, bounds = W.shingle_sets(data, offsets, plan.shingle)
                odd = odd_sketches(*minima(keys, bounds, samples), last - first, bits)
                held = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), _lists(odd), held, pa.array(np.diff(bounds))], names=["c", "odd", "keys", "size"])

    return texts.select("c", "text").mapInArrow(W.tidy(sketch), "c long, odd array<long>, keys array<long>, size long")


def linked(keys: np.ndarray, bounds: np.ndarray, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows have 100 * shared >= percent * all keys; a row's keys are distinct."""
    number = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    width, sizes = int(number.max(initial=0)) + 1, np.diff(bounds)
    there = np.sort(W.row_of(bounds) * width + number)
    shared = np.zeros(len(u), dtype=np.int64)
    share = np.searchsorted(np.cumsum(sizes[u]), np.arange(0, int(sizes[u].sum()), 1_000_000), side="left")
    cuts = np.unique(np.append(share, len(u)))  # about so many keys at a time
    for low, high in zip(cuts, cuts[1:]):
        a, b = u[low:high], v[low:high]
        n = sizes[a]
        place = np.repeat(bounds[a] - np.cumsum(n) + n, n) + np.arange(n.sum())
        asked = np.repeat(b, n) * width + number[place]
        found = there[np.minimum(np.searchsorted(there, asked), len(there) - 1)] == asked
        shared[low:high] = np.bincount(np.repeat(np.arange(len(a)), n), weights=found, minlength=len(a))
    return 100 * shared >= percent * (sizes[u] + sizes[v] - shared)


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places i < j within each of consecutive groups of the given sizes."""
    size = np.repeat(sizes, sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    more = ends - np.arange(len(size)) - 1  # places of the group after each
    left = np.repeat(np.arange(len(size)), more)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more)


def _needed(group: np.ndarray, a: np.ndarray, b: np.ndarray, sure: int) -> np.ndarray:
    """Which pairs of components (a, b) within groups must be checked.

    Of the first `sure` pairs, those that join components not joined before; of the others, those
    that the sure ones leave apart. So a group of near copies gives a link for each component that it
    joins and not its square.
    """
    codes, ends = np.unique(np.stack([np.concatenate([group, group]), np.concatenate([a, b])]), axis=1, return_inverse=True)
    lead = np.arange(codes.shape[1])
    x, y = ends.ravel()[: len(group)], ends.ravel()[len(group) :]

    def root(k: int) -> int:
        while lead[k] != k:
            lead[k] = lead[lead[k]]
            k = lead[k]
        return k

    first = np.sort(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)])[:, :sure], axis=1, return_index=True)[1])
    chosen = []
    for k in first.tolist():
        p, q = root(x[k]), root(y[k])
        if p != q:
            lead[max(p, q)] = min(p, q)
            chosen.append(k)
    roots = np.array([root(k) for k in range(len(lead))], dtype=np.int64)
    rest = sure + np.flatnonzero(roots[x[sure:]] != roots[y[sure:]])
    return np.concatenate([np.array(chosen, dtype=np.int64), rest])


def joining(a: np.ndarray, b: np.ndarray, check: Callable[[np.ndarray], np.ndarray], turns: int = 3) -> np.ndarray:
    """Links among pairs of components (a, b), likely ones first, that join all the components that the links of all pairs join.

    check says which of the asked pairs are links. Only pairs that would join something not joined
    yet are asked, in turns; after the last turn all that are left apart are asked at once.
    """
    labels, ends = np.unique(np.stack([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    label, rest, found = np.arange(len(labels)), np.arange(len(a)), [np.zeros(0, dtype=np.int64)]
    while len(rest := rest[label[x[rest]] != label[y[rest]]]):
        same = np.zeros(len(rest), dtype=np.int64)
        asked = _needed(same, label[x[rest]], label[y[rest]], len(rest)) if turns > 0 else np.arange(len(rest))
        links = rest[asked][check(rest[asked])]
        if len(links):
            links = links[_needed(same[: len(links)], label[x[links]], label[y[links]], len(links))]
            found.append(links)
            p, q, was = label[x[links]], label[y[links]], None
            step = np.arange(len(labels))
            while was is None or (was != step).any():
                was = step.copy()
                np.minimum.at(step, p, was[q])
                np.minimum.at(step, q, was[p])
                step = step[step]
            label = step[label]
        rest, turns = np.delete(rest, asked), turns - 1
    return np.concatenate(found)


def _across(members: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) of one bucket but different components: of each group a forest, see joining.

    members: bucket, n, load, top (n, component, load of the bucket's largest component), c, component,
    odd, keys. Members of the largest component meet only those of others, and each goes to as many
    tasks as the others have slices; the others meet among themselves too. Slices are of so many
    members (n) or shingles (load), so a group has a bounded size; groups are read in order, many at
    a time.
    """
    slices = lambda n, load: F.greatest(F.ceil(n / plan.slice), F.ceil(load / plan.slice_shingles), F.lit(1)).cast("int")
    big = F.col("component") == F.col("top.component")
    cut = members.withColumns({"large": slices(F.col("top.n"), F.col("top.load")), "small": slices(F.col("n") - F.col("top.n"), F.col("load") - F.col("top.load"))})
    cut = cut.withColumn("own", F.pmod(F.xxhash64("c"), F.when(big, F.col("large")).otherwise(F.col("small"))).cast("int"))
    group = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    each = lambda n, of: F.transform(F.sequence(F.lit(0), F.col(n) - 1), of)
    others = F.concat(each("small", lambda j: group(0, F.least("own", j), F.greatest("own", j))), each("large", lambda i: group(1, i, F.col("own"))))
    dealt = cut.withColumn("group", F.explode(F.when(big, each("small", lambda j: group(1, F.col("own"), j))).otherwise(others)))
    dealt = dealt.select("bucket", "group.kind", "group.a", "group.b", "c", "component", "odd", "keys")
    most = plan.most_bits() if plan.short else plan.most_fine_bits()

    def near(rows: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, comp = rows.column(4).to_numpy(), rows.column(5).to_numpy()
        odd = rows.column(6).flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        keys, bounds = rows.column(7).flatten().to_numpy(), np.concatenate([[0], np.cumsum(rows.column(7).value_lengths().to_numpy().astype(np.int64))])
        at = np.concatenate([[0], np.cumsum(sizes)])
        share = np.searchsorted(np.cumsum(sizes * sizes), np.arange(0, int((sizes * sizes).sum()), 200_000), side="left")
        for low, high in zip(cuts := np.unique(np.append(share, len(sizes))), cuts[1:]):  # so many pairs at a time
            u, v = _pairs(sizes[low:high])
            u, v = u + at[low], v + at[low]
            other = comp[u] != comp[v]
            u, v = u[other], v[other]
            apart = [np.bitwise_count(odd[u[k : k + 50_000]] ^ odd[v[k : k + 50_000]]).sum(axis=1) for k in range(0, len(u), 50_000)]
            apart = np.concatenate([np.zeros(0, dtype=np.uint64), *apart])
            by = np.argsort(apart, kind="stable")
            by = by[apart[by] <= most]
            u, v = u[by], v[by]

            def check(k: np.ndarray, u: np.ndarray = u, v: np.ndarray = v) -> np.ndarray:
                used, ends = np.unique(np.stack([u[k], v[k]]), return_inverse=True)
                n = np.diff(bounds)[used]
                own = np.repeat(bounds[used] - np.cumsum(n) + n, n) + np.arange(n.sum())
                return linked(keys[own], np.concatenate([[0], np.cumsum(n)]), *ends.reshape(2, -1), plan.percent)

            chosen = joining(comp[u], comp[v], check)
            u, v = ids[u[chosen]], ids[v[chosen]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def grouped(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole groups of what is held; the last may go on in the next batch."""
            rows = pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            keys = [rows.column(k).to_numpy() for k in range(4)]
            new = np.ones(rows.num_rows, dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            at = np.append(np.flatnonzero(new), rows.num_rows)
            done = len(at) - 1 if last else len(at) - 2
            rest[:] = [] if last else [rows.slice(at[-2])]
            if done:
                yield from near(rows.slice(0, at[done]), np.diff(at[: done + 1]))

        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
                yield from grouped(False)
        if rest:
            yield from grouped(True)

    order = ["bucket", "kind", "a", "b"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(W.tidy(compare), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    Links: texts whose sets of distinct word shingles (A-Z lower-cased, words by white space; a
    shorter text is one shingle) have 100 * shared >= percent * all. component_id: the smallest key
    that a row's key reaches, kept: that is its own. A null or empty text, or one of white space,
    has no shingles and is linked with nothing, so it stays. Rows that share a key are one node with
    the links of all of them. A row with a null key takes part in nothing: component_id null, kept.
    Texts of any length are read whole, one at a time where they are longer than a block. Other columns are not read. No rows give no rows.
    """
    work = Work(docs.sparkSession, "near")
    signed = work.settled(signatures(docs, text, key, plan).withColumn("r", F.monotonically_increasing_id()), "signatures")
    full = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    held = [*_numbered("b", plan.bands), *_numbered("o", plan.bits // 64)]
    # a class is known by the number of one of its rows
    classes = work.settled(full.groupBy("p", "q", "n_shingles").agg(F.min("r").alias("c"), *(F.first(h).alias(h) for h in held)), "classes")
    bands, odd = F.array(*_numbered("b", plan.bands)), F.array(*_numbered("o", plan.bits // 64))
    # a set that not even one shingle more or less would be close to has no link but with its equals
    able = classes.filter(100 * F.col("n_shingles") >= plan.percent * (F.col("n_shingles") + 1))
    met = work.settled(colliding(able.select("c", F.explode(bands).alias("bucket"))), "met")
    leads = met.groupBy("bucket").agg(F.min("c").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    members = work.settled(met.join(leads, "bucket"), "members")
    star = members.filter("c <> lead").select(F.col("lead").alias("u"), F.col("c").alias("v")).distinct()
    sketched = classes.join(members.select("c").distinct(), "c", "left_semi").select("c", odd.alias("odd"))
    close = star.join(sketched.select(F.col("c").alias("u"), F.col("odd").alias("odd_u")), "u").join(sketched.select(F.col("c").alias("v"), F.col("odd").alias("odd_v")), "v").filter(differing("odd_u", "odd_v") <= plan.most_bits())
    # every later check reads texts of these only, so they are fetched once; neither side has a bound, so by a shuffle at every size
    asked = signed.select("id", "tag", F.col("r").alias("c")).join(members.select("c").distinct(), "c", "left_semi")
    tagged = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tag"))
    texts = work.settled(tagged.join(asked.hint("merge"), ["id", "tag"]).dropDuplicates(["id", "tag"]).select("c", "text"), "texts")
    links = work.settled(verified(work.settled(close.select("u", "v"), "pairs"), texts, plan), "links")
    first = components(links, work)
    placed = members.join(first.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    # the lead has been compared with all of its bucket
    others = placed.filter("c <> lead")
    mixed = others.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    left = work.settled(others.join(mixed, "bucket", "left_semi").select("bucket", "c", "component"), "left")
    fine = work.settled(_fine(texts.join(left.select("c").distinct().hint("merge"), "c", "left_semi"), plan), "fine")
    sizes = left.join(fine.select("c", "size"), "c").groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("load"))
    loads = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "load")).alias("top"), F.sum("n").alias("n"), F.sum("load").alias("load"))
    links = links.union(work.settled(_across(left.join(loads, "bucket").join(fine.drop("size"), "c"), plan), "across"))
    rows = work.settled(full.select("r", "id", "p", "q", "n_shingles").join(classes.select("p", "q", "n_shingles", "c"), ["p", "q", "n_shingles"]).select("id", "n_shingles", "c"), "rows")
    # classes that share a key are one node too
    several = rows.groupBy("id").agg(F.min("c").alias("u"), F.max("c").alias("high")).filter("u < high").select("id", "u")
    same = rows.join(several, "id").select("u", F.col("c").alias("v"))
    last = components(links.union(same), work)
    grouped = work.settled(rows.join(last.withColumnRenamed("id", "c"), "c", "left").select("id", "n_shingles", F.coalesce("component", "c").alias("component")), "grouped")
    lowest = work.settled(grouped.groupBy("component").agg(F.min("id").alias("component_id")), "lowest")
    out = grouped.join(lowest, "component").select("id", "n_shingles", "component_id")
    out = out.unionByName(signed.filter("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component_id")))
    return work.concluded(out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")), "near")
