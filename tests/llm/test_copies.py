"""Operators that compare texts with each other, against plain Python."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemill.llm import odd_sketch, paragraph_dedup, run_length_index
from phasemill.llm.components import components

from . import helpers as H


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(5, 4), (4, 5), (4, 4), (7, 7), (None, 3), (100, 50), (60, 50), (60, 61)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 4: 4, 5: 4, 7: 7, 50: 50, 60: 50, 61: 50, 100: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _family(n, first=200):
    """Texts that are close to their neighbours but not to the far end."""
    words, out = H.prose(9, 100, 3000).split(), []
    for k in range(n):
        out.append((first + k, " ".join(words), "a"))
        words = words.copy()
        for j in range(4):
            words[(k * 4 + j) % 100] = f"new{k}"
    return out


def test_near_duplicates(spark):
    rows = [(r.doc_id, r.text, r.source) for r in H.awkward(spark).collect()] + _family(12)
    table = H.docs(spark, rows).withColumn("id", F.lit("clash")).withColumn("component", F.lit(0))
    got = odd_sketch.near_duplicates(table, plan=odd_sketch.Plan(slice=4)).collect()
    want = H.classes([(k, H.shingles(t, 4)) for k, t, _ in dict((r[0], r) for r in rows if r[0] is not None).values()])
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            assert g.component_id is None and g.kept
        else:
            assert (g.component_id, g.kept) == (want[g.doc_id], want[g.doc_id] == g.doc_id), g
    assert {g.doc_id: g.n_shingles for g in got if g.doc_id in (1, 2, 3, 9)} == {1: 0, 2: 0, 3: 0, 9: 1}
    assert len({want[k] for k in range(200, 212)}) == 1


def test_needed_pairs_keep_all_connections():
    """Sure pairs as a forest, doubtful ones wherever the sure ones leave their ends apart."""
    rng = np.random.default_rng(12)
    for _ in range(200):
        n, k = int(rng.integers(1, 40)), int(rng.integers(2, 9))
        group, a, b = rng.integers(0, 3, n), rng.integers(0, k, n), rng.integers(0, k, n)
        sure = int(rng.integers(0, n + 1))
        kept = odd_sketch._needed(group, a, b, sure)

        def joined(pairs):
            lead = {}
            find = lambda x: x if lead.setdefault(x, x) == x else find(lead[x])
            for i in pairs:
                p, q = find((group[i], a[i])), find((group[i], b[i]))
                lead[max(p, q)] = min(p, q)
            return find

        before, after = joined(range(sure)), joined([i for i in kept if i < sure])
        assert all(after((group[i], a[i])) == after((group[i], b[i])) for i in range(sure))
        assert {i for i in kept if i >= sure} == {i for i in range(sure, n) if before((group[i], a[i])) != before((group[i], b[i]))}
        assert sum(i < sure for i in kept) < 3 * k


def test_joining_links_keep_all_connections():
    """As the links of all pairs join components, so do those chosen, with one less than components joined."""
    rng = np.random.default_rng(13)
    for turns in (0, 1, 3):
        for _ in range(200):
            n, k = int(rng.integers(0, 60)), int(rng.integers(2, 12))
            a, b, link = rng.integers(0, k, n), rng.integers(0, k, n), rng.random(n) < rng.random()
            asked = []
            chosen = odd_sketch.joining(a, b, lambda i: asked.extend(i.tolist()) or link[i], turns)

            def roots(pairs):
                low = list(range(k))
                for _ in range(k):
                    for i in pairs:
                        low[a[i]] = low[b[i]] = min(low[a[i]], low[b[i]])
                return low

            assert link[chosen].all() and len(set(asked)) == len(asked)
            assert roots(chosen) == roots(np.flatnonzero(link))
            assert len(chosen) == k - len(set(roots(chosen)))


def test_a_dense_group_of_near_copies_gives_few_pairs(spark):
    """Texts that all resemble each other but not the first of their bucket enough: one class, and not the square of pairs."""
    rows = _family(12) + [(500 + k, " ".join(w if i % 50 != k % 50 else f"own{k}" for i, w in enumerate(H.prose(77, 200, 3000).split())), "a") for k in range(60)]
    for short in (False, True):
        got = {r.doc_id: r.component_id for r in odd_sketch.near_duplicates(H.docs(spark, rows), plan=odd_sketch.Plan(slice=16, short=short)).collect()}
        assert got == H.classes([(k, H.shingles(t, 4)) for k, t, _ in rows])


def test_linked_pairs():
    rng = np.random.default_rng(2)
    sets = [set(rng.integers(0, 1 << 60, 30).tolist()) for _ in range(5)]
    sets += [set(list(s)[: int(rng.integers(20, 31))]) for s in sets] + [set()]
    keys, bounds = np.array([k for s in sets for k in sorted(s)]), np.cumsum([0, *map(len, sets)])
    u, v = np.triu_indices(10, 1)
    want = [100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in zip(u, v)]
    assert any(want) and odd_sketch.linked(keys, bounds, u, v, 80).tolist() == want


def test_near_duplicates_of_nothing(spark):
    assert odd_sketch.near_duplicates(H.awkward(spark).limit(0)).count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(5)
    plan = odd_sketch.Plan()
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for same in (360, 300):
        other = np.concatenate([base[:same], rng.integers(0, 1 << 63, 400 - same, dtype=np.uint64)])
        keys, bounds = np.concatenate([np.sort(base), np.sort(other)]), np.array([0, 400, 800])
        full, lows = odd_sketch.minima(keys, bounds, plan.fine_samples)
        a, b = odd_sketch.odd_sketches(full, lows, 2, plan.fine_bits).view(np.uint64)
        differ = int(np.bitwise_count(a ^ b).sum())
        estimate = 1 + plan.fine_bits / (4 * plan.fine_samples) * np.log(1 - 2 * differ / plan.fine_bits)
        assert estimate == pytest.approx(same / (800 - same), abs=0.06)


def test_paragraphs(spark):
    base = H.prose(41, 60, 3000)
    close = " ".join(w if i != 30 else "other" for i, w in enumerate(base.split()))
    rows = [(5, "intro\n" + base + "\nend", "a"), (3, base, "b"), (9, H.prose(42, 30) + "\n\n" + close + "\n" + base, "a"), (1, None, "a"), (2, "", "a"), (4, "short line\nshort line", "a"), (None, base, "a"), (3, base, "b")]
    got = paragraph_dedup.paragraph_dedup(H.docs(spark, rows).withColumn("line", F.lit(0))).collect()
    want = [(5, 1, 1, [1], [3]), (3, 1, 0, [], []), (9, 3, 2, [2, 3], [3]), (1, 0, 0, [], []), (2, 0, 0, [], []), (4, 0, 0, [], []), (None, 0, 0, [], []), (3, 1, 0, [], [])]
    assert H.counts(tuple(r) for r in got) == H.counts(want)
    assert paragraph_dedup.paragraph_dedup(H.docs(spark, rows).limit(0)).count() == 0
    assert 1 - (1 - 0.8**3) ** paragraph_dedup.tuned(80, 3, 1e-4) >= 1 - 1e-4


def test_paragraph_components_match_brute_force(spark):
    rows = [(k, "\n".join(H.prose(s, 30, 3000) for s in (k % 5, k)) + "\n" + t, "a") for k, (_, t, _) in enumerate(_family(10))]
    got = paragraph_dedup.repeated_paragraphs(H.docs(spark, rows)).collect()
    parts = [((k, n), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for k, t, _ in rows for n, line in enumerate(t.split("\n")) for w in [line.split()] if len(w) >= 20]
    assert {(r.doc, r.line): (r.first_doc, r.first_line) for r in got} == H.classes(parts)


def test_short_paragraphs_and_wrapped_passages(spark):
    a, b, c = (H.prose(s, n, 3000) for s, n in ((501, 12), (502, 15), (503, 4)))
    rows = [(1, f"{H.prose(504, 9)}\n\n{a}\n{b}\n\n{c}", "a"), (2, f"{H.prose(505, 30)}\n{a}\n{b}\n{H.prose(506, 40)}\n{c}", "a"), (3, f"{a} {b}\n \n", "a"), (4, f"{H.prose(507, 14)}\n{a.upper()}", "a"), (None, a, "a"), (5, None, "a")]
    got = paragraph_dedup.repeated_passages(H.docs(spark, rows)).collect()
    parts = {}
    for k, t, _ in rows:
        lines, run = (t or "").split("\n"), []
        for n, line in enumerate([*lines, ""]):
            if k is not None and line.strip():
                parts[k, n, n] = H.shingles(line, 5)
            if 0 < len(line.split()) < 20:
                run.append(n)
                continue
            if len(run) > 1 and k is not None:
                parts[k, run[0], run[-1]] = H.shingles("\n".join(lines[run[0] : run[-1] + 1]), 5)
            run = []
    assert {(r.doc, r.line, r.last): (r.first_doc, r.first_line, r.first_last) for r in got} == H.classes(sorted(parts.items()))
    gone = {(r.doc, r.line, r.last) for r in got if not r.kept}
    assert gone == {(2, 1, 1), (2, 2, 2), (2, 1, 2), (2, 4, 4), (3, 0, 0), (4, 1, 1)}
    assert paragraph_dedup.repeated_passages(H.docs(spark, rows).limit(0)).count() == 0


def _removed(rows):
    """doc_id -> (bytes, removed, spans, kept hash), by a dictionary of all 100-byte strings."""
    seen, out = set(), {}
    for k, text in sorted(rows):
        body = text.encode()
        hit = np.zeros(len(body), dtype=bool)
        for i in range(len(body) - 99):
            s = body[i : i + 100]
            if s in seen:
                hit[i : i + 100] = True
            seen.add(s)
        kept = bytes(b for b, h in zip(body, hit) if not h)
        out[k] = (len(body), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark):
    shared = H.prose(61, 60, 3000)
    rows = [(r.doc_id, r.text, r.source) for r in H.awkward(spark).collect()]
    rows += [(300 + k, H.prose(70 + k, k * 3, 3000) + " " + " ".join(shared.split()[k : 60 - k]) + H.prose(90 + k, 10, 3000), "a") for k in range(20)]
    rows += [(400, "ab" * 400, "a"), (401, "é" * 300, "a"), (402, shared + shared, "b"), (403, shared[:99], "b")]
    table = H.docs(spark, rows).withColumn("bucket", F.lit("clash"))
    got = run_length_index.repeated_bytes(table, carry=("bucket",)).collect()
    want = _removed({k: t or "" for k, t, _ in rows if k is not None}.items())
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            assert g.n_removed == 0
        else:
            assert (g.n_bytes, g.n_removed, len(g.spans), g.kept_sha256) == want[g.doc_id], g.doc_id
        assert g.bucket == "clash"
    assert run_length_index.repeated_bytes(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 2, 1000])
def test_anchors_with_many_places(spark, monkeypatch, most):
    """Equal stretches told by hashes from the first, from the third or never: the same result."""
    monkeypatch.setattr(run_length_index, "MANY_PLACES", most)
    test_repeated_bytes(spark)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_most_repeats_are_found_by_the_index(spark, monkeypatch):
    """The share of marked windows that hashes alone decide."""
    kept = {}

    def windows(df):
        return sum(int(run_length_index.unpack(r.columns[3], np.uint8).sum()) for r in df.filter("kind = 1").collect())

    def watched(make):
        def run(self, df, name):
            out = make(self, df, name)
            if name in ("equal", "marks"):
                kept[name] = windows(out)
            return out

        return run

    for name in ("settled", "concluded"):
        monkeypatch.setattr(run_length_index.Work, name, watched(getattr(run_length_index.Work, name)))
    run_length_index.repeated_bytes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    print(f"{kept['equal'] / kept['marks']:.2f} of the marked windows by hashes")
    assert 0 < kept["equal"] < 0.5 * kept["marks"]


def test_windows_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(run_length_index, "HOT_STRETCHES", 3)
    test_repeated_bytes(spark)
    monkeypatch.setattr(run_length_index, "HOT_STRETCHES", 0)
    test_repeated_bytes(spark)


def test_bytes_of_a_hot_anchor_do_not_meet(spark, monkeypatch):
    """Borders of one passage in many documents: no task gets more than a bounded number of stretches of one anchor."""
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(run_length_index, "HOT_STRETCHES", 50, raising=False)
    plain = run_length_index._fetch

    def counted(groups):
        fetch = plain(groups)

        def run(docs, asked):
            out = fetch(docs, asked)
            seen.add(sum(len(run_length_index.unpack(c[0], np.uint64)) for k, c in zip(out.column("kind").to_pylist(), out.column("columns").to_pylist()) if k == 0))
            return out

        return run

    monkeypatch.setattr(run_length_index, "_fetch", counted)
    passage = H.prose(801, 40, 3000)
    rows = [(k, f"{H.prose(2000 + k, 20, 3000)} {passage} {H.prose(4000 + k, 20, 3000)}", "a") for k in range(200)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in run_length_index.repeated_bytes(H.docs(spark, rows)).collect()}
    assert got == _removed((k, t) for k, t, _ in rows)
    assert seen.value < 200


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    body = H.prose(77, 1500, 3000)
    data = np.frombuffer(body.encode(), dtype=np.uint8)
    whole = run_length_index.stretches(data, np.array([0, len(data)]))
    assert whole[1].sum() == len(data) - 99
    parts = [run_length_index.stretches(data[lo : lo + 4000 + 99], np.array([0, min(4099, len(data) - lo)])) for lo in range(0, len(data) - 99, 4000)]
    assert sum(p[1].sum() for p in parts) == len(data) - 99


def test_run_length_index_matches_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(20):
        texts = [bytes(rng.integers(97, 100, int(rng.integers(30, 120))).astype(np.uint8)) for _ in range(6)]
        texts.append(texts[0][5:60] + texts[1][3:50])
        patterns = [texts[2][4:70], texts[6], bytes(rng.integers(97, 101, 80).astype(np.uint8))]
        tags = np.array([0, 0, 0, 1, 1, 0, 0])
        index = run_length_index.RunLengthIndex(texts, tags)
        got = index.statistics(patterns, np.zeros(3, dtype=np.int64), 12)
        for p, found in zip(patterns, got):
            assert sorted(found.tolist()) == [i for i in range(len(p) - 11) if any(p[i : i + 12] in t for t, g in zip(texts, tags) if g == 0)]


def test_equal_windows_of_many_copies():
    texts = [bytes([97 + k % 26]) * 3 + b"0123456789" * 12 + bytes([97 + k // 26]) * 5 for k in range(60)]
    got = run_length_index.earlier_matches(np.zeros(60, dtype=np.int64), np.arange(60), texts)
    seen = set()
    for t, found in zip(texts, got):
        windows = [t[i : i + 100] for i in range(len(t) - 99)]
        assert found.tolist() == [i for i, w in enumerate(windows) if w in seen]
        seen.update(windows)


def test_texts_of_one_key_are_told_apart(spark):
    """Rows of one key with different texts, keys in strides: nothing of a text without copies goes."""
    rows = [(8 * k, H.prose(k, 40, 3000), "a") for k in range(60)] + [(8, H.prose(500 + k, 40, 3000), "b") for k in range(40)]
    got = run_length_index.repeated_bytes(H.docs(spark, rows), carry=("text", "source", "lang")).withColumnRenamed("n_removed", "gone").collect()
    assert len(got) == 100 and all(g.gone == 0 and g.kept_text == g.text for g in got)
    assert H.counts((g.doc_id, g.text, g.source) for g in got) == H.counts(rows)
