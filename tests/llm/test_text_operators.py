"""Operators that judge texts one by one or against the corpus, compared with plain Python."""

import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemill.llm import backoff_lm, deobfuscate, gam, html_blocks, pfair, positional_index, repetition

from . import helpers as H


def test_repetition_coverage(spark):
    table = H.awkward(spark).withColumn("n_words", F.lit("clash"))
    got = repetition.repetition_coverage(table).collect()
    want = []
    for r in H.awkward(spark).collect():
        w = H.words(r.text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines, dup = set(), 0
        for line in (r.text or "").split("\n"):
            if H.words(line):
                dup += line in lines
                lines.add(line)
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), dup, len(hit), len(w) < 50 or 2 * len(hit) > len(w)))
    assert H.counts((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got) == H.counts(want)
    by = {g.doc_id: g for g in got}
    assert by[13].kept and not by[10].kept and not by[1].kept
    assert repetition.repetition_coverage(table.limit(0)).count() == 0


def test_repetition_rejects_repeated_lines_only(spark):
    clean, lines = H.prose(21, 200, 5000), "\n".join([H.prose(22, 30, 5000)] * 2 + [H.prose(23, 40, 5000)])
    got = {r.doc_id: r.kept for r in repetition.repetition_coverage(H.docs(spark, [(1, clean, "a"), (2, lines, "a")])).collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores(spark, order):
    table = H.awkward(spark).unionByName(H.docs(spark, [(k, H.prose(k % 7, 40, 30), "a") for k in range(100, 160)])).withColumn("score", F.lit(1))
    got = backoff_lm.scores(table, order=order, strength=3.0).collect()
    rows = [(r.doc_id, [*H.words((r.text or "").translate(H.LOWER)), None]) for r in table.collect()]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    c = Counter(tuple(t[i : i + n]) for k, t in rows if not held(k) for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total, known = sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    once, twice = (sum(v == n for g, v in c.items() if len(g) == 1) for n in (1, 2))
    cut = once / (once + 2 * twice)

    def p(history, w):
        if history and not c[history]:
            return p(history[1:], w)
        if history:
            return (c[(*history, w)] + 3.0 * p(history[1:], w)) / (c[history] + 3.0)
        return (c[(w,)] - cut) / total if c[(w,)] else cut * known / total

    want = {}
    for k, t in rows:
        base = sum(math.log10((c[(w,)] + 0.1) / (total + 0.1 * (known + 1))) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), w)) for i, w in enumerate(t))
        want[k] = (held(k), len(t), sum(c[(w,)] > 0 for w in t), total, base, score)
    assert len(got) == len(rows)
    for g in got:
        h, n, kn, tot, base, score = want[g.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, n, kn, tot)
        assert g.base_score == pytest.approx(base, abs=1e-8) and g.score == pytest.approx(score, abs=1e-8)


def test_registered_model_has_trigrams(spark, tmp_path):
    from phasemill.llm import queries

    H.docs(spark, [(k, H.prose(k % 7, 40, 30), "a") for k in range(100, 160)]).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got, three, two = ({r.doc_id: r.score for r in d.collect()} for d in (queries.op3_backoff_automaton(spark, str(tmp_path)), backoff_lm.scores(table, order=3), backoff_lm.scores(table, order=2)))
    assert got == pytest.approx(three) and sum(got.values()) > sum(two.values())


def test_packed_numbers_come_back():
    rng = np.random.default_rng(6)
    for values in (np.zeros(0, dtype=np.int64), np.zeros(5, dtype=np.int64), np.array([0, 1, 2, 3, 2**30, 2**31 - 2]), rng.zipf(1.3, 5000) % 100_000):
        assert np.array_equal(backoff_lm.unpack_numbers(backoff_lm.pack_numbers(values)), values)


def test_backoff_lanes_join_seamlessly(spark, monkeypatch):
    table = H.docs(spark, [(k, H.prose(k, 1300, 50), "a") for k in range(1, 6)])
    whole = {r.doc_id: r.score for r in backoff_lm.scores(table, order=3).collect()}
    hashes = np.arange(1, 9, dtype=np.uint64)[[0, 1, 2, 3, 0, 1, 2, 4, 0, 1]]
    bounds = np.array([0, 10])
    grams = [backoff_lm.Grams(hashes, bounds, k) for k in (1, 2, 3)]
    model = {"discount": 0.5, "total": 10, "strength": 2.0, "unknown": -3.0}
    automaton = backoff_lm.Automaton(grams, [g.counts(np.ones(10, dtype=bool)).astype(float) for g in grams], hashes, model)
    one = automaton.traverse(grams[0].at, bounds)
    monkeypatch.setattr(backoff_lm, "LANE", 3)
    assert np.allclose(one, automaton.traverse(grams[0].at, bounds))
    again = {r.doc_id: r.score for r in backoff_lm.scores(table, order=3).collect()}
    assert whole == pytest.approx(again)


def test_backoff_without_rows_or_training(spark):
    empty = H.awkward(spark).limit(0)
    assert backoff_lm.scores(empty).count() == 0
    out = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    (row,) = backoff_lm.scores(H.docs(spark, [(out, "a b", "s")])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.score) == (True, 3, 0, 0, 0.0)


def test_contamination(spark):
    passage = H.prose(31, 20)
    rows = [(0, f"{H.prose(32, 30)} {passage} {H.prose(33, 30)}", "a"), (1, passage.upper(), "a"), (2, None, "a"), (3, "alpha, beta!", "a"), (4, H.prose(34, 900) + " alpha beta", "b"), (5, " ".join(passage.split()[:12]), "a"), (6, "", "b"), (3, "alpha, beta!", "a"), (None, "alpha-beta", "c")]
    items = spark.createDataFrame([(1, passage), (2, "Alpha  beta"), (3, None), (4, ""), (None, "alpha"), (10, "alpha beta")], "item_id long, text string")
    got = positional_index.contamination(H.docs(spark, rows).withColumn("items", F.lit(0)), items).collect()
    digest = positional_index.items_digest
    want = [(0, 80, 20, ["1"], True), (1, 20, 20, ["1"], True), (2, 0, 0, [], False), (3, 2, 2, ["10", "2"], True), (4, 902, 2, ["10", "2"], False), (5, 12, 0, [], False), (6, 0, 0, [], False), (3, 2, 2, ["10", "2"], True), (None, 2, 2, ["10", "2"], True)]
    assert H.counts((g.doc_id, g.n_words, g.n_hit, g["items"], g.contaminated) for g in got) == H.counts(want)
    assert digest(["2", "10"]) == hashlib.sha256(b"10,2").hexdigest()


def test_contamination_in_slices_and_without_items(spark, monkeypatch):
    rows = [(k, H.prose(k % 5, 60) + " " + H.prose(50 + k, 30), "a") for k in range(12)]
    items = spark.createDataFrame([(k, H.prose(k, 25)) for k in range(5)], "item_id long, text string")
    table = H.docs(spark, rows)
    columns = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    whole = {r.doc_id: tuple(r) for r in positional_index.contamination(table, items).select(columns).collect()}
    assert len(list(positional_index.slices(items, "item_id", "text", 100))) > 1
    monkeypatch.setattr(positional_index, "slices", lambda *a, f=positional_index.slices: f(*a[:3], 100))
    assert {r.doc_id: tuple(r) for r in positional_index.contamination(table, items).select(columns).collect()} == whole
    assert all(r.n_hit == 0 for r in positional_index.contamination(table, items.limit(0)).collect())
    assert positional_index.contamination(table.limit(0), items).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 100])
def test_contamination_judges_each_row(spark, monkeypatch, most):
    """Null and repeated keys, against plain Python, with a benchmark of one slice and of several."""
    a, b = H.prose(31, 20), H.prose(35, 20)
    rows = [(None, a, "a"), (None, H.prose(36, 50) + " " + b, "a"), (None, "clean words", "a"), (None, None, "a"), (7, a, "a"), (7, H.prose(37, 90), "a"), (7, a, "a"), (8, a + " " + b, "a"), (9, H.prose(38, 500) + " " + b, "a")]
    items = [(1, a), (2, b), (3, "clean")]
    want = []
    for k, t, _ in rows:
        w, hit, named = H.words(t), set(), set()
        for n, x in items:
            p = x.split()
            for win in (tuple(p[i : i + 13]) for i in range(max(1, len(p) - 12))):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        named.add(str(n))
        want.append((k, len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    monkeypatch.setattr(positional_index, "slices", lambda *a, f=positional_index.slices: f(*a[:3], most))
    got = positional_index.contamination(H.docs(spark, rows).withColumn("row", F.lit(1)).withColumn("spans", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert H.counts(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()) == H.counts(want)


@pytest.mark.parametrize("most", [2_000_000, 60])
def test_proximity(spark, monkeypatch, most):
    rows = [(1, "red blue x green", "a"), (2, "green x x x x x x red blue", "a"), (3, "blue green red", "a"), (3, "blue green red", "b"), (None, "x red red x blue green", "a"), (4, None, "a"), (5, " ".join(reversed(H.prose(61, 14, 3000).split())), "a"), (6, H.prose(62, 40, 9), "a")]
    items = [("q", "red blue green"), ("r", "red red"), ("s", H.prose(61, 14, 3000)), ("t", H.prose(63, 13, 9)), (None, "red"), ("u", None)]
    monkeypatch.setattr(positional_index, "slices", lambda *a, f=positional_index.slices: f(*a[:3], most))
    table, asked = H.docs(spark, rows).withColumn("item", F.lit(0)), spark.createDataFrame(items, "item_id string, text string")
    for width in (5, 14):
        want = []
        for k, t, _ in rows:
            w = H.words(t)
            for n, x in items:
                p = H.words(x)
                wins = [set(p[i : i + 13]) for i in range(max(1, len(p) - 12))] if p else []
                if n and any(win <= set(w[s : s + width]) for win in wins for s in range(len(w))):
                    want.append((k, n))
        assert want and H.counts(tuple(r) for r in positional_index.proximity(table, asked, width).collect()) == H.counts(want)
    assert positional_index.proximity(table, asked.limit(0)).count() == positional_index.proximity(table.limit(0), asked).count() == 0


def test_main_text():
    page = "<html><body><div id=header>Name</div><div class='cookie-notice'>We use cookies so that all of this works, please do accept every one of them.</div><div class=content><h1>Title of it</h1><p>{0}<p>Short.</p><p>{0}</div><div class='sidebar'><p>{0}</div><div id=comments><p>{0}</div><div class=footer>x</div></body></html>".format("A &lt;long&gt;   text with words &amp; more. " * 4)
    body = ("A <long> text with words & more. " * 4).strip()
    assert html_blocks.main_text(page) == f"Title of it\n{body}\nShort.\n{body}"
    assert html_blocks.main_text("<article><p>a<aside>no</aside><script>if (a < b) {}</script><p>b<br>c</p><div class=comments><p>me too</div></article><p>after") == "a\nb\nc"
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<nav>a</nav>") == ""
    assert html_blocks.main_text("<article><p>cut off in a ta") == "cut off in a ta"


def _kept_lines(found, window, surge, dive, bonus, outside, share):
    """Numbers of the kept lines, by the definition: one pass that opens at a surge and closes at a dive."""
    seen = [n for n, x in enumerate(found) if not x.furniture]
    article = any(found[n].article for n in seen)
    weight = {}
    for n in seen:
        x = found[n]
        plain = 0 if x.links >= share * len(x.text) else len(x.text) - x.links
        weight[n] = len(x.text) + bonus if x.article else plain * outside if article else plain
    total = {n: sum(weight[m] for m in seen[k : k + window]) for k, n in enumerate(seen)}
    top = min(surge, max(total.values(), default=0))
    low = min(dive, top)
    kept, open_, leading = [], False, False
    for n in seen:
        if not open_ and weight[n] and total[n] >= top:
            open_ = leading = True
        if open_ and total[n] < low:
            open_ = False
            continue
        if open_:
            leading = leading and weight[n] < low and not found[n].heading
            if weight[n] and not leading:
                kept.append(n)
    return kept


def test_surges_and_dives_match_a_second_version():
    rng = np.random.default_rng(4)
    differ = 0
    for _ in range(400):
        some = rng.random() < 0.5
        lines = []
        for _ in range(int(rng.integers(0, 25))):
            size = int(rng.choice([3, 15, 30, 60, 200]))
            lines.append(html_blocks.Line("x" * size, bool(rng.random() < 0.2), bool(some and rng.random() < 0.4), int(size * rng.choice([0, 0, 0.5, 1])), bool(rng.random() < 0.1)))
        plans = [html_blocks.Blocks(), html_blocks.Blocks(window=1, surge=1), html_blocks.Blocks(window=5, surge=300, dive=60)]
        got = [[id(x) for x in html_blocks.main_lines(lines, p)] for p in plans]
        assert got == [[id(lines[n]) for n in _kept_lines(lines, p.window, p.surge, p.dive, p.bonus, p.outside, p.link_share)] for p in plans]
        differ += got[0] != got[1]
    assert differ > 100


def test_window_decides_without_an_article():
    """A page of plain divs: short lines go, the text between surge and dive stays; the window's size matters."""
    text = [H.prose(k, 30, 3000) for k in range(4)]
    page = "<body>" + "".join(f"<div>{t}</div>" for t in ["Home", "News", "Log in", "A B", *text[:2], "* * *", *text[2:], "End", "Terms", "Map"]) + "</body>"
    assert html_blocks.main_text(page) == "\n".join([*text[:2], "* * *", *text[2:]])
    assert html_blocks.main_text(page, html_blocks.Blocks(window=1, surge=1, dive=1)).startswith("Home\nNews")
    ends = "<article><p>a first line of some length, and more of it</p><aside>x</aside><aside>y</aside><nav>z</nav><p><a href=/>Sources</a></p><p>Short.</p></article><div>Rights reserved</div>"
    assert html_blocks.main_text(ends) == "a first line of some length, and more of it\nSources\nShort."


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_pages_without_article_keep_their_text(spark):
    """Precision and recall by words, against a plain cut of the article, with and without the elements that mark it."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    hit = got_n = want_n = whole = 0
    for (page,) in rows:
        inner = re.search(r"<article>(.*)</article>", page, re.DOTALL).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        whole += " ".join(html_blocks.main_text(page).split()) == want
        got = Counter(html_blocks.main_text(re.sub(r"</?article>", "", page)).split())
        hit += (got & Counter(want.split())).total()
        got_n, want_n = got_n + got.total(), want_n + len(want.split())
    assert whole == len(rows) and hit / got_n > 0.9 and hit / want_n > 0.9


def test_main_text_of_tables(spark):
    rows = [(1, "u", "<article><p>é</p></article>"), (1, "u", "<article><p>é</p></article>"), (2, None, None), (None, "v", "<article>" + "<p>x</p>" * 3000 + "</article>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_blocks.extracted(table).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 5999), (1, 1), (1, 1), (2, 0)]
    assert html_blocks.extracted(table.limit(0)).count() == 0


def test_mixing(spark):
    table = H.awkward(spark).withColumn("slot", F.lit("clash"))
    got = pfair.mixed(table, {"a": 3, "b": 1}, block_bytes=700, carry=("text",)).collect()
    assert H.counts((r.doc_id, r.source, r.text) for r in got) == H.counts((r.doc_id, r.source, r.text) for r in table.collect())
    for name in ("a", "b", "c", None):
        rows = sorted((r.block * 700 + r.offset, r.n_bytes) for r in got if r.source == name)
        assert [s for s, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert pfair.mixed(table.limit(0)).count() == 0


def _slots(blocks, shares):
    """(slot, source, block, release, deadline) of all blocks, from the phases' periods."""
    return [(p.begin + m * p.length + t, i, p.done[i] + m * p.shares[i] + k, p.begin + m * p.length + r, p.begin + m * p.length + d) for p in pfair.phases(blocks, shares) for m in range(-(-p.slots // p.length)) for t, i, k, r, d in islice(pfair.slots_of(p.shares), p.made) if m * p.length + t < p.slots]


def _earliest_deadlines(blocks, shares):
    """The same by taking, slot by slot, the released block with the earliest deadline of all."""
    left, out, begin, done = list(blocks), [], 0, [0] * len(blocks)
    while active := [i for i, n in enumerate(left) if n]:
        whole, base, t = sum(shares[i] for i in active), list(done), 0
        while all(left[i] for i in active):
            k = {i: done[i] - base[i] for i in active}
            free = [(-(-(k[i] + 1) * whole // shares[i]), i) for i in active if k[i] * whole // shares[i] <= t]
            d, i = min(free)
            out.append((begin + t, i, done[i], begin + k[i] * whole // shares[i], begin + d))
            done[i], left[i], t = done[i] + 1, left[i] - 1, t + 1
        begin += t
    return out


def test_schedule_stays_within_one_block():
    rng = np.random.default_rng(3)
    for most in (500, 9):
        for _ in range(40):
            n = int(rng.integers(1, 7))
            blocks, shares = rng.integers(0, 40, n).tolist(), rng.integers(1, most, n).tolist()
            rows = sorted(_slots(blocks, shares))
            assert rows == _earliest_deadlines(blocks, shares)
            assert [r[0] for r in rows] == list(range(sum(blocks)))
            left, active = list(blocks), {i for i in range(n) if blocks[i]}
            done, t = dict.fromkeys(active, 0), 0
            for slot, i, _, release, deadline in rows:
                assert release <= slot < deadline
                whole = sum(shares[j] for j in active)
                done[i], t, left[i] = done[i] + 1, t + 1, left[i] - 1
                assert all(abs(done[j] - t * shares[j] / whole) < 1 for j in active)
                if not left[i]:
                    active.discard(i)
                    done, t = dict.fromkeys(active, 0), 0


def test_the_plan_does_not_grow_with_the_blocks():
    few, many = (pfair.phases([n, 3 * n, n // 2], [5000, 3000, 2000]) for n in (10**6, 10**12))
    assert [p.made for p in few] == [p.made for p in many] == [10_000, 5_000, 3_000]
    assert sum(p.slots for p in many) == 45 * 10**11


def test_mixing_matches_the_schedule(spark):
    """Blocks of the same size at any total: each row's slot is its block's in the plain schedule, with null keys and many sources."""
    rows = [(None if k % 3 == 0 else k, H.prose(k, 20 + k % 9, 3000), f"s{k % 11}") for k in range(400)]
    table = H.docs(spark, rows).withColumns({"slot": F.lit("clash"), "_name": F.lit(1), "phase": F.lit(2), "_carried": F.lit(3)})
    carried = ("text", "_name", "phase", "_carried")
    got = pfair.mixed(table, block_bytes=300, period=50, carry=carried).collect()
    assert H.counts((r.doc_id, r.source, r.text, r["_name"], r.phase, r["_carried"]) for r in got) == H.counts((k, s, t, 1, 2, 3) for k, t, s in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.encode()) + 1
    names = sorted(size, key=lambda s: (-size[s], s))
    shares = [(size[s] / sum(size.values())) ** 0.7 for s in names]
    shares = [max(1, round(w / sum(shares) * 50)) for w in shares]
    at = {(names[i], b): (slot, r, d) for slot, i, b, r, d in _earliest_deadlines([-(-size[s] // 300) for s in names], shares)}
    assert all(at[r.source, r.block] == (r.slot, r.release, r.deadline) for r in got)


def test_a_thousand_sources(spark):
    """Each is a task of its own: no source departs from its share by a block, and rows are where the plain schedule has them."""
    rng = np.random.default_rng(9)
    blocks, shares = rng.integers(1, 6, 1000).tolist(), rng.integers(1, 30, 1000).tolist()
    assert sorted(_slots(blocks, shares)) == _earliest_deadlines(blocks, shares)
    rows = [(k, "x" * 299, f"s{k % 1000}") for k in range(3000)]  # blocks of 300 bytes, one row each
    got = pfair.mixed(H.docs(spark, rows), block_bytes=300).collect()
    assert sorted(r.slot for r in got) == list(range(3000)) and all(r.release <= r.slot < r.deadline for r in got)
    assert all(abs(r.slot / 1000 - r.block) < 1 for r in got)


def _auc(score, label):
    rank = np.argsort(np.argsort(score))
    one = label == 1
    return (rank[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


def test_quality_on_held_out_rows(spark):
    rows = [(k, H.prose(k, 60) if k % 3 else "$$$ " * 40 + H.prose(k, 20), "a") for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(600)] + [(1, None), (2, 7), (None, 1)], "doc_id long, quality int").withColumn("text", F.lit(""))
    got = gam.quality(H.docs(spark, [*rows, (1000, None, "a"), (1001, "", "a"), (None, "x", "a")]), labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in [*range(600), 1000, 1001] if zlib.crc32(str(k).encode()) % 3 == 1}
    held = [r for r in held if r.doc_id < 1000]
    assert _auc(np.array([r.score for r in held]), np.array([int(r.doc_id % 3 > 0) for r in held])) > 0.99


def test_quality_without_labels_or_rows(spark):
    table = H.awkward(spark)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert len({r.score for r in gam.quality(table, labels.limit(0)).collect()}) == 1
    assert len({r.score for r in gam.quality(table, labels).collect()}) == 1
    assert gam.quality(table.limit(0), labels).count() == 0


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.AdditiveModel(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and _auc(model.score(x[3000:]), y[3000:]) > 0.95


def _letters():
    import pyarrow as pa

    from phasemill.llm import words as W

    text = " ".join(["the stupid idiot is a clown and the clown is stupid", "worthless trash", "we said that it is cold outside and the storm was loud"] * 30)
    (_, _, data, _), = list(W.blocks(pa.array([text])))
    c = deobfuscate._CLASS[np.concatenate([[32], data, [32]])]
    codes = (c[:-2] << 14) | (c[1:-1] << 7) | c[2:]
    codes, n = np.unique(codes[(codes & 0x3FFF) > 0], return_counts=True)
    return deobfuscate.Letters(codes, n)


def test_restored_words():
    letters = _letters()
    for disguised, plain in {"1d10t": "idiot", "st*pid": "stupid", "c-l-o-w-n": "clown", "trrrash": "trash", "$tup!d": "stupid", "iiddiioott": "idiot", "w0rthle55": "worthless"}.items():
        assert deobfuscate.restored(disguised, letters) == plain
    data = np.frombuffer(b"He is an i d i o t. Plain words, x", dtype=np.uint8)
    got = deobfuscate.read(data, np.array([0, len(data)]), letters, {})
    plain = np.frombuffer(b"idiot", dtype=np.uint8)
    assert deobfuscate.W.rolling_hashes(plain, np.array([0]), np.array([5]))[0] in got.hashes


def test_toxicity_on_held_out_rows(spark):
    mean = ["stupid idiot", "worthless clown", "$tup1d", "i d i o t", "cl0wn"]
    rows = [(k, H.prose(k, 30) + (f" {mean[k % len(mean)]} " if k % 4 == 0 else " ") + H.prose(k + 5000, 20), "a") for k in range(900)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    extra = [(2000, None, "a"), (2001, "", "a"), (None, "you idiot", "a"), (2002, "x" * 20000, "a"), (2003, "a 1 $ b " * 500, "a")]
    got = deobfuscate.toxicity(H.docs(spark, rows + extra), labels).collect()
    assert len(got) == 905 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert _auc(np.array([r.score for r in held]), np.array([int(r.doc_id % 4 == 0) for r in held])) > 0.99


def test_toxicity_without_labels_or_rows(spark):
    table, labels = H.awkward(spark), spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert len({r.score for r in deobfuscate.toxicity(table, labels.limit(0)).collect()}) == 1
    assert deobfuscate.toxicity(table.limit(0), labels).count() == 0
