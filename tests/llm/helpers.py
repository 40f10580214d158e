"""Small tables with awkward rows, and plain versions of the operators to compare with."""

import re
from collections import Counter

from pyspark.sql import types as T

SYLLABLES = [a + b for a in "bdfglmnrv" for b in "aeou"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], DOCS)


def prose(seed, n, vocabulary=400):
    """n words of a fixed made-up language."""
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        word = (x >> 33) % vocabulary
        out.append("".join(SYLLABLES[word // len(SYLLABLES) ** k % len(SYLLABLES)] for k in range(3)) + SYLLABLES[word * 7 % len(SYLLABLES)])
    return " ".join(out)


def awkward(spark):
    """Null, empty and blank texts, exact copies, a row given twice, a text of one long word, lines, unusual letters, a null key and source."""
    base = prose(1, 120)
    edited = " ".join(w if i % 60 else "changed" for i, w in enumerate(base.split()))
    rows = [
        (0, base, "a"), (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, base, "b"), (5, edited, "a"), (6, base.upper().replace("W", "W"), "a"),
        (7, prose(2, 80) + "\n" + base + "\n" + prose(3, 90), "b"), (8, "x" * 5000, "a"), (9, "one two three", "a"), (10, "Ünïcödé ßtraße " * 40, "c"), (11, "One  two\tthree", "c"),
        (12, "\n".join(["same line here"] * 8 + [prose(4, 60)]), "a"), (13, prose(5, 3000), "a"), (9, "one two three", "a"), (14, "é" * 70 + prose(6, 30), "b"), (None, base, "a"), (15, "é" * 70 + prose(7, 30), "b"),
    ]
    return docs(spark, rows)


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(sets):
    """(key, set) pairs -> smallest key that each key reaches by similarity of 0.8 or more."""
    lead = {k: k for k, _ in sets}

    def find(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                lead[max(p, q)] = min(p, q)
    return {k: find(k) for k in lead}


def counts(items):
    return Counter(map(repr, items))
