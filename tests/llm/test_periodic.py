"""Periodic runs against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfold.llm import periodic


def brute(ids, least=24, periods=3):
    """Every period on its own: stretches of equal words one period apart; of one interval the least period stays."""
    n, found = len(ids), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(r, n, kinds):
    """Random words with stretches that repeat, some within others."""
    out = []
    while len(out) < n:
        if r.random() < 0.3:
            base = [r.randrange(kinds) for _ in range(r.randint(1, 12))]
            if r.random() < 0.3:
                base = base * r.randint(2, 5) + [r.randrange(kinds)]
            out += (base * r.randint(2, 30))[: r.randint(5, 200)]
        else:
            out += [r.randrange(kinds) for _ in range(r.randint(1, 15))]
    return np.array(out[:n], np.int32)


@pytest.mark.parametrize("kinds", [1, 2, 3, 50])
@pytest.mark.parametrize("least,periods", [(24, 3), (6, 2), (10, 4)])
def test_runs_equal_brute_force(kinds, least, periods):
    r = random.Random(kinds)
    for _ in range(60):
        ids = planted(r, r.randint(0, 300), kinds)
        assert periodic.find_runs(ids, least, periods) == brute(ids.tolist(), least, periods)


def test_words_of_thue_and_fibonacci():
    """Words without cubes have no run; Fibonacci words have many that overlap."""
    thue = np.array([bin(i).count("1") & 1 for i in range(3000)], np.int32)
    assert periodic.find_runs(thue) == []
    a, b = [0], [0, 1]
    while len(b) < 2500:
        a, b = b, b + a
    found = periodic.find_runs(np.array(b, np.int32))
    assert found and found == brute(b)


def test_z_function():
    from array import array

    r = random.Random(5)
    for _ in range(300):
        w = [r.randrange(2) for _ in range(r.randint(1, 40))]
        assert periodic.z_function(array("i", w)).tolist() == [next((k for k in range(len(w) - i) if w[k] != w[i + k]), len(w) - i) for i in range(len(w))]


def test_a_long_text_takes_n_log_n():
    ids = np.zeros(400_000, np.int32)
    assert periodic.find_runs(ids) == [(0, 400_000, 1)]
    assert len(periodic.kept_words(len(ids), [(0, 400_000, 1)])) == 1


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_BYTES", 7)
    text = "one  two\x1cthree\n\n averyveryverylongword\x0b ü one \r"
    words, ids = periodic.intern_words(text.encode())
    assert [words[i].decode() for i in ids] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_query_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(str(x) for x in planted(r, r.randint(0, 200), 4))) for i in range(300)]
    rows += [(1000 + i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 90)))) for i in range(150)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (None, "a " * 40), (2003, "x y z\x1cw " * 30), (2003, "x y z\x1cw " * 30), (2004, "word " * 5000)]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("runs", "collapsed", "start", "best", "words")}).repartition(3)
    found = sorted(map(tuple, periodic.op13_periodic_runs(docs).collect()), key=repr)
    assert found == sorted(((k, *expected(k, t)) for k, t in rows), key=repr)


def test_operator_keeps_columns_and_gives_texts(spark):
    docs = spark.createDataFrame([(1, "start " + "go on " * 20 + "end", "x")], "doc_id long, text string, extra string")
    row = periodic.periodic_runs(docs, runs_as="r", collapsed_as="c").first()
    assert (row.extra, row.c) == ("x", "start go on end") and [tuple(x) for x in row.r] == [(1, 40, 2)]
    assert periodic.op13_periodic_runs(docs.limit(0)).count() == 0
