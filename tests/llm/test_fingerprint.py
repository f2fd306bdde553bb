"""Fingerprints against a plain version, and neighbours on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfold.llm import fingerprint as fp

W, A = fp.WINDOW, fp.AROUND


def text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlué") for _ in range(r.randint(1, 9))) for _ in range(n))[:n]


def plain_level(window: bytes) -> int:
    return sum(int(fp._TERM[c]) for c in Counter(window).values()) >> fp._SHIFT


def plain_features(data: bytes, ranks) -> list[bytes]:
    """One stretch of windows after the other."""
    rank = [int(ranks[plain_level(data[i : i + W])]) for i in range(len(data) - W + 1)]
    points = Counter(min(range(i, i + A), key=lambda k: (rank[k], k)) for i in range(len(rank) - A + 1))
    places = sorted(p for p, n in points.items() if n >= fp.POPULAR)
    return list(dict.fromkeys([data[p : p + W] for p in places])) or ([data] if data else [])


def plain_digest(data: bytes, ranks) -> str:
    found, out = plain_features(data, ranks), []
    for i in range(0, len(found), fp.PER_FILTER):
        flags = np.zeros(fp.BITS, bool)
        for f in found[i : i + fp.PER_FILTER]:
            flags[[int.from_bytes(hashlib.sha1(f).digest()[4 * k : 4 * k + 4], "big") % fp.BITS for k in range(fp.HASHES)]] = True
        out.append(fp.Digest(np.packbits(flags).view(np.uint64).reshape(1, -1), np.array([len(found[i : i + fp.PER_FILTER])])))
    return ",".join(map(str, out))


TEXTS = ["", "a", "short", "x" * 500, text(1, 69), text(2, 63), text(3, 62), text(4, 3000), text(5, 20000), "ab" * 400, text(6, 300) * 4, "日本語のテキスト" * 60, text(7, 100)]


def test_levels_are_entropies():
    data = np.frombuffer(text(8, 700).encode(), np.uint8)
    levels = fp.entropy_levels(data)
    assert levels.tolist() == [plain_level(data[i : i + W].tobytes()) for i in range(len(data) - W + 1)]
    h = -sum(c / W * math.log2(c / W) for c in Counter(data[:W].tobytes()).values())
    assert abs(math.log2(W) - (levels[0] << fp._SHIFT) / (W * fp._UNIT) - h) < 0.01
    assert fp.entropy_levels(np.zeros(40, np.uint8)).tolist() == [fp.LEVELS - 1] * (40 - W + 1) and not len(fp.entropy_levels(data[:10]))


@pytest.mark.parametrize("block", [1 << 18, 97])
def test_digests_equal_the_plain_version(monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    counts = fp.level_counts(pa.array(TEXTS))
    want = Counter(plain_level(t.encode()[i : i + W]) for t in TEXTS for i in range(len(t.encode()) - W + 1))
    assert {i: n for i, n in enumerate(counts.tolist()) if n} == want
    ranks = fp.ranks_of(counts)
    assert [str(d) for d in fp.digests(pa.array(TEXTS), ranks)] == [plain_digest(t.encode(), ranks) for t in TEXTS]
    assert [str(fp.digests(pa.array([t]), ranks)[0]) for t in TEXTS] == [plain_digest(t.encode(), ranks) for t in TEXTS]


def test_ranks_put_rare_levels_first_and_weak_ones_last():
    counts = np.full(fp.LEVELS, 50)
    counts[[3, 100]] = [7, 2]
    counts[-1] = 1
    ranks = fp.ranks_of(counts)
    assert (ranks[100], ranks[3]) == (0, 1) and ranks[-1] > ranks[200] and sorted(ranks) == list(range(fp.LEVELS))


def test_likeness(monkeypatch):
    ranks = fp.ranks_of(fp.level_counts(pa.array(TEXTS)))
    whole, half, other = text(10, 30000), text(10, 30000)[:15000] + text(11, 15000), text(12, 30000)
    a, b, c, e = fp.digests(pa.array([whole, half, other, ""]), ranks)
    assert len(a.filters) > 4 and fp.likeness(a, a) == 1 and fp.likeness(e, e) == 1 and fp.likeness(a, e) == 0
    assert 0.4 < fp.likeness(a, b) < 0.7 and fp.likeness(a, c) < 0.05
    for x in (a, b, c, e):
        again = fp.Digest.parse(str(x))
        assert str(again) == str(x) and fp.likeness(again, x) == 1
        assert all(fp.likeness(x, y) == fp.likeness(y, x) for y in (a, b, c, e))
    before = fp.likeness(a, b)
    monkeypatch.setattr(fp, "PAIRS", 3)
    assert fp.likeness(a, b) == before


def expected(rows, ranks):
    """Neighbours in the order of doc_id, where no two rows of one id differ."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (key, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        own, mark, following = (fp.digests(pa.array([x]), ranks)[0] for x in (t, edited, after))
        out.append((key, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(mark), fp.likeness(own, mark), fp.likeness(own, following)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_query_equals_the_plain_version(spark, parts):
    r = random.Random(parts)
    rows = [(3 * i, text(i, r.randint(0, 900))) for i in range(80)] + [(1, None), (4, ""), (7, "é"), (None, text(99, 800)), (100, text(5, 700)), (100, text(5, 700)), (2, text(5, 700))]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("part", "guest", "key", "fingerprint", "to", "tie")}).repartition(4)
    ranks = fp.rarity(docs)
    assert (ranks == fp.ranks_of(fp.level_counts(pa.array([t for _, t in rows])))).all()
    found = sorted(map(tuple, fp.compare_with_next(docs, ranks, parts=parts).collect()), key=repr)
    assert found == sorted(expected(rows, ranks), key=repr)


def test_one_document_none_and_other_columns(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    row = fp.op12_fingerprint(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and (row.n_chars, row.near_next) == (4, 1.0)
    assert fp.op12_fingerprint(one.limit(0)).count() == 0
    many = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id long, body string, fingerprint string")
    ranks = fp.rarity(many, text="body")
    marked = fp.fingerprint(many, ranks, text="body")
    assert marked.columns == ["id", "body", "fingerprint"]
    assert {r.id: r.fingerprint for r in marked.collect()} == {i: str(d) for i, d in enumerate(fp.digests(pa.array(TEXTS), ranks))}
