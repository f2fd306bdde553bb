"""Pre-tokens whose hashes collide, and very long ones, against the tokenizers library."""

from __future__ import annotations

import random
import resource

import numpy as np
import pyarrow as pa
import pytest

from sparkfold.llm import kernels, packing, token_count

PATH = token_count.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def thue_morse(flip: bool, n: int = 1024) -> str:
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_colliding_pretokens_keep_their_own_values(library):
    """Thue-Morse words collide under every polynomial modulo a power of two."""
    one, two = thue_morse(False), thue_morse(True)
    points = np.array([ord(c) for c in one + two], np.uint32)
    hashes = kernels.span_hashes(points, np.array([0, 1024]), np.array([1024, 2048]))
    assert hashes[0] == hashes[1]
    for texts in ([one, two, one], [two, one], [one + " " + two, "x"], [two, "y", two]):
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        counter, encoder = token_count.Counter(PATH), packing.Encoder(PATH)
        for _ in range(2):  # from the cache as well
            assert counter(pa.array(texts)).tolist() == [len(w) for w in want]
            assert [np.concatenate(chunks).tolist() for _, chunks in encoder(pa.array(texts))] == want
        assert counter(pa.array(texts[::-1])).tolist() == [len(w) for w in want[::-1]]


def test_every_hash_alike(library, monkeypatch):
    """Even if all hashes were equal, values would be right."""
    monkeypatch.setattr(kernels, "span_hashes", lambda points, starts, ends: (ends - starts).astype(np.uint64) % 3)
    r = random.Random(0)
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(40)) for _ in range(20)]
    counter, encoder = token_count.Counter(PATH), packing.Encoder(PATH)
    for part in (texts[:7], texts[5:], texts):
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert counter(pa.array(part)).tolist() == [len(w) for w in want]
        assert [np.concatenate(chunks).tolist() for _, chunks in encoder(pa.array(part))] == want


def test_a_full_cache_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_LIMIT", 5)
    counter = token_count.Counter(PATH)
    for t in ("one two three four five six seven", "eight nine ten one two", thue_morse(False) + " " + thue_morse(True), "one"):
        assert counter(pa.array([t])).tolist() == [len(library.encode(t, add_special_tokens=False).ids)]


def test_long_pretokens_in_arrays(library):
    merges = token_count.Merges(PATH)
    assert merges.table.rising
    r = random.Random(1)
    pieces = ["a" * 997, "ab" * 500, "the" * 300, "aab" * 333, thue_morse(False), "".join(r.choice("etaoinshr") for _ in range(5000)), "".join(r.choice("aé日") for _ in range(999)), "x", "xy", "Ünïcödé" * 50]
    pieces += ["".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(200)] + ["".join(r.choice("theranion") for _ in range(r.randint(1, 40))) for _ in range(300)]
    assert [merges.table.count(p.encode()) for p in pieces] == [merges.count(p.encode()) for p in pieces]
    text = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    assert merges.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids)


def test_an_unbroken_text_of_many_megabytes():
    """Three megabytes of letters stay well below what lists of Python objects would take (about 600 MB)."""
    r = np.random.default_rng(0)
    text = bytes(r.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()
    merges = token_count.Merges(PATH)
    assert merges.table.rising
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = merges.count(text.encode())
    assert 0 < n < len(text) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
