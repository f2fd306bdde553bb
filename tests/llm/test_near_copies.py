"""The near copies of the test table, all of them by brute force, and what becomes of each."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkfold.llm import near_dup

SF = "/root/testdata/sf0.01"


def shingles(text: str) -> Counter:
    words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower()).split()
    return Counter(zip(*[words[i:] for i in range(5)], strict=False)) if len(words) >= 5 else Counter([tuple(words)])


def test_every_pair_of_the_contracts_similarity_is_joined(spark):
    """All pairs that share a shingle are compared: those of 0.8 or more share a class, and nothing else makes one.

    The copies below 0.8 are no duplicates by the contract; a tool that counts them as planted copies sees them missing.
    """
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    tables = {r.doc_id: shingles(r.text) for r in rows}
    holders, shared = defaultdict(list), Counter()
    for key, table in tables.items():
        for s in table:
            holders[s].append(key)
    for keys in holders.values():
        shared.update((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
    alike = {}
    for a, b in shared:
        x, y = tables[a], tables[b]
        alike[a, b] = (x & y).total() / (x | y).total()
    found = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    sure = {p: s for p, s in alike.items() if s >= 0.805}
    assert len(sure) > 20 and all(found[a] == found[b] for a, b in sure), [(p, s) for p, s in sure.items() if found[p[0]] != found[p[1]]]
    # a class is what pairs of about 0.8 or more connect
    parent = {k: k for k in tables}

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for (a, b), s in alike.items():
        if s >= 0.795:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    joined = defaultdict(set)
    for key, c in found.items():
        joined[c].add(root(key))
    assert all(len(roots) == 1 for roots in joined.values())
    below = {p: round(s, 3) for p, s in alike.items() if 0.5 <= s < 0.795 and root(p[0]) != root(p[1])}
    print(f"{len(sure)} pairs of 0.805 or more, all joined; {len(below)} pairs from 0.5 to 0.795 that nothing joins: {sorted(below.values())}")
    assert all(found[a] != found[b] for a, b in below)
