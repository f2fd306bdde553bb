"""The filter audit against DuckDB and against a plain simulation, on odd rows."""

from __future__ import annotations

import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkfold.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(120))
DOCS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (None, LONG, "en"), (4, "a b c", "en"), (5, "", "fr"), (6, None, "fr"), (7, "x " * 150, "de"),
    (8, "LOUD # " * 40, "de"), (8, "LOUD # " * 40, "de"), (9, "nbsp is\x1cno space\x0bbut this", None), (10, "\t\n \r", ""), (11, "É" * 9 + "A", "en"), (12, LONG + " #", "en"), (None, None, None),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (5, 1, None), (None, 1, 1), (8, 1, 1), (99, 1, 1)]


def simulate(docs, labels):
    """Every document walks through every order of the filters."""
    texts, rows = {}, []
    for key, text, _ in docs:
        if key is not None:
            texts.setdefault(text or "", set()).add(key)
    good, bad = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    for key, text, part in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = key is not None and any(k < key for k in texts.get(text, ()))
        rows.append((part or "", {f for f, x in fails.items() if x}, key in good, key in bad))
    out = {}
    for part in {r[0] for r in rows}:
        own, totals = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for i, f in enumerate(order):
                here = [r for r in own if not r[1] & set(order[:i])]
                gone = [r for r in here if f in r[1]]
                totals[f] += len(gone)
                out[part, order, i + 1] = [len(here) - len(gone), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(totals[order[step - 1]])
    return out


def as_dict(frame):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in frame.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    extra = {c: F.lit("kept") for c in ("id", "part", "mask", "words", "digest", "known", "at", "n", "good", "bad", "step", "filter_order", "failed")}
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumns(extra).repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumns(extra)


def test_odd_rows_equal_a_simulation(tables):
    assert as_dict(filter_audit.op11_filter_audit(*tables)) == simulate(DOCS, LABELS)


def test_zero_rows_and_sums(tables):
    rows = filter_audit.op11_filter_audit(*tables).collect()
    assert len(rows) == 600 * len({d[2] or "" for d in DOCS})
    assert all(r.kept >= 0 and r.removed + r.redundant >= r.unique_fails for r in rows)
    n = {p: sum((d[2] or "") == p for d in DOCS) for p in {d[2] or "" for d in DOCS}}
    assert all(r.kept + r.removed == n[r.part] for r in rows if r.step == 1)


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.op11_filter_audit(docs, labels).count() == 0


def test_other_filters(spark):
    """The windows take any filters; three of them have six orders."""
    cells = spark.createDataFrame([("p", 0b011, True, 5), ("p", 0b100, False, 2), ("p", 0, False, 7)], "part string, mask int, good boolean, n long")
    rows = {(r.filter_order, r.step): r for r in filter_audit.interactions(cells, "xyz", {"good": "good_lost"}).collect()}
    assert len(rows) == 18
    assert [rows["xyz", i].removed for i in (1, 2, 3)] == [5, 0, 2] and rows["xyz", 2].redundant == 5 and rows["xyz", 3].kept == 7
    assert rows["xyz", 1].shapley == 15 and rows["zyx", 1].shapley == 12 and rows["yxz", 1].good_lost == 5
    with pytest.raises(ValueError):
        filter_audit.interactions(cells, "xx", {})


def test_oracle_on_odd_rows(tables):
    known = [d for d in DOCS if d[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR); CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", known)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", [x for x in LABELS if x[0] is not None])
    found = con.sql("SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM (" + filter_audit.ORACLE + ")").fetchall()
    assert {tuple(r[:3]): list(r[3:]) for r in found} == simulate(known, LABELS)
