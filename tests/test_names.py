"""The similarity join of names and the search that rests on it, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkfold.functions import similarity as S
from sparkfold.operators import names, resolve

WORDS = "spider man omnibus collection captain silence science amazing fantasy the lois lane x war of worlds 2099 tales".split()


def typo(r, name):
    i = r.randrange(len(name) + 1)
    return [name[:i] + r.choice("abcxyz 1") + name[i:], name[:i] + name[i + 1 :], name[:i] + r.choice("aeiou") + name[i + 1 :]][r.randrange(3)]


@pytest.fixture(scope="module")
def some_names():
    r = random.Random(1)
    base = [" ".join(["the"] * (r.random() < 0.6) + r.sample(WORDS, r.randint(1, 4))) for _ in range(130)]
    odd = ["", "a", "aa", "the", "ab", "é日本語", "x" * 70, "x" * 64, "xy" * 40, "spider man " * 9, "0"]
    return sorted({*base, *(typo(r, n) for n in base), *odd})


@pytest.mark.parametrize("threshold", [0.4, 0.7, 0.95, 1.0])
def test_join_equals_all_pairs(spark, some_names, threshold):
    left, right = some_names[::2], some_names[1::3] + some_names[::5]
    found = names.ratio_join(spark.createDataFrame([(n,) for n in [*left, *left[:9], None]], "a string").repartition(3), spark.createDataFrame([(n,) for n in right], "b string"), "a", "b", threshold)
    want = {(a, b): S.ratio(a, b) / 100 for a in set(left) - {""} for b in set(right) - {""}}
    rows = found.collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {(r.a, r.b): round(r.ratio, 12) for r in rows} == {k: round(v, 12) for k, v in want.items() if v >= threshold - 1e-9}


def test_many_subsequences_at_once(some_names):
    r = random.Random(2)
    pairs = [(r.choice(some_names), r.choice(some_names)) for _ in range(6000)] + [("a\0b", "ab"), ("x" * 65, "x" * 65), ("x" * 64, "x" * 100)]
    assert S.lcs_many([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [S.lcs(a, b) for a, b in pairs]


def test_contained_names(spark, some_names):
    found = names.contained_join(spark.createDataFrame([(n,) for n in some_names], "a string"), spark.createDataFrame([(n,) for n in some_names[::2]], "b string"), "a", "b")
    inside = lambda x, y: set(x.split(" ")) <= set(y.split(" "))
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in some_names if a for b in some_names[::2] if b and (inside(a, b) or inside(b, a))}


PEOPLE = "path string, series string, issue string, issue_int long, year int, publisher string, pages int, volume int"
OFFERS = "issue_id long, series string, issue string, year int, publisher string, pages int, volume long, aliases array<string>"


def test_no_candidate_is_lost(spark):
    """A frequent word beside a rare one, a typo, an alias, and a year in parentheses."""
    offers = [(i, "Spider-Man", "1", 1990, None, None, i, None) for i in range(101)] + [(500, "Omnibus Collection", "1", 1990, None, None, 1, None), (501, "Batman", "1", 1990, None, None, 2, None), (502, "Lois Lane (1986-1990)", "1", 1990, None, None, 3, None)]
    offers += [(503, "Shingeki no Kyojin", "1", 1990, None, None, 4, ["Attack on Titan", None, ""]), (504, "Adventures of Lois Lane and Friends", "1", 1990, None, None, 5, [])]
    people = [("omnibus", "Spider-Man Omnibus", "1", 1, 1990, None, None, None), ("typo", "Batmen", "1", 1, 1990, None, None, None), ("year", "Lois Lane", "1", 1, 1990, None, None, None), ("alias", "Attack on Titan", "1", 1, 1990, None, None, None), ("none", None, "1", 1, 1990, None, None, None)]
    people, offers = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(offers, OFFERS)

    def ids(effort):
        out = {}
        for r in resolve.candidates(people, offers, effort=effort).collect():
            out.setdefault(r.path, {})[r.c_issue_id] = r.s_series
        return out

    strict, usual, all_ = ids("minimal"), ids("balanced"), ids("thorough")
    assert set(strict["omnibus"]) == set(range(101)) and set(strict["typo"]) == {501} and set(strict["year"]) == {502} and set(strict["alias"]) == {503}
    assert strict["alias"][503] == 1.0 and strict["year"][502] >= 0.7
    plain = {i: "spider man" for i in range(101)} | {500: "omnibus collection", 501: "batman", 502: "lois lane", 503: "attack on titan", 504: "adventures of lois lane and friends"}
    assert set(usual["year"]) - {503} == {i for i, n in plain.items() if S.ratio("lois lane", n) >= 40} - {503} and {502, 504} <= set(usual["year"]) and (500 in usual["omnibus"]) == (S.ratio("spider man omnibus", "omnibus collection") >= 40) and set(strict["none"]) == set(usual["none"]) == {*range(101), 500, 501, 502, 503, 504}
    assert all(set(strict[p]) <= set(usual[p]) <= set(all_[p]) for p in strict) and 504 in all_["year"]


def test_candidates_equal_all_pairs(spark):
    r = random.Random(4)
    series = [" ".join(r.sample(WORDS, r.randint(1, 3))) for _ in range(60)]
    offers = [(i, r.choice(series), r.choice(["1", "2", "2.5", None]), 1990, None, None, i, [typo(r, r.choice(series))] if i % 3 == 0 else None) for i in range(300)]
    people = [(str(i), typo(r, r.choice(series)), r.choice(["1", "2", "02", None]), None, 1990, None, None, None) for i in range(60)]
    issue = lambda x: x and x.lstrip("0")
    for effort, limit in (("minimal", 0.7), ("balanced", 0.4)):
        found = {(x.path, x.c_issue_id): x.s_series for x in resolve.candidates(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(offers, OFFERS), effort=effort).collect()}
        norm = lambda n: " ".join(n.split())
        alike = {(p[0], o[0]) for p in people for o in offers if any(norm(n) and norm(p[1]) and S.ratio(norm(p[1]), norm(n)) >= 100 * limit - 1e-9 for n in [o[1], *(o[7] or [])]) and (not p[2] or not o[2] or issue(p[2]) == o[2])}
        assert set(found) == alike
        assert all(abs(s - max(S.weighted_ratio(norm(people[int(p)][1]), norm(n)) for n in [offers[i][1], *(offers[i][7] or [])]) / 100) < 1e-9 for (p, i), s in found.items())


def test_a_skewed_catalog(spark):
    """Thousands of first issues with one word in common: exactly those of a similar name are met."""
    catalog = spark.range(3000).selectExpr("id AS issue_id", "concat('The Series ', hex(id)) AS series", "'1' AS issue", "1990 AS year", "CAST(NULL AS string) AS publisher", "CAST(NULL AS int) AS pages", "id AS volume")
    people = spark.range(60, 3000, 60).selectExpr("CAST(id AS string) AS path", "concat('Series ', hex(id)) AS series", "'1' AS issue", "1L AS issue_int", "1990 AS year", "CAST(NULL AS string) AS publisher", "CAST(NULL AS int) AS pages", "CAST(NULL AS int) AS volume")
    pairs = {(int(r.path), r.c_issue_id) for r in resolve.candidates(people, catalog, effort="minimal").select("path", "c_issue_id").collect()}
    assert pairs == {(i, j) for i in range(60, 3000, 60) for j in range(3000) if S.ratio(f"series {i:x}", f"the series {j:x}") >= 70}
