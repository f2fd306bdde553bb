"""Catalogs that are code, as table functions."""

from __future__ import annotations

import pytest

from sparkfold.functions.numbers import RATE_LIMIT_SCHEDULE
from sparkfold.operators import code_sources, match, resolve

PEOPLE = "path string, series string, issue string, issue_int long, year int, publisher string, pages int, volume int"


def make(name="letters", broken=(), ready=True):
    class Letters(code_sources.CodeSource):
        """Knows the series with one letter, in two volumes."""

        def configured(self):
            return ready

        def search(self, profile):
            if profile["series"] in broken:
                raise KeyError(profile["series"])
            if profile["series"] and len(profile["series"]) == 1:
                for v in range(2):
                    yield {"issue_id": ord(profile["series"]) * 10 + v, "series": profile["series"], "issue": profile["issue"], "year": 1990 + v, "volume": v}

    Letters.name = name
    return Letters()


@pytest.fixture(scope="module")
def people(spark):
    rows = [("p1", "a", "1", 1, 1990, None, None, None), ("p2", "b", "2", 2, 1991, None, None, None), ("p3", "long", "1", 1, 1990, None, None, None), ("p4", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, PEOPLE)


def test_candidates_and_failures(people):
    found = {(r.path, r.issue_id, r.error) for r in code_sources.search(people, make(broken=("b",))).collect()}
    assert found == {("p1", 970, None), ("p1", 971, None), ("p2", None, "KeyError: 'b'")}
    assert code_sources.search(people, make(ready=False)).count() == 0


def test_keys_and_sql(spark, people):
    with pytest.raises(ValueError, match="column path"):
        code_sources.search(people.drop("path"), make())
    spark.udtf.register("letters", code_sources.search_function(make(), people.schema["path"]))
    people.createOrReplaceTempView("people_of_letters")
    rows = spark.sql("SELECT path, issue_id FROM letters(TABLE(people_of_letters) PARTITION BY path) WHERE error IS NULL").collect()
    assert {tuple(r) for r in rows} == {("p1", 970), ("p1", 971), ("p2", 980), ("p2", 981)}


def test_in_turn_and_resolved(spark, people):
    found = code_sources.search_in_turn(people, [make("first", broken=("b",)), make("second")])
    assert {(r.path, r.source) for r in found.collect()} == {("p1", "first"), ("p2", "second")}
    done = {r.path: (r.resolution, r.source, r.issue_id) for r in resolve.run(people, code_sources.as_catalog(found), {}, match.Policy(margin=0.05)).collect()}
    assert done["p1"][1:] == ("first", 970) and done["p2"][1:] == ("second", 981) and done["p3"][0] == "NO_MATCH"


def test_failures_that_may_pass_are_tried_again():
    class Shaky(code_sources.CodeSource):
        def __init__(self, failures, status=None):
            self.left, self.status, self.waits = failures, status, []

        def wait(self, seconds):
            self.waits.append(seconds)

        def search(self, profile):
            yield {"issue_id": 1}
            if self.left:
                self.left -= 1
                problem = RuntimeError("Connection reset by peer" if self.status is None else "no")
                problem.status = self.status
                raise problem

    good = Shaky(3)
    assert code_sources.persistent(good, {}) == [{"issue_id": 1}] and good.waits == [2, 4, 8]
    limited = Shaky(5, 429)
    assert code_sources.persistent(limited, {}) == [{"issue_id": 1}] and limited.waits == list(RATE_LIMIT_SCHEDULE[:5])
    for shaky, waits in ((Shaky(99), 4), (Shaky(1, 404), 0)):
        with pytest.raises(RuntimeError):
            code_sources.persistent(shaky, {})
        assert len(shaky.waits) == waits
