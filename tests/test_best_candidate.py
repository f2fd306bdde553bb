"""The best candidate of a profile without an order of all."""

from __future__ import annotations

import random

from sparkfold.operators import match as M
from sparkfold.plans import catalog

SF = "/root/testdata/sf0.001"


def test_the_best_candidate_is_that_of_all_ranks(spark):
    r = random.Random(3)
    rows = [(p, i, r.choice([None, 0.2, 0.5, 0.7, 0.7, 0.9]), r.choice([None, 1, 2])) for p in range(60) for i in range(r.randint(1, 6))]
    pairs = spark.createDataFrame(rows, "profile int, issue int, s double, volume int")
    ranked = M.viable(M.rank(pairs, "profile", "s", "volume", "issue"), "profile", "s", 0.5).where("place = 1").select("profile", "issue", "s", "gap", "viable", "solo")
    best = M.best(pairs, "profile", "s", "volume", "issue", 0.5)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, best.collect())) and best.columns == ranked.columns
    for name in ("m09_needs_hash", "m11_policies", "m12_resolution"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        window = max(i for i, x in enumerate(lines) if "Window" in x)
        assert any("Aggregate" in x for x in lines[window:])  # pairs are counted before anything is sorted
