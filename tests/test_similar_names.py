"""Names are compared before their rows meet."""

from __future__ import annotations

from sparkfold.plans import catalog

SF = "/root/testdata/sf0.001"


def test_names_are_compared_before_their_rows_meet(spark):
    plan = catalog.QUERIES["m02_p12_similar_names"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    compared = plan[plan.index("weighted_ratio_udf") :]
    assert "p_partkey" not in compared.split("weighted_ratio_udf")[1].split("Relation")[0]
