"""Sides of the registered zips."""

from quillon.plans import combined
from quillon.runtime import table

SF = "/root/testdata/sf0.001"


def test_sides_are_whole_and_no_task_takes_them_all(spark):
    keys = sorted(r.o_orderkey for r in table(spark, SF, "orders").select("o_orderkey").collect())
    for side, key in zip(combined._sides(spark, SF), ("early", "cheap"), strict=True):
        assert sorted(r[key] for r in side.collect()) == keys
        plan = side._jdf.queryExecution().toString()
        assert "Limit" not in plan and "TakeOrdered" not in plan
