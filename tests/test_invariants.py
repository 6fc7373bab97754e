"""Relations that must hold between results."""

from pyspark.sql import functions as F

from innings.operators import career as C
from innings.plans.registry import entries
from innings.sources.adapter import deliveries, table


def test_every_ball_is_counted_once(spark, sf):
    balls = deliveries(spark, sf)
    n = table(spark, sf, "lineitem").count()
    assert C.h2h_records(balls).agg(F.sum("balls")).first()[0] == n
    assert C.intent_distribution(balls).agg(F.sum("n")).first()[0] == n


def test_scans_read_only_what_they_need(spark, sf):
    plan = entries()["h2h_records"].run(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_returnflag" not in plan and "l_shipdate" not in plan
    assert plan.count("FileScan") == 1


def test_ordinary_data_pays_nothing_for_hot_matches(spark, sf):
    """After adaptive execution the plan of a running sum is scan, exchange, window, exchange, window."""
    df = entries()["innings_progress"].run(spark, sf)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("Exchange hashpartitioning") == 2 and "Join" not in final
