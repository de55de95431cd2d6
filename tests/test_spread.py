"""Costly sessions are dealt to all tasks, however few bytes they have."""

from pyspark.sql import functions as F

from waymark.plans import tracking


def test_corridor_sessions_lie_in_many_tasks(spark):
    placed = tracking.corridor_places(spark, "/root/testdata/sf0.001").select("session", F.spark_partition_id().alias("task")).distinct()
    rows = placed.collect()
    assert len({r.session for r in rows}) == len(rows)
    assert len({r.task for r in rows}) > 2
