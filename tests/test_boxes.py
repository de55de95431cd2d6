"""Boxes around many rings."""

import time

from pyspark.sql import functions as F

from waymark.functions import geo


def test_smallest_boxes_of_many_rings_take_little_time(spark):
    corner = lambda x, y: F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    rings = spark.range(20000).select(F.array(corner(0, 0), corner(2, 2), corner(0, 4), corner(-2, 2)).alias("ring"))
    began = time.time()
    told = rings.select(geo.smallest_box(F.col("ring")).alias("b")).select(F.round("b.area", 6).alias("area"), F.round("b.width", 6).alias("width"), "b.angle").distinct().collect()
    assert [tuple(r) for r in told] == [(8.0, 2.828427, 45.0)]
    assert time.time() - began < 30


def test_rings_with_corners_that_are_not_told(spark):
    rings = spark.createDataFrame([(0, None), (1, []), (2, [(None, 1.0)]), (3, [(None, 1.0), (0.0, 0.0), (3.0, 0.0)]), (4, [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)])], "id int, ring array<struct<x: double, y: double>>")
    told = {r.id: tuple(r.b) for r in rings.select("id", geo.smallest_box(F.col("ring")).alias("b")).collect()}
    nothing = (None, 0.0, None, None)
    assert told == {0: nothing, 1: nothing, 2: nothing, 3: (0.0, 0.0, 3.0, 0.0), 4: (2.0, 0.0, 2.0, 1.0)}
