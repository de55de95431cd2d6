import pytest

from waymark.functions import geo, text
from waymark.operators import graph, motion, sequences
from pyspark.sql import functions as F


def test_jump_filter_rules():
    def fold(rows):
        state, out = None, []
        for row in rows:
            state, told = motion.GPS_JUMP.step(state, row)
            out.append(told)
        return out

    jump = fold([(0, 0.0, 0.0, True), (1000, 500.0, 0.0, True), (2000, 1.0, 0.0, True), (60_000, 900.0, 0.0, True)])
    assert [a for a, _ in jump] == [True, False, True, True]  # a jump goes, a fix after a gap stays
    assert fold([(0, 0.0, 0.0, True)] + [(k * 1000, 400.0, 0.0, True) for k in range(1, 6)]) == [(True, False)] + [(False, False)] * 4 + [(True, True)]  # the fifth reject is taken
    assert fold([(0, 0.0, 0.0, True), (1000, 900.0, 0.0, True), (18_000, 900.0, 0.0, True)])[1:] == [(False, False), (True, True)]  # a gap does not hide that it gave in
    assert fold([(0, 0.0, 0.0, True), (1000, 900.0, 0.0, False), (1000, None, 0.0, True)])[1:] == [(True, False), (False, False)]


def test_places_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("v")).repartition(7)
    got = {r.k: r.place for r in sequences.numbered(rows, F.asc_nulls_last("v"), "k").collect()}
    want = sorted(((r.v is None, r.v or 0, r.k) for r in rows.collect()))
    assert got == {k: n for n, (_, _, k) in enumerate(want, 1)}
    assert sequences.numbered(rows.limit(0), "k").isEmpty()


def test_reach_takes_length_of_the_cheapest_path(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, 50.0), (1, 2, 1.0, 50.0), (0, 2, 5.0, 3.0)], "source long, target long, cost double, length double")
    out = graph.reach(edges, spark.createDataFrame([(0,)], "node long")).collect()
    assert {r.node: (r.cost, r.length) for r in out} == {0: (0, 0), 1: (1, 50), 2: (2, 100)}


def test_checked_edges_reject_dangling_ends(spark):
    nodes = spark.createDataFrame([(0,), (1,)], "id long")
    edges = spark.createDataFrame([(0, 7, 1.0, 1.0, True)], "source long, target long, cost double, length double, bidirectional boolean")
    with pytest.raises(ValueError):
        graph.checked_edges(edges, nodes)


def test_angles_keep_their_two_conventions(spark):
    row = spark.range(1).select(geo.turn_degrees(F.lit(0.0), F.lit(180.0)).alias("a"), geo.heading_delta(F.lit(0.0), F.lit(180.0)).alias("b"), geo.normalised_degrees(F.lit(-7.5)).alias("c")).first()
    assert (row.a, row.b, row.c) == (-180.0, 180.0, 352.5)


def test_short_rings_hold_nothing(spark):
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    row = spark.range(1).select(geo.in_polygon(F.lit(0.0), F.lit(0.0), ring).alias("a"), geo.polygon_area(ring).alias("b")).first()
    assert (row.a, row.b) == (False, 0.0)


def test_typo_in_a_letter(spark):
    row = spark.range(1).select(text.prefix_distance(text.jamo(F.lit("스타박")), text.jamo(F.lit("스타벅스"))).alias("d")).first()
    assert row.d == 1
