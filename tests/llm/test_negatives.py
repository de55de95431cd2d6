"""Hard negatives against brute force: small lists and parts, ties, copies, odd lengths, large components."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string, list int, part int, block int, v string, anchor string"


def plain(rows, scale, relabel):
    """rows: id, label, vector; products of Python's whole numbers."""
    taken = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, relabel(i, label), [math.floor(scale * float(x)) for x in v]))
    out = []
    for i, label, q in taken:
        if i % 4:
            continue
        score = [(-sum(a * b for a, b in zip(q, v, strict=False)), j, other) for j, other, v in taken]
        positives = sorted((s, j) for s, j, other in score if other == label and j != i)[:5]
        for ps, p in positives:
            fits = sorted((s, j) for s, j, other in score if other != label and 80 * ps >= 100 * s >= 100 * ps)[:5]
            out += [(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


def as_float(x):
    import numpy as np

    return None if x is None else float(np.float32(x))


def run(spark, rows, scale=256, relabel=lambda i, label: label, **more):
    table = spark.createDataFrame([(i, label, v, "x", 1, 2, 3, "y", "z") for i, label, v in rows], SCHEMA).repartition(3)
    taken = negatives.whole_vectors(table, scale, F.col("label"))
    got = negatives.hard_negatives(taken, F.col("id") % 4 == 0, **more)
    return sorted(tuple(r) for r in got.collect())


def random_rows(seed, n, dims=6, labels=3):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = pick.choice(centres)
        rows.append((i, pick.randrange(labels), [as_float(x + pick.gauss(0, 0.3)) for x in c]))
    return rows


@pytest.mark.parametrize(("seed", "more"), [(1, {}), (2, {"lists": 7, "part_rows": 5, "sample": 30, "waves": (1, 2, None), "block": 3})])
def test_against_brute_force(spark, seed, more):
    rows = random_rows(seed, 150)
    rows += [(200 + k, k % 3, rows[0][2]) for k in range(25)]  # copies: ties by id
    rows += [(300, None, rows[1][2]), (301, 1, None), (304, 1, [1.0, None]), (308, 0, [float("nan")]), (312, 0, [float("inf"), 1.0]), (None, 1, rows[2][2])]
    rows += [(316, 1, []), (320, 2, [3.0]), (321, 2, [as_float(0.1 * k) for k in range(40)]), (324, 1, [as_float(0.1 * k) for k in range(50)]), (328, 9, [0.0] * 6)]
    assert run(spark, rows, **more) == plain(rows, 256, lambda i, label: label)


def test_products_past_doubles_are_exact(spark):
    rows = [(0, 1, [1e6, 3e6]), (1, 1, [1e6, 3e6]), (4, 2, [1e6, 3e6 - 1]), (5, 2, [1e6 - 1, 3e6]), (6, 2, [1e6, 3e6])]
    rows = [(i, label, [as_float(x) for x in v]) for i, label, v in rows]
    got = run(spark, rows, scale=100)
    assert got == plain(rows, 100, lambda i, label: label) and max(r[4] for r in got) > 2**53


def test_products_past_a_long_are_cut(spark):
    rows = [(0, 1, [3e18]), (1, 1, [3e18]), (2, 2, [3e18]), (3, 2, [2.7e18])]
    got = run(spark, rows, scale=1)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(0, 1, 1, 2), (0, 1, 2, 3)] and {r[5] for r in got} == {2**63 - 1}


def test_repeated_rows_and_empty_tables(spark):
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.9])]
    got = run(spark, rows)
    assert got == plain(rows, 256, lambda i, label: label) and len(got) == 4
    assert run(spark, []) == [] and run(spark, [(0, 1, [1.0])]) == [] and run(spark, [(1, 1, [1.0])]) == []


def test_bounds_leave_lists_out(spark):
    """Far clusters are not visited once the k-th score is known."""
    pick = random.Random(9)
    rows = [(i, i % 2, [as_float((i % 20) * 10 + pick.random()), as_float(300 - (i % 20) * 10 + pick.random())]) for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, label long, v array<double>").cache()
    index = negatives.InvertedLists.build(table, lists=40)
    asking = table.where("id % 100 = 0").selectExpr("id as anchor", "id as anchor_id", "label", "v", "0 as block", "cast(60000 as double) as least", "double('inf') as most")
    visits = asking.mapInArrow(negatives._bounded(index.centroids, index.radii, 0, None), "anchor long, anchor_id long, label long, v array<double>, block int, least double, most double, list int")
    some, every = visits.count(), asking.count() * len(index.centroids)
    assert 0 < some < every
    close = asking.withColumn("least", F.lit(20.0)).withColumn("most", F.lit(30.0))
    none = close.mapInArrow(negatives._bounded(index.centroids, index.radii, 0, None), "anchor long, anchor_id long, label long, v array<double>, block int, least double, most double, list int")
    assert none.count() < some
