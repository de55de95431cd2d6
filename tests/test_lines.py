"""Points against long lines."""

import math
import random

import pytest

from waymark.operators import lines


def test_progress_against_all_segments(spark):
    """The nearest foot of all segments, for lines of any form and points at any distance, the window first."""
    rng = random.Random(5)
    form = {"scattered": lambda k: (rng.gauss(0, 10), rng.gauss(0, 10)), "flat": lambda k: (rng.uniform(0, 100), 0.0), "upright": lambda k: (3.0, k % 5.0), "corridor": lambda k: (rng.choice([0.0, 50.0]), rng.choice([0.0, 1.0])), "one": lambda k: (k * 10.0, k * 5.0)}
    vertices = [(line, k, *at(k)) for line, at in form.items() for k in range(2 if line == "one" else 50)]
    points = [(k, line, rng.gauss(0, far), rng.gauss(0, far), rng.choice([None, rng.uniform(-20, 900)])) for line in form for k, far in enumerate([1.0, 30.0, 1e3, 1e6] * 8)]
    segments = lines.line_segments(spark.createDataFrame(vertices, "line string, pos int, x double, y double")).cache()
    got = {(r.line, r.id): r for r in lines.progress(spark.createDataFrame(points, "id int, line string, x double, y double, previous double"), segments).collect()}
    assert len(got) == len(points)
    known = segments.collect()
    for id_, line, x, y, previous in points:
        feet = []
        for s in (s for s in known if s.line == line):
            t = min(1.0, max(0.0, ((x - s.x1) * (s.x2 - s.x1) + (y - s.y1) * (s.y2 - s.y1)) / s.length**2))
            at = s.before + t * s.length
            feet.append((previous is None or abs(at - previous) > 15, round(math.hypot(x - s.x1 - t * (s.x2 - s.x1), y - s.y1 - t * (s.y2 - s.y1)), 9), s.seg, at))
        far, offset, seg, at = min(feet)
        r = got[line, id_]
        assert (r.seg, r.reacquired) == (seg, previous is not None and far)
        assert r.offset == pytest.approx(offset, abs=1e-6) and r.travelled == pytest.approx(at, abs=1e-6)


def test_progress_makes_few_pairs(spark):
    """Points and segments meet where they are near, not line by line."""
    vertices = spark.range(20000).selectExpr("id % 2 as line", "id as pos", "(id * 7919 % 10007) / 100 as x", "(id * 104729 % 9973) / 100 as y")
    points = vertices.selectExpr("pos as id", "line", "x", "y", "cast(null as double) as previous")
    met = lines._nearest(points, lines.line_segments(vertices))
    assert met.select("id").distinct().count() == 20000
    assert met.count() < 4 * 20000
