"""Step functions by their rules, and streams against tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import graph, lines, motion, search, stateful
from waymark.streaming import runs


def fold(kernel, rows):
    state, out = None, []
    for row in rows:
        state, told = kernel.step(state, row)
        out.append(told)
    return out


@pytest.fixture(scope="module")
def walk(spark):
    pick = random.Random(7)
    rows = [(k % 3, k, k * 37, pick.uniform(0, 360) if k % 11 else None, k % 4 > 0, pick.uniform(0, 0.6)) for k in range(300)]
    return spark.createDataFrame(rows, "session long, seq long, ms long, heading double, stable boolean, size double")


@pytest.mark.parametrize("kernel", [motion.HEADING, motion.STEP_PEAKS, motion.throttle(100, 5.0)], ids=["heading", "peaks", "throttle"])
def test_stream_gives_what_the_table_gives(spark, walk, kernel, tmp_path):
    table = stateful.replay(walk, "session", "seq", kernel)
    for k in range(3):  # three micro-batches, one after the other
        walk.where(f"seq >= {k * 100} and seq < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = runs.parquet_source(spark, str(tmp_path / "in"), files_each=1)
    got = runs.finish(stateful.stream(source, "session", "seq", kernel))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect()))
    assert got.count() == 300


def test_replay_is_the_fold_of_each_key(walk):
    got = {(r.session, r.seq): r.smooth for r in stateful.replay(walk, "session", "seq", motion.HEADING).collect()}
    for session in range(3):
        rows = sorted(tuple(r) for r in walk.where(F.col("session") == session).collect())
        want = fold(motion.HEADING, [(r[2], r[3], r[4]) for r in rows])
        assert [got[session, r[1]] for r in rows] == [w[0] for w in want]


def test_rows_without_key_go_and_empty_tables_stay_empty(spark, walk):
    assert stateful.replay(walk.where("false"), "session", "seq", motion.HEADING).count() == 0
    assert stateful.replay(walk.withColumn("session", F.lit(None).cast("long")), "session", "seq", motion.HEADING).count() == 0


def test_heading_takes_the_shorter_turn():
    out = fold(motion.HEADING, [(0, 350.0, True), (500, 10.0, True), (500, None, True)])
    assert 9 < out[1][0] < 10 and out[2] == out[1]


def test_stride_prefers_distance_then_cadence():
    out = fold(motion.STRIDE, [(10, 10, 7.0, None, None), (20, 10, 15.0, None, None), (30, 10, None, 2.0, 0.625), (40, 10, None, None, None), (50, 10, 40.0, None, None), (50, 0, 41.0, None, None)])
    assert [s for _, s in out] == ["distance", "distance", "cadence", "fixed", "fixed", "none"]
    assert out[0][0] == pytest.approx(0.7) and out[1][0] == pytest.approx(0.72)
    assert all(0.35 <= m <= 1.2 for m, _ in out)


def test_pedometer_drops_late_sessions():
    out = fold(motion.STEP_BATCHES, [(1, 5, True), (1, 9, True), (0, 50, True), (1, 12, True), (2, 4, True), (3, 7, False), (3, 2, True), (None, 3, True)])
    assert [m for (m,) in out] == [5, 4, None, 3, 4, 0, 0, None]


def test_direction_needs_three_distinct_steps():
    back = [(k, "reverse", 0.5) for k in (1, 2, 2, 3)]
    out = [d for (d,) in fold(motion.DIRECTION, [(0, "forward", 1.0), *back, (4, "forward", 0.5), (5, "reverse", 0.5), (6, "off", 0.0), (7, "forward", 0.7)])]
    assert out == ["forward", "reverse?", "reverse?", "reverse?", "reverse", "forward?", "reverse", "off", "forward?"]


def test_checkpoints_keep_their_distance():
    rows = [(5.0, 2, 4.0), (5.0, 2, 9.0), (0.0, 2, 12.0), (-90.0, 3, 14.0), (170.0, 2, 30.0), (1.0, 3, 40.0), (1.0, 2, 41.0)]
    assert [k for (k,) in fold(motion.CHECKPOINTS, rows)] == [None, "straight", None, "turn", None, None, "straight"]


def test_door_must_be_left_first():
    assert [r for r, _ in fold(motion.DOOR, [(3.0,), (None,), (16.0,), (15.0,)])] == [False, False, False, True]


def test_session_windows_close_at_the_gap(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(seconds=s)) for s in (0, 5, 14, 40, 41)] + [("b", start), ("b", start + datetime.timedelta(hours=1))]
    table = spark.createDataFrame(rows, "key string, at timestamp")
    got = {(r.key, r.samples) for r in runs.session_gaps(table, "key", "at", "15 seconds", "1 minute").collect()}
    assert got == {("a", 3), ("a", 2), ("b", 1)}
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = runs.parquet_source(spark, str(tmp_path / "in"))
    closed = runs.finish(runs.session_gaps(source, "key", "at", "15 seconds", "1 minute"))
    # the last run is still open when the source ends
    assert sorted((r.key, r.samples) for r in closed.collect()) == [("a", 2), ("a", 3), ("b", 1)]


def test_lift_routes_stand_and_passing_floors_cost_more(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 3), (4, 1), (5, 3)], "id long, floor int")
    way = "source long, target long, cost double, length double, mode string"
    stairs = [(0, 1, 1.0, 1.0, "escalator"), (1, 2, 10.0, 10.0, None), (2, 3, 1.0, 1.0, "escalator"), (0, 4, 14.0, 14.0, None), (4, 3, 1.0, 1.0, "escalator")]
    start = spark.createDataFrame([(0,)], "node long")
    by = lambda edges: {r.node: (r.cost, r.nodes) for r in graph.multi_floor_routes(spark.createDataFrame(edges, way), nodes, start).collect()}
    assert by(stairs)[3] == (15.0, [0, 4, 3])  # 12 over floor 2 counts as 17
    assert by([*stairs, (0, 3, 11.0, 11.0, "elevator")])[3] == (11.0, [0, 3])  # a lift that wins stands
    assert by([*stairs, (0, 3, 16.0, 16.0, "elevator")])[3] == (15.0, [0, 4, 3])
    assert by([*stairs[:3], (0, 3, 16.0, 16.0, "elevator")])[3] == (12.0, [0, 1, 2, 3])  # a lift brought in by the weights is refused


def test_snap_finds_the_nearest_edge_across_cells(spark):
    pick = random.Random(3)
    edges = [(k, *(pick.uniform(0, 100) for _ in range(4))) for k in range(40)] + [(99, 5.0, 5.0, 5.0, 5.0)]
    points = [(k, pick.uniform(-5, 105), pick.uniform(-5, 105)) for k in range(200)]

    def off(p, e):
        _, x1, y1, x2, y2 = e
        square = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = 0 if square == 0 else min(1, max(0, ((p[1] - x1) * (x2 - x1) + (p[2] - y1) * (y2 - y1)) / square))
        return ((p[1] - x1 - t * (x2 - x1)) ** 2 + (p[2] - y1 - t * (y2 - y1)) ** 2) ** 0.5

    want = {p[0]: min((off(p, e), e[0]) for e in edges)[1] for p in points if min(off(p, e) for e in edges) <= 4}
    got = lines.snap(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(edges, "edge int, x1 double, y1 double, x2 double, y2 double"), 4.0)
    assert {r.id: r.edge for r in got.collect()} == want


def test_suggestions(spark):
    names = spark.createDataFrame(list(enumerate(["스타벅스", "나이키 라이즈", "!!", None, "오설록", "나이키"])), "id long, name string")
    groups = search.name_groups(names)
    ask = lambda q: [(r.key, r.kind) for r in search.suggest(groups, q).collect()]
    assert ask("나이ㅋ") == [("나이키", 0), ("나이키라이즈", 0)]  # a syllable that is still being typed
    assert ask("ㅇㅅㄹ") == [("오설록", 1)]
    assert ask("라이") == [("나이키라이즈", 2)]
    assert ask("스타박스") == [("스타벅스", 3)]
    assert ask("ㅣㅋ") == [] and ask("") == [] and ask("?") == []
    assert search.siblings(search.suggest(groups, "나이"), "스타벅스").count() == 0


def test_reasons_without_text_do_not_count(spark):
    rows = spark.createDataFrame([("k", 1, "One. Two"), ("k", 2, "One. Three."), ("k", 3, " "), ("k", 4, None), ("m", 5, "One.")], "key string, id int, reason string")
    got = {r.id: (r.shared, r.own) for r in search.distinctive(rows, "key", "reason").collect()}
    assert got == {1: (["One."], "Two"), 2: (["One."], "Three."), 3: (["One."], None), 4: (["One."], None), 5: ([], "One.")}
