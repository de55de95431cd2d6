"""Rides by cases: what lands, what is cancelled and why; the join of near boarding points; table and stream alike."""

import random

import pytest

from waymark.operators import escalators as e
from waymark.operators import stateful
from waymark.streaming.runs import finish, parquet_source

FLOORS = ["6F", "5F", "4F", "3F", "2F", "1F", "B1"]
UP, DOWN = (1, "ES1", True, "3F"), (2, "ES1", False, "1F")


class Walker:
    """Rows of a session, a sample about each second."""

    def __init__(self, floor="2F", every=1069, grain=0.0):
        self.ms, self.steps, self.floor, self.every, self.grain, self.rows = 1_000_000, 40, floor, every, grain, []

    def row(self, near=(), route=None, altitude=None, moved=0, stepped=0):
        boards = [list(x) for x in zip(*((b[0], b[1], b[2], b[3], m) for b, m in near), strict=True)] if near else [[]] * 5
        path = (None,) * 7 if route is None else (float(route[0]), *route[1], route[2], route[3])
        self.rows.append((self.ms, self.floor, FLOORS, self.steps, moved, stepped, *boards, *path, None if altitude is None else float(altitude)))
        return self

    def near(self, board=UP, metres=0.7):
        return self.row([(board, metres)])

    def route(self, *metres, board=UP, arrival=31, at_once=False):
        for m in metres:
            self.steps, self.ms = self.steps + 2, self.ms + 700
            self.row(route=(m, board, arrival, at_once))
        return self

    def ramp(self, start, end, seconds, moved=0, stepped=0, stay=()):
        n = round(seconds * 1000 / self.every)
        for k in range(1, n + 1):
            self.ms += self.every
            level = start + (end - start) * k / n
            self.row(stay, altitude=round(level / self.grain) * self.grain if self.grain else level, moved=moved, stepped=stepped)
        return self

    def hold(self, at, seconds, **more):
        return self.ramp(at, at, seconds, **more)

    def told(self):
        state, out = None, []
        for row in self.rows:
            state, told = e.RIDE.step(state, row)
            out.append(told)
        self.state = state
        return out

    def changes(self):
        return [c for told in self.told() for c in told[0]]


def test_one_floor_up():
    told = Walker().hold(0, 5).near().ramp(0, 4.5, 20).hold(4.5, 5).told()
    landed = [t for t in told if any(c.startswith("landed") for c in t[0])]
    assert len(landed) == 1 and landed[0][1:5] == ("3F", "ES1", 1, None) and landed[0][7:9] == ("seen", 0) and abs(landed[0][5] - 4.5) < 0.5


def test_landing_waits_for_the_end_and_half_way_is_told_before():
    w = Walker().hold(0, 5).near().ramp(0, 3.2, 12)
    assert [c for c in w.changes() if c[:6] in ("midway", "landed")] == ["midway: up"]
    assert w.hold(3.2, 5).changes()[-1] == "landed: up"


@pytest.mark.parametrize(("every", "grain"), [(180, 0.0), (1069, 0.0), (200, 0.085)])
def test_sample_rates_and_coarse_pressure(every, grain):
    w = Walker(every=every, grain=grain).hold(0, 6).near(DOWN).ramp(0, -4.6, 22).hold(-4.6, 8)
    assert [c for c in w.changes() if c.startswith("landed")] == ["landed: down"] and w.state.landed_on == "1F"


def test_two_floors_in_a_row():
    w = Walker().hold(0, 5).near().ramp(0, 4.5, 20).hold(4.5, 6)
    w.floor = "3F"
    w.near((7, "ES1", True, "4F")).ramp(4.5, 9.0, 20).hold(9.0, 6)
    assert [c for c in w.changes() if c.startswith("landed")] == ["landed: up"] * 2


def test_a_step_lands_at_once_and_the_rest_of_a_ride_is_no_floor():
    quiet = Walker().hold(0, 5).near().ramp(0, 4.5, 20).hold(4.5, 5)
    step = Walker().hold(0, 5).near().ramp(0, 4.5, 20).hold(4.5, 5, stepped=1)
    at = lambda w: next(k for k, t in enumerate(w.told()) if any(c.startswith("landed") for c in t[0]))
    assert at(step) < at(quiet)
    assert [c for c in step.hold(4.9, 30).changes() if c.startswith("landed")] == ["landed: up"]


def test_boarding_by_route():
    w = Walker().hold(0, 5).route(12, 9, 6, 4, 2.5)
    assert w.changes() == ["boarding: route"]
    assert w.route(20).changes() == ["boarding: route", "cancelled: moved away"]
    assert Walker().hold(0, 5).route(2.5).changes() == []  # one frame near is not enough
    assert Walker().hold(0, 5).route(9, 6, 4).changes() == []
    assert Walker().hold(0, 5).route(6, 4, 2.5, board=(3, "X", True, "9F")).changes() == []  # no such floor
    stalled = Walker().hold(0, 5).route(6, 4, 2.5).hold(0, 45)
    assert stalled.changes() == ["boarding: route", "cancelled: no vertical motion"]


def test_vertical_motion_at_the_boarding_point_comes_before_half_way():
    told = Walker().hold(0, 5).route(6, 4, 2.5).ramp(0, 4.5, 20).hold(4.5, 5).changes()
    assert [c.split(":")[0] for c in told] == ["boarding", "rising", "midway", "landed"]
    first = lambda w: next(k for k, t in enumerate(w.told()) if any(c.startswith("rising") for c in t[0]))
    assert first(Walker().hold(0, 5).route(6, 4, 2.5, at_once=True).ramp(0, 4.5, 20)) <= first(Walker().hold(0, 5).route(6, 4, 2.5).ramp(0, 4.5, 20))


def test_vertical_motion_without_a_boarding_point_needs_altitude_and_motion():
    moving, still = Walker().hold(0, 8).ramp(0, 3, 8, moved=1), Walker().hold(0, 8).ramp(0, 3, 8)
    assert moving.changes() == ["rising: up by altitude"] and still.changes() == []
    assert moving.hold(3, 6).changes()[-1] == "cancelled: vertical motion ended"


def test_the_routes_boarding_point_goes_before_a_nearer_one():
    other = (9, "ES2", True, "3F")
    w = Walker().hold(0, 5).row([(other, 0.5), (UP, 2.0)]).ramp(0, 4.5, 20).hold(4.5, 5)
    assert [t[3] for t in w.told() if t[7]] == [9]
    w = Walker().hold(0, 5).row([(other, 0.5), (UP, 2.0)]).route(12, 11).ramp(0, 4.5, 20).hold(4.5, 5)
    landed = [t for t in w.told() if t[7]]
    assert [(t[3], t[4], t[7]) for t in landed] == [(1, 31, "route and seen")]


def test_cancelled_rides():
    reasons = lambda w: [c for c in w.changes() if c.startswith("cancelled")]
    assert reasons(Walker().hold(0, 5).near().ramp(0, 1.9, 8).ramp(1.9, 0, 8)) [-1:] == ["cancelled: went back"]
    assert "cancelled: several floors" in reasons(Walker().hold(0, 5).near().ramp(0, 12, 40))
    assert "cancelled: no boarding point" in reasons(Walker().hold(0, 5).near(DOWN).ramp(0, 4.5, 20))
    assert "cancelled: unknown floor" in reasons(Walker().hold(0, 5).near((3, "X", True, "9F")).ramp(0, 4.5, 20))


def test_far_from_escalators_nothing_lands():
    assert Walker().hold(0, 5).row([(UP, 6.5)]).ramp(0, 4.5, 20).hold(4.5, 5).changes() == []
    assert Walker().hold(0, 5).ramp(0, 2.0, 3600).changes() == []  # weather
    assert not any(c.startswith("landed") for c in Walker().hold(0, 5).route(17).ramp(0, 4.5, 20).hold(4.5, 5).changes())


def test_another_floor_and_silence_begin_anew():
    w = Walker().hold(0, 5).route(6, 4, 2.5)
    w.floor = "5F"
    w.hold(0, 3)
    assert w.changes()[-1] == "cancelled: floor changed" and not w.state.near
    w = Walker().hold(0, 5).near()
    w.ms += 16_000
    w.hold(4.5, 2)
    w.told()
    assert w.state.base is None and len(w.state.window) == 2


def test_odd_rows():
    nothing = (None,) * 19
    w = Walker()
    w.rows = [nothing, (5, *nothing[1:])]
    assert w.changes() == []
    w.rows = [nothing, *Walker().hold(0, 5).near().ramp(0, 4.5, 20).hold(4.5, 5).rows, nothing]
    assert [c for c in w.changes() if c.startswith("landed")] == ["landed: up"]


SCHEMA = "session long, seq long, " + e.RIDE.inputs


def test_table_and_stream_agree(spark, tmp_path):
    pick, rows = random.Random(5), []
    for session in range(4):
        w = Walker(every=pick.choice([180, 500, 1069])).hold(0, 6).route(9, 6, 4, 2.5).near().ramp(0, 4.5, 18 + session).hold(4.5, 8, stepped=session % 2)
        rows += [(session, k, *r) for k, r in enumerate(w.rows)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in stateful.replay(table, "session", "seq", e.RIDE).collect())
    assert e.rides(stateful.replay(table, "session", "seq", e.RIDE), "session", "seq").count() == 4
    for part in range(3):
        table.where(f"seq >= {part * 40} and (seq < {part * 40 + 40} or {part} = 2)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = parquet_source(spark, str(tmp_path / "in"), 1)
    assert sorted(tuple(r) for r in finish(stateful.stream(source, "session", "seq", e.RIDE)).collect()) == want


def test_near_boarding_points_by_brute_force(spark):
    pick = random.Random(2)
    boards = [(pick.randrange(2), pick.choice(["1F", "2F"]), k, f"b{k}", k % 2 == 0, "3F", pick.uniform(-20, 20), pick.uniform(-20, 20)) for k in range(60)]
    samples = [(k, pick.randrange(2), pick.choice(["1F", "2F"]), pick.uniform(-20, 20), pick.uniform(-20, 20)) for k in range(80)] + [(90, 0, "1F", None, 1.0), (91, 7, "1F", 0.0, 0.0)]
    got = e.near_boarding(spark.createDataFrame(samples, "seq long, building int, floor string, x double, y double"), spark.createDataFrame(boards, "building int, floor string, id long, bank string, up boolean, to_floor string, x double, y double"), ["seq"])
    found = {r.seq: list(zip(r.near_ids or [], r.near_banks or [], r.near_ups or [], strict=True)) for r in got.collect()}
    for seq, building, floor, x, y in samples:
        near = [] if x is None else sorted((((x - b[6]) ** 2 + (y - b[7]) ** 2) ** 0.5, b[2], b[3], b[4]) for b in boards if b[:2] == (building, floor))
        assert found[seq] == [n[1:] for n in near if n[0] <= 6]
