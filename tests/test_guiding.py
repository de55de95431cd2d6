"""Guided walks by cases and timers, steps on routes by a plain loop, checkpoints with repeated steps."""

import random

import pytest

from waymark.operators import guiding as g
from waymark.operators import stateful
from waymark.streaming.runs import finish, parquet_source

FIELDS = "ms route travelled off on_edge again lost junction steps rerouting riding reverse board_m".split()


def row(ms, travelled=0.0, **more):
    base = {"ms": ms, "route": 1, "travelled": float(travelled), "off": 0.0, "on_edge": True, "again": False, "lost": False, "junction": False, "steps": ms // 500, "rerouting": False, "riding": False, "reverse": False, "board_m": None}
    return tuple((base | more)[f] for f in FIELDS)


def told(rows):
    """What each row and each timer says, in order."""
    state, out = None, []
    for r in rows:
        state, rung = g.GUIDE.rung(state, r[0])
        out += [("timer", t[-1]) for t in rung]
        state, say = g.GUIDE.step(state, r)
        out.append(dict(zip("shown hold evidence reroute gate held new_route timer".split(), say, strict=True)))
    return out


def test_weak_evidence_needs_three_updates_and_its_time():
    out = told([row(0), *(row(500 * k, k, on_edge=False, off=1.0) for k in range(1, 6))])
    assert [o["reroute"] for o in out] == [False, False, False, False, True, True]  # 3 updates by 1500, 1200 ms by 2000
    assert [o["hold"] for o in out[1:]] == ["deviation"] * 5 and {o["shown"] for o in out} == {0.0}


@pytest.mark.parametrize("more", [{"off": 5.0}, {"again": True}])
def test_strong_evidence_is_quicker(more):
    out = told([row(0), *(row(400 * k, k, steps=k, **more) for k in range(1, 4))])
    assert [o["reroute"] for o in out] == [False, False, False, True]  # 2 updates by 800, 700 ms by 1200


def test_only_steps_are_evidence():
    assert not any(o["reroute"] for o in told([row(0), *(row(500 * k, 0, on_edge=False, steps=4) for k in range(1, 12))]))
    assert not any(o["reroute"] for o in told([row(0), *(row(500 * k, k, on_edge=False, steps=None) for k in range(1, 12))]))


def test_what_ends_evidence():
    back = told([row(0), row(500, 1, on_edge=False), row(1000, 2, on_edge=False), row(1500, 3), row(2000, 3, on_edge=False)])
    assert [o["evidence"] for o in back] == [0, 1, 2, 0, 1]
    lost = told([row(0), row(500, 1, on_edge=False), row(1000, 2, on_edge=False, lost=True)])
    assert lost[-1]["evidence"] == 0
    assert not any(o["reroute"] for o in told([row(0), *(row(500 * k, k, off=9.0, rerouting=True) for k in range(1, 8))]))


def test_a_junction_excuses_for_four_seconds():
    out = told([row(0), *(row(500 * k, k, off=9.0, junction=True) for k in range(1, 14))])
    assert ("timer", "junction") in out and out.index(("timer", "junction")) == 9  # before the row of 4500
    rows = [o for o in out if isinstance(o, dict)]
    assert [k for k, o in enumerate(rows) if o["reroute"]][0] == 11  # 9 and 10 are the first updates, 700 ms later
    assert not any(o["evidence"] for o in rows[:9])


def test_jumps_and_going_back_are_held():
    out = told([row(0, 0, steps=0), row(500, 2, steps=1), row(1000, 20, steps=2), row(1500, 3, steps=3), row(2000, 0.5, steps=4), row(2500, 0.5, steps=5, reverse=True)])
    assert [o["hold"] for o in out] == [None, None, "jump", None, "back", None] and [o["shown"] for o in out] == [0, 2, 2, 3, 3, 0.5]


def test_boarding_gate():
    out = told([row(0, 0, board_m=20.0), row(500, 1, board_m=15.0), row(1000, 2, board_m=5.0), row(1500, 3, board_m=7.0), row(2000, 4, board_m=8.5), row(2500, 5, board_m=5.5), row(60_000, 6, board_m=5.5), row(60_500, 7, board_m=30.0), row(61_000, 8, board_m=4.0)])
    assert out.pop(6) == ("timer", "boarding")
    assert [o["gate"] for o in out] == [False, True, True, True, True, True, False, False, True]
    assert [o["held"] for o in out] == [False, False, True, True, False, True, False, False, True]
    assert [o["shown"] for o in out] == [0, 1, 1, 1, 4, 4, 6, 7, 7]
    near = told([row(0), *(row(500 * k, k, off=9.0, board_m=15.0) for k in range(1, 8))])
    assert not any(o["reroute"] for o in near)


def test_routes_change_and_end():
    out = told([row(0, 5), row(500, 30, route=2, steps=1), row(1000, 31, route=None), row(1500, 3, route=2, steps=3)])
    assert [(o["shown"], o["new_route"]) for o in out] == [(5, True), (30, True), (None, False), (3, True)]
    assert told([(None,) * 13])[0]["shown"] is None and told([row(0, riding=True)])[0]["shown"] is None


def test_table_and_stream_agree_timers_too(spark, tmp_path):
    rows = []
    for s in range(4):
        rows += [(s, k, *row(10**6 + 1000 * k + 37 * s, k, off=9.0 * (k > 4), junction=3 <= k < 9, board_m=5.0 if s == 3 and k > 8 else None)) for k in range(12)]
    rows += [(9, 0, *row(10**6 + 90_000, 0))]  # time goes on for all
    kinds = g.GUIDE.inputs
    table = spark.createDataFrame(rows, f"session long, seq long, {kinds}")
    want = stateful.replay(table, "session", "seq", g.GUIDE, 1000)
    timers = [(r.session, r.timer) for r in want.where("seq is null").collect()]
    assert sorted(timers) == sorted([(s, "junction") for s in range(4)] + [(3, "boarding")])
    for part in range(3):
        table.where(f"seq >= {4 * part} and seq < {4 * part + 4} and session < 9 or session = 9 and {part} = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = finish(stateful.stream(parquet_source(spark, str(tmp_path / "in"), 1), "session", "seq", g.GUIDE, 1000))
    known = {tuple(r) for r in want.collect()}
    assert {tuple(r) for r in got.collect()} == known and got.count() == len(known) == len(rows) + len(timers)


def test_relation_by_a_plain_loop(spark):
    pick = random.Random(8)
    lines = {e: (e, e + 1) for e in range(12)}
    routes = {1: [(e, e, e + 1) for e in range(8)], 2: [(e, e + 1, e) for e in reversed(range(3, 9))], 3: [(0, 0, 1), (5, 0, 9), (0, 1, 0)]}
    steps = []
    for k in range(200):
        moved = [(pick.randrange(11), round(pick.uniform(0, 5), 2), round(pick.uniform(0, 5), 2)) for _ in range(pick.randrange(4))]
        if moved and k % 4 == 0:
            moved.append(moved[0])
        steps.append((k, pick.choice([1, 2, 3, 4]), moved, [pick.randrange(12) for _ in range(pick.randrange(3))], k % 13 == 0))

    def plain(route, moved, crossed, relocated):
        if relocated:
            return 0.0, "relocated", []
        signed = 0.0
        for e, a, b in moved:
            way = next(((s, t) for x, s, t in routes.get(route, []) if x == e), None)
            if way is None or e not in lines:
                return signed, "off", []
            if way not in (lines[e], lines[e][::-1]):
                return signed, "ambiguous", []
            signed += (b - a) * (1 if way == lines[e] else -1)
        nodes = {n for _, s, t in routes.get(route, []) for n in (s, t)}
        return signed, "forward" if signed > 1e-6 else "reverse" if signed < -1e-6 else "ambiguous", [n for n in crossed if n in nodes]

    got = g.relation(
        spark.createDataFrame(steps, "step long, route long, moved array<struct<edge: long, from_m: double, to_m: double>>, crossed_nodes array<long>, relocated boolean"),
        spark.createDataFrame([(r, k, *w) for r, ways in routes.items() for k, w in enumerate(ways)], "route long, nth long, edge long, source long, target long"),
        spark.createDataFrame([(e, *ends) for e, ends in lines.items()], "edge long, source long, target long"),
        ["step"],
    )
    found = {r.step: (round(r.signed_m, 9), r.relation, r.crossed) for r in got.collect()}
    want = {k: plain(*rest) for k, *rest in steps}
    assert found == {k: (round(m, 9), told, crossed) for k, (m, told, crossed) in want.items()}


CHECK = "peak route relation direction signed_m crossed nodes kinds outs metres edge on_route lost unsure rerouting".split()


def walk(rows):
    state, out = None, []
    for r in rows:
        base = {"peak": None, "route": 1, "relation": "forward", "direction": "forward", "signed_m": 0.7, "crossed": [], "nodes": [3, 5], "kinds": ["turn", "straight"], "outs": [34, 56], "metres": [0.5, 0.5], "edge": 34, "on_route": True, "lost": False, "unsure": False, "rerouting": False} | r
        state, told = g.CHECKPOINT.step(state, tuple(base[c] for c in CHECK))
        out.append(told)
    return out


def test_a_turn_is_committed_by_three_steps_behind_it():
    rows = [{"peak": 1, "edge": 23}, {"peak": 2, "crossed": [3]}, {"peak": 3}, {"peak": 4}, {"peak": 5, "crossed": [5]}]
    assert [t[:3] for t in walk(rows)] == [(None,) * 3, (3, "candidate", "steps to come"), (None,) * 3, (3, "commit", "steps"), (5, "commit", "steps")]


def test_repeated_steps_change_nothing():
    rows = [{"peak": 1, "edge": 23}, {"peak": 2, "crossed": [3]}, {"peak": 3}, {"peak": 4}, {"peak": 5, "crossed": [5]}]
    twice = walk([r for x in rows for r in (x, x)] + rows)
    assert [t for t in twice if t[1]] == [t for t in walk(rows) if t[1]] and twice[-1][3] == 2


def test_disputes_and_rejects():
    last = lambda *rows: walk(rows)[-1][1:3]
    assert last({"peak": 2, "crossed": [3], "metres": [1.6, 0]}) == ("dispute", "too far")
    assert last({"peak": 2, "crossed": [3]}, {"peak": 3, "edge": 99}) == ("reject", "another way")
    assert last({"peak": 2, "crossed": [3], "relation": "reverse"}) == ("reject", "not forward")
    assert last({"peak": 2, "crossed": [3], "direction": "reverse"}) == ("reject", "direction not forward")
    for what, why in (("lost", "lost"), ("unsure", "ambiguous"), ("rerouting", "routing anew")):
        assert last({"peak": 2, "crossed": [3], what: True}) == ("reject", why)
    assert last({"peak": 2, "crossed": [3], "on_route": False}) == ("reject", "off the route")
    straight = {"nodes": [5], "kinds": ["straight"], "outs": [56]}
    assert last({"peak": 2, "crossed": [5], **straight}) == ("reject", "too few steps")
    assert last({"peak": 2, "crossed": [3]}, {"peak": 3, "relation": "off"}, {"peak": 4}, {"peak": 5}) == (None, None)  # evidence was cleared
    assert walk([{"peak": None}, {"peak": 1, "nodes": None, "kinds": None, "outs": None, "metres": None}])[-1] == (None, None, None, 0)
