"""The map matcher by cases, lines of routes, fixed-rate values and label order against plain loops."""

import json
import math
import random

import numpy as np
import pytest

from waymark.operators import corridors, matching, shapes, stateful

SQUARE = {1: (0, 0), 2: (10, 0), 3: (10, 10), 4: (0, 3), 5: (10, 3)}


def described(edges, at=SQUARE, both=True):
    return json.dumps([{"id": 10 * a + b, "source": a, "target": b, "both": both, "access": access, "xs": [float(at[a][0]), float(at[b][0])], "ys": [float(at[a][1]), float(at[b][1])], "penalty": None} for a, b, access in edges])


APART = described([(1, 2, False), (2, 3, False), (4, 5, False)])  # 45 is joined with nothing
JOINED = described([(1, 2, False), (1, 4, False), (4, 5, False)])


def matched(network, *points):
    state, out = None, []
    for x, y in points:
        state, told = matching.MATCH.step(state, (network, x, y))
        out.append(told)
    return out


def test_a_place_is_the_foot_on_the_nearest_corridor():
    (edge, metres, x, y, away, told, way, via), = matched(APART, (4, 1.2))
    assert (edge, metres, x, y, told, way, via) == (12, 4, 4, 0, "tracking", 0, None) and away == pytest.approx(1.2)


def test_turns_follow_the_graph_by_their_node():
    out = matched(APART, (8, 0.3), (10.2, 4))
    assert [o[0] for o in out] == [12, 23] and out[1][2:4] == (10, 4) and out[1][6:] == (6, 2)  # two metres, node 2, four metres


def test_small_shaking_and_unjoined_corridors_keep_the_edge():
    assert [o[0] for o in matched(APART, (2, 0.2), (4, 1.6))] == [12, 12]
    assert [o[0] for o in matched(APART, (4, 0.1), (4, 3))] == [12, 12]
    out = matched(APART, (1, 0.1), (2, 3), (3, 3), (4, 3), (5, 3))
    assert {o[0] for o in out} == {12} and {o[5] for o in out} == {"tracking"}


def test_access_edges_stand_back():
    at = {1: (0, 0), 2: (5, 0), 3: (10, 0), 4: (5, 2)}
    assert matched(described([(1, 2, False), (2, 3, False), (4, 2, True)], at), (5, 1.5))[0][0] != 42


def test_recovery_needs_three_samples_of_one_corridor():
    out = matched(JOINED, (1, 0.1), (2, 1.6), (3, 2.2), (4, 2.8), (5, 3))
    assert [o[5] for o in out] == ["tracking", "tracking", "suspect", "suspect", "recovered"]
    assert out[-1][0] == 45 and out[-1][2:4] == (5, 3) and out[-1][6] == pytest.approx(4 + 3 + 5)
    out = matched(JOINED, (1, 0.1), (2, 1.6), (3, 2.2), (4, 0.2), (5, 2.2))
    assert [o[5] for o in out][2:] == ["suspect", "tracking", "suspect"] and out[-1][0] == 12


def test_odd_rows_and_one_way_edges():
    assert matching.MATCH.step(None, (None, 1.0, 1.0)) == (None, (None,) * 8)
    assert matched("[]", (1, 1))[0] == (None,) * 8
    out = matched(APART, (None, 1.0), (4, 1.2), (5, None), (5, 1))
    assert [o[0] for o in out] == [None, 12, None, 12]
    net = matching.Streets(described([(1, 2, False), (2, 3, False)], both=False))
    assert net.between(1, 3) == 20 and net.between(3, 1) == math.inf


def test_ways_against_all_pairs():
    pick = random.Random(1)
    at = {k: (pick.uniform(0, 50), pick.uniform(0, 50)) for k in range(9)}
    pairs = {(a, b) for a in range(9) for b in range(a + 1, 9) if pick.random() < 0.3}
    net = matching.Streets(described([(a, b, False) for a, b in pairs], at))
    far = {(a, b): 0.0 if a == b else math.inf for a in range(9) for b in range(9)}
    for a, b in pairs:
        far[a, b] = far[b, a] = math.dist(at[a], at[b])
    for k in range(9):
        for a in range(9):
            for b in range(9):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    assert all(net.between(a, b) == pytest.approx(far[a, b]) for a in range(9) for b in range(9))


def test_the_matcher_over_a_table(spark):
    edges = spark.createDataFrame([(0, 12, 1, 2, True, False, [0.0, 10.0], [0.0, 0.0], 1.5), (0, 23, 2, 3, True, False, [10.0, 10.0], [0.0, 10.0], 0.0)], "floor int, id long, source long, target long, both boolean, access boolean, xs array<double>, ys array<double>, penalty double")
    rows = spark.createDataFrame([(s, k, 0, 8.0 + k, 0.3) for s in "ab" for k in range(3)], "session string, seq long, floor int, x double, y double")
    out = stateful.replay(corridors.with_network(rows, corridors.networks(edges), "session", "seq"), "session", "seq", matching.MATCH).collect()
    assert len(out) == 6 and {r.edge for r in out} == {12} and matching.Streets(corridors.networks(edges).first().network).penalty == {12: 1.5, 23: 0.0}


def test_route_lines_turn_and_join(spark):
    nodes = spark.createDataFrame([(k, float(10 * k), 0.0) for k in range(4)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 0, 1, 10.0, [0.0, 5.0, 10.0], [0.0, 1.0, 0.0]), (2, 2, 1, 11.0, [20.0, 15.0, 10.5], [0.0, 2.0, 0.0]), (3, 2, 3, 10.0, None, None)], "edge long, source long, target long, length double, xs array<double>, ys array<double>")
    path = [(1, 0, 1, 0, 1), (1, 1, 2, 1, 2), (1, 2, 3, 2, 3), (2, 0, 3, 3, 2), (3, 0, 1, 0, 2), (4, 0, 9, 0, 1), (5, 0, 2, 2, 1)]
    out = {r.route: r for r in shapes.route_line(spark.createDataFrame(path, "route long, nth long, edge long, source long, target long"), edges, nodes).collect()}
    # the joint at (10, 0) is no joint, as the second line ends beside it
    assert out[1].xs == [0, 5, 10, 10.5, 15, 20, 30] and out[1].ys == [0, 1, 0, 0, 2, 0, 0] and out[1].metres == 31
    assert out[2].xs == [30, 20] and out[3].xs is None and out[3].metres is None and out[4].xs is None and out[5].xs == [20, 15, 10.5]


@pytest.mark.parametrize("seed", range(3))
def test_fixed_rate_values_by_a_plain_loop(spark, seed):
    pick, rows = random.Random(seed), []
    for key in range(3):
        at = 0
        for _ in range(pick.choice([1, 2, 60])):
            at += pick.choice([3, 5, 7, 20, 39, 40, 41, 70])
            rows.append((key, at, pick.uniform(-1, 1), pick.uniform(-1, 1)))
    want = {}
    for key in range(3):
        own = sorted(r[1:] for r in rows if r[0] == key)
        start = own[-1][0] - 5 * 99
        for frame in range(100):
            target = start + 5 * frame
            after = next((i for i, s in enumerate(own) if s[0] >= target), None)
            if after:  # neither missing nor the first sample
                a, b = own[after - 1], own[after]
                share = (target - a[0]) / (b[0] - a[0])
                want[key, frame] = tuple(p + (q - p) * share for p, q in zip(a[1:], b[1:], strict=True)) if b[0] - a[0] <= 40 else (None, None)
    got = shapes.on_grid(spark.createDataFrame(rows, "key int, at long, v double, w double"), "key", "at", ["v", "w"], 5, 100, 40)
    found = {(r.key, r.frame): (r.v, r.w) for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == (None, None) if w == (None, None) else found[k] == pytest.approx(w) for k, w in want.items())


def plain_order(rows):
    """rows: id, x, y, area; every pick looks at all pairs."""
    most = max(r[3] for r in rows)
    across = math.hypot(max(r[1] for r in rows) - min(r[1] for r in rows), max(r[2] for r in rows) - min(r[2] for r in rows))
    picked = []
    while len(picked) < len(rows):
        def score(r):
            size = math.log(1 + r[3]) / math.log(1 + most) if most > 0 else 0.0
            if not picked:
                return size
            near = min(math.dist(r[1:3], p[1:3]) for p in picked) / across if across > 0 else 0.0
            return 0.72 * min(1.0, near) + 0.28 * size
        rest = sorted(r for r in rows if r not in picked)
        top = max(map(score, rest))
        picked.append(next(r for r in rest if score(r) >= top - 1e-12))
    return [p[0] for p in picked]


@pytest.mark.parametrize("seed", range(4))
def test_label_order_against_all_pairs(seed):
    pick = random.Random(seed)
    rows = [(k, float(pick.randrange(12)), float(pick.randrange(12)), float(pick.choice([0, 5, 50]))) for k in range(40)]
    ranks = shapes.placing_order(*(np.array(c) for c in zip(*rows, strict=True)))
    assert [rows[i][0] for i in np.argsort(ranks)] == plain_order(rows)


def test_label_priority_by_floor_with_odd_rows(spark):
    stores = [("1F", k, f"s{k}", 37.5 + k * 1e-5, 127.0, 10.0 * k) for k in range(5)] + [("2F", 9, "one", 37.5, 127.0, None), ("2F", 10, " ", 37.5, 127.0, 1.0), (None, 11, "x", 1.0, 1.0, 1.0), ("3F", 12, "y", None, 1.0, 1.0), ("4F", 13, "a", 37.5, 127.0, -1.0), ("4F", 14, "b", 37.5, 127.0, -1.0)]
    table = spark.createDataFrame(stores, "floor string, id long, name string, lat double, lon double, area double")
    out = {(r.floor, r.id): r.priority for r in shapes.label_priority(table).collect()}
    assert out["1F", 4] == 0 and out["1F", 0] + out["1F", 1] <= 5 and sorted(out[f, i] for f, i in out if f == "1F") == [0, 1, 2, 3, 4]
    assert out["2F", 9] == 0 and (out["4F", 13], out["4F", 14]) == (0, 1) and len(out) == 8
    assert shapes.label_priority(table.limit(0)).count() == 0
