"""Corridor tracking: made walks, every branch by brute force, table and stream alike, odd rows."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import corridors as c
from waymark.operators import stateful
from waymark.streaming.runs import finish, parquet_source

#: Two rooms of corridors with a bridge: node: x, y; the line of an edge may bend.
NODES = {1: (0, 0), 2: (30, 0), 3: (30, 20), 4: (0, 20), 5: (60, 0), 6: (60, 20), 7: (30, 45)}
EDGES = [(12, 1, 2), (23, 2, 3), (34, 4, 3), (14, 1, 4), (25, 2, 5), (56, 5, 6), (36, 3, 6), (37, 3, 7)]


def edge_rows(both=True):
    out = []
    for k, a, b in EDGES:
        line = [NODES[a], NODES[b]]
        if k == 36:
            line.insert(1, (45, 24))
        out.append((0, k, a, b, both, False, [float(p[0]) for p in line], [float(p[1]) for p in line]))
    return out + [(0, 99, 2, 8, True, True, [30.0, 31.0], [0.0, 0.0])]


SCHEMA = "floor int, id long, source long, target long, both boolean, access boolean, xs array<double>, ys array<double>"
NET = c.Network(json.dumps([dict(zip(("floor", "id", "source", "target", "both", "access", "xs", "ys"), r, strict=True)) for r in edge_rows()]))


def made_walk(way, bias, noise, seed=1, stride=0.7, batch=3):
    """Rows of a walker along nodes, a step every 600 ms, confirmed in batches; headings are off by a bias and noise."""
    pick, true = random.Random(seed), []
    for a, b in zip(way, way[1:], strict=False):
        (ax, ay), (bx, by) = NODES[a], NODES[b]
        far = math.hypot(bx - ax, by - ay)
        true += [(c.bearing(bx - ax, by - ay), ax + (bx - ax) * k * stride / far, ay + (by - ay) * k * stride / far) for k in range(1, int(far / stride) + 1)]
    x, y = NODES[way[0]]
    rows, steps, metres, path = [], 0, 0.0, []
    for k, (heading, _, _) in enumerate(true):
        seen = heading + bias + pick.gauss(0, noise)
        x, y = x + stride * math.sin(math.radians(seen)), y + stride * math.cos(math.radians(seen))
        path.append((x, y))
        if len(path) == batch or k == len(true) - 1:
            steps, metres = steps + len(path), metres + stride * len(path)
            rows.append((len(rows), 600 * (k + 1), 0, steps, metres, x, y, seen % 360, [p[0] for p in path], [p[1] for p in path], None, None, [], [], [], None))
            path = []
    return rows, true[-1][1:]


COLUMNS = "seq long, ms long, floor int, steps long, metres double, x double, y double, heading double, xs array<double>, ys array<double>, origin_x double, origin_y double, peaks array<long>, peak_xs array<double>, peak_ys array<double>, through long"


def sessions(spark, walks):
    return spark.createDataFrame([(name, *row) for name, rows in walks.items() for row in rows], f"session string, {COLUMNS}")


def tracked(spark, walks, edges=None):
    floors = c.networks(spark.createDataFrame(edge_rows() if edges is None else edges, SCHEMA))
    return stateful.replay(c.with_network(sessions(spark, walks), floors, "session", "seq"), "session", "seq", c.CORRIDOR)


@pytest.mark.parametrize(("way", "bias"), [([1, 2, 5, 6, 3, 2, 1], 0), ([1, 2, 3, 4, 1], 12), ([4, 3, 7, 3, 2, 5], -12), ([5, 2, 1, 2, 5], 5)])
def test_made_walks_are_kept(spark, way, bias):
    rows, end = made_walk(way, bias, 6)
    start = [(-1, 0, 0, 0, 0.0, *map(float, NODES[way[0]]), rows[0][7], None, None, None, None, [], [], [], None)]
    table = sessions(spark, {"s": start + rows})
    out = tracked(spark, {"s": start + rows}).join(table.select("session", "seq", "ms", "metres"), ["session", "seq"])
    told = c.summary(out, "session", "seq", "ms", "metres").first()
    assert told["rows"] == len(rows) + 1 and 0.95 < told["retention"] < 1.1 and told["stall_s"] < 6
    last = out.orderBy(F.desc("seq")).first()
    assert math.hypot(last.at_x - end[0], last.at_y - end[1]) < 6


def every_way(steps, x, y):
    """Mean error and place of all ways of following the steps, without any pruning; written down as plain recursion."""

    def err(a, b):
        return abs((a - b + 180) % 360 - 180)

    def signed(a, b):
        return (a - b + 180) % 360 - 180

    def go(w, s, left, depth):
        edge = NET.edges[w["e"]]
        room = edge.length - w["m"] if w["s"] > 0 else w["m"]
        d = min(left, room)
        n = dict(w)
        if d > 1e-6:
            ahead = edge.heading(w["m"], w["s"])
            straight = err(s[0], ahead)
            bent = straight if w["p"] is None else err(signed(s[0], w["p"][0]), signed(ahead, w["p"][1]))
            n["m"] = min(edge.length, max(0, w["m"] + w["s"] * d))
            at = edge.at(n["m"])
            off = math.dist(at, s[2:])
            away = 10 * min(12, max(0, off - w["off"])) + 0.15 * min(12, max(0, off - 6))
            fade = math.exp(-d / 25)
            n |= {"c": w["c"] * fade + min(60, straight * 0.25 + bent * 0.75) * d + 0.5 * away * d, "k": w["k"] * fade + d, "p": (s[0], ahead), "off": off, "l": min(3.5, w["l"] + d) if straight > 60 else w["l"] * fade}
        if left <= 1e-6:
            yield w
            return
        if left <= room + 1e-6:
            yield n
            if depth == 0:
                here = err(s[0], edge.heading(n["m"], n["s"]))
                room = edge.length - n["m"] if n["s"] > 0 else n["m"]
                sides = [(edge.end(n["s"]), room)]
                if n["n"] == edge.end(-n["s"]):
                    sides.append((n["n"], edge.length - room))
                for node, far in sides:
                    skip = max(0, far - n["l"])
                    if 1e-6 < skip <= min(3.5, 0.4 * edge.length) and NET.decides(edge, node):
                        for o in NET.exits[node]:
                            if o.edge != n["e"] and skip <= min(3.5, 0.4 * NET.edges[o.edge].length) and err(s[0], o.heading) < here:
                                yield entered(n, o, node, s, 3 + 4 * skip, o.heading)
            return
        if depth >= 3:
            yield n | {"c": n["c"] + 90 * (left - d), "k": n["k"] + left - d}
            return
        for o in NET.exits[edge.end(w["s"])]:
            yield from go(entered(n, o, edge.end(w["s"]), s, 3, None), s, left - d, depth + 1)

    def entered(n, o, node, s, cost, heading):
        start = 0.0 if o.sign > 0 else NET.edges[o.edge].length
        return n | {"e": o.edge, "m": start, "s": o.sign, "c": n["c"] + cost, "n": node, "off": math.dist(NET.edges[o.edge].at(start), s[2:]), "l": 0.0, "p": n["p"] if heading is None else (n["p"][0], heading)}

    ways = [{"e": e, "m": m, "s": sign, "c": 0.0, "k": 0.0, "p": None, "off": 0.0, "n": None, "l": 0.0, "seed": far * 25} for far, e, m in NET.near(x, y) for sign in (1, -1)]
    for s in steps:
        after = []
        for w in ways:
            after += go(w, s, s[1], 0)
            if err(s[0], NET.edges[w["e"]].heading(w["m"], w["s"])) >= 115:
                after += go(w | {"s": -w["s"]}, s, s[1], 0)
        ways = after
    return sorted(((w["c"] + w["seed"]) / (w["k"] if w["k"] > 1e-6 else 1), w["e"], w["m"], w["s"]) for w in ways)


@pytest.mark.parametrize("seed", range(6))
def test_every_branch_against_brute_force(seed):
    pick = random.Random(seed)
    x, y = pick.choice([(28.0, 1.0), (31.0, 18.0), (1.0, 1.0)])
    steps, heading, px, py = [], pick.choice([0, 90, 180, 270]), x, y
    for _ in range(5):
        heading += pick.choice([0, 0, 90, -90, 180]) + pick.gauss(0, 10)
        far = pick.choice([0.7, 1.4, 2.1, 24.0])
        px, py = px + far * math.sin(math.radians(heading)), py + far * math.cos(math.radians(heading))
        steps.append((heading % 360, far, px, py))
    beam = c.seeds(NET, x, y)
    for s in steps:
        beam = c.advanced(NET, beam, c.Step(*s), 10**6, 1e-9)
    want = every_way(steps, x, y)
    best = {}
    for mean, e, m, sign in want:
        best.setdefault((e, sign, round(m, 6)), mean)
    got = {(g.edge, g.sign, round(g.metres, 6)): g.mean() for g in beam}
    assert got[beam[0].edge, beam[0].sign, round(beam[0].metres, 6)] == pytest.approx(want[0][0], abs=1e-9)
    # a merged guess may cost more later than one that was dropped for it, never less than the best
    assert got.keys() == best.keys() and all(got[k] >= best[k] - 1e-9 for k in got)


def test_the_beam_is_narrow_and_its_guesses_apart():
    beam = c.seeds(NET, 29.0, 1.0)
    pick = random.Random(4)
    for _ in range(60):
        beam = c.advanced(NET, beam, c.Step(pick.random() * 360, 0.9, 30 + pick.gauss(0, 5), pick.gauss(0, 5)))
        keys = [(g.edge, g.sign, math.floor(g.metres / 1.5 + 0.5)) for g in beam]
        assert 0 < len(beam) <= 24 and len(set(keys)) == len(keys)


def test_a_leader_is_held_by_a_margin():
    a, b = c.Guess(12, 10.0, 1, cost=20, matched=10), c.Guess(25, 10.0, 1, cost=5, matched=10)
    assert c._led(NET, [b, a], (12, 1))[1] == (12, 1)  # 0.5 against 2.0: within 2.5
    assert c._led(NET, [b._replace(cost=-10), a], (12, 1))[1] == (25, 1)
    near = a._replace(metres=29.0)  # at the junction a turn takes the lead by 0.5
    assert c._led(NET, [c.Guess(23, 0.5, 1, cost=5, matched=10), near], (12, 1))[1] == (23, 1)


def test_unconfirmed_steps_count_once(spark):
    rows, _ = made_walk([1, 2, 5], 0, 2, batch=4)
    plain = [list(r) for r in rows[:8]]
    for k, r in enumerate(plain):
        steps = list(zip(rows[k + 1][8], rows[k + 1][9], strict=True))
        r[10], r[11], r[12], r[13], r[14], r[15] = r[5], r[6], [r[1] + 100 * (i + 1) for i in range(len(steps))], [p[0] for p in steps], [p[1] for p in steps], r[1]
    again = [plain[0], *(r for row in plain[1:] for r in (row, [row[0] + 0.5, *row[1:]]))]
    again = [[k, *r[1:]] for k, r in enumerate(again)]
    out = {r.seq: r for r in tracked(spark, {"s": list(map(tuple, plain))}).collect()}
    twice = {r.seq: r for r in tracked(spark, {"s": list(map(tuple, again))}).collect()}
    for k in range(1, 8):  # a batch that comes again changes nothing of what is shown
        a, b, c2 = out[k], twice[2 * k - 1], twice[2 * k]
        assert (a.shown_edge, round(a.shown_progress, 6), round(a.lead, 6)) == (b.shown_edge, round(b.shown_progress, 6), round(b.lead, 6)) == (c2.shown_edge, round(c2.shown_progress, 6), round(c2.lead, 6))
    assert all(0 < out[k].lead < 4 for k in range(1, 8))


def test_nulls_missing_floors_and_empty_tables(spark):
    rows, _ = made_walk([1, 2], 0, 3)
    odd = [(k, None, 0, None, None, None, None, None, None, None, None, None, None, None, None, None) for k in (-2, 50)]
    lost = [(r[0], r[1], 7, *r[3:]) for r in rows[:3]]
    out = tracked(spark, {"s": odd + rows, "elsewhere": lost, "null": odd}).collect()
    assert len(out) == len(rows) + 2 + 3 + 2
    assert all(r.edge is None for r in out if r.session != "s" or r.seq in (-2, 50))
    assert all(r.edge is not None for r in out if r.session == "s" and r.seq not in (-2, 50))
    assert tracked(spark, {"s": rows}, []).where("edge is not null").count() == 0
    assert tracked(spark, {}).count() == 0
    assert c.summary(tracked(spark, {}).selectExpr("*", "0L as ms", "0D as metres"), "session", "seq", "ms", "metres").count() == 0


def test_table_and_stream_agree(spark, tmp_path):
    walks = {"a": made_walk([1, 2, 3, 4], 8, 5)[0], "b": made_walk([5, 2, 1], -5, 5, seed=3)[0]}
    table = sessions(spark, walks)
    want = sorted(tuple(r) for r in tracked(spark, walks).collect())
    for part in range(3):
        n = max(len(w) for w in walks.values()) // 3 + 1
        table.where((F.col("seq") >= part * n) & (F.col("seq") < (part + 1) * n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    floors = c.networks(spark.createDataFrame(edge_rows(), SCHEMA))
    rows = c.with_network(parquet_source(spark, str(tmp_path / "in"), 1), floors, "session", "seq")
    got = sorted(tuple(r) for r in finish(stateful.stream(rows, "session", "seq", c.CORRIDOR)).collect())
    assert got == want
