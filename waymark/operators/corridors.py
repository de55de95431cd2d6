"""Positions kept on corridors: a beam of guesses over a floor's walking graph, as keyed state.

A guess is a place on an edge with a direction and what it has cost so far.  Each
measured step moves every guess along the graph; where a node is passed or near,
guesses branch.  Guesses of one edge, direction and stretch are one, the best
stay, and a leader is replaced only by a margin.  A second beam follows steps that
are not confirmed yet, each once by its id, and is set back only when the first
cannot explain it.

Spark brings the graph to the sessions: ``networks`` makes one row a floor, which
is joined to the first sample of each session (or to every sample of a stream).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.stateful import Kernel

# Beam width; metres of a stretch; cost of passing a node, of a metre past a dead end; degrees from which a reversal is tried.
WIDTH, STRETCH_M, PASS_COST, DEAD_END_COST, REVERSE_DEG = 24, 1.5, 3.0, 90.0, 115.0
# Share of the absolute error, most error of a step, metres after which cost is forgotten; radius and cost a metre of first guesses.
ABSOLUTE, MOST_DEG, HORIZON_M, SEED_M, SEED_COST = 0.25, 60.0, 25.0, 5.0, 25.0
# Cost a metre of standing off the measured position, what is tolerated, the most that counts, and the weights of growth and of the rest.
OFF_COST, OFF_FREE_M, OFF_MOST_M, OFF_GROWTH, OFF_REST = 0.5, 6.0, 12.0, 10.0, 0.15
# Margins in degrees for a new leader, at a junction too, and for an ambiguous place.
LEAD_DEG, LEAD_JUNCTION_DEG, AMBIGUOUS_DEG = 2.5, 0.5, 6.0
# Correction of the heading a step, its limit, the error past which none is made; nodes passed in a step.
BIAS_STEP_DEG, BIAS_MOST_DEG, BIAS_ERROR_DEG, PASSES = 0.75, 60.0, 50.0, 3
# A junction's reach in metres and as a share of an edge, its cost a metre, the turn that makes one, the error that counts as off the edge.
REACH_M, REACH_SHARE, SKIP_COST, TURN_DEG, OFF_EDGE_DEG = 3.5, 0.4, 4.0, 20.0, 60.0
# Ids of steps that are remembered, slack of a lead in metres, jump that is no walk.
REMEMBERED, LEAD_SLACK_M, JUMP_M = 512, 2.0, 0.5
TINY = 1e-6


def turn(a: float, b: float) -> float:
    """The signed way from b to a in degrees, in [-180, 180)."""
    return (a - b + 180.0) % 360.0 - 180.0


def bearing(dx: float, dy: float) -> float:
    return math.degrees(math.atan2(dx, dy)) % 360.0


class Exit(NamedTuple):
    """A way out of a node: the edge, the direction on it, and where it heads."""

    edge: int
    sign: int
    heading: float


class Corridor:
    """One edge's line."""

    def __init__(self, described: dict):
        self.id, self.ends, self.both, self.access = described["id"], (described["source"], described["target"]), bool(described["both"]), bool(described["access"])
        self.line = list(zip(described["xs"], described["ys"], strict=True))
        self.reached = [0.0]
        for (ax, ay), (bx, by) in zip(self.line, self.line[1:], strict=False):
            self.reached.append(self.reached[-1] + math.hypot(bx - ax, by - ay))
        self.length = self.reached[-1]
        self.heads = [{sign: bearing(sign * (bx - ax), sign * (by - ay)) for sign in (1, -1)} for (ax, ay), (bx, by) in zip(self.line, self.line[1:], strict=False)]
        self.last = len(self.line) - 1
        self.reach = min(REACH_M, self.length * REACH_SHARE)

    def _piece(self, metres: float) -> int:
        k = 1
        while k < self.last and metres > self.reached[k]:
            k += 1
        return k

    def at(self, metres: float) -> tuple[float, float]:
        """The point so many metres along."""
        k = self._piece(metres)
        (ax, ay), (bx, by), span = self.line[k - 1], self.line[k], self.reached[k] - self.reached[k - 1]
        share = (metres - self.reached[k - 1]) / span if span > 0 else 0.0
        return ax + (bx - ax) * share, ay + (by - ay) * share

    def heading(self, metres: float, sign: int) -> float:
        return self.heads[self._piece(metres) - 1][sign]

    def foot(self, x: float, y: float) -> tuple[float, float]:
        """Distance to the line, and metres along it, of its nearest point."""
        best = (math.inf, 0.0)
        for k, ((ax, ay), (bx, by)) in enumerate(zip(self.line, self.line[1:], strict=False)):
            dx, dy = bx - ax, by - ay
            squared = dx * dx + dy * dy
            if squared > 0:
                share = min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / squared))
                best = min(best, (math.hypot(x - ax - dx * share, y - ay - dy * share), self.reached[k] + math.sqrt(squared) * share))
        return best

    def end(self, sign: int):
        return self.ends[1 if sign > 0 else 0]

    def left(self, metres: float, sign: int) -> float:
        return self.length - metres if sign > 0 else metres


class Network:
    """A floor's corridors and the ways out of its nodes."""

    def __init__(self, described: str):
        edges = (Corridor(e) for e in json.loads(described))
        self.edges = {e.id: e for e in sorted(edges, key=lambda e: e.id) if e.length > TINY}
        self._decides: dict = {}
        self.exits: dict = {}
        for e in self.edges.values():
            if not e.access:
                self.exits.setdefault(e.ends[0], []).append(Exit(e.id, 1, e.heading(0.0, 1)))
                if e.both:
                    self.exits.setdefault(e.ends[1], []).append(Exit(e.id, -1, e.heading(e.length, -1)))

    def near(self, x: float, y: float) -> list[tuple[float, int, float]]:
        """Distance, edge, metres along it: those within reach, else the nearest one, access edges left out while there is another."""
        feet = sorted((*e.foot(x, y), e.id) for e in self.edges.values() if not e.access) or sorted((*e.foot(x, y), e.id) for e in self.edges.values())
        inside = [f for f in feet if f[0] <= SEED_M] or feet[:1]
        return [(away, edge, metres) for away, metres, edge in inside]

    def decides(self, edge: Corridor, node) -> bool:
        """Whether one who comes along the edge can turn at the node."""
        if (edge.id, node) not in self._decides:
            coming = edge.heading(edge.length, 1) if node == edge.ends[1] else edge.heading(0.0, -1)
            self._decides[edge.id, node] = any(abs(turn(coming, out.heading)) > TURN_DEG for out in self.exits.get(node, ()) if out.edge != edge.id)
        return self._decides[edge.id, node]

    def junction(self, edge: Corridor, metres: float, within: float):
        """The nearest node of the edge where ways part, and its distance, if within reach."""
        found = sorted((away, side) for side, away in ((0, metres), (1, edge.length - metres)) if away <= within and self.decides(edge, edge.ends[side]))
        return (edge.ends[found[0][1]], found[0][0]) if found else None

    def follows(self, edge: Corridor, sign: int, metres: float, target: int, within: float) -> bool:
        """Whether the target edge begins within so many metres ahead."""
        if edge.id == target:
            return True
        seen, ahead = {edge.id}, [(edge.end(sign), edge.left(metres, sign))]
        for node, away in ahead:
            if away > within:
                continue
            for out in self.exits.get(node, ()):
                if out.edge == target:
                    return True
                if out.edge not in seen:
                    seen.add(out.edge)
                    ahead.append((self.edges[out.edge].end(out.sign), away + self.edges[out.edge].length))
        return False


class Guess(NamedTuple):
    """A place on the graph; ``walked`` is the length of the way that led there."""

    edge: int
    metres: float
    sign: int
    cost: float = 0.0
    matched: float = 0.0
    unmatched: float = 0.0
    seen: float | None = None
    along: float | None = None
    passed: int = 0
    node: int | None = None
    off: float = 0.0
    seed: float = 0.0
    loose: float = 0.0
    walked: float = 0.0

    def mean(self) -> float:
        return (self.cost + self.seed) / (self.matched if self.matched > TINY else 1.0)


def _order(g: Guess) -> tuple:
    return (g.mean(), g.edge, g.sign, g.metres)


def best_of(guesses: list[Guess], width: int = WIDTH, stretch: float = STRETCH_M) -> list[Guess]:
    """The best guess of each edge, direction and stretch, and of these the best."""
    kept: dict = {}
    for g in sorted(guesses, key=_order):
        kept.setdefault((g.edge, g.sign, math.floor(g.metres / stretch + 0.5)), g)
    return list(kept.values())[:width]


class Step(NamedTuple):
    """A measured step: heading with its correction, length, and the measured position after it."""

    heading: float
    metres: float
    x: float
    y: float


def _along(net: Network, g: Guess, s: Step, metres: float) -> Guess:
    """The guess so many metres on along its edge."""
    if metres <= TINY:
        return g
    edge = net.edges[g.edge]
    ahead = edge.heading(g.metres, g.sign)
    straight = abs(turn(s.heading, ahead))
    bent = straight if g.seen is None else abs(turn(s.heading - g.seen, ahead - g.along))
    to = min(edge.length, max(0.0, g.metres + g.sign * metres))
    x, y = edge.at(to)
    off = math.hypot(x - s.x, y - s.y)
    away = OFF_GROWTH * min(OFF_MOST_M, max(0.0, off - g.off)) + OFF_REST * min(OFF_MOST_M, max(0.0, off - OFF_FREE_M))
    error = min(MOST_DEG, ABSOLUTE * straight + (1 - ABSOLUTE) * bent)
    keeps = math.exp(-metres / HORIZON_M)
    loose = min(REACH_M, g.loose + metres) if straight > OFF_EDGE_DEG else g.loose * keeps
    cost = g.cost * keeps + (error + OFF_COST * away) * metres
    return Guess(g.edge, to, g.sign, cost, g.matched * keeps + metres, g.unmatched * keeps, s.heading, ahead, g.passed, g.node, off, g.seed, loose, g.walked + abs(to - g.metres))


def _enter(net: Network, g: Guess, out: Exit, node, s: Step, cost: float, **more) -> Guess:
    edge = net.edges[out.edge]
    start = 0.0 if out.sign > 0 else edge.length
    x, y = edge.at(start)
    return g._replace(edge=out.edge, metres=start, sign=out.sign, cost=g.cost + cost, passed=g.passed + 1, node=node, off=math.hypot(x - s.x, y - s.y), loose=0.0, **more)


def _turns(net: Network, g: Guess, s: Step) -> Iterator[Guess]:
    """Turns just before the node ahead, and just after the node behind that the guess has come by."""
    edge = net.edges[g.edge]
    left = edge.left(g.metres, g.sign)
    if min(left, edge.length - left) - g.loose > edge.reach:  # neither node is near
        return
    error = abs(turn(s.heading, edge.heading(g.metres, g.sign)))
    ends = [(edge.end(g.sign), left, 1)]
    if g.node is not None and g.node == edge.end(-g.sign):
        ends.append((g.node, edge.left(g.metres, -g.sign), -1))
    for node, away, side in ends:
        skipped = max(0.0, away - g.loose)
        if not TINY < skipped <= edge.reach or not net.decides(edge, node):
            continue
        for out in net.exits.get(node, ()):
            if out.edge != g.edge and skipped <= net.edges[out.edge].reach and abs(turn(s.heading, out.heading)) < error:
                yield _enter(net, g, out, node, s, PASS_COST + SKIP_COST * skipped, along=out.heading, walked=g.walked + side * away)


def walk(net: Network, g: Guess, s: Step, metres: float, passes: int = 0) -> Iterator[Guess]:
    """Where the guess can be after so many metres."""
    if metres <= TINY:
        yield g
        return
    edge = net.edges[g.edge]
    left = edge.left(g.metres, g.sign)
    on = _along(net, g, s, min(metres, left))
    if metres <= left + TINY:
        yield on
        if not passes:
            yield from _turns(net, on, s)
        return
    node, rest = edge.end(g.sign), metres - min(metres, left)
    outs = net.exits.get(node, ()) if passes < PASSES else ()
    for out in outs:
        yield from walk(net, _enter(net, on, out, node, s, PASS_COST), s, rest, passes + 1)
    if not outs:
        yield on._replace(cost=on.cost + DEAD_END_COST * rest, matched=on.matched + rest, unmatched=on.unmatched + rest)


def advanced(net: Network, beam: list[Guess], s: Step, width: int = WIDTH, stretch: float = STRETCH_M) -> list[Guess]:
    """The beam after a step; guesses that head against it are also tried the other way."""
    out: list[Guess] = []
    for g in beam:
        edge = net.edges[g.edge]
        out += walk(net, g, s, s.metres)
        if edge.both and abs(turn(s.heading, edge.heading(g.metres, g.sign))) >= REVERSE_DEG:
            out += walk(net, g._replace(sign=-g.sign), s, s.metres)
    return best_of(out, width, stretch)


def seeds(net: Network, x: float, y: float) -> list[Guess]:
    """Both directions of all edges near the first position."""
    found = [Guess(edge, metres, sign, seed=away * SEED_COST) for away, edge, metres in net.near(x, y) for sign in (1, -1) if sign > 0 or net.edges[edge].both]
    return best_of(found)


class Track(NamedTuple):
    """A session's state."""

    described: str
    beam: list = []
    shown: list = []  # the beam of unconfirmed steps
    steps: int = 0
    metres: float = 0.0
    heading: float = 0.0
    bias: float = 0.0
    leader: tuple | None = None
    x: float = 0.0
    y: float = 0.0
    last: float | None = None  # heading of the last confirmed step
    shown_m: float = 0.0
    ids: tuple = ()
    unsure: bool = False


def _led(net: Network, beam: list[Guess], leader: tuple | None) -> tuple[list[Guess], tuple]:
    """The beam with its leader first: the last one, until another is better by a margin."""
    first = beam[0]
    held = next((g for g in beam if leader == (g.edge, g.sign)), None)
    if held is None or held is first:
        return beam, (first.edge, first.sign)
    edge = net.edges[held.edge]
    by = net.junction(edge, held.metres, edge.reach + held.loose) if held.edge != first.edge else None
    margin = LEAD_JUNCTION_DEG if by and any(out.edge == first.edge for out in net.exits.get(by[0], ())) else LEAD_DEG
    if first.mean() < held.mean() - margin:
        return beam, (first.edge, first.sign)
    return [held, *(g for g in beam if g is not held)], leader


def _confirm(net: Network, t: Track, row: tuple) -> tuple[Track, str, int | None, bool]:
    """New confirmed steps: the track, what its place is, the edge it may be on instead, and whether it jumped."""
    steps, metres, x, y, xs, ys = row
    more, way = max(0, steps - t.steps), max(0.0, metres - t.metres)
    t = t._replace(steps=max(t.steps, steps), metres=max(t.metres, metres))
    if not (more and way):
        return t._replace(x=x, y=y), "still", None, False
    at, measured = (t.x, t.y), []
    for to in zip(xs or (), ys or (), strict=True):
        if (far := math.hypot(to[0] - at[0], to[1] - at[1])) > TINY:
            measured.append((bearing(to[0] - at[0], to[1] - at[1]), far, *to))
        at = to
    total = sum(m[1] for m in measured)
    measured = [(h, far * way / total, px, py) for h, far, px, py in measured] or [(t.heading, way / more, x, y)] * more
    beam, passed = t.beam, t.beam[0].passed
    was = net.edges[beam[0].edge].at(beam[0].metres)
    for heading, far, px, py in measured:
        beam = advanced(net, beam, Step((heading + t.bias) % 360.0, far, px, py))
    bias, first = t.bias, beam[0]
    if first.unmatched <= 0.5:
        wanted = turn(net.edges[first.edge].heading(first.metres, first.sign), t.heading + bias)
        if abs(wanted) <= BIAS_ERROR_DEG:
            bias = min(BIAS_MOST_DEG, max(-BIAS_MOST_DEG, bias + min(BIAS_STEP_DEG, max(-BIAS_STEP_DEG, wanted))))
    beam, leader = _led(net, beam, t.leader)
    first, second = beam[0], beam[1] if len(beam) > 1 else None
    unsure = second is not None and second.edge != first.edge and second.mean() - first.mean() < AMBIGUOUS_DEG
    place = "lost" if first.unmatched > 0.5 else "node" if first.passed > passed else "turn" if unsure else "straight"
    now = net.edges[first.edge].at(first.metres)
    jumped = math.hypot(now[0] - was[0], now[1] - was[1]) > way + JUMP_M
    return t._replace(beam=beam, bias=bias, leader=leader, x=x, y=y, last=measured[-1][0]), place, second.edge if unsure else None, jumped


def _preview(net: Network, t: Track, row: tuple, jumped: bool) -> tuple[Track, bool, int]:
    """Steps that are not confirmed: the track, whether the shown place jumped, and how many steps were new."""
    ox, oy, ids, xs, ys, through = row
    best, shown = t.beam[0], t.shown
    lead = max(0.0, t.shown_m - t.metres)
    if not shown:
        shown, t = [best], t._replace(shown_m=t.metres)
    elif (shown[0].edge, shown[0].sign) != (best.edge, best.sign) and not net.follows(net.edges[best.edge], best.sign, best.metres, shown[0].edge, lead + LEAD_SLACK_M):
        shown, t, jumped = [best], t._replace(shown_m=t.metres), True
    known, held, new, shown_m = list(t.ids), set(t.ids), 0, t.shown_m
    if ox is not None and oy is not None:
        for name, px, py in zip(ids or (), xs or (), ys or (), strict=True):
            dx, dy, ox, oy = px - ox, py - oy, px, py
            if name in held:
                continue
            known.append(name)
            held.add(name)
            if (far := math.hypot(dx, dy)) > TINY:
                shown = advanced(net, shown, Step((bearing(dx, dy) + t.bias) % 360.0, far, px, py))
                shown_m, new = shown_m + far, new + 1
    if t.metres - shown_m > TINY:  # steps that came confirmed only
        heading = t.heading if t.last is None else t.last
        shown = advanced(net, shown, Step((heading + t.bias) % 360.0, t.metres - shown_m, t.x, t.y))
        shown_m = t.metres
    known = known[-REMEMBERED:]
    while known and through is not None and 0 <= known[0] <= through:
        known.pop(0)
    gap = shown[1].mean() - shown[0].mean() if len(shown) > 1 and shown[1].edge != shown[0].edge else math.inf
    unsure = gap < AMBIGUOUS_DEG * (2 if t.unsure else 1)
    return t._replace(shown=shown, shown_m=shown_m, ids=tuple(known), unsure=unsure), jumped, new


def _track(state: Track | None, row: tuple) -> tuple[Track | None, tuple]:
    described, steps, metres, x, y, heading, xs, ys, *peaks = row
    nothing = (None,) * 16
    if state is None and described is not None:
        state = Track(described)  # a network may come before the first position
    if state is None or x is None or y is None:
        return state, nothing
    net = _network(state.described)
    if not state.beam:
        state = Track(state.described, beam=seeds(net, x, y), steps=steps or 0, metres=metres or 0.0, x=x, y=y, shown_m=metres or 0.0)
        if not state.beam:
            return state, nothing
    if heading is not None:
        state = state._replace(heading=heading % 360.0)
    state, place, other, jumped = _confirm(net, state, (state.steps if steps is None else steps, state.metres if metres is None else metres, x, y, xs, ys))
    state, jumped, new = _preview(net, state, tuple(peaks), jumped)
    first, shown = state.beam[0], state.shown[0]
    edge, ahead = net.edges[first.edge], net.edges[shown.edge]
    junction = net.junction(ahead, shown.metres, ahead.reach + shown.loose) or (None, None)
    return state, (
        first.edge, first.metres, first.sign, *edge.at(first.metres), edge.heading(first.metres, first.sign), state.bias, place, other, first.walked, jumped,
        shown.edge, shown.metres, max(0.0, state.shown_m - state.metres), state.unsure, junction[0],
    )


_networks: dict[str, Network] = {}


def _network(described: str) -> Network:
    """The network of a description; a worker keeps the last few floors."""
    if described not in _networks:
        if len(_networks) >= 16:
            _networks.pop(next(iter(_networks)))
        _networks[described] = Network(described)
    return _networks[described]


def _pack(t: Track | None) -> tuple:
    return (None, None) if t is None else (t.described, json.dumps(t[1:]))


def _unpack(values: tuple) -> Track | None:
    described, rest = values
    if described is None:
        return None
    beam, shown, *more = json.loads(rest)
    t = Track(described, [Guess(*g) for g in beam], [Guess(*g) for g in shown], *more)
    return t._replace(leader=tuple(t.leader) if t.leader else None, ids=tuple(t.ids))


#: A walker's place on the corridors, confirmed and shown.  Without a network or a position a row says nothing.
CORRIDOR = Kernel(
    "network string, steps long, metres double, x double, y double, heading double, xs array<double>, ys array<double>, "
    "origin_x double, origin_y double, peaks array<long>, peak_xs array<double>, peak_ys array<double>, through long",
    "described string, rest string",
    "edge long, progress double, sign int, at_x double, at_y double, at_heading double, bias double, place string, other_edge long, walked double, jumped boolean, "
    "shown_edge long, shown_progress double, lead double, unsure boolean, junction long",
    _track,
    _pack,
    _unpack,
)


def networks(edges: DataFrame) -> DataFrame:
    """floor, network: a floor's corridors as one text.

    edges: floor, id, source, target, both, access, xs, ys (a line of at least two
    points), and a penalty for matching if there is one.  A row holds one floor, whose size a building bounds; edges between
    floors are left out before.
    """
    line = F.struct("id", "source", "target", "both", "access", "xs", "ys", *(["penalty"] if "penalty" in edges.columns else []))
    return edges.where("size(xs) >= 2 and size(xs) = size(ys)").groupBy("floor").agg(F.to_json(F.sort_array(F.collect_list(line))).alias("network"))


def with_network(samples: DataFrame, floors: DataFrame, key: str, order: str) -> DataFrame:
    """samples with their floor's network: a table's first sample of each key has it, all of a stream."""
    if samples.isStreaming:
        return samples.join(floors, "floor", "left")
    first = samples.groupBy(key).agg(F.min_by("floor", order).alias("floor"), F.min(order).alias(order)).join(floors, "floor", "left")
    return samples.join(first.select(key, order, "network"), [key, order], "left")


def summary(tracked: DataFrame, key: str, order: str, ms: str, walked: str) -> DataFrame:
    """Per key: rows, the share of the walked metres that the track has, its longest stall in seconds, jumps, bounds of the track.

    A stall is time in which the walked metres grow and the track stays.
    """
    by = Window.partitionBy(key).orderBy(order)
    moved = (F.col("edge") != F.lag("edge").over(by)) | (F.abs(F.col("progress") - F.lag("progress").over(by)) > TINY)
    walks = F.col(walked) > F.lag(walked).over(by)
    rows = tracked.where("edge is not null").withColumn("moved", F.coalesce(moved, F.lit(True))).withColumn("since", F.col(ms) - F.lag(ms).over(by)).withColumn("walks", F.coalesce(walks, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("moved").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.withColumn("stuck", F.when(~F.col("moved") & F.col("walks"), F.col("since")).otherwise(0)).groupBy(key, "run").agg(
        F.sum("stuck").alias("stuck"), F.count("*").alias("n"), F.sum(F.col("jumped").cast("int")).alias("jumps"), F.max("walked").alias("track_m"), F.max_by("walked", order).alias("last_m"), F.max(order).alias("last"),
        F.min(walked).alias("from_m"), F.max(walked).alias("to_m"), *(f(c).alias(f"{n}_{c[-1]}") for n, f in (("min", F.min), ("max", F.max)) for c in ("at_x", "at_y")),
    )
    far = F.max("to_m") - F.min("from_m")
    return runs.groupBy(key).agg(
        F.sum("n").alias("rows"), (F.max_by("last_m", "last") / F.nullif(far, F.lit(0.0))).alias("retention"), (F.max("stuck") / 1000).alias("stall_s"), F.sum("jumps").alias("jumps"),
        *(f(f"{n}_{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")),
    )
