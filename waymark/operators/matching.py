"""The plain map matcher: the nearest edge by a score, kept unless another is clearly better and near by the graph, as keyed state."""

from __future__ import annotations

import heapq
import json
import math

from waymark.operators.corridors import Corridor
from waymark.operators.stateful import Kernel

# Fixed values, metres: what another edge must be better by, least way to it, that way's multiple of the step, cost of heading across an edge, the step from which a heading counts.
SWITCH_M, WAY_M, WAY_TIMES, ACROSS_M, HEADS_M = 1.25, 4.0, 3.0, 2.0, 0.2
# Metres off the held edge that begin a recovery, samples of one other edge that end it, how near it is, least way and its multiple.
OFF_M, SAMPLES, NEAR_M, RECOVER_M, RECOVER_TIMES = 2.0, 3, 12.0, 14.0, 4.0
#: How many edges are tried for a switch; the penalty of an access edge.
TRIED, ACCESS_M = 8, 4.0


class Streets:
    """A floor's edges with their penalties, and shortest ways between nodes, each source searched once."""

    def __init__(self, described: str):
        rows = json.loads(described)
        self.edges = {e.id: e for e in sorted(map(Corridor, rows), key=lambda e: e.id) if e.length > 1e-8}
        self.penalty = {r["id"]: r["penalty"] if r.get("penalty") is not None else ACCESS_M if r["access"] else 0.0 for r in rows}
        self.ways: dict = {}
        for e in self.edges.values():
            self.ways.setdefault(e.ends[0], []).append((e.ends[1], e.length))
            if e.both:
                self.ways.setdefault(e.ends[1], []).append((e.ends[0], e.length))
        self._from: dict = {}

    def between(self, a, b) -> float:
        """Metres from node a to node b."""
        if a not in self._from:
            known, ahead = {a: 0.0}, [(0.0, a)]
            while ahead:
                metres, node = heapq.heappop(ahead)
                if metres > known[node]:
                    continue
                for to, length in self.ways.get(node, ()):
                    if metres + length < known.get(to, math.inf):
                        known[to] = metres + length
                        heapq.heappush(ahead, (known[to], to))
            self._from[a] = known
        return self._from[a].get(b, math.inf)

    def way(self, edge: int, metres: float, to: int, to_metres: float) -> tuple[float, int | None, int | None]:
        """Metres between two places, and the nodes by which the way leaves one edge and enters the other."""
        if edge == to:
            return abs(metres - to_metres), None, None
        a, b = self.edges[edge], self.edges[to]
        return min((left + self.between(out, into) + rest, out, into) for out, left in zip(a.ends, (metres, a.length - metres), strict=True) for into, rest in zip(b.ends, (to_metres, b.length - to_metres), strict=True))


_streets: dict[str, Streets] = {}


def _of(described: str) -> Streets:
    if described not in _streets:
        if len(_streets) >= 16:
            _streets.pop(next(iter(_streets)))
        _streets[described] = Streets(described)
    return _streets[described]


def _score(net: Streets, edge: Corridor, away: float, metres: float, dx: float, dy: float) -> float:
    score, step = away + net.penalty[edge.id], math.hypot(dx, dy)
    if step < HEADS_M:
        return score
    heading = math.radians(edge.heading(metres, 1))
    along = (dx * math.sin(heading) + dy * math.cos(heading)) / step
    return score + (1.0 - min(1.0, max(0.0, abs(along) if edge.both else along))) * ACROSS_M


def _match(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
    """State: network, held edge, metres along it, last position, and of a recovery its edge, samples and metres."""
    described, x, y = row
    described, held, at, px, py, other, samples, walked = state or (described, None, None, None, None, None, 0, 0.0)
    nothing = (None,) * 8
    if described is None or x is None or y is None:
        return (None if described is None else (described, held, at, px, py, other, samples, walked)), nothing
    net = _of(described)
    if not net.edges:
        return (described, held, at, px, py, other, samples, walked), nothing
    dx, dy = (0.0, 0.0) if px is None else (x - px, y - py)
    step = math.hypot(dx, dy)
    feet = {i: e.foot(x, y) for i, e in net.edges.items()}
    score = {i: _score(net, net.edges[i], away, metres, dx, dy) for i, (away, metres) in feet.items()}
    order = sorted(score, key=lambda i: (score[i], i))
    told, way = "tracking", (0.0, None, None)
    if held is None:
        chosen, other, samples, walked = order[0], None, 0, 0.0
    else:
        chosen, least = held, max(WAY_M, step * WAY_TIMES + SWITCH_M)
        better = lambda i: score[i] + SWITCH_M < score[held]
        to = lambda i: net.way(held, at, i, feet[i][1])
        near = next((i for i in order[:TRIED] if i != held and to(i)[0] <= least), None)
        if near is not None and better(near):
            chosen, other, samples, walked = near, None, 0, 0.0
        else:
            found = next((i for i in order if i != held and feet[i][0] <= NEAR_M and better(i) and to(i)[0] < math.inf), None)
            if found is None or feet[held][0] < OFF_M:
                other, samples, walked = None, 0, 0.0
            else:
                samples, walked = (samples + 1, walked + step) if found == other else (1, step)
                other, told = found, "suspect"
                if samples >= SAMPLES and to(found)[0] <= max(RECOVER_M, walked * RECOVER_TIMES + SWITCH_M):
                    chosen, told, other, samples, walked = found, "recovered", None, 0, 0.0
        way = to(chosen)
    away, metres = feet[chosen]
    return (described, chosen, metres, x, y, other, samples, walked), (chosen, metres, *net.edges[chosen].at(metres), away, told, way[0], way[1])


#: A walker's edge and place on it; ``way`` is how far it is along the graph from the last one, ``via`` the node by which it left the last edge.
MATCH = Kernel(
    "network string, x double, y double",
    "described string, held long, at double, px double, py double, other long, samples long, walked double",
    "edge long, progress double, at_x double, at_y double, away double, told string, way double, via long",
    _match,
)
