"""Following a route: how steps relate to it, evidence of leaving it, what is shown and held, and which checkpoints are passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.motion import FREE_BACK_M, JUMP_SLACK_M, STEP_M
from waymark.operators.stateful import Kernel

# Metres off a route that are strong evidence; updates and ms that strong and weak evidence need; ms at a junction that excuse.
STRONG_M, STRONG, WEAK, JUNCTION_MS = 4.0, (2, 700), (3, 1_200), 4_000
# Metres from which a route leads to its boarding point, at which the shown place is held there, at which it is let go, and how long.
GATE_M, HOLD_M, LET_GO_M, GATE_MS = 16.0, 6.0, 8.0, 40_000

# route, shown metres, steps when shown; evidence: count, since, steps seen; junction since, still excused; gate since, held at the boarding point
_NOBODY = (None, None, None, 0, None, None, None, False, None, False)


def _approach(since: int | None, held: bool, ms: int, metres: float | None) -> tuple[int | None, bool, bool]:
    """The boarding gate: since when, whether the shown place is held there, whether it is open."""
    if metres is None or metres > GATE_M:
        return None, False, False
    since = ms if since is None else since
    if ms - since >= GATE_MS:
        return since, False, False
    return since, metres <= (LET_GO_M if held else HOLD_M), True


def _guide(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    ms, route, travelled, off, on_edge, again, lost, junction, steps, rerouting, riding, reverse, board_m = row
    known, shown, shown_steps, count, since, seen, at_junction, excused, gate, held = state or _NOBODY
    if ms is None:
        return (known, shown, shown_steps, count, since, seen, at_junction, excused, gate, held), (shown, None, count, False, False, held, False, None)
    gate, held, is_open = _approach(gate, held, ms, board_m)
    if route is None:
        return (*_NOBODY[:8], gate, held), (None, None, 0, False, is_open, held, False, None)
    changed = route != known
    if changed:  # a new route is begun as if nothing were known of the walker
        shown = shown_steps = since = seen = None
        count = 0
    if riding or held or travelled is None or off is None:
        return (route, shown, shown_steps, count, since, seen, at_junction, excused, gate, held), (shown, None, count, False, is_open, held, changed, None)

    at_junction = (ms if at_junction is None else at_junction) if junction else None
    excused = at_junction is not None and ms - at_junction < JUNCTION_MS
    strong, reroute = off >= STRONG_M or bool(again), False
    if lost or not (strong or not on_edge):
        count, since, seen = 0, None, steps
    elif not excused and steps is not None and steps != seen:  # only a walker leaves a route
        seen, since, count = steps, ms if since is None else since, count + 1
        updates, lasts = STRONG if strong else WEAK
        reroute = count >= updates and ms - since >= lasts and not rerouting and not is_open

    hold = None
    if shown is not None:
        explained = None if shown_steps is None or steps is None else JUMP_SLACK_M + max(0, steps - shown_steps) * STEP_M
        if not on_edge and count > 0:
            hold = "deviation"
        elif explained is not None and abs(travelled - shown) > explained:
            hold = "jump"
        elif shown - travelled > FREE_BACK_M and not reverse:
            hold = "back"
    if hold is None:
        shown, shown_steps = travelled, steps
    return (route, shown, shown_steps, count, since, seen, at_junction, excused, gate, held), (shown, hold, count, reroute, is_open, held, changed, None)


def _due(state: tuple | None) -> int | None:
    """When an excuse at a junction ends, or a gate closes."""
    if state is None:
        return None
    ends = [s + after for s, after, on in ((state[6], JUNCTION_MS, state[7]), (state[8], GATE_MS, state[9])) if s is not None and on]
    return min(ends, default=None)


def _ring(state: tuple) -> tuple[tuple, tuple]:
    known, shown, shown_steps, count, since, seen, at_junction, excused, gate, held = state
    if excused and at_junction is not None and at_junction + JUNCTION_MS == _due(state):
        excused, timer = False, "junction"
    else:
        held, timer = False, "boarding"
    return (known, shown, shown_steps, count, since, seen, at_junction, excused, gate, held), (shown, None, count, False, False, held, False, timer)


#: A guided walk: shown progress and why it is held, evidence of leaving the route, whether to route anew, the gate of a boarding point.
#: Timers end an excuse at a junction and the hold at a boarding point without waiting for a row.
GUIDE = Kernel(
    "ms long, route long, travelled double, off double, on_edge boolean, again boolean, lost boolean, junction boolean, steps long, rerouting boolean, riding boolean, reverse boolean, board_m double",
    "known long, shown double, shown_steps long, count long, since long, seen long, at_junction long, excused boolean, gate long, held boolean",
    "shown double, hold string, evidence long, reroute boolean, gate boolean, held boolean, new_route boolean, timer string",
    _guide,
    clock="ms",
    due=_due,
    ring=_ring,
)


def relation(steps: DataFrame, routes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, signed_m, relation, crossed: how each step lies on its route.

    steps: key, route, moved (array of edge, from_m, to_m; an edge may repeat),
    crossed_nodes, relocated; routes: route, nth, edge, source, target (the way it is
    walked); edges: edge, source, target.  Metres are counted up to the first part
    that is off the route; a part whose edge does not join the route's nodes there
    makes the step ambiguous.
    """
    first = routes.groupBy("route", "edge").agg(F.min_by(F.struct("source", "target"), "nth").alias("way"))
    parts = steps.where("not relocated").select(*key, "route", F.posexplode("moved").alias("nth", "part")).select(*key, "route", "nth", F.col("part.edge").alias("edge"), (F.col("part.to_m") - F.col("part.from_m")).alias("metres"))
    lines = edges.select("edge", F.struct("source", "target").alias("line"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")).alias("back"))
    met = parts.join(first, ["route", "edge"], "left").join(lines, "edge", "left")
    sign = F.when(F.col("line") == F.col("way"), 1).when(F.col("back") == F.col("way"), -1)
    bad = F.when(F.col("way").isNull() | F.col("line").isNull(), "off").when(sign.isNull(), "ambiguous")
    judged = met.select(*key, "nth", (F.col("metres") * sign).alias("metres"), bad.alias("bad"))
    by = Window.partitionBy(*key)
    stop = F.min(F.when(F.col("bad").isNotNull(), F.struct("nth", "bad"))).over(by)
    counted = judged.withColumn("stop", stop).groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("stop").isNull() | (F.col("nth") < F.col("stop.nth")), F.col("metres"))), F.lit(0.0)).alias("signed_m"), F.first("stop.bad").alias("bad")
    )
    nodes = routes.select("route", "source").unionByName(routes.select("route", F.col("target").alias("source"))).distinct()
    passed = steps.where("not relocated").select(*key, "route", F.posexplode("crossed_nodes").alias("nth", "source")).join(nodes, ["route", "source"], "left_semi")
    crossed = passed.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", "source"))).alias("c")).select(*key, F.col("c.source").alias("crossed"))
    signed = F.coalesce("signed_m", F.lit(0.0))
    told = F.when(F.col("relocated"), "relocated").when(F.col("bad").isNotNull(), F.col("bad")).when(signed > 1e-6, "forward").when(signed < -1e-6, "reverse").otherwise("ambiguous")
    out = steps.select(*key, "relocated").join(counted, key, "left").join(crossed, key, "left")
    on_route = told.isin("forward", "reverse") | (told == "ambiguous") & F.col("bad").isNull()
    none = F.array().cast(dict(crossed.dtypes)["crossed"])
    return out.select(*key, signed.alias("signed_m"), told.alias("relation"), F.when(on_route, F.coalesce("crossed", none)).otherwise(none).alias("crossed"))


# Fixed values of checkpoints: steps of evidence behind a turn, metres from the node that are too far, steps looked back on, the least of them.
TURN_STEPS, RESIDUAL_M, LOOK_BACK, LEAST_STEPS = 3, 1.5, 4, 3


def _gate(relation: str | None, direction: str | None, lost, edge_on_route, unsure, rerouting) -> str | None:
    if relation != "forward":
        return "not forward"
    if direction != "forward":
        return "direction not forward"
    for failed, why in ((lost, "lost"), (not edge_on_route, "off the route"), (unsure, "ambiguous"), (rerouting, "routing anew")):
        if failed:
            return why
    return None


def _pass(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    """Checkpoints of the row's route come as its next ones: node, kind, the edge behind it, metres from it."""
    peak, route, relation, direction, signed, crossed, nodes, kinds, outs, metres, edge, on_route, lost, unsure, rerouting = row
    known, done, last, pending, steps, pending_m, recent = state or (None, 0, None, None, 0, None, [])
    if route != known:
        known, done, last, pending, steps, pending_m, recent = route, 0, None, None, 0, None, []
    recent = list(recent or [])
    same = (known, done, last, pending, steps, pending_m, recent)
    if peak is None or (last is not None and peak <= last) or route is None or done >= len(nodes or ()):
        return same, (None, None, None, done)
    node, kind, out, away = (x[done] for x in (nodes, kinds, outs, metres))
    passes, last = node in (crossed or ()), peak
    why = _gate(relation, direction, lost, on_route, unsure, rerouting)
    if why:
        return (known, done, last, None, 0, None, []), ((node, "reject", why, done) if passes else (None, None, None, done))
    recent = [*recent, signed or 0.0][-LOOK_BACK:]
    told = (None, None, None)
    if kind == "straight" and passes:
        if away is None or away > RESIDUAL_M:
            told = (node, "dispute", "too far")
        elif len(recent) >= LEAST_STEPS and min(recent) > 0:
            told, done = (node, "commit", "steps"), done + 1
        else:
            told = (node, "reject", "too few steps")
    elif kind == "turn" and passes and pending is None:
        if away is None or away > RESIDUAL_M:
            told = (node, "dispute", "too far")
        else:
            told, pending, steps, pending_m = (node, "candidate", "steps to come"), node, 1, away
    elif kind == "turn" and pending == node:
        steps += 1
        if edge != out:
            told, pending, steps, pending_m = (node, "reject", "another way"), None, 0, None
        elif steps >= TURN_STEPS:
            told, done, pending, steps, pending_m = (node, "commit", "steps"), done + 1, None, 0, None
    return (known, done, last, pending, steps, pending_m, recent), (*told, done)


#: Checkpoints of a route as steps pass them: a turn is a candidate until enough steps go out behind it; a step counts once, its id being its time.
CHECKPOINT = Kernel(
    "peak long, route long, relation string, direction string, signed_m double, crossed array<long>, nodes array<long>, kinds array<string>, outs array<long>, metres array<double>, edge long, on_route boolean, lost boolean, unsure boolean, rerouting boolean",
    "known long, done long, last long, pending long, steps long, pending_m double, recent array<double>",
    "node long, decision string, reason string, done long",
    _pass,
)
