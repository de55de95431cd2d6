"""Rides on escalators, from air pressure, steps and the boarding points near a walker, as keyed state.

A ride has phases: boarding (a route leads to a boarding point and the walker comes
near), rising (vertical motion for a time), midway (half a floor, a first sign that
the floor changes) and landed; a ride that goes back, stalls, takes too long or
passes several floors is cancelled.  Which boarding points are near is joined to
the samples by Spark (``near_boarding``), so the state has no map.
"""

from __future__ import annotations

import json
import math
import re
import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.stateful import Kernel

# Fixed values, metres and ms: near a boarding point, on a route to one, how long that holds.
NEAR_M, ROUTE_M, HOLDS_MS = 6.0, 16.0, 60_000
# The median's window and least samples, silence that begins anew, the rise that opens a ride, is midway, may land, is several floors.
MEDIAN_MS, MEDIAN_N, SILENT_MS, OPENS_M, MIDWAY_M, LANDS_M, TOO_FAR_M = 3_000, 3, 15_000, 1.2, 2.4, 2.2, 10.0
# A ramp's window, strides of at least this time and rise, how many; its least rise in a settle window, the rise that counts as settled.
RAMP_MS, STRIDE_MS, STRIDE_M, STRIDES, SETTLE_MS, RAMP_M, SETTLED_M = 5_000, 1_000, 0.04, 3, 2_500, 0.45, 0.25
# The quick altitude's time constant and base of speed, speeds in m/s that are still (with a step), quiet that lands, the least ride, the longest.
QUICK_MS, BASE_MS, STILL, STILL_STEP, QUIET_MS, LEAST_MS, LONGEST_MS = 300.0, 700, 0.12, 0.18, 1_000, 2_500, 90_000
# How much of a difference the baseline follows; when boarding begins and is left, nearing it so often; stall; vertical speed, its time, what is seen.
FOLLOWS, BOARDS_M, LEAVES_M, NEARINGS, STALL_MS, VERTICAL, VERTICAL_MS, SEEN_M, AT_BOARDING_M = 0.02, 3.0, 8.0, 2, 40_000, 0.12, 1_000, 1.2, 0.5
# Metres by which a distance to a boarding point shrinks or grows.
SHRINKS_M, GROWS_M = 0.2, 0.5


def rank(label: str | None) -> int:
    """B3 is -3, 2F is 2, anything else 0."""
    found = re.match(r"([Bb]?)(\d+)", label or "")
    return 0 if not found else -int(found[2]) if found[1] else int(found[2])


class Ride:
    """A session's state; every attribute is a plain value."""

    def __init__(self, **held):
        self.floor, self.floors, self.landed_on = None, [], None
        self.steps, self.moves, self.taken, self.seen = 0, 0, 0, [0, 0, 0]
        self.forget()
        self.near, self.watched, self.until, self.expected, self.arrival = {}, {}, None, None, None
        self.phase, self.since = "idle", None
        self.leave()
        self.__dict__.update(held)
        self.told: list = []

    def forget(self) -> None:
        """No altitudes, as at the start."""
        self.window, self.smooth, self.base, self.level = [], [], None, None
        self.quick, self.quick_ms, self.quicks = None, None, []
        self.close()
        self.settling, self.settled_ms = False, None

    def close(self) -> None:
        """No ride is open."""
        self.start, self.sign, self.start_steps, self.board, self.to, self.midway, self.quiet_ms = None, 0, 0, None, None, False, None

    def leave(self) -> None:
        """No boarding is under way."""
        self.route_m, self.route_steps, self.nearings, self.at, self.at_once = None, None, 0, None, False
        self.up_ms, self.up_sign, self.moving, self.risen, self.early, self.calm_ms = None, 0, False, 0.0, False, None

    # what is told: (phase, reason, to floor, bank, boarding point, arrival, rise, event)
    def turn_to(self, phase: str, ms: int, reason: str, to=None, board=None, arrival=None, rise=0.0, event=None) -> None:
        if self.phase != phase:
            self.phase, self.since = phase, ms
            self.told.append((phase, reason, to, board and board["bank"], board and board["id"], arrival, rise))
            if phase in ("cancelled", "landed"):
                self.leave()
                self.phase = "idle"

    def cancel(self, ms: int, reason: str, rise: float, base: float | None = None, to=None, board=None) -> None:
        self.turn_to("cancelled", ms, reason, to, board, None, rise)
        self.close()
        self.base = self.base if base is None else base

    def moves_to(self, floor: str | None, floors: list) -> None:
        """The floor that is shown; one that a ride has landed on is no news."""
        self.floors = floors or self.floors
        if floor is None or floor == self.floor:
            return
        known, self.floor = self.floor, floor
        if floor == self.landed_on:
            self.landed_on = None
        elif known is not None:
            if self.phase != "idle":
                self.turn_to("cancelled", self.since or 0, "floor changed")
            self.forget()
            self.leave()
            self.landed_on, self.near, self.watched, self.until, self.expected, self.arrival = None, {}, {}, None, None, None
            self.phase, self.since, self.seen = "idle", None, [self.steps, self.moves, self.taken]

    def stands(self, ms: int, boards: list) -> None:
        """Boarding points within reach."""
        for b, away in boards:
            if away <= NEAR_M:
                key = str(b["id"])
                self.near[key] = (b, min(away, self.near[key][1]) if key in self.near else away)
                self.watched[key] = min(away, self.watched.get(key, away))
                self.until = ms + HOLDS_MS

    def approaches(self, ms: int, away: float, board: dict, arrival, at_once: bool) -> None:
        """The metres that a route still has to its boarding point."""
        if away > ROUTE_M:
            if self.phase == "boarding":
                self.turn_to("cancelled", ms, "moved away")
            self.route_m, self.route_steps, self.nearings, self.at, self.at_once = None, None, 0, None, False
            return
        self.expected, self.arrival, self.at, self.at_once = board["id"], arrival, board, at_once
        self.near[str(board["id"])], self.until = (board, away), ms + HOLDS_MS
        if self.phase not in ("idle", "boarding"):
            return
        if self.route_steps != self.steps:
            if self.route_m is not None:
                self.nearings = self.nearings + 1 if away < self.route_m - SHRINKS_M else 0 if away > self.route_m + GROWS_M else self.nearings
            self.route_m, self.route_steps = away, self.steps
        if self.phase == "boarding":
            if not self.moving and away > LEAVES_M:
                self.turn_to("cancelled", ms, "moved away")
        elif away <= BOARDS_M and self.nearings >= NEARINGS and self.has(board["to"]):
            self.turn_to("boarding", ms, "route", board["to"], board, arrival)

    def has(self, floor: str) -> bool:
        return not self.floors or floor in self.floors

    def choose(self, up: bool) -> tuple[dict | None, str]:
        """The boarding point of a ride that goes this way: the route's, else the nearest that was seen; and the evidence."""
        fits = {k: b for k, (b, _) in self.near.items() if bool(b["up"]) == up}
        if self.expected is not None and str(self.expected) in fits:
            return fits[str(self.expected)], "route and seen" if str(self.expected) in self.watched else "route"
        seen = sorted((away, k) for k, away in self.watched.items() if k in fits)
        return (fits[seen[0][1]] if seen else None), "seen"

    def next_floor(self, up: bool) -> str | None:
        here, step = rank(self.floor), 1 if up else -1
        if not here:
            return None
        wanted = here + 2 * step if here + step == 0 else here + step
        return next((f for f in self.floors if rank(f) == wanted), None)

    def hears(self, ms: int, metres: float) -> None:
        """An altitude."""
        stepped, moved = self.steps > self.seen[0] or self.taken > self.seen[2], self.moves > self.seen[1]
        moved, self.seen = moved or stepped, [self.steps, self.moves, self.taken]
        if self.window and ms - self.window[-1][0] > SILENT_MS:
            phase = self.phase
            self.forget()
            self.phase = phase
        before = self.quick
        passed = None if self.quick_ms is None else ms - self.quick_ms
        share = 1.0 - math.exp(-passed / QUICK_MS) if passed and passed > 0 else 1.0
        self.quick = metres if before is None else before + share * (metres - before)
        self.quick_ms = ms
        self.quicks.append((ms, self.quick))
        while len(self.quicks) > 2 and self.quicks[1][0] <= ms - BASE_MS:
            self.quicks.pop(0)
        then, was = self.quicks[0]
        speed = (self.quick - was) * 1000.0 / (ms - then) if len(self.quicks) > 1 and then <= ms - BASE_MS else None
        gained = 0.0 if before is None or passed is None else self.quick - before

        self.window.append((ms, metres))
        while len(self.window) > MEDIAN_N and self.window[0][0] < ms - MEDIAN_MS:
            self.window.pop(0)
        if len(self.window) < MEDIAN_N:
            self.level = None
            return
        self.level = statistics.median(m for _, m in self.window)
        self.smooth.append((ms, self.level))
        while len(self.smooth) > 1 and self.smooth[1][0] < ms - RAMP_MS:  # one older than the window tells the rise after a pause
            self.smooth.pop(0)
        self.base = self.level if self.base is None else self.base
        if self.until is None or ms > self.until:
            self.near, self.watched, self.until = {}, {}, None
        rise = self.level - self.base
        if self.start is not None:
            self.rides(ms, rise, speed, stepped)
        elif self.settling:
            self.settles(ms, speed)
        else:
            self.waits(ms, rise, speed, gained, moved)

    def settles(self, ms: int, speed: float | None) -> None:
        """After landing the baseline waits for quiet, so that the rest of a ride is no second floor."""
        if speed is None or abs(speed) >= VERTICAL:
            self.settled_ms = None
            return
        self.settled_ms = ms if self.settled_ms is None else self.settled_ms
        if ms - self.settled_ms >= QUIET_MS:
            self.base, self.settling, self.settled_ms = self.level, False, None

    def waits(self, ms: int, rise: float, speed: float | None, gained: float, moved: bool) -> None:
        armed = self.until is not None
        if not armed and (speed is None or abs(speed) < VERTICAL):
            self.base += FOLLOWS * rise
        self.watches(ms, rise, speed, gained, moved)
        if self.phase in ("boarding", "rising") and self.since is not None and ms - self.since >= STALL_MS:
            self.turn_to("cancelled", ms, "no vertical motion" if armed else "left alone")
        up = rise > 0
        if not armed or abs(rise) < OPENS_M or (self.rise(ms) or 0.0) * (1 if up else -1) < RAMP_M or not self.ramps(ms, up):
            return
        self.start, self.sign, self.start_steps, self.quiet_ms = ms, 1 if up else -1, self.steps, None
        board, _ = self.choose(up)
        if self.floor is None or board is None:
            self.cancel(ms, "no boarding point", rise)
        elif not self.has(board["to"]):
            self.cancel(ms, "unknown floor", rise, None, board["to"], board)
        else:
            self.board, self.to = board, board["to"]

    def watches(self, ms: int, rise: float, speed: float | None, gained: float, moved: bool) -> None:
        """Vertical motion, which begins a ride for whoever walks it."""
        if speed is None or abs(speed) < VERTICAL:
            self.up_ms, self.up_sign, self.moving, self.risen = None, 0, False, 0.0
            if self.early and self.phase == "rising":
                self.calm_ms = ms if self.calm_ms is None else self.calm_ms
                if ms - self.calm_ms >= QUIET_MS:
                    self.turn_to("cancelled", ms, "vertical motion ended")
            return
        self.calm_ms, sign = None, 1 if speed > 0 else -1
        if sign != self.up_sign:
            self.up_ms, self.up_sign, self.risen = ms, sign, gained
        else:
            self.risen += gained
        if ms - self.up_ms < VERTICAL_MS:
            return
        self.moving, up, risen = True, sign > 0, max(abs(rise), abs(self.risen))
        board = self.at or self.choose(up)[0]
        fits = board is not None and bool(board["up"]) == up
        if fits:
            away = self.watched.get(str(board["id"]), self.near.get(str(board["id"]), (None, None))[1])
            if (self.at is not None or (away is not None and away <= BOARDS_M)) and risen >= (0.0 if self.at_once and self.at is not None else AT_BOARDING_M):
                self.early = False
                self.turn_to("rising", ms, "up" if up else "down", board["to"], board, self.arrival if board["id"] == self.expected else None)
                return
        to = board["to"] if fits else self.next_floor(up)
        if risen >= SEEN_M and moved and to is not None:
            self.early, self.calm_ms = board is None, None
            self.turn_to("rising", ms, "up by altitude" if up else "down by altitude", to, board, None, rise)

    def rides(self, ms: int, rise: float, speed: float | None, stepped: bool) -> None:
        took = ms - self.start
        if rise * self.sign < OPENS_M / 2:
            return self.cancel(ms, "went back", rise)
        if abs(rise) >= TOO_FAR_M:
            return self.cancel(ms, "several floors", rise, self.level)
        if took > LONGEST_MS:
            return self.cancel(ms, "does not settle", rise, self.level)
        arrival = self.arrival if self.board["id"] == self.expected else None
        if not self.midway and abs(rise) >= MIDWAY_M:
            self.midway = True
            self.turn_to("midway", ms, "up" if self.sign > 0 else "down", self.to, self.board, arrival, rise)
        if took < LEAST_MS or abs(rise) < LANDS_M:
            return None
        if speed is None:
            landed = abs(self.rise(ms) if self.rise(ms) is not None else math.inf) <= SETTLED_M
        else:
            still = abs(speed) <= (STILL_STEP if stepped else STILL)
            self.quiet_ms = (ms if self.quiet_ms is None else self.quiet_ms) if still else None
            landed = still and (stepped or ms - self.quiet_ms >= QUIET_MS)
        if landed:
            board, to = self.board, self.to
            self.turn_to("landed", ms, "up" if self.sign > 0 else "down", to, board, arrival, rise)
            self.close()
            self.landed_on, self.base, self.settling, self.settled_ms = to, self.level, True, None
            self.near, self.watched, self.until = {}, {}, None
        return None

    def rise(self, ms: int) -> float | None:
        """The rise over a settle window."""
        then = [v for at, v in self.smooth if at <= ms - SETTLE_MS]
        return self.level - then[-1] if then else None

    def ramps(self, ms: int, up: bool) -> bool:
        """Whether strides of the window go one way only."""
        inside = [(at, v) for at, v in self.smooth if at >= ms - RAMP_MS]
        rises, last = [], inside[0]
        for at, v in inside[1:]:
            if at - last[0] >= STRIDE_MS:
                rises.append((v - last[1]) * (1 if up else -1))
                last = (at, v)
        return inside[-1][0] - inside[0][0] >= SETTLE_MS and sum(r >= STRIDE_M for r in rises) >= STRIDES and not any(r <= -STRIDE_M for r in rises)


def _boards(ids, banks, ups, tos, metres) -> list:
    return [({"id": i, "bank": b, "up": u, "to": t}, m) for i, b, u, t, m in zip(ids or (), banks or (), ups or (), tos or (), metres or (), strict=True) if m is not None]


def _ride(state: Ride | None, row: tuple) -> tuple[Ride, tuple]:
    ms, floor, floors, steps, moved, stepped, *near, route_m, expected, bank, up, to, arrival, at_once, altitude = row
    ride = state or Ride()
    if ms is None:
        return ride, ([], None, None, None, None, None, None, None, None, ride.phase)
    ride.told = []
    ride.moves_to(floor, floors)
    ride.steps = ride.steps if steps is None else steps
    ride.stands(ms, _boards(*near))
    if route_m is not None and expected is not None:
        ride.approaches(ms, route_m, {"id": expected, "bank": bank, "up": up, "to": to}, arrival, bool(at_once))
    ride.moves, ride.taken = ride.moves + (moved or 0) + (stepped or 0), ride.taken + (stepped or 0)
    evidence = ride.choose(ride.sign > 0)[1] if ride.start is not None else None
    walked = ride.steps - ride.start_steps
    if altitude is not None:
        ride.hears(ms, altitude)
    last = ride.told[-1] if ride.told else (None,) * 7
    landed = last[0] == "landed"
    delta = None if ride.level is None or ride.base is None else ride.level - ride.base
    return ride, ([f"{t[0]}: {t[1]}" for t in ride.told], last[2], last[3], last[4], last[5], last[6], delta, evidence if landed else None, walked if landed else None, ride.phase)


def _pack(ride: Ride | None) -> tuple:
    return (None if ride is None else json.dumps({k: v for k, v in vars(ride).items() if k != "told"}),)


def _unpack(values: tuple) -> Ride | None:
    return None if values[0] is None else Ride(**json.loads(values[0]))


#: A session's rides.  Rows without a time say nothing; each other value may be missing.
RIDE = Kernel(
    "ms long, floor string, floors array<string>, steps long, moved int, stepped int, near_ids array<long>, near_banks array<string>, near_ups array<boolean>, near_tos array<string>, near_metres array<double>, "
    "route_m double, expected long, expected_bank string, expected_up boolean, expected_to string, arrival long, at_once boolean, altitude double",
    "ride string",
    "changes array<string>, to_floor string, bank string, board long, arrives long, rise double, delta double, evidence string, steps_during long, phase string",
    _ride,
    _pack,
    _unpack,
)

_NEAR = ("near_ids", "near_banks", "near_ups", "near_tos", "near_metres")


def near_boarding(samples: DataFrame, boards: DataFrame, key: list[str], reach: float = NEAR_M) -> DataFrame:
    """samples with the boarding points of their building and floor within reach, nearest first.

    samples: key, building, floor, x, y; boards: building, floor, id, bank, up, to_floor, x, y.
    Both sides are dealt into square cells of the reach's side, and a sample looks
    into its own and the eight around.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    points = boards.select("building", "floor", "id", "bank", "up", "to_floor", F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.struct((k % 3 - 1).alias("dx"), (F.floor(k / 3) - 1).alias("dy"))))
    asked = samples.select(*key, "building", "floor", "x", "y").where("x is not null and y is not null").withColumn("d", around)
    asked = asked.withColumns({"cx": cell("x") + F.col("d.dx"), "cy": cell("y") + F.col("d.dy")})
    met = asked.join(points, ["building", "floor", "cx", "cy"]).withColumn("metres", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).where(F.col("metres") <= reach)
    found = met.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("metres", "id", "bank", "up", "to_floor"))).alias("near"))
    columns = dict(zip(_NEAR, ("near.id", "near.bank", "near.up", "near.to_floor", "near.metres"), strict=True))
    return samples.join(found, key, "left").withColumns({name: F.col(c) for name, c in columns.items()}).drop("near")


def rides(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the landed rides: order, to_floor, bank, board, arrives, rise, evidence, steps_during."""
    return changes.where(F.exists("changes", lambda c: c.startswith("landed"))).select(key, order, "to_floor", "bank", "board", "arrives", "rise", "evidence", "steps_during")
