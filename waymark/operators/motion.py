"""Step functions of walking sensors and of what a guide shows; each is a Kernel for a table or a stream."""

from __future__ import annotations

import math

from waymark.operators.stateful import Kernel


def _turn(a: float, b: float) -> float:
    """The shortest turn from a to b, in [-180, 180), by the operations of SQL, so that a turn right at a bound is the same there."""
    return math.fmod(math.fmod(b - a + 180.0, 360.0) + 360.0, 360.0) - 180.0


# Time constants of the heading in seconds, and the longest time between samples that counts.
SHAKY_S, STEADY_S, LONGEST_S = 0.60, 0.10, 0.5


def _smooth(state, row):
    ms, heading, stable = row
    if heading is None:
        return state or (None, None), (state[1] if state else None,)
    if state is None or state[1] is None:
        return (ms, heading % 360.0), (heading % 360.0,)
    passed = min(LONGEST_S, max(0.0, (ms - state[0]) / 1000.0))
    share = 1.0 - math.exp(-passed / (STEADY_S if stable else SHAKY_S))
    now = (state[1] + _turn(state[1], heading) * share) % 360.0
    return (ms, now), (now,)


#: Heading smoothed along the shorter turn: quickly while stable, slowly while not; samples without one keep the last.
HEADING = Kernel("ms long, heading double, stable boolean", "ms long, at double", "smooth double", _smooth)

# Fixed values of the step detector: how fast bounds close in, the least swing, where it fires and arms again, and the pause in ms.
CLOSING, LEAST_SWING, FLOOR, FIRES, ARMS, PAUSE_MS = 0.007, 0.03, 0.06, 0.55, 0.30, 380.0


def _peak(state, row):
    ms, size = row
    if size is None:
        return state or (None, None, False, None), (False,)
    top, bottom, armed, last = state or (None, None, False, None)
    if top is None:
        top = bottom = size
    else:
        top = max(size, top + CLOSING * (size - top))
        bottom = min(size, bottom + CLOSING * (size - bottom))
    swing = top - bottom
    if swing < LEAST_SWING:
        return (top, bottom, True, last), (False,)
    fires = armed and size > max(FLOOR, bottom + FIRES * swing) and (last is None or ms - last > PAUSE_MS)
    if fires:
        return (top, bottom, False, ms), (True,)
    return (top, bottom, armed or size < bottom + ARMS * swing, last), (False,)


#: Steps as peaks of acceleration over a moving envelope, with hysteresis and a pause.
STEP_PEAKS = Kernel("ms long, size double", "top double, bottom double, armed boolean, last long", "peak boolean", _peak)

# Fixed values of the stride in metres: its first value, its bounds, the largest change at once, and how much of it counts (first ten steps, later).
FIRST_M, LEAST_M, MOST_M, CHANGE, EARLY, LATE, EARLY_STEPS = 0.70, 0.35, 1.20, 0.20, 0.45, 0.20, 10


def _by_distance(steps, more, metres, last_steps, last_metres):
    if metres is None:
        return None
    if last_metres is None:
        return metres / more if steps == more and metres > 0 else None
    if steps - last_steps != more or metres <= last_metres:
        return None
    return (metres - last_metres) / more


def _stride(state, row):
    steps, more, metres, cadence, pace = row
    at, last_steps, last_metres, walked = state or (FIRST_M, None, None, 0)
    valid = lambda m: m if m is not None and LEAST_M <= m <= MOST_M else None
    if not more or more < 0:
        base = (steps, metres) if metres is not None else (last_steps, last_metres)
        return (at, *base, walked), (at, "none")
    measured, source = valid(_by_distance(steps, more, metres, last_steps, last_metres)), "distance"
    if measured is None:
        measured, source = (valid(1.0 / (pace * cadence)) if cadence and pace and cadence > 0 and pace > 0 else None), "cadence"
    if measured is None:
        measured, source = FIRST_M, "fixed"
    near = min(at * (1 + CHANGE), max(at * (1 - CHANGE), measured))
    at = min(MOST_M, max(LEAST_M, at + (near - at) * (EARLY if walked < EARLY_STEPS else LATE)))
    if metres is not None:
        last_steps, last_metres = steps, metres
    return (at, last_steps, last_metres, walked + more), (at, source)


#: Stride from measured distance, else from cadence and pace, else fixed; changes are bounded and damped.
STRIDE = Kernel("steps long, more long, metres double, cadence double, pace double", "at double, last_steps long, last_metres double, walked long", "stride double, source string", _stride)


def _batches(state, row):
    part, steps, windowed = row
    last_part, last_steps = state or (None, None)
    if part is None or steps is None or (last_part is not None and part < last_part):
        return (last_part, last_steps), (None,)
    if part != last_part:
        return (part, steps), (max(0, steps) if windowed else 0,)
    return (part, steps), (max(0, steps - last_steps),)


#: New steps of cumulative counters: an older counting session is late and drops (null), a new one counts in full if its start is known.
STEP_BATCHES = Kernel("part long, steps long, windowed boolean", "part long, steps long", "more long", _batches)


def hysteresis(on: float, off: float) -> Kernel:
    """A switch that goes on above one level and off again at or below another; missing levels keep it."""

    def step(state, row):
        (level,) = row
        now = bool(state and state[0])
        if level is not None:
            now = level > (off if now else on)
        return (now,), (now,)

    return Kernel("level double", "on_ boolean", "on_ boolean", step)


def kept_after(metres: float) -> Kernel:
    """Whether a position is the first or this far from the last kept one."""

    def step(state, row):
        x, y = row
        if x is None or y is None:
            return state or (None, None), (False,)
        keep = state is None or state[0] is None or math.hypot(x - state[0], y - state[1]) >= metres
        return ((x, y) if keep else state), (keep,)

    return Kernel("x double, y double", "x double, y double", "kept boolean", step)


def throttle(ms: int, degrees: float) -> Kernel:
    """Whether a heading is sent: the first, then with this much time and turn since the last one sent."""

    def step(state, row):
        at, heading = row
        if heading is None:
            return state or (None, None), (False,)
        send = state is None or state[0] is None or (at - state[0] >= ms and abs(_turn(state[1], heading)) >= degrees)
        return ((at, heading) if send else state), (send,)

    return Kernel("ms long, heading double", "at long, heading double", "sent boolean", step)


def heartbeat(ms: int) -> Kernel:
    """Whether a sample is recorded: it differs from the last recorded one, or this much time has passed."""

    def step(state, row):
        at, kind = row
        keep = state is None or state[1] != kind or at - state[0] >= ms
        return ((at, kind) if keep else state), (keep,)

    return Kernel("ms long, kind string", "at long, kind string", "recorded boolean", step)


#: Fixed value: metres around a door within which it is reached.
DOOR_M = 15.0


def _door(state, row):
    (metres,) = row
    left = bool(state and state[0])
    if metres is None:
        return (left,), (False, "unknown")
    if metres > DOOR_M:
        return (True,), (False, "away")
    return (left,), (left, "reached" if left else "never left")


#: Evidence of leaving by a door: its zone must be left first, then reached again.
DOOR = Kernel("metres double", "left boolean", "reached boolean, reason string", _door)

# Steps and metres that confirm a change of direction.
CONFIRM_STEPS, CONFIRM_M = 3, 1.2


def _direction(state, row):
    """Relations are forward, reverse, off, or anything else, which says nothing."""
    peak, relation, metres = row
    now, last, count, sum_m = state or ("forward", None, 0, 0.0)
    if peak is None or peak == last or relation not in ("forward", "reverse", "off"):
        return (now, last, count, sum_m), (now,)
    if relation == "off":
        return ("off", peak, 0, 0.0), ("off",)
    m = abs(metres or 0.0)
    opposite = "reverse" if relation == "forward" else "forward"
    if now == relation:
        count, sum_m = 0, 0.0
    elif now == relation + "?":
        count, sum_m = count + 1, sum_m + m
    elif now == opposite + "?":
        now, count, sum_m = relation, 0, 0.0
    else:
        now, count, sum_m = relation + "?", 1, m
    if now.endswith("?") and count >= CONFIRM_STEPS and sum_m >= CONFIRM_M:
        now, count, sum_m = relation, 0, 0.0
    return (now, peak, count, sum_m), (now,)


#: Direction along a route: a change is a candidate (with ?) until enough distinct steps confirm it, or one against it ends it.
DIRECTION = Kernel("peak long, relation string, metres double", "now string, last long, count long, sum_m double", "direction string", _direction)

# Fixed values of checkpoints: a strong turn's range, a straight way's most, the spacing of straight ones.
STRONG, STRAIGHT, SPACING_M = (35.0, 150.0), 20.0, 9.0


def _checkpoint(state, row):
    turn, ways, metres = row
    last = state[0] if state else 0.0
    if turn is None or metres is None:
        return (last,), (None,)
    kind = "turn" if STRONG[0] <= abs(turn) <= STRONG[1] else "straight" if abs(turn) <= STRAIGHT and ways == 2 and metres - last >= SPACING_M else None
    return (metres if kind else last,), (kind,)


#: Nodes of a route that can confirm a position: strong turns, and straight ways apart from the last checkpoint.
CHECKPOINTS = Kernel("turn double, ways long, metres double", "last double", "kind string", _checkpoint)

# Fixed values of a trail in metres: the same point, what is joined, what breaks it.
SAME_M, BREAK_M = 0.05, 3.0


def _trail(state, row):
    x, y = row
    if x is None or y is None:
        return state or (None, None, 0), (None, False)
    if state is None or state[0] is None:
        return (x, y, 0), (0, True)
    far = math.hypot(x - state[0], y - state[1])
    part = state[2] + (far > BREAK_M)
    return ((x, y, part) if far > SAME_M else state), (part, far > SAME_M)


#: A trail's parts: jumps begin a new one, and points where the last kept one is drop.
TRAIL = Kernel("x double, y double", "x double, y double, part long", "part long, kept boolean", _trail)

# Fixed values of the jump filter: metres and metres a second that a walker can explain, rejects and ms after which it gives in, ms without a fix that say nothing.
SLACK_M, SPEED_M_S, REJECTS, GIVES_IN_MS, SILENT_MS = 15.0, 3.5, 5, 10_000, 15_000


def _jump(state, row):
    """State: the accepted fix, fixes rejected since, and the time of the first of them."""
    ms, x, y, walking = row
    if ms is None or x is None or y is None:
        return state or (None, None, None, 0, None), (False, False)
    accept = lambda gave_in: ((ms, x, y, 0, None), (True, gave_in))
    if not walking or state is None or state[0] is None:
        return accept(False)
    last, x0, y0, rejects, since = state
    passed = max(0, ms - last)
    if (rejects == 0 and passed > SILENT_MS) or math.hypot(x - x0, y - y0) <= SLACK_M + SPEED_M_S * passed / 1000.0:
        return accept(False)
    since = ms if since is None else since
    if rejects + 1 >= REJECTS or ms - since >= GIVES_IN_MS:
        return accept(True)
    return (last, x0, y0, rejects + 1, since), (False, False)


#: Fixes that a walker can have made; a row of rejects, the last one counted, ends the filter's trust in the accepted fix.
GPS_JUMP = Kernel("ms long, x double, y double, walking boolean", "ms long, x double, y double, rejects long, since long", "accepted boolean, gave_in boolean", _jump)

# Fixed values of shown progress in metres: slack and metres a step that explain a jump, and how far back it may go unconfirmed.
JUMP_SLACK_M, STEP_M, FREE_BACK_M = 3.0, 1.2, 2.0


def _progress(state, row):
    travelled, steps, reverse = row
    if travelled is None:
        return state or (None, None), ("none", state[0] if state else None)
    if state is not None and state[0] is not None:
        at, at_steps = state
        if at_steps is not None and steps is not None and abs(travelled - at) > JUMP_SLACK_M + max(0, steps - at_steps) * STEP_M:
            return state, ("jump", at)
        if at - travelled > FREE_BACK_M and not reverse:
            return state, ("back", at)
    return (travelled, steps), ("shown", travelled)


#: Progress along a route as shown: what steps cannot explain is held, as is going back until a reverse walk is confirmed.
PROGRESS = Kernel("travelled double, steps long, reverse boolean", "travelled double, steps long", "verdict string, shown double", _progress)

#: Fixed value: metres by which another entrance must be nearer to replace the held one.
SWITCH_M = 15.0


def _entrance(state, row):
    x, y, door, door_x, door_y = row
    if x is None or y is None or door is None:
        return state or (None, None, None), (state[0] if state else None,)
    best = door, door_x, door_y
    if state is None or state[0] is None or state[0] == door:
        return best, (door,)
    nearer = math.hypot(x - state[1], y - state[2]) - math.hypot(x - door_x, y - door_y)
    return (best, (door,)) if nearer > SWITCH_M else (state, (state[0],))


#: The entrance that is used: the nearest, once it is nearer by a margin than the held one.
ENTRANCE = Kernel("x double, y double, door long, door_x double, door_y double", "door long, x double, y double", "used long", _entrance)


def smoothed(keep: float) -> Kernel:
    """An exponential mean that keeps this much of what it was; missing values keep it."""

    def step(state, row):
        (value,) = row
        if value is None:
            return state or (None,), (state[0] if state else None,)
        now = value if state is None or state[0] is None else keep * state[0] + (1 - keep) * value
        return (now,), (now,)

    return Kernel("value double", "mean double", "mean double", step)


def sent_after(ms: int) -> Kernel:
    """Whether a sample is sent: the first, then with this much time since the last one sent."""

    def step(state, row):
        (at,) = row
        send = state is None or state[0] is None or at - state[0] >= ms
        return ((at,) if send else state), (send,)

    return Kernel("ms long", "at long", "sent boolean", step)


# Fixed values of altitudes: time constant in ms, how much of a difference the baseline follows, ms without a sample that begin anew.
FAST_MS, FOLLOWS, ANEW_MS = 300.0, 0.02, 15_000


def _altitude(state, row):
    ms, metres = row
    if ms is None or metres is None:
        return state or (None, None, None), (None, None)
    if state is None or state[0] is None or ms - state[0] > ANEW_MS:
        return (ms, metres, metres), (metres, 0.0)
    last, fast, base = state
    fast += (metres - fast) * (1.0 - math.exp(-max(0, ms - last) / FAST_MS))
    delta = fast - base
    return (ms, fast, base + FOLLOWS * delta), (fast, delta)


#: Altitude smoothed by time, and its rise over a baseline that follows the weather while nobody rides.
ALTITUDE = Kernel("ms long, metres double", "ms long, fast double, base double", "fast double, delta double", _altitude)


# Fixed values of the walk's offset: confidence it needs, time constants in seconds of following and of forgetting, its most, the turn that holds it and for how long.
SURE, FOLLOW_S, FORGET_S, OFFSET_DEG, TURNING_DEG, TURNED_MS = 0.35, 2.5, 12.0, 60.0, 20.0, 1_500


def _offset(state, row):
    ms, swinging, net, walk, sure, heading = row
    last, offset, held = state or (None, 0.0, None)
    if ms is None:
        return (last, offset, held), (offset, False)
    passed = 0.0 if last is None else max(0, ms - last) / 1000.0
    if net is not None and net > TURNING_DEG:
        held = ms + TURNED_MS
    if not swinging:
        return (ms, offset * math.exp(-passed / FORGET_S), held), (offset * math.exp(-passed / FORGET_S), False)
    if (held is not None and ms < held) or sure is None or sure < SURE or walk is None or heading is None:
        return (ms, offset, held), (offset, False)
    # the way that is walked has no front: its nearer end is meant
    now = (heading + offset) % 360.0
    ahead = walk % 360.0 if abs(_turn(now, walk)) <= abs(_turn(now, walk + 180.0)) else (walk + 180.0) % 360.0
    wanted = _turn(heading, ahead)
    offset = _turn(0.0, offset + _turn(offset, wanted) * (1.0 - math.exp(-passed / FOLLOW_S)))
    offset = max(-OFFSET_DEG, min(OFFSET_DEG, offset))
    return (ms, offset, held), (offset, True)


#: How far a swinging phone points beside the way its owner walks: it follows sure directions, forgets without swinging and is held in turns.
WALK_OFFSET = Kernel("ms long, swinging boolean, net double, walk double, sure double, heading double", "ms long, offset double, held long", "offset double, active boolean", _offset)
