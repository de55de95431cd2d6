"""Steps shown before they are confirmed, what a later batch makes of them, and the part of a batch that was tracked."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.stateful import Kernel

# Steps and metres that a preview may lead, also before anything is confirmed; ms between peaks of a walk, and shares of the cadence's interval.
LEAD_STEPS, LEAD_M, FIRST_STEPS, FIRST_M, DENSE_MS, SPARSE_MS, CADENCE = 12, 10.0, 30, 24.0, 300, 1_100, (0.45, 2.60)
# Ms by which confirmation may lag without a cap, peaks that wait, strides that can be, and the one if there is none.
LAG_MS, WAITING, STRIDES_M, STRIDE_M, LEAST_HZ = 8_000, 40, (0.35, 1.20), 0.70, 0.2


def _interval(peak_ms: int, last_ms: int | None, cadence: float | None) -> str | None:
    """What is odd about a peak's interval; it is told, the peak counts."""
    if last_ms is None:
        return None
    passed = peak_ms - last_ms
    if passed < DENSE_MS:
        return "dense"
    if passed > SPARSE_MS:
        return "sparse"
    if cadence is not None and cadence > LEAST_HZ and not CADENCE[0] * 1000.0 / cadence <= passed <= CADENCE[1] * 1000.0 / cadence:
        return "cadence"
    return None


def _leads(state: list, stride: float, now: int, steps: int, metres: float, through: int | None) -> str | None:
    """Why one more step would lead too far."""
    if through is not None:
        if now - through <= LAG_MS:
            return None
        ahead, far, (most, most_m) = len(state[3]), sum(p[1] for p in state[3]), (LEAD_STEPS, LEAD_M)
    else:
        ahead, far = state[4] - (steps or 0), state[5] - (metres or 0.0)
        most, most_m = LEAD_STEPS if steps else FIRST_STEPS, LEAD_M if (metres or 0.0) > 0 else FIRST_M
    return "steps" if ahead + 1 > most else "metres" if far + stride > most_m else None


def _preview(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
    """State: last count, last peak, peaks that wait (ms, heading), shown ones that are not confirmed (ms, metres), steps, metres, x, y."""
    count, peak_ms, tracking, heading, stride, steps, metres, through, cadence = row
    s = [None, None, [], [], 0, 0.0, 0.0, 0.0] if state is None else [*state[:2], list(state[2]), list(state[3]), *state[4:]]
    if through is not None:
        s[3] = [p for p in s[3] if p[0] > through]

    def told(reason, shown=()):
        return tuple(s), ([p[0] for p in shown], [p[1] for p in shown], [p[2] for p in shown], reason, len(s[2]), s[4], s[5], s[6], s[7], len(s[3]), sum(p[1] for p in s[3]))

    if count is None:
        return told(None)
    last, s[0] = s[0], count
    if last is None or count < last:  # counting begins, or began anew
        s[1] = peak_ms if peak_ms is not None else s[1]
        return told("begin")
    if count == last:
        return told(None)
    if peak_ms is None:
        return told("no time")
    if not tracking or heading is None:
        s[1], s[2] = peak_ms, []
        return told("no heading" if tracking else "not tracking")
    odd, s[1] = _interval(peak_ms, s[1], cadence), peak_ms
    stride = stride if stride is not None and STRIDES_M[0] <= stride <= STRIDES_M[1] else STRIDE_M
    s[2] += [(peak_ms, heading)] * min(count - last, WAITING)
    lost, s[2] = len(s[2]) > WAITING or count - last > WAITING, s[2][-WAITING:]
    shown, why = [], None
    while s[2] and not (why := _leads(s, stride, peak_ms, steps, metres, through)):
        at, turned = s[2].pop(0)
        s[6], s[7] = s[6] + stride * math.sin(math.radians(turned)), s[7] + stride * math.cos(math.radians(turned))
        s[3].append((at, stride))
        s[4], s[5] = s[4] + 1, s[5] + stride
        shown.append((at, s[6], s[7]))
    return told(f"waits: {why}" if s[2] else "overflow" if lost else odd, shown)


#: Peaks that are shown as steps at once, unless they would lead what is confirmed too far: then they wait, first in, first out.
PREVIEW = Kernel(
    "count long, peak_ms long, tracking boolean, heading double, stride double, steps long, metres double, through long, cadence double",
    "held string",
    "shown array<long>, shown_xs array<double>, shown_ys array<double>, reason string, waiting int, steps long, metres double, x double, y double, ahead int, ahead_m double",
    _preview,
    lambda state: (None if state is None else json.dumps(state),),
    lambda values: None if values[0] is None else tuple(json.loads(values[0])),
)


def reconciled(samples: DataFrame, batches: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """key, seq, x, y, ahead, ahead_m, taken_back: each sample's place is its last batch's, and the shown steps after that batch's end.

    samples: key, seq, ms; batches: key, ms (arrival), through, x, y; steps: key, ms,
    dx, dy, metres.  Steps up to ``through`` are confirmed by their batch and go,
    so a batch moves a place by what it takes back: its own place less the steps
    that it confirms.  One pass of running sums a key; a sample before the first
    batch starts from 0.
    """
    none = lambda kind: F.lit(None).cast(kind)
    moved = steps.select(key, F.col("ms").alias("at"), F.lit(0).alias("kind"), none("long").alias("seq"), none("long").alias("arrives"), none("double").alias("x"), none("double").alias("y"), "dx", "dy", "metres", F.lit(1).alias("n"))
    still = [F.lit(0.0).alias(c) for c in ("dx", "dy", "metres")] + [F.lit(0).alias("n")]
    ends = batches.select(key, F.col("through").alias("at"), F.lit(1).alias("kind"), none("long").alias("seq"), F.col("ms").alias("arrives"), "x", "y", *still)
    so_far = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = ("dx", "dy", "metres", "n")
    # what was shown up to each batch's end
    ended = moved.unionByName(ends).withColumns({f"{c}_sum": F.sum(c).over(so_far) for c in sums}).where("kind = 1")
    base = ended.select(key, F.col("arrives").alias("at"), F.lit(1).alias("kind"), none("long").alias("seq"), *still, F.struct("at", "x", "y", *(f"{c}_sum" for c in sums)).alias("batch"))
    asked = samples.select(key, F.col("ms").alias("at"), F.lit(2).alias("kind"), "seq", *still, none(dict(base.dtypes)["batch"]).alias("batch"))
    walked = moved.drop("arrives", "x", "y").withColumn("batch", none(dict(base.dtypes)["batch"]))
    by = Window.partitionBy(key).orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = walked.unionByName(base).unionByName(asked).withColumns({f"{c}_sum": F.sum(c).over(by) for c in sums}).withColumn("batch", F.last("batch", ignorenulls=True).over(by))
    ahead = lambda c: F.col(f"{c}_sum") - F.coalesce(F.col(f"batch.{c}_sum"), F.lit(0))
    placed = rows.where("kind = 2").select(key, "seq", "at", F.col("batch.at").alias("through"), (F.coalesce("batch.x", F.lit(0.0)) + ahead("dx")).alias("x"), (F.coalesce("batch.y", F.lit(0.0)) + ahead("dy")).alias("y"), ahead("n").alias("ahead"), ahead("metres").alias("ahead_m"), "dx_sum", "dy_sum")
    before = Window.partitionBy(key).orderBy("at", "seq")
    gone = lambda c: F.col(c) - F.lag(c).over(before) - (F.col(f"d{c}_sum") - F.lag(f"d{c}_sum").over(before))
    back = F.coalesce(F.hypot(gone("x"), gone("y")), F.lit(0.0))
    return placed.select(key, "seq", "x", "y", "ahead", "ahead_m", back.alias("taken_back"))


def tracked_part(batches: DataFrame, turns: DataFrame, key: str, first_on: Column) -> DataFrame:
    """key, batch, kept, fraction, from_ms, to_ms, peaks: the steps of each batch that were walked while tracking was on.

    batches: key, batch, steps, a, b, peaks (times, or null), on (tracking now, for a
    batch without a span); turns: key, at, on.  By the peaks of (a, b] that were on,
    else by the time that was; whole steps, so what is kept and what is not add up.
    States are running last values over turns, spans and peaks in one order; no
    batch meets the turns of others.
    """
    split = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("b") > F.col("a"))
    spans = batches.where(split)
    by = Window.partitionBy(key).orderBy("at", "kind")
    switched = turns.select(key, "at", "on").withColumn("was", F.coalesce(F.lag("on").over(Window.partitionBy(key).orderBy("at")), first_on)).select(key, "at", F.lit(0).alias("kind"), "on", "was", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("string").alias("what"))
    asks = lambda column, kind, what: spans.select(key, column.alias("at"), F.lit(kind).alias("kind"), F.lit(None).cast("boolean").alias("on"), F.lit(None).cast("boolean").alias("was"), "batch", F.lit(what).alias("what"))
    inside = F.filter("peaks", lambda p: (p > F.col("a")) & (p <= F.col("b")))
    peaks = spans.select(key, "batch", F.explode(inside).alias("at")).select(key, F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("boolean").alias("on"), F.lit(None).cast("boolean").alias("was"), "batch", F.lit("peak").alias("what"))
    # a turn at a span's beginning counts, one at its end does not
    events = switched.unionByName(asks(F.col("a"), 2, "a")).unionByName(asks(F.col("b"), -1, "b")).unionByName(peaks)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)  # what follows, without a frame to the end
    known = events.withColumn("state", F.coalesce(F.last("on", ignorenulls=True).over(so_far), first_on))
    lasted = F.when(F.coalesce(F.lag("state").over(by), first_on), F.col("at") - F.lag("at").over(by)).otherwise(0)
    known = known.withColumn("lasted", F.coalesce(lasted, F.lit(0))).withColumns(
        {"total": F.sum("lasted").over(so_far), "off_at": F.last(F.when((F.col("on") == F.lit(False)) & F.col("was"), F.col("at")), ignorenulls=True).over(so_far), "on_at": F.last(F.when(F.col("on"), F.col("at")), ignorenulls=True).over(later)}
    )
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    sides = known.where("what in ('a', 'b')").groupBy(key, "batch").agg(*(of(w, c).alias(f"{c}_{w}") for w in "ab" for c in ("total", "state", "off_at", "on_at")))
    counted = known.where("what = 'peak'").groupBy(key, "batch").agg(F.count("*").alias("n_peaks"), F.sum(F.col("state").cast("int")).alias("n_on"), F.sort_array(F.collect_list(F.when(F.col("state"), F.col("at")))).alias("on_peaks"))
    met = batches.join(sides, [key, "batch"], "left").join(counted, [key, "batch"], "left")
    by_time = (F.col("total_b") - F.col("total_a")) / (F.col("b") - F.col("a"))
    fraction = F.when(~split | F.col("a").isNull() | F.col("b").isNull(), F.col("on").cast("double")).otherwise(F.when(F.coalesce("n_peaks", F.lit(0)) > 0, F.col("n_on") / F.col("n_peaks")).otherwise(by_time))
    met = met.withColumn("fraction", fraction).withColumn("kept", F.least(F.col("steps"), F.round(F.col("steps") * F.col("fraction"))).cast("long"))
    cut_short = split & (F.col("kept") < F.col("steps"))
    start = F.when(F.col("state_a"), F.col("a")).when(F.col("on_at_a") < F.col("b"), F.col("on_at_a"))
    end = F.when(F.col("state_b"), F.col("b")).when(F.col("off_at_b") > F.col("a"), F.col("off_at_b"))
    both = start.isNotNull() & end.isNotNull()
    return met.select(
        key, "batch", "kept", "fraction", F.when(cut_short & both, start).otherwise(F.col("a")).alias("from_ms"), F.when(cut_short & both, end).otherwise(F.col("b")).alias("to_ms"),
        F.when(cut_short & F.col("on_peaks").isNotNull(), F.col("on_peaks")).otherwise(F.col("peaks")).alias("peaks"),
    )
