"""Queries over sensor samples: windows, spans, and keyed state in tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import motion, sequences, stateful
from waymark.plans.queries import SAMPLES, query
from waymark.sources import tables as t
from waymark.streaming import runs


def _by():
    return Window.partitionBy("session").orderBy("seq")


def _so_far():
    return _by().rowsBetween(Window.unboundedPreceding, 0)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """samples with tick: the table's hours told as seconds, in ms."""
    return t.samples(spark, d).withColumn("tick", F.floor(F.col("ms") / 40000).cast("long"))


TIMED = SAMPLES.replace("value from events", "value, epoch_us(ts) // 40000000 as tick from events")
ORDERED = TIMED + ", o as (select *, row_number() over (partition by session order by seq) as rn from samples)"


def folded(first: str, next_: str, told: str, rows: str = ORDERED) -> str:
    """SQL that carries a state s from each session's row o to the next."""
    return f"""with recursive {rows}, r as (select session, seq, rn, {first} as s from o where rn = 1
  union all select o.session, o.seq, o.rn, {next_} from r join o on o.session = r.session and o.rn = r.rn + 1) select session, seq, {told} from r"""


@query(f"with {TIMED} select session, seq, round(case when count(*) over r >= 3 then median(value) over r else median(value) over n end, 6) as middle from samples window r as (partition by session order by tick range between 3000 preceding and current row), n as (partition by session order by seq rows between 2 preceding and current row)")
def sliding_median_altitude(spark, d):
    """Median of the last three seconds, but of three samples at least."""
    timed = Window.partitionBy("session").orderBy("tick").rangeBetween(-3000, 0)
    middle = F.when(F.count("*").over(timed) >= 3, F.percentile("value", 0.5).over(timed)).otherwise(F.percentile("value", 0.5).over(_by().rowsBetween(-2, 0)))
    return _rows(spark, d).select("session", "seq", F.round(middle, 6).alias("middle"))


@query(f"""with {TIMED}, ends as (select session, seq, tick as b, lag(tick) over (partition by session order by seq) as a from samples where kind = 'purchase'),
turns as (select session, tick as s, lead(tick) over (partition by session order by seq) as e, kind = 'click' as tracked from samples where kind in ('click', 'error'))
select n.session, n.seq, round(coalesce(sum(greatest(0, least(coalesce(e, b), b) - greatest(s, a))) filter (tracked), 0) / (b - a), 6) as fraction
from ends n left join turns t on t.session = n.session and t.s < b and coalesce(t.e, b) > a where b > a group by n.session, n.seq, a, b""")
def interval_overlap(spark, d):
    """The part of each span between purchases during which tracking was on: on from a click, off from an error.

    One pass: time tracked so far is a running sum, and a span's share is its rise.
    """
    rows = _rows(spark, d)
    turned = F.when(F.col("kind") == "click", 1).when(F.col("kind") == "error", 0)
    state = F.coalesce(F.last(turned, ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passed = rows.withColumn("tracked", state * F.coalesce(F.col("tick") - F.lag("tick").over(_by()), F.lit(0)))
    ends = passed.withColumn("total", F.sum("tracked").over(_so_far())).where("kind = 'purchase'")
    spans = ends.select("session", "seq", (F.col("total") - F.lag("total").over(_by())).alias("on"), (F.col("tick") - F.lag("tick").over(_by())).alias("length"))
    return spans.where("length > 0").select("session", "seq", F.round(F.col("on") / F.col("length"), 6).alias("fraction"))


@query(f"""with {TIMED}, ends as (select session, seq, lag(seq) over (partition by session order by seq) as before from samples where kind = 'purchase')
select n.session, n.seq, count(p.seq) as peaks from ends n left join samples p on p.session = n.session and p.kind = 'view' and p.seq < n.seq and p.seq > coalesce(n.before, -1) group by all""")
def batch_peak_count(spark, d):
    """Peaks since the batch before."""
    rows = _rows(spark, d).withColumn("peaks", F.count(F.when(F.col("kind") == "view", 1)).over(_so_far())).where("kind = 'purchase'")
    return rows.select("session", "seq", (F.col("peaks") - F.coalesce(F.lag("peaks").over(_by()), F.lit(0))).alias("peaks"))


@query(f"""with {TIMED}, m as (select *, coalesce((floor(value / 40) <> floor(lag(value) over w / 40))::int, 0) as moved from samples window w as (partition by session order by seq)),
g as (select *, sum(moved) over (partition by session order by seq rows between unbounded preceding and current row) as held from m), h as (select session, held, max(tick) - min(tick) as ms from g group by all)
select session, max(ms) as longest, count(*) as places from h group by session""")
def stall_duration(spark, d):
    """The longest stay at one place, and the number of stays."""
    place = F.floor(F.col("value") / 40)
    moved = F.coalesce((place != F.lag(place).over(_by())).cast("int"), F.lit(0))
    held = _rows(spark, d).withColumn("moved", moved).withColumn("held", F.sum("moved").over(_so_far()))
    stays = held.groupBy("session", "held").agg((F.max("tick") - F.min("tick")).alias("ms"))
    return stays.groupBy("session").agg(F.max("ms").alias("longest"), F.count("*").alias("places"))


@query(f"with {TIMED} select session, count(*) as samples, round(avg((kind = 'view')::int), 6) as on_route, max(value) as farthest, arg_min(value, seq) as first, arg_max(value, seq) as last from samples group by session")
def route_progress_summary(spark, d):
    on = (F.col("kind") == "view").cast("int")
    return _rows(spark, d).groupBy("session").agg(
        F.count("*").alias("samples"), F.round(F.avg(on), 6).alias("on_route"), F.max("value").alias("farthest"), F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last")
    )


@query(f"""with {TIMED}, c as (select session, count(*) filter (kind = 'view') as peaks, sum(value) filter (kind = 'purchase') as steps, count(*) filter (kind = 'error' and value > 20) as bad from samples group by session)
select session, peaks, round(coalesce(steps, 0), 4) as steps, case when bad > 3 then 'degraded' when peaks > coalesce(steps, 0) * 0.1 then 'caution' else 'good' end as quality from c""")
def undercount_scan(spark, d):
    """Counts of peaks and steps in one pass, and what they say of a session."""
    when = lambda kind, value: F.when(F.col("kind") == kind, value)
    sums = _rows(spark, d).groupBy("session").agg(
        F.count(when("view", 1)).alias("peaks"), F.coalesce(F.sum(when("purchase", F.col("value"))), F.lit(0.0)).alias("steps"), F.count(when("error", F.when(F.col("value") > 20, 1))).alias("bad")
    )
    quality = F.when(F.col("bad") > 3, "degraded").when(F.col("peaks") > F.col("steps") * 0.1, "caution").otherwise("good")
    return sums.select("session", "peaks", F.round("steps", 4).alias("steps"), quality.alias("quality"))


@query(f"""with {TIMED}, h as (select *, coalesce(last_value(case when kind = 'view' then value end ignore nulls) over w, 0) as heading from samples window w as (partition by session order by seq rows between unbounded preceding and current row))
select session, seq, round(sum(sin(radians(heading)) * 0.7) over w, 4) as east, round(sum(cos(radians(heading)) * 0.7) over w, 4) as north from h where kind <> 'view' window w as (partition by session order by seq rows between unbounded preceding and current row)""")
def dead_reckoning(spark, d):
    """Positions by steps of 0.7 m in the last known heading: running sums, since each step only adds."""
    rows = sequences.last_known(_rows(spark, d), "session", ["seq"], F.when(F.col("kind") == "view", F.col("value")), "heading")
    angle = F.radians(F.coalesce("heading", F.lit(0.0)))
    steps = rows.withColumn("e", F.sin(angle) * 0.7).withColumn("n", F.cos(angle) * 0.7).where("kind <> 'view'")
    return steps.select("session", "seq", F.round(F.sum("e").over(_so_far()), 4).alias("east"), F.round(F.sum("n").over(_so_far()), 4).alias("north"))


@query(f"""with {TIMED}, p as (select session, seq, value as e, value * value / 500 + seq % 7 as n from samples),
c as (select session, seq, var_pop(e) over w as ee, var_pop(n) over w as nn, covar_pop(e, n) over w as en, count(*) over w as k from p window w as (partition by session order by seq rows between 9 preceding and current row))
select session, seq, round(((degrees(0.5 * atan2(2 * en, nn - ee)) % 180) + 180) % 180, 3) as axis from c where k >= 3""")
def walk_direction(spark, d):
    """The axis of most movement over the last ten samples, in degrees from north under 180."""
    e, n = F.col("value"), F.col("value") * F.col("value") / 500 + F.col("seq") % 7
    w = _by().rowsBetween(-9, 0)
    rows = _rows(spark, d).select("session", "seq", e.alias("e"), n.alias("n"))
    held = rows.select("session", "seq", F.var_pop("e").over(w).alias("ee"), F.var_pop("n").over(w).alias("nn"), F.covar_pop("e", "n").over(w).alias("en"), F.count("*").over(w).alias("k"))
    axis = F.pmod(F.degrees(F.atan2(2 * F.col("en"), F.col("nn") - F.col("ee")) / 2), F.lit(180.0))
    return held.where("k >= 3").select("session", "seq", F.round(axis, 3).alias("axis"))


@query(f"with {TIMED} select session, seq, value from samples qualify row_number() over (partition by session order by seq desc) <= 50")
def last_points(spark, d):
    """The last fifty points of each session."""
    return _rows(spark, d).withColumn("back", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))).where("back <= 50").select("session", "seq", "value")


_SMOOTH = folded(
    "{'a': tick, 'h': value % 360}",
    "{'a': o.tick, 'h': ((s.h + (((o.value - s.h + 180) % 360 + 360) % 360 - 180) * (1 - exp(-least(0.5, greatest(0.0, (o.tick - s.a) / 1000.0)) / case when o.kind = 'view' then 0.1 else 0.6 end))) % 360 + 360) % 360}",
    "round(s.h, 4) as smooth",
)


def _headings(rows: DataFrame) -> DataFrame:
    return rows.select("session", "seq", F.col("tick").alias("ms"), F.col("value").alias("heading"), (F.col("kind") == "view").alias("stable"))


@query(_SMOOTH)
def heading_smoothing(spark, d):
    """Headings smoothed along the shorter turn."""
    return stateful.replay(_headings(_rows(spark, d)), "session", "seq", motion.HEADING).withColumn("smooth", F.round("smooth", 4))


@query(_SMOOTH)
def stream_heading_smoothing(spark, d):
    """The same from a stream of files."""
    events = runs.parquet_source(spark, f"{d}/events*.parquet")
    rows = events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.floor(F.expr(t.MILLISECONDS) / 40000).cast("long").alias("tick"), F.col("event_type").alias("kind"), "value")
    return runs.finish(stateful.stream(_headings(rows), "session", "seq", motion.HEADING)).withColumn("smooth", F.round("smooth", 4))


@query(folded(
    "{'t': value / 100, 'b': value / 100, 'a': true, 'm': null::bigint, 'p': false}",
    """(select case when t - b < 0.03 then {'t': t, 'b': b, 'a': true, 'm': m, 'p': false}
      when a and z > greatest(0.06, b + 0.55 * (t - b)) and (m is null or n - m > 380) then {'t': t, 'b': b, 'a': false, 'm': n, 'p': true}
      else {'t': t, 'b': b, 'a': a or z < b + 0.30 * (t - b), 'm': m, 'p': false} end
      from (select greatest(z0, s0.t + 0.007 * (z0 - s0.t)) as t, least(z0, s0.b + 0.007 * (z0 - s0.b)) as b, s0.a as a, s0.m as m, z0 as z, n0 as n from (select s as s0, o.value / 100 as z0, o.tick as n0)))""",
    "s.p as peak",
))
def step_peaks(spark, d):
    """Steps as peaks over a moving envelope."""
    rows = _rows(spark, d).select("session", "seq", F.col("tick").alias("ms"), (F.col("value") / 100).alias("size"))
    return stateful.replay(rows, "session", "seq", motion.STEP_PEAKS)


@query(folded("{'p': seq // 700, 'n': seq % 97, 'm': case when value > 10 then seq % 97 else 0 end}",
    "{'p': greatest(s.p, o.seq // 700 - o.seq % 2), 'n': case when o.seq // 700 - o.seq % 2 < s.p then s.n else o.seq % 97 end, 'm': case when o.seq // 700 - o.seq % 2 < s.p then null when o.seq // 700 - o.seq % 2 > s.p then case when o.value > 10 then o.seq % 97 else 0 end else greatest(0, o.seq % 97 - s.n) end}",
    "s.m as more").replace("{'p': seq // 700,", "{'p': seq // 700 - seq % 2,"))
def pedometer_batches(spark, d):
    """New steps of cumulative counters over counting sessions, late ones dropped."""
    part = F.floor(F.col("seq") / 700).cast("long") - F.col("seq") % 2
    rows = _rows(spark, d).select("session", "seq", part.alias("part"), (F.col("seq") % 97).alias("steps"), (F.col("value") > 10).alias("windowed"))
    return stateful.replay(rows, "session", "seq", motion.STEP_BATCHES)


@query(folded("{'x': value, 'y': seq % 11, 'k': true}",
    "case when sqrt((o.value - s.x) ** 2 + (o.seq % 11 - s.y) ** 2) >= 10 then {'x': o.value, 'y': o.seq % 11, 'k': true} else {'x': s.x, 'y': s.y, 'k': false} end", "s.k as kept"))
def route_recompute(spark, d):
    """Where a route is due again: 10 m from where it was made last."""
    rows = _rows(spark, d).select("session", "seq", F.col("value").alias("x"), (F.col("seq") % 11).cast("double").alias("y"))
    return stateful.replay(rows, "session", "seq", motion.kept_after(10.0))


@query(folded("{'a': tick, 'h': value, 'k': true}",
    "case when o.tick - s.a >= 400 and abs(((o.value - s.h + 180) % 360 + 360) % 360 - 180) >= 2 then {'a': o.tick, 'h': o.value, 'k': true} else {'a': s.a, 'h': s.h, 'k': false} end", "s.k as sent"))
def emit_throttle(spark, d):
    """Headings that are sent: 400 ms and 2 degrees after the last one."""
    rows = _rows(spark, d).select("session", "seq", F.col("tick").alias("ms"), F.col("value").alias("heading"))
    return stateful.replay(rows, "session", "seq", motion.throttle(400, 2.0))


@query(folded("{'a': tick, 'h': kind, 'k': true}",
    "case when o.kind <> s.h or o.tick - s.a >= 1000 then {'a': o.tick, 'h': o.kind, 'k': true} else {'a': s.a, 'h': s.h, 'k': false} end", "s.k as recorded"))
def heartbeat_samples(spark, d):
    """Samples that a session's export keeps: changes, and one a second."""
    rows = _rows(spark, d).select("session", "seq", F.col("tick").alias("ms"), "kind")
    return stateful.replay(rows, "session", "seq", motion.heartbeat(1000))


@query(f"""with {ORDERED}, l as (select session, seq, value, coalesce(bool_or(value > 15) over (partition by session order by seq rows between unbounded preceding and 1 preceding), false) as l from o)
select session, seq, value <= 15 and l as reached, case when value > 15 then 'away' when l then 'reached' else 'never left' end as reason from l""")
def exit_door_evidence(spark, d):
    """Whether a door's zone was left and reached again."""
    rows = _rows(spark, d).select("session", "seq", F.col("value").alias("metres"))
    return stateful.replay(rows, "session", "seq", motion.DOOR)


@query(folded("{'o': value > 30}", "{'o': o.value > case when s.o then 18 else 30 end}", "s.o as swinging"))
def swing_hysteresis(spark, d):
    """Swinging from above 30 degrees until 18 or less."""
    rows = _rows(spark, d).select("session", "seq", F.col("value").alias("level"))
    return stateful.replay(rows, "session", "seq", motion.hysteresis(30.0, 18.0)).withColumnRenamed("on_", "swinging")


@query(folded("{'x': value, 'y': seq % 5, 'p': 0, 'k': true}",
    "(select {'x': case when f > 0.05 then o.value else s.x end, 'y': case when f > 0.05 then o.seq % 5 else s.y end, 'p': s.p + (f > 3)::int, 'k': f > 0.05} from (select sqrt((o.value - s.x) ** 2 + (o.seq % 5 - s.y) ** 2) as f))",
    "s.p::bigint as part, s.k as kept"))
def trail_segments(spark, d):
    """Parts of each trail, a new one after a jump of over 3 m."""
    rows = _rows(spark, d).select("session", "seq", F.col("value").alias("x"), (F.col("seq") % 5).cast("double").alias("y"))
    return stateful.replay(rows, "session", "seq", motion.TRAIL)


_STRIDES = ORDERED.replace("select *, row_number()", """select *, seq % 5 as more, sum(seq % 5) over w as steps, case when kind = 'purchase' then sum(seq % 5 * 0.7::double) over w end as metres,
  case when kind = 'view' then 1.8::double end as cadence, case when kind = 'view' then 0.5 + value / 100 end as pace, row_number()""").replace("as rn from samples)", "as rn from samples window w as (partition by session order by seq rows between unbounded preceding and current row))")
_STRIDE = """(select case when v.more <= 0 then {'a': z.a, 'l': case when v.metres is not null then v.steps else z.l end, 'm': coalesce(v.metres, z.m), 'w': z.w, 's': 'none'}
  else {'a': least(1.2, greatest(0.35, z.a + (least(z.a * 1.2, greatest(z.a * 0.8, coalesce(v.d, v.c, 0.7))) - z.a) * case when z.w < 10 then 0.45 else 0.2 end)),
    'l': case when v.metres is not null then v.steps else z.l end, 'm': coalesce(v.metres, z.m), 'w': z.w + v.more, 's': case when v.d is not null then 'distance' when v.c is not null then 'cadence' else 'fixed' end} end
  from (select Z as z, {'more': o.more, 'steps': o.steps, 'metres': o.metres,
    'd': (select case when d between 0.35 and 1.2 then d end from (select case when o.metres is null then null when ZM is null then case when o.steps = o.more and o.metres > 0 then o.metres / nullif(o.more, 0) end
      when o.steps - ZL <> o.more or o.metres <= ZM then null else (o.metres - ZM) / nullif(o.more, 0) end as d)),
    'c': (select case when c between 0.35 and 1.2 then c end from (select 1 / (o.pace * o.cadence) as c))} as v))"""


@query(folded(_STRIDE.replace("ZM", "null::double").replace("ZL", "null::hugeint").replace("Z as z", "{'a': 0.7::double, 'l': null::hugeint, 'm': null::double, 'w': 0::bigint} as z"), _STRIDE.replace("ZM", "s.m").replace("ZL", "s.l").replace("Z as z", "s as z"), "round(s.a, 6) as stride, s.s as source", _STRIDES))
def stride_estimates(spark, d):
    """Strides from distance, else cadence and pace."""
    more, metres = F.col("seq") % 5, F.when(F.col("kind") == "purchase", F.sum(F.col("seq") % 5 * 0.7).over(_so_far()))
    rows = _rows(spark, d).select("session", "seq", F.sum(more).over(_so_far()).alias("steps"), more.alias("more"), metres.alias("metres"), F.when(F.col("kind") == "view", 1.8).alias("cadence"), F.when(F.col("kind") == "view", 0.5 + F.col("value") / 100).alias("pace"))
    return stateful.replay(rows, "session", "seq", motion.STRIDE).withColumn("stride", F.round("stride", 6))


_RELATION = "case o.kind when 'view' then 'reverse' when 'click' then 'forward' when 'error' then 'off' end"
_TURNS = f"""(select case when r is null then z when r = 'off' then {{'n': 'off', 'c': 0::bigint, 'm': 0.0::double}} when z.n = r or z.n = (case r when 'forward' then 'reverse' else 'forward' end) || '?' then {{'n': r, 'c': 0::bigint, 'm': 0.0::double}}
  when z.n = r || '?' then case when z.c >= 2 and z.m + d >= 1.2 then {{'n': r, 'c': 0::bigint, 'm': 0.0::double}} else {{'n': z.n, 'c': z.c + 1, 'm': z.m + d}} end else {{'n': r || '?', 'c': 1::bigint, 'm': d}} end
  from (select Z as z, {_RELATION} as r, abs(o.value / 20) as d))"""


@query(folded(_TURNS.replace("Z as z", "{'n': 'forward', 'c': 0::bigint, 'm': 0.0::double} as z"), _TURNS.replace("Z as z", "s as z"), "s.n as direction"))
def travel_direction(spark, d):
    """Directions along a route, confirmed by distinct steps."""
    relation = F.when(F.col("kind") == "view", "reverse").when(F.col("kind") == "click", "forward").when(F.col("kind") == "error", "off").otherwise("unclear")
    rows = _rows(spark, d).select("session", "seq", F.col("seq").alias("peak"), relation.alias("relation"), (F.col("value") / 20).alias("metres"))
    return stateful.replay(rows, "session", "seq", motion.DIRECTION)


_NODES = ORDERED.replace("select *, row_number()", "select *, ((value - lag(value) over w + 180) % 360 + 360) % 360 - 180 as turn, seq % 3 + 1 as ways, sum(value / 10) over (partition by session order by seq rows between unbounded preceding and current row) as metres, row_number()").replace("as rn from samples)", "as rn from samples window w as (partition by session order by seq))")
_CHECK = "(select {'l': case when k is null then z.l else o.metres end, 'k': k} from (select Z as z, case when abs(o.turn) between 35 and 150 then 'turn' when abs(o.turn) <= 20 and o.ways = 2 and o.metres - ZL >= 9 then 'straight' end as k))"


@query(folded(_CHECK.replace("ZL", "0").replace("Z as z", "{'l': 0.0::double} as z"), _CHECK.replace("ZL", "s.l").replace("Z as z", "s as z"), "s.k as kind", _NODES))
def route_checkpoints(spark, d):
    """Turns and spaced straight nodes along each track."""
    at = F.sum(F.col("value") / 10).over(_so_far())
    rows = _rows(spark, d).select("session", "seq", geo.turn_degrees(F.lag("value").over(_by()), F.col("value")).alias("turn"), (F.col("seq") % 3 + 1).alias("ways"), at.alias("metres"))
    return stateful.replay(rows, "session", "seq", motion.CHECKPOINTS)


_FIXES = """(select case when o.kind = 'error' or z is null or (z.r = 0 and dt > 15000) or d <= 15 + 3.5 * dt / 1000 then {'t': o.tick, 'x': x, 'y': y, 'r': 0, 'f': null::bigint, 'k': true, 'g': false}
  when z.r + 1 >= 5 or o.tick - coalesce(z.f, o.tick) >= 10000 then {'t': o.tick, 'x': x, 'y': y, 'r': 0, 'f': null::bigint, 'k': true, 'g': true}
  else {'t': z.t, 'x': z.x, 'y': z.y, 'r': z.r + 1, 'f': coalesce(z.f, o.tick), 'k': false, 'g': false} end
  from (select s as z, o.value as x, o.value * 3 % 50 as y, greatest(0, o.tick - s.t) as dt, sqrt((o.value - s.x) ** 2 + (o.value * 3 % 50 - s.y) ** 2) as d))"""


@query(folded("{'t': tick, 'x': value, 'y': value * 3 % 50, 'r': 0, 'f': null::bigint, 'k': true, 'g': false}", _FIXES, "s.k as accepted, s.g as gave_in"))
def gps_jump_filter(spark, d):
    """Fixes that a walker can have made; others count while not walking."""
    rows = _rows(spark, d).select("session", "seq", F.col("tick").alias("ms"), F.col("value").alias("x"), (F.col("value") * 3 % 50).alias("y"), (F.col("kind") != "error").alias("walking"))
    return stateful.replay(rows, "session", "seq", motion.GPS_JUMP)
