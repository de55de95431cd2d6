"""Queries over walkers' places: corridors, escalators, guidance, checkpoints, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators import corridors, escalators, guiding, matching, motion, preview, shapes, stateful
from waymark.plans.motion import folded
from waymark.plans.queries import QUERIES, SAMPLES
from waymark.plans.queries import query as with_sql
from waymark.sources.tables import edges, nodes, samples, table


def query(f):
    QUERIES[f.__name__] = f
    return f


def floor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """floor, id, source, target, both, access, xs, ys: edges that stay on a floor, as lines; each is given once."""
    ends = nodes(spark, sf_dir).select("id", "floor", "x", "y")
    a, b = ends.toDF("source", "floor", "ax", "ay"), ends.select("id", "x", "y").toDF("target", "bx", "by")
    near = edges(spark, sf_dir).where("not transfer").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    joined = near.join(a, "source").join(b, "target")
    return joined.select("floor", (F.col("source") * 100 + F.col("target")).alias("id"), "source", "target", F.lit(True).alias("both"), F.lit(False).alias("access"), F.array("ax", "bx").alias("xs"), F.array("ay", "by").alias("ys"))


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, ms, floor and what a walker's sensors say: an event is one to three steps in a heading that turns every few events; the next event is a preview."""
    by = Window.partitionBy("session").orderBy("seq")
    n = F.row_number().over(by) - 1
    more = 1 + F.col("seq") % 3
    heading = (F.col("session") * 47 + F.floor(n / 4) * (60 + F.col("session") % 5 * 30)) % 360
    rows = samples(spark, sf_dir).where("session is not null and seq is not null and ms is not null").select("session", "seq", "ms", (F.col("session") % 2).cast("int").alias("floor"), more.alias("more"), heading.cast("double").alias("heading"))
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    start = nodes(spark, sf_dir).select(F.col("id").alias("start"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    metres = F.col("more") * 0.7
    rows = rows.withColumn("start", F.col("floor") * 9 + F.col("session") % 8).join(start, "start")
    rows = rows.withColumns({"steps": F.sum("more").over(run), "metres": F.sum(metres).over(run)})
    rows = rows.withColumns({"x": F.col("x0") + F.sum(metres * F.sin(F.radians("heading"))).over(run), "y": F.col("y0") + F.sum(metres * F.cos(F.radians("heading"))).over(run)})
    next_ = lambda c: F.array_compact(F.array(F.lead(c).over(by)))
    return rows.withColumns({"xs": F.array("x"), "ys": F.array("y"), "origin_x": F.col("x"), "origin_y": F.col("y"), "peaks": next_("seq"), "peak_xs": next_("x"), "peak_ys": next_("y"), "through": F.col("seq")})


def corridor_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corridors.with_network(walks(spark, sf_dir), corridors.networks(floor_edges(spark, sf_dir)), "session", "seq")
    return stateful.replay(rows, "session", "seq", corridors.CORRIDOR, spread=True)


@query
def corridor_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's place on the corridors, confirmed and shown."""
    tracked = corridor_places(spark, sf_dir)
    metres = [c for c, kind in tracked.dtypes if kind == "double"]
    return tracked.withColumns({c: F.round(c, 6) for c in metres})


@query
def corridor_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: how much of the walked way the track kept, its longest stall, its jumps and bounds."""
    rows = walks(spark, sf_dir).select("session", "seq", "ms", "metres")
    tracked = corridor_places(spark, sf_dir).join(rows, ["session", "seq"])
    out = corridors.summary(tracked, "session", "seq", "ms", "metres")
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


#: Floors of the building that the queries ride in.
FLOORS = ("5F", "4F", "3F", "2F", "1F", "B1")


def boarding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building, floor, id, bank, up, to_floor, x, y: a nation is a boarding point of an escalator."""
    n = F.col("n_nationkey").cast("long")
    floors = F.array(*map(F.lit, FLOORS))
    at = (n % 5 + 1).cast("int")
    up = n % 2 == 0
    other = F.element_at(floors, F.when(up, F.greatest(at - 1, F.lit(1))).otherwise(at + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(
        F.lit(0).alias("building"), F.element_at(floors, at).alias("floor"), n.alias("id"), F.concat(F.lit("ES"), n % 4).alias("bank"), up.alias("up"), other.alias("to_floor"),
        (n * 37 % 100).cast("double").alias("x"), (n * 53 % 80).cast("double").alias("y"),
    )


def riders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq and what a rider's sensors say, a sample a second: each minute stands by a boarding point, rides up or down for 20 seconds, and walks on."""
    by = Window.partitionBy("session").orderBy("seq")
    n, s = F.row_number().over(by) - 1, F.col("session")
    rows = samples(spark, sf_dir).where("session is not null and seq is not null").select("session", "seq", n.alias("n"))
    at = F.col("n") % 60
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), (s % 5 + 1).cast("int"))
    start = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("start"), (F.col("n_nationkey") * 37 % 100).cast("double").alias("x0"), (F.col("n_nationkey") * 53 % 80).cast("double").alias("y0"))
    rows = rows.withColumns({"start": s % 25, "at": at}).join(start, "start")
    height = (3.4 + s % 4 * 0.7) * F.when(s % 2 == 0, 1).otherwise(-1)
    ridden = F.floor(F.col("n") / 60) * height + height * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("at") - 12) / 20.0))
    stands = F.col("at").between(6, 11)
    nothing = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "session", "seq", (1000 * F.col("n")).cast("long").alias("ms"), F.lit(0).alias("building"), floor.alias("floor"), F.array(*map(F.lit, FLOORS)).alias("floors"), (F.col("n") - F.least(F.col("at") - 12, F.lit(20)) * (F.col("at") > 12).cast("int")).cast("long").alias("steps"),
        F.lit(1).alias("moved"), F.when(F.col("at") > 34, 1).otherwise(0).alias("stepped"), F.when(stands, F.col("x0") + s % 9).alias("x"), F.when(stands, F.col("y0")).alias("y"),
        nothing("double").alias("route_m"), nothing("long").alias("expected"), nothing("string").alias("expected_bank"), nothing("boolean").alias("expected_up"), nothing("string").alias("expected_to"), nothing("long").alias("arrival"), F.lit(False).alias("at_once"),
        ridden.cast("double").alias("altitude"),
    )


@query
def escalator_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples at which a rider's phase changes, and how."""
    rows = escalators.near_boarding(riders(spark, sf_dir), boarding_points(spark, sf_dir), ["session", "seq"])
    told = stateful.replay(rows, "session", "seq", escalators.RIDE).where("size(changes) > 0")
    return told.withColumn("changes", F.array_join("changes", "; ")).withColumns({c: F.round(c, 6) for c in ("rise", "delta")})


@query
def escalator_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides that have landed, with their boarding points and evidence."""
    rows = escalators.near_boarding(riders(spark, sf_dir), boarding_points(spark, sf_dir), ["session", "seq"])
    return escalators.rides(stateful.replay(rows, "session", "seq", escalators.RIDE), "session", "seq").withColumn("rise", F.round("rise", 6))


@query
def guided_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample of a guided walk: shown progress, why it is held, evidence of leaving the route, and rows of timers (seq -1)."""
    by = Window.partitionBy("session").orderBy("seq")
    v, n = F.col("value"), F.row_number().over(by) - 1
    rows = samples(spark, sf_dir).where("session is not null and seq is not null").withColumn("n", n)
    at = F.col("n") % 40
    guided = rows.select(
        "session", "seq", (700 * F.col("n") + F.when(at >= 36, 30_000).otherwise(0)).cast("long").alias("ms"), (F.col("session") * 100 + F.floor(F.col("n") / 40)).cast("long").alias("route"), (0.7 * at + F.when(v > 190, 15).when(v > 180, -4).otherwise(0)).cast("double").alias("travelled"),
        (F.when(at.between(14, 20), v / 20).otherwise(v / 100)).cast("double").alias("off"), (~at.between(24, 29)).alias("on_edge"), (v > 195).alias("again"), (F.col("kind") == "error").alias("lost"), at.between(16, 23).alias("junction"),
        F.col("n").cast("long").alias("steps"), F.lit(False).alias("rerouting"), (at == 39).alias("riding"), (F.col("session") % 3 == 0).alias("reverse"), F.when(at >= 30, 40.0 - at).alias("board_m"),
    )
    told = stateful.replay(guided, "session", "seq", guiding.GUIDE)
    return told.fillna(-1, ["seq"]).withColumn("shown", F.round("shown", 6))


def route_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """routes (route, nth, edge, source, target): ten of eight edges each, odd ones walked backwards; edges (edge, source, target) between nodes one apart."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source"))
    lines = n.select((F.col("source") * 100 + (F.col("source") + 1) % 25).alias("edge"), "source", ((F.col("source") + 1) % 25).alias("target"))
    each = n.where("source < 10").select(F.col("source").alias("route"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    from_, back = (F.col("route") + F.col("k")) % 25, F.col("route") % 2 == 1
    to = (from_ + 1) % 25
    routes = each.select("route", F.when(back, 7 - F.col("k")).otherwise(F.col("k")).cast("long").alias("nth"), (from_ * 100 + to).alias("edge"), F.when(back, to).otherwise(from_).alias("source"), F.when(back, from_).otherwise(to).alias("target"))
    return routes, lines


def route_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, route, moved, crossed_nodes, relocated: an event is a step over one to three parts of edges, some of them twice."""
    s, q, v = F.col("session"), F.col("seq"), F.col("value")
    at = (s % 10 + q % 9) % 25
    edge = lambda n: n * 100 + (n + 1) % 25
    first = F.struct(edge(at).alias("edge"), (v % 5).alias("from_m"), (v % 7).alias("to_m"))
    second = F.struct(edge((at + 1) % 25).alias("edge"), F.lit(0.0).alias("from_m"), (v % 3).alias("to_m"))
    moved = F.when(q % 3 == 0, F.array(first)).when(q % 3 == 1, F.array(first, second)).otherwise(F.array(first, second, first))
    crossed = F.when(q % 2 == 0, F.array(at, (at + 1) % 25)).otherwise(F.array().cast("array<long>"))
    rows = samples(spark, sf_dir).where("session is not null and seq is not null and value is not null")
    return rows.select("session", "seq", "ms", (s % 10).alias("route"), moved.alias("moved"), crossed.alias("crossed_nodes"), (q % 17 == 0).alias("relocated"))


@with_sql(f"""with {SAMPLES}, lines as (select n_nationkey * 100 + (n_nationkey + 1) % 25 as edge, n_nationkey as s, (n_nationkey + 1) % 25 as t from nation),
routes as (select n_nationkey as route, ((n_nationkey + k) % 25) * 100 + (n_nationkey + k + 1) % 25 as edge, n_nationkey % 2 = 1 as back from nation, range(8) r(k) where n_nationkey < 10),
placed as (select session, seq, session % 10 as route, (session % 10 + seq % 9) % 25 as n, value as v, seq % 17 = 0 as relocated from samples where value is not null),
parts as (
  select session, seq, route, 0 as nth, n * 100 + (n + 1) % 25 as edge, v % 7 - v % 5 as m from placed
  union all select session, seq, route, 1, ((n + 1) % 25) * 100 + (n + 2) % 25, v % 3 from placed where seq % 3 > 0
  union all select session, seq, route, 2, n * 100 + (n + 1) % 25, v % 7 - v % 5 from placed where seq % 3 = 2),
met as (select p.*, r.edge is null as off, case when r.back then -m else m end as signed from parts p left join routes r on r.route = p.route and r.edge = p.edge),
stops as (select session, seq, min(nth) filter (off) as stop from met group by all),
sums as (select m.session, m.seq, any_value(stop) as stop, coalesce(sum(signed) filter (stop is null or nth < stop), 0.0) as signed_m from met m join stops s on s.session = m.session and s.seq = m.seq group by all),
told as (select a.session, a.seq, a.route, a.n, case when relocated then 0.0 else signed_m end as metres, case when relocated then 'relocated' when stop is not null then 'off' when signed_m > 1e-6 then 'forward' when signed_m < -1e-6 then 'reverse' else 'ambiguous' end as relation from placed a join sums using (session, seq))
select session, seq, round(metres, 6) as signed_m, relation,
  case when relation in ('forward', 'reverse', 'ambiguous') and seq % 2 = 0 then array_to_string(list_filter([n, (n + 1) % 25], lambda x: (x - route + 25) % 25 <= 8), ',') else '' end as crossed
from told""")
def step_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each step lies on its session's route: signed metres over repeated parts, relation, route nodes passed."""
    routes, lines = route_lines(spark, sf_dir)
    out = guiding.relation(route_steps(spark, sf_dir), routes, lines, ["session", "seq"])
    return out.select("session", "seq", F.round("signed_m", 6).alias("signed_m"), "relation", F.array_join(F.col("crossed").cast("array<string>"), ",").alias("crossed"))


@query
def checkpoint_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the checkpoints of each session's route as its steps pass them."""
    routes, lines = route_lines(spark, sf_dir)
    steps = route_steps(spark, sf_dir)
    related = guiding.relation(steps, routes, lines, ["session", "seq"]).join(steps.select("session", "seq", "route", "moved"), ["session", "seq"])
    directed = related.withColumns({"peak": F.col("seq"), "metres": F.col("signed_m")})
    direction = stateful.replay(directed, "session", "seq", motion.DIRECTION)
    by = Window.partitionBy("route").orderBy("nth")
    points = routes.withColumn("out", F.lead("edge").over(by)).where("out is not null").withColumn("kind", F.when(F.col("nth") % 2 == 0, "turn").otherwise("straight"))
    nodes_of = points.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("nth", "target", "kind", "out"))).alias("c"))
    edge = F.element_at("moved", -1)["edge"]
    rows = related.join(direction, ["session", "seq"]).join(nodes_of, "route").select(
        "session", "seq", F.col("seq").alias("peak"), "route", "relation", "direction", "signed_m", "crossed", F.col("c.target").alias("nodes"), F.col("c.kind").alias("kinds"), F.col("c.out").alias("outs"),
        F.transform("c", lambda c: (F.abs(c["target"] - F.col("seq") % 25) % 3).cast("double")).alias("metres"), edge.alias("edge"), (F.col("relation") != "off").alias("on_route"), F.lit(False).alias("lost"), (F.col("seq") % 19 == 0).alias("unsure"), F.lit(False).alias("rerouting"),
    )
    return stateful.replay(rows, "session", "seq", guiding.CHECKPOINT).where("decision is not null")


def _turned(a: str, b: str) -> str:
    """SQL for the shortest turn from a to b, in (-180, 180]."""
    d = f"((({b}) - ({a})) % 360 + 360) % 360"
    return f"(case when {d} > 180 then {d} - 360 else {d} end)"


_WALKED = SAMPLES + """, o as (select *, row_number() over w as rn, 100 * (row_number() over w)::bigint as tick, (value * 3.6) % 360 as heading, (value * 7 + seq) % 360 as walk, (seq % 10) / 10.0 as sure, kind <> 'error' as swinging, case when kind = 'purchase' then 30.0 else 5.0 end as net from samples window w as (partition by session order by seq))"""
_HELD = "case when o.net > 20 then o.tick + 1500 else s.h end"
_AHEAD = f"case when abs({_turned('o.heading + s.v', 'o.walk')}) <= abs({_turned('o.heading + s.v', 'o.walk + 180')}) then o.walk else o.walk + 180 end"
_NEW = f"greatest(-60.0::double, least(60.0::double, {_turned('0', 's.v + ' + _turned('s.v', _turned('o.heading', _AHEAD)) + ' * (1 - exp(-(o.tick - s.t) / 2500.0::double))')}))"


@with_sql(folded(
    "{'t': tick, 'v': 0.0::double, 'h': case when net > 20 then tick + 1500 else -1 end, 'a': swinging and not net > 20 and sure >= 0.35}",
    f"case when not o.swinging then {{'t': o.tick, 'v': s.v * exp(-(o.tick - s.t) / 12000.0::double), 'h': {_HELD}, 'a': false}} when o.tick < {_HELD} or o.sure < 0.35 then {{'t': o.tick, 'v': s.v, 'h': {_HELD}, 'a': false}} else {{'t': o.tick, 'v': {_NEW}, 'h': {_HELD}, 'a': true}} end",
    "round(s.v, 6) as walk_offset, s.a as active", _WALKED))
def walk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each sample's phone points beside the way that is walked."""
    by = Window.partitionBy("session").orderBy("seq")
    v, q = F.col("value"), F.col("seq")
    rows = samples(spark, sf_dir).select(
        "session", "seq", (100 * F.row_number().over(by)).cast("long").alias("ms"), (F.col("kind") != "error").alias("swinging"), F.when(F.col("kind") == "purchase", 30.0).otherwise(5.0).alias("net"),
        ((v * 7 + q) % 360).alias("walk"), (q % 10 / 10.0).alias("sure"), ((v * 3.6) % 360).alias("heading"),
    )
    return stateful.replay(rows, "session", "seq", motion.WALK_OFFSET).select("session", "seq", F.round("offset", 6).alias("walk_offset"), "active")


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples with n, their place in the session, as seconds."""
    return samples(spark, sf_dir).where("session is not null and seq is not null").withColumn("n", (F.row_number().over(Window.partitionBy("session").orderBy("seq"))).cast("long"))


@query
def step_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks shown before they are confirmed: what each sample shows, what waits, and the lead."""
    rows = _seconds(spark, sf_dir)
    n, more = F.col("n"), F.when(F.col("kind") == "view", 2).otherwise(1)
    by = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("count", F.sum(more).over(by))
    batch = F.floor(n / 25) * 25
    confirmed = F.max(F.when(n % 25 == 0, F.col("count"))).over(by)
    known = seen.select(
        "session", "seq", "count", (600 * n).alias("peak_ms"), (n % 40 > 2).alias("tracking"), F.when(F.col("seq") % 31 > 0, F.col("value") * 3.6).alias("heading"), (0.3 + F.col("seq") % 10 / 10.0).alias("stride"),
        F.coalesce(confirmed, F.lit(0)).alias("steps"), (0.7 * F.coalesce(confirmed, F.lit(0))).alias("metres"), F.when(batch > 0, 600 * batch).alias("through"), F.when(F.col("seq") % 3 == 0, 1.6).alias("cadence"),
    )
    told = stateful.replay(known, "session", "seq", preview.PREVIEW)
    shown = {c: F.array_join(F.transform(c, lambda x: F.round(x, 6)), ",") for c in ("shown_xs", "shown_ys")}
    return told.withColumn("shown", F.array_join("shown", ",")).withColumns(shown).withColumns({c: F.round(c, 6) for c in ("metres", "x", "y", "ahead_m")})


@with_sql(f"""with {SAMPLES}, n as (select *, row_number() over (partition by session order by seq) as n from samples),
steps as (select session, 1000 * n as ms, value / 100 as dx, (value % 7) / 10 as dy, value / 50 as m from n where kind in ('view', 'click')),
batches as (select session, 1000 * n + 500 as ms, 1000 * (n - 3) as through, value as x, value / 2 as y from n where n % 8 = 0),
asked as (select session, seq, 1000 * n + 700 as ms from n),
at as (select a.session, a.seq, a.ms, arg_max(b.through, b.ms) as through, arg_max(b.x, b.ms) as bx, arg_max(b.y, b.ms) as b_y from asked a left join batches b on b.session = a.session and b.ms <= a.ms group by all),
placed as (select p.session, p.seq, p.ms, coalesce(any_value(bx), 0) + coalesce(sum(dx) filter (s.ms > coalesce(p.through, -1)), 0) as x, coalesce(any_value(b_y), 0) + coalesce(sum(dy) filter (s.ms > coalesce(p.through, -1)), 0) as y,
  count(s.ms) filter (s.ms > coalesce(p.through, -1)) as ahead, coalesce(sum(m) filter (s.ms > coalesce(p.through, -1)), 0) as ahead_m, coalesce(sum(dx), 0) as tx, coalesce(sum(dy), 0) as ty
  from "at" p left join steps s on s.session = p.session and s.ms <= p.ms group by p.session, p.seq, p.ms),
moved as (select *, x - lag(x) over w - (tx - lag(tx) over w) as gx, y - lag(y) over w - (ty - lag(ty) over w) as gy from placed window w as (partition by session order by seq))
select session, seq, round(x, 6) as x, round(y, 6) as y, ahead, round(ahead_m, 6) as ahead_m, round(coalesce(sqrt(gx * gx + gy * gy), 0), 6) as taken_back from moved""".replace("at as (select a.session", '"at" as (select a.session'))
def reconciled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from the last batch and the steps shown since its end, and what each batch takes back."""
    rows, n, v = _seconds(spark, sf_dir), F.col("n"), F.col("value")
    steps = rows.where("kind in ('view', 'click')").select("session", (1000 * n).alias("ms"), (v / 100).alias("dx"), (v % 7 / 10).alias("dy"), (v / 50).alias("metres"))
    batches = rows.where("n % 8 = 0").select("session", (1000 * n + 500).alias("ms"), (1000 * (n - 3)).alias("through"), v.alias("x"), (v / 2).alias("y"))
    out = preview.reconciled(rows.select("session", "seq", (1000 * n + 700).alias("ms")), batches, steps, "session")
    return out.withColumn("ahead", F.col("ahead").cast("long")).withColumns({c: F.round(c, 6) for c in ("x", "y", "ahead_m", "taken_back")})


@with_sql(f"""with {SAMPLES}, n as (select *, row_number() over (partition by session order by seq) as n from samples),
turns as (select session, 1000 * n as "at", kind = 'click' as "on" from n where kind in ('click', 'error')),
batches as (select session, seq as batch, 3 + seq % 7 as steps, case when seq % 13 > 0 then 1000 * (n - 5) - 300 end as a, 1000 * n - 300 as b, seq % 2 = 0 as "on", case when seq % 3 > 0 then list_transform(range(0, 4 + seq % 3), lambda k: 1000 * (n - 6) + 1300 * k) end as peaks from n where n % 5 = 0),
spans as (select * from batches where a is not null),
p as (select session, batch, unnest(peaks) as "at", a, b from spans),
inside as (select p.*, coalesce((select arg_max(t."on", t.at) from turns t where t.session = p.session and t.at <= p.at), true) as state from p where p.at > a and p.at <= b),
by_peak as (select session, batch, count(*) as n_peaks, count(*) filter (state) as n_on, coalesce(list("at" order by "at") filter (state), []) as on_peaks from inside group by all),
ranges as (select session, "at" as s, coalesce(lead("at") over (partition by session order by "at"), 1e15::bigint) as e, "on" from turns
  union all select session, -1e15::bigint, min("at"), true from turns group by session union all select distinct session, -1e15::bigint, 1e15::bigint, true from n where session not in (select session from turns)),
laps as (select b.session, b.batch, greatest(s, a) as s, least(e, b) as e from spans b join ranges r on r.session = b.session and r."on" and r.s < b and r.e > a),
by_time as (select session, batch, sum(e - s) as on_ms, min(s) as s, max(e) as e from laps group by all),
met as (select b.*, by_peak.n_peaks, by_peak.on_peaks, t.s, t.e, case when a is null then b."on"::int::double when coalesce(n_peaks, 0) > 0 then n_on / n_peaks else coalesce(on_ms, 0) / (b.b - a) end as fraction
  from batches b left join by_peak using (session, batch) left join by_time t using (session, batch)),
kept as (select *, least(steps, round(steps * fraction))::bigint as kept from met)
select session, batch, kept, round(fraction, 6) as fraction, case when a is not null and kept < steps and s is not null then s else a end as from_ms, case when a is not null and kept < steps and s is not null then e else b end as to_ms,
  array_to_string(case when a is not null and kept < steps and on_peaks is not null then on_peaks else peaks end, ',') as peaks from kept""")
def tracked_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of each batch that were walked while tracking was on, by its peaks, else by time."""
    rows, n, q = _seconds(spark, sf_dir), F.col("n"), F.col("seq")
    turns = rows.where("kind in ('click', 'error')").select("session", (1000 * n).alias("at"), (F.col("kind") == "click").alias("on"))
    peaks = F.transform(F.sequence(F.lit(0).cast("long"), 3 + q % 3), lambda k: 1000 * (n - 6) + 1300 * k)
    batches = rows.where("n % 5 = 0").select("session", q.alias("batch"), (3 + q % 7).alias("steps"), F.when(q % 13 > 0, 1000 * (n - 5) - 300).alias("a"), (1000 * n - 300).alias("b"), (q % 2 == 0).alias("on"), F.when(q % 3 > 0, peaks).alias("peaks"))
    out = preview.tracked_part(batches, turns, "session", F.lit(True))
    return out.withColumns({"fraction": F.round("fraction", 6), "peaks": F.array_join(F.col("peaks").cast("array<string>"), ",")})


@query
def map_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample's edge by the plain map matcher, whether it is suspect or recovered, and its way along the graph."""
    rows = corridors.with_network(walks(spark, sf_dir).select("session", "seq", "floor", "x", "y"), corridors.networks(floor_edges(spark, sf_dir)), "session", "seq")
    told = stateful.replay(rows, "session", "seq", matching.MATCH)
    return told.withColumns({c: F.round(c, 6) for c in ("progress", "at_x", "at_y", "away", "way")})


@with_sql("""with n as (select n_nationkey as node, (n_nationkey * 37 % 100)::double as x, (n_nationkey * 53 % 80)::double as y from nation),
r as (select n_nationkey as route, k, (n_nationkey + k) % 25 as a, (n_nationkey + k + 1) % 25 as b, n_nationkey % 2 = 1 as back from nation, range(8) t(k) where n_nationkey < 10),
pts as (
  select route, case when back then 7 - k else k end as nth, case when back then 2 - p else p end as p, case p when 0 then s.x when 1 then (s.x + t.x) / 2 + 1 else t.x end as x, case p when 0 then s.y when 1 then (s.y + t.y) / 2 - 1 else t.y end as y
  from r join n s on s.node = a join n t on t.node = b, range(3) q(p) where a % 3 > 0 or p <> 1),
kept as (select * from pts where nth = 0 or p > 0)
select route, sum(metres) as metres, max(lats) as lats, max(lons) as lons from (
  select route, (select sum(5 + (3 * a + 5 * b) % 17) from r where r.route = kept.route)::double as metres,
    string_agg(round(37.5 + 0.00001 * (y + 0.1 * x), 9)::varchar, ',' order by nth, p) as lats, string_agg(round(127.0 + 0.00001 * (x - 0.1 * y), 9)::varchar, ',' order by nth, p) as lons from kept group by route) group by route""")
def floor_route_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of routes on the globe: the lines of their edges put together, turned where walked backwards."""
    routes, lines = route_lines(spark, sf_dir)
    at = nodes(spark, sf_dir).select("id", "x", "y")
    a, b = at.toDF("source", "ax", "ay"), at.toDF("target", "bx", "by")
    bent = F.col("source") % 3 > 0
    mid = lambda p, q, by: (F.col(p) + F.col(q)) / 2 + by
    length = (5 + (3 * F.col("source") + 5 * F.col("target")) % 17).cast("double")
    drawn = lines.join(a, "source").join(b, "target").select("edge", "source", "target", length.alias("length"), F.when(bent, F.array("ax", mid("ax", "bx", 1), "bx")).alias("xs"), F.when(bent, F.array("ay", mid("ay", "by", -1), "by")).alias("ys"))
    out = shapes.route_line(routes, drawn, at)
    lat = F.zip_with("xs", "ys", lambda x, y: F.round(37.5 + 0.00001 * (y + 0.1 * x), 9).cast("string"))
    lon = F.zip_with("xs", "ys", lambda x, y: F.round(127.0 + 0.00001 * (x - 0.1 * y), 9).cast("string"))
    return out.select("route", "metres", F.array_join(lat, ",").alias("lats"), F.array_join(lon, ",").alias("lons"))


@with_sql(f"""with {SAMPLES}, t as (select session, value as v, 7 * row_number() over (partition by session order by seq) + case when seq % 23 = 0 then 3 else 0 end + 60 * (row_number() over (partition by session order by seq) // 50) as ms from samples),
p as (select session, ms, v, lead(ms) over w as ms2, lead(v) over w as v2 from t window w as (partition by session order by ms)),
e as (select session, max(ms) - 5 * 399 as start from t group by session),
f as (select p.*, start, unnest(range(greatest(0, floor((ms - start) / 5.0)::bigint + 1), floor((ms2 - start) / 5.0)::bigint + 1)) as frame from p join e using (session) where ms2 > ms and ms2 >= start)
select session, frame::int as frame, case when ms2 - ms <= 40 then round(v + (v2 - v) * (start + frame * 5 - ms) / (ms2 - ms), 6) end as v from f""")
def resampled_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 400 frames of each session at 200 Hz, on the lines between its samples; null over longer gaps."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq"))
    rows = samples(spark, sf_dir).where("session is not null and seq is not null").withColumn("n", n)
    timed = rows.select("session", F.col("value").alias("v"), (7 * F.col("n") + F.when(F.col("seq") % 23 == 0, 3).otherwise(0) + 60 * F.floor(F.col("n") / 50)).alias("ms"))
    return shapes.on_grid(timed, "session", "ms", ["v"], 5, 400, 40).withColumn("v", F.round("v", 6))


@query
def label_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a floor's store labels are placed: far from those before, and large. A part is a store, forty brands and kinds are floors."""
    key = F.col("p_partkey")
    floor = F.concat_ws("/", F.col("p_brand"), F.split("p_type", " ")[0], F.col("p_size").cast("string"))
    stores = table(spark, sf_dir, "part").select(floor.alias("floor"), key.alias("id"), F.col("p_name").alias("name"), (37.5 + key * 37 % 1009 * 1e-6).alias("lat"), (127.0 + key * 53 % 997 * 1e-6).alias("lon"), (key * 13 % 211).cast("double").alias("area"))
    return shapes.label_priority(stores)
