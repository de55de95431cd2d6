"""Queries over routes, walking edges and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import graph, lines
from waymark.plans.queries import EDGES, POINTS, query
from waymark.sources import tables as t

MODES = EDGES + ", moded as (select *, case when transfer then case when (source + target) % 2 = 0 then 'elevator' else 'escalator' end end as mode from edges)"
ROUTES = MODES + """, tasks as (select distinct floor::text as task, floor as ending from nodes union all select 'plain', null),
priced as (select task, source, target, cost * case when mode is null and ending is not null and n.floor <> ending and n.floor <> (select floor from nodes where id = 0) then 1.5 else 1.0 end as cost, length, cost as plain, (mode is not distinct from 'elevator')::int as lift from moded join nodes n on n.id = source, tasks),
walk as (select task, 0::bigint as node, {'c': 0.0::double, 'l': 0.0::double, 'p': 0.0::double, 'e': 0, 'h': 0, 'n': [0::bigint]} as s from tasks
  union all select w.task, e.target, {'c': s.c + e.cost, 'l': s.l + e.length, 'p': s.p + e.plain, 'e': s.e + e.lift, 'h': s.h + 1, 'n': list_append(s.n, e.target)} from walk w join priced e on w.task = e.task and w.node = e.source where s.h < 7),
solved as (select task, node, min(s) as s from walk group by all),
chosen as (select r.node, case when r.s.e > 0 or n.floor = (select floor from nodes where id = 0) or w.s is null or w.s.e > 0 then r.s else w.s end as s
  from solved r join nodes n on n.id = r.node left join solved w on w.node = r.node and w.task = n.floor::text where r.task = 'plain')"""


def _moded(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("transfer"), F.when((F.col("source") + F.col("target")) % 2 == 0, "elevator").otherwise("escalator"))
    return t.edges(spark, d).select("source", "target", "cost", "length", mode.alias("mode"))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return graph.multi_floor_routes(_moded(spark, d), t.nodes(spark, d), spark.range(1).select(F.col("id").alias("node")))


@query(f"with recursive {ROUTES} select node, s.c as cost, s.l as length, s.h as hops from solved where task = 'plain'")
def route_cost(spark, d):
    """The cheapest path from node 0 to every node."""
    edges = _moded(spark, d).withColumn("task", F.lit("plain")).withColumn("plain", F.col("cost")).withColumn("lift", F.when(F.col("mode") == "elevator", 1).otherwise(0))
    found = graph.routes(edges, spark.range(1).select(F.lit("plain").alias("task"), F.col("id").alias("node")))
    return found.select("node", "cost", "length", "hops")


@query(f"with recursive {ROUTES} select node, s.p as cost, s.l as length, s.e as lifts, array_to_string(s.n, '>') as way from chosen")
def multi_floor_penalty(spark, d):
    """Routes between floors: walking on floors in between counts more, unless a lift comes into play."""
    return _routes(spark, d).select("node", "cost", "length", "lifts", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("way"))


@query(f"""with recursive {ROUTES}, visits as (select node, unnest(s.n) as id, unnest(range(len(s.n))) as pos from chosen),
h as (select a.*, n.floor, lag(id) over w as source, coalesce((lag(n.floor) over w <> n.floor)::int, 0) as changed from visits a join nodes n using (id) window w as (partition by node order by pos)),
g as (select *, sum(changed) over (partition by node order by pos rows between unbounded preceding and current row) as segment from h)
select g.node, segment::bigint as segment, floor, sum(coalesce(m.length, 0)) as walked, arg_min(id, pos) as first, arg_max(id, pos) as last from g left join moded m on m.source = g.source and m.target = id and m.mode is null group by g.node, segment, floor""")
def route_segments(spark, d):
    """Each route's parts on one floor."""
    return graph.segments(_routes(spark, d), _moded(spark, d), t.nodes(spark, d)).withColumn("segment", F.col("segment").cast("long"))


@query(f"""with {EDGES}, doors as (select id, floor, x + id % 9 as x, y + id % 4 as y from nodes), g as (select d.*, sqrt((d.x - n.x) ** 2 + (d.y - n.y) ** 2) as gap from doors d join nodes n using (id))
select id, id as node, round(gap, 6) as gap from g where gap between 3 and 25 and not exists (select 1 from nodes n where n.floor = g.floor and sqrt((g.x - n.x) ** 2 + (g.y - n.y) ** 2) <= 1)""")
def door_stitch(spark, d):
    """Edges from doors to the graph."""
    nodes = t.nodes(spark, d)
    doors = nodes.select("id", "floor", (F.col("x") + F.col("id") % 9).alias("x"), (F.col("y") + F.col("id") % 4).alias("y"), F.col("id").alias("node"))
    return graph.door_stitches(doors, nodes).withColumn("gap", F.round("gap", 6))


_LINE = f"""{POINTS}, tracks as (select id % 7 as line, id as pos, x, y from points),
e as (select line, pos as seg, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from tracks window w as (partition by line order by pos)),
l as (select *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) as length from e), segs as (select *, sum(length) over (partition by line order by seg) - length as before from l where length > 0)"""


@query(f"""with {_LINE}, asked as (select id, id % 7 as line, x, y, case when id % 3 > 0 then id % 50 * 10.0 end as previous from points),
t as (select *, least(1.0, greatest(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (length * length))) as t from asked join segs using (line)),
f as (select *, before + t * length as travelled, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) as o from t)
select id, line, round(travelled, 4) as travelled, round(o, 4) as "offset", seg, previous is not null and abs(travelled - previous) > 15 as reacquired from f
qualify row_number() over (partition by id order by not (previous is not null and abs(travelled - previous) <= 15), round(o, 9), seg) = 1""")
def route_projection(spark, d):
    """Progress of points along tracks, near the progress before where that is known."""
    tracks = t.points(spark, d).select((F.col("id") % 7).alias("line"), F.col("id").alias("pos"), "x", "y")
    asked = t.points(spark, d).select("id", (F.col("id") % 7).alias("line"), "x", "y", F.when(F.col("id") % 3 > 0, F.col("id") % 50 * 10.0).alias("previous"))
    return lines.progress(asked, lines.line_segments(tracks)).select("id", "line", F.round("travelled", 4).alias("travelled"), F.round("offset", 4).alias("offset"), "seg", "reacquired")


@query(f"""with {EDGES}, {POINTS}, w as (select e.source * 25 + e.target as edge, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from edges e join nodes a on a.id = e.source join nodes b on b.id = e.target where e.source < e.target),
p as (select id, x + 50 as x, y + 40 as y from points), f as (select *, case when x1 = x2 and y1 = y2 then 0.0 else least(1.0, greatest(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) end as t from p, w),
o as (select id, edge, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) as o from f)
select id, edge, round(o, 6) as "offset" from o where o <= 12 qualify row_number() over (partition by id order by round(o, 9), edge) = 1""")
def gps_snap(spark, d):
    """The nearest walking edge within 12 m of each fix."""
    n = t.nodes(spark, d)
    end = lambda k, i: n.select(F.col("id").alias(k), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    edges = t.edges(spark, d).where("source < target").join(end("source", 1), "source").join(end("target", 2), "target").withColumn("edge", F.col("source") * 25 + F.col("target"))
    fixes = t.points(spark, d).select("id", (F.col("x") + 50).alias("x"), (F.col("y") + 40).alias("y"))
    return lines.snap(fixes, edges.select("edge", "x1", "y1", "x2", "y2"), 12.0).select("id", "edge", F.round("offset", 6).alias("offset"))


_RING = f"""{POINTS}, v as (select id, [{{'x': x - 10, 'y': y - 10}}, {{'x': x + 12, 'y': y - 6}}, {{'x': x, 'y': y + 1}}, {{'x': x + 8, 'y': y + 14}}] as r from points)"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return t.points(spark, d).select("id", F.array(corner(-10, -10), corner(12, -6), corner(0, 1), corner(8, 14)).alias("ring"))


@query(f"""with {_RING}, e as (select id, r[i] as a, r[i % 4 + 1] as b from v, unnest([1, 2, 3, 4]) as u(i)),
f as (select id, a, b, least(1.0, greatest(0.0, (-a.x * (b.x - a.x) - a.y * (b.y - a.y)) / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2))) as t from e),
g as (select id, count(*) filter ((a.y > 0) <> (b.y > 0) and 0 < (b.x - a.x) * (0 - a.y) / nullif(b.y - a.y, 0) + a.x) % 2 = 1 as inside, min(sqrt((a.x + t * (b.x - a.x)) ** 2 + (a.y + t * (b.y - a.y)) ** 2)) as away from f group by id)
select id, round(case when inside then 0 else away end, 6) as outside, round(case when inside then away else 0 end, 6) as depth from g""")
def polygon_distance(spark, d):
    """How far the origin is outside each ring, or how deep inside."""
    zero = F.lit(0.0)
    return _rings(spark, d).select("id", F.round(geo.polygon_distance(zero, zero, F.col("ring")), 6).alias("outside"), F.round(geo.polygon_depth(zero, zero, F.col("ring")), 6).alias("depth"))


@query(f"""with {_RING}, a as (select id, k, radians(k * 0.5) as a, unnest(r) as p from v, unnest(range(360)) as u(k)),
b as (select id, k, (max(p.x * cos(a) + p.y * sin(a)) - min(p.x * cos(a) + p.y * sin(a))) * (max(p.y * cos(a) - p.x * sin(a)) - min(p.y * cos(a) - p.x * sin(a))) as area from a group by id, k)
select id, round(min(area), 4) as area from b group by id""")
def min_area_box(spark, d):
    """The area of the smallest turned box around each ring."""
    return _rings(spark, d).select("id", F.round(geo.smallest_box(F.col("ring"))["area"], 4).alias("area"))


@query(f"""with {POINTS}, s as (select id % 7 as line, id, (degrees(atan2(lead(x) over w - x, lead(y) over w - y)) - degrees(atan2(x - lag(x) over w, y - lag(y) over w))) as raw from points window w as (partition by id % 7 order by id)),
d as (select line, id, ((raw + 180) % 360 + 360) % 360 - 180 as turn from s where raw is not null)
select line, id, round(turn, 6) as turn, case when abs(turn) < 20 then 'straight' when turn > 0 then 'right' else 'left' end as kind from d""")
def turn_steps(spark, d):
    """Turns at the inner vertices of each track."""
    w = Window.partitionBy(F.col("id") % 7).orderBy("id")
    bearing = lambda a, b, c, e: F.degrees(F.atan2(c - a, e - b))
    x, y = F.col("x"), F.col("y")
    turn = geo.turn_degrees(bearing(F.lag("x").over(w), F.lag("y").over(w), x, y), bearing(x, y, F.lead("x").over(w), F.lead("y").over(w)))
    return t.points(spark, d).select((F.col("id") % 7).alias("line"), "id", turn.alias("turn")).where("turn is not null").select("line", "id", F.round("turn", 6).alias("turn"), geo.turn_kind(F.col("turn")).alias("kind"))


@query(f"with {POINTS}, a as (select id, sqrt(x * x + y * y) * 7 as m from points) select id, least(999, greatest(1, ceil(m / 1.2 / 60)))::int as minutes, (case when m < 50 then greatest(5, round(m / 5) * 5) else round(m / 10) * 10 end)::int as told from a")
def walking_labels(spark, d):
    """Minutes to walk and metres as an instruction tells them."""
    m = F.hypot("x", "y") * 7
    return t.points(spark, d).select("id", geo.reach_minutes(m).alias("minutes"), geo.guidance_metres(m).alias("told"))


@query(f"with {POINTS} select id, round(x, 6) as x, round(y, 6) as y from points")
def affine_round_trip(spark, d):
    """Points through an affine map and back."""
    m = (2.0, -0.5, 7.0, 0.25, 1.5, -3.0)
    u, v = geo.affine(F.col("x"), F.col("y"), m)
    x, y = geo.affine_inverse(u, v, m)
    return t.points(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
