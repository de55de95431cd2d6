"""Queries over the projected wayfinding entities, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import graph, sequences
from waymark.sources import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NODES = "nodes as (select n_nationkey::bigint as id, (n_nationkey // 9)::int as floor, (n_nationkey * 37 % 100)::double as x, (n_nationkey * 53 % 80)::double as y from nation)"
EDGES = NODES + """, edges as (
  select s.id as source, t.id as target, (1 + (13 * s.id + 7 * t.id) % 11)::double as cost, (5 + (3 * s.id + 5 * t.id) % 17)::double as length, s.floor <> t.floor as transfer
  from nodes s, nodes t where (t.id - s.id + 25) % 25 in (1, 4, 21, 24))"""
REACH = EDGES + """, walk as (
  select 0::bigint as node, 0.0::double as cost, 0.0::double as length, 0 as hops
  union all select target, w.cost + e.cost, w.length + e.length, hops + 1 from walk w join edges e on w.node = e.source where hops < 7),
best as (select node, min({'c': cost, 'l': length}) as m from walk group by node), reach as (select node, m.c as cost, m.l as length from best)"""
STORES = "stores as (select p_partkey as id, p_name as name, split_part(p_type, ' ', 1) as category, p_brand as subcategory, (p_size % 5)::int as floor, p_partkey % 30 as node from part)"
POINTS = "points as (select vec_id as id, embedding[1]::double * 100 as x, embedding[2]::double * 100 as y from embeddings where embedding is not null)"
SAMPLES = "samples as (select user_id as session, event_id as seq, epoch_us(ts) // 1000 as ms, event_type as kind, value from events)"
HANGUL = "hangul as (select p_partkey as id, ([" + ", ".join(f"'{w}'" for w in t.BRANDS) + "])[(p_partkey % 8 + 1)::int] || ' ' || chr((44032 + p_partkey * 37 % 11172)::int) || p_size as name from part)"


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _reach(spark: SparkSession, d: str) -> DataFrame:
    walkable = graph.checked_edges(t.edges(spark, d), t.nodes(spark, d))
    return graph.reach(walkable, spark.range(1).select(F.col("id").alias("node")))


@query(f"with recursive {REACH}, {STORES} select s.id, s.name, r.length from stores s join reach r using (node) order by r.length, s.name, s.id limit 5")
def nearby_topk(spark, d):
    """The five stores at the least walking distance from node 0; stores without a reachable node drop."""
    return t.stores(spark, d).join(_reach(spark, d), "node").select("id", "name", "length").orderBy("length", "name", "id").limit(5)


@query(f"with recursive {REACH} select * from reach")
def reach_single_source(spark, d):
    return _reach(spark, d)


@query(f"with recursive {REACH}, {STORES} select s.id, r.length, row_number() over (order by r.length nulls last, s.id)::bigint as place from stores s left join reach r using (node)")
def search_order_by_reach(spark, d):
    """All stores by walking distance, unknown distances last."""
    found = t.stores(spark, d).join(_reach(spark, d), "node", "left").select("id", "length")
    return sequences.numbered(found, F.asc_nulls_last("length"), "id")


@query(f"with {EDGES}, ends as (select source as node from edges where not transfer union all select target from edges where not transfer) select node, count(*) as degree from ends group by node")
def edge_degree(spark, d):
    return graph.degree(t.edges(spark, d))


@query(f"""with {EDGES}, asked as (select id as source, (id * 3 + 2) % 40 as target from nodes),
pairs as (select distinct least(source, target) as lo, greatest(source, target) as hi from asked where source in (select id from nodes) and target in (select id from nodes))
select * from pairs p where not exists (select 1 from edges e where least(e.source, e.target) = p.lo and greatest(e.source, e.target) = p.hi)""")
def shortcut_overlay(spark, d):
    nodes = t.nodes(spark, d)
    asked = nodes.select(F.col("id").alias("source"), ((F.col("id") * 3 + 2) % 40).alias("target"))
    return graph.overlay(t.edges(spark, d), nodes, asked)


@query(f"""with {EDGES}, turns as (
  select a.source, a.target as node, b.target, ((degrees(atan2(n2.x - n1.x, n2.y - n1.y)) - degrees(atan2(n1.x - n0.x, n1.y - n0.y)) + 180) % 360 + 360) % 360 - 180 as turn
  from edges a join edges b on a.target = b.source and a.source <> b.target join nodes n0 on n0.id = a.source join nodes n1 on n1.id = a.target join nodes n2 on n2.id = b.target)
select node, count(*) as ways, round(max(abs(turn)), 6) as sharpest, count(*) filter (abs(turn) > 20) > 0 as junction from turns group by node""")
def junction_nodes(spark, d):
    """Nodes where a walker can turn by more than 20 degrees."""
    e, n = t.edges(spark, d).select("source", "target"), t.nodes(spark, d).select("id", "x", "y")
    at = lambda name, key: n.select(F.col("id").alias(key), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"))
    first = e.select("source", F.col("target").alias("node"))
    ways = first.join(e.select(F.col("source").alias("node"), "target"), "node").where("source <> target")
    ways = ways.join(at("a", "source"), "source").join(at("b", "node"), "node").join(at("c", "target"), "target")
    raw = lambda p, q: F.degrees(F.atan2(F.col(f"{q}x") - F.col(f"{p}x"), F.col(f"{q}y") - F.col(f"{p}y")))
    turn = F.abs(geo.turn_degrees(raw("a", "b"), raw("b", "c")))
    return ways.groupBy("node").agg(F.count("*").alias("ways"), F.round(F.max(turn), 6).alias("sharpest"), F.max(turn > 20).alias("junction"))


@query(f"with {STORES} select floor, category, subcategory, count(*) as n from stores where trim(category) <> '' group by all")
def floor_category_counts(spark, d):
    return t.stores(spark, d).where("trim(category) <> ''").groupBy("floor", "category", "subcategory").agg(F.count("*").alias("n"))


@query(f"with {STORES} select regexp_replace(lower(name), '[^0-9a-z가-힣ㄱ-ㆎ]', '', 'g') as key, min(id) as first_id, count(*) as members, arg_min(name, id) as name from stores group by key")
def store_name_groups(spark, d):
    """Stores by normalised name, first seen first."""
    return t.stores(spark, d).groupBy(text.match_key(F.col("name")).alias("key")).agg(F.min("id").alias("first_id"), F.count("*").alias("members"), F.min_by("name", "id").alias("name"))


@query(f"""with {HANGUL}, c as (select id, name, i, name[i] as ch, unicode(name[i]) - 44032 as n from hangul, unnest(range(1, length(name) + 1)) as u(i)),
  j as (select id, i, case when n between 0 and 11171 then '{text.LEADS}'[n // 588 + 1] else ch end as lead,
  case when n between 0 and 11171 then '{text.LEADS}'[n // 588 + 1] || '{text.VOWELS}'[n % 588 // 28 + 1] || case when n % 28 > 0 then '{text.TAILS}'[n % 28] else '' end else ch end as jamo from c)
  select id, string_agg(jamo, '' order by i) as jamo, string_agg(lead, '' order by i) as initials from j group by id""")
def jamo_forms(spark, d):
    """Every store's Hangul name as letters and as initials."""
    return t.hangul_names(spark, d).select("id", text.jamo(F.col("name")).alias("jamo"), text.initials(F.col("name")).alias("initials"))


@query(f"with {STORES}, m as (select id, name, contains(replace(lower(name), ' ', ''), 'widgetred') as hit from stores) select id, name from m where hit or not exists (select 1 from m where hit)")
def poi_relevance_fallback(spark, d):
    """Stores whose name holds the needle; all stores where none does."""
    stores = t.stores(spark, d).select("id", "name", text.collapsed(F.col("name")).contains("widgetred").alias("hit"))
    some = stores.where("hit").limit(1).select(F.lit(True).alias("some"))
    return stores.join(F.broadcast(some), F.lit(True), "left").where("hit or some is null").select("id", "name")


@query(f"with {POINTS} select id, round(sqrt(x * x + y * y), 6) as distance from points order by sqrt(x * x + y * y), id limit 12")
def nearest_around_me(spark, d):
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return t.points(spark, d).orderBy(far, "id").limit(12).select("id", F.round(far, 6).alias("distance"))


def _rings(spark, d):
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return t.points(spark, d).select("id", F.array(corner(-10, -10), corner(12, -6), corner(0, 1), corner(8, 14)).alias("ring"))


@query(f"""with {POINTS} select id, round(abs((x - 10) * (y - 6) - (x + 12) * (y - 10) + (x + 12) * (y + 1) - x * (y - 6) + x * (y + 14) - (x + 8) * (y + 1) + (x + 8) * (y - 10) - (x - 10) * (y + 14)) / 2, 6) as area from points""")
def polygon_area(spark, d):
    return _rings(spark, d).select("id", F.round(geo.polygon_area(F.col("ring")), 6).alias("area"))


@query(f"""with {POINTS}, v as (select id, [{{'x': x - 10, 'y': y - 10}}, {{'x': x + 12, 'y': y - 6}}, {{'x': x, 'y': y + 1}}, {{'x': x + 8, 'y': y + 14}}] as r from points),
e as (select id, r[i] as a, r[i % 4 + 1] as b from v, unnest([1, 2, 3, 4]) as u(i))
select id, count(*) filter ((a.y > 0) <> (b.y > 0) and 0 < (b.x - a.x) * (0 - a.y) / nullif(b.y - a.y, 0) + a.x) % 2 = 1 as inside from e group by id""")
def point_in_polygon(spark, d):
    """Whether the origin lies in each point's ring."""
    return _rings(spark, d).select("id", geo.in_polygon(F.lit(0.0), F.lit(0.0), F.col("ring")).alias("inside"))


@query(f"""with {POINTS}, s as (select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy, sum(3 * x - y + 7) as su, sum(x * (3 * x - y + 7)) as sxu, sum(y * (3 * x - y + 7)) as syu from points),
c as (select *, n * sxx - sx * sx as a, n * sxy - sx * sy as b, n * syy - sy * sy as c, n * sxu - sx * su as p, n * syu - sy * su as q from s)
select round((p * c - q * b) / (a * c - b * b), 4) as kx, round((a * q - b * p) / (a * c - b * b), 4) as ky from c""")
def affine_fit(spark, d):
    """Least-squares coefficients of u = kx x + ky y + k0 from one pass of sums."""
    x, y = F.col("x"), F.col("y")
    u = 3 * x - y + 7
    sums = t.points(spark, d).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y, "su": u, "sxu": x * u, "syu": y * u}.items()))
    normal = sums.selectExpr("n * sxx - sx * sx as a", "n * sxy - sx * sy as b", "n * syy - sy * sy as c", "n * sxu - sx * su as p", "n * syu - sy * su as q")
    return normal.selectExpr("round((p * c - q * b) / (a * c - b * b), 4) as kx", "round((a * q - b * p) / (a * c - b * b), 4) as ky")


@query(f"""with {POINTS} select id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][(floor((((degrees(atan2(x, y)) % 360) + 360) % 360 + 22.5) / 45) % 8 + 1)::int] as label from points""")
def compass_label(spark, d):
    return t.points(spark, d).select("id", geo.compass_label(geo.planar_bearing(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y"))).alias("label"))


@query(f"""with {POINTS}, s as (select id, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) as step, id % 7 as track from points window w as (partition by id % 7 order by id))
select track, round(sum(step), 6) as length, count(*) filter (step > 20) as jumps from s group by track""")
def polyline_length(spark, d):
    """Length of each track and its jumps of over 20 m."""
    w = Window.partitionBy("track").orderBy("id")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    steps = t.points(spark, d).withColumn("track", F.col("id") % 7).withColumn("step", F.sqrt(dx * dx + dy * dy))
    return steps.groupBy("track").agg(F.round(F.sum("step"), 6).alias("length"), F.count(F.when(F.col("step") > 20, 1)).alias("jumps"))


@query(f"""with {SAMPLES} select session, seq, round(greatest(0.0, coalesce(value - lag(value) over (partition by session, kind order by ms, seq), 0.0)), 6) as delta from samples""")
def counter_delta(spark, d):
    w = Window.partitionBy("session", "kind").orderBy("ms", "seq")
    return t.samples(spark, d).select("session", "seq", F.round(sequences.counter_delta(F.col("value"), w), 6).alias("delta"))


@query(f"""with {SAMPLES} select session, seq, last_value(case when kind = 'view' then value end ignore nulls) over (partition by session order by ms, seq rows between unbounded preceding and current row) as heading from samples""")
def asof_heading(spark, d):
    rows = t.samples(spark, d)
    return sequences.last_known(rows, "session", ["ms", "seq"], F.when(F.col("kind") == "view", F.col("value")), "heading").select("session", "seq", "heading")


_SESSIONS = f"""{SAMPLES}, m as (select *, coalesce((ms - lag(ms) over (partition by session order by ms, seq) > 86400000)::int, 0) as late from samples),
s as (select *, sum(late) over (partition by session order by ms, seq rows between unbounded preceding and current row) as part from m)"""


@query(f"with {_SESSIONS} select session, part::bigint as part, count(*) as samples, max(ms) - min(ms) as span_ms from s group by all")
def gap_sessions(spark, d):
    """Runs of a session's samples without a day's gap."""
    rows = sequences.gap_sessions(t.samples(spark, d).withColumnRenamed("session", "user"), "user", ["ms", "seq"], F.col("ms"), 86_400_000)
    return rows.groupBy(F.col("user").alias("session"), F.col("session").cast("long").alias("part")).agg(F.count("*").alias("samples"), (F.max("ms") - F.min("ms")).alias("span_ms"))


@query(f"""with {SAMPLES}, r as (select session, seq, avg(sin(radians(value))) over w as s, avg(cos(radians(value))) over w as c from samples window w as (partition by session order by ms, seq rows between 4 preceding and current row))
select session, seq, round(((degrees(atan2(s, c)) % 360) + 360) % 360, 4) as mean from r""")
def circular_mean_window(spark, d):
    """Circular mean of the last five headings."""
    w = Window.partitionBy("session").orderBy("ms", "seq").rowsBetween(-4, 0)
    angle = F.radians("value")
    mean = F.degrees(F.atan2(F.avg(F.sin(angle)).over(w), F.avg(F.cos(angle)).over(w)))
    return t.samples(spark, d).select("session", "seq", F.round(geo.normalised_degrees(mean), 4).alias("mean"))


@query("""with spans as (select o_custkey as customer, epoch_us(o_orderdate) // 86400000000 as s, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 60 as e from orders),
m as (select *, max(e) over (partition by customer order by s, e rows between unbounded preceding and 1 preceding) as before from spans),
i as (select *, sum((before is null or s > before)::int) over (partition by customer order by s, e rows between unbounded preceding and current row) as island from m)
select customer, min(s) as start, max(e) as end from i group by customer, island""")
def interval_merge(spark, d):
    """Spans of days of each customer, with overlapping and touching ones merged."""
    day = F.expr("datediff(o_orderdate, date'1970-01-01')").cast("long")
    spans = t.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), day.alias("start"), (day + F.col("o_orderkey") % 60).alias("end"))
    return sequences.merged_intervals(spans, "customer")


@query("""with s as (select s_suppkey as id, 480 + s_suppkey % 7 * 30 as open, (960 + s_suppkey * 37 % 900) % 1440 as close from supplier)
select id, open <> close and case when close > open then 1290 >= open and 1290 < close else 1290 >= open or 1290 < close end as is_open from s""")
def open_hours_status(spark, d):
    """Whether a place is open at 21:30; a close at or before the opening is on the next day, equal times are no span."""
    hours = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (480 + F.col("s_suppkey") % 7 * 30).alias("open"), ((960 + F.col("s_suppkey") * 37 % 900) % 1440).alias("close"))
    return hours.select("id", F.expr("open <> close and case when close > open then 1290 >= open and 1290 < close else 1290 >= open or 1290 < close end").alias("is_open"))


@query("""select o_orderkey as id, o_orderpriority as diary from orders where o_orderdate::date <= date '1996-06-01' and (o_orderdate + to_days((o_orderkey % 30)::int))::date >= date '1996-06-01'""")
def events_open_on_day(spark, d):
    orders = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("diary"), F.to_date("o_orderdate").alias("start"))
    return orders.where(F.expr("start <= date'1996-06-01' and date_add(start, cast(id % 30 as int)) >= date'1996-06-01'")).select("id", "diary")


@query("""with k as (select conv_id, lower(trim(regexp_replace(text, '[ ]+', ' ', 'g')))[1:100] as key, max(turn) as last_turn from conversations where role = 'user' and trim(text) <> '' group by all)
select * from k qualify row_number() over (partition by conv_id order by last_turn desc, key) <= 10""")
def recents_lru(spark, d):
    """Each conversation's ten latest distinct searches, case and spaces folded."""
    asked = t.table(spark, d, "conversations").where("role = 'user' and trim(text) <> ''")
    key = F.substring(F.lower(F.trim(F.regexp_replace("text", "[ ]+", " "))), 1, 100).alias("key")
    latest = asked.groupBy("conv_id", key).agg(F.max("turn").alias("last_turn"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("last_turn"), "key"))
    return latest.withColumn("place", place).where("place <= 10").drop("place")


@query(f"with {SAMPLES} select seq, round(44330.0 * (1 - ((900 + value / 5) / 1013.25) ** 0.190295), 4) as altitude from samples")
def pressure_altitude(spark, d):
    return t.samples(spark, d).select("seq", F.round(geo.pressure_altitude(900 + F.col("value") / 5), 4).alias("altitude"))


@query(f"with {SAMPLES}, m as (select seq, round(value * 13) as whole from samples) select seq, case when whole >= 1000 then format('{{:.1f}}km', floor(whole / 100) / 10) else whole::bigint || 'm' end as label from m")
def distance_label(spark, d):
    return t.samples(spark, d).select("seq", geo.distance_label(F.col("value") * 13).alias("label"))
