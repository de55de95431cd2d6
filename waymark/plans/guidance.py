"""Queries over headings, progress, entrances, places and dates that a guide works with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import dates, geo, text
from waymark.operators import motion, stateful
from waymark.plans.motion import ORDERED, TIMED, _by, _rows, _so_far, folded
from waymark.plans.queries import EDGES, POINTS, REACH, SAMPLES, STORES, _reach, query
from waymark.sources import tables as t


def _range(ms: int):
    return Window.partitionBy("session").orderBy("tick").rangeBetween(-ms, 0)


_WINDOWED = """, w as (select session, seq, tick, value, list({'s': seq, 'v': value}) over r as l, min(tick) over r as since,
    atan2(avg(sin(radians(value))) over r, avg(cos(radians(value))) over r) as mean from samples window r as (partition by session order by tick range between WIDE preceding and current row)),
d as (select session, seq, tick, since, len(l) as n, list_transform(l, lambda e: ((e.v - degrees(mean) + 180) % 360 + 360) % 360 - 180) as d, list_sort(l) as l from w)"""
_DEVIATIONS = TIMED + _WINDOWED


def _deviations(rows: DataFrame, ms: int) -> DataFrame:
    """session, seq, tick, since, n, d, net: deviations from the circular mean of a window of bounded time, and its net turn."""
    r = _range(ms)
    mean = F.degrees(F.atan2(F.avg(F.sin(F.radians("value"))).over(r), F.avg(F.cos(F.radians("value"))).over(r)))
    held = rows.select("session", "seq", "tick", F.array_sort(F.collect_list(F.struct("seq", "value")).over(r)).alias("l"), F.min("tick").over(r).alias("since"), mean.alias("mean"))
    deviations = F.transform("l", lambda e: geo.turn_degrees(F.col("mean"), e["value"]))
    net = F.abs(geo.turn_degrees(F.element_at("l", 1)["value"], F.element_at("l", -1)["value"]))
    return held.select("session", "seq", "tick", "since", F.size("l").alias("n"), deviations.alias("d"), net.alias("net"))


@query(f"""with {_DEVIATIONS.replace("WIDE", "1500")} select session, seq, case when n < 6 then 0.0
  else round(greatest(0, greatest(0, list_max(d)) - least(0, list_min(d)) - abs(((l[-1].v - l[1].v + 180) % 360 + 360) % 360 - 180)), 6) end as swing from d""")
def swing_range(spark, d):
    """Degrees by which a heading swings within 1.5 s beyond its net turn; none below six samples."""
    held = _deviations(_rows(spark, d), 1500)
    swing = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), F.array_max("d")) - F.least(F.lit(0.0), F.array_min("d")) - F.col("net"))
    return held.select("session", "seq", F.when(F.col("n") < 6, 0.0).otherwise(F.round(swing, 6)).alias("swing"))


#: Samples of a phone that is held still but for errors: each 150 ms, headings an eighth of the value.
_STEADY = SAMPLES.replace("value from events", "value / 8 + case when event_type = 'error' then 40 else 0 end as value, 150 * row_number() over (partition by user_id order by event_id) as tick from events")


def settled(held: DataFrame, samples: int = 8, span_ms: int = 1200, most_deg: float = 12.0) -> DataFrame:
    """session, seq, converged: whether a window has ever had enough samples over enough time with none far from their mean."""
    now = (F.col("n") >= samples) & (F.col("tick") - F.col("since") >= span_ms) & (F.array_max(F.transform("d", F.abs)) <= most_deg)
    return held.withColumn("settled", now).select("session", "seq", F.max("settled").over(_so_far()).alias("converged"))


@query(f"""with {_STEADY + _WINDOWED.replace("WIDE", "2000")}, h as (select *, n >= 8 and tick - since >= 1200 and list_max(list_transform(d, lambda x: abs(x))) <= 12 as held from d)
select session, seq, coalesce(bool_or(held) over (partition by session order by seq rows between unbounded preceding and current row), false) as converged from h""")
def heading_convergence(spark, d):
    """Whether a heading has ever settled: 8 samples over 1.2 s of the last 2 s, none 12 degrees from their mean."""
    steady = F.col("value") / 8 + F.when(F.col("kind") == "error", 40.0).otherwise(0.0)
    rows = t.samples(spark, d).withColumns({"value": steady, "tick": (150 * F.row_number().over(_by())).cast("long")})
    return settled(_deviations(rows, 2000))


_BASE = f"{TIMED}, b as (select session, seq, tick, value, max({{'t': tick, 's': seq, 'v': value}}) over (partition by session order by tick range between unbounded preceding and WIDE preceding) as b, first_value(value) over (partition by session order by tick, seq) as f from samples)"


def _base(rows: DataFrame, ms: int) -> DataFrame:
    """rows with base: the last sample at least so much earlier."""
    w = Window.partitionBy("session").orderBy("tick")
    return rows.withColumn("base", F.max(F.struct("tick", "seq", "value")).over(w.rangeBetween(Window.unboundedPreceding, -ms)))


@query(f"with {_BASE.replace('WIDE', '700')} select session, seq, round((value - b.v) * 1000 / (tick - b.t), 6) as slope from b where b is not null")
def strided_slope(spark, d):
    """Rise a second since the last sample that is 700 ms older or more."""
    rows = _base(_rows(spark, d), 700).where("base is not null")
    return rows.select("session", "seq", F.round((F.col("value") - F.col("base.value")) * 1000 / (F.col("tick") - F.col("base.tick")), 6).alias("slope"))


@query(f"with {_BASE.replace('WIDE', '3000')} select session, seq, round(value - coalesce(b.v, f), 6) as rise from b")
def settle_rise(spark, d):
    """Rise over a settling time of 3 s; since the first sample where none is so old."""
    first = F.first("value").over(Window.partitionBy("session").orderBy("tick", "seq"))
    return _base(_rows(spark, d).withColumn("begun", first), 3000).select("session", "seq", F.round(F.col("value") - F.coalesce("base.value", "begun"), 6).alias("rise"))


def _from_end(last: int):
    """What follows a row, told from the end, since a frame to the end is summed anew for each row."""
    return Window.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, last)


@query(f"with {TIMED} select session, seq, round(sum(value) over (partition by session order by seq rows between current row and unbounded following), 4) as remaining from samples")
def remaining_sums(spark, d):
    """What is left from each sample to its session's end."""
    return _rows(spark, d).select("session", "seq", F.round(F.sum("value").over(_from_end(0)), 4).alias("remaining"))


@query(f"""with {TIMED}, m as (select *, floor(value / 40)::int as edge, coalesce((floor(value / 40) <> lag(floor(value / 40)) over (partition by session order by seq))::int, 0) as moved from samples),
g as (select *, sum(moved) over (partition by session order by seq rows between unbounded preceding and current row) as run from m)
select session, run::bigint as run, edge, count(*) as samples from g group by all""")
def edge_runs(spark, d):
    """Runs of samples on one edge."""
    rows = _rows(spark, d).withColumn("edge", F.floor(F.col("value") / 40).cast("int"))
    moved = F.coalesce((F.col("edge") != F.lag("edge").over(_by())).cast("int"), F.lit(0))
    return rows.withColumn("moved", moved).withColumn("run", F.sum("moved").over(_so_far()).cast("long")).groupBy("session", "run", "edge").agg(F.count("*").alias("samples"))


@query(f"""with {TIMED}, s as (select session, seq, abs(value - lag(value) over (partition by session order by seq)) as step from samples),
b as (select session, seq, coalesce(sum(step) over (partition by session order by seq desc rows between unbounded preceding and 1 preceding), 0) as back from s)
select session, seq, round(back, 6) as back from b where round(back, 6) <= 200""")
def last_metres(spark, d):
    """The points of a path's last 200 m and how far they are from its end."""
    steps = _rows(spark, d).withColumn("step", F.abs(F.col("value") - F.lag("value").over(_by())))
    back = F.round(F.coalesce(F.sum("step").over(Window.partitionBy("session").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 6)
    return steps.select("session", "seq", back.alias("back")).where("back <= 200")


_PROGRESS = """(select case when abs(v - z.a) > 3 + greatest(0, o.seq // 40 - z.n) * 1.2 then {'a': z.a, 'n': z.n, 'k': 'jump'} when z.a - v > 2 and o.kind <> 'error' then {'a': z.a, 'n': z.n, 'k': 'back'}
  else {'a': v, 'n': o.seq // 40, 'k': 'shown'} end from (select s as z, o.value / 10 as v))"""


@query(folded("{'a': value / 10, 'n': seq // 40, 'k': 'shown'}", _PROGRESS, "s.k as verdict, round(s.a, 6) as shown"))
def progress_holds(spark, d):
    """Progress as shown: jumps that steps do not explain are held, and ways back that are not confirmed."""
    rows = _rows(spark, d).select("session", "seq", (F.col("value") / 10).alias("travelled"), F.expr("seq div 40").alias("steps"), (F.col("kind") == "error").alias("reverse"))
    return stateful.replay(rows, "session", "seq", motion.PROGRESS).withColumn("shown", F.round("shown", 6))


@query(folded("{'m': value}", "{'m': 0.8 * s.m + 0.2 * o.value}", "round(s.m, 6) as cadence"))
def cadence_mean(spark, d):
    """Cadence as an exponential mean."""
    rows = _rows(spark, d).select("session", "seq", "value")
    return stateful.replay(rows, "session", "seq", motion.smoothed(0.8)).select("session", "seq", F.round("mean", 6).alias("cadence"))


@query(folded("{'a': tick, 'k': true}", "case when o.tick - s.a >= 180 then {'a': o.tick, 'k': true} else {'a': s.a, 'k': false} end", "s.k as sent"))
def pressure_throttle(spark, d):
    """Samples of pressure that are sent, one in 180 ms."""
    return stateful.replay(_rows(spark, d).select("session", "seq", F.col("tick").alias("ms")), "session", "seq", motion.sent_after(180))


_DOORS = f"""{EDGES}, doors as (select id, x, y from nodes where floor = 0), {ORDERED.replace("select *, row_number()", "select *, seq % 97 as px, value * 3 % 80 as py, row_number()")},
near as (select session, seq, rn, px, py, (select min({{'d': round(sqrt((x - px) ** 2 + (y - py) ** 2), 9), 'id': id}}).id from doors) as door from o),
o2 as (select n.*, x as dx, y as dy from near n join doors on id = door)"""


@query(f"""with recursive {_DOORS}, r as (select session, seq, rn, {{'id': door, 'x': dx, 'y': dy}} as s from o2 where rn = 1
  union all select o.session, o.seq, o.rn, case when o.door = s.id or sqrt((o.px - s.x) ** 2 + (o.py - s.y) ** 2) - sqrt((o.px - o.dx) ** 2 + (o.py - o.dy) ** 2) > 15 then {{'id': o.door, 'x': o.dx, 'y': o.dy}} else s end
  from r join o2 o on o.session = r.session and o.rn = r.rn + 1) select session, seq, s.id as used from r""")
def entrance_hysteresis(spark, d):
    """The entrance in use: the nearest one, once it is nearer than the held one by 15 m."""
    doors = t.nodes(spark, d).where("floor = 0").agg(F.collect_list(F.struct("id", "x", "y")).alias("doors"))  # the entrances of one building
    rows = _rows(spark, d).select("session", "seq", (F.col("seq") % 97).cast("double").alias("x"), (F.col("value") * 3 % 80).alias("y"))
    each = F.transform("doors", lambda e: F.struct(F.round(F.hypot(e["x"] - F.col("x"), e["y"] - F.col("y")), 9).alias("far"), e["id"].alias("door"), e["x"].alias("door_x"), e["y"].alias("door_y")))
    near = rows.join(F.broadcast(doors), F.lit(True)).select("session", "seq", "x", "y", F.array_min(each).alias("b"))
    return stateful.replay(near.select("session", "seq", "x", "y", "b.door", "b.door_x", "b.door_y"), "session", "seq", motion.ENTRANCE)


@query(f"""with recursive {REACH}, {STORES} select category, arg_min(s.id, {{'u': r.length is null, 'l': coalesce(r.length, 0), 'f': s.floor <> 0, 'id': s.id}}) as id, min(r.length) as length from stores s left join reach r using (node) group by category""")
def nearest_by_walking(spark, d):
    """The store of each category at the least walking distance; the current floor's first where none can be reached."""
    found = t.stores(spark, d).join(_reach(spark, d), "node", "left")
    order = F.struct(F.col("length").isNull(), F.coalesce("length", F.lit(0.0)), F.col("floor") != 0, "id")
    return found.groupBy("category").agg(F.min_by("id", order).alias("id"), F.min("length").alias("length"))


@query(f"with {POINTS} select id % 7 as track, round((min(x) + max(x)) / 2, 6) as cx, round((min(y) + max(y)) / 2, 6) as cy, round(max(x) - min(x), 6) as width, round(max(y) - min(y), 6) as height, round(avg(x), 6) as mx, round(avg(y), 6) as my from points group by track")
def bounds_and_centres(spark, d):
    """Box, its centre and the mean of each track."""
    x, y = F.col("x"), F.col("y")
    middle = lambda c: F.round((F.min(c) + F.max(c)) / 2, 6)
    return t.points(spark, d).groupBy((F.col("id") % 7).alias("track")).agg(
        middle(x).alias("cx"), middle(y).alias("cy"), F.round(F.max(x) - F.min(x), 6).alias("width"), F.round(F.max(y) - F.min(y), 6).alias("height"), F.round(F.avg(x), 6).alias("mx"), F.round(F.avg(y), 6).alias("my")
    )


@query(f"with {STORES} select floor, string_agg(distinct category, ',' order by category) as categories, count(distinct subcategory) as subcategories from stores where trim(category) <> '' group by floor")
def category_options(spark, d):
    """The distinct categories of each floor in order, and how many subcategories there are."""
    shown = t.stores(spark, d).where("trim(category) <> ''").groupBy("floor")
    return shown.agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count_distinct("subcategory").alias("subcategories"))


@query(f"with {STORES} select id, name, node from stores where subcategory = 'Brand#11' and node > 0 and floor = 0")
def ground_entrances(spark, d):
    """Stores that are tagged as entrances, on the ground and with a node."""
    return t.stores(spark, d).where("subcategory = 'Brand#11' and node > 0 and floor = 0").select("id", "name", "node")


@query(f"""with {STORES}, every as (select 0 as part, id, case when node < 10 then 'node:' || node else 'name:' || lower(name) end as identity from stores union all
  select 1, s_suppkey, case when s_suppkey % 4 = 0 then 'node:' || s_suppkey % 30 else 'name:' || lower(s_name) end from supplier)
select identity, min({{'p': part, 'i': id}}).p as part, min({{'p': part, 'i': id}}).i as id from every group by identity""")
def union_by_identity(spark, d):
    """Stores and outside rows together, the first of each identity: its node where it has one, else its name."""
    first = t.stores(spark, d).select(F.lit(0).alias("part"), "id", F.when(F.col("node") < 10, F.concat(F.lit("node:"), "node")).otherwise(F.concat(F.lit("name:"), F.lower("name"))).alias("identity"))
    key = F.col("s_suppkey")
    outside = t.table(spark, d, "supplier").select(F.lit(1).alias("part"), key.alias("id"), F.when(key % 4 == 0, F.concat(F.lit("node:"), key % 30)).otherwise(F.concat(F.lit("name:"), F.lower("s_name"))).alias("identity"))
    return first.unionByName(outside).groupBy("identity").agg(F.min(F.struct("part", "id")).alias("m")).select("identity", "m.part", "m.id")


@query("""with f as (select o_custkey as customer, o_orderkey % 5 as place, count(*) as turns, max(o_orderkey) as last from orders group by all)
select customer, place, row_number() over (partition by customer order by last) as position from f where turns % 2 = 1""")
def favourites(spark, d):
    """Each customer's favourites after all toggles, in the order in which they were put in last."""
    turns = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 5).alias("place")).agg(F.count("*").alias("turns"), F.max("o_orderkey").alias("last"))
    return turns.where("turns % 2 = 1").select("customer", "place", F.row_number().over(Window.partitionBy("customer").orderBy("last")).cast("long").alias("position"))


_WRITTEN = "written as (select o_orderkey as id, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then '1996-02-' || (28 + o_orderkey % 3) when 2 then strftime(o_orderdate, '%Y-%-m-%-d') else 'soon' end as day from orders)"


@query(f"""with {_WRITTEN}, p as (select id, case when regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast(day as date) end as read from written)
select id, strftime(read, '%Y-%m-%d') as read, read is null or date_diff('day', read, date '1996-06-01') > 90 as stale from p""")
def staleness(spark, d):
    """Dates as they can be read strictly, and whether what was confirmed then is too old on 1996-06-01; what cannot be read is."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    loose = F.concat_ws("-", F.date_format(day, "yyyy"), F.month(day), F.dayofmonth(day))
    written = F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 4 == 1, F.concat(F.lit("1996-02-"), 28 + key % 3)).when(key % 4 == 2, loose).otherwise("soon")
    read = dates.strict_date(F.col("day"))
    rows = t.table(spark, d, "orders").select(key.alias("id"), written.alias("day")).withColumn("read", read)
    return rows.select("id", F.date_format("read", "yyyy-MM-dd").alias("read"), dates.is_stale(F.col("read"), F.lit("1996-06-01").cast("date")).alias("stale"))


_CLOCK = "clock as (select o_orderkey as id, (o_orderkey % 27) || ':' || (case when o_orderkey % 3 = 0 then '00' when o_orderkey % 3 = 1 then '30' else '7' end) as told from orders)"


@query(f"""with {_CLOCK}, p as (select id, told, split_part(told, ':', 1)::int as h, split_part(told, ':', 2) as m from clock)
select id, case when length(m) = 2 and (h < 24 or (h = 24 and m = '00')) then h * 60 + m::int end as minute from p""")
def minute_parse(spark, d):
    """Minutes of the day of written hours; 24:00 is one, 24:30 is none."""
    key = F.col("o_orderkey")
    told = F.concat((key % 27).cast("string"), F.lit(":"), F.when(key % 3 == 0, "00").when(key % 3 == 1, "30").otherwise("7"))
    return t.table(spark, d, "orders").select(key.alias("id"), dates.minute_of(told).alias("minute"))


@query("""with days as (select s_suppkey as id, unnest(range(7)) as day from supplier),
h as (select id, day, 480 + id % 7 * 30 as o, (960 + id * 37 % 900) % 1440 as c, id % 7 = (day + 3) % 7 as off, id % 5 = 0 and day = 1 as special from days)
select id, day, case when special then case when id % 10 = 0 then 'closed' else '600-720' end when off then 'closed' else o || '-' || c end as hours from h""")
def week_table(spark, d):
    """Hours of the next seven days, a dated exception in place of the whole day."""
    days = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("day"))
    weekly = F.when(F.col("id") % 7 == (F.col("day") + 3) % 7, "closed").otherwise(F.concat_ws("-", 480 + F.col("id") % 7 * 30, (960 + F.col("id") * 37 % 900) % 1440))
    special = F.when((F.col("id") % 5 == 0) & (F.col("day") == 1), F.when(F.col("id") % 10 == 0, "closed").otherwise("600-720"))
    return days.select("id", "day", F.coalesce(special, weekly).alias("hours"))


_LIFTS = "lifts as (select p_partkey as id, p_brand || (case p_partkey % 4 when 0 then '-UP (TO ' when 1 then '-dn(FR' when 2 then ' - DOWN ( to ' else '-UP TO ' end) || 'B' || p_size || (case when p_partkey % 5 = 0 then '' else ')' end) as name from part)"


@query(rf"""with {_LIFTS}, p as (select id, regexp_extract(name, '^(.*?)-\s*(UP|DN|DOWN)\s*\(\s*(TO|FR)\s*([A-Za-z0-9]+)\s*\)$', ['g', 'way', 'side', 'floor'], 'i') as p from lifts)
select id, trim(p.g) as bank, case when upper(p.way) = 'UP' then 'up' else 'down' end as way, upper(p.side) = 'TO' as arrives, p.floor as floor from p where p.way <> ''""")
def escalator_names(spark, d):
    """Bank, direction and floor that an escalator's node name tells; other names tell nothing."""
    key = F.col("p_partkey")
    middle = F.when(key % 4 == 0, "-UP (TO ").when(key % 4 == 1, "-dn(FR").when(key % 4 == 2, " - DOWN ( to ").otherwise("-UP TO ")
    name = F.concat("p_brand", middle, F.lit("B"), F.col("p_size").cast("string"), F.when(key % 5 == 0, "").otherwise(")"))
    return t.table(spark, d, "part").select(key.alias("id"), text.escalator_name(name).alias("e")).where("e is not null").select("id", "e.bank", "e.way", "e.arrives", "e.floor")


@query(f"""with {POINTS}, p as (select 37.5 + y / 5000 as lat, 127.0 + x / 5000 as lng, id from points),
m as (select id, lat, lng, (lng - 127.0) * cos(radians(37.5)) * 111320 as ex, (lat - 37.5) * 111320 as ny from p)
select id, round(ex, 4) as east, round(ny, 4) as north, round(37.5 + ny / 111320, 9) as lat, round(127.0 + ex / (111320 * cos(radians(37.5))), 9) as lng,
  round(sqrt(((lng - 127.0) * cos(radians((37.5 + lat) / 2))) ** 2 + (lat - 37.5) ** 2) * 111320, 4) as metres from m""")
def local_metres(spark, d):
    """Places in metres around a reference, back again, and their distance from it."""
    lat0, lng0 = F.lit(37.5), F.lit(127.0)
    places = t.points(spark, d).select("id", (lat0 + F.col("y") / 5000).alias("lat"), (lng0 + F.col("x") / 5000).alias("lng"))
    east, north = geo.project(F.col("lat"), F.col("lng"), lat0, lng0)
    lat, lng = geo.unproject(F.col("east"), F.col("north"), lat0, lng0)
    metres = geo.equirectangular_metres(lat0, lng0, F.col("lat"), F.col("lng"))
    return places.withColumns({"east": east, "north": north, "metres": metres}).select("id", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"), F.round("metres", 4).alias("metres"))


_PAIRS = f"{POINTS}, pairs as (select id % 7 as g, x, y, 2 * (0.6 * x - 0.8 * y) + 5 + sin(id::double) as u, 2 * (0.8 * x + 0.6 * y) - 3 + cos(id::double) as v from points)"


@query(f"""with {_PAIRS}, s as (select g, count(*) as n, var_pop(x) + var_pop(y) as a, covar_pop(x, u) + covar_pop(y, v) as p, covar_pop(x, v) - covar_pop(y, u) as q,
  covar_pop(x, u) - covar_pop(y, v) as fp, covar_pop(x, v) + covar_pop(y, u) as fq, var_pop(u) + var_pop(v) as b from pairs group by g)
select g, fp * fp + fq * fq > p * p + q * q as mirrored, round(sqrt(greatest(p * p + q * q, fp * fp + fq * fq)) / a, 6) as scale, round(degrees(case when fp * fp + fq * fq > p * p + q * q then atan2(fq, fp) else atan2(q, p) end), 4) as angle,
  round(sqrt(greatest(0, b - greatest(p * p + q * q, fp * fp + fq * fq) / a)), 6) as rms from s where n >= 2""")
def procrustes_fit(spark, d):
    """Rotation or mirror, scale and remaining error between two point sets, from one pass of sums."""
    x, y, i = F.col("x"), F.col("y"), F.col("id").cast("double")
    pairs = t.points(spark, d).select((F.col("id") % 7).alias("g"), x, y, (2 * (0.6 * x - 0.8 * y) + 5 + F.sin(i)).alias("u"), (2 * (0.8 * x + 0.6 * y) - 3 + F.cos(i)).alias("v"))
    fit = pairs.groupBy("g").agg(*geo.similarity_sums(), F.count("*").alias("n")).where("n >= 2")
    return fit.select("g", *(c if k == "mirrored" else F.round(c, 4 if k == "angle" else 6).alias(k) for k, c in geo.similarity(F.col).items()))
