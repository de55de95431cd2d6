"""Queries over parts of paths, and lists in an order of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.plans.motion import _so_far
from waymark.plans.queries import POINTS, STORES, query
from waymark.plans.verdicts import _PATH, _path
from waymark.sources import tables as t

_DONE = f"{_PATH}, r as (select session, seq, x, y, nx, ny, sum(coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0)) over (partition by session order by seq) as done, sqrt((nx - x) ** 2 + (ny - y) ** 2) as after from l), w as (select *, max(done) over (partition by session) as total from r)"


def _whole():
    return Window.partitionBy("session")


def _done(spark, d):
    """The vertices of ``_path`` with the metres done at each, the whole path's, and the next vertex."""
    path = _path(spark, d).withColumn("done", F.sum(F.coalesce("before", F.lit(0.0))).over(_so_far()))
    ahead = Window.partitionBy("session").orderBy("seq")
    return path.withColumns({"total": F.max("done").over(_whole()), "nx": F.lead("x").over(ahead), "ny": F.lead("y").over(ahead)})


# Fixed values in metres: gaps to a destination that are closed, from which a way back is looked for, the longest cut, and how much shorter it must be.
LEAST_GAP, MOST_GAP, SNAP, CUT, RATIO = 3, 150, 20, 80, 1.5


@query(f"""with {_DONE}, e as (select session, count(*) as n, max(seq) as last, max(done) as total, arg_max(x, seq) + session % 60 * 4 as dx, arg_max(y, seq) as dy, session % 60 * 4 as gap from r group by session),
s as (select r.session, seq, done, round(sqrt((x - dx) ** 2 + (y - dy) ** 2), 9) as straight, total, gap from r join e on e.session = r.session where gap > 20 and seq < last and total > 0),
c as (select session, min({{'s': seq, 'm': done + straight}}) as c from s where straight <= 80 and straight * 1.5 < total - done + gap group by session)
select e.session, case when c.c is not null then 'cut' when n < 2 or gap < 3 or gap > 150 then 'kept' else 'extended' end as kind, round(coalesce(c.c.m, total), 4) as metres, c.c.s as cut_at from e left join c on c.session = e.session""")
def route_tail(spark, d):
    """Routes that end beside their destination: led on to it, or cut where a straight way saves a detour."""
    gap = F.col("session") % 60 * 4
    end = F.max(F.struct("seq", "x", "y")).over(_whole())
    rows = _done(spark, d).withColumn("end", end).withColumn("gap", gap)
    straight = F.round(F.hypot(F.col("x") - F.col("end.x") - F.col("gap"), F.col("y") - F.col("end.y")), 9)
    rows = rows.withColumn("straight", straight)
    saves = (F.col("gap") > SNAP) & (F.col("seq") < F.col("end.seq")) & (F.col("total") > 0) & (F.col("straight") <= CUT) & (F.col("straight") * RATIO < F.col("total") - F.col("done") + F.col("gap"))
    cut = F.min(F.when(saves, F.struct("seq", (F.col("done") + F.col("straight")).alias("m"))))
    found = rows.groupBy("session").agg(cut.alias("c"), F.count("*").alias("n"), F.max("gap").alias("gap"), F.max("total").alias("total"))
    kept = (F.col("n") < 2) | (F.col("gap") < LEAST_GAP) | (F.col("gap") > MOST_GAP)
    kind = F.when(F.col("c").isNotNull(), "cut").when(kept, "kept").otherwise("extended")
    return found.select("session", kind.alias("kind"), F.round(F.coalesce("c.m", "total"), 4).alias("metres"), F.col("c.seq").alias("cut_at"))


_AT = "round({v} + (n{v} - {v}) * (goal - done) / after, 4) as {v}"
_ENDS = f"cut as (select session, goal, {_AT.format(v='x')}, {_AT.format(v='y')} from asked where done <= goal and goal < done + after)"


def _cut(rows):
    """session, goal, x, y: the points of paths at the metres asked for."""
    on = lambda c: F.round(F.col(c) + (F.col("n" + c) - F.col(c)) * (F.col("goal") - F.col("done")) / F.col("after"), 4).alias(c)
    return rows.where("done <= goal and goal < done + after").select("session", "goal", on("x"), on("y"))


@query(f"""with {_DONE}, asked as (select *, total * 0.4 as goal from w), {_ENDS}, n as (select session, count(*) filter (done <= goal) as completed, count(*) filter (done > goal) as remaining from asked group by session)
select session, completed, remaining, x, y from n join cut using (session)""")
def split_path(spark, d):
    """Each path parted where two fifths of it are done: vertices on both sides, and the point between."""
    asked = _done(spark, d).withColumn("goal", F.col("total") * 0.4)
    parts = asked.groupBy("session").agg(F.count_if(F.col("done") <= F.col("goal")).alias("completed"), F.count_if(F.col("done") > F.col("goal")).alias("remaining"))
    return parts.join(_cut(asked), "session").select("session", "completed", "remaining", "x", "y")


@query(f"""with {_DONE}, asked as (select *, total * unnest([0.25, 0.6]) as goal from w), {_ENDS}
select session, round(goal, 4) as metres, x, y from cut union all select session, round(done, 4), round(x, 4), round(y, 4) from w where done > total * 0.25 and done < total * 0.6""")
def subpath(spark, d):
    """The points of each path from a quarter to three fifths of it, both ends put in."""
    path = _done(spark, d)
    ends = _cut(path.withColumn("share", F.explode(F.array(F.lit(0.25), F.lit(0.6)))).withColumn("goal", F.col("total") * F.col("share")))
    inner = path.where("done > total * 0.25d and done < total * 0.6d").select("session", F.col("done").alias("goal"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
    return ends.unionByName(inner).select("session", F.round("goal", 4).alias("metres"), "x", "y")


@query(f"""with {POINTS}, c as (select id, 37.5 + (y + unnest([-10, -6, 1, 14])) / 5000 as lat, 127 + (x + unnest([-10, 12, 0, 8])) / 5000 as lng from points)
select id, round((max(lng) - min(lng)) * 111320 * cos(radians(avg(lat))), 4) as width from c group by id""")
def polygon_width(spark, d):
    """Metres from west to east of each ring."""
    corner = lambda dx, dy: F.struct((37.5 + (F.col("y") + dy) / 5000).alias("lat"), (127 + (F.col("x") + dx) / 5000).alias("lng"))
    ring = F.array(corner(-10, -10), corner(12, -6), corner(0, 1), corner(8, 14))
    return t.points(spark, d).select("id", F.round(geo.polygon_width(ring), 4).alias("width"))


@query("""with k as (select o_custkey as customer, case when o_orderkey % 3 = 0 then 'node:' || o_orderkey % 7 else 'name:' || lower(o_orderpriority) end as key, max({'d': o_orderdate, 'k': o_orderkey}) as m from orders group by all)
select customer, key, row_number() over (partition by customer order by m desc) as place from k qualify place <= 10""")
def recent_route_points(spark, d):
    """The ten ends of routes that each customer used last, by node where there is one, else by name."""
    order = F.col("o_orderkey")
    key = F.when(order % 3 == 0, F.concat(F.lit("node:"), order % 7)).otherwise(F.concat(F.lit("name:"), F.lower("o_orderpriority")))
    used = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer"), key.alias("key")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    place = F.row_number().over(Window.partitionBy("customer").orderBy(F.desc("m")))
    return used.withColumn("place", place.cast("long")).where("place <= 10").select("customer", "key", "place")


# Labels that come first, then those with an order of their own.
LABELS = ("전체", "음식점", "카페", "패션", "뷰티", "식품관", "키즈", "리빙", "편의시설")
_LABELS = "[" + ", ".join(f"'{label}'" for label in LABELS) + "]"


@query(f"""with {STORES}, s as (select distinct floor, case id % 8 when 0 then '전체' when 1 then '카페' when 2 then '패션' when 3 then null when 4 then ' ' when 5 then lower(category) when 6 then '음식점' else category end as label from stores)
select floor, label, row_number() over (partition by floor order by coalesce(nullif(list_position({_LABELS}, label), 0), 99), lower(label), label) as place from s where trim(label) <> ''""")
def label_order(spark, d):
    """The labels of each floor: the leading one, those with a fixed place, the rest by letters."""
    key = F.col("id") % 8
    label = F.when(key == 0, "전체").when(key == 1, "카페").when(key == 2, "패션").when(key == 3, None).when(key == 4, " ").when(key == 5, F.lower("category")).when(key == 6, "음식점").otherwise(F.col("category"))
    shown = t.stores(spark, d).select("floor", label.alias("label")).where("trim(label) <> ''").distinct()
    fixed = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")), F.lit(0).cast("long")), F.lit(99).cast("long"))
    return shown.select("floor", "label", F.row_number().over(Window.partitionBy("floor").orderBy(fixed, F.lower("label"), "label")).cast("long").alias("place"))


@query("""with i as (select l_orderkey as id, l_linenumber as pos, case when l_linenumber = 6 and l_orderkey % 2 = 0 then null else l_returnflag end as tab from lineitem), f as (select id, tab, min(pos) as pos from i group by all)
select id, case when bool_or(tab is null) or count(*) < 2 then '' else string_agg(tab, ',' order by pos, tab) end as tabs from f group by id""")
def menu_tabs(spark, d):
    """The tabs of each menu in order of appearance; none if an item has no tab or all have the same."""
    tab = F.when((F.col("l_linenumber") == 6) & (F.col("l_orderkey") % 2 == 0), None).otherwise(F.col("l_returnflag"))
    first = t.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), tab.alias("tab")).agg(F.min("l_linenumber").alias("pos"))
    seen = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "tab"))).alias("l"))  # as many as there are tabs
    missing = F.exists("l", lambda e: e["tab"].isNull())
    return seen.select("id", F.when(missing | (F.size("l") < 2), "").otherwise(F.array_join(F.col("l.tab"), ",")).alias("tabs"))


@query("""select 0 as part, p_partkey as id, p_name as name from part union all select 1, s_suppkey, s_name from supplier union all select 2, c_custkey, c_name from customer where c_name not in (select s_name from supplier)""")
def route_candidates(spark, d):
    """Ends that a route can have: stores, buildings, and outside places that no building has by name; part and id are their order."""
    rows = lambda part, name, key, label: t.table(spark, d, name).select(F.lit(part).alias("part"), F.col(key).alias("id"), F.col(label).alias("name"))
    buildings = rows(1, "supplier", "s_suppkey", "s_name")
    outside = rows(2, "customer", "c_custkey", "c_name").join(buildings.select("name"), "name", "left_anti")
    return rows(0, "part", "p_partkey", "p_name").unionByName(buildings).unionByName(outside)
