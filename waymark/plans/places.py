"""Queries over stores, places of outside services, events and opening hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import calendar, search, sequences
from waymark.plans.queries import HANGUL, POINTS, STORES, query
from waymark.sources import tables as t

GROUPS = STORES + """, groups as (select regexp_replace(lower(name), '[^0-9a-z가-힣ㄱ-ㆎ]', '', 'g') as key, min(id) as first_id from stores group by key)"""


def _hits(q: str) -> str:
    return f"select key, first_id, instr(key, '{q}')::int - 1 as rank_in_kind, case when instr(key, '{q}') = 1 then 0 else 2 end as kind from groups where contains(key, '{q}') order by kind, rank_in_kind, length(key), first_id limit 8"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return search.name_groups(t.stores(spark, d))


@query(f"with {GROUPS} {_hits('widget')}")
def suggest_prefix(spark, d):
    """Names that begin with the typed letters."""
    return search.suggest(_groups(spark, d), "Widget")


@query(f"with {GROUPS} {_hits('l')}")
def suggest_partial(spark, d):
    """Names that hold the typed letters, nearer to the start first."""
    return search.suggest(_groups(spark, d), "l")


@query(f"""with {GROUPS}, near as (select key, first_id, (select min(levenshtein('bluw', key[1:k])) from unnest(range(0, length(key) + 1)) as u(k)) as distance from groups)
select key, first_id, distance::int as rank_in_kind, 3 as kind from near where distance <= 1 and not exists (select 1 from groups where contains(key, 'bluw')) order by distance, length(key), first_id limit 8""")
def suggest_correction(spark, d):
    """Names a typo away from the query's letters, only where nothing holds the query itself."""
    return search.suggest(_groups(spark, d), "bluw")


_LETTERS = f"""with {HANGUL}, w as (select regexp_replace(lower(name), '[^0-9a-z가-힣ㄱ-ㆎ]', '', 'g') as key, min(id) as id from hangul group by key),
c as (select id, key, i, key[i] as ch, unicode(key[i]) - 44032 as n from w, unnest(range(1, length(key) + 1)) as u(i)),
l as (select id, key, string_agg(case when n between 0 and 11171 then '{text.LEADS}'[n // 588 + 1] else ch end, '' order by i) as initials from c group by all)"""


@query(f"{_LETTERS} select key, id as first_id, 0 as rank_in_kind, 1 as kind from l where starts_with(initials, 'ㅅㅌ') order by length(key), id limit 8")
def suggest_initials(spark, d):
    """Names by the first letters of their syllables."""
    return search.suggest(search.name_groups(t.hangul_names(spark, d)), "ㅅㅌ")


@query(f"{_LETTERS.replace("from hangul group", "from (select * from hangul union all select 1, '나이키') group")}, s as (select key, id from l where starts_with(key, '나이키') order by length(key), id limit 8) select key, id as first_id from s where key <> '나이키' and exists (select 1 from s where key = '나이키')")
def name_siblings(spark, d):
    """What the suggestions hold besides the name that a search confirmed; nothing where they do not hold it."""
    names = t.hangul_names(spark, d)
    names = names.unionByName(names.where("id = 1").select("id", F.lit("나이키").alias("name")))
    return search.siblings(search.suggest(search.name_groups(names), "나이"), "나이키").select("key", "first_id")


_SHOPS = """shops as (select p_partkey as id, replace(p_brand, '#', '') || p_size || ' ' || p_name as name, p_partkey % 5 as floor, p_partkey % 30 as node from part),
pois as (select p_partkey as id, replace(p_brand, '#', '') || p_size || ' branch (' || p_partkey * 3 % 7 || 'F)' as name, p_partkey % 2 = 0 as inside from part),
pairs as (select p.id, s.id as store_id, s.floor::text = (p.id * 3 % 7)::text as same from pois p join shops s on
  starts_with(replace(lower(s.name), ' ', ''), lower(split_part(p.name, ' ', 1))) or starts_with(lower(split_part(p.name, ' ', 1)), replace(lower(s.name), ' ', ''))),
matched as (select p.id, p.name, p.inside, case when count(m.store_id) = 1 then min(m.store_id) when count(*) filter (m.same) = 1 then min(m.store_id) filter (m.same) end as store_id from pois p left join pairs m on p.id = m.id group by all)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    brand = F.concat(F.regexp_replace("p_brand", "#", ""), F.col("p_size"))
    part, key = t.table(spark, d, "part"), F.col("p_partkey")
    shops = part.select(key.alias("id"), F.concat(brand, F.lit(" "), "p_name").alias("name"), (key % 5).alias("floor"), (key % 30).alias("node"))
    pois = part.select(key.alias("id"), F.concat(brand, F.lit(" branch ("), key * 3 % 7, F.lit("F)")).alias("name"), (key % 2 == 0).alias("inside"))
    return search.match_brands(pois, shops)


@query(f"with {_SHOPS} select id, store_id from matched")
def brand_floor_match(spark, d):
    """The store that a place of an outside service stands for, if there is just one."""
    return _matched(spark, d).select("id", "store_id")


@query(f"with {_SHOPS} select id, name from matched where not (inside and store_id is not null)")
def poi_indoor_merge(spark, d):
    """Outside places, without those in the building that a store row shows already."""
    return _matched(spark, d).where("not (inside and store_id is not null)").select("id", "name")


@query(f"""with {STORES}, n as (select distinct name from (select name from stores union all select split_part(name, ' ', 1) from stores union all select split_part(name, ' ', 2) from stores) where name <> '')
select a.name, count(*) as parts from n a join n b on a.name <> b.name and contains(a.name, b.name) group by a.name having count(*) >= 2""")
def aggregate_store_ids(spark, d):
    """Names that hold two or more other names."""
    word = F.split("name", " ")
    stores = t.stores(spark, d)
    names = stores.select("name").unionByName(stores.select(F.explode(F.slice(word, 1, 2)).alias("name")))
    return search.aggregates(names)


@query("""with r as (select p_partkey as id, p_brand as brand, [p_brand || '.', 'Size ' || p_size % 3 || '.', p_name] as s from part),
c as (select brand, one, count(*) as c from (select brand, unnest(s) as one from r) group by all), n as (select brand, count(*) as n from r group by brand),
k as (select brand, list_sort(list(one)) as shared from c join n using (brand) where n >= 2 and c = n group by brand)
select id, array_to_string(coalesce(shared, []), ',') as shared, nullif(array_to_string(list_filter(s, lambda x: not list_contains(coalesce(shared, []), x)), ' '), '') as own from r left join k using (brand)""")
def shared_sentences(spark, d):
    """What a store's reason says that not every store of its brand says."""
    reason = F.concat("p_brand", F.lit(". Size "), F.col("p_size") % 3, F.lit(". "), "p_name")
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), reason.alias("reason"))
    return search.distinctive(rows, "brand", "reason").select("id", F.array_join("shared", ",").alias("shared"), "own")


@query("""with m as (select l_orderkey as id, list_sort(list(distinct case l_returnflag when 'R' then 'bus' when 'A' then 'subway' end)) as modes from lineitem group by l_orderkey),
k as (select case when modes = ['bus'] then 'bus' when modes = ['subway'] then 'subway' when modes = ['bus', 'subway'] then 'bus+subway' else 'all' end as kind from (select id, list_filter(modes, lambda x: x is not null) as modes from m))
select kind, count(*) as n from k group by kind""")
def itinerary_filter(spark, d):
    """Itineraries by the set of their modes, walking left out: orders are itineraries, their lines legs."""
    mode = F.when(F.col("l_returnflag") == "R", "bus").when(F.col("l_returnflag") == "A", "subway")
    rides = t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max((mode == "bus").cast("int")).alias("bus"), F.max((mode == "subway").cast("int")).alias("subway"))
    kind = F.expr("case when bus = 1 and subway = 1 then 'bus+subway' when bus = 1 then 'bus' when subway = 1 then 'subway' else 'all' end")
    return rides.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""with o as (select o_custkey as customer, o_orderkey % 3 as geometry, o_orderpriority as kind, o_orderkey as route from orders),
k as (select customer, geometry, kind, min(route) as route from o group by all)
select customer, geometry, string_agg(kind, ',' order by kind) as kinds, arg_min(route, kind) as route from k group by all""")
def route_option_merge(spark, d):
    """Alternatives of one geometry as one option, with its kinds in order and the first kind's route."""
    o = t.table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 3).alias("geometry"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("route"))
    kinds = o.groupBy("customer", "geometry", "kind").agg(F.min("route").alias("route"))
    return kinds.groupBy("customer", "geometry").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.min_by("route", "kind").alias("route"))


@query(f"with {POINTS}, s as (select round(x, 0) as gx, round(y, 0) as gy, min(id) as id from points group by all) select id, gx, gy from s order by id limit 10")
def walk_gap_distinct(spark, d):
    """The first ten gaps to walk, one for each snapped end."""
    snapped = t.points(spark, d).groupBy(F.round("x", 0).alias("gx"), F.round("y", 0).alias("gy")).agg(F.min("id").alias("id"))
    return snapped.orderBy("id").limit(10).select("id", "gx", "gy")


@query(f"with {POINTS}, c as (select id, count(*) over (partition by round(x / 10, 0), round(y / 10, 0)) as sharing, row_number() over (partition by round(x / 10, 0), round(y / 10, 0) order by id) - 1 as level from points) select id, sharing, level from c where sharing >= 2")
def label_share_counts(spark, d):
    """Labels that share a rounded centre, and the level at which each is stacked."""
    cell = Window.partitionBy(F.round(F.col("x") / 10, 0), F.round(F.col("y") / 10, 0))
    stacked = t.points(spark, d).select("id", F.count("*").over(cell).alias("sharing"), (F.row_number().over(cell.orderBy("id")) - 1).cast("long").alias("level"))
    return stacked.where("sharing >= 2")


@query("select o_orderpriority as diary, count(*) as n from orders where o_orderstatus = 'O' group by diary")
def diary_counts(spark, d):
    """Events by diary; diaries without one are not listed."""
    return t.table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_orderpriority").alias("diary")).agg(F.count("*").alias("n"))


@query("""select o_orderkey as id, row_number() over (order by o_orderdate + to_days((o_orderkey % 30)::int), o_custkey % 3 <> 0, o_orderkey)::bigint as place from orders
  where o_orderdate::date <= date '1996-06-01' and (o_orderdate + to_days((o_orderkey % 30)::int))::date >= date '1996-06-01'""")
def events_order(spark, d):
    """Events open on a day, those that end first at first, those with a way to them before others, then by key."""
    end = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 30 as int))")
    events = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("start"), end.alias("end"), (F.col("o_custkey") % 3 != 0).alias("far"))
    return sequences.numbered(events.where("start <= date'1996-06-01' and to_date(end) >= date'1996-06-01'"), "end", "far", "id").select("id", "place")


@query("""with e as (select o_orderkey as id, o_custkey as customer, o_orderstatus as status from orders)
select e.id, c.c_name as store, c.c_nationkey as node from e left join (select * from customer where c_acctbal > 0) c on e.customer = c.c_custkey where e.status = 'P'""")
def event_store_lookup(spark, d):
    """Events with their store, if it is in the index."""
    stores = t.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("store"), F.col("c_nationkey").alias("node"))
    events = t.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return events.join(stores, "customer", "left").select("id", "store", "node")


@query(f"""with {STORES}, p as (select id, string_split(lower(name), 'e') as s from stores)
select id, array_to_string([list_sum([length(x) for x in s[1:i]]) + i - 1 for i in range(1, len(s))]::bigint[], ',') as places from p""")
def name_highlights(spark, d):
    """Where a typed letter stands in each name."""
    return t.stores(spark, d).select("id", F.array_join(text.highlights(F.col("name"), "E").cast("array<string>"), ",").alias("places"))


@query(f"""with {STORES}, l as (select id, name, case when floor < 2 then 'B' || (2 - floor) else (floor - 1) || 'F' end as label from stores where category = 'PROMO' or subcategory <> 'Brand#11')
select id, label, (case when label like 'B%' then -(label[2:]::int) else rtrim(label, 'F')::int end)::int as rank from l""")
def category_listing(spark, d):
    """Stores of a listing with their floor's rank, one brand hidden outside promotions."""
    shown = t.stores(spark, d).where("category = 'PROMO' or subcategory <> 'Brand#11'")
    label = F.when(F.col("floor") < 2, F.concat(F.lit("B"), 2 - F.col("floor"))).otherwise(F.concat(F.col("floor") - 1, F.lit("F")))
    return shown.select("id", label.alias("label")).withColumn("rank", text.floor_rank(F.col("label")))


@query("""with days as (select s_suppkey as id, unnest(range(-1, 8)) as day from supplier),
h as (select id, day, (day + 3) % 7 as weekday, 480 + id % 7 * 30 as o, (960 + id * 37 % 900) % 1440 as c, id % 7 = (day + 3) % 7 as off, id % 5 = 0 and day = 1 as special, id % 10 = 0 as shut from days),
r as (select id, day, case when special then 600 else o end as o, case when special then 720 else c end as c from h where case when special then not shut else not off end),
s as (select id, day * 1440 + o as s, day * 1440 + case when c > o then c else c + 1440 end as e from r where o <> c),
m as (select *, max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) as before from s),
i as (select *, sum((before is null or s > before)::int) over (partition by id order by s, e rows between unbounded preceding and current row) as island from m),
g as (select id, min(s) as s, max(e) as e from i group by id, island)
select p.s_suppkey as id, case when count(*) filter (g.s <= 1290 and 1290 < g.e) > 0 then 'open' else 'closed' end as state,
  case when count(*) filter (g.s <= 1290 and 1290 < g.e) > 0 then nullif(max(case when g.s <= 1290 and 1290 < g.e then case when g.e < 8 * 1440 then g.e else -1 end end), -1) else min(g.s) filter (g.s > 1290) end as next_change
from supplier p left join g on g.id = p.s_suppkey group by p.s_suppkey""")
def open_status(spark, d):
    """Open or closed at 21:30 of day 0, and the minute of the next change: weekly hours under exceptions, over midnight."""
    places = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    week = places.join(spark.range(7).select(F.col("id").cast("int").alias("weekday")), F.expr("id % 7 <> weekday"))
    week = week.select("id", "weekday", (480 + F.col("id") % 7 * 30).alias("open"), ((960 + F.col("id") * 37 % 900) % 1440).alias("close"))
    special = places.where("id % 5 = 0").select("id", F.lit(1).alias("day"), (F.col("id") % 10 == 0).alias("closed"), F.lit(600).alias("open"), F.lit(720).alias("close"))
    return calendar.open_status(places, week, special, first_weekday=3, now=1290)
