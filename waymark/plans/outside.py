"""Queries over documents of outside services and of the service's own: read from JSON, and written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.durable import shared_folder
from waymark.functions import geo
from waymark.plans.queries import SAMPLES, query
from waymark.sources import documents, tables

_PLACES = """p as (select s_suppkey as k, case when s_suppkey % 5 > 0 then 's' || s_suppkey end as id, case when s_suppkey % 11 > 0 then ' ' || s_name || ' ' else '  ' end as name,
  case when s_suppkey % 3 > 0 then 37 + (s_suppkey % 100) / 8 else 0 end as front_lat, 127 + (s_suppkey % 50) / 4 as front_lon, case when s_suppkey % 7 > 0 then 36 + (s_suppkey % 64) / 16 end as noor_lat, 126.5 as noor_lon,
  case when s_suppkey % 2 = 0 then 'lower' || s_nationkey else ' ' end as lower, 'middle' || s_nationkey as middle, s_suppkey % 4 as first_no, s_suppkey % 6 as second_no, case when s_suppkey % 8 = 0 then 'Road ' || s_suppkey end as road, s_suppkey % 9 / 4 as km from supplier)"""


def place_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc: a supplier as a place of an outside service, with texts for numbers, blanks and missing fields."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    fields = {
        "id": F.when(k % 5 > 0, F.concat(F.lit("s"), k)), "name": F.when(k % 11 > 0, F.concat(F.lit(" "), "s_name", F.lit(" "))).otherwise("  "),
        "frontLat": text(F.when(k % 3 > 0, 37 + k % 100 / 8).otherwise(0.0)), "frontLon": text(127 + k % 50 / 4), "noorLat": text(F.when(k % 7 > 0, 36 + k % 64 / 16)), "noorLon": F.lit("126.5"),
        "lowerBizName": F.when(k % 2 == 0, F.concat(F.lit("lower"), "s_nationkey")).otherwise(" "), "middleBizName": F.concat(F.lit("middle"), "s_nationkey"), "upperAddrName": F.lit("Seoul"),
        "firstNo": text(k % 4), "secondNo": text(k % 6), "radius": text(k % 9 / 4),
        "newAddressList": F.when(k % 8 == 0, F.struct(F.array(F.struct(F.concat(F.lit("Road "), k).alias("fullAddressRoad"))).alias("newAddress"))),
    }
    return tables.table(spark, sf_dir, "supplier").select(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("doc"))


@query(f"""with {_PLACES}, at as (select *, case when front_lat <> 0 then front_lat else noor_lat end as lat, case when front_lat <> 0 then front_lon when noor_lat is not null then noor_lon end as lng from p)
select coalesce(id, lat::double || ',' || lng::double) as id, trim(name) as name, lat::double as lat, lng::double as lng, case when lower <> ' ' then lower else middle end as category,
  coalesce(road, 'Seoul' || case when first_no > 0 then ' ' || first_no || case when second_no > 0 then '-' || second_no else '' end else '' end) as address, case when km > 0 then km::double * 1000 end as distance_m
from at where trim(name) <> '' and lat is not null""".replace("at as (select *", '"at" as (select *').replace("from at where", 'from "at" where'))
def outside_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of an outside service by their best fields; those without a name or a point drop."""
    out = documents.places(place_documents(spark, sf_dir), "doc")
    return out.select("id", "name", F.col("point.lat").alias("lat"), F.col("point.lng").alias("lng"), "category", "address", "distance_m")


_LEGS = """legs as (select l_orderkey as id, l_linenumber as n, ['WALK', 'BUS', 'SUBWAY'][(l_partkey % 3 + 1)::int] as mode, l_quantity as q, l_partkey as p, l_suppkey as s from lineitem)"""


def itinerary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc: an order as an itinerary, its items as legs with lines in the service's text form."""
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long")
    mode = F.element_at(F.array(F.lit("WALK"), F.lit("BUS"), F.lit("SUBWAY")), (p % 3 + 1).cast("int"))
    pair = lambda a, b: F.concat(a.cast("string"), F.lit(","), b.cast("string"))
    shape = F.when(p % 4 > 0, F.concat_ws(" ", pair(p % 90, s % 45), F.lit("broken"), pair(p % 90 + 1, s % 45 + 1)))
    stop = lambda lat, lon: F.struct(F.lit("stop").alias("name"), lat.cast("string").alias("lat"), lon.cast("string").alias("lon"))
    stations = F.array(*(F.struct(F.lit(str(i)).alias("stationName")) for i in range(1, 7)))
    leg = F.struct(
        "l_linenumber", mode.alias("mode"), q.alias("q"), p.alias("p"), s.alias("s"), (q * 10).cast("string").alias("sectionTime"), (q * 7).cast("string").alias("distance"), F.when(p % 5 > 0, F.concat(F.lit("line:"), s)).otherwise(" ").alias("route"),
        F.when(p % 2 == 0, F.lit("00ff0a")).otherwise("green").alias("routeColor"), stop(s % 30 + 1, p % 60 + 1).alias("start"), stop(s % 30 + 2, p % 60).alias("end"), F.struct(shape.alias("linestring")).alias("passShape"),
        F.struct(F.slice(stations, F.lit(1), F.greatest(F.lit(1), (q % 7).cast("int"))).alias("stationList")).alias("passStopList"),
    )
    rows = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(leg)).alias("legs"), F.sum(q * 10).alias("t"))
    return rows.select("id", F.to_json(F.struct(F.col("t").cast("string").alias("totalTime"), F.lit("60").alias("totalWalkTime"), "legs")).alias("doc"))


@query(f"""with {_LEGS}, kinds as (select id, sum(q * 10)::int as seconds, list_sort(list_distinct(list(lower(mode)) filter (mode <> 'WALK'))) as m from legs group by id)
select l.id, row_number() over (partition by l.id order by n, mode, q, p, s)::int as place, k.seconds as total, case when m = ['bus'] then 'bus' when m = ['subway'] then 'subway' when m = ['bus', 'subway'] then 'bus+subway' else 'all' end as kind,
  lower(mode) as mode, (q * 10)::int as seconds, (q * 7)::double as metres, case when p % 5 > 0 then split_part('line:' || s, ':', 2) end as short_name, case when p % 2 = 0 then '#00ff0a' end as colour, greatest(1, q::int % 7) - 1 as stations,
  case when p % 4 > 0 then 2 when p % 60 = 0 then 1 else 2 end as points, case when p % 4 > 0 then p % 90 else p % 60 + 1 end::double as first_lng
from legs l join kinds k using (id)""")
def transit_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of itineraries: mode, time, length, line, colour, stations, and points from their shape or else their ends."""
    out = documents.legs(itinerary_documents(spark, sf_dir), "id", "doc")
    short = F.when(F.col("leg.route").contains(":"), F.element_at(F.split("leg.route", ":"), 2)).otherwise(F.col("leg.route"))
    return out.select(
        "id", (F.col("place") + 1).alias("place"), "total", "kind", "leg.mode", "leg.seconds", "leg.metres", short.alias("short_name"), "leg.colour", "leg.stations",
        F.size("leg.points").alias("points"), F.element_at("leg.points", 1)["lng"].alias("first_lng"),
    )


@query(f"""with {SAMPLES}, v as (select session, row_number() over (partition by session order by seq) as pos, session % 180 + seq % 8 / 8 as lng, session % 80 + seq % 4 / 4 as lat from samples)
select session as line, '{{"type":"Feature","properties":{{"style":"walk"}},"geometry":{{"type":"LineString","coordinates":[' || string_agg('[' || lng::double || ',' || lat::double || ']', ',' order by pos) || ']}}}}' as feature
from v group by session having count(*) >= 2""")
def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions' tracks as GeoJSON features."""
    s, q = F.col("session"), F.col("seq")
    rows = tables.samples(spark, sf_dir).select(s.alias("line"), q.alias("pos"), (s % 180 + q % 8 / 8).alias("lng"), (s % 80 + q % 4 / 4).alias("lat"))
    return documents.line_features(rows, "walk")


@query(f"with {SAMPLES} select session, count(*) as samples, min(seq) as first, max(seq) as last, count(distinct kind) as kinds, round(sum(value), 4) as total from samples group by session")
def session_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as JSON lines and read again."""
    at = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    rows = tables.samples(spark, sf_dir)
    documents.export_sessions(rows, at)
    read = spark.read.schema(rows.schema).json(at)
    return read.groupBy("session").agg(F.count("*").alias("samples"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.countDistinct("kind").alias("kinds"), F.round(F.sum("value"), 4).alias("total"))


@query("select p_partkey::varchar as id, p_name as name, 'f' || p_size % 5 as floor_id, split_part(p_type, ' ', 1) as category, case when p_partkey % 3 > 0 then (p_partkey % 30)::varchar end as entrance_node_id from part")
def store_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store index from JSON documents."""
    at = f"{shared_folder(spark)}/stores-{uuid.uuid4().hex}"
    key = F.col("p_partkey")
    rows = tables.table(spark, sf_dir, "part").select(key.cast("string").alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("f"), F.col("p_size") % 5).alias("floor_id"), F.split("p_type", " ")[0].alias("category"), F.when(key % 3 > 0, (key % 30).cast("string")).alias("entrance_node_id"))
    rows.write.json(at)
    return tables.store_index(spark, at).select("id", "name", "floor_id", "category", "entrance_node_id")


_GLOBE = "g as (select vec_id as id, 37.5 + embedding[1]::double / 10 as lat, 127 + embedding[2]::double / 10 as lng, 37.5 as lat0, 127.0 as lng0, embedding[3]::double * 400 as bearing, abs(embedding[4]::double) * 1000 as metres from embeddings where embedding is not null)"


@query(f"""with {_GLOBE}, d as (select *, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2)))) as far,
  asin(sin(radians(lat)) * cos(metres / 6371008.8) + cos(radians(lat)) * sin(metres / 6371008.8) * cos(radians(bearing))) as to_lat from g)
select id, round(far, 3) as metres, round(far) as whole_metres, round(degrees(to_lat), 8) as to_lat,
  round(lng + degrees(atan2(sin(radians(bearing)) * sin(metres / 6371008.8) * cos(radians(lat)), cos(metres / 6371008.8) - sin(radians(lat)) * sin(to_lat))), 8) as to_lng,
  abs(far - sqrt(pow((lng - lng0) * cos(radians((lat + lat0) / 2)), 2) + pow(lat - lat0, 2)) * {geo.METRES_PER_DEGREE}) <= 0.01 * far + 1 as flat_is_near from d""")
def globe_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle metres to a place, also as whole metres, where a heading and a distance lead, and whether the flat distance is near."""
    e = tables.table(spark, sf_dir, "embeddings").where("embedding is not null")
    part = lambda k: F.element_at("embedding", k).cast("double")
    rows = e.select(F.col("vec_id").alias("id"), (37.5 + part(1) / 10).alias("lat"), (127 + part(2) / 10).alias("lng"), (part(3) * 400).alias("bearing"), (F.abs(part(4)) * 1000).alias("metres"))
    far = geo.great_circle_metres(F.lit(37.5), F.lit(127.0), F.col("lat"), F.col("lng"))
    to = geo.offset_by(F.col("lat"), F.col("lng"), F.col("bearing"), F.col("metres"))
    flat = geo.equirectangular_metres(F.lit(37.5), F.lit(127.0), F.col("lat"), F.col("lng"))
    return rows.select("id", F.round(far, 3).alias("metres"), F.round(far).alias("whole_metres"), F.round(to["lat"], 8).alias("to_lat"), F.round(to["lng"], 8).alias("to_lng"), (F.abs(far - flat) <= 0.01 * far + 1).alias("flat_is_near"))
