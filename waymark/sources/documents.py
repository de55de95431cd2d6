"""Documents of outside services as rows: places, transit itineraries, lines, and the documents that go out.

Outside documents are read tolerantly: numbers may be texts, blank texts are
missing, a zero coordinate is none, and what cannot be read is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names of the place service.
PLACE_FIELDS = (
    "id", "name", "frontLat", "frontLon", "noorLat", "noorLon", "lowerBizName", "middleBizName", "upperBizName", "bizName",
    "upperAddrName", "middleAddrName", "lowerAddrName", "detailAddrName", "firstNo", "secondNo", "telNo", "radius",
)
PLACE = ", ".join(f"{f} string" for f in PLACE_FIELDS) + ", newAddressList struct<newAddress: array<struct<fullAddressRoad: string>>>"

# Field names of the transit service.
STOP = "struct<name: string, lat: string, lon: string>"
LEG = f"struct<mode: string, sectionTime: string, distance: string, route: string, routeColor: string, start: {STOP}, `end`: {STOP}, passShape: struct<linestring: string>, steps: array<struct<linestring: string>>, passStopList: struct<stationList: array<struct<stationName: string>>>>"
ITINERARY = f"totalTime string, totalWalkTime string, legs array<{LEG}>"


def text(value: Column) -> Column:
    """A trimmed text; blank is null."""
    return F.nullif(F.trim(value), F.lit(""))


def number(value: Column) -> Column:
    """A number that may be written as a text; anything else is null."""
    return F.trim(value).try_cast("double")


def _point(lat: Column, lng: Column) -> Column:
    y, x = number(lat), number(lng)
    return F.when((y != 0) & (x != 0), F.struct(y.alias("lat"), x.alias("lng")))


def places(documents: DataFrame, column: str) -> DataFrame:
    """id, name, point, category, address, tel, distance_m of JSON places; without a name or a point they drop.

    The entrance goes before the middle, a narrow trade before a wide one, the road's
    address before the lot's; a place without an id is named by its point.
    """
    p = documents.select(F.from_json(column, PLACE).alias("p")).select("p.*")
    point = F.coalesce(_point(F.col("frontLat"), F.col("frontLon")), _point(F.col("noorLat"), F.col("noorLon")))
    lot_first, lot_second = F.nullif(text(F.col("firstNo")), F.lit("0")), F.nullif(text(F.col("secondNo")), F.lit("0"))
    parts = [text(F.col(c)) for c in ("upperAddrName", "middleAddrName", "lowerAddrName", "detailAddrName")]
    lot = F.nullif(F.concat_ws(" ", *parts, F.when(lot_first.isNotNull(), F.concat_ws("-", lot_first, lot_second))), F.lit(""))
    road = text(F.get("newAddressList.newAddress", F.lit(0))["fullAddressRoad"])
    km = number(F.col("radius"))
    told = p.select(
        text(F.col("id")).alias("id"), text(F.col("name")).alias("name"), point.alias("point"),
        F.coalesce(*(text(F.col(c)) for c in ("lowerBizName", "middleBizName", "upperBizName", "bizName"))).alias("category"),
        F.coalesce(road, lot).alias("address"), text(F.col("telNo")).alias("tel"), F.when(km > 0, km * 1000).alias("distance_m"),
    )
    told = told.where("name is not null and point is not null")
    return told.withColumn("id", F.coalesce("id", F.concat_ws(",", F.col("point.lat").cast("string"), F.col("point.lng").cast("string"))))


def line(value: Column) -> Column:
    """Points (lng, lat) of "lng,lat lng,lat"; pairs that cannot be read are left out."""
    pairs = F.transform(F.split(F.coalesce(value, F.lit("")), " "), lambda p: F.split(p, ","))
    read = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(number(p[0]).alias("lng"), number(p[1]).alias("lat")))
    return F.filter(read, lambda p: p["lng"].isNotNull() & p["lat"].isNotNull())


def _itineraries(documents: DataFrame, id_: str, column: str) -> DataFrame:
    """id, minutes and walk seconds, kind of JSON itineraries, and their legs as they are written."""
    i = documents.select(F.col(id_).alias("id"), F.from_json(column, ITINERARY).alias("i")).select("id", "i.*")
    i = i.withColumn("modes", F.array_sort(F.array_distinct(F.filter(F.transform("legs", lambda x: F.lower(x["mode"])), lambda m: m != "walk"))))
    modes = F.coalesce("modes", F.array().cast("array<string>"))
    kind = F.when(modes == F.array(F.lit("bus")), "bus").when(modes == F.array(F.lit("subway")), "subway").when(modes == F.array(F.lit("bus"), F.lit("subway")), "bus+subway").otherwise("all")
    return i.select("id", F.round(number(F.col("totalTime"))).cast("int").alias("seconds"), F.round(number(F.col("totalWalkTime"))).cast("int").alias("walk_seconds"), kind.alias("kind"), "legs")


def _steps(x: Column) -> Column:
    return F.coalesce(F.flatten(F.transform(x["steps"], lambda s: line(s["linestring"]))), F.array().cast("array<struct<lng: double, lat: double>>"))


def _leg(x: Column, drawn: Column) -> Column:
    """A leg with its line, or its two ends where that has under two points."""
    ends = F.filter(F.array(*(_point(x[e]["lat"], x[e]["lon"]) for e in ("start", "end"))), lambda p: p.isNotNull())
    points = F.when(F.size(drawn) >= 2, drawn).otherwise(F.transform(ends, lambda p: F.struct(p["lng"].alias("lng"), p["lat"].alias("lat"))))
    stops = F.coalesce(F.size(x["passStopList"]["stationList"]), F.lit(0))
    colour = F.when(x["routeColor"].rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), x["routeColor"]))
    return F.struct(
        F.lower(x["mode"]).alias("mode"), F.coalesce(F.round(number(x["sectionTime"])).cast("int"), F.lit(0)).alias("seconds"), F.coalesce(number(x["distance"]), F.lit(0.0)).alias("metres"),
        text(x["route"]).alias("route"), colour.alias("colour"), F.greatest(F.lit(0), stops - 1).alias("stations"), points.alias("points"),
    )


def legs(documents: DataFrame, id_: str, column: str) -> DataFrame:
    """id, total, kind, place (from 0), leg of the legs of JSON itineraries, a row each; a line is read once."""
    x = F.col("x")
    told = _itineraries(documents, id_, column).select("id", F.col("seconds").alias("total"), "kind", F.posexplode("legs").alias("place", "x"))
    told = told.withColumn("drawn", line(x["passShape"]["linestring"]))
    told = told.withColumn("drawn", F.when(F.size("drawn") >= 2, F.col("drawn")).otherwise(_steps(x)))
    return told.select("id", "total", "kind", "place", _leg(x, F.col("drawn")).alias("leg"))


def itineraries(documents: DataFrame, id_: str, column: str) -> DataFrame:
    """id, minutes and walk seconds, kind, legs(mode, seconds, metres, route, colour, stations, points) of JSON itineraries.

    A leg's line is its shape, else its steps' lines together, else its two ends.
    Stations are counted between boarding and leaving.  Kinds tell modes besides walking.
    """

    def leg(x: Column) -> Column:
        shape = line(x["passShape"]["linestring"])
        return _leg(x, F.when(F.size(shape) >= 2, shape).otherwise(_steps(x)))

    return _itineraries(documents, id_, column).withColumn("legs", F.transform(F.coalesce("legs", F.array().cast(f"array<{LEG}>")), leg))


def line_features(tracks: DataFrame, style: str) -> DataFrame:
    """line, feature of vertices (line, pos, lng, lat): each line as GeoJSON; under two vertices there is none."""
    ordered = tracks.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("pos", "lng", "lat"))).alias("v")).where(F.size("v") >= 2)
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("v", lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))
    return ordered.select("line", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(style).alias("style")).alias("properties"), shape.alias("geometry"))).alias("feature"))


def export_sessions(samples: DataFrame, path: str, key: str = "session", order: str = "seq") -> None:
    """Samples as JSON lines by session and order; long sessions are cut over many files, and a second run replaces the first."""
    samples.repartitionByRange(key, order).sortWithinPartitions(key, order).write.mode("overwrite").json(path)
