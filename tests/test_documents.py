import json

from pyspark.sql import functions as F

from waymark.sources import documents


def test_places_take_the_best_fields(spark):
    rows = [
        {"id": "a", "name": " Cafe ", "frontLat": "37.5", "frontLon": 127.1, "noorLat": "1", "noorLon": "2", "lowerBizName": " ", "middleBizName": "Food", "radius": "0.25", "firstNo": "12", "secondNo": "0", "upperAddrName": "Seoul"},
        {"name": "Shop", "frontLat": "0", "frontLon": "127", "noorLat": "37.25", "noorLon": "127.5", "newAddressList": {"newAddress": [{"fullAddressRoad": "Road 1"}]}, "radius": "0", "firstNo": "3", "secondNo": "4"},
        {"id": "c", "name": "", "frontLat": "37", "frontLon": "127"},
        {"id": "d", "name": "Nowhere", "frontLat": "x", "frontLon": "127"},
    ]
    table = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("broken",), (None,)], "doc string")
    got = {r.name: (r.id, r.point.lat, r.point.lng, r.category, r.address, r.distance_m) for r in documents.places(table, "doc").collect()}
    assert got == {"Cafe": ("a", 37.5, 127.1, "Food", "Seoul 12", 250.0), "Shop": ("37.25,127.5", 37.25, 127.5, None, "Road 1", None)}


def test_lines_leave_out_what_cannot_be_read(spark):
    row = spark.range(1).select(documents.line(F.lit("127.1,37.5  x,1 3 4,5,6 126,36")).alias("a"), documents.line(F.lit(None).cast("string")).alias("b")).first()
    assert [tuple(p) for p in row.a] == [(127.1, 37.5), (126.0, 36.0)] and row.b == []


def test_itineraries(spark):
    at = lambda lat, lon: {"name": "s", "lat": lat, "lon": lon}
    doc = {"totalTime": "900", "totalWalkTime": 60, "legs": [
        {"mode": "WALK", "sectionTime": 60, "distance": "80", "steps": [{"linestring": "1,2 3,4"}, {"linestring": "5,6"}]},
        {"mode": "BUS", "sectionTime": 500, "route": "B:1", "routeColor": "00ff00", "passShape": {"linestring": "1,1 2,2"}, "passStopList": {"stationList": [{"stationName": "x"}, {"stationName": "y"}, {"stationName": "z"}]}},
        {"mode": "SUBWAY", "routeColor": "green", "start": at("37", "127"), "end": at("38", "128")},
    ]}
    table = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}"), (3, None)], "id long, doc string")
    got = {r.id: r for r in documents.itineraries(table, "id", "doc").collect()}
    one = got[1]
    assert (one.seconds, one.walk_seconds, one.kind) == (900, 60, "bus+subway")
    assert [(x.mode, x.seconds, x.metres, x.route, x.colour, x.stations, [tuple(p) for p in x.points]) for x in one.legs] == [
        ("walk", 60, 80.0, None, None, 0, [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]),
        ("bus", 500, 0.0, "B:1", "#00ff00", 2, [(1.0, 1.0), (2.0, 2.0)]),
        ("subway", 0, 0.0, None, None, 0, [(127.0, 37.0), (128.0, 38.0)]),
    ]
    assert got[2].legs == [] and got[2].kind == "all" and got[3].legs == []


def test_line_features_and_export(spark, tmp_path):
    table = spark.createDataFrame([(1, 2, 3.0, 4.0), (1, 1, 1.0, 2.0), (2, 1, 0.0, 0.0)], "line int, pos int, lng double, lat double")
    made = documents.line_features(table, "walk").collect()
    assert [r.line for r in made] == [1]
    assert json.loads(made[0].feature) == {"type": "Feature", "properties": {"style": "walk"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}}
    documents.export_sessions(table, str(tmp_path / "out"), "line", "pos")
    assert spark.read.json(str(tmp_path / "out")).count() == 3
