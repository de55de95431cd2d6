"""Legs of itineraries, a row each, against legs as lists."""

import json

from pyspark.sql import functions as F

from waymark.sources import documents


def test_legs_are_those_of_their_itineraries(spark):
    stop = {"lat": "37.5", "lon": "127"}
    made = [
        {"totalTime": "60", "legs": [{"mode": "WALK", "passShape": {"linestring": "127,37 broken 128,38"}}, {"mode": "BUS", "steps": [{"linestring": "1,2"}, {"linestring": "3,4 5,6"}], "start": stop, "end": stop}]},
        {"legs": [{"mode": "SUBWAY", "sectionTime": "x", "start": stop, "end": {"lat": "0", "lon": "1"}, "passShape": {"linestring": "1,2"}}, {}]},
        {"totalTime": "5", "legs": []},
        {"totalTime": "6"},
        None,
    ]
    table = spark.createDataFrame([(k, json.dumps(d) if d else None) for k, d in enumerate(made)], "id int, doc string")
    lists = documents.itineraries(table, "id", "doc").select("id", F.col("seconds").alias("total"), "kind", F.posexplode("legs").alias("place", "leg"))
    rows = documents.legs(table, "id", "doc")
    assert rows.columns == lists.columns
    got = sorted(map(str, rows.collect()))
    assert got == sorted(map(str, lists.collect())) and len(got) == 4
    assert [len(r.leg.points) for r in rows.orderBy("id", "place").collect()] == [2, 3, 1, 0]
