"""Wayfinding entities projected from the data set's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Milliseconds since 1970 of a timestamp without zone, whatever the session's zone.
MILLISECONDS = "datediff(ts, date'1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + cast(extract(second from ts) * 1000 as bigint)"

#: The same to the nearest millisecond, halves away from 1970.
NEAREST_MILLISECONDS = "cast(round(datediff(ts, date'1970-01-01') * 86400000BD + hour(ts) * 3600000BD + minute(ts) * 60000BD + extract(second from ts) * 1000) as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, floor, x, y: a nation is a node, nine of them in a row are on one floor."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(n.alias("id"), F.expr("n_nationkey div 9").cast("int").alias("floor"), (n * 37 % 100).cast("double").alias("x"), (n * 53 % 80).cast("double").alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, cost, length, transfer, bidirectional between nodes one or four places apart."""
    a, b = nodes(spark, sf_dir).alias("a"), nodes(spark, sf_dir).alias("b")
    steps = F.explode(F.array(*map(F.lit, (1, 4, 21, 24)))).alias("step")
    out = a.select("id", "floor", steps).withColumn("target", (F.col("id") + F.col("step")) % 25).alias("a")
    s, t = F.col("a.id"), F.col("target")
    return out.join(b, t == F.col("b.id")).select(
        s.alias("source"), t.alias("target"), (1 + (13 * s + 7 * t) % 11).cast("double").alias("cost"), (5 + (3 * s + 5 * t) % 17).cast("double").alias("length"),
        (F.col("a.floor") != F.col("b.floor")).alias("transfer"), F.lit(False).alias("bidirectional"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, category, subcategory, floor, node: a part is a store."""
    kind = F.split("p_type", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind[0].alias("category"), F.col("p_brand").alias("subcategory"),
        (F.col("p_size") % 5).cast("int").alias("floor"), (F.col("p_partkey") % 30).alias("node"),
    )


#: Names that stores are given in Hangul.
BRANDS = ("스타벅스", "스타벅스 리저브", "신탁", "오설록", "나이키 라이즈", "나이키", "스튜디오", "ABC마트")


def hangul_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: every part's name as a brand, a syllable and its size."""
    key = F.col("p_partkey")
    code = F.lit(0xAC00) + key * 37 % 11172
    # a syllable's three bytes in UTF-8
    syllable = F.decode(F.unhex(F.concat(F.hex(0xE0 + F.shiftright(code, 12)), F.hex(0x80 + F.shiftright(code, 6).bitwiseAND(F.lit(63))), F.hex(0x80 + code.bitwiseAND(F.lit(63))))), "UTF-8")
    brand = F.element_at(F.array(*map(F.lit, BRANDS)), (key % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("id"), F.concat(brand, F.lit(" "), syllable, F.col("p_size").cast("string")).alias("name"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y: the first two components of each embedding, in metres."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("id"), (F.element_at("embedding", 1).cast("double") * 100).alias("x"), (F.element_at("embedding", 2).cast("double") * 100).alias("y"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, ms, kind, value: a user's events as sensor samples."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.expr(MILLISECONDS).alias("ms"), F.col("event_type").alias("kind"), F.col("value")
    )


# Documents of the wayfinding service, for spark.read.schema(...).json(...) and from_json.
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
HOURS = T.StructType([T.StructField("open", T.StringType()), T.StructField("close", T.StringType())])
STORE_INDEX = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "floor_id", "floor_name", "category", "subcategory", "kind", "entrance_node_id")])


def store_index(spark: SparkSession, path: str) -> DataFrame:
    """The store index from JSON documents; only the columns that a query asks for are parsed."""
    return spark.read.schema(STORE_INDEX).json(path)
