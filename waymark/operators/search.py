"""Name search and place matching over store tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import text

# Kinds of a suggestion, best first, and the limits of typo correction.
PREFIX, INITIALS, PARTIAL, CORRECTION = 0, 1, 2, 3
MIN_CORRECTED, MAX_DISTANCE, SUGGESTIONS = 3, 1, 8


def name_groups(stores: DataFrame) -> DataFrame:
    """key, first_id, members, name of each normalised store name (id, name); names without a letter or digit drop."""
    groups = stores.where("name is not null").groupBy(text.match_key(F.col("name")).alias("key"))
    return groups.agg(F.min("id").alias("first_id"), F.count("*").alias("members"), F.min_by("name", "id").alias("name")).where("key <> ''")


def suggest(groups: DataFrame, query: str, limit: int = SUGGESTIONS) -> DataFrame:
    """key, first_id, kind, rank_in_kind of the best name groups for what a user has typed.

    Consonants alone match initials.  Other text matches letters from a syllable's
    start: at the name's own start, or inside it, nearer to the start first.  Only
    where nothing matches, names a typo away are taken.  A query without letters finds nothing.
    """
    q, key = text.match_key(F.lit(query)), F.col("key")
    letters, consonants = text.jamo(q), q.rlike("^[ㄱ-ㅎ]+$")
    offset = F.when(consonants, F.when(text.initials(key).startswith(q), 0)).otherwise(text.syllable_offset(letters, key))
    kind = F.when(consonants, INITIALS).when(F.col("rank_in_kind") == 0, PREFIX).otherwise(PARTIAL)
    typed = groups.where(q != "")
    hits = typed.where(text.may_hold(key, query)).select("key", "first_id", offset.alias("rank_in_kind")).where("rank_in_kind is not null").withColumn("kind", kind)
    some = F.broadcast(hits.limit(1).select(F.lit(True).alias("some")))
    near = typed.where(~consonants & (F.length(q) >= MIN_CORRECTED)).select("key", "first_id", text.prefix_distance(letters, text.jamo(key)).alias("rank_in_kind"))
    near = near.where(F.col("rank_in_kind") <= MAX_DISTANCE).join(some, F.lit(True), "left_anti").withColumn("kind", F.lit(CORRECTION))
    return hits.unionByName(near).orderBy("kind", "rank_in_kind", F.length("key"), "first_id").limit(limit)


def siblings(suggestions: DataFrame, confirmed: str) -> DataFrame:
    """Suggestions besides the confirmed name; none where it is not among them, corrections never."""
    sure = suggestions.where(F.col("kind") != CORRECTION)
    own = F.col("key") == text.match_key(F.lit(confirmed))
    # suggestions are a few rows, made once
    held = sure.withColumn("own", own).withColumn("found", F.max("own").over(Window.partitionBy(F.lit(0))))
    return held.where("found and not own").drop("own", "found")


def _floor(label: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(label)), "F", "")


def match_brands(pois: DataFrame, stores: DataFrame) -> DataFrame:
    """pois (id, name, ...) with store_id: the only store of the same brand, or the only one on the hinted floor.

    A brand is a name's first word, of two characters at least; one of brand and
    store name begins the other.  Several stores without a floor that leaves one
    give null.  Store names are counted by floor and found by their prefixes, so
    no pair of a place and a store is made.
    """
    named = stores.where("node is not null").select("id", text.collapsed(F.col("name")).alias("key"), _floor(F.col("floor").cast("string")).alias("floor")).where("key <> ''")
    counted = named.groupBy("key", "floor").agg(F.count("*").alias("n"), F.min("id").alias("store_id"))
    brand = text.collapsed(F.regexp_extract(F.trim("name"), r"^\S+", 0))
    asked = pois.withColumn("_brand", F.when(F.length(brand) >= 2, brand)).withColumn("_floor", _floor(F.regexp_extract(F.upper("name"), r"\((B?\d{1,2}F?)\)", 1)))
    brands = asked.select("_brand").where("_brand is not null").distinct()
    prefixes = lambda c, least, most: F.explode(F.transform(F.sequence(F.lit(least), most), lambda k: F.substring(c, F.lit(1), k)))
    longer = counted.where("length(key) >= 2").withColumn("_brand", prefixes(F.col("key"), 2, F.length("key")))
    shorter = brands.where("length(_brand) >= 2").withColumn("key", prefixes(F.col("_brand"), 1, F.length("_brand"))).where("key <> _brand").join(counted, "key")
    columns = ["_brand", "floor", "n", "store_id"]
    found = longer.join(brands, "_brand", "left_semi").select(*columns).unionByName(shorter.select(*columns))
    by_floor = found.groupBy("_brand", F.col("floor").alias("_floor")).agg(F.sum("n").alias("_fn"), F.min("store_id").alias("_fid"))
    overall = by_floor.groupBy("_brand").agg(F.sum("_fn").alias("_n"), F.min("_fid").alias("_id"))
    matched = asked.join(overall, "_brand", "left").join(by_floor, ["_brand", "_floor"], "left")
    store = F.when(F.col("_n") == 1, F.col("_id")).when(F.col("_fn") == 1, F.col("_fid"))
    return matched.select(*pois.columns, store.alias("store_id"))


def aggregates(names: DataFrame) -> DataFrame:
    """name, parts of the names that hold two or more other names, as areas named after their shops do."""
    distinct = names.select("name").where("name <> ''").distinct()
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.transform(F.sequence(F.lit(1), F.length("name") - i + 1), lambda k: F.substring(F.col("name"), i, k))))
    held = distinct.select(F.col("name").alias("whole"), F.explode(F.array_distinct(cuts)).alias("name")).where("name <> whole")
    return held.join(distinct, "name").groupBy(F.col("whole").alias("name")).agg(F.count("*").alias("parts")).where("parts >= 2")


def sentences(reason: Column) -> Column:
    """Sentences with their full stops; a tail without one counts too."""
    parts = F.regexp_extract_all(F.trim(reason), F.lit(r"[^.]*\.|[^.]+$"), 0)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def distinctive(rows: DataFrame, key: str, reason: str) -> DataFrame:
    """rows with shared (sentences in every reason of the key, sorted) and own (the rest; null where nothing is left).

    Rows without a reason do not count; a key with one reason shares nothing.
    """
    told = rows.withColumn("_s", F.when(F.trim(reason) != "", sentences(F.col(reason))))
    total = told.where("_s is not null").groupBy(key).agg(F.count("*").alias("_n"))
    counts = told.select(key, F.explode(F.array_distinct("_s")).alias("_one")).groupBy(key, "_one").agg(F.count("*").alias("_c"))
    shared = counts.join(total, key).where("_n >= 2 and _c = _n").groupBy(key).agg(F.array_sort(F.collect_list("_one")).alias("shared"))
    left = told.join(shared, key, "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    own = F.array_join(F.filter("_s", lambda s: ~F.array_contains(F.col("shared"), s)), " ")
    return left.withColumn("own", F.when(own != "", own)).drop("_s")
