"""Ordered-sequence operators: as-of, gaps, intervals, deltas, places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.durable import cut


def merged_intervals(spans: DataFrame, key: str) -> DataFrame:
    """key, start, end with overlapping and touching spans of a key merged."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    numbered = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def last_known(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last non-null value of the key up to each row (an as-of join over a union)."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(window))


def gap_sessions(rows: DataFrame, key: str, order: list[str], at_ms: Column, gap_ms: int) -> DataFrame:
    """rows with session: it rises where more than gap_ms passed since the key's row before."""
    window = Window.partitionBy(key).orderBy(*order)
    late = F.coalesce((at_ms - F.lag(at_ms).over(window) > gap_ms).cast("int"), F.lit(0))
    return rows.withColumn("_late", late).withColumn("session", F.sum("_late").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_late")


def counter_delta(value: Column, window) -> Column:
    """Rise of a counter since the row before; 0 at the first row and after a reset."""
    return F.coalesce(F.greatest(F.lit(0.0), value - F.lag(value).over(window)), F.lit(0.0))


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with place, from 1, in a total order over all of them.

    Rows are sorted over ranges; a row's place is its place in its range and the rows of the ranges before,
    so no task sees all rows.
    """
    at = cut(rows.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = sorted(map(tuple, at.groupBy(part.alias("part")).agg(F.count("*")).collect()))  # a row for each range
    before, total = [], 0
    for k, n in sizes:
        before += [F.lit(k), F.lit(total)]
        total += n
    offset = F.create_map(*before)[part] if before else F.lit(0)
    return at.withColumn("place", (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_at")
