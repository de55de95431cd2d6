"""Opening hours over weekly tables and dated exceptions; time is in minutes from midnight of day 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.sequences import merged_intervals

# The days that decide a status begin with yesterday, whose hours may pass midnight.
FIRST_DAY, DAYS, DAY = -1, 9, 1440


def spans(places: DataFrame, week: DataFrame, exceptions: DataFrame, first_weekday: int) -> DataFrame:
    """id, start, end of merged open spans.

    week(id, weekday, open, close) and exceptions(id, day, closed, open, close)
    may hold several spans of a day; an exception replaces its whole day, a closed
    one empties it.  A close not after its open is on the next day; equal times are no span.
    """
    days = places.select("id", F.explode(F.sequence(F.lit(FIRST_DAY), F.lit(FIRST_DAY + DAYS - 1))).alias("day"))
    weekly = days.join(exceptions.select("id", "day"), ["id", "day"], "left_anti").withColumn("weekday", F.pmod(F.col("day") + first_weekday, F.lit(7)))
    weekly = weekly.join(week, ["id", "weekday"]).select("id", "day", "open", "close")
    dated = exceptions.where("not closed").join(days, ["id", "day"], "left_semi").select("id", "day", "open", "close")
    close = F.when(F.col("close") > F.col("open"), F.col("close")).otherwise(F.col("close") + DAY)
    each = weekly.unionByName(dated).where("open <> close").select("id", (F.col("day") * DAY + F.col("open")).alias("start"), (F.col("day") * DAY + close).alias("end"))
    return merged_intervals(each, "id")


def open_status(places: DataFrame, week: DataFrame, exceptions: DataFrame, first_weekday: int, now: int) -> DataFrame:
    """id, state, next_change of every place; no next change where none is within the days looked at."""
    holds = (F.col("start") <= now) & (F.col("end") > now)
    last = (FIRST_DAY + DAYS) * DAY
    told = spans(places, week, exceptions, first_weekday).groupBy("id").agg(F.max(holds).alias("open"), F.max(F.when(holds, F.col("end"))).alias("end"), F.min(F.when(F.col("start") > now, F.col("start"))).alias("start"))
    change = F.when(F.col("open"), F.when(F.col("end") < last, F.col("end"))).otherwise(F.col("start"))
    return places.select("id").distinct().join(told, "id", "left").select("id", F.when(F.col("open"), "open").otherwise("closed").alias("state"), change.cast("long").alias("next_change"))
