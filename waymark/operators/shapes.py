"""Lines of routes, values on a fixed grid of times, and the order in which labels are placed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def route_line(path: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """route, xs, ys, metres: the lines of a path's edges one after another, turned where they are walked backwards.

    path: route, nth, edge, source, target; edges: edge, source, target, length, xs,
    ys (null or empty: straight); nodes: node, x, y.  A point that repeats the last
    one of the edge before is left out.  A route with an edge that does not join its
    two nodes, or is not known, has no line (null).
    """
    ends = edges.select("edge", F.col("source").alias("s"), F.col("target").alias("t"), "length", "xs", "ys")
    a, b = nodes.toDF("source", "ax", "ay"), nodes.toDF("target", "bx", "by")
    parts = path.join(ends, "edge", "left").join(a, "source", "left").join(b, "target", "left")
    straight = F.coalesce(F.size("xs"), F.lit(0)) < 1
    ahead, back = (F.col("s") == F.col("source")) & (F.col("t") == F.col("target")), (F.col("s") == F.col("target")) & (F.col("t") == F.col("source"))
    line = F.when(straight, F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).otherwise(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")))
    parts = parts.withColumn("line", F.when(F.coalesce(ahead, F.lit(False)), line).when(F.coalesce(back, F.lit(False)), F.when(straight, line).otherwise(F.reverse(line))))
    by = Window.partitionBy("route").orderBy("nth")
    joined = F.element_at("line", 1) == F.lag(F.element_at("line", -1)).over(by)
    points = parts.withColumn("kept", F.when(F.coalesce(joined, F.lit(False)), F.slice("line", 2, F.greatest(F.size("line") - 1, F.lit(0)))).otherwise(F.col("line")))
    whole = points.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("nth", "kept"))).alias("parts"), F.sum("length").alias("metres"), F.min(F.col("line").isNotNull().cast("int")).alias("known"))
    flat = F.when(F.col("known") == 1, F.flatten(F.col("parts.kept")))
    return whole.select("route", flat.alias("points"), F.when(F.col("known") == 1, F.col("metres")).alias("metres")).select("route", F.col("points.x").alias("xs"), F.col("points.y").alias("ys"), "metres")


def on_grid(samples: DataFrame, key: str, at: str, values: list[str], period: int, frames: int, most_gap: int) -> DataFrame:
    """key, frame, values...: linear values at ``frames`` times, ``period`` apart, up to each key's last sample.

    A time between two samples gets the values on the line between them, a time at a
    sample that sample's; over a gap longer than ``most_gap`` they are null, and times
    before the first sample are left out.  Every sample looks at the next one only.
    """
    by = Window.partitionBy(key).orderBy(at)
    ends = samples.groupBy(key).agg((F.max(at) - period * (frames - 1)).alias("start"))
    pairs = samples.withColumns({f"{c}_to": F.lead(c).over(by) for c in (at, *values)}).where(F.col(f"{at}_to") > F.col(at))
    pairs = pairs.join(ends, key).where(F.col(f"{at}_to") >= F.col("start"))
    first = F.greatest(F.lit(0), F.floor((F.col(at) - F.col("start")) / period) + 1)
    last = F.floor((F.col(f"{at}_to") - F.col("start")) / period)
    placed = pairs.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    share = (F.col("start") + F.col("frame") * period - F.col(at)) / (F.col(f"{at}_to") - F.col(at))
    near = F.col(f"{at}_to") - F.col(at) <= most_gap
    return placed.select(key, F.col("frame").cast("int").alias("frame"), *(F.when(near, F.col(c) + (F.col(f"{c}_to") - F.col(c)) * share).alias(c) for c in values))


#: The weights of a label's distance to those before it and of its area; scores that are equal.
APART, AREA, EQUAL = 0.72, 0.28, 1e-12


def placing_order(ids: np.ndarray, x: np.ndarray, y: np.ndarray, area: np.ndarray) -> np.ndarray:
    """Ranks of a floor's labels, each time the one farthest from all before it and large; ids in order break ties.

    Kept least distances make a pick one pass over the labels that remain.
    """
    size = np.log1p(area) / np.log1p(area.max()) if len(area) and area.max() > 0 else np.zeros(len(ids))
    across = np.hypot(np.ptp(x), np.ptp(y)) if len(ids) else 0.0
    nearest, ranks = np.zeros(len(ids)), np.full(len(ids), -1)
    for rank in range(len(ids)):
        score = np.where(ranks < 0, nearest * APART + size * AREA if rank else size, -np.inf)
        best = int(np.flatnonzero(score >= score.max() - EQUAL)[0])
        ranks[best] = rank
        if across > 0:
            away = np.minimum(np.hypot(x - x[best], y - y[best]) / across, 1.0)
            nearest = away if rank == 0 else np.minimum(nearest, away)
    return ranks


def label_priority(stores: DataFrame) -> DataFrame:
    """floor, id, priority: stores (floor, id, name, lat, lon, area) with an id and a name, in the order in which labels are placed.

    The stores of one floor are one group, which a floor's walls bound; degrees of
    longitude are scaled at the floor's middle.
    """

    def rank(frames: pd.DataFrame) -> pd.DataFrame:
        rows = frames.sort_values("id").reset_index(drop=True)
        scale = np.cos(np.radians((rows["lat"].min() + rows["lat"].max()) / 2))
        order = placing_order(rows["id"].to_numpy(), rows["lon"].to_numpy(float) * scale, rows["lat"].to_numpy(float), rows["area"].to_numpy(float))
        return pd.DataFrame({"floor": rows["floor"], "id": rows["id"], "priority": order.astype(np.int64)})

    named = stores.where("floor is not null and id is not null and trim(name) <> '' and lat is not null and lon is not null").select("floor", "id", "lat", "lon", F.greatest(F.coalesce("area", F.lit(0.0)), F.lit(0.0)).cast("double").alias("area"))
    kinds = dict(named.dtypes)
    return named.groupBy("floor").applyInPandas(rank, f"floor {kinds['floor']}, id {kinds['id']}, priority long")
