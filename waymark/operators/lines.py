"""Points against polylines and walking edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo


def line_segments(vertices: DataFrame) -> DataFrame:
    """line, seg, x1, y1, x2, y2, before, length of lines given by vertices (line, pos, x, y); segments without length drop."""
    order = Window.partitionBy("line").orderBy("pos")
    ends = vertices.select("line", F.col("pos").alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2"))
    real = ends.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).where("length > 0")
    upto = Window.partitionBy("line").orderBy("seg")
    return real.withColumn("before", F.sum("length").over(upto) - F.col("length"))


def progress(points: DataFrame, segments: DataFrame, window: float = 15.0) -> DataFrame:
    """points (id, line, x, y, previous) with travelled, remaining, offset, seg and reacquired.

    The nearest foot within the window around the previous progress counts; where
    none is, the nearest of all, marked as reacquired.  Feet equally far, to a nanometre, go to the earlier segment.
    A point meets the segments that its window reaches, the others those in its cells.
    """
    total = segments.groupBy("line").agg(F.sum("length").alias("total"))
    within = F.abs(F.col("travelled") - F.col("previous")) <= window
    near = _best(_feet(_windowed(points, segments, window)).where(within))
    rest = points.join(near.select("id", "line"), ["id", "line"], "left_anti")
    best = near.withColumn("far", F.lit(False)).unionByName(_best(_nearest(rest, segments)).withColumn("far", F.lit(True)))
    known = best.join(points.select("id", "line", F.col("previous").isNotNull().alias("known")), ["id", "line"]).join(total, "line")
    return known.select("id", "line", "b.travelled", F.greatest(F.lit(0.0), F.col("total") - F.col("b.travelled")).alias("remaining"), "b.offset", "b.seg", (F.col("known") & F.col("far")).alias("reacquired"))


def _feet(met: DataFrame) -> DataFrame:
    t = F.expr("least(1d, greatest(0d, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (length * length)))")
    feet = met.withColumn("t", t).withColumn("travelled", F.col("before") + F.col("t") * F.col("length"))
    return feet.withColumn("offset", F.expr("hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))"))


def _best(feet: DataFrame) -> DataFrame:
    return feet.groupBy("id", "line").agg(F.min(F.struct(F.round("offset", 9).alias("offset"), "seg", "travelled")).alias("b"))


def _windowed(points: DataFrame, segments: DataFrame, window: float) -> DataFrame:
    """Each point with the segments that begin or end within the window around its previous progress, or span it."""
    numbered = segments.withColumn("nth", F.row_number().over(Window.partitionBy("line").orderBy("seg")))
    asked = points.where("previous is not null")
    slack = F.lit(window) + 1e-3 + F.abs("previous") * 1e-9
    mark = lambda at, last: F.struct(at.alias("at"), F.lit(last).alias("last"))
    marks = asked.select("line", "id", F.inline(F.array(mark(F.col("previous") - slack, False), mark(F.col("previous") + slack, True))))
    starts = numbered.select("line", F.lit(None).cast(dict(points.dtypes)["id"]).alias("id"), F.col("before").alias("at"), F.lit(None).cast("boolean").alias("last"), "nth")
    # segments come before the marks at their start
    upto = Window.partitionBy("line").orderBy("at", F.col("nth").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(marks, allowMissingColumns=True).withColumn("nth", F.max("nth").over(upto)).where("last is not null")
    spans = placed.groupBy("line", "id").agg(F.coalesce(F.max(F.when(~F.col("last"), F.col("nth"))), F.lit(1)).alias("low"), F.max(F.when(F.col("last"), F.col("nth"))).alias("high"))
    reached = spans.where("high is not null").select("line", "id", F.explode(F.sequence("low", "high")).alias("nth"))
    return reached.join(numbered, ["line", "nth"]).join(asked, ["line", "id"])


# Cells as parts or multiples of a line's own cell; those from 1 on hold segments, the finer ones tell how far a vertex is at most.
SIZES, ALL = (2.0**-20, 2.0**-4, 1.0, 8.0, 64.0, 512.0, 4096.0), 99


def _nearest(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Each point with the segments of its line that may be the nearest ones.

    A vertex in a point's cell bounds its distance, so only segments in cells within
    that bound count; a point that shares no cell of any size with its line meets
    all segments.  A line's own cells are sized so that cells of segments and
    segments of cells are about as many: work grows with n to the power of 1.5
    where long segments cross everywhere.
    """
    extent = lambda v: F.greatest(F.max(f"{v}1"), F.max(f"{v}2")) - F.least(F.min(f"{v}1"), F.min(f"{v}2"))
    sized = segments.groupBy("line").agg(extent("x").alias("w"), extent("y").alias("h"), F.count("*").alias("n"), F.avg("length").alias("mean"))
    sized = sized.select("line", F.expr("greatest(2 * sqrt(w * h / n), 2 * (w + h) / n, mean / sqrt(n))").alias("own"))
    cell = lambda v: F.floor(v / F.col("size"))
    level = lambda least: F.inline(F.array(*(F.struct(F.lit(k).alias("level"), (F.col("own") * s).alias("size")) for k, s in enumerate(SIZES) if s >= least)))

    vertices = segments.select("line", F.inline(F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2)))))
    held = lambda rows, *more: rows.join(sized, "line").select(*rows.columns, "own", level(0)).select("line", "level", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"), *more)
    occupied = held(vertices).distinct().withColumn("here", F.lit(True))
    found = held(points.select("id", "line", "x", "y"), "id", "x", "y", "own").join(occupied, ["line", "level", "cx", "cy"], "left")
    bounded = found.groupBy("id", "line", "x", "y", "own").agg(F.min(F.when(F.col("here"), F.col("level"))).alias("level"))
    size = F.element_at(F.array(*map(F.lit, SIZES)), F.least(F.col("level"), F.lit(len(SIZES) - 1)) + 1) * F.col("own")
    # rounding to a nanometre makes feet equal that are not
    asked = bounded.withColumn("bound", F.when(F.col("level").isNull(), F.lit(float("inf"))).otherwise(size * 1.4143 + 2e-9))
    asked = asked.withColumn("level", F.when(F.col("level").isNull(), ALL).otherwise(F.greatest("level", F.lit(SIZES.index(1.0))))).withColumn("size", size)
    reach = F.when(F.col("level") == ALL, 0.0).otherwise(F.col("bound"))
    span = lambda v: F.explode(F.sequence(cell(F.col(v) - reach), cell(F.col(v) + reach)))
    only = lambda c: F.when(F.col("level") == ALL, F.lit(0).cast("long")).otherwise(F.col(c))
    asked = asked.withColumn("cx", span("x")).withColumn("cy", span("y")).withColumns({"cx": only("cx"), "cy": only("cy")}).drop("own", "size")

    # a segment's columns of cells, and of each the rows that the segment passes in it
    laid = segments.join(sized, "line").select(*segments.columns, level(1.0)).withColumn("edge", F.col("size") / 1000)
    laid = laid.withColumn("cx", F.explode(F.sequence(cell(F.least("x1", "x2") - F.col("edge")), cell(F.greatest("x1", "x2") + F.col("edge")))))
    at = lambda x: F.when(F.col("x1") == F.col("x2"), None).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.col("x1")) / (F.col("x2") - F.col("x1")))))
    y = lambda t: F.col("y1") + (F.col("y2") - F.col("y1")) * t
    first, last = F.coalesce(y(at(F.col("cx") * F.col("size") - F.col("edge"))), F.col("y1")), F.coalesce(y(at((F.col("cx") + 1) * F.col("size") + F.col("edge"))), F.col("y2"))
    laid = laid.withColumn("cy", F.explode(F.sequence(cell(F.least(first, last) - F.col("edge")), cell(F.greatest(first, last) + F.col("edge"))))).drop("size", "edge")
    whole = segments.withColumns({"level": F.lit(ALL), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})
    met = asked.join(laid.unionByName(whole), ["line", "level", "cx", "cy"])
    return _feet(met).where(F.col("offset") <= F.col("bound"))


def snap(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """id, edge, offset: the nearest edge (edge, x1, y1, x2, y2) within a radius of each point (id, x, y).

    Points and edges meet in cells as wide as the radius, so that work grows with
    what is near.  Points without an edge near drop; edges equally far, to a nanometre, go to the smaller one.
    """
    cell = lambda v: f"cast(floor(({v}) / {radius}) as bigint)"
    span = lambda a, b: F.explode(F.expr(f"sequence({cell(f'least({a}, {b}) - {radius}')}, {cell(f'greatest({a}, {b}) + {radius}')})"))
    spread = edges.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    # of the cells of an edge's box, only those near the edge itself stay
    middle = lambda c: (F.col(c) + 0.5) * radius
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    spread = spread.where(geo.segment_distance(middle("cx"), middle("cy"), *ends) <= 1.75 * radius)
    met = points.withColumn("cx", F.expr(cell("x"))).withColumn("cy", F.expr(cell("y"))).join(spread, ["cx", "cy"])
    near = met.withColumn("offset", geo.segment_distance(F.col("x"), F.col("y"), *ends)).where(F.col("offset") <= radius)
    return near.groupBy("id").agg(F.min(F.struct(F.round("offset", 9).alias("offset"), "edge")).alias("b")).select("id", "b.edge", "b.offset")
