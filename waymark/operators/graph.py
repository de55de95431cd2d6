"""Walking-graph operators over edge tables (graph, source, target, cost, length)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.durable import cut


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges in both directions where bidirectional; a dangling end or negative cost is an error."""
    known = nodes.select(F.col("id").alias("_n"))
    dangling = edges.join(known, F.col("source") == F.col("_n"), "left_anti").unionByName(edges.join(known, F.col("target") == F.col("_n"), "left_anti"))
    if not dangling.unionByName(edges.where("cost < 0")).isEmpty():
        raise ValueError("an edge has an unknown end or a negative cost")
    back = edges.where("bidirectional").select(F.col("target").alias("source"), F.col("source").alias("target"), "cost", "length")
    return edges.select("source", "target", "cost", "length").unionByName(back)


def reach(edges: DataFrame, start: DataFrame, limit: float | None = None) -> DataFrame:
    """node, cost, length: least cost from the start nodes, up to a limit, and the length along that path; ties go to the shorter.

    Label-correcting rounds: only nodes whose label fell in a round relax their
    edges in the next.  Every round is cut, so lineage stays short.
    """
    labels = cut(start.select("node", F.lit(0.0).alias("cost"), F.lit(0.0).alias("length")))
    moved = labels
    while not moved.isEmpty():
        offers = moved.join(edges, moved["node"] == edges["source"]).select(F.col("target").alias("node"), (moved["cost"] + edges["cost"]).alias("cost"), (moved["length"] + edges["length"]).alias("length"))
        offers = offers if limit is None else offers.where(F.col("cost") <= limit)
        best = labels.withColumn("old", F.lit(True)).unionByName(offers.withColumn("old", F.lit(False)))
        best = cut(best.groupBy("node").agg(F.min(F.struct("cost", "length", (~F.col("old")).alias("new"))).alias("m")).select("node", "m.cost", "m.length", "m.new"))
        moved = best.where("new").drop("new")
        labels = best.drop("new")
    return labels


def routes(edges: DataFrame, start: DataFrame) -> DataFrame:
    """task, node, cost, length, plain, lifts, hops, nodes: the cheapest path of each task to each node it reaches.

    edges(task, source, target, cost, length, plain, lift) hold each task's own
    weights, start(task, node) its start.  Ties go to the shorter path, then to
    fewer lifts and hops, then to smaller nodes.  Rounds as in ``reach``.
    """
    names = ["cost", "length", "plain", "lifts", "hops", "nodes"]
    labels = cut(start.selectExpr("task", "node", "0d as cost", "0d as length", "0d as plain", "0 as lifts", "0 as hops", "array(node) as nodes"))
    moved = labels
    while not moved.isEmpty():
        steps = moved.alias("m").join(edges.alias("e"), F.expr("m.task = e.task and m.node = e.source"))
        offers = steps.selectExpr("m.task", "e.target as node", "m.cost + e.cost as cost", "m.length + e.length as length", "m.plain + e.plain as plain", "m.lifts + e.lift as lifts", "m.hops + 1 as hops", "concat(m.nodes, array(e.target)) as nodes")
        both = labels.withColumn("new", F.lit(False)).unionByName(offers.withColumn("new", F.lit(True)))
        best = cut(both.groupBy("task", "node").agg(F.min(F.struct(*names, "new")).alias("b")).select("task", "node", "b.*"))
        moved = best.where("new").drop("new")
        labels = best.drop("new")
    return labels


#: Fixed value: how much dearer walking is on a floor that a route only passes.
PASSING = 1.5


def multi_floor_routes(edges: DataFrame, nodes: DataFrame, start: DataFrame) -> DataFrame:
    """node, cost, length, lifts, nodes: the route from the start node to every node it reaches.

    edges(source, target, cost, length, mode: null on a floor), nodes(id, floor), start(node).
    The cheapest path stands if it takes a lift or stays on one floor.  Else
    walking on floors in between is dearer, unless that answer takes a lift.  All
    weightings, one for each floor of arrival, are solved together.
    """
    floors = nodes.select("floor").distinct()
    begin = start.join(nodes, start["node"] == nodes["id"]).select("node", F.col("floor").alias("begin"))
    tasks = floors.select(F.col("floor").cast("string").alias("task"), F.col("floor").alias("end")).unionByName(floors.limit(1).select(F.lit("plain").alias("task"), F.lit(None).cast("int").alias("end")))
    priced = edges.join(nodes.select(F.col("id").alias("source"), "floor"), "source").join(F.broadcast(tasks), F.lit(True)).join(F.broadcast(begin.select("begin")), F.lit(True))
    passing = F.col("mode").isNull() & F.col("end").isNotNull() & (F.col("floor") != F.col("begin")) & (F.col("floor") != F.col("end"))
    weighted = priced.select("task", "source", "target", (F.col("cost") * F.when(passing, PASSING).otherwise(1.0)).alias("cost"), "length", F.col("cost").alias("plain"), (F.coalesce("mode", F.lit("")) == "elevator").cast("int").alias("lift"))
    solved = routes(cut(weighted), tasks.select("task").join(F.broadcast(begin.select("node")), F.lit(True)))
    ends = nodes.select(F.col("id").alias("node"), F.col("floor").alias("end")).join(F.broadcast(begin.select("begin")), F.lit(True))
    raw = solved.where("task = 'plain'").drop("task").join(ends, "node")
    other = solved.where("task <> 'plain'").select(F.col("task").alias("_task"), F.col("node").alias("_node"), F.struct("plain", "length", "lifts", "nodes").alias("w"))
    both = raw.join(other, (F.col("node") == F.col("_node")) & (F.col("_task") == F.col("end").cast("string")), "left")
    stands = F.expr("lifts > 0 or begin = end or w is null or w.lifts > 0")
    return both.select("node", F.when(stands, F.struct("plain", "length", "lifts", "nodes")).otherwise(F.col("w")).alias("r")).selectExpr("node", "r.plain as cost", "r.length", "r.lifts", "r.nodes")


def segments(routes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, segment, floor, walked, first, last: the parts of each route (node, nodes) on one floor, split at transfers."""
    at = routes.select("node", F.posexplode("nodes").alias("pos", "id")).join(nodes.select("id", "floor"), "id")
    order = Window.partitionBy("node").orderBy("pos")
    hops = at.withColumn("source", F.lag("id").over(order)).withColumn("changed", F.coalesce((F.lag("floor").over(order) != F.col("floor")).cast("int"), F.lit(0)))
    hops = hops.withColumn("segment", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = edges.where("mode is null").groupBy("source", F.col("target").alias("id")).agg(F.min(F.struct("cost", "length"))["length"].alias("length"))
    walked = hops.join(lengths, ["source", "id"], "left")
    return walked.groupBy("node", "segment", "floor").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("walked"), F.min_by("id", "pos").alias("first"), F.max_by("id", "pos").alias("last"))


# A door's own node is made for a gap of this range, unless a node is this near.
LEAST_GAP, MOST_GAP, OWN_NODE = 3.0, 25.0, 1.0


def door_stitches(doors: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, node, gap: the edge from each door (id, floor, x, y, node) to its anchor node, where one is due.

    The check for a near node looks only into the neighbouring square metres.
    """
    cell = lambda c: F.floor(F.col(c) / OWN_NODE).cast("long")
    anchor = nodes.select(F.col("id").alias("node"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    gap = doors.join(anchor, "node").withColumn("gap", F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay"))).where(F.col("gap").between(LEAST_GAP, MOST_GAP))
    around = [F.explode(F.expr(f"sequence({c} - 1, {c} + 1)")).alias(n) for c, n in (("_cx", "cx"), ("_cy", "cy"))]
    spread = gap.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    spread = spread.select("id", "floor", "x", "y", "_cy", around[0]).select("id", "floor", "x", "y", "cx", around[1])
    near = nodes.select("floor", F.col("x").alias("nx"), F.col("y").alias("ny"), cell("x").alias("cx"), cell("y").alias("cy"))
    taken = spread.join(near, ["floor", "cx", "cy"]).where(F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")) <= OWN_NODE).select("id").distinct()
    return gap.join(taken, "id", "left_anti").select("id", "node", "gap")


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: edges that touch each node, transfers left out."""
    walked = edges.where("not transfer")
    ends = walked.select(F.col("source").alias("node")).unionByName(walked.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def overlay(edges: DataFrame, nodes: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """Shortcuts (source, target) whose ends both exist and whose unordered pair has no edge yet."""
    known = nodes.select("id")
    pair = [F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")]
    real = shortcuts.join(known, shortcuts["source"] == known["id"], "left_semi")
    real = real.join(known, real["target"] == known["id"], "left_semi")
    linked = edges.select(*pair).distinct()
    return real.select("source", "target", *pair).join(linked, ["lo", "hi"], "left_anti").dropDuplicates(["lo", "hi"]).select("lo", "hi")
