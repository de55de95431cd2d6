"""Planar and angular column functions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: metres of one degree of latitude in the equirectangular distance.
METRES_PER_DEGREE = 111320.0


def normalised_degrees(angle: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def turn_degrees(from_: Column, to: Column) -> Column:
    """The shortest turn, in [-180, 180), by the operations of SQL, so that a turn right at a bound is the same there."""
    return ((to - from_ + 180.0) % 360.0 + 360.0) % 360.0 - 180.0


def heading_delta(from_: Column, to: Column) -> Column:
    """The shortest turn, in (-180, 180]."""
    d = F.pmod(to - from_, F.lit(360.0))
    return F.when(d > 180.0, d - 360.0).otherwise(d)


def planar_bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return normalised_degrees(F.degrees(F.atan2(x2 - x1, y2 - y1)))


def equirectangular_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    east = (lng2 - lng1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(east, lat2 - lat1) * METRES_PER_DEGREE


#: Fixed value: the mean radius of the earth in metres.
EARTH_M = 6371008.8


def great_circle_metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere, which differ from those on an ellipsoid by half a percent at most; round them for whole metres."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def offset_by(lat: Column, lng: Column, bearing: Column, metres: Column) -> Column:
    """(lat, lng) of the point so many metres away in a heading, on a sphere."""
    around, ahead, north = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    to = F.asin(F.sin(north) * F.cos(around) + F.cos(north) * F.sin(around) * F.cos(ahead))
    east = F.atan2(F.sin(ahead) * F.sin(around) * F.cos(north), F.cos(around) - F.sin(north) * F.sin(to))
    return F.struct(F.degrees(to).alias("lat"), (lng + F.degrees(east)).alias("lng"))


def compass_label(bearing: Column) -> Column:
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.pmod(F.floor((normalised_degrees(bearing) + 22.5) / 45), F.lit(8)) + 1).cast("int"))


def _corners(ring: Column) -> Column:
    """(a, b) of each edge of a ring of (x, y) structs; the ring closes itself."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.element_at(ring, (F.pmod(i + 1, F.size(ring)) + 1).cast("int")).alias("b")))


def polygon_area(ring: Column) -> Column:
    """Shoelace area; 0 below three vertices."""
    twice = F.aggregate(_corners(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(twice) / 2)


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; false below three vertices."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    odd = F.size(F.filter(_corners(ring), crosses)) % 2 == 1
    return F.coalesce((F.size(ring) >= 3) & odd, F.lit(False))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment; a segment without length is a point."""
    square = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.when(square == 0, 0.0).otherwise(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / square)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - (x1 + t * (x2 - x1)), y - (y1 + t * (y2 - y1)))


def pressure_altitude(hpa: Column) -> Column:
    """Metres by the standard atmosphere; 0 without pressure."""
    return F.when(hpa <= 0, 0.0).otherwise(44330.0 * (1 - F.pow(hpa / 1013.25, F.lit(0.190295))))


def distance_label(metres: Column) -> Column:
    """Whole metres, from 1 km tenths of kilometres cut off; empty for no distance."""
    whole = F.round(metres)
    far = F.concat(F.format_string("%.1f", F.floor(whole / 100) / 10), F.lit("km"))
    return F.when(metres.isNull() | F.isnan(metres) | (metres < 0), "").when(whole >= 1000, far).otherwise(F.concat(whole.cast("long").cast("string"), F.lit("m")))


def polygon_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point outside a ring to its nearest edge; 0 inside, null below three vertices."""
    each = F.transform(_corners(ring), lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.when(F.size(ring) < 3, None).when(in_polygon(x, y, ring), 0.0).otherwise(F.array_min(each))


def polygon_depth(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point inside a ring to its nearest edge; 0 outside and below three vertices."""
    each = F.transform(_corners(ring), lambda e: segment_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.when(in_polygon(x, y, ring), F.array_min(each)).otherwise(0.0)


def smallest_box(ring: Column, step: float = 0.5) -> Column:
    """(area, angle, width, height) of the smallest box around a ring, by a sweep of angles under 180; the first smallest wins.

    Corners without both coordinates do not count; without any corner only the angle is told.
    """
    angles = [k * step for k in range(round(180 / step))]
    turned = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles]

    @F.arrow_udf("area double, angle double, width double, height double")
    def boxes(rings: pa.Array) -> pa.Array:
        corners = rings.flatten()
        x, y = (corners.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        lengths = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
        told = ~(np.asarray(corners.field("x").is_null()) | np.asarray(corners.field("y").is_null()) | np.asarray(corners.is_null()))
        row = np.repeat(np.arange(len(rings)), lengths)[told]
        x, y = x[told], y[told]
        has, first = np.unique(row, return_index=True)
        best = np.full((4, len(rings)), np.nan)
        if len(has):
            found = best[:, has]
            for angle, (c, s) in zip(angles, turned, strict=True):
                sides = [np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first) for v in (x * c + y * s, y * c - x * s)]
                area = sides[0] * sides[1]
                less = area < found[0] if angle else np.full(len(has), True)
                found[:, less] = np.stack([area, np.full(len(has), angle), *sides])[:, less]
            best[:, has] = found
        empty = np.full(len(rings), True)
        empty[has] = False
        best[1, empty] = 0.0
        columns = [pa.array(v, mask=None if k == 1 else empty) for k, v in enumerate(best)]
        return pa.StructArray.from_arrays(columns, ["area", "angle", "width", "height"])

    return boxes(ring)


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """u = a x + b y + c, v = d x + e y + f."""
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def affine_inverse(u: Column, v: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """The point that an affine map takes to (u, v); nulls for a singular map."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    if abs(det) < 1e-12:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    return (e * (u - c) - b * (v - f)) / det, (a * (v - f) - d * (u - c)) / det


def reach_minutes(metres: Column) -> Column:
    """Minutes of walking at 1.2 m/s, from 1 to 999."""
    return F.greatest(F.lit(1), F.least(F.lit(999), F.ceil(metres / 1.2 / 60))).cast("int")


def turn_kind(turn: Column) -> Column:
    """straight below 20 degrees, else right or left."""
    return F.when(F.abs(turn) < 20, "straight").when(turn > 0, "right").otherwise("left")


def guidance_metres(metres: Column) -> Column:
    """Rounded to 5 m below 50 m and to 10 m from there; one unit at least."""
    unit = F.when(metres < 50, 5).otherwise(10)
    return F.greatest(unit, F.round(metres / unit) * unit).cast("int")


def project(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference."""
    return (lng - lng0) * F.cos(F.radians(lat0)) * METRES_PER_DEGREE, (lat - lat0) * METRES_PER_DEGREE


def unproject(east: Column, north: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """The place so many metres east and north of a reference."""
    return lat0 + north / METRES_PER_DEGREE, lng0 + east / (F.cos(F.radians(lat0)) * METRES_PER_DEGREE)


def similarity_sums() -> list[Column]:
    """Sums over pairs (x, y) and (u, v) that ``similarity`` needs."""
    c = F.covar_pop
    return [
        (F.var_pop("x") + F.var_pop("y")).alias("a"), (F.var_pop("u") + F.var_pop("v")).alias("b"),
        (c("x", "u") + c("y", "v")).alias("p"), (c("x", "v") - c("y", "u")).alias("q"), (c("x", "u") - c("y", "v")).alias("fp"), (c("x", "v") + c("y", "u")).alias("fq"),
    ]


def similarity(col) -> dict[str, Column]:
    """mirrored, scale, angle and rms of the rotation or mirror that takes (x, y) nearest to (u, v)."""
    turned, flipped = col("p") * col("p") + col("q") * col("q"), col("fp") * col("fp") + col("fq") * col("fq")
    mirrored = flipped > turned
    angle = F.when(mirrored, F.atan2(col("fq"), col("fp"))).otherwise(F.atan2(col("q"), col("p")))
    best = F.greatest(turned, flipped)
    return {"mirrored": mirrored.alias("mirrored"), "scale": F.sqrt(best) / col("a"), "angle": F.degrees(angle), "rms": F.sqrt(F.greatest(F.lit(0.0), col("b") - best / col("a")))}


# Fixed values in metres: accuracies that let a fix tell inside and outside, how far inside and outside it must be, and how much a footprint may be too small.
INSIDE_ACCURACY, OUTSIDE_ACCURACY, INSIDE_BY, OUTSIDE_BY, TOLERANCE = 20.0, 30.0, 5.0, 8.0, 6.0


def building_verdict(accuracy: Column, outside: Column, depth: Column) -> Column:
    """inside, outside or unclear, from a fix's accuracy and its distance outside a footprint or depth inside it; unclear without a footprint."""
    inner = F.when(outside > 0, F.greatest(F.lit(0.0), TOLERANCE - outside)).otherwise(depth + TOLERANCE)
    told = F.when((accuracy <= INSIDE_ACCURACY) & (inner >= INSIDE_BY), "inside").when((accuracy <= OUTSIDE_ACCURACY) & (outside - TOLERANCE >= OUTSIDE_BY), "outside")
    return F.coalesce(told, F.lit("unclear"))


def axes(a: Column, b: Column, d: Column, e: Column) -> tuple[Column, Column, Column, Column]:
    """(ux, uy, vx, vy): unit axes of the map (a b; d e), the second made upright to the first, so scale and shear are gone."""
    first = F.hypot(a, d)
    ux, uy = a / first, d / first
    along = b * ux + e * uy
    wx, wy = b - along * ux, e - along * uy
    second = F.hypot(wx, wy)
    return ux, uy, wx / second, wy / second


def between(metres: Column, step: float) -> Column:
    """Fractions of a length at which points part it evenly into pieces of at most a step."""
    n = F.greatest(F.lit(0), F.ceil(metres / step).cast("int") - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i / (n + 1))).otherwise(F.array().cast("array<double>"))


def strong_turn(turn: Column, before: Column, after: Column) -> Column:
    """Whether a turn is told: 35 to 150 degrees between pieces of 1.5 m at least."""
    return F.coalesce(F.abs(turn).between(35, 150) & (before >= 1.5) & (after >= 1.5), F.lit(False))


def polygon_width(ring: Column) -> Column:
    """Metres from west to east of a ring of (lat, lng) structs, at its mean latitude; 0 below three vertices."""
    lng = F.transform(ring, lambda p: p["lng"])
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    return F.when(F.size(ring) < 3, 0.0).otherwise((F.array_max(lng) - F.array_min(lng)) * METRES_PER_DEGREE * F.cos(F.radians(mean)))
