"""Facet geometry: boxes, plane distances, rays and points in volumes, in single precision.

Facets of a geometry are a small table against many points: they are broadcast where a count shows
them to be under FEW, and joined by volume otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 200_000
#: A generic direction in the positive octant; any fixed one will do.
RAY = (0.41238, 0.63281, 0.65541)


def _f(x: Column) -> Column:
    return x.cast("float")


def volume_boxes(facets: DataFrame) -> DataFrame:
    """local_id, global_id and lo0..hi2 of every volume."""
    at = lambda d: [F.col(f"v{n}").getItem(d) for n in range(3)]
    return facets.filter("kind = 'volume'").groupBy("local_id", "global_id").agg(*(F.min(F.least(*at(d))).alias(f"lo{d}") for d in range(3)), *(F.max(F.greatest(*at(d))).alias(f"hi{d}") for d in range(3)))


def project(x: list[Column], ray: list[Column]) -> tuple[Column, Column]:
    """Where a line from x along ray meets the plane of facet v0, v1, v2: (inside the facet, signed distance).
    A parallel ray is never inside."""
    v = [[_f(F.col(f"v{n}").getItem(d)) for d in range(3)] for n in range(3)]
    a = [_f(v[1][d] - v[0][d]) for d in range(3)]
    b = [_f(v[2][d] - v[0][d]) for d in range(3)]
    c = [_f(-r) for r in ray]
    y = [_f(x[d] - v[0][d]) for d in range(3)]
    cross = lambda p, q: [_f(p[1] * q[2] - p[2] * q[1]), _f(p[2] * q[0] - p[0] * q[2]), _f(p[0] * q[1] - p[1] * q[0])]
    dot = lambda p, q: _f(p[0] * q[0] + p[1] * q[1] + p[2] * q[2])
    bc = cross(b, c)
    det = dot(a, bc)
    y0 = F.try_divide(dot(y, bc), det)
    y1 = F.try_divide(dot(y, cross(c, a)), det)
    y2 = F.try_divide(dot(y, cross(a, b)), det)
    inside = (det != 0) & (y0 >= 0) & (y1 >= 0) & (y0 + y1 <= 1)
    return F.coalesce(inside, F.lit(False)), _f(y2)


def ray_hits(x: list[Column], ray: list[Column]) -> Column:
    """Strictly ahead: a start on the facet is no hit."""
    inside, ahead = project(x, ray)
    return inside & F.coalesce(ahead > 0, F.lit(False))


def plane_distance(x: list[Column]) -> Column:
    d = [_f(x[i] - F.col("v0").getItem(i)) for i in range(3)]
    return _f(sum((d[i] * F.col("normal").getItem(i) for i in range(1, 3)), d[0] * F.col("normal").getItem(0)))


def _bounded(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _hits(points: DataFrame, facets: DataFrame, key: str, ray: tuple[float, ...]) -> DataFrame:
    """key, local_id, global_id and the number of hits, for every volume whose box holds the point; points in no box
    have one row of nulls. Boxes are a row per solid; facets are broadcast under FEW."""
    boxes = volume_boxes(facets)
    within = [F.col(c).cast("float").between(F.col(f"lo{d}"), F.col(f"hi{d}")) for d, c in enumerate("xyz")]
    near = points.select(key, "x", "y", "z").join(F.broadcast(boxes), within[0] & within[1] & within[2], "left").select(key, "x", "y", "z", "local_id", "global_id")
    sides = _bounded(facets.filter("kind = 'volume'").select("local_id", "v0", "v1", "v2"))
    hit = ray_hits([_f(F.col(c)) for c in "xyz"], [F.lit(float(r)) for r in ray])
    return near.join(sides, "local_id", "left").groupBy(key, "local_id", "global_id").agg(F.sum(hit.cast("int")).alias("hits"))


def point_in_volume(points: DataFrame, facets: DataFrame, key: str = "pid", ray: tuple[float, ...] = RAY) -> DataFrame:
    """For each point (key, x, y, z) and volume whose box holds it: key, local_id, inside (odd number of hits)."""
    return _hits(points, facets, key, ray).filter("local_id IS NOT NULL").select(key, "local_id", (F.col("hits") % 2 == 1).alias("inside"))


def locate(points: DataFrame, facets: DataFrame, global_id: int, key: str = "pid") -> DataFrame:
    """key, volume_id: -2 outside the global volume's box, else the first volume by local id (not the
    global one) that holds the point, else -1. One pass over the points."""
    whole = F.col("global_id") == global_id
    first = F.min(F.when(~whole & (F.col("hits") % 2 == 1), F.col("local_id"))).alias("first")
    found = _hits(points, facets, key, RAY).groupBy(key).agg(F.coalesce(F.bool_or(whole), F.lit(False)).alias("in_box"), first)
    return found.select(key, F.when(~F.col("in_box"), F.lit(-2)).otherwise(F.coalesce("first", F.lit(-1))).cast("int").alias("volume_id"))


def volume_facets(facets: DataFrame, local_id: int) -> DataFrame:
    return facets.filter((F.col("kind") == "volume") & (F.col("local_id") == local_id))


def surface_facets(facets: DataFrame, local_id: int) -> DataFrame:
    return facets.filter((F.col("kind") == "surface") & (F.col("local_id") == local_id))


def local_ids(facets: DataFrame, kind: str) -> dict[int, int]:
    """Global to local id: one entry a solid."""
    return {r.global_id: r.local_id for r in facets.filter(F.col("kind") == kind).select("global_id", "local_id").distinct().collect()}
