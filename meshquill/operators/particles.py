"""Particle creation: uniform and random in cells, random on facets. Draws are hashes of (cell, number,
dimension, seed), so they don't depend on partitioning and reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.functions.linalg import Vector
from meshquill.operators.mesh import Mesh


def hash_uniform(*keys: Column) -> Column:
    """In [0, 1), from 52 bits of a hash."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / float(1 << 52)


def _cells(spark: SparkSession, mesh: Mesh) -> DataFrame:
    nx, ny = mesh.num_cell[:2]
    return mesh.entities(spark, "cell").withColumn("cell_id", F.col("i") + nx * (F.col("j") + ny * F.col("k")))


def _finish(rows: DataFrame, mesh: Mesh, per_cell: int, create: Column | None) -> DataFrame:
    volume = 1.0
    for h in mesh.cell_size:
        volume *= h
    rows = rows.withColumn("volume", F.lit(volume / per_cell))
    return rows.filter(create) if create is not None else rows


def particles_uniform(spark: SparkSession, mesh: Mesh, per_dim: int, create: Column | None = None) -> DataFrame:
    """per_dim ** 3 in every cell: pid, x, y, z, volume. create: which to keep, from those columns."""
    n = per_dim
    rows = _cells(spark, mesh).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1))))
    part = [F.expr(f"(s div {n**d}) % {n}") for d in range(3)]
    at = [F.lit(mesh.low[d]) + F.col(a) * mesh.cell_size[d] + (part[d] + 0.5) * (mesh.cell_size[d] / n) for d, a in enumerate(mesh.axes)]
    rows = rows.select((F.col("cell_id") * n**3 + F.col("s")).alias("pid"), *(c.alias(x) for c, x in zip(at, "xyz")))
    return _finish(rows, mesh, n**3, create)


def particles_random(spark: SparkSession, mesh: Mesh, per_cell: int, seed: int = 0, create: Column | None = None) -> DataFrame:
    rows = _cells(spark, mesh).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))))
    at = [F.lit(mesh.low[d]) + (F.col(a) + hash_uniform(F.col("cell_id"), F.col("s"), F.lit(d), F.lit(seed))) * mesh.cell_size[d] for d, a in enumerate(mesh.axes)]
    rows = rows.select((F.col("cell_id") * per_cell + F.col("s")).alias("pid"), *(c.alias(x) for c, x in zip(at, "xyz")))
    return _finish(rows, mesh, per_cell, create)


def append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New particles after those that are there; order is not kept."""
    return existing.unionByName(new, allowMissingColumns=True)


def particles_surface(facets: DataFrame, per_facet: int, seed: int = 0) -> DataFrame:
    """per_facet on every facet (facet_id, v0, v1, v2 arrays): pid, facet_id, x, y, z, area, nx, ny, nz.
    The barycentric sum is uniform, so points crowd towards the first vertex, as is asked of them."""
    v = [Vector.of(F.col(f"v{n}").cast("array<double>"), 3) for n in range(3)]
    ab, ac = v[1] - v[0], v[2] - v[0]
    normal = ab % ac
    rows = facets.select("facet_id", *(c.alias(f"a{d}") for d, c in enumerate(v[0].v)), *(c.alias(f"ab{d}") for d, c in enumerate(ab.v)), *(c.alias(f"ac{d}") for d, c in enumerate(ac.v)), *(c.alias(f"n{d}") for d, c in enumerate(normal.v)))
    rows = rows.withColumn("size", F.sqrt(F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") + F.col("n2") * F.col("n2")))
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(per_facet - 1))))
    both = hash_uniform(F.col("facet_id"), F.col("s"), F.lit(0), F.lit(seed))
    rows = rows.withColumn("both", both).withColumn("r", F.col("both") * hash_uniform(F.col("facet_id"), F.col("s"), F.lit(1), F.lit(seed)))
    at = [F.col(f"a{d}") + F.col("r") * F.col(f"ab{d}") + (F.col("both") - F.col("r")) * F.col(f"ac{d}") for d in range(3)]
    return rows.select((F.col("facet_id") * per_facet + F.col("s")).alias("pid"), "facet_id", *(c.alias(x) for c, x in zip(at, "xyz")), (0.5 * F.col("size") / per_facet).alias("area"), *(F.try_divide(f"n{d}", "size").alias(f"n{x}") for d, x in enumerate("xyz")))
