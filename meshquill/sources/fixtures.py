"""Particle, matrix and grid views of the star-schema tables, on a lattice of sixteenths so that sums
of order 1 and 2 are exact in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.operators.mesh import Mesh

SPLIT_BYTES = 32 << 20
MESH = Mesh((16, 8, 8), (0.0,) * 3, (1.0,) * 3, (False,) * 3, halo=2)
PERIODIC = Mesh((16, 8, 8), (0.0,) * 3, (1.0,) * 3, (True,) * 3, halo=2)


def table(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """by: a key to deal a small file's rows out by, where it has fewer splits than there are slots."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    slots = spark.sparkContext.defaultParallelism
    if by and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < slots * SPLIT_BYTES:
        return rows.repartition(slots, by)
    return rows


def particles_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No key: for sums over the grid."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey")
    x = (F.col("l_quantity") * 4 + F.col("l_orderkey") % 4) / 16.0
    y = (F.round(F.col("l_discount") * 100) * 8 + F.col("l_partkey") % 8) / 16.0
    z = (F.round(F.col("l_tax") * 100) * 8 + F.col("l_suppkey") % 8) / 16.0
    m = (F.col("l_partkey") % 7 + 1).cast("double")
    state = [((F.col("l_partkey") * (r + 1) + F.col("l_suppkey") * (d + 1)) % 9 - 4).cast("double") for r in range(8) for d in range(3)]
    vec = [((F.col("l_partkey") * (d + 1)) % 5 - 2).cast("double") for d in range(3)]
    ten = [((F.col("l_partkey") + F.col("l_suppkey") * (d + 1)) % 5 - 2).cast("double") for d in range(9)]
    return li.select(x.alias("x"), y.alias("y"), z.alias("z"), m.alias("m"), F.array(*state[:12]).alias("c"), F.array(*state).alias("c8"), F.array(*vec).alias("vec"), F.array(*ten).alias("ten"))


def particles_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid is event_id: for results by particle."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events", "event_id").select(e.alias("pid"), ((e * 7 % 160) / 16.0).alias("x"), ((u * 3 % 96) / 16.0).alias("y"), ((e * 5 % 80) / 16.0).alias("z"))


def grid_field(spark: SparkSession, mesh: Mesh = MESH, location: str = "node") -> DataFrame:
    """phi and u (three components) on the entities."""
    i, j, k = (F.col(c).cast("double") for c in "ijk")
    return mesh.entities(spark, location).select("i", "j", "k", (i * i - 2 * j * k + 3 * k).alias("phi"), F.array(i + 2 * j - k, i * j - 3 * k, k * k - i).alias("u"))


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, e: the components of an embedding, as double, scaled by 64 and cut to quarters: products are exact."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 256) / 4.0).alias("e"))


def cube_corners(low: float, high: float) -> list[tuple]:
    """Three corners each of a box's twelve facets, seen from outside in turn."""
    p = [[float(high if n >> d & 1 else low) for d in range(3)] for n in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    return [f for a, b, c, d in quads for f in ((p[a], p[b], p[c]), (p[a], p[c], p[d]))]


def cube(spark: SparkSession, low: float = 1.0, high: float = 3.0, global_id: int = 1, local_id: int = 0) -> DataFrame:
    """Twelve facets of a box, as the STL reader gives them."""
    from meshquill.sources.stl import facet_normal

    rows = [("volume", global_id, local_id, n, *f) for n, f in enumerate(cube_corners(low, high))]
    schema = "kind string, global_id int, local_id int, facet_id long, v0 array<float>, v1 array<float>, v2 array<float>"
    return spark.createDataFrame(rows, schema).withColumn("normal", facet_normal())
