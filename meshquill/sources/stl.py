"""ASCII STL, read and written by Spark.

Solids are `solid <Volume|Body|Surface> <id>`; normals in the file are ignored and built from the
vertices in single precision. A file is one row, and its lines are numbered in one task: its format says
nothing by itself on any line of which solid it is part of. So a file is read as far as a task's memory
goes; facets are dealt out from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshquill.functions.linalg import Vector
from meshquill.sources.shared import checkpoint

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """Facets: kind (volume or surface), global_id, local_id (order in the file, per kind), facet_id
    (order in the file), v0, v1, v2, normal (arrays of float)."""
    try:
        text = spark.read.text(path, wholetext=True)
        _ = text.schema
        lines = text.select(F.posexplode(F.split("value", "\\r?\\n")).alias("line", "raw")).select("line", F.btrim("raw", F.lit(" \t\r")).alias("raw"))
        words = checkpoint(lines.withColumn("w", F.split("raw", "[ \t]+")))
        bad = words.filter(_problem() != "").select(_problem().alias("p"), "raw").orderBy("line").first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise RuntimeError("Unable to open STL ASCII file") from e
        raise
    if bad is not None:
        raise RuntimeError(f"STL READER: {bad.p}: {bad.raw}")
    first = F.lower(F.col("w")[0])
    solids = words.filter(first == "solid").select("line", F.when(F.lower(F.col("w")[1]) == "surface", "surface").otherwise("volume").alias("kind"), F.col("w")[2].cast("int").alias("global_id"))
    solids = solids.withColumn("local_id", (F.row_number().over(Window.partitionBy("kind").orderBy("line")) - 1).cast("int")).withColumn("until", F.lead("line", 1, 1 << 30).over(Window.orderBy("line")))
    points = words.filter(first == "vertex").select("line", F.array(*(F.col("w")[i].cast("float") for i in (1, 2, 3))).alias("v"))
    points = points.withColumn("n", F.row_number().over(Window.orderBy("line")) - 1)
    facets = points.groupBy(F.floor(F.col("n") / 3).alias("facet_id")).agg(F.min("line").alias("line"), *(F.max(F.when(F.col("n") % 3 == i, F.col("v"))).alias(f"v{i}") for i in range(3)))
    owned = facets.join(F.broadcast(solids.withColumnRenamed("line", "begin")), (F.col("line") > F.col("begin")) & (F.col("line") < F.col("until")))
    return owned.select("kind", "global_id", "local_id", F.col("facet_id").cast("long").alias("facet_id"), "v0", "v1", "v2", facet_normal().alias("normal"))


def _problem() -> Column:
    """What is wrong with a line; empty where nothing is."""
    w, n = F.col("w"), F.size("w")
    first = F.lower(w[0])
    return (
        F.when((first == "solid") & (n != 3), "a solid line has three words")
        .when((first == "solid") & ~F.lower(w[1]).isin("volume", "body", "surface"), "unknown solid")
        .when((first == "facet") & (n != 5), "a facet line has five words")
        .when((first == "vertex") & (n != 4), "a vertex line has four words")
        .otherwise("")
    )


def facet_normal() -> Column:
    v = [[F.col(f"v{n}").getItem(d) for d in range(3)] for n in range(3)]
    sub = lambda a, b: [(x - y).cast("float") for x, y in zip(a, b)]
    c = (Vector(sub(v[1], v[0])) % Vector(sub(v[2], v[0]))).v
    size = F.sqrt(sum((x * x for x in c[1:]), c[0] * c[0]))
    return F.array(*(F.try_divide(x, size).cast("float") for x in c))


def offsets(facets: DataFrame) -> DataFrame:
    """Facets of each solid and their inclusive running count: kind, local_id, n, offset."""
    counts = facets.groupBy("kind", "local_id").agg(F.count("*").alias("n"))
    return counts.withColumn("offset", F.sum("n").over(Window.partitionBy("kind").orderBy("local_id")))


def write_stl(facets: DataFrame, path: str, name: str = "Surface 1") -> None:
    """Facets (facet_id, v0, v1, v2) as one text file, normals zero, in order of facet_id."""
    vertex = [F.format_string("      vertex %e %e %e", *(F.col(f"v{n}").getItem(d).cast("double") for d in range(3))) for n in range(3)]
    body = facets.select(F.col("facet_id").cast("long").alias("at"), F.concat_ws("\n", F.lit("  facet normal 0.0 0.0 0.0\n    outer loop"), *vertex, F.lit("    endloop\n  endfacet")).alias("value"))
    ends = facets.sparkSession.createDataFrame([(-1, f"solid {name}"), (1 << 62, f"endsolid {name}")], "at long, value string")
    body.unionByName(ends).repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def written(facets: DataFrame, path: str, name: str) -> str:
    """write_stl, and its path."""
    write_stl(facets, path, name)
    return path
