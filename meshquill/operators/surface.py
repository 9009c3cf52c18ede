"""Marching cubes. Corner b of a cell has offsets (b >> 2, b >> 1 & 1, b & 1); a corner is inside where
the value is <= 0; a case is the set of inside corners as bits.

The facet table follows from a rule: on every face, crossings are joined by directed segments with the
inside to one side (where opposite corners are inside, the inside is joined between them), segments
close to loops, and a loop of n crossings is a fan of n - 2 facets. Where just two corners are inside,
across the cell's diagonal, their two loops are joined by a tube of six facets.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.functions.linalg import Vector
from meshquill.operators.mesh import Mesh

#: Corners at the ends of each of the 12 edges: along k, along j, along i.
EDGES = [(0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7)]


def _faces() -> list[list[int]]:
    """Corners of every face, counter-clockwise from outside."""
    faces = []
    for axis in range(3):
        u, v = 1 << (2 - (axis + 1) % 3), 1 << (2 - (axis + 2) % 3)
        ring = [0, u, u | v, v]
        faces.append([c | (1 << (2 - axis)) for c in ring])
        faces.append(ring[::-1])
    return faces


def _tube(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Two loops of three joined: the second runs backwards along the first, turned to lie nearest."""
    middle = lambda e: [sum((c >> s & 1) for c in EDGES[e]) / 2 for s in (2, 1, 0)]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(middle(x), middle(y)))
    turn = min(range(3), key=lambda t: sum(far(a[n], b[(t - n) % 3]) for n in range(3)))
    mate = [b[(turn - n) % 3] for n in range(3)]
    return [f for n in range(3) for m in [(n + 1) % 3] for f in ((a[n], a[m], mate[m]), (a[n], mate[m], mate[n]))]


@lru_cache(maxsize=1)
def facet_table() -> list[list[tuple[int, int, int]]]:
    """For every case its facets as triples of edges."""
    number = {frozenset(e): n for n, e in enumerate(EDGES)}
    table = []
    for case in range(256):
        follow = {}
        for ring in _faces():
            cross = []
            for a, b in zip(ring, ring[1:] + ring[:1]):
                ins = (case >> a & 1, case >> b & 1)
                if ins[0] != ins[1]:
                    cross.append((ins[0] == 1, number[frozenset((a, b))]))
            # leaving the inside pairs with the next entry: what is cut off is the outside corner between them
            for at, (leaves, edge) in enumerate(cross):
                if leaves:
                    follow[edge] = cross[(at + 1) % len(cross)][1]
        loops, left = [], set(follow)
        while left:
            loop = [min(left)]
            while follow[loop[-1]] != loop[0]:
                loop.append(follow[loop[-1]])
            left -= set(loop)
            loops.append(loop)
        inside = [c for c in range(8) if case >> c & 1]
        if len(inside) == 2 and inside[0] ^ inside[1] == 7:
            table.append(_tube(*loops))
        else:
            table.append([(loop[0], loop[n], loop[n + 1]) for loop in loops for n in range(1, len(loop) - 1)])
    return table


def table_rows(spark: SparkSession) -> DataFrame:
    """case, facet, and the corners p0 q0 .. p2 q2 of each vertex's edge; fewer than a thousand rows."""
    rows = [(case, n, *(c for e in facet for c in EDGES[e])) for case, facets in enumerate(facet_table()) for n, facet in enumerate(facets)]
    return spark.createDataFrame(rows, "case int, facet int, p0 int, q0 int, p1 int, q1 int, p2 int, q2 int")


def cells(field: DataFrame, mesh: Mesh, value: str = "phi") -> DataFrame:
    """i, j, k, v (the 8 corner values), case of every cell; nodes (i, j, k, value) go to the cells they touch."""
    b = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b")
    rows = field.select("i", "j", "k", value, b)
    at = [F.col(a) - F.expr(f"shiftright(b, {2 - d}) & 1") for d, a in enumerate("ijk")]
    at = [F.pmod(c, F.lit(n)) if p else c for c, n, p in zip(at, mesh.num_cell, mesh.periodic)]
    rows = rows.select(*(c.cast("long").alias(a) for a, c in zip("ijk", at)), "b", value)
    for a, n, p in zip("ijk", mesh.num_cell, mesh.periodic):
        rows = rows if p else rows.filter(F.col(a).between(0, n - 1))
    sums = rows.groupBy("i", "j", "k").agg(*(F.max(F.when(F.col("b") == c, F.col(value))).alias(f"v{c}") for c in range(8)))
    case = F.lit(0)
    for c in range(8):
        case = case + F.when(F.col(f"v{c}") <= 0, 1 << c).otherwise(0)
    return sums.select("i", "j", "k", F.array(*(f"v{c}" for c in range(8))).alias("v"), case.cast("int").alias("case"))


def marching_cubes(field: DataFrame, mesh: Mesh, value: str = "phi") -> DataFrame:
    """Facets i, j, k, facet, v0, v1, v2 (arrays) of the owned cells."""
    spark = field.sparkSession
    cut = cells(field, mesh, value).filter("case NOT IN (0, 255)")
    rows = cut.join(F.broadcast(table_rows(spark)), "case")

    def point(n: int) -> Column:
        a, b = F.col("v")[F.col(f"p{n}")], F.col("v")[F.col(f"q{n}")]
        t = a / (a - b)
        out = []
        for d, axis in enumerate("ijk"):
            lo, hi = F.expr(f"shiftright(p{n}, {2 - d}) & 1"), F.expr(f"shiftright(q{n}, {2 - d}) & 1")
            out.append(F.lit(mesh.low[d]) + (F.col(axis) + lo + t * (hi - lo)) * mesh.cell_size[d])
        return F.array(*out).alias(f"v{n}")

    return rows.select("i", "j", "k", "facet", *(point(n) for n in range(3)))


def facet_area() -> Column:
    v = [Vector.of(F.col(f"v{n}"), 3) for n in range(3)]
    c = (v[1] - v[0]) % (v[2] - v[0])
    return 0.5 * F.sqrt(c.dot(c))


def numbered(facets: DataFrame) -> DataFrame:
    """facet_id in the order of cells (k, j, i) and the facets in them, for files: dealt out by range, sorted and
    numbered part by part. Numbers rise and are distinct, but leave gaps between parts."""
    order = ["k", "j", "i", "facet"]
    return facets.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("facet_id", F.monotonically_increasing_id())
