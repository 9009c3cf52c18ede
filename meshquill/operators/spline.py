"""B-spline stencils of order 0 to 3 as Column expressions.

Per axis X = (x - low) / h - off gives a base index and a fraction, from which the order + 1 weights,
their gradients and the distances entity minus particle follow. A stencil row's weight is the product
over the axes; a gradient replaces one factor.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquill.operators.mesh import OFFSETS, Mesh

POSITION = ("x", "y", "z")


def axis_base(order: int, x: Column) -> Column:
    """Index of the particle's reference knot."""
    return F.floor(x + 0.5) if order in (0, 2) else F.floor(x)


def knots(order: int) -> list[int]:
    """Stencil knots relative to the base."""
    return {0: [0], 1: [0, 1], 2: [-1, 0, 1], 3: [-1, 0, 1, 2]}[order]


def axis_weights(order: int, f: Column) -> list[Column]:
    if order == 0:
        return [F.lit(1.0)]
    if order == 1:
        return [1.0 - f, f]
    if order == 2:
        return [0.5 * (0.5 - f) * (0.5 - f), 0.75 - f * f, 0.5 * (0.5 + f) * (0.5 + f)]
    g = 1.0 - f
    return [g * g * g / 6.0, (3.0 * f * f * f - 6.0 * f * f + 4.0) / 6.0, (-3.0 * f * f * f + 3.0 * f * f + 3.0 * f + 1.0) / 6.0, f * f * f / 6.0]


def axis_gradients(order: int, f: Column, h: float) -> list[Column]:
    if order == 0:
        return [F.lit(0.0)]
    if order == 1:
        return [F.lit(-1.0 / h), F.lit(1.0 / h)]
    if order == 2:
        return [-(0.5 - f) / h, -2.0 * f / h, (0.5 + f) / h]
    g = 1.0 - f
    return [-0.5 * g * g / h, (1.5 * f * f - 2.0 * f) / h, (-1.5 * f * f + f + 0.5) / h, 0.5 * f * f / h]


class Place:
    """What a sum over a stencil may use, as SQL text: weight w, gradient g[d] and distance d[d] of one entity, each
    axis's own (weight, gradient) factors[d], and read(name), a gathered field's value there (an array's by component).
    Text, since a sum over 64 entities takes thousands of column objects, each of which is a call to the JVM."""

    def __init__(self, w: str, g: list[str], d: list[str], factors: list[tuple[str, str]] = (), field: str = ""):
        self.w, self.g, self.d, self.factors, self._field = w, g, d, factors, field

    def read(self, name: str, component: int | None = None) -> str:
        return f"{self._field}.`{name}`" + ("" if component is None else f"[{component}]")

    def reading(self, field: str) -> Place:
        return Place(self.w, self.g, self.d, self.factors, field)


def product_of(factors: list[str]) -> str:
    return "(" + " * ".join(factors) + ")"


def sure(x: Column) -> Column:
    """x, 0 for null: it adds nothing. Code without tests for null is a third as long, which the JVM compiles."""
    return F.coalesce(x.cast("double"), F.lit(0.0))


def based(particles: DataFrame, mesh: Mesh, location: str, order: int, keep: list[str], members: tuple[str, ...], position: tuple[str, ...] = POSITION) -> tuple[DataFrame, list[tuple[list[int], Place]]]:
    """One row per particle with its base index _b0.. and per-axis factors, and for every stencil entity its
    offsets from the base and its Place over those columns. Particles without a position have no row."""
    off, n = OFFSETS[location], mesh.dim
    logical = [sure((F.col(position[d]) - mesh.low[d]) / mesh.cell_size[d] - off[d]).alias(f"_x{d}") for d in range(n)]
    rows = particles.dropna(subset=list(position[:n])).select(*keep, *logical)
    rows = rows.select(*keep, *(f"_x{d}" for d in range(n)), *(axis_base(order, F.col(f"_x{d}")).cast("long").alias(f"_b{d}") for d in range(n)))
    rows = rows.select(*keep, *(f"_b{d}" for d in range(n)), *((F.col(f"_x{d}") - F.col(f"_b{d}")).alias(f"_f{d}") for d in range(n)))
    made = []
    for d in range(n):
        made += [w.alias(f"_w{d}_{t}") for t, w in enumerate(axis_weights(order, F.col(f"_f{d}")))]
        if "gradient" in members:
            made += [g.alias(f"_g{d}_{t}") for t, g in enumerate(axis_gradients(order, F.col(f"_f{d}"), mesh.cell_size[d]))]
    rows = rows.select(*keep, *(f"_b{d}" for d in range(n)), *(f"_f{d}" for d in range(n) if "distance" in members), *made)
    places = []
    for t in product(range(order + 1), repeat=n):
        factors = [(f"_w{d}_{t[d]}", f"_g{d}_{t[d]}") for d in range(n)]
        g = [product_of([factors[e][1 if e == d else 0] for e in range(n)]) for d in range(n)] if "gradient" in members else []
        dist = [f"(({knots(order)[t[d]]} - _f{d}) * {mesh.cell_size[d]!r}D)" for d in range(n)] if "distance" in members else []
        places.append(([knots(order)[x] for x in t], Place(product_of([w for w, _ in factors]), g, dist, factors)))
    return rows, places


def stencil(particles: DataFrame, mesh: Mesh, location: str, order: int, keep: list[str], members: tuple[str, ...] = ("value",), position: tuple[str, ...] = POSITION) -> DataFrame:
    """One row per particle and stencil entity: the kept columns, i j k, w, and where asked for gi gj gk
    ("gradient"), di dj dk ("distance"). Indices wrap in periodic dimensions; entities outside the
    others are dropped."""
    off, axes, n = OFFSETS[location], mesh.axes, order + 1
    logical = [((F.col(position[d]) - mesh.low[d]) / mesh.cell_size[d] - off[d]).alias(f"_x{d}") for d in range(mesh.dim)]
    rows = particles.select(*keep, *logical)
    rows = rows.select(*keep, *(f"_x{d}" for d in range(mesh.dim)), *(axis_base(order, F.col(f"_x{d}")).cast("long").alias(f"_b{d}") for d in range(mesh.dim)))
    made = []
    for d in range(mesh.dim):
        f = F.col(f"_x{d}") - F.col(f"_b{d}")
        made.append(F.array(*axis_weights(order, f)).alias(f"_w{d}"))
        if "gradient" in members:
            made.append(F.array(*axis_gradients(order, f, mesh.cell_size[d])).alias(f"_g{d}"))
    carry = [f"_b{d}" for d in range(mesh.dim)] + ([f"_x{d}" for d in range(mesh.dim)] if "distance" in members else [])
    rows = rows.select(*keep, *carry, *made, F.explode(F.sequence(F.lit(0), F.lit(n**mesh.dim - 1))).alias("_s"))
    place = [F.expr(f"(_s div {n ** (mesh.dim - 1 - d)}) % {n}").cast("int") for d in range(mesh.dim)]
    at = [F.col(f"_b{d}") + place[d] + knots(order)[0] for d in range(mesh.dim)]
    weight = [F.col(f"_w{d}")[place[d]] for d in range(mesh.dim)]
    w = weight[0]
    for x in weight[1:]:
        w = w * x
    out = [*keep, *(mesh.wrapped(d, location, at[d]).cast("long").alias(axes[d]) for d in range(mesh.dim)), w.alias("w")]
    for d in range(mesh.dim):
        if "gradient" in members:
            g = F.col(f"_g{d}")[place[d]]
            for e in range(mesh.dim):
                g = g * weight[e] if e != d else g
            out.append(g.alias(f"g{axes[d]}"))
        if "distance" in members:
            out.append(((at[d] - F.col(f"_x{d}")) * mesh.cell_size[d]).alias(f"d{axes[d]}"))
    rows = rows.select(*out)
    inside = mesh.inside(location)
    return rows if inside is None else rows.filter(inside)
