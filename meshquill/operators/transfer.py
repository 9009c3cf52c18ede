"""Particle-to-grid scatter and grid-to-particle gather, and the affine and polynomial transfers.

Scatter: particles are summed by their base index, a sum per stencil entity, then the sums are dealt to
entities and summed again. Spark combines on the map side, so what is shuffled is at most a row per task
and base index; no stencil is exploded before it. Gather: the field is the side that is dealt out: every entity sends its values to the
base indices whose stencils hold it, and each base index gets one row with all of them. Particles join
that once, by base index, and add up their stencil in the row: a particle is one row in the shuffle at
most, and none where Spark's own size check lets it broadcast the field.

Particle state of the affine transfer: 4 x N, row-major array, row 0 the velocity u, rows 1 to 3 the
transpose of B. Polynomial transfer: 8 x N modes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquill.functions.linalg import Matrix, determinant, inverse
from meshquill.operators.mesh import Mesh
from meshquill.operators.spline import POSITION, Place, based, knots, product_of, sure

#: Named values at one stencil entity, as SQL text over particle columns and what a Place gives.
Sums = dict[str, Callable[[Place], str]]


def scatter(
    particles: DataFrame, mesh: Mesh, location: str, order: int, sums: Sums, keep: list[str], members: tuple[str, ...] = ("value",), position: tuple[str, ...] = POSITION, field: DataFrame | None = None
) -> DataFrame:
    """Sum of each expression (over kept columns and a Place, which reads the field if one is given) by entity."""
    rows, places = placed(particles, mesh, location, order, keep, members, position, field)
    base = [f"_b{d}" for d in range(mesh.dim)]
    rows = rows.groupBy(*base).agg(*(F.expr(f"sum({e(place)}) AS {name}__{t}") for t, (_, place) in enumerate(places) for name, e in sums.items()))
    made = [", ".join([*(f"'{a}', {b} + {o}" for a, b, o in zip(mesh.axes, base, offset)), *(f"'{name}', {name}__{t}" for name in sums)]) for t, (offset, _) in enumerate(places)]
    rows = rows.select(F.expr(f"explode(array({', '.join(f'named_struct({m})' for m in made)})) AS _p"))
    rows = rows.select(*(mesh.wrapped(d, location, F.col(f"_p.{a}")).cast("long").alias(a) for d, a in enumerate(mesh.axes)), *(f"_p.{name}" for name in sums))
    inside = mesh.inside(location)
    rows = rows if inside is None else rows.filter(inside)
    return rows.groupBy(*mesh.axes).agg(*(F.sum(name).alias(name) for name in sums))


def field_by_base(field: DataFrame, mesh: Mesh, location: str, order: int) -> DataFrame:
    """A row per base index whose stencil holds an entity of the field: _b0.. and _f, the field's rows there in
    the order of the stencil, null where there is none. Base indices are wrapped in periodic dimensions."""
    n, size = order + 1, (order + 1) ** mesh.dim
    values = [c for c in field.columns if c not in mesh.axes]
    rows = field.select(*mesh.axes, F.struct(*values).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_t"))
    knot = [F.expr(f"(_t div {n ** (mesh.dim - 1 - d)}) % {n}") + knots(order)[0] for d in range(mesh.dim)]
    base = [mesh.wrapped(d, location, F.col(a) - knot[d]).cast("long").alias(f"_b{d}") for d, a in enumerate(mesh.axes)]
    names = [f"_b{d}" for d in range(mesh.dim)]
    rows = rows.select(*base, "_t", "_v").groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_v"))).alias("_m"))
    return rows.select(*names, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda t: F.try_element_at("_m", t)).alias("_f"))


def placed(
    particles: DataFrame, mesh: Mesh, location: str, order: int, keep: list[str], members: tuple[str, ...], position: tuple[str, ...] = POSITION, field: DataFrame | None = None
) -> tuple[DataFrame, list[tuple[list[int], Place]]]:
    """Rows and places as of based(), joined by base index to what the field has there, if one is given."""
    rows, places = based(particles, mesh, location, order, keep, members, position)
    if field is None:
        return rows, places
    at = [mesh.wrapped(d, location, F.col(f"_b{d}")).cast("long").alias(f"_b{d}") for d in range(mesh.dim)]
    rows = rows.select(*at, *(c for c in rows.columns if c not in {f"_b{d}" for d in range(mesh.dim)}))
    rows = rows.join(field_by_base(field, mesh, location, order), [f"_b{d}" for d in range(mesh.dim)])

    return rows, [(offset, place.reading(f"_f[{t}]")) for t, (offset, place) in enumerate(places)]


def gather(
    particles: DataFrame, mesh: Mesh, location: str, order: int, field: DataFrame, sums: Sums, key: str = "pid", members: tuple[str, ...] = ("value",), keep: tuple[str, ...] = (), position: tuple[str, ...] = POSITION
) -> DataFrame:
    """Sum over the stencil of each expression (over kept columns and a Place that reads the field) per particle;
    kept columns come along. A particle whose stencil holds no entity of the field has no row."""
    rows, places = placed(particles, mesh, location, order, [key, *keep], members, position, field)
    return rows.select(key, *keep, *(total(e, places).alias(name) for name, e in sums.items()))


def total(e: Callable[[Place], str], places: list[tuple[list[int], Place]]) -> Column:
    """The sum of e over the places, in their order; 0 where the field has no entity."""
    return F.expr(" + ".join(f"coalesce({e(place)}, 0D)" for _, place in places))


# Grid to particle -----------------------------------------------------------


def g2p_value(particles, mesh, location, order, field, value: str, size: int = 1, **more) -> DataFrame:
    """Sum of w * value: out, or out_0.. for a vector column of that size."""
    sums = {"out": lambda p: f"{p.w} * {p.read(value)}"} if size == 1 else {f"out_{d}": lambda p, d=d: f"{p.w} * {p.read(value, d)}" for d in range(size)}
    return gather(particles, mesh, location, order, field, sums, **more)


def g2p_gradient(particles, mesh, location, order, field, value: str, size: int = 1, **more) -> DataFrame:
    """Scalar: out_d. Vector: out_{component}{derivative}."""
    if size == 1:
        sums = {f"out_{d}": lambda p, d=d: f"{p.g[d]} * {p.read(value)}" for d in range(mesh.dim)}
    else:
        sums = {f"out_{a}{d}": lambda p, a=a, d=d: f"{p.g[d]} * {p.read(value, a)}" for a in range(size) for d in range(mesh.dim)}
    return gather(particles, mesh, location, order, field, sums, members=("gradient",), **more)


def g2p_divergence(particles, mesh, location, order, field, value: str, **more) -> DataFrame:
    sums = {"out": lambda p: dot([p.read(value, d) for d in range(mesh.dim)], p.g)}
    return gather(particles, mesh, location, order, field, sums, members=("gradient",), **more)


# Particle to grid -----------------------------------------------------------


def p2g_value(particles, mesh, location, order, value: str, size: int = 1) -> DataFrame:
    rows, names = _flat(particles, value, size)
    sums = {"out" if size == 1 else f"out_{d}": lambda p, n=n: f"{p.w} * {n}" for d, n in enumerate(names)}
    return scatter(rows, mesh, location, order, sums, names)


def p2g_gradient(particles, mesh, location, order, value: str) -> DataFrame:
    rows, names = _flat(particles, value, 1)
    return scatter(rows, mesh, location, order, {f"out_{d}": lambda p, d=d: f"{p.g[d]} * {names[0]}" for d in range(mesh.dim)}, names, ("gradient",))


def p2g_divergence(particles, mesh, location, order, value: str, tensor: bool = False) -> DataFrame:
    """Of a vector: out. Of a row-major tensor T: out_i, the sum over j of T_ij times the j-th derivative."""
    n = mesh.dim
    rows, names = _flat(particles, value, n * n if tensor else n)
    if tensor:
        sums = {f"out_{i}": lambda p, i=i: dot(names[i * n : i * n + n], p.g) for i in range(n)}
    else:
        sums = {"out": lambda p: dot(names, p.g)}
    return scatter(rows, mesh, location, order, sums, names, ("gradient",))


def _flat(particles: DataFrame, value: str, size: int) -> tuple[DataFrame, list[str]]:
    """Positions and the value's components, each a column."""
    names = [f"_q{n}" for n in range(size)]
    parts = [F.col(value)] if size == 1 else [_c(value, n) for n in range(size)]
    return particles.select(*(x for x in POSITION if x in particles.columns), *(sure(e).alias(n) for e, n in zip(parts, names))), names


def _c(name: str, d: int) -> Column:
    return F.col(name).getItem(d)


def dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


# Affine transfer ------------------------------------------------------------


def inertial_scaling(order: int, h: float) -> float:
    """Inverse of the stencil's second moment."""
    return {2: 4.0, 3: 3.0}[order] / (h * h)


def apic_p2g(particles: DataFrame, mesh: Mesh, location: str, order: int, mass: str = "m", state: str = "c", dim: int | None = None) -> DataFrame:
    """Grid momentum mu_0.. and mass. dim: staggered, only that component, at a location of its own."""
    which = range(3) if dim is None else [dim]
    scale = 1.0 if order == 1 else inertial_scaling(order, mesh.cell_size[0])
    parts = {f"_s{r}{d}": sure(F.col(mass) * _c(state, r * 3 + d) * (scale if r else 1.0)) for r in range(4) for d in which}
    rows = particles.select(*POSITION, sure(F.col(mass)).alias("_mass"), *(e.alias(n) for n, e in parts.items()))

    def momentum(p: Place, d: int) -> str:
        bend = [f"_s{1 + e}{d}" for e in range(3)]
        return f"({p.w} * _s0{d} + {dot(bend, p.g)})" if order == 1 else f"{p.w} * (_s0{d} + {dot(bend, p.d)})"

    sums = {(f"mu_{d}" if dim is None else "mu"): lambda p, d=d: momentum(p, d) for d in which}
    return scatter(rows, mesh, location, order, sums | {"mass": lambda p: f"{p.w} * _mass"}, ["_mass", *parts], ("gradient",) if order == 1 else ("distance",))


def apic_g2p(particles: DataFrame, mesh: Mesh, location: str, order: int, field: DataFrame, value: str = "u", key: str = "pid", dim: int | None = None) -> DataFrame:
    """State c per particle, overwritten: collocated from a vector column; staggered from a scalar one,
    other components 0."""
    which = range(3) if dim is None else [dim]
    at = lambda p, d: p.read(value, d) if dim is None else p.read(value)
    sums = {f"c0{d}": lambda p, d=d: f"{p.w} * {at(p, d)}" for d in which} | {f"c{1 + e}{d}": lambda p, d=d, e=e: f"{p.w} * {at(p, d)} * {p.d[e]}" for d in which for e in range(3)}
    rows = gather(particles, mesh, location, order, field, sums, key, ("distance",))
    return rows.select(key, F.array(*(F.col(f"c{r}{d}") if d in which else F.lit(0.0) for r in range(4) for d in range(3))).alias("c"))


# Polynomial transfer, linear basis, 8 modes -----------------------------------

#: The axes of each mode's basis polynomial.
ALONG = [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]


def polypic_p2g(particles: DataFrame, mesh: Mesh, location: str, dt: float, mass: str = "m", state: str = "c", dim: int | None = None) -> DataFrame:
    """Momentum and mass from 8 x 3 modes: distances are first taken back by the inverse of I + dt * (rows 1 to 3)."""
    which = range(3) if dim is None else [dim]
    modes = [f"_s{r}{d}" for r in range(8) for d in which]
    shape = particles.select(*POSITION, F.col(mass).alias("_mass"), *(_c(state, r * 3 + d).alias(f"_s{r}{d}") for r in range(8) for d in which), *(_c(state, 3 + n).alias(f"_a{n}") for n in range(9)))
    a = Matrix([[F.lit(1.0 if r == c else 0.0) + dt * F.col(f"_a{r * 3 + c}") for c in range(3)] for r in range(3)])
    # the determinant, then the inverse, by themselves: once per particle, not once per entity
    shape = shape.withColumn("_det", determinant(a))
    back = inverse(a, F.col("_det")).v
    rows = shape.select(*POSITION, *(sure(F.col(c)).alias(c) for c in ("_mass", *modes)), *(sure(x).alias(f"_v{n}") for n, x in enumerate(back)))

    def momentum(p: Place, d: int) -> str:
        m = [dot([f"_v{r * 3 + e}" for e in range(3)], p.d) for r in range(3)]
        return f"{p.w} * _mass * (" + " + ".join(product_of([f"_s{r}{d}", *(m[e] for e in axes)]) for r, axes in enumerate(ALONG)) + ")"

    sums = {(f"mu_{d}" if dim is None else "mu"): lambda p, d=d: momentum(p, d) for d in which}
    return scatter(rows, mesh, location, 1, sums | {"mass": lambda p: f"{p.w} * _mass"}, ["_mass", *modes, *(f"_v{n}" for n in range(9))], ("distance",))


def polypic_g2p(particles: DataFrame, mesh: Mesh, location: str, field: DataFrame, value: str = "u", key: str = "pid", dim: int | None = None, state: str | None = None) -> DataFrame:
    """8 x 3 modes per particle. Staggered: only column dim is set; the others are those of `state`."""
    # mode r takes the gradient along the axes of its basis polynomial and the weight along the others
    which = range(3) if dim is None else [dim]
    at = lambda p, d: p.read(value, d) if dim is None else p.read(value)
    factor = lambda p, axes: product_of([p.factors[e][1 if e in axes else 0] for e in range(3)])
    sums = {f"c{r}{d}": lambda p, axes=axes, d=d: f"{factor(p, axes)} * {at(p, d)}" for r, axes in enumerate(ALONG) for d in which}
    out = gather(particles, mesh, location, 1, field, sums, key, ("gradient",), (state,) if state else ())
    other = lambda r, d: _c(state, r * 3 + d) if state else F.lit(0.0)
    return out.select(key, F.array(*(F.col(f"c{r}{d}") if d in which else other(r, d) for r in range(8) for d in range(3))).alias("c"))
