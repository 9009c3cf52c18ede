"""Documented algorithms composed of the operators: one step of each as a DataFrame to DataFrame function.
Callers that take many steps write the particles between them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.operators import geometry, levelset, particles, transfer
from meshquill.operators.mesh import Mesh
from meshquill.plans import sqlgen as Q
from meshquill.sources import fixtures as FX
from meshquill.sources import stl
from meshquill.sources.shared import checkpoint, new_path


def unpacked(df: DataFrame, name: str, n: int) -> DataFrame:
    """An array column as n columns name_0.."""
    return df.select(*(c for c in df.columns if c != name), *(F.col(name)[i].alias(f"{name}_{i}") for i in range(n)))


def stl_roundtrip(facets: DataFrame, *global_ids: int) -> DataFrame:
    """The facets of those volumes written as a surface, in the shared folder, and read back."""
    path = new_path(facets.sparkSession, "stl")
    stl.write_stl(facets.filter(F.col("global_id").isin(*global_ids)) if global_ids else facets, path)
    return stl.read_stl(facets.sparkSession, path)


def incompressible_step(p: DataFrame, mesh: Mesh, dt: float, bulk: float, gamma: float, gravity: tuple[float, float, float], volume: float) -> DataFrame:
    """Nearly incompressible affine step. p: pid, x, y, z, m, jac (volume ratio), c (4 x 3). Pressure force and momentum are
    summed in one shuffle; walls stop what leaves through them."""
    pressure = -bulk * (F.pow(F.col("jac"), -gamma) - 1.0)
    scale = transfer.inertial_scaling(2, mesh.cell_size[0])
    sums = {"mass": lambda q: f"{q.w} * m"}
    for d in range(3):
        sums[f"mu{d}"] = lambda q, d=d: f"{q.w} * m * (c[{d}] + {scale!r}D * {transfer.dot([f'c[{3 + 3 * e + d}]' for e in range(3)], q.d)})"
        sums[f"f{d}"] = lambda q, d=d: f"{-volume!r}D * jac * pressure * {q.g[d]}"
    grid = transfer.scatter(p.withColumn("pressure", pressure), mesh, "node", 2, sums, ["m", "c", "jac", "pressure"], ("gradient", "distance"))
    last = [n for n in mesh.extent("node")]
    u = []
    for d, a in enumerate("ijk"):
        free = F.try_divide(F.col(f"mu{d}") + dt * F.col(f"f{d}"), F.col("mass")) + dt * gravity[d]
        wall = F.lit(False) if mesh.periodic[d] else ((F.col(a) <= 0) & (free < 0)) | ((F.col(a) >= last[d] - 1) & (free > 0))
        u.append(F.when(wall, 0.0).otherwise(free))
    grid = grid.filter("mass > 0").select("i", "j", "k", F.array(*u).alias("u"))
    out = {f"c{d}": lambda q, d=d: f"{q.w} * {q.read('u', d)}" for d in range(3)} | {f"c{3 + 3 * e + d}": lambda q, e=e, d=d: f"{q.w} * {q.read('u', d)} * {q.d[e]}" for e in range(3) for d in range(3)}
    out["div"] = lambda q: transfer.dot(q.g, [q.read("u", d) for d in range(3)])
    new = transfer.gather(p, mesh, "node", 2, grid, out, members=("gradient", "distance"), keep=("x", "y", "z", "m", "jac"))
    return new.select("pid", *((F.col(a) + dt * F.col(f"c{d}")).alias(a) for d, a in enumerate("xyz")), "m", (F.col("jac") * F.exp(dt * F.col("div"))).alias("jac"), F.array(*(F.col(f"c{n}") for n in range(12))).alias("c"))


def position_correction(p: DataFrame, mesh: Mesh, dt: float, density: float, kappa: float) -> DataFrame:
    """pid and the shift dx, dy, dz that evens out cell densities."""
    h3 = mesh.cell_size[0] ** 3
    rho = transfer.p2g_value(p, mesh, "cell", 1, "m").withColumnRenamed("out", "rho")
    filled = transfer.p2g_value(p.withColumn("one", F.lit(1.0)), mesh, "cell", 0, "one").withColumnRenamed("out", "filled")
    cells = rho.join(filled, ["i", "j", "k"], "left").select("i", "j", "k", (F.col("rho") / h3).alias("rho"), F.coalesce("filled", F.lit(0.0)).alias("filled"))
    edge = F.lit(False)
    for d, a in enumerate("ijk"):
        edge = edge | (F.col(a).isin(0, mesh.num_cell[d] - 1) if not mesh.periodic[d] else F.lit(False))
    r = F.when((F.col("filled") > 0) | edge, F.col("rho")).otherwise(F.greatest("rho", F.lit(density)))
    push = cells.select("i", "j", "k", (dt * dt / density * kappa * (1 - r / density)).alias("push"))
    nodes = mesh.nodes(p.sparkSession).withColumnsRenamed({"i": "ni", "j": "nj", "k": "nk"})
    shift = transfer.gather(nodes, mesh, "cell", 1, push, {f"s{d}": lambda q, d=d: f"-{q.g[d]} * {q.read('push')}" for d in range(3)}, "ni", ("gradient",), ("nj", "nk"))
    shift = shift.select(F.col("ni").alias("i"), F.col("nj").alias("j"), F.col("nk").alias("k"), F.array("s0", "s1", "s2").alias("s"))
    return transfer.g2p_value(p, mesh, "node", 2, shift, "s", 3).withColumnsRenamed({"out_0": "dx", "out_1": "dy", "out_2": "dz"})


def regularized(phi, h: float):
    """One half less a logistic of the distance: sharp at the surface."""
    return 0.5 - 1.0 / (1.0 + F.exp(phi / (h / 2)))


def heat_step(p: DataFrame, mesh: Mesh, dt: float, conductivity: float, capacity: float, phi: DataFrame, source: float) -> DataFrame:
    """Internal energy by diffusion and a surface source. p: pid, x, y, z, m, v, e; phi: i, j, k, phi. Returns pid, e."""
    grid = transfer.scatter(p, mesh, "node", 2, {"mass": lambda q: f"{q.w} * m", "me": lambda q: f"{q.w} * m * e"}, ["m", "e"])
    grid = grid.filter("mass > 0").select("i", "j", "k", "mass", (F.col("me") / F.col("mass")).alias("mean")).join(phi.select("i", "j", "k", regularized(F.col("phi"), mesh.cell_size[0]).alias("soft")), ["i", "j", "k"])
    at = transfer.gather(p, mesh, "node", 2, grid, {"soft_p": lambda q: f"{q.w} * {q.read('soft')}"} | {f"slope{d}": lambda q, d=d: f"{q.g[d]} * {q.read('mean')}" for d in range(3)}, members=("gradient",), keep=("x", "y", "z", "v", "e"))
    at = at.withColumn("s", F.when(F.abs("soft_p") <= 0.45, source).otherwise(0.0))
    gain = lambda q: f"v * ({q.w} * s - {conductivity / capacity!r}D * {transfer.dot([f'slope{d}' for d in range(3)], q.g)})"
    change = transfer.scatter(at, mesh, "node", 2, {"gain": gain}, ["v", "s", "slope0", "slope1", "slope2"], ("gradient",))
    rise = grid.join(change, ["i", "j", "k"]).select("i", "j", "k", (dt * F.col("gain") / F.col("mass")).alias("rise"))
    up = transfer.g2p_value(p, mesh, "node", 2, rise, "rise", keep=("e",))
    return up.select("pid", (F.col("e") + F.col("out")).alias("e"))


#: The corners of a cell in the order of a linear stencil, as signs by axis.
CORNERS = [[1 if n >> (2 - d) & 1 else -1 for d in range(3)] for n in range(8)]


def flip_step(
    p: DataFrame, mesh: Mesh, dt: float, gravity: tuple[float, float, float], bulk: float, density: float, gamma: float, viscosity: float, second: float = 0.0, artificial: float = 0.0, blend: float = 1.0
) -> DataFrame:
    """Explicit step with pressure and viscosity in the cells, that gives particles the grid's velocity change (blend 1)
    or its velocity (0). p: pid, x, y, z, m, v (volume at rest), jac (volume ratio), u (array of 3); so is the result.

    Cells have density, a pressure bulk * ((rho / density) ** gamma - 1), the viscous pressure -(second + 2 viscosity)
    div u, the shear viscosity * curl u, and, for artificial > 0, where the flow converges, a shock pressure. A node's
    momentum changes by its corner gradient in each of the 8 cells round it, times their volume; at the walls nothing
    flows through. The viscous pressure resists compression, so that what it takes from the motion is never negative."""
    h, volume = mesh.cell_size, math.prod(mesh.cell_size)
    sums = {"mass": lambda q: f"{q.w} * m"} | {f"mu{d}": lambda q, d=d: f"{q.w} * m * u[{d}]" for d in range(3)}
    nodes = transfer.scatter(p, mesh, "node", 1, sums, ["m", "u"]).filter("mass > 0").select("i", "j", "k", "mass", F.array(*(F.expr(f"mu{d} / mass") for d in range(3))).alias("u"))
    cells = transfer.scatter(p, mesh, "cell", 2, {"mc": lambda q: f"{q.w} * m", "vc": lambda q: f"{q.w} * v * jac"}, ["m", "v", "jac"]).filter("mc > 0 AND vc > 0")
    corners = transfer.field_by_base(nodes.select("i", "j", "k", "u"), mesh, "node", 1).withColumnsRenamed({"_b0": "i", "_b1": "j", "_b2": "k"})
    at = lambda n, d: f"coalesce(_f[{n}].u[{d}], 0D)"
    slope = lambda e, d: "(" + " + ".join(f"{CORNERS[n][e] * 0.25 / h[e]!r}D * {at(n, d)}" for n in range(8)) + ")"
    cells = cells.join(corners, ["i", "j", "k"]).select("i", "j", "k", F.expr("mc / vc").alias("rho"), F.expr(" + ".join(slope(d, d) for d in range(3))).alias("div"), *(F.expr(f"{viscosity!r}D * ({slope((d + 1) % 3, (d + 2) % 3)} - {slope((d + 2) % 3, (d + 1) % 3)})").alias(f"psi{d}") for d in range(3)))
    shock = f"CASE WHEN div < 0 THEN {artificial**2 * h[0] ** 2!r}D * rho * div * div ELSE 0D END"
    cells = cells.withColumn("press", F.expr(f"{bulk!r}D * (pow(rho / {density!r}D, {gamma!r}D) - 1) - {second + 2 * viscosity!r}D * div + {shock}"))
    push = []
    for n, sign in enumerate(CORNERS):
        g = [f"{sign[d] * 0.25 / h[d] * volume!r}D" for d in range(3)]
        force = [f"{g[d]} * press + ({g[(d + 1) % 3]} * psi{(d + 2) % 3} - {g[(d + 2) % 3]} * psi{(d + 1) % 3}) AS f{d}" for d in range(3)]
        push.append("struct(" + ", ".join([f"{a} + {max(0, sign[d])} AS {a}" for d, a in enumerate("ijk")] + force) + ")")
    pushed = cells.select(F.expr(f"explode(array({', '.join(push)})) AS q")).select(*(mesh.wrapped(d, "node", F.col(f"q.{a}")).cast("long").alias(a) for d, a in enumerate("ijk")), "q.f0", "q.f1", "q.f2")
    pushed = pushed.groupBy("i", "j", "k").agg(*(F.sum(f"f{d}").alias(f"f{d}") for d in range(3)))
    last = mesh.extent("node")
    new = []
    for d, a in enumerate("ijk"):
        free = f"u[{d}] + {dt!r}D * (coalesce(f{d}, 0D) / mass + {float(gravity[d])!r}D)"
        new.append(free if mesh.periodic[d] else f"CASE WHEN {a} = 0 OR {a} = {last[d] - 1} THEN 0D ELSE {free} END")
    grid = nodes.join(pushed, ["i", "j", "k"], "left").select("i", "j", "k", F.expr(f"array({', '.join(new)})").alias("v1"), F.col("u").alias("v0"))
    got = {f"n{d}": lambda q, d=d: f"{q.w} * {q.read('v1', d)}" for d in range(3)} | {f"o{d}": lambda q, d=d: f"{q.w} * {q.read('v0', d)}" for d in range(3)}
    got["div"] = lambda q: transfer.dot(q.g, [q.read("v1", d) for d in range(3)])
    seen = transfer.gather(p, mesh, "node", 1, grid, got, members=("gradient",), keep=("x", "y", "z", "m", "v", "jac", "u"))
    u = [blend * (F.col("u")[d] + F.col(f"n{d}") - F.col(f"o{d}")) + (1 - blend) * F.col(f"n{d}") for d in range(3)]
    return seen.select("pid", *((F.col(a) + dt * F.col(f"n{d}")).alias(a) for d, a in enumerate("xyz")), "m", "v", (F.col("jac") * F.exp(dt * F.col("div"))).alias("jac"), F.array(*u).alias("u"))


def rotating_disk(spark: SparkSession, facets: DataFrame, box_id: int, mesh: Mesh, angle: float, steps: int, radius: float, p: levelset.LevelSet, per_dim: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Particles in a shape of facets, coloured by the volume that holds them and turned about the z axis through the
    origin step by step, as (particles, distance estimate of all colours, redistanced level set). Every step's
    particles are written, so that no lineage grows with the number of steps."""
    made = particles.particles_uniform(spark, mesh, per_dim)
    inside = geometry.locate(made, facets, box_id).filter("volume_id >= 0")
    moved = checkpoint(made.join(inside, "pid").select("pid", "x", "y", "z", F.col("volume_id").alias("color")))
    c, s = math.cos(angle), math.sin(angle)
    for _ in range(steps):
        moved = checkpoint(moved.select("pid", (F.col("x") * c - F.col("y") * s).alias("x"), (F.col("x") * s + F.col("y") * c).alias("y"), "z", "color"))
    estimate = checkpoint(levelset.estimate_distance(levelset.of_color(moved, -1), mesh, "node", radius))
    return moved, estimate, levelset.redistance(estimate, mesh, p, "distance_estimate")


# Registered steps ------------------------------------------------------------------------------


def _ev(s: SparkSession, d: str) -> DataFrame:
    return FX.particles_ev(s, d).withColumn("m", (F.col("pid") % 7 + 1).cast("double"))


_EVM = f"{Q.EV}, p as (select *, cast(pid % 7 + 1 as double) as m from ev)"


def _incompressible(s: SparkSession, d: str) -> DataFrame:
    p = _ev(s, d).withColumn("jac", F.lit(1.0)).withColumn("c", F.array(*((F.col("pid") * (n + 1) % 5 - 2).cast("double") for n in range(12))))
    out = unpacked(incompressible_step(p, FX.MESH, 0.125, 10.0, 7.0, (0.0, 0.0, -1.0), 1.0), "c", 12)
    return out.select("pid", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z", "jac", *(f"c_{n}" for n in range(12)))))


def _incompressible_sql() -> str:
    c = lambda r, e: f"cast((pid * {3 * r + e + 1}) % 5 - 2 as double)"
    mu = ", ".join(f"sum(w * m * ({c(0, d)} + 4 * ({c(1, d)} * di + {c(2, d)} * dj + {c(3, d)} * dk))) / sum(w * m) + {0.125 * g} as f{d}" for d, g in enumerate((0.0, 0.0, -1.0)))
    last = (16, 8, 8)
    u = ", ".join(f"case when ({a} <= 0 and f{d} < 0) or ({a} >= {last[d]} and f{d} > 0) then 0e0 else f{d} end as u{d}" for d, a in enumerate("ijk"))
    return f"""with {_EVM}, {Q.stencil('p', 2, 'node')}, g as (select i, j, k, {mu} from s group by i, j, k having sum(w * m) > 0), h as (select i, j, k, {u} from g),
n as (select pid, any_value(s.x) as x, any_value(s.y) as y, any_value(s.z) as z, {', '.join([f'sum(w * u{e}) as c{e}' for e in range(3)] + [f'sum(w * u{e} * d{a}) as c{3 + 3 * n + e}' for n, a in enumerate('ijk') for e in range(3)])}, sum(gi * u0 + gj * u1 + gk * u2) as dv from s join h using (i, j, k) group by pid)
select pid, round(x + 125e-3 * c0, 6) + 0e0 as x, round(y + 125e-3 * c1, 6) + 0e0 as y, round(z + 125e-3 * c2, 6) + 0e0 as z, round(exp(125e-3 * dv), 6) + 0e0 as jac, {', '.join(f'round(c{x}, 6) + 0e0 as c_{x}' for x in range(12))} from n"""


def _flip(s: SparkSession, d: str) -> DataFrame:
    p = _ev(s, d).withColumn("u", F.array(*((F.col("pid") * (n + 1) % 5 - 2).cast("double") for n in range(3)))).withColumns({"v": F.lit(0.25), "jac": F.lit(1.0) + (F.col("pid") % 3) / 8.0})
    out = unpacked(flip_step(p, FX.MESH, 0.03125, (0.0, 0.0, -1.0), 8.0, 16.0, 2.0, 0.5, 0.25, 1.0), "u", 3)
    return out.select("pid", *((F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z", "jac", "u_0", "u_1", "u_2")))


def _flip_sql() -> str:
    v = lambda e: f"cast((pid * {e + 1}) % 5 - 2 as double)"
    at = lambda source, order, location, select: f"(with {Q.stencil(source, order, location)} {select})"
    slope = lambda e, d: f"sum(c{e} * coalesce(f{d}, 0e0)) * 25e-2"
    curl = ", ".join(f"5e-1 * ({slope((d + 1) % 3, (d + 2) % 3)} - {slope((d + 2) % 3, (d + 1) % 3)}) as psi{d}" for d in range(3))
    force = ", ".join(f"sum(25e-2 * (c{d} * press + c{(d + 1) % 3} * psi{(d + 2) % 3} - c{(d + 2) % 3} * psi{(d + 1) % 3})) as p{d}" for d in range(3))
    last = (16, 8, 8)
    new = ", ".join(f"case when g.{a} = 0 or g.{a} = {last[d]} then 0e0 else f{d} + 3125e-5 * (coalesce(p{d}, 0e0) / mass + {-1.0 if d == 2 else 0.0}) end as n{d}" for d, a in enumerate("ijk"))
    return f"""with {_EVM}, pj as (select *, 1e0 + (pid % 3) / 8e0 as jac from p),
g as {at('pj', 1, 'node', f"select i, j, k, sum(w * m) as mass, {', '.join(f'sum(w * m * {v(e)}) / sum(w * m) as f{e}' for e in range(3))} from s group by i, j, k having sum(w * m) > 0")},
c as {at('pj', 2, 'cell', 'select i, j, k, sum(w * m) / sum(w * 25e-2 * jac) as rho from s group by i, j, k having sum(w * m) > 0')},
k as (select c.i, c.j, c.k, rho, x, y, z, 2 * x - 1 as c0, 2 * y - 1 as c1, 2 * z - 1 as c2 from c, (select unnest(range(2)) as x) as h0, (select unnest(range(2)) as y) as h1, (select unnest(range(2)) as z) as h2),
m as (select k.i, k.j, k.k, any_value(rho) as rho, {slope(0, 0)} + {slope(1, 1)} + {slope(2, 2)} as dv, {curl} from k left join g on g.i = k.i + x and g.j = k.j + y and g.k = k.k + z group by k.i, k.j, k.k),
t as (select *, 8e0 * (pow(rho / 16e0, 2e0) - 1) - 125e-2 * dv + case when dv < 0 then rho * dv * dv else 0e0 end as press from m),
q as (select k.i + x as i, k.j + y as j, k.k + z as k, {force} from k join t on t.i = k.i and t.j = k.j and t.k = k.k group by k.i + x, k.j + y, k.k + z),
n as (select g.i, g.j, g.k, f0, f1, f2, {new} from g left join q on q.i = g.i and q.j = g.j and q.k = g.k),
r as {at('pj', 1, 'node', f"select pid, any_value(s.x) as x, any_value(s.y) as y, any_value(s.z) as z, any_value(jac) as jac, {', '.join(f'sum(w * n{e}) as a{e}, sum(w * (n{e} - f{e})) as b{e}' for e in range(3))}, sum(gi * n0 + gj * n1 + gk * n2) as dv from s join n on n.i = s.i and n.j = s.j and n.k = s.k group by pid")}
select pid, {', '.join(f'round({x} + 3125e-5 * a{e}, 6) + 0e0 as {x}' for e, x in enumerate('xyz'))}, round(jac * exp(3125e-5 * dv), 6) + 0e0 as jac, {', '.join(f'round({v(e)} + b{e}, 6) + 0e0 as u_{e}' for e in range(3))} from r"""


def _heat(s: SparkSession, d: str) -> DataFrame:
    p = _ev(s, d).withColumn("v", F.lit(1.0)).withColumn("e", (F.col("pid") % 11).cast("double"))
    phi = FX.MESH.entities(s).withColumn("phi", F.col("i") / 4.0 - 1.5)
    return heat_step(p, FX.MESH, 0.125, 2.0, 4.0, phi, 1.0).select("pid", (F.round("e", 6) + 0.0).alias("e"))


def _heat_sql() -> str:
    e = "cast(pid % 11 as double)"
    return f"""with {_EVM}, {Q.stencil('p', 2, 'node')}, g as (select i, j, k, sum(w * m) as mass, sum(w * m * {e}) / sum(w * m) as mean from s group by i, j, k having sum(w * m) > 0),
a as (select pid, sum(gi * mean) as s0, sum(gj * mean) as s1, sum(gk * mean) as s2, case when abs(sum(w * (5e-1 - 1 / (1 + exp(2 * (i / 4e0 - 15e-1)))))) <= 45e-2 then 1e0 else 0e0 end as src from s join g using (i, j, k) group by pid),
c as (select i, j, k, sum(w * src - 5e-1 * (s0 * gi + s1 * gj + s2 * gk)) as gain from s join a using (pid) group by i, j, k),
r as (select i, j, k, 125e-3 * gain / mass as rise from g join c using (i, j, k))
select pid, round({e} + sum(w * rise), 6) + 0e0 as e from s join r using (i, j, k) group by pid"""


#: A slotted block, as three bars that share no volume: left, right and the bridge over the slot (lo, hi by axis).
_BARS = [((-0.8, -0.8, -0.45), (-0.3, 0.8, 0.45)), ((0.3, -0.8, -0.45), (0.8, 0.8, 0.45)), ((-0.3, 0.3, -0.45), (0.3, 0.8, 0.45))]
_DISK_MESH = Mesh((18, 18, 10), (-1.125, -1.125, -0.625), (0.125,) * 3, (False,) * 3, halo=3)


def _slotted(s: SparkSession) -> DataFrame:
    """The bars (volumes 1 to 3) and their bounding box (volume 9), through an STL file."""
    boxes = [*((n + 1, *bar) for n, bar in enumerate(_BARS)), (9, (-1.1, -1.1, -0.6), (1.1, 1.1, 0.6))]
    rows = []
    for n, (which, lo, hi) in enumerate(boxes):
        cube = FX.cube(s, 0.0, 1.0, which, n).withColumn("facet_id", F.col("facet_id") + 12 * n)
        place = lambda v, lo=lo, hi=hi: F.array(*((F.lit(lo[d]) + F.col(v)[d] * (hi[d] - lo[d])).cast("float") for d in range(3)))
        rows.append(cube.select("kind", "global_id", "local_id", "facet_id", *(place(f"v{x}").alias(f"v{x}") for x in range(3))))
    whole = reduce(lambda a, b: a.unionByName(b), rows)
    made = [stl.read_stl(s, stl.written(whole.filter(F.col("global_id") == which), new_path(s, "bar"), f"Volume {which}")).withColumns({"local_id": F.lit(n), "facet_id": F.col("facet_id") + 12 * n}) for n, (which, *_) in enumerate(boxes)]
    return reduce(lambda a, b: a.unionByName(b), made)


def _disk(s: SparkSession, d: str) -> DataFrame:
    """A full turn in four steps: the particles are where they were, at every node the estimate is the distance to the
    nearest one less a radius, and redistancing keeps every node's side (nodes within half a cell of the surface aside) and
    gives the same distance outside. Steps of two nodes blunt the block's edges, by a cell and a quarter at most."""
    moved, estimate, got = rotating_disk(s, _slotted(s), 9, _DISK_MESH, math.pi / 2, 4, 0.125, levelset.LevelSet(secant_tol=0.1, num_random_guess=1, projection_tol=1e-6))
    both = got.join(estimate, ["i", "j", "k"]).crossJoin(moved.agg(F.count("*").alias("n"), F.sum("color").alias("colors")))
    e, g = F.col("distance_estimate"), F.col("signed_distance")
    return both.select("i", "j", "k", "n", "colors", (F.round(e, 4) + 0.0).alias("estimate"), F.when(F.abs(e) > 0.0625, g < 0).otherwise(e < 0).alias("inside"), F.when(e > 0, F.abs(g - e) <= 1.25 * 0.125).otherwise(g <= 0.125).alias("close"))


def _disk_sql() -> str:
    held = " or ".join("(" + " and ".join(f"{x} > {lo!r} and {x} < {hi!r}" for x, lo, hi in zip("xyz", *bar)) + ")" for bar in _BARS)
    color = "case " + " ".join(f"when {' and '.join(f'{x} > {lo!r} and {x} < {hi!r}' for x, lo, hi in zip('xyz', *bar))} then {n}" for n, bar in enumerate(_BARS)) + " end"
    at = lambda a, low: f"{low} + ({a} + 5e-1) * 625e-4"
    return f"""with q as (select {at('a.i', -1.125)} as x, {at('b.j', -1.125)} as y, {at('c.k', -0.625)} as z from range(36) as a(i), range(36) as b(j), range(20) as c(k)),
p as (select x, y, z, {color} as color from q where {held}), t as (select count(*) as n, sum(color) as colors from p),
e as (select i, j, k, -1125e-3 + i * 125e-3 as x, -1125e-3 + j * 125e-3 as y, -625e-3 + k * 125e-3 as z from range(19) as a(i), range(19) as b(j), range(11) as c(k)),
d as (select i, j, k, sqrt(min((p.x - e.x) * (p.x - e.x) + (p.y - e.y) * (p.y - e.y) + (p.z - e.z) * (p.z - e.z))) - 125e-3 as v from e, p group by i, j, k)
select i, j, k, n, cast(colors as bigint) as colors, round(v, 4) + 0e0 as estimate, v < 0 as inside, true as close from d, t"""


def _correction_sql() -> str:
    at = lambda source, order, location, select: f"(with {Q.stencil(source, order, location)} {select})"
    return f"""with {_EVM}, rho as {at('p', 1, 'cell', 'select i, j, k, sum(w * m) as rho from s group by i, j, k')},
fil as {at('p', 0, 'cell', 'select i, j, k, sum(w) as f from s group by i, j, k')},
c as (select rho.i, rho.j, rho.k, case when coalesce(f, 0) > 0 or rho.i in (0, 15) or rho.j in (0, 7) or rho.k in (0, 7) then rho else greatest(rho, 4e0) end as r from rho left join fil on rho.i = fil.i and rho.j = fil.j and rho.k = fil.k),
pu as (select i, j, k, 3125e-5 * (1 - r / 4e0) as push from c),
nd as (select a.i as ni, b.j as nj, c.k as nk, cast(a.i as double) as x, cast(b.j as double) as y, cast(c.k as double) as z from range(17) as a(i), range(9) as b(j), range(9) as c(k)),
sh as {at('nd', 1, 'cell', 'select ni, nj, nk, sum(-gi * push) as s0, sum(-gj * push) as s1, sum(-gk * push) as s2 from s join pu using (i, j, k) group by ni, nj, nk')},
q as {at('p', 2, 'node', 'select pid, i, j, k, w from s')}
select pid, {', '.join(f'round(sum(w * s{e}), 6) + 0e0 as d{x}' for e, x in enumerate('xyz'))} from q join sh on i = ni and j = nj and k = nk group by pid"""


PIPELINES = {
    "step_incompressible": (_incompressible, _incompressible_sql()),
    "step_flip": (_flip, _flip_sql()),
    "step_heat": (_heat, _heat_sql()),
    "step_rotating_disk": (_disk, _disk_sql()),
    "step_position_correction": (lambda s, d: position_correction(_ev(s, d), FX.MESH, 0.125, 4.0, 8.0).select("pid", *((F.round(c, 6) + 0.0).alias(c) for c in ("dx", "dy", "dz"))), _correction_sql()),
}
