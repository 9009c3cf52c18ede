"""Registered queries of the particle and grid operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.functions import arrow_linalg as A
from meshquill.functions import linalg as LA
from meshquill.operators import fields as FD
from meshquill.operators import geometry as GEO
from meshquill.operators import levelset as LS
from meshquill.operators import mapping as MP
from meshquill.operators import mesh as ME
from meshquill.operators import particles as PA
from meshquill.operators import surface as SU
from meshquill.operators import transfer as T
from meshquill.plans import pipelines as PL
from meshquill.plans import sqlgen as Q
from meshquill.sources import fixtures as FX
from meshquill.sources import stl as STL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def rounded(df: DataFrame, digits: int | None = None, *keys: str) -> DataFrame:
    """Doubles rounded, minus zero made plain."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        e = F.col(c)
        if kinds[c] == "double" and c not in keys:
            e = (F.round(e, digits) if digits is not None else e) + F.lit(0.0)
        out.append(e.alias(c))
    return df.select(*out)


# Scatter and gather -----------------------------------------------------------

register("p2g_value_scalar", lambda s, d: rounded(T.p2g_value(FX.particles_li(s, d), FX.MESH, "node", 2, "m")), Q.p2g(2, "node", {"out": "w * m"}))
for _o in (0, 1, 3):
    register(f"p2g_value_scalar_o{_o}", lambda s, d, o=_o: rounded(T.p2g_value(FX.particles_li(s, d), FX.MESH, "cell" if o == 0 else "node", o, "m"), 6), Q.p2g(_o, "cell" if _o == 0 else "node", {"out": "w * m"}, 6))
register("p2g_value_vector", lambda s, d: rounded(T.p2g_value(FX.particles_li(s, d), FX.MESH, "node", 2, "vec", 3)), Q.p2g(2, "node", {f"out_{e}": f"w * {Q.vec(e)}" for e in range(3)}))
_G = ("gi", "gj", "gk")
register("p2g_gradient", lambda s, d: rounded(T.p2g_gradient(FX.particles_li(s, d), FX.MESH, "node", 2, "m")), Q.p2g(2, "node", {f"out_{e}": f"{_G[e]} * m" for e in range(3)}))
register("p2g_divergence_vector", lambda s, d: rounded(T.p2g_divergence(FX.particles_li(s, d), FX.MESH, "node", 2, "vec")), Q.p2g(2, "node", {"out": " + ".join(f"{_G[e]} * {Q.vec(e)}" for e in range(3))}))
register("p2g_divergence_tensor", lambda s, d: rounded(T.p2g_divergence(FX.particles_li(s, d), FX.MESH, "node", 2, "ten", tensor=True)), Q.p2g(2, "node", {f"out_{i}": " + ".join(f"{Q.ten(3 * i + j)} * {_G[j]}" for j in range(3)) for i in range(3)}))
register("p2g_cell_centred", lambda s, d: rounded(T.p2g_value(FX.particles_li(s, d), FX.MESH, "cell", 2, "m")), Q.p2g(2, "cell", {"out": "w * m"}))
register("halo_scatter_sum_periodic", lambda s, d: rounded(T.p2g_value(FX.particles_li(s, d), FX.PERIODIC, "node", 2, "m")), Q.p2g(2, "node", {"out": "w * m"}, periodic=True))

register("g2p_value_scalar", lambda s, d: rounded(T.g2p_value(FX.particles_ev(s, d), FX.MESH, "node", 2, FX.grid_field(s), "phi")), Q.g2p(2, "node", {"out": f"w * {Q.PHI}"}))
for _o in (0, 1, 3):
    register(f"g2p_value_scalar_o{_o}", lambda s, d, o=_o: rounded(T.g2p_value(FX.particles_ev(s, d), FX.MESH, "node", o, FX.grid_field(s), "phi"), 6), Q.g2p(_o, "node", {"out": f"w * {Q.PHI}"}, 6))
register("g2p_value_vector", lambda s, d: rounded(T.g2p_value(FX.particles_ev(s, d), FX.MESH, "node", 2, FX.grid_field(s), "u", 3)), Q.g2p(2, "node", {f"out_{e}": f"w * {Q.U[e]}" for e in range(3)}))
register("g2p_gradient_scalar", lambda s, d: rounded(T.g2p_gradient(FX.particles_ev(s, d), FX.MESH, "node", 2, FX.grid_field(s), "phi")), Q.g2p(2, "node", {f"out_{e}": f"{_G[e]} * {Q.PHI}" for e in range(3)}))
register("g2p_gradient_vector", lambda s, d: rounded(T.g2p_gradient(FX.particles_ev(s, d), FX.MESH, "node", 2, FX.grid_field(s), "u", 3)), Q.g2p(2, "node", {f"out_{a}{e}": f"{_G[e]} * {Q.U[a]}" for a in range(3) for e in range(3)}))
register("g2p_divergence", lambda s, d: rounded(T.g2p_divergence(FX.particles_ev(s, d), FX.MESH, "node", 2, FX.grid_field(s), "u")), Q.g2p(2, "node", {"out": " + ".join(f"{_G[e]} * {Q.U[e]}" for e in range(3))}))

# Affine and polynomial transfers ------------------------------------------------

_D = ("di", "dj", "dk")
_FACE = ("face_i", "face_j", "face_k")


def _mu(order: int, d: int) -> str:
    u = Q.state(0, d)
    if order == 1:
        return f"w * m * {u} + (" + " + ".join(f"{Q.state(1 + e, d)} * m * {_G[e]}" for e in range(3)) + ")"
    return f"w * m * ({u} + {T.inertial_scaling(order, 1.0)} * (" + " + ".join(f"{Q.state(1 + e, d)} * {_D[e]}" for e in range(3)) + "))"


for _o, _loc in ((1, "node"), (2, "cell"), (3, "node")):
    register(f"apic_p2g_o{_o}", lambda s, d, o=_o, loc=_loc: rounded(T.apic_p2g(FX.particles_li(s, d), FX.MESH, loc, o), 6), Q.p2g(_o, _loc, {f"mu_{d}": _mu(_o, d) for d in range(3)} | {"mass": "w * m"}, 6))
    register(
        f"apic_g2p_o{_o}",
        lambda s, d, o=_o, loc=_loc: rounded(PL.unpacked(T.apic_g2p(FX.particles_ev(s, d), FX.MESH, loc, o, FX.grid_field(s, location=loc)), "c", 12), 6),
        Q.g2p(_o, _loc, {f"c_{d}": f"w * {Q.U[d]}" for d in range(3)} | {f"c_{3 + 3 * e + d}": f"w * {Q.U[d]} * {_D[e]}" for e in range(3) for d in range(3)}, 6),
    )
for _d, _face in enumerate(_FACE):
    for _o in (1, 2, 3):
        _n = f"_o{_o}" if _o != 2 else ""
        register(f"apic_p2g_staggered_{'ijk'[_d]}{_n}", lambda s, d, o=_o, dim=_d: rounded(T.apic_p2g(FX.particles_li(s, d), FX.MESH, _FACE[dim], o, dim=dim), 6), Q.p2g(_o, _face, {"mu": _mu(_o, _d), "mass": "w * m"}, 6))
        register(
            f"apic_g2p_staggered_{'ijk'[_d]}{_n}",
            lambda s, d, o=_o, dim=_d: rounded(PL.unpacked(T.apic_g2p(FX.particles_ev(s, d), FX.MESH, _FACE[dim], o, FX.grid_field(s, location=_FACE[dim]), "phi", dim=dim), "c", 12), 6),
            Q.g2p(_o, _face, {f"c_{3 * r + e}": (f"w * {Q.PHI}" + (f" * {_D[r - 1]}" if r else "")) if e == _d else "0e0" for r in range(4) for e in range(3)}, 6),
        )

_DT = 0.03125
_ALONG = [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]


def _poly_p2g_sql(location: str, dims: list[int], one: bool) -> str:
    a = [[f"({1.0 if r == c else 0.0} + {_DT} * {Q.state(1 + r, c)})" for c in range(3)] for r in range(3)]
    m = [f"a{r}{c}" for r in range(3) for c in range(3)]
    cof = lambda r, c: "(" + " - ".join(f"a{x}{y} * a{z}{w}" for x, y, z, w in _minor(r, c)) + ")"
    det = f"(a00 * {cof(0, 0)} - a01 * {cof(0, 1)} + a02 * {cof(0, 2)})"
    inv = [[f"{'' if (r + c) % 2 == 0 else '-'}{cof(c, r)} / {det}" for c in range(3)] for r in range(3)]
    basis = ["1e0", "m0", "m1", "m2", "m0 * m1", "m0 * m2", "m1 * m2", "m0 * m1 * m2"]
    sums = ", ".join(f"round(sum(w * m * ({' + '.join(f'{Q.state(r, d)} * {basis[r]}' for r in range(8))})), 6) + 0e0 as {'mu' if one else f'mu_{d}'}" for d in dims)
    return f"""with {Q.LI}, {Q.stencil('li', 1, location)}, e as (select *, {', '.join(f'{a[r][c]} as a{r}{c}' for r in range(3) for c in range(3))} from s),
f as (select *, {', '.join(f'({inv[r][0]}) * di + ({inv[r][1]}) * dj + ({inv[r][2]}) * dk as m{r}' for r in range(3))} from e)
select i, j, k, {sums}, round(sum(w * m), 6) + 0e0 as mass from f group by i, j, k""" if m else ""


def _minor(r: int, c: int) -> list[tuple[int, int, int, int]]:
    (x, y), (z, w) = [n for n in range(3) if n != r], [n for n in range(3) if n != c]
    return [(x, z, y, w), (x, w, y, z)]


def _poly_sums(dims, at) -> dict[str, str]:
    return {f"c_{3 * r + d}": (" * ".join(f"{'g' if e in axes else 'w'}{e}" for e in range(3)) + f" * {at(d)}") if d in dims else "0e0" for r, axes in enumerate(_ALONG) for d in range(3)}


register("polypic_p2g", lambda s, d: rounded(T.polypic_p2g(FX.particles_li(s, d), FX.MESH, "node", _DT, state="c8"), 6), _poly_p2g_sql("node", [0, 1, 2], False))
register("polypic_g2p", lambda s, d: rounded(PL.unpacked(T.polypic_g2p(FX.particles_ev(s, d), FX.MESH, "node", FX.grid_field(s)), "c", 24), 6), Q.g2p(1, "node", _poly_sums(range(3), lambda d: Q.U[d]), 6))
register("polypic_p2g_staggered", lambda s, d: rounded(T.polypic_p2g(FX.particles_li(s, d), FX.MESH, "face_i", _DT, state="c8", dim=0), 6), _poly_p2g_sql("face_i", [0], True))
register("polypic_g2p_staggered", lambda s, d: rounded(PL.unpacked(T.polypic_g2p(FX.particles_ev(s, d), FX.MESH, "face_j", FX.grid_field(s, location="face_j"), "phi", dim=1), "c", 24), 6), Q.g2p(1, "face_j", _poly_sums([1], lambda d: Q.PHI), 6))

_MODES = [[f"cast((pid * {3 * r + e + 1}) % 7 - 3 as double)" for e in range(3)] for r in range(8)]


def _poly_kept(s: SparkSession, d: str) -> DataFrame:
    """Only the second column of the modes is set; the others stay what they were."""
    p = FX.particles_ev(s, d).withColumn("c8", F.array(*((F.col("pid") * (3 * r + e + 1) % 7 - 3).cast("double") for r in range(8) for e in range(3))))
    return rounded(PL.unpacked(T.polypic_g2p(p, FX.MESH, "face_j", FX.grid_field(s, location="face_j"), "phi", dim=1, state="c8"), "c", 24), 6)


register("polypic_g2p_kept", _poly_kept, Q.g2p(1, "face_j", {n: e for n, e in _poly_sums([1], lambda d: Q.PHI).items() if int(n[2:]) % 3 == 1}, 6).replace(" from s group by pid", ", " + ", ".join(f"any_value({_MODES[r][e]}) as c_{3 * r + e}" for r in range(8) for e in (0, 2)) + " from s group by pid"))

# Grid operators and fields --------------------------------------------------------

_FOO, _BAR = FD.Layout("node", FD.Field("foo", (3,))), FD.Layout("node", FD.Field("bar"))
_ENTITIES = "e as (select i, j, k from range({0}) as a(i), range({1}) as b(j), range({2}) as c(k))"


def _grid_op_zero(s: SparkSession, d: str) -> DataFrame:
    cat = FD.FieldCatalog(FX.MESH, s)
    op = FD.create_grid_operator(FX.MESH, scatter=[_BAR])
    op.setup(cat)
    op.apply_particles(cat, FX.particles_li(s, d).select("x", "y", "z", "m"), "node", 1, lambda p: {"bar": f"{p.w} * m"})
    return rounded(cat.array(_BAR))


def _grid_op_entities(s: SparkSession, d: str) -> DataFrame:
    cat = FD.FieldCatalog(FX.MESH, s)
    foo = FX.grid_field(s).select("i", "j", "k", F.col("u").alias("foo"))
    cat.add(_FOO, foo)
    op = FD.create_grid_operator(FX.MESH, gather=[_FOO], local=[_BAR])
    op.setup(cat)
    v = LA.Vector.of(F.col("foo"), 3)
    return rounded(op.apply_entities(cat, "node", lambda: {"bar": v.dot(v) + F.col("bar")}))


_OUT, _FOO2, _SUM2 = FD.Layout("node", FD.Field("out")), FD.Layout("node", FD.Field("foo2")), FD.Layout("node", FD.Field("sum2"))


def _grid_op_both(s: SparkSession, d: str) -> DataFrame:
    """One pass over particles that reads a field, adds to two others and sets a column of the particles."""
    cat = FD.FieldCatalog(FX.MESH, s)
    cat.add(_FOO, FX.grid_field(s).select("i", "j", "k", F.col("u").alias("foo")))
    op = FD.create_grid_operator(FX.MESH, gather=[_FOO], scatter=[_BAR, _OUT])
    op.setup(cat)
    p = FX.particles_ev(s, d).withColumn("m", (F.col("pid") % 7 + 1).cast("double"))
    got = op.apply_particles(cat, p, "node", 1, lambda q: {"bar": f"{q.w} * m", "out": f"{q.w} * m * ({q.read('foo', 0)} - {q.read('foo', 2)})", "speed": f"{q.w} * {q.read('foo', 1)}"})
    grid = cat.array(_BAR).join(cat.array(_OUT), ["i", "j", "k"]).select("i", "j", "k", "bar", "out", F.lit(0.0).alias("speed"))
    return rounded(grid.unionByName(got.select(F.col("pid").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(-1).cast("long").alias("k"), F.lit(0.0).alias("bar"), F.lit(0.0).alias("out"), "speed")))


def _grid_op_2d(s: SparkSession, d: str) -> DataFrame:
    """Two dimensions: a field of entities from another, by one of two bodies."""
    mesh = ME.Mesh((12, 7), (0.0, 0.0), (0.5, 0.5), (True, False))
    cat = FD.FieldCatalog(mesh, s)
    cat.add(_FOO2, mesh.entities(s).withColumn("foo2", (F.col("i") * 3 - F.col("j")).cast("double")))
    op = FD.create_grid_operator(mesh, gather=[_FOO2], scatter=[_SUM2])
    op.setup(cat)
    bodies = {"twice": lambda: {"sum2": F.col("foo2") * 2}, "square": lambda: {"sum2": F.col("foo2") * F.col("foo2")}}
    op.apply_entities(cat, "node", bodies["square"])
    return rounded(cat.array(_SUM2))


def _halo_gather(s: SparkSession, d: str) -> DataFrame:
    places = s.range(20 * 12 * 12).selectExpr("id % 20 - 2 as i", "id div 20 % 12 - 2 as j", "id div 240 - 2 as k")
    return rounded(FD.gather_copies(FX.PERIODIC, "node", FX.grid_field(s, FX.PERIODIC).select("i", "j", "k", "phi"), places))


register("grid_op_zero_fill", _grid_op_zero, f"with {Q.LI}, {Q.stencil('li', 1, 'node')}, g as (select i, j, k, sum(w * m) as bar from s group by i, j, k), {_ENTITIES.format(17, 9, 9)} select e.i, e.j, e.k, coalesce(bar, 0e0) as bar from e left join g on e.i = g.i and e.j = g.j and e.k = g.k")
register("grid_op_entities", _grid_op_entities, f"with {_ENTITIES.format(17, 9, 9)} select i, j, k, {' + '.join(f'{u} * {u}' for u in Q.U)} + 0e0 as bar from e")
register(
    "grid_op_gather_scatter",
    _grid_op_both,
    f"with {Q.EV}, p as (select *, cast(pid % 7 + 1 as double) as m from ev), {Q.stencil('p', 1, 'node')}, g as (select i, j, k, sum(w * m) as bar, sum(w * m * ({Q.U[0]} - {Q.U[2]})) as out from s group by i, j, k), {_ENTITIES.format(17, 9, 9)} select e.i, e.j, e.k, coalesce(bar, 0e0) as bar, coalesce(out, 0e0) as out, 0e0 as speed from e left join g on e.i = g.i and e.j = g.j and e.k = g.k union all select pid, -1, -1, 0e0, 0e0, sum(w * {Q.U[1]}) + 0e0 from s group by pid",
)
register("grid_op_2d", _grid_op_2d, "select i, j, cast((i * 3 - j) * (i * 3 - j) as double) as sum2 from range(12) as a(i), range(8) as b(j)")
register(
    "halo_gather_periodic",
    _halo_gather,
    f"with p as (select a.i as pi, b.j as pj, c.k as pk, ((a.i % 16) + 16) % 16 as i, ((b.j % 8) + 8) % 8 as j, ((c.k % 8) + 8) % 8 as k from (select unnest(range(-2, 18)) as i) as a, (select unnest(range(-2, 10)) as j) as b, (select unnest(range(-2, 10)) as k) as c) select pi as i, pj as j, pk as k, {Q.PHI} + 0e0 as phi from p",
)

# Meshes and mappings ----------------------------------------------------------------

_CONFIG = {"mesh": {"cell_size": 0.5, "periodic": [True, False, True], "partitioner": {"type": "uniform_dim"}, "halo_cell_width": 2}}
_ADAPT = {"mesh": {"cell_size": [0.5, 0.5, 0.5], "periodic": [True, False, True], "halo_cell_width": 2}}
_BOX = [-2.0, -1.5, 1.0, 3.0, 2.5, 4.0]
register("mesh_nodes_uniform", lambda s, d: ME.uniform_mesh(_CONFIG, _BOX, 2).nodes(s), f"with {_ENTITIES.format(10, 13, 6)} select i, j, k, -2e0 + i * 5e-1 as x, -25e-1 + j * 5e-1 as y, 1e0 + k * 5e-1 as z from e")
register("mesh_nodes_adaptive", lambda s, d: ME.adaptive_mesh(_ADAPT, _BOX, 2).nodes(s), f"with {_ENTITIES.format(10, 13, 6)} select i, j, k, i * 5e-1 as x, -2e0 + j * 5e-1 as y, k * 5e-1 as z from e")
register("mesh_blocks", lambda s, d: FX.MESH.partitioned(FX.MESH.entities(s, "cell"), (2, 2, 1)).groupBy("i").agg(F.count("*").alias("n")), "select i, cast(64 as bigint) as n from range(16) as r(i)")


def _uniform_roundtrip(s: SparkSession, d: str) -> DataFrame:
    m = MP.uniform_cartesian_mesh([0.0, 0.0, 0.0, 16.0, 8.0, 8.0], 0.5, (False,) * 3).mapping
    p = FX.particles_ev(s, d)
    ref, ok = m.reverse([F.col(c) for c in "xyz"])
    rows = p.select("pid", *(r.alias(f"r{n}") for n, r in enumerate(ref)), ok.alias("ok"))
    return rows.select("pid", "r0", "r1", "r2", "ok", *(x.alias(f"x{n}") for n, x in enumerate(m.forward([F.col(f"r{n}") for n in range(3)]))), F.lit(m.measure()).alias("det"))


register("map_uniform_roundtrip", _uniform_roundtrip, f"with {Q.EV} select pid, x * 2 as r0, y * 2 as r1, z * 2 as r2, true as ok, x as x0, y as x1, z as x2, 125e-3 as det from ev")


def _sheared(s: SparkSession, n: int = 3) -> MP.BilinearMapping:
    """Node coordinates on a mesh of 10 x 6 x 5 cells, bent by products of indices."""
    cells = (10, 6, 5)[:n]
    m = ME.Mesh(cells, (0.0,) * n, (1.0,) * n, (False,) * n)
    i, j, k = F.col("i"), F.col("j"), F.col("k") if n == 3 else F.lit(0)
    x = [i + 0.125 * j * 1.0 + 0.0625 * k, j + 0.0625 * i * j * 0.25, k + 0.125 * i][:n]
    return MP.BilinearMapping(cells, (False,) * n, m.entities(s).select(*m.axes, F.array(*(c.cast("double") for c in x)).alias("x")))


def _refs(s: SparkSession, d: str, n: int = 3) -> DataFrame:
    return FX.particles_ev(s, d).select("pid", *(F.col(c).alias(f"r{e}") for e, c in enumerate("xyz"[:n])))


def _bilinear_sql(n: int, outs: str) -> str:
    bits = ", ".join(f"(select unnest(range(0, 2)) as b{d}) as h{d}" for d in range(n))
    node = ["(i + 125e-3 * j + 625e-4 * k)", "(j + 15625e-6 * i * j)", "(k + 125e-3 * i)"]
    ijk = ", ".join(f"floor({c}) + b{d} as {a}" for d, (c, a) in enumerate(zip("xyz", "ijk"))) if n == 3 else "floor(x) + b0 as i, floor(y) + b1 as j, 0 as k"
    w = ", ".join(f"case b{d} when 1 then {c} - floor({c}) else 1e0 - ({c} - floor({c})) end as w{d}, case b{d} when 1 then 1e0 else -1e0 end as g{d}" for d, c in enumerate("xyz"[:n]))
    prod = lambda e=None: " * ".join(f"{'g' if d == e else 'w'}{d}" for d in range(n))
    if outs == "x":
        sums = ", ".join(f"round(sum({prod()} * {node[d]}), 9) + 0e0 as x{d}" for d in range(n))
        return f"with {Q.EV}, c as (select pid, {ijk}, {w} from ev, {bits}) select pid, {sums} from c group by pid"
    sums = ", ".join(f"sum({prod(e)} * {node[d]}) as j{d}{e}" for d in range(n) for e in range(n))
    det = "j00 * j11 - j01 * j10" if n == 2 else "j00 * (j11 * j22 - j12 * j21) - j01 * (j10 * j22 - j12 * j20) + j02 * (j10 * j21 - j11 * j20)"
    return f"with {Q.EV}, c as (select pid, {ijk}, {w} from ev, {bits}), m as (select pid, {sums} from c group by pid) select pid, {', '.join(f'round(j{d}{e}, 9) + 0e0 as j_{d * n + e}' for d in range(n) for e in range(n))}, round({det}, 9) + 0e0 as det from m"


for _n in (2, 3):
    _t = "" if _n == 3 else "_2d"
    register(f"map_bilinear_forward{_t}", lambda s, d, n=_n: rounded(_sheared(s, n).forward(_refs(s, d, n), "pid"), 9), _bilinear_sql(_n, "x"))
    register(f"map_bilinear_jacobian{_t}", lambda s, d, n=_n: rounded(PL.unpacked(_sheared(s, n).metrics(_refs(s, d, n), "pid").drop("inverse").withColumnRenamed("jacobian", "j"), "j", n * n), 9), _bilinear_sql(_n, "j"))


def _newton(s: SparkSession, d: str) -> DataFrame:
    m, ref = _sheared(s), _refs(s, d)
    start = m.forward(ref, "pid").join(ref, "pid").select("pid", "x0", "x1", "x2", *((F.floor(f"r{n}") + 0.5).alias(f"r{n}") for n in range(3)))
    return rounded(PL.unpacked(m.reverse(start, "pid").withColumnRenamed("ref", "r"), "r", 3), 6)


register("map_newton_reverse", _newton, f"with {Q.EV} select pid, true as ok, round(x, 6) as r_0, round(y, 6) as r_1, round(z, 6) as r_2 from ev")

# Particle creation --------------------------------------------------------------------

_SMALL = ME.Mesh((6, 5, 4), (0.0,) * 3, (0.25,) * 3, (True,) * 3)
register(
    "particles_uniform",
    lambda s, d: PA.particles_uniform(s, _SMALL, 2, F.col("x") > 0.5),
    "select (i + 6 * (j + 5 * k)) * 8 + a + 2 * (b + 2 * c) as pid, i * 25e-2 + (a + 5e-1) * 125e-3 as x, j * 25e-2 + (b + 5e-1) * 125e-3 as y, k * 25e-2 + (c + 5e-1) * 125e-3 as z, 1953125e-9 as volume from range(6) as r1(i), range(5) as r2(j), range(4) as r3(k), range(2) as r4(a), range(2) as r5(b), range(2) as r6(c) where i * 25e-2 + (a + 5e-1) * 125e-3 > 5e-1",
)


def _random(s: SparkSession, d: str) -> DataFrame:
    p = PA.particles_random(s, _SMALL, 10, seed=4).withColumn("cell", F.expr("pid div 10"))
    i, j, k = F.expr("cell % 6"), F.expr("cell div 6 % 5"), F.expr("cell div 30")
    ok = (F.col("x") >= i * 0.25) & (F.col("x") < (i + 1) * 0.25) & (F.col("y") >= j * 0.25) & (F.col("y") < (j + 1) * 0.25) & (F.col("z") >= k * 0.25) & (F.col("z") < (k + 1) * 0.25)
    return p.groupBy("cell").agg(F.count("*").alias("n"), F.bool_and(ok).alias("inside"), F.round(F.sum("volume"), 9).alias("volume"))


register("particles_random", _random, "select i as cell, cast(10 as bigint) as n, true as inside, round(15625e-6, 9) as volume from range(120) as r(i)")


def _surface_particles(s: SparkSession, d: str) -> DataFrame:
    p = PA.particles_surface(FX.cube(s), 20, seed=1)
    on = F.lit(False)
    for c in "xyz":
        on = on | (F.abs(F.col(c) - 1) < 1e-9) | (F.abs(F.col(c) - 3) < 1e-9)
    return p.groupBy("facet_id").agg(F.count("*").alias("n"), F.round(F.sum("area"), 9).alias("area"), F.bool_and(on).alias("on_facet"), F.round(F.max(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)), 9).alias("unit"))


register("particles_surface", _surface_particles, "select i as facet_id, cast(20 as bigint) as n, 2e0 as area, true as on_facet, 1e0 as unit from range(12) as r(i)")
register("particles_append", lambda s, d: PA.append(PA.particles_uniform(s, _SMALL, 1), PA.particles_uniform(s, _SMALL, 1)).groupBy("pid").agg(F.count("*").alias("n")), "select i as pid, cast(2 as bigint) as n from range(120) as r(i)")

# Small dense algebra: the spec of each is (name, Spark value, SQL value) --------------------



def _e(n: int) -> str:
    return f"e[{n + 1}]"


_MATS = "t as (select vec_id, list_transform(embedding, lambda v: floor(cast(v as double) * 256) / 4e0) as e from embeddings)"


def algebra(name: str, value: Callable[[], LA._Values | list[Column]], sql: list[str]) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        v = value()
        v = v.v if hasattr(v, "v") else v
        return rounded(FX.matrices(s, d).select("vec_id", *(c.alias(f"r_{n}") for n, c in enumerate(v))), 6)

    register(name, query, f"with {_MATS} select vec_id, {', '.join(f'round({x}, 6) + 0e0 as r_{n}' for n, x in enumerate(sql))} from t")


def _m(n: int, m: int, at: int = 0) -> LA.Matrix:
    return LA.Matrix.of(F.col("e"), n, m, at)


def _v(n: int, at: int) -> LA.Vector:
    return LA.Vector.of(F.col("e"), n, at)


def _q(at: int) -> LA.Quaternion:
    return LA.Quaternion.of(F.col("e"), at)


def _x(r: int, c: int, at: int = 0, m: int = 3) -> str:
    return _e(at + r * m + c)


_R3 = range(3)
_det3 = f"({_x(0, 0)} * ({_x(1, 1)} * {_x(2, 2)} - {_x(1, 2)} * {_x(2, 1)}) - {_x(0, 1)} * ({_x(1, 0)} * {_x(2, 2)} - {_x(1, 2)} * {_x(2, 0)}) + {_x(0, 2)} * ({_x(1, 0)} * {_x(2, 1)} - {_x(1, 1)} * {_x(2, 0)}))"
_det2 = f"({_e(0)} * {_e(3)} - {_e(1)} * {_e(2)})"


def _cof3(r: int, c: int) -> str:
    (a, b), (p, q) = [n for n in _R3 if n != r], [n for n in _R3 if n != c]
    return f"{'' if (r + c) % 2 == 0 else '-'}({_x(a, p)} * {_x(b, q)} - {_x(a, q)} * {_x(b, p)})"


def _qmul(a: list[str], b: list[str]) -> list[str]:
    w, x, y, z = a
    p, q, r, s = b
    return [f"({w} * {p} - {x} * {q} - {y} * {r} - {z} * {s})", f"({w} * {q} + {x} * {p} + {y} * {s} - {z} * {r})", f"({w} * {r} - {x} * {s} + {y} * {p} + {z} * {q})", f"({w} * {s} + {x} * {r} - {y} * {q} + {z} * {p})"]


_qa, _qb = [_e(n) for n in range(4)], [_e(n) for n in range(4, 8)]
_qc = [_qb[0], *(f"(-{x})" for x in _qb[1:])]
_qn = "(" + " + ".join(f"{x} * {x}" for x in _qb) + ")"
algebra("la_copy", lambda: LA.copy(_m(3, 3)), [_e(n) for n in range(9)])
algebra("la_transpose", lambda: ~_m(3, 3), [_x(c, r) for r in _R3 for c in _R3])
algebra("la_add_sub", lambda: [*(_m(3, 3) + _m(3, 3, 9)).v, *(_v(3, 0) - _v(3, 3)).v], [f"{_e(n)} + {_e(n + 9)}" for n in range(9)] + [f"{_e(n)} - {_e(n + 3)}" for n in _R3])
algebra("la_matmul", lambda: _m(3, 3) * _m(3, 3, 9), [" + ".join(f"{_x(r, s)} * {_x(s, c, 9)}" for s in _R3) for r in _R3 for c in _R3])
algebra("la_matvec", lambda: _m(3, 3) * _v(3, 9), [" + ".join(f"{_x(r, s)} * {_e(9 + s)}" for s in _R3) for r in _R3])
algebra("la_outer_dot", lambda: [*(_v(3, 0) * ~_v(3, 3)).v, *(~_v(3, 0) * _v(3, 3)).v], [f"{_e(r)} * {_e(3 + c)}" for r in _R3 for c in _R3] + [" + ".join(f"{_e(n)} * {_e(n + 3)}" for n in _R3)])
algebra("la_cross", lambda: _v(3, 0) % _v(3, 3), [f"{_e((n + 1) % 3)} * {_e(3 + (n + 2) % 3)} - {_e((n + 2) % 3)} * {_e(3 + (n + 1) % 3)}" for n in _R3])
algebra("la_elementwise", lambda: [*(_v(3, 0) & _v(3, 3)).v, *(_v(3, 0) | LA.Vector([F.abs(c) + 1.0 for c in _v(3, 3).v])).v], [f"{_e(n)} * {_e(n + 3)}" for n in _R3] + [f"{_e(n)} / (abs({_e(n + 3)}) + 1)" for n in _R3])
algebra("la_scale", lambda: [*(2.5 * _m(3, 3)).v, *(_m(3, 3) / 8.0).v], [f"25e-1 * {_e(n)}" for n in range(9)] + [f"{_e(n)} * 125e-3" for n in range(9)])
algebra("la_det2", lambda: [LA.determinant(_m(2, 2))], [_det2])
algebra("la_det3", lambda: [LA.determinant(_m(3, 3))], [_det3])
#: Well conditioned: the matrix with 400 added on its diagonal.
_shift = lambda n: _m(n, n) + LA.diagonal(LA.Vector([400.0] * n))


def _shifted(sql: str, n: int) -> str:
    for d in range(n):
        sql = sql.replace(f"e[{d * n + d + 1}]", f"(400e0 + E[{d * n + d + 1}])")
    return sql.replace("E[", "e[")


algebra("la_inverse2", lambda: 10000.0 * LA.inverse(_shift(2)), [_shifted(f"1e4 * {x} / {_det2}", 2) for x in (_e(3), f"-{_e(1)}", f"-{_e(2)}", _e(0))])
algebra("la_inverse3", lambda: 10000.0 * LA.inverse(_shift(3)), [_shifted(f"1e4 * ({_cof3(c, r)}) / {_det3}", 3) for r in _R3 for c in _R3])
algebra("la_solve2", lambda: _shift(2) ^ _v(2, 10), [_shifted(f"({_e(3)} * {_e(10)} - {_e(1)} * {_e(11)}) / {_det2}", 2), _shifted(f"(-{_e(2)} * {_e(10)} + {_e(0)} * {_e(11)}) / {_det2}", 2)])
algebra("la_solve3", lambda: _shift(3) ^ _v(3, 10), [_shifted("(" + " + ".join(f"({_cof3(c, r)}) * {_e(10 + c)}" for c in _R3) + f") / {_det3}", 3) for r in _R3])
algebra("la_trace", lambda: [LA.trace(_m(3, 3))], [f"{_e(0)} + {_e(4)} + {_e(8)}"])
algebra("la_identity", lambda: _m(3, 3) * LA.identity(3), [_e(n) for n in range(9)])
algebra("la_diag", lambda: LA.diagonal(_v(3, 0)), [_e(r) if r == c else "0e0" for r in _R3 for c in _R3])
algebra("la_permutation", lambda: LA.contract(LA.permutation(), _v(3, 0), 0), ["0e0", f"-{_e(2)}", _e(1), _e(2), "0e0", f"-{_e(0)}", f"-{_e(1)}", _e(0), "0e0"])
for _k in range(3):
    _at = lambda i, j, s, k=_k: [(s, i, j), (i, s, j), (i, j, s)][k]
    algebra(f"la_contract3_{_k}", lambda k=_k: LA.contract(LA.Tensor.of(F.col("e"), (3, 3, 3)), _v(3, 30), k), [" + ".join(f"{_e(_at(i, j, s)[0] * 9 + _at(i, j, s)[1] * 3 + _at(i, j, s)[2])} * {_e(30 + s)}" for s in _R3) for i in _R3 for j in _R3])
algebra("la_contract4", lambda: LA.contract(LA.Tensor.of(F.col("e"), (2, 2, 2, 2)), _m(2, 2, 20)), [" + ".join(f"{_e(i * 8 + j * 4 + k * 2 + m)} * {_e(20 + k * 2 + m)}" for k in range(2) for m in range(2)) for i in range(2) for j in range(2)])
algebra("la_slices", lambda: [*_m(3, 3).row(1).v, *_m(3, 3).col(2).v, *LA.Tensor.of(F.col("e"), (3, 3, 3)).matrix(2).v, *LA.Tensor.of(F.col("e"), (2, 2, 2, 2)).tensor3(1).v], [_x(1, c) for c in _R3] + [_x(r, 2) for r in _R3] + [_e(18 + n) for n in range(9)] + [_e(8 + n) for n in range(8)])
algebra("la_normalize", lambda: _v(3, 0).normalized(), [f"{_e(n)} / sqrt({' + '.join(f'{_e(m)} * {_e(m)}' for m in _R3)})" for n in _R3])
algebra("la_expression", lambda: 0.5 * (_m(3, 3) + ~_m(3, 3)) * _m(3, 3, 9), [" + ".join(f"5e-1 * ({_x(r, s)} + {_x(s, r)}) * {_x(s, c, 9)}" for s in _R3) for r in _R3 for c in _R3])
algebra("quat_add_sub", lambda: [*(_q(0) + _q(4)).v, *(_q(0) - _q(4)).v], [f"{a} + {b}" for a, b in zip(_qa, _qb)] + [f"{a} - {b}" for a, b in zip(_qa, _qb)])
algebra("quat_mul", lambda: _q(0) & _q(4), _qmul(_qa, _qb))
algebra("quat_div", lambda: _q(0) | _q(4), [f"{x} / {_qn}" for x in _qmul(_qa, _qc)])
algebra("quat_conj", lambda: ~_q(0), [_qa[0], *(f"-{x}" for x in _qa[1:])])
algebra("quat_parts", lambda: [_q(0).scalar(), *LA.Quaternion.join(_q(0).scalar(), _q(4).vector()).v], [_qa[0], _qa[0], *_qb[1:]])
_w, _qx, _qy, _qz = _qb
_s2 = f"(2e0 / {_qn})"
algebra("quat_to_matrix", lambda: _q(4).to_matrix(), [
    f"1 - {_s2} * ({_qy} * {_qy} + {_qz} * {_qz})", f"{_s2} * ({_qx} * {_qy} - {_w} * {_qz})", f"{_s2} * ({_qx} * {_qz} + {_w} * {_qy})",
    f"{_s2} * ({_qx} * {_qy} + {_w} * {_qz})", f"1 - {_s2} * ({_qx} * {_qx} + {_qz} * {_qz})", f"{_s2} * ({_qy} * {_qz} - {_w} * {_qx})",
    f"{_s2} * ({_qx} * {_qz} - {_w} * {_qy})", f"{_s2} * ({_qy} * {_qz} + {_w} * {_qx})", f"1 - {_s2} * ({_qx} * {_qx} + {_qy} * {_qy})",
])
algebra("quat_rotate_rows", lambda: _m(3, 3, 8) & _q(4), [x for r in _R3 for x in _qmul(_qmul(_qb, ["0e0", *(_x(r, c, 8) for c in _R3)]), _qc)[1:]])


def _residuals(name: str, value: Callable[[DataFrame], DataFrame], sql: str) -> None:
    register(name, lambda s, d: rounded(value(FX.matrices(s, d)), 6), f"with {_MATS} select vec_id, {sql} from t")


def _conditioned(n: int) -> Column:
    """The first n * n components with 4 n * n added on the diagonal."""
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.col("e")[i] + F.when(i % (n + 1) == 0, 4.0 * n * n).otherwise(0.0))


def _solve_residual(t: DataFrame) -> DataFrame:
    n = 4
    t = t.select("vec_id", _conditioned(n).alias("a"), F.slice("e", 41, n).alias("b"))
    t = t.withColumn("x", A.solve(F.col("a"), F.col("b"), n)).withColumn("inv", A.inverse(F.col("a"), n))
    a, x = LA.Matrix.of(F.col("a"), n, n), LA.Vector.of(F.col("x"), n)
    back = a * LA.Matrix.of(F.col("inv"), n, n) - LA.identity(n)
    return t.select("vec_id", LA.total([F.abs(c) for c in (a * x - LA.Vector.of(F.col("b"), n)).v]).alias("residual"), LA.total([F.abs(c) for c in back.v]).alias("inverse_residual"))


def _lu_product(t: DataFrame) -> DataFrame:
    n = 4
    t = t.select("vec_id", A.lu(_conditioned(n), n).alias("f"))
    f = LA.Matrix.of(F.col("f"), n, n)
    lower = LA.Matrix([[f[r, c] if c < r else (1.0 if c == r else 0.0) for c in range(n)] for r in range(n)])
    upper = LA.Matrix([[f[r, c] if c >= r else 0.0 for c in range(n)] for r in range(n)])
    return t.select("vec_id", *(c.alias(f"a_{i}") for i, c in enumerate((lower * upper).v)))


def _svd_invariants(t: DataFrame) -> DataFrame:
    t = t.select("vec_id", F.slice("e", 1, 9).alias("a")).withColumn("s", A.svd(F.col("a")))
    u, v = LA.Matrix.of(F.col("s.u"), 3, 3), LA.Matrix.of(F.col("s.v"), 3, 3)
    d = F.col("s.d")
    back = u * LA.diagonal(LA.Vector.of(d, 3)) * ~v
    return t.select("vec_id", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("norm2"), (d[0] * d[1] * d[2]).alias("det"), LA.determinant(u).alias("det_u"), LA.determinant(v).alias("det_v"), LA.total([F.abs(x) for x in (back - LA.Matrix.of(F.col("a"), 3, 3)).v]).alias("residual"))


_residuals("la_solve_n", _solve_residual, "0e0 as residual, 0e0 as inverse_residual")
_residuals("la_lu", _lu_product, ", ".join(f"round({_e(n)} + {64 if n % 5 == 0 else 0}, 6) + 0e0 as a_{n}" for n in range(16)))
_residuals("la_svd", _svd_invariants, f"round({' + '.join(f'{_e(n)} * {_e(n)}' for n in range(9))}, 6) + 0e0 as norm2, round({_det3}, 6) + 0e0 as det, 1e0 as det_u, 1e0 as det_v, 0e0 as residual")


def _exp_turn(t: DataFrame) -> DataFrame:
    """Of a stretched turn about the third axis: entries 0 and 4 alike, 1 and 3 opposite, 8 by itself."""
    at = {0: F.col("e")[0] / 64, 1: -F.col("e")[1] / 16, 3: F.col("e")[1] / 16, 4: F.col("e")[0] / 64, 8: F.col("e")[2] / 64}
    t = t.select("vec_id", F.array(*(at.get(n, F.lit(0.0)) for n in range(9))).alias("a")).withColumn("x", A.exponential(F.col("a"), 3))
    return t.select("vec_id", *(F.col("x")[n].alias(f"r_{n}") for n in range(9)))


_TURN = {0: f"exp({_e(0)} / 64) * cos({_e(1)} / 16)", 1: f"-exp({_e(0)} / 64) * sin({_e(1)} / 16)", 3: f"exp({_e(0)} / 64) * sin({_e(1)} / 16)", 4: f"exp({_e(0)} / 64) * cos({_e(1)} / 16)", 8: f"exp({_e(2)} / 64)"}
_residuals("la_exp", _exp_turn, ", ".join(f"round({_TURN.get(n, '0e0')}, 6) + 0e0 as r_{n}" for n in range(9)))

# Facet geometry --------------------------------------------------------------------------


def _facets(s: SparkSession) -> DataFrame:
    """Volume 1: a box (1, 3); volume 2: a box (4, 5); volume 9: their bounding box (0, 9)."""
    return FX.cube(s, 1.0, 3.0, 1, 0).unionByName(FX.cube(s, 4.0, 5.0, 2, 1).withColumn("facet_id", F.col("facet_id") + 12)).unionByName(FX.cube(s, 0.0, 9.0, 9, 2).withColumn("facet_id", F.col("facet_id") + 24))


def _shifted_points(s: SparkSession, d: str) -> DataFrame:
    """Off every facet's plane, and some outside the bounding box."""
    return FX.particles_ev(s, d).select("pid", (F.col("x") + 0.03125 - 0.5).alias("x"), (F.col("y") + 0.03125).alias("y"), (F.col("z") + 0.03125).alias("z"))


_BOXES = "b(global_id, local_id, lo, hi) as (values (1, 0, 1e0, 3e0), (2, 1, 4e0, 5e0), (9, 2, 0e0, 9e0))"
_PTS = f"{Q.EV}, p as (select pid, x + 3125e-5 - 5e-1 as x, y + 3125e-5 as y, z + 3125e-5 as z from ev)"
register("volume_boxes", lambda s, d: GEO.volume_boxes(_facets(s)).select("local_id", "global_id", *(F.col(f"{a}{n}").cast("double").alias(f"{a}{n}") for n in range(3) for a in ("lo", "hi"))), f"with {_BOXES} select local_id, global_id, {', '.join(f'lo as lo{n}, hi as hi{n}' for n in range(3))} from b")
_VERTICES = [f"v{n}[{d}]" for n in range(3) for d in range(3)]
register(
    "stl_facets",
    lambda s, d: PL.stl_roundtrip(_facets(s)).select("kind", "global_id", "local_id", "facet_id", *(F.expr(v).cast("double").alias(f"v{n // 3}_{n % 3}") for n, v in enumerate(_VERTICES))),
    "select * from (values " + ", ".join(f"('surface', 1, 0, {n}::bigint, {', '.join(f'{float(x)}e0' for v in f for x in v)})" for n, f in enumerate(FX.cube_corners(1, 3) + FX.cube_corners(4, 5) + FX.cube_corners(0, 9))) + ") as v(kind, global_id, local_id, facet_id, " + ", ".join(f"v{n // 3}_{n % 3}" for n in range(9)) + ")",
)
register("stl_offsets", lambda s, d: STL.offsets(_facets(s)), "select 'volume' as kind, i as local_id, cast(12 as bigint) as n, cast(12 * (i + 1) as bigint) as offset from range(3) as r(i)")
register(
    "surface_accessors",
    lambda s, d: GEO.surface_facets(PL.stl_roundtrip(_facets(s), 1, 2), 0).agg(F.count("*").alias("n"), F.min("global_id").alias("global_id"), F.min(F.col("v0")[0]).cast("double").alias("least"), F.max(F.col("v1")[1]).cast("double").alias("most")),
    "select cast(24 as bigint) as n, 1 as global_id, 1e0 as least, 5e0 as most",
)
register("facet_normals", lambda s, d: _facets(s).select("facet_id", *(F.abs(F.col("normal")[n]).cast("double").alias(f"n{n}") for n in range(3))), "select i as facet_id, case when i % 12 // 4 = 0 then 0e0 when i % 12 // 4 = 1 then 0e0 else 1e0 end as n0, case when i % 12 // 4 = 1 then 1e0 else 0e0 end as n1, case when i % 12 // 4 = 0 then 1e0 else 0e0 end as n2 from range(36) as r(i)")


def _plane(s: SparkSession, d: str) -> DataFrame:
    return rounded(_shifted_points(s, d).join(F.broadcast(FX.cube(s))).groupBy("pid").agg(F.sum(F.abs(GEO.plane_distance([F.col(c) for c in "xyz"])).cast("double")).alias("total"), F.min(GEO.plane_distance([F.col(c) for c in "xyz"]).cast("double")).alias("least")), 4)


register("facet_plane_distance", _plane, f"with {_PTS} select pid, round(2 * ({' + '.join(f'abs({c} - 1) + abs({c} - 3)' for c in 'xyz')}), 4) + 0e0 as total, round(least({', '.join(f'1 - {c}, {c} - 3' for c in 'xyz')}), 4) + 0e0 as least from p")


def _ray(s: SparkSession, d: str) -> DataFrame:
    up = GEO.ray_hits([F.col(c) for c in "xyz"], [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    p = FX.particles_ev(s, d).select("pid", (F.col("x") + 0.015625).alias("x"), (F.col("y") + 0.03125).alias("y"), (F.col("z") + 0.03125).alias("z"))
    return p.join(F.broadcast(FX.cube(s).select("v0", "v1", "v2"))).groupBy("pid").agg(F.sum(up.cast("int")).alias("hits"))


register("ray_facet", _ray, f"with {Q.EV}, p as (select pid, x + 15625e-6 as x, y + 3125e-5 as y, z + 3125e-5 as z from ev) select pid, cast(case when x > 1 and x < 3 and y > 1 and y < 3 then case when z < 1 then 2 when z < 3 then 1 else 0 end else 0 end as bigint) as hits from p")
register("point_in_volume", lambda s, d: GEO.point_in_volume(_shifted_points(s, d), _facets(s)), f"with {_PTS}, {_BOXES} select pid, local_id, true as inside from p, b where x between lo and hi and y between lo and hi and z between lo and hi")
register("locate_point", lambda s, d: GEO.locate(_shifted_points(s, d), _facets(s), 9), f"with {_PTS}, {_BOXES} select pid, cast(case when not (x between 0 and 9 and y between 0 and 9 and z between 0 and 9) then -2 else coalesce((select min(local_id) from b where global_id <> 9 and x between lo and hi and y between lo and hi and z between lo and hi), -1) end as integer) as volume_id from p")
register("facet_accessors", lambda s, d: GEO.volume_facets(_facets(s), 1).groupBy("global_id").agg(F.count("*").alias("n")), "select 2 as global_id, 12::bigint as n")

# Level sets and surfaces ---------------------------------------------------------------------

register("color_filter", lambda s, d: LS.of_color(FX.particles_ev(s, d).withColumn("color", (F.col("pid") % 3).cast("int")), 1), f"with {Q.EV} select pid, x, y, z, cast(1 as integer) as color from ev where pid % 3 = 1")


def _nearest(s: SparkSession, d: str) -> DataFrame:
    return rounded(LS.estimate_distance(FX.particles_ev(s, d), FX.MESH, "node", 0.5), 3)


register("nearest_distance", _nearest, f"with {Q.EV}, f as (select distinct x, y, z from ev), {_ENTITIES.format(17, 9, 9)} select i, j, k, round(cast(cast(min(sqrt(cast((x - i) * (x - i) + (y - j) * (y - j) + (z - k) * (z - k) as float))) as float) - cast(5e-1 as float) as double), 3) + 0e0 as distance_estimate from e, f group by i, j, k")
_CUBE = ME.Mesh((16,) * 3, (0.0,) * 3, (0.0625,) * 3, (True,) * 3, halo=4)


def _sphere(s: SparkSession, scale: float = 1.0) -> DataFrame:
    x = _CUBE.coordinates()
    return _CUBE.entities(s).withColumn("phi", (F.sqrt((x[0] - 0.5) * (x[0] - 0.5) + (x[1] - 0.5) * (x[1] - 0.5) + (x[2] - 0.5) * (x[2] - 0.5)) - 0.25) * scale)


_PHI48 = "(sqrt((i / 16e0 - 5e-1) * (i / 16e0 - 5e-1) + (j / 16e0 - 5e-1) * (j / 16e0 - 5e-1) + (k / 16e0 - 5e-1) * (k / 16e0 - 5e-1)) - 25e-2)"


_FINE = ME.Mesh((48,) * 3, (0.0,) * 3, (1 / 48,) * 3, (True,) * 3, halo=4)


def _ball(s: SparkSession, mesh: ME.Mesh, radius: float = 0.25) -> DataFrame:
    x = mesh.coordinates()
    return mesh.entities(s).withColumn("phi", F.sqrt((x[0] - 0.5) * (x[0] - 0.5) + (x[1] - 0.5) * (x[1] - 0.5) + (x[2] - 0.5) * (x[2] - 0.5)) - radius)


def _redistanced(s: SparkSession, d: str) -> DataFrame:
    """A sphere's distance from twice that distance on 48 cubed cells, with 5 random starts: every node of the mesh, near and
    far, within six tenths of a cell, and on its side."""
    p = LS.LevelSet(secant_tol=0.1, num_random_guess=5, projection_tol=1e-6)
    exact = _ball(s, _FINE)
    got = LS.redistance(exact.withColumn("phi", F.col("phi") * 2), _FINE, p).join(exact, ["i", "j", "k"])
    sign = F.when(F.abs("phi") > 0.5 / 48, F.signum("signed_distance") == F.signum("phi")).otherwise(F.lit(True))
    return got.select("i", "j", "k", (F.abs(F.col("signed_distance") - F.col("phi")) <= 0.6 / 48).alias("near"), sign.alias("sign"), (F.round("phi", 9) + 0.0).alias("phi"))


register("levelset_redistance", _redistanced, f"with {_ENTITIES.format(48, 48, 48)} select i, j, k, true as near, true as sign, round(sqrt((i / 48e0 - 5e-1) * (i / 48e0 - 5e-1) + (j / 48e0 - 5e-1) * (j / 48e0 - 5e-1) + (k / 48e0 - 5e-1) * (k / 48e0 - 5e-1)) - 25e-2, 9) + 0e0 as phi from e")


def _plane_distance(s: SparkSession, d: str) -> DataFrame:
    """Three times a plane's distance, on small tiles: the distance itself, to the last digit shown, at every node."""
    mesh = ME.Mesh((20, 9, 7), (0.0,) * 3, (0.25,) * 3, (False,) * 3, halo=3)
    rows = mesh.entities(s).withColumn("phi", (F.col("i") * 0.25 - 2.1) * 3)
    return rounded(LS.redistance(rows, mesh, LS.LevelSet(secant_tol=1e-6, num_random_guess=2, projection_tol=1e-8), tile=4), 6)


register("levelset_plane", _plane_distance, f"with {_ENTITIES.format(21, 10, 8)} select i, j, k, round(i * 25e-2 - 21e-1, 6) + 0e0 as signed_distance from e")


def _surface_distance(s: SparkSession, d: str) -> DataFrame:
    """The distance of every node to the places where grid lines cross a sphere, round the edges of a periodic mesh."""
    points = LS.crossings(_ball(s, _CUBE, 0.27), _CUBE, "phi")
    nodes = _CUBE.entities(s).select("i", "j", "k", *(F.col(a).cast("double").alias(f"e{n}") for n, a in enumerate("ijk")))
    return rounded(LS.nearest(points, nodes, ["i", "j", "k"], (0.0,) * 3, 1.0), 6)


_CROSS = "b as (select i, j, k, sqrt((i / 16e0 - 5e-1) * (i / 16e0 - 5e-1) + (j / 16e0 - 5e-1) * (j / 16e0 - 5e-1) + (k / 16e0 - 5e-1) * (k / 16e0 - 5e-1)) - 27e-2 as phi from e), x as (" + " union all ".join(
    f"select {', '.join(f'a.{a} + ' + ('a.phi / (a.phi - c.phi)' if n == d else '0e0') + f' as {a}' for n, a in enumerate('ijk'))} from b as a join b as c on {' and '.join(f'c.{a} = ' + (f'(a.{a} + 1) % 16' if n == d else f'a.{a}') for n, a in enumerate('ijk'))} where a.phi * c.phi < 0"
    for d in range(3)
) + ")"
register(
    "levelset_surface_distance",
    _surface_distance,
    f"with {_ENTITIES.format(16, 16, 16)}, {_CROSS}, t as (select e.i, e.j, e.k, min({' + '.join(f'least(abs(x.{a} - e.{a}), 16 - abs(x.{a} - e.{a})) ** 2' for a in 'ijk')}) as q from e, x group by e.i, e.j, e.k) select i, j, k, round(sqrt(q), 6) + 0e0 as near from t",
)


def _closed(s: SparkSession, d: str) -> DataFrame:
    """Marching cubes of a sphere: distinct vertices, facets, and facet edges that two facets share, the other way round."""
    facets = SU.marching_cubes(_ball(s, _CUBE, 0.27), _CUBE)
    name = lambda n: F.concat_ws(",", *(F.round(F.col(f"v{n}")[e], 9).cast("string") for e in range(3)))
    named = facets.select(*(name(n).alias(f"n{n}") for n in range(3)))
    corners = named.select(F.explode(F.array("n0", "n1", "n2")).alias("v")).agg(F.countDistinct("v").alias("vertices"))
    edges = named.select(F.explode(F.array(*(F.struct(F.col(f"n{n}").alias("a"), F.col(f"n{(n + 1) % 3}").alias("b")) for n in range(3)))).alias("e")).select("e.a", "e.b")
    pairs = edges.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("turns"))
    shared = pairs.agg(F.sum(F.when((F.col("n") == 2) & (F.col("turns") == 0), 1).otherwise(0)).alias("shared"), F.count("*").alias("edges"))
    return corners.crossJoin(facets.agg(F.count("*").alias("facets"))).crossJoin(shared)


# a closed surface without handles: a vertex per crossed grid line, V - E + F = 2, three edges a facet, two facets an edge
register("mc_closed_surface", _closed, f"with {_ENTITIES.format(16, 16, 16)}, {_CROSS}, v as (select count(*) as n from x) select n as vertices, 2 * n - 4 as facets, 3 * n - 6 as shared, 3 * n - 6 as edges from v")
_EVEN = "(i * i + 2 * j * j - k * i)"


def _interpolated(s: SparkSession, d: str) -> DataFrame:
    i, j, k = (F.col(c) for c in "ijk")
    even = _CUBE.entities(s).filter("i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0").withColumn("out", (i * i + 2 * j * j - k * i).cast("double"))
    return rounded(LS.interpolate_odd(even, _CUBE))


register(
    "levelset_interpolate",
    _interpolated,
    f"with e as (select i, j, k, {_EVEN} as v from range(0, 16, 2) as a(i), range(0, 16, 2) as b(j), range(0, 16, 2) as c(k)), n as (select (i + di + 16) % 16 as i, (j + dj + 16) % 16 as j, (k + dk + 16) % 16 as k, v from e, (select unnest(range(-1, 2)) as di) as x, (select unnest(range(-1, 2)) as dj) as y, (select unnest(range(-1, 2)) as dk) as z) select i, j, k, avg(v) + 0e0 as out from n group by i, j, k",
)
_CORNERS = f"{_ENTITIES.format(16, 16, 16)}, n as (select i, j, k, {_PHI48} as phi from e), c as (select (n.i - (b >> 2 & 1) + 16) % 16 as i, (n.j - (b >> 1 & 1) + 16) % 16 as j, (n.k - (b & 1) + 16) % 16 as k, sum(case when phi <= 0 then 1 << b else 0 end) as cs from n, (select unnest(range(0, 8)) as b) as r group by 1, 2, 3)"
register("mc_case_ids", lambda s, d: SU.cells(_sphere(s), _CUBE).select("i", "j", "k", "case"), f'with {_CORNERS} select i, j, k, cast(cs as integer) as "case" from c')
register(
    "mc_facet_counts",
    lambda s, d: SU.marching_cubes(_sphere(s), _CUBE).groupBy("i", "j", "k").agg(F.count("*").alias("n")),
    f"with {_CORNERS}, t(cs, n) as (values {', '.join(f'({c}, {len(f)})' for c, f in enumerate(SU.facet_table()))}) select i, j, k, cast(n as bigint) as n from c join t using (cs) where n > 0",
)
register("mc_facets_area", lambda s, d: SU.marching_cubes(_sphere(s), _CUBE).agg((F.abs(F.sum(SU.facet_area()) - 0.7853981633974483) < 0.03).alias("near"), (F.count("*") > 0).alias("some")), "select true as near, true as some")

# Pipelines --------------------------------------------------------------------------------------

for _name, (_query, _sql) in PL.PIPELINES.items():
    register(_name, _query, _sql)
