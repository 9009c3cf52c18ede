import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquill.operators import fields as FD
from meshquill.operators import geometry as GEO
from meshquill.operators import mapping as MP
from meshquill.operators import mesh as ME
from meshquill.operators import particles as PA
from meshquill.operators import transfer as T
from meshquill.sources import config, stl
from meshquill.sources import fixtures as FX

PERIODIC = [True, False, True]


def test_mesh_rules(tmp_path):
    c = {"mesh": {"cell_size": 0.5, "periodic": PERIODIC, "partitioner": {"type": "uniform_dim"}, "halo_cell_width": 2}}
    (tmp_path / "c.json").write_text(json.dumps(c))
    m = ME.uniform_mesh(config.parse(str(tmp_path / "c.json")), [0, 0, 0, 2, 2, 2], 1)
    assert m.num_cell == (4, 6, 4) and m.low == (0, -0.5, 0) and m.halo == 2 and m.high == (2, 2.5, 2)
    m = ME.uniform_mesh({"mesh": {"global_num_cell": [4, 4, 4], "periodic": PERIODIC}}, [0, 0, 0, 2, 2, 2], 0)
    assert m.cell_size == (0.5,) * 3
    with pytest.raises(RuntimeError, match="Invalid uniform mesh size parameters"):
        ME.uniform_mesh({"mesh": {"periodic": PERIODIC}}, [0, 0, 0, 1, 1, 1])
    with pytest.raises(ValueError, match="not evenly divisible"):
        ME.uniform_mesh({"mesh": {"cell_size": 0.3, "periodic": PERIODIC}}, [0, 0, 0, 1, 1, 1])
    with pytest.raises(ValueError, match="partitioner"):
        ME.uniform_mesh({"mesh": {"cell_size": 0.5, "periodic": PERIODIC, "partitioner": {"type": "odd"}}}, [0, 0, 0, 1, 1, 1])
    m = ME.uniform_mesh({"mesh": {"cell_size": 0.5, "periodic": PERIODIC, "partitioner": {"type": "manual", "ranks_per_dim": [2, 1, 1]}}}, [0, 0, 0, 1, 1, 1])
    assert m.ranks == (2, 1, 1) and ME.is_uniform_mesh(m) and not ME.is_adaptive_mesh(m) and not ME.is_curvilinear_mesh(m)
    assert config.version()


def test_catalog(spark):
    cat = FD.FieldCatalog(FX.MESH, spark)
    foo = FD.Layout("node", FD.Field("foo", (3,)))
    with pytest.raises(RuntimeError, match="Node_foo field doesn't exist"):
        cat.array(foo)
    cat.add(foo)
    before = cat.array(foo)
    cat.add(foo)
    assert cat.array(foo) is before and before.count() == 17 * 9 * 9
    assert cat.array(FD.Layout("node", FD.PhysicalPosition())).count() == 17 * 9 * 9
    assert FD.particle_schema(FD.Color, FD.Field("bar", (3, 3)))["bar"].metadata == {"rank": 2, "dims": [3, 3]}


@pytest.mark.parametrize("location", sorted(ME.OFFSETS))
def test_wrapped_gather_and_scatter(spark, location):
    mesh = ME.Mesh((4, 3, 2), (0.0,) * 3, (1.0,) * 3, (True,) * 3)
    own = mesh.entities(spark, location).withColumn("v", (F.col("i") + 10 * F.col("j") + 100 * F.col("k")).cast("double"))
    places = spark.range(8 * 7 * 6).selectExpr("id % 8 - 2 as i", "id div 8 % 7 - 2 as j", "id div 56 - 2 as k")
    got = FD.gather_copies(mesh, location, own, places).collect()
    assert len(got) == 8 * 7 * 6 and all(r.v == r.i % 4 + 10 * (r.j % 3) + 100 * (r.k % 2) for r in got)
    back = FD.scatter_sum(mesh, location, places.withColumn("v", F.lit(1.0)), ["v"]).agg(F.sum("v"), F.count("*")).first()
    assert tuple(back) == (8 * 7 * 6, 24)


def test_scatter_field_is_zeroed_first(spark):
    cat = FD.FieldCatalog(FX.MESH, spark)
    bar = FD.Layout("node", FD.Field("bar"))
    cat.add(bar, FX.MESH.entities(spark).withColumn("bar", F.lit(-1.1)))
    op = FD.create_grid_operator(FX.MESH, scatter=[bar])
    op.setup(cat)
    p = spark.createDataFrame([(1, 2.5, 2.5, 2.5)], "pid long, x double, y double, z double")
    op.apply_particles(cat, p, "node", 1, lambda p: {"bar": f"{p.w} * 8"})
    got = {r.bar for r in cat.array(bar).collect()}
    assert got == {0.0, 1.0}


def test_gather_and_scatter_in_one_pass(spark):
    """A functor that reads a field, adds to another and sets a column of the particles."""
    mesh = ME.Mesh((4, 4, 4), (0.0,) * 3, (1.0,) * 3, PERIODIC)
    cat = FD.FieldCatalog(mesh, spark)
    a, b = FD.Layout("node", FD.Field("a", (2,))), FD.Layout("node", FD.Field("b"))
    cat.add(a, mesh.entities(spark).withColumn("a", F.array(F.col("j") * 1.0, F.lit(2.0))))
    op = FD.create_grid_operator(mesh, gather=[a], scatter=[b])
    op.setup(cat)
    p = spark.createDataFrame([(1, 3.75, 1.25, 0.5, 4.0), (2, 0.0, 2.0, 3.0, 8.0), (3, None, 1.0, 1.0, 1.0)], "pid long, x double, y double, z double, m double")
    got = op.apply_particles(cat, p, "node", 1, lambda q: {"b": f"{q.w} * m * {q.read('a', 1)}", "height": f"{q.w} * {q.read('a', 0)}"})
    assert {r.pid: r.height for r in got.collect()} == {1: 1.25, 2: 2.0}, "a particle without a position has no row"
    grid = {(r.i, r.j, r.k): r.b for r in cat.array(b).collect()}
    assert len(grid) == 4 * 5 * 4 and sum(grid.values()) == pytest.approx(24) and grid[0, 2, 3] == 16 and grid[0, 1, 0] == 4 * 2 * 0.75 * 0.75 * 0.5


def test_two_dimensions(spark):
    mesh = ME.Mesh((6, 5), (0.0, 0.0), (0.5, 0.5), (True, False))
    p = spark.createDataFrame([(1, 1.3, 1.1, 2.0), (2, 0.1, 2.2, 3.0)], "pid long, x double, y double, m double")
    assert T.p2g_value(p, mesh, "node", 1, "m").agg(F.sum("out")).first()[0] == pytest.approx(5.0)
    grid = mesh.entities(spark).withColumn("f", F.col("j") * 0.5)
    assert {r.pid: round(r.out, 9) for r in T.g2p_value(p, mesh, "node", 1, grid, "f").collect()} == {1: 1.1, 2: 2.2}


@pytest.mark.parametrize("make,per_cell", [("uniform", 27), ("random", 10)])
def test_particle_counts(spark, make, per_cell):
    mesh = ME.Mesh((5, 4, 6), (-1.0, 0.0, 2.0), (0.23,) * 3, PERIODIC)
    inside = (F.col("x") > -1 + 0.23) & (F.col("x") < -1 + 4 * 0.23)
    p = PA.particles_uniform(spark, mesh, 3, inside) if make == "uniform" else PA.particles_random(spark, mesh, 10, 1, inside)
    got = p.agg(F.count("*"), F.countDistinct("pid"), F.min("volume"), F.max("volume")).first()
    assert got[0] == got[1] == per_cell * 3 * 4 * 6
    assert got[2] == got[3] == pytest.approx(0.23**3 / per_cell)
    assert PA.append(p, p).count() == 2 * got[0]


@pytest.mark.parametrize("n", [2, 3])
def test_bilinear_roundtrip(spark, n):
    m = MP.uniform_bilinear(spark, [0.0] * n + [2.0] * n, 0.5, (False,) * n)
    rng = np.random.default_rng(0)
    pts = rng.uniform(0.1, 3.9, (20, n))
    ref = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pid long, " + ", ".join(f"r{d} double" for d in range(n)))
    x = {r.pid: [r[f"x{d}"] for d in range(n)] for r in m.forward(ref, "pid").collect()}
    assert all(x[i] == pytest.approx(p * 0.5) for i, p in enumerate(pts))
    metrics = m.metrics(ref, "pid").first()
    assert metrics.det == pytest.approx(0.5**n) and metrics.inverse[0] == pytest.approx(2)
    start = ref.select("pid", *(F.lit(1.5).alias(f"r{d}") for d in range(n))).join(m.forward(ref, "pid"), "pid")
    for r in m.reverse(start, "pid").collect():
        assert r.ok and r.ref == pytest.approx(pts[r.pid])


def test_newton_crosses_cells_and_wraps(spark):
    """Starts far from the goal on a bent mesh, one dimension of it periodic; singular cells give up."""
    cells = (8, 6)
    mesh = ME.Mesh(cells, (0.0, 0.0), (1.0, 1.0), (False, False))
    nodes = mesh.entities(spark).select("i", "j", F.array(F.col("i") + 0.1 * F.col("j"), F.col("j") + 0.02 * F.col("i") * F.col("j")).alias("x"))
    m = MP.BilinearMapping(cells, (False, False), nodes)
    goal = [(n, 0.3 + 0.9 * n, 5.7 - 0.6 * n) for n in range(8)]
    at = m.forward(spark.createDataFrame(goal, "pid long, r0 double, r1 double"), "pid")
    start = at.select("pid", "x0", "x1", F.lit(7.5).alias("r0"), F.lit(0.5).alias("r1"))
    got = {r.pid: r for r in m.reverse(start, "pid").collect()}
    assert len(got) == 8 and all(got[n].ok and got[n].ref == pytest.approx([a, b], abs=1e-9) for n, a, b in goal)
    flat = MP.BilinearMapping(cells, (False, False), nodes.withColumn("x", F.array(F.lit(1.0), F.lit(2.0))))
    assert not any(r.ok for r in flat.reverse(start, "pid").collect())
    assert m.reverse(start.limit(0), "pid").count() == 0


@pytest.mark.slow
def test_newton_on_more_than_two_million_nodes(spark):
    m = MP.uniform_bilinear(spark, [0.0] * 3 + [130.0] * 3, 1.0, (False,) * 3)
    ref = spark.createDataFrame([(n, 0.4 + 25.3 * n, 129.7 - 25 * n, 64.2) for n in range(5)], "pid long, r0 double, r1 double, r2 double")
    start = m.forward(ref, "pid").select("pid", "x0", "x1", "x2", *(F.lit(10.5).alias(f"r{d}") for d in range(3)))
    got = {r.pid: r for r in m.reverse(start, "pid").collect()}
    assert all(got[r.pid].ok and got[r.pid].ref == pytest.approx([r.r0, r.r1, r.r2]) for r in ref.collect())


def test_stl(spark, tmp_path):
    text = ["solid Volume 7", *["  facet normal 0 0 0", "    outer loop", "      vertex 0 0 0", "      vertex 1.5e0 0 0", "      vertex 0 -2 0", "    endloop", "  endfacet"], "endsolid Volume 7", "solid Surface 2", "endsolid Surface 2"]
    f = tmp_path / "a.stl"
    f.write_text("\n".join(text))
    rows = stl.read_stl(spark, str(f)).collect()
    assert len(rows) == 1 and rows[0].global_id == 7 and rows[0].kind == "volume" and list(rows[0].normal) == [0, 0, -1]
    for wrong, says in (("solid Volume", "three words"), ("solid Cube 1", "unknown solid"), ("facet normal 0 0", "five words"), ("vertex 1 2", "four words")):
        f.write_text("\n".join([wrong, *text]))
        with pytest.raises(RuntimeError, match=f"STL READER: .*{says}"):
            stl.read_stl(spark, str(f))
    with pytest.raises(RuntimeError, match="Unable to open STL ASCII file"):
        stl.read_stl(spark, str(tmp_path / "none.stl"))
    out = str(tmp_path / "out")
    stl.write_stl(FX.cube(spark), out)
    back = stl.read_stl(spark, out)
    assert back.count() == 12 and stl.offsets(back).first().offset == 12


def test_rays_and_location(spark):
    facet = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "v0 array<float>, v1 array<float>, v2 array<float>")
    hit = lambda x, r: facet.select(GEO.ray_hits([F.lit(float(c)) for c in x], [F.lit(float(c)) for c in r])).first()[0]
    assert hit((0.2, 0.2, -1), (0, 0, 1)) and not hit((0.2, 0.2, -1), (0, 0, -1))
    assert not hit((0.2, 0.2, 0), (0, 0, 1)), "on the facet is no hit"
    assert not hit((0.8, 0.8, -1), (0, 0, 1)) and not hit((0.2, 0.2, -1), (1, 0, 0))
    shape = FX.cube(spark, 1, 3, 1, 0).unionByName(FX.cube(spark, 4, 5, 2, 1)).unionByName(FX.cube(spark, 0, 9, 9, 2))
    pts = spark.createDataFrame([(1, 2.0, 2.1, 2.2), (2, 4.4, 4.5, 4.6), (3, 0.5, 0.5, 0.6), (4, -20.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    assert {r.pid: r.volume_id for r in GEO.locate(pts, shape, 9).collect()} == {1: 0, 2: 1, 3: -1, 4: -2}
    assert GEO.local_ids(shape, "volume") == {1: 0, 2: 1, 9: 2}
