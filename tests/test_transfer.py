import pytest
from pyspark.sql import functions as F

from meshquill.operators import transfer as T
from meshquill.operators.mesh import Mesh
from meshquill.operators.spline import stencil

MESH = Mesh((200, 200, 200), (-50.0,) * 3, (0.5,) * 3, (False,) * 3)

# Known results of the transfers: the field below, one particle at (9.31, -8.28, -3.34) with mass 0.134.
U = {
    1: [-1075.3973434395382, -1070.4012502238586, -1063.4052282856794],
    2: [-1042.881103306653, -1037.9269247222057, -1030.9728166896425],
}
B1 = [-3.27964099553369, -4.910550811089088, 0.1993230728031321, -3.2687262820030547, -4.911593173052676, 0.1993230728031179, -3.257811639242931, -4.91263564023696, 0.1993230728031392]
MASS1 = [0.019390336, 0.009124864, 0.015235264, 0.007169536, 0.031636864, 0.014887936, 0.024857536, 0.011697664]


def field(stencil):
    i, j, k = (F.col(x).cast("double") for x in "ijk")
    u = lambda d: 1e-10 * (d + 1) * i**5 - 1.2e-9 * ((d + 1) + j * i) ** 3 + 1e-10 * (i * j * k) ** 2 + float((d + 1) ** 2)
    return stencil.select("i", "j", "k").distinct().withColumn("u", F.array(u(0), u(1), u(2)))


@pytest.fixture(scope="module")
def particle(spark):
    return spark.createDataFrame([(1, 9.31, -8.28, -3.34, 0.134)], "pid long, x double, y double, z double, m double").cache()


@pytest.mark.parametrize("order,location", [(1, "node"), (2, "cell")])
def test_affine_gather_known(particle, order, location):
    grid = field(stencil(particle, MESH, location, order, ["pid"]))
    c = T.apic_g2p(particle, MESH, location, order, grid).first().c
    assert c[:3] == pytest.approx(U[order], abs=1e-9)
    if order == 1:
        assert [c[3 + e * 3 + d] for d in range(3) for e in range(3)] == pytest.approx(B1, abs=1e-9)


def test_affine_scatter_mass_known(particle):
    rows = T.apic_p2g(particle.withColumn("c", F.array_repeat(F.lit(1.0), 12)), MESH, "node", 1).orderBy("i", "j", "k").collect()
    assert (rows[0].i, rows[0].j, rows[0].k) == (118, 83, 93)
    assert [r.mass for r in rows] == pytest.approx(MASS1, abs=1e-12)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_weights_sum_to_one_and_mass_is_kept(particle, order):
    got = T.p2g_value(particle, MESH, "node", order, "m").agg(F.sum("out"), F.count("*")).first()
    assert got[0] == pytest.approx(0.134, abs=1e-14)
    assert got[1] == (order + 1) ** 3


def test_constant_field(spark):
    mesh = Mesh((6, 5, 4), (0.0,) * 3, (0.5,) * 3, (True,) * 3)
    cells = mesh.entities(spark, "cell").select((F.col("i") * 100 + F.col("j") * 10 + F.col("k")).alias("pid"), *(((F.col(a) + 0.5) * 0.5).alias(x) for a, x in zip("ijk", "xyz")), F.lit(3.5).alias("v"), F.array_repeat(F.lit(3.5), 3).alias("vec"), F.array_repeat(F.lit(3.5), 9).alias("ten"))
    got = T.p2g_value(cells, mesh, "node", 1, "v").collect()
    assert len(got) == 120 and all(r.out == pytest.approx(3.5) for r in got)
    for rows in (T.p2g_gradient(cells, mesh, "node", 1, "v"), T.p2g_divergence(cells, mesh, "node", 1, "vec"), T.p2g_divergence(cells, mesh, "node", 1, "ten", tensor=True)):
        assert all(abs(r[c]) < 1e-12 for r in rows.collect() for c in rows.columns if c.startswith("out"))
    grid = mesh.entities(spark).withColumn("f", F.lit(3.5)).withColumn("v3", F.array_repeat(F.lit(3.5), 3))
    assert all(r.out == pytest.approx(3.5) for r in T.g2p_value(cells, mesh, "node", 2, grid, "f").collect())
    for rows in (T.g2p_gradient(cells, mesh, "node", 2, grid, "f"), T.g2p_gradient(cells, mesh, "node", 2, grid, "v3", 3), T.g2p_divergence(cells, mesh, "node", 2, grid, "v3")):
        assert all(abs(r[c]) < 1e-12 for r in rows.collect() for c in rows.columns if c.startswith("out"))
