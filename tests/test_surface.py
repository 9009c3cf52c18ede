import math

import numpy as np
from pyspark.sql import functions as F

from meshquill.operators import levelset as L
from meshquill.operators import surface as S
from meshquill.operators.mesh import Mesh


def sphere(spark, n, low=0.0, r=0.25):
    mesh = Mesh((n,) * 3, (low,) * 3, (1.0 / n,) * 3, (True,) * 3, halo=4)
    x = mesh.coordinates()
    return mesh, mesh.entities(spark).withColumn("phi", F.sqrt(sum((c - 0.5) * (c - 0.5) for c in x)) - r)


def test_table():
    t = S.facet_table()
    assert [len(t[c]) for c in (0, 1, 3, 6, 9, 24, 231, 255)] == [0, 1, 2, 4, 4, 6, 2, 0]
    assert sum(map(len, t)) == 836


def test_tables_match_on_shared_faces():
    """The face lines that facets of one cell draw are those its neighbour draws, the other way round."""
    t, faces = S.facet_table(), S._faces()

    def lines(case, axis, side):
        on = [n for n, (a, b) in enumerate(S.EDGES) if all((c >> (2 - axis) & 1) == side for c in (a, b))]
        own = [(f[i], f[(i + 1) % 3]) for f in t[case] for i in range(3)]
        own = [e for e in own if all(x in on for x in e) and e[::-1] not in own]
        place = lambda n: frozenset(c & ~(1 << (2 - axis)) for c in S.EDGES[n])
        return {(place(a), place(b)) for a, b in own}

    rng = np.random.default_rng(0)
    for _ in range(300):
        axis = int(rng.integers(3))
        bits = rng.integers(0, 2, 8)
        other = rng.integers(0, 2, 8)
        for c in range(8):
            if not c >> (2 - axis) & 1:
                other[c] = bits[c | 1 << (2 - axis)]
        a, b = (int(sum(int(x[c]) << c for c in range(8))) for x in (bits, other))
        assert lines(a, axis, 1) == {e[::-1] for e in lines(b, axis, 0)}
    assert len(faces) == 6


def test_sphere_area(spark):
    mesh, phi = sphere(spark, 24)
    area = S.marching_cubes(phi, mesh).agg(F.sum(S.facet_area())).first()[0]
    assert abs(area - 4 * math.pi * 0.25**2) < 0.01


def test_redistance_sphere(spark):
    mesh, phi = sphere(spark, 16)
    h = 1.0 / 16
    scaled = phi.withColumn("phi", F.col("phi") * 2)
    p = L.LevelSet(secant_tol=0.1, num_random_guess=2, projection_tol=1e-6)
    last = None
    for tile in (8, 32):
        got = L.redistance(scaled, mesh, p, tile=tile).join(phi, ["i", "j", "k"]).orderBy("i", "j", "k").toPandas()
        assert len(got) == 16**3
        assert ((got.signed_distance - got.phi).abs() <= 0.5 * h).all(), "near and far"
        assert (np.sign(got.signed_distance) == np.sign(got.phi))[got.phi.abs() > 0.5 * h].all()
        assert last is None or np.abs(got.signed_distance - last).max() < 1e-14, "tiles change nothing, at any node"
        last = got.signed_distance


def test_redistance_oblique_plane(spark):
    """The field's multiple of the distance to a plane: exact in the band, wherever the foot lies in the mesh."""
    mesh = Mesh((12,) * 3, (0.0,) * 3, (0.5,) * 3, (False,) * 3, halo=3)
    x = mesh.coordinates()
    exact = (x[0] * 2 + x[1] + x[2] * 2) / 3 - 4.6
    rows = mesh.entities(spark).select("i", "j", "k", (exact * 3).alias("phi"), exact.alias("exact"))
    got = L.redistance(rows, mesh, L.LevelSet(secant_tol=1e-7, projection_tol=1e-9, max_projection_iter=400), tile=6).join(rows, ["i", "j", "k"]).toPandas()
    d = got.exact.to_numpy()
    foot = got[["i", "j", "k"]].to_numpy() * 0.5 - d[:, None] * np.array([2, 1, 2]) / 3
    # at the mesh's edge the nearest place within it is not the foot, and the steps between even nodes carry that inwards
    inner = (np.abs(d) < 1.0) & (foot > 1.2).all(axis=1) & (foot < 4.8).all(axis=1)
    assert inner.sum() > 100 and np.abs(got.signed_distance - d)[inner].max() < 1e-5
    assert (np.sign(got.signed_distance) == np.sign(d))[np.abs(d) > 0.25].all(), "but within half a cell of the plane"
    none = L.redistance(rows.withColumn("phi", F.lit(2.0)), mesh, L.LevelSet()).select("signed_distance").distinct().collect()
    assert [round(r[0], 9) for r in none] == [round(6 * 3**0.5, 9)], "no surface: the mesh's diagonal"


def test_nearest_far_away(spark):
    """Few particles in a corner of a long mesh, many in one place: each entity finds its nearest, against brute force."""
    mesh = Mesh((40, 3, 3), (-5.0, 0.0, 0.0), (0.5,) * 3, (False,) * 3, halo=2)
    rng = np.random.default_rng(4)
    pts = np.concatenate((rng.uniform(0, 0.4, (300, 3)) + [14, 0.5, 0.5], [[-9.0, 5.0, 1.0]]))
    parts = spark.createDataFrame([(*map(float, p),) for p in pts], "x double, y double, z double")
    got = L.estimate_distance(parts, mesh, "cell", 0.0).toPandas()
    assert len(got) == 360
    e = (got[["i", "j", "k"]].to_numpy() + 0.5) * 0.5 + [-5, 0, 0]
    want = np.sqrt(((e[:, None] - pts[None]) ** 2).sum(axis=2)).min(axis=1)
    assert np.abs(got.distance_estimate - want).max() < 1e-5


def test_nearest_distance(spark):
    mesh = Mesh((6, 5, 4), (0.0,) * 3, (0.5,) * 3, (False,) * 3, halo=2)
    rng = np.random.default_rng(3)
    pts = rng.uniform(0, 0.6, (9, 3))
    parts = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double, z double")
    got = L.estimate_distance(parts, mesh, "node", 0.1).toPandas()
    assert len(got) == 7 * 6 * 5
    e = got[["i", "j", "k"]].to_numpy() * 0.5
    want = np.sqrt(((e[:, None] - pts[None]) ** 2).sum(axis=2)).min(axis=1) - 0.1
    assert np.abs(got.distance_estimate - want).max() < 1e-6
    empty = L.estimate_distance(parts.limit(0), mesh, "node", 0.1)
    assert {r.distance_estimate for r in empty.collect()} == {1.0}
