import numpy as np
import pytest
from pyspark.sql import functions as F

from meshquill.functions import arrow_linalg as A
from meshquill.functions import linalg as LA


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def values(one, v):
    v = v.v if hasattr(v, "v") else v
    return list(one.select(F.array(*v).alias("r")).first().r)


def test_quaternions(one):
    p, q = LA.Quaternion([1, 3, 2, 4]), LA.Quaternion([2, 3, 4, 5])
    assert values(one, p & q) == [-35, 3, 5, 19]
    assert values(one, p | q) == pytest.approx([13 / 18, 3 / 18, 1 / 18, -1 / 18])
    assert values(one, (~p) + p) == [2, 0, 0, 0]
    assert values(one, LA.Quaternion([0, 0, 0, 0]).to_matrix()) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    r = np.array(values(one, p.to_matrix())).reshape(3, 3)
    assert r @ r.T == pytest.approx(np.eye(3)) and np.linalg.det(r) == pytest.approx(1)


def test_contractions(one):
    t, u = LA.Tensor(range(27), (3, 3, 3)), LA.Vector([1, 2, 3])
    assert values(one, LA.contract(t, u, 0)) == list(range(72, 121, 6))
    assert values(one, LA.contract(t, u, 1)) == [24, 30, 36, 78, 84, 90, 132, 138, 144]
    assert values(one, LA.contract(t, u, 2)) == list(range(8, 153, 18))
    lam, mu = 0.5, 1.0
    d = np.eye(3)
    hooke = lam * np.einsum("ij,kl->ijkl", d, d) + mu * (np.einsum("ik,jl->ijkl", d, d) + np.einsum("il,jk->ijkl", d, d))
    strain = LA.Matrix([[0.5, 1, 0], [1, 0, 0], [0, 0, 0]])
    assert values(one, LA.contract(LA.Tensor(hooke.ravel(), (3, 3, 3, 3)), strain)) == [1.25, 2, 0, 2, 0.25, 0, 0, 0, 0.25]
    # the convention (0, 1, 2) = -1: the cross product of (1, 2, 3) and (3, 4, 3) is that of the transpose
    v = LA.Vector([3, 4, 3])
    assert values(one, LA.contract(LA.permutation(), u, 1) * v) == pytest.approx([6, -6, 2])
    assert values(one, ~LA.contract(LA.permutation(), u, 1) * v) == pytest.approx([-6, 6, -2])


def test_products_and_solves(one):
    rng = np.random.default_rng(1)
    for n in (2, 3):
        a, b = rng.normal(size=(n, n)) + 3 * np.eye(n), rng.normal(size=n)
        m = LA.Matrix(a.tolist())
        assert values(one, m ^ LA.Vector(b)) == pytest.approx(np.linalg.solve(a, b))
        assert values(one, [LA.determinant(m)])[0] == pytest.approx(np.linalg.det(a))
        assert values(one, m * LA.inverse(m)) == pytest.approx(np.eye(n).ravel(), abs=1e-12)
    singular = values(one, LA.inverse(LA.Matrix([[1, 2], [2, 4]])))
    assert not any(np.isfinite(singular))
    with pytest.raises(ValueError):
        LA.determinant(LA.identity(4))
    assert values(one, LA.Vector([3, 0, 4]).normalized()) == pytest.approx([0.6, 0, 0.8])


@pytest.mark.parametrize("n", [2, 3, 4, 10, 20])
def test_blocks(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(10, n, n)) + n * np.eye(n)
    b = rng.normal(size=(10, n, 2))
    assert A.solve_block(a, b) == pytest.approx(np.linalg.solve(a, b))
    f = A.lu_block(a)
    low, up = np.tril(f, -1) + np.eye(n), np.triu(f)
    assert low @ up == pytest.approx(a)


def test_svd_known(spark):
    a = [9.0, 8.0, -2.0, -5.0, -3.0, -4.0, 6.0, 0.0, 9.0]
    r = spark.createDataFrame([(a,)], "a array<double>").select(A.svd(F.col("a")).alias("s")).first().s
    assert r.d == pytest.approx([14.7817842778, 9.84464467996, -0.762774336685])
    u, v = np.array(r.u).reshape(3, 3), np.array(r.v).reshape(3, 3)
    assert np.linalg.det(u) == pytest.approx(1) and np.linalg.det(v) == pytest.approx(1)
    assert (u * r.d) @ v.T == pytest.approx(np.array(a).reshape(3, 3))


def test_exponential():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 3, 3)) * 0.4
    want, term = np.eye(3) + 0 * a, np.eye(3) + 0 * a
    for k in range(1, 60):
        term = term @ a / k
        want = want + term
    assert A.exponential_block(a) == pytest.approx(want, abs=1e-10)
