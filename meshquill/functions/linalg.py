"""Small dense algebra per row, as unrolled Column expressions.

Values hold Columns; `of` reads them from a row-major array column, `column()` makes one. Operators:
~ transpose or conjugate, * product, + -, & element-wise (Hamilton product for quaternions, row
rotation for matrix & quaternion), | element-wise quotient (quaternion division), % cross product.
Division by a scalar multiplies by its reciprocal. A zero determinant or divisor gives infinities or
NaN as in IEEE arithmetic, never an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF, _NAN = float("inf"), float("nan")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def quotient(a, b) -> Column:
    """a / b by the rules of IEEE arithmetic."""
    a, b = lit(a), lit(b)
    zero = F.when((a == 0) | F.isnan(a), F.lit(_NAN)).otherwise(F.when(a > 0, F.lit(_INF)).otherwise(F.lit(-_INF)))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def total(xs: Sequence[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


class _Values:
    """Anything that is a flat run of Columns with extents."""

    v: list[Column]

    def column(self) -> Column:
        return F.array(*self.v)

    def _like(self, v):
        raise NotImplementedError

    def __add__(self, o):
        return self._like([a + b for a, b in zip(self.v, o.v, strict=True)])

    def __sub__(self, o):
        return self._like([a - b for a, b in zip(self.v, o.v, strict=True)])

    def scaled(self, s):
        return self._like([lit(s) * a for a in self.v])

    def __rmul__(self, s):
        return self.scaled(s)

    def __truediv__(self, s):
        return self.scaled(quotient(1.0, s))


class Vector(_Values):
    def __init__(self, v: Sequence):
        self.v = [lit(x) for x in v]

    @classmethod
    def of(cls, column: Column, n: int, at: int = 0) -> Vector:
        return cls([column.getItem(at + i) for i in range(n)])

    def _like(self, v):
        return Vector(v)

    def __len__(self):
        return len(self.v)

    def __getitem__(self, i) -> Column:
        return self.v[i]

    def __invert__(self) -> Matrix:
        return Matrix([self.v])

    def __mul__(self, o):
        """Outer product with a 1 x N matrix; scaling otherwise."""
        if isinstance(o, Matrix):
            return Matrix([[a]for a in self.v]) * o
        return self.scaled(o)

    def __and__(self, o: Vector) -> Vector:
        return Vector([a * b for a, b in zip(self.v, o.v, strict=True)])

    def __or__(self, o: Vector) -> Vector:
        return Vector([quotient(a, b) for a, b in zip(self.v, o.v, strict=True)])

    def __mod__(self, o: Vector) -> Vector:
        a, b = self.v, o.v
        return Vector([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])

    def dot(self, o: Vector) -> Column:
        return total([a * b for a, b in zip(self.v, o.v, strict=True)])

    def normalized(self) -> Vector:
        return self / F.sqrt(self.dot(self))


class Matrix(_Values):
    def __init__(self, rows: Sequence[Sequence]):
        self.n, self.m = len(rows), len(rows[0])
        self.v = [lit(x) for r in rows for x in r]

    @classmethod
    def of(cls, column: Column, n: int, m: int, at: int = 0) -> Matrix:
        return cls([[column.getItem(at + r * m + c) for c in range(m)] for r in range(n)])

    def _like(self, v):
        return Matrix([v[r * self.m : (r + 1) * self.m] for r in range(self.n)])

    def __getitem__(self, at) -> Column:
        return self.v[at[0] * self.m + at[1]]

    def row(self, r: int) -> Vector:
        return Vector(self.v[r * self.m : (r + 1) * self.m])

    def col(self, c: int) -> Vector:
        return Vector(self.v[c :: self.m])

    def __invert__(self) -> Matrix:
        return Matrix([[self[r, c] for r in range(self.n)] for c in range(self.m)])

    def __mul__(self, o):
        if isinstance(o, Matrix):
            return Matrix([[self.row(r).dot(o.col(c)) for c in range(o.m)] for r in range(self.n)])
        if isinstance(o, Vector):
            return Vector([self.row(r).dot(o) for r in range(self.n)])
        return self.scaled(o)

    def __and__(self, q: Quaternion) -> Matrix:
        """Every row turned by the quaternion: the vector part of q (0, row) q*."""
        return Matrix([(q & Quaternion([0.0, *self.row(r).v]) & ~q).v[1:] for r in range(self.n)])

    def __xor__(self, b):
        return solve(self, b)


class Quaternion(_Values):
    """(w, x, y, z)."""

    def __init__(self, v: Sequence):
        self.v = [lit(x) for x in v]

    @classmethod
    def of(cls, column: Column, at: int = 0) -> Quaternion:
        return cls([column.getItem(at + i) for i in range(4)])

    @classmethod
    def join(cls, scalar, vector: Vector) -> Quaternion:
        return cls([scalar, *vector.v])

    def _like(self, v):
        return Quaternion(v)

    def scalar(self) -> Column:
        return self.v[0]

    def vector(self) -> Vector:
        return Vector(self.v[1:])

    def __invert__(self) -> Quaternion:
        return Quaternion([self.v[0], *(-x for x in self.v[1:])])

    def __and__(self, o: Quaternion) -> Quaternion:
        a, u, b, v = self.scalar(), self.vector(), o.scalar(), o.vector()
        return Quaternion.join(a * b - u.dot(v), v.scaled(a) + u.scaled(b) + u % v)

    def __or__(self, o: Quaternion) -> Quaternion:
        return self & ((~o) / total([x * x for x in o.v]))

    def to_matrix(self) -> Matrix:
        """Rotation matrix of the normalised quaternion; the zero quaternion gives the identity."""
        norm = total([x * x for x in self.v])
        s = F.when(norm > 0, quotient(2.0, norm)).otherwise(F.lit(0.0))
        w, x, y, z = self.v
        return Matrix([
            [1.0 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
            [s * (x * y + w * z), 1.0 - s * (x * x + z * z), s * (y * z - w * x)],
            [s * (x * z - w * y), s * (y * z + w * x), 1.0 - s * (x * x + y * y)],
        ])


class Tensor(_Values):
    """Rank 3 or 4, row-major."""

    def __init__(self, v: Sequence, dims: tuple[int, ...]):
        self.v, self.dims = [lit(x) for x in v], dims

    @classmethod
    def of(cls, column: Column, dims: tuple[int, ...], at: int = 0) -> Tensor:
        n = 1
        for d in dims:
            n *= d
        return cls([column.getItem(at + i) for i in range(n)], dims)

    def _like(self, v):
        return Tensor(v, self.dims)

    def __getitem__(self, at) -> Column:
        i = 0
        for d, x in zip(self.dims, at, strict=True):
            i = i * d + x
        return self.v[i]

    def matrix(self, first: int) -> Matrix:
        """The last two indices of a rank-3 tensor at one first index."""
        a, b = self.dims[1:]
        return Matrix([[self[first, i, j] for j in range(b)] for i in range(a)])

    def tensor3(self, first: int) -> Tensor:
        n = len(self.v) // self.dims[0]
        return Tensor(self.v[first * n : (first + 1) * n], self.dims[1:])

    def vector(self, first: int, second: int) -> Vector:
        return Vector([self[first, second, k] for k in range(self.dims[2])])


def copy(a):
    """A value of its own with the same Columns."""
    return a._like(list(a.v))


def determinant(a: Matrix) -> Column:
    if (a.n, a.m) == (2, 2):
        return a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
    if (a.n, a.m) == (3, 3):
        return a[0, 0] * (a[1, 1] * a[2, 2] - a[1, 2] * a[2, 1]) - a[0, 1] * (a[1, 0] * a[2, 2] - a[1, 2] * a[2, 0]) + a[0, 2] * (a[1, 0] * a[2, 1] - a[1, 1] * a[2, 0])
    raise ValueError("determinant: 2 x 2 or 3 x 3 only")


def trace(a: Matrix) -> Column:
    return total([a[i, i] for i in range(min(a.n, a.m))])


def identity(n: int) -> Matrix:
    return Matrix([[1.0 if r == c else 0.0 for c in range(n)] for r in range(n)])


def diagonal(x: Vector) -> Matrix:
    return Matrix([[x[r] if r == c else 0.0 for c in range(len(x))] for r in range(len(x))])


def permutation() -> Tensor:
    """Levi-Civita tensor with the sign convention (0, 1, 2) = -1."""
    return Tensor([(i - j) * (j - k) * (i - k) / 2.0 for i in range(3) for j in range(3) for k in range(3)], (3, 3, 3))


def contract(t: Tensor, x, index: int | None = None):
    """Rank 3 with a vector over an index: a matrix. Rank 4 with a matrix over its last two: a matrix."""
    if len(t.dims) == 4:
        a, b, c, d = t.dims
        return Matrix([[total([t[i, j, k, m] * x[k, m] for k in range(c) for m in range(d)]) for j in range(b)] for i in range(a)])
    rest = [d for e, d in enumerate(t.dims) if e != index]
    at = lambda i, j, s: tuple([i, j][:index]) + (s,) + tuple([i, j][index:])
    return Matrix([[total([t[at(i, j, s)] * x[s] for s in range(t.dims[index])]) for j in range(rest[1])] for i in range(rest[0])])


def inverse(a: Matrix, det: Column | None = None) -> Matrix:
    """Adjugate over determinant, 2 x 2 or 3 x 3; larger ones: functions.arrow_linalg."""
    scale = quotient(1.0, determinant(a) if det is None else det)
    if a.n == 2:
        adjugate = Matrix([[a[1, 1], -a[0, 1]], [-a[1, 0], a[0, 0]]])
    else:
        minor = lambda r, c: [a[i, j] for i in range(3) if i != r for j in range(3) if j != c]
        cof = [[(1 if (r + c) % 2 == 0 else -1) * (minor(r, c)[0] * minor(r, c)[3] - minor(r, c)[1] * minor(r, c)[2]) for c in range(3)] for r in range(3)]
        adjugate = ~Matrix(cof)
    return adjugate.scaled(scale)


def solve(a: Matrix, b):
    """a x = b for 2 x 2 and 3 x 3; b a vector or a matrix of right-hand sides."""
    return inverse(a) * b


#: The factors of the degree-16 matrix exponential (Gebremedhin and Weatherford, arXiv:1606.08395).
EXPONENTIAL_SCALE = 4.955887515892002289e-14
EXPONENTIAL_FACTORS = [
    [3599.994262347704951, 862.0738730089864644, -14.86233950714664427, -4.881331340410683266, 1.0],
    [1693.461215815646064, 430.8068649851425321, 77.58934041908401266, 7.763092503482958289, 1.0],
    [1478.920917621023984, 387.7896702475912482, 98.78409444643527097, 9.794888991082968084, 1.0],
    [2237.981769593417334, 545.9089563171489062, 37.31797993128430013, 3.323349845844756893, 1.0],
]
