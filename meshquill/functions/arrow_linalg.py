"""Batched dense algebra on array columns where unrolled expressions would be too large: Arrow batches
of row-major arrays become (rows, n, n) numpy blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from meshquill.functions.linalg import EXPONENTIAL_FACTORS, EXPONENTIAL_SCALE


def _block(s: pd.Series, *dims: int) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(np.float64).reshape(-1, *dims) if len(s) else np.zeros((0, *dims))


def _series(a: np.ndarray) -> pd.Series:
    return pd.Series(list(a.reshape(len(a), -1)), dtype=object)


def lu_block(a: np.ndarray) -> np.ndarray:
    """Packed LU without pivoting; rectangular blocks allowed. A zero pivot gives infinities or NaN."""
    a = a.copy()
    n, m = a.shape[1:]
    with np.errstate(all="ignore"):
        for k in range(min(n, m)):
            a[:, k + 1 :, k] /= a[:, k, k][:, None]
            a[:, k + 1 :, k + 1 :] -= a[:, k + 1 :, k, None] * a[:, None, k, k + 1 :]
    return a


def solve_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forward and back substitution on the packed LU; b: (rows, n, right-hand sides)."""
    f, x = lu_block(a), b.copy()
    n = a.shape[1]
    with np.errstate(all="ignore"):
        for i in range(1, n):
            x[:, i] -= np.einsum("rk,rkm->rm", f[:, i, :i], x[:, :i])
        for i in range(n - 1, -1, -1):
            x[:, i] = (x[:, i] - np.einsum("rk,rkm->rm", f[:, i, i + 1 :], x[:, i + 1 :])) / f[:, i, i][:, None]
    return x


def exponential_block(a: np.ndarray) -> np.ndarray:
    """Product of four quartic factors, no scaling or squaring."""
    powers = [np.broadcast_to(np.eye(a.shape[1]), a.shape), a]
    for _ in range(3):
        powers.append(powers[-1] @ a)
    out = None
    for factor in EXPONENTIAL_FACTORS:
        part = sum(c * p for c, p in zip(factor, powers))
        out = part if out is None else out @ part
    return EXPONENTIAL_SCALE * out


def svd_block(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, d, V with a = U diag(d) V^T, U and V rotations (determinant 1) and the smallest entry of d
    carrying the sign of the determinant."""
    if not len(a):
        return a, a[:, :, 0], a
    u, d, vt = np.linalg.svd(a)
    v = np.swapaxes(vt, 1, 2).copy()
    for x in (u, v):
        flip = np.linalg.det(x) < 0
        x[flip, :, -1] *= -1
        d[flip, -1] *= -1
    return u, d, v


def _udf(fn, kind: str):
    return F.pandas_udf(fn, kind)


def lu(a: Column, n: int, m: int | None = None) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return _series(lu_block(_block(s, n, m or n)))

    return _udf(run, "array<double>")(a)


def solve(a: Column, b: Column, n: int, sides: int = 1) -> Column:
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return _series(solve_block(_block(s, n, n), _block(t, n, sides)))

    return _udf(run, "array<double>")(a, b)


def inverse(a: Column, n: int) -> Column:
    def run(s: pd.Series) -> pd.Series:
        x = _block(s, n, n)
        return _series(solve_block(x, np.broadcast_to(np.eye(n), x.shape)))

    return _udf(run, "array<double>")(a)


def exponential(a: Column, n: int) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return _series(exponential_block(_block(s, n, n)))

    return _udf(run, "array<double>")(a)


def svd(a: Column) -> Column:
    """Of 3 x 3: struct u, d, v."""

    def run(s: pd.Series) -> pd.DataFrame:
        u, d, v = svd_block(_block(s, 3, 3))
        return pd.DataFrame({"u": _series(u), "d": _series(d), "v": _series(v)})

    return _udf(run, "struct<u:array<double>,d:array<double>,v:array<double>>")(a)
