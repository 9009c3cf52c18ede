"""Coordinate mappings between a logical mesh of unit cells and physical space."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquill.functions.linalg import Matrix, determinant, inverse
from meshquill.operators.mesh import AXES, Mesh
from meshquill.operators.transfer import Sums, field_by_base, gather
from meshquill.sources.shared import checkpoint


class Mapping:
    """num_cell and periodic; forward, jacobian and reverse work on logical columns r0, r1, r2."""

    num_cell: tuple[int, ...]
    periodic: tuple[bool, ...]

    @property
    def dim(self) -> int:
        return len(self.num_cell)

    def mesh(self) -> Mesh:
        return Mesh(self.num_cell, (0.0,) * self.dim, (1.0,) * self.dim, self.periodic, kind="curvilinear", mapping=self)


@dataclass(frozen=True)
class UniformMapping(Mapping):
    """physical = low + logical * h."""

    num_cell: tuple[int, ...]
    periodic: tuple[bool, ...]
    low: tuple[float, ...]
    h: float

    def forward(self, ref: list[Column]) -> list[Column]:
        return [F.lit(lo) + r * self.h for lo, r in zip(self.low, ref)]

    def jacobian(self, ref: list[Column]) -> Matrix:
        return Matrix([[self.h if r == c else 0.0 for c in range(self.dim)] for r in range(self.dim)])

    def measure(self) -> float:
        """Determinant of the Jacobian: a cell's measure."""
        return self.h**self.dim

    def reverse(self, x: list[Column]) -> tuple[list[Column], Column]:
        return [(c - lo) * (1.0 / self.h) for lo, c in zip(self.low, x)], F.lit(True)


def uniform_cartesian_mesh(box: list[float], h: float, periodic: tuple[bool, ...]) -> Mesh:
    """A curvilinear mesh under the uniform mapping, of two or three dimensions."""
    n = len(periodic)
    extent = [box[n + d] - box[d] for d in range(n)]
    cells = tuple(int(np.rint(e / h)) for e in extent)
    if any(abs(c * h - e) > np.finfo(np.float32).eps for c, e in zip(cells, extent)):
        raise ValueError("Extent not evenly divisible by uniform cell size")
    return UniformMapping(cells, tuple(periodic), tuple(box[:n]), h).mesh()


@dataclass(frozen=True)
class BilinearMapping(Mapping):
    """Multilinear in every cell, between the cell's node coordinates (i, j[, k], x array)."""

    num_cell: tuple[int, ...]
    periodic: tuple[bool, ...]
    nodes: DataFrame = None

    def _met(self, rows: DataFrame, key: str, sums: Sums) -> DataFrame:
        """key and the sums over the corners of each row's cell: nodes are dealt to cells, rows meet them once."""
        n = self.dim
        unit = Mesh(self.num_cell, (0.0,) * n, (1.0,) * n, self.periodic)
        return gather(rows, unit, "node", 1, self.nodes.select(*AXES[:n], F.col("x").alias("_x")), sums, key, ("gradient",), position=tuple(f"r{d}" for d in range(n)))

    def forward(self, rows: DataFrame, key: str) -> DataFrame:
        """rows (key, r0..) to key, x0.."""
        return self._met(rows, key, {f"x{d}": lambda p, d=d: f"{p.w} * {p.read('_x', d)}" for d in range(self.dim)})

    def metrics(self, rows: DataFrame, key: str) -> DataFrame:
        """key, jacobian (row-major: component, direction), det, inverse."""
        n = self.dim
        sums = self._met(rows, key, {f"j{d}{e}": lambda p, d=d, e=e: f"{p.g[e]} * {p.read('_x', d)}" for d in range(n) for e in range(n)})
        j = Matrix([[F.col(f"j{d}{e}") for e in range(n)] for d in range(n)])
        sums = sums.select(key, j.column().alias("jacobian"), determinant(j).alias("det"))
        j = Matrix.of(F.col("jacobian"), n, n)
        return sums.select(key, "jacobian", "det", inverse(j, F.col("det")).column().alias("inverse"))

    def reverse(self, rows: DataFrame, key: str, steps: int = 15) -> DataFrame:
        """Newton from the logical start (r0.., physical x0..): key, ref array, ok (converged within `steps`).

        Rows meet the corners of their cell by a join on its index and iterate there, in Arrow batches; only
        those that left it go to another round. So no task holds more than its rows' own corners, however
        large the mesh is. Outside a dimension that doesn't wrap, the last cell is extrapolated."""
        n = self.dim
        cells, wrap = np.array(self.num_cell), np.array(self.periodic)
        corners = checkpoint(field_by_base(self.nodes.select(*AXES[:n], "x"), self.mesh(), "node", 1).select(*(f"_b{d}" for d in range(n)), F.flatten(F.transform("_f", lambda v: v["x"])).alias("_x")))
        kind, state = dict(rows.dtypes)[key], [*(f"r{d}" for d in range(n)), *(f"x{d}" for d in range(n))]
        out = f"{key} {kind}, " + ", ".join(f"{c} double" for c in state) + ", _left int, _status int"

        def run(batches):
            for pdf in batches:
                ref, goal = (np.stack([pdf[f"{c}{d}"].to_numpy(float) for d in range(n)], 1) for c in "rx")
                known = pdf["_x"].map(lambda v: v is not None and len(v) == n << n and not any(y is None or y != y for y in v)).to_numpy(bool)
                x = np.zeros((len(ref), 1 << n, n))
                if known.any():
                    x[known] = np.stack(pdf["_x"][known].to_numpy()).astype(float).reshape(-1, 1 << n, n)
                left, status = pdf["_left"].to_numpy(int).copy(), np.where(known, 0, 2)  # 1: converged, 2: given up
                cell, live = _cell(ref, cells, wrap), np.flatnonzero(known)
                while len(live):
                    at, jac = _multilinear(x[live], ref[live] - cell[live])
                    good = np.abs(np.linalg.det(jac)) > 0
                    status[live[~good]] = 2
                    live, at, jac = live[good], at[good], jac[good]
                    step = np.linalg.solve(jac, (goal[live] - at)[:, :, None])[:, :, 0] if len(live) else np.zeros((0, n))
                    ref[live] += step
                    left[live] -= 1
                    done = (step * step).sum(axis=1) < 1e-24
                    status[live[done]] = 1
                    lost = ~done & ((left[live] <= 0) | ~np.isfinite(ref[live]).all(axis=1))
                    status[live[lost]] = 2
                    live = live[~done & ~lost]
                    live = live[(_cell(ref[live], cells, wrap) == cell[live]).all(axis=1)]
                made = {key: pdf[key]} | {f"r{d}": ref[:, d] for d in range(n)} | {f"x{d}": goal[:, d] for d in range(n)}
                yield pd.DataFrame(made | {"_left": left.astype("int32"), "_status": status.astype("int32")})

        active = rows.select(key, *(F.col(c).cast("double").alias(c) for c in state), F.lit(steps).alias("_left"))
        done = None
        while True:
            index = [F.floor(f"r{d}") if w else F.least(F.greatest(F.floor(f"r{d}"), F.lit(0)), F.lit(int(c) - 1)) for d, (c, w) in enumerate(zip(cells, wrap))]
            met = active.select("*", *((F.pmod(i, F.lit(int(c))) if w else i).cast("long").alias(f"_b{d}") for d, (i, c, w) in enumerate(zip(index, cells, wrap))))
            tried = checkpoint(met.join(corners, [f"_b{d}" for d in range(n)], "left").select(*active.columns, "_x").mapInPandas(run, out))
            ended = tried.filter("_status > 0")
            done = ended if done is None else done.unionByName(ended)
            active = tried.filter("_status = 0").drop("_status")
            if active.isEmpty():
                return done.select(key, F.array(*(f"r{d}" for d in range(n))).alias("ref"), (F.col("_status") == 1).alias("ok"))


def _cell(ref: np.ndarray, cells: np.ndarray, wrap: np.ndarray) -> np.ndarray:
    return np.where(wrap, np.floor(ref), np.clip(np.floor(ref), 0, cells - 1))


def _multilinear(x: np.ndarray, xi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and Jacobians at xi in cells with corners x (rows, corners with the last axis fastest, components)."""
    n = xi.shape[1]
    at, jac = np.zeros_like(xi), np.zeros((len(xi), n, n))
    for c in range(1 << n):
        bit = np.array([c >> (n - 1 - d) & 1 for d in range(n)])
        w = np.where(bit, xi, 1 - xi)
        at += w.prod(axis=1)[:, None] * x[:, c]
        for e in range(n):
            g = w.copy()
            g[:, e] = 1.0 if bit[e] else -1.0
            jac[:, :, e] += g.prod(axis=1)[:, None] * x[:, c]
    return at, jac


def uniform_bilinear(spark: SparkSession, box: list[float], h: float, periodic: tuple[bool, ...]) -> BilinearMapping:
    """Node coordinates of a uniform box, as the simplest bilinear mesh."""
    mesh = uniform_cartesian_mesh(box, h, periodic)
    n = mesh.dim
    rows = mesh.entities(spark).select(*mesh.axes, F.array(*(F.lit(float(box[d])) + F.col(a) * h for d, a in enumerate(mesh.axes))).alias("x"))
    return BilinearMapping(mesh.num_cell, tuple(periodic[:n]), rows)
