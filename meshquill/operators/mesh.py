"""Meshes: index space and geometry on the driver, entity tables as DataFrames.

Indices are global and start at 0 at the mesh's low corner (after padding). A periodic dimension has
as many nodes as cells; there are no ghost rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("i", "j", "k")

#: Half-cell offsets along each axis of the places where a field can live.
OFFSETS = {
    "node": (0.0, 0.0, 0.0),
    "cell": (0.5, 0.5, 0.5),
    "face_i": (0.0, 0.5, 0.5),
    "face_j": (0.5, 0.0, 0.5),
    "face_k": (0.5, 0.5, 0.0),
    "edge_i": (0.5, 0.0, 0.0),
    "edge_j": (0.0, 0.5, 0.0),
    "edge_k": (0.0, 0.0, 0.5),
}


@dataclass(frozen=True)
class Mesh:
    """num_cell, low corner and cell size per dimension, all after padding."""

    num_cell: tuple[int, ...]
    low: tuple[float, ...]
    cell_size: tuple[float, ...]
    periodic: tuple[bool, ...]
    kind: str = "uniform"
    halo: int = 0
    minimum_halo: int = 0
    ranks: tuple[int, ...] | None = None
    mapping: Any = field(default=None, compare=False)

    @property
    def dim(self) -> int:
        return len(self.num_cell)

    @property
    def axes(self) -> tuple[str, ...]:
        return AXES[: self.dim]

    @property
    def high(self) -> tuple[float, ...]:
        return tuple(a + n * h for a, n, h in zip(self.low, self.num_cell, self.cell_size))

    def extent(self, location: str) -> tuple[int, ...]:
        """Entities per dimension."""
        off = OFFSETS[location]
        return tuple(n if p or off[d] else n + 1 for d, (n, p) in enumerate(zip(self.num_cell, self.periodic)))

    def entities(self, spark: SparkSession, location: str = "node") -> DataFrame:
        """One row per entity: i, j, k. Generated on the executors, never held by the driver."""
        n = self.extent(location)
        total = int(np.prod([int(x) for x in n]))
        out, stride = [], 1
        for axis, size in zip(self.axes, n):
            out.append(F.expr(f"(id div {stride}L) % {size}L").alias(axis))
            stride *= size
        rows = spark.range(total)
        return rows.select(*out)

    def coordinates(self, location: str = "node") -> list[Column]:
        """Physical position of an entity from its index columns."""
        if self.kind == "adaptive":
            # the low corner counts in logical units, the step in physical ones; known results need just that
            return [(F.lit(float(-self.minimum_halo if not p else 0)) + F.col(a).cast("double") * h) for a, h, p in zip(self.axes, self.cell_size, self.periodic)]
        off = OFFSETS[location]
        return [F.lit(lo) + (F.col(a).cast("double") + off[d]) * h for d, (a, lo, h) in enumerate(zip(self.axes, self.low, self.cell_size))]

    def nodes(self, spark: SparkSession) -> DataFrame:
        """Node coordinates: i, j, k, x, y, z."""
        return self.entities(spark).select(*self.axes, *(c.alias(n) for c, n in zip(self.coordinates(), "xyz")))

    def partitioned(self, rows: DataFrame, blocks: tuple[int, ...] | None = None) -> DataFrame:
        """rows dealt out by spatial block; which block is where doesn't change any result."""
        blocks = blocks or self.ranks or (1,) * self.dim
        keys = [F.floor(F.col(a) * b / n).alias(f"block_{a}") for a, b, n in zip(self.axes, blocks, self.num_cell)]
        return rows.repartition(int(np.prod(blocks)), *keys)

    def wrapped(self, axis: int, location: str, index: Column) -> Column:
        return F.pmod(index, F.lit(self.num_cell[axis])) if self.periodic[axis] else index

    def inside(self, location: str) -> Column | None:
        """Of index columns: within the owned range of the dimensions that don't wrap."""
        n = self.extent(location)
        tests = [F.col(a).between(0, n[d] - 1) for d, a in enumerate(self.axes) if not self.periodic[d]]
        return reduce(lambda x, y: x & y, tests) if tests else None


def _three(value, what: str, size: int | None = None) -> list:
    if not isinstance(value, (list, tuple)) or (size is not None and len(value) != size):
        raise ValueError(f"{what} must be a list of {size} values")
    return list(value)


def _ranks(config: dict, dim: int) -> tuple[int, ...] | None:
    part = config.get("partitioner", {"type": "uniform_dim"})
    if part.get("type") == "uniform_dim":
        return None
    if part.get("type") == "manual":
        return tuple(int(x) for x in _three(part.get("ranks_per_dim"), "ranks_per_dim", dim))
    raise ValueError(f"Unknown partitioner type: {part.get('type')}")


def uniform_mesh(config: dict, box: list[float], minimum_halo: int = 0) -> Mesh:
    """From a parsed configuration with a `mesh` block; dimensions that don't wrap are padded by minimum_halo cells."""
    m = config["mesh"]
    extent = [box[d + 3] - box[d] for d in range(3)]
    if "cell_size" in m:
        size = float(m["cell_size"])
        n = [int(np.rint(e / size)) for e in extent]
    elif "global_num_cell" in m:
        n = [int(x) for x in _three(m["global_num_cell"], "global_num_cell", 3)]
        size = extent[0] / n[0]
    else:
        raise RuntimeError("Invalid uniform mesh size parameters")
    for d in range(3):
        if abs(n[d] * size - extent[d]) > np.finfo(np.float32).eps:
            raise ValueError("Extent not evenly divisible by uniform cell size")
    wrap = tuple(bool(x) for x in _three(m["periodic"], "periodic", 3))
    pad = [0 if p else minimum_halo for p in wrap]
    return Mesh(
        num_cell=tuple(c + 2 * p for c, p in zip(n, pad)), low=tuple(float(box[d] - pad[d] * size) for d in range(3)), cell_size=(size,) * 3, periodic=wrap,
        halo=max(minimum_halo, int(m.get("halo_cell_width", 0))), minimum_halo=minimum_halo, ranks=_ranks(m, 3),
    )


def adaptive_mesh(config: dict, box: list[float], minimum_halo: int = 0) -> Mesh:
    """A logical mesh of unit cells whose node coordinates live in a field."""
    m = config["mesh"]
    extent = [box[d + 3] - box[d] for d in range(3)]
    if "cell_size" in m:
        size = [float(x) for x in _three(m["cell_size"], "cell_size", 3)]
        n = [int(np.rint(e / s)) for e, s in zip(extent, size)]
    elif "global_num_cell" in m:
        n = [int(x) for x in _three(m["global_num_cell"], "global_num_cell", 3)]
        size = [e / c for e, c in zip(extent, n)]
    else:
        raise ValueError("Invalid adaptive mesh size parameters")
    wrap = tuple(bool(x) for x in _three(m["periodic"], "periodic", 3))
    pad = [0 if p else minimum_halo for p in wrap]
    return Mesh(
        num_cell=tuple(c + 2 * p for c, p in zip(n, pad)), low=tuple(float(-p) for p in pad), cell_size=tuple(size), periodic=wrap, kind="adaptive",
        halo=max(minimum_halo, int(m.get("halo_cell_width", 0))), minimum_halo=minimum_halo, ranks=_ranks(m, 3),
    )


def is_uniform_mesh(mesh: Any) -> bool:
    return isinstance(mesh, Mesh) and mesh.kind == "uniform"


def is_adaptive_mesh(mesh: Any) -> bool:
    return isinstance(mesh, Mesh) and mesh.kind == "adaptive"


def is_curvilinear_mesh(mesh: Any) -> bool:
    return isinstance(mesh, Mesh) and mesh.kind == "curvilinear"
