"""Particles that arrive as a stream, deposited on the grid with the batch operators.

The stencil is a narrow step and the sum an ordinary streaming aggregation, so each micro-batch is
combined map-side and only touched entities enter the state. With a time column and a watermark the
sums are by window, and state is dropped as windows close; without one the state holds one row per
entity of the mesh, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshquill.operators.mesh import Mesh
from meshquill.operators.spline import stencil


def deposit(stream: DataFrame, mesh: Mesh, location: str, order: int, value: str, time: str | None = None, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Running sums of w * value by entity (and window): i, j, k, out. For output modes complete or
    update; with a time column append too."""
    if time is None:
        rows = stencil(stream, mesh, location, order, [value])
        return rows.groupBy(*mesh.axes).agg(F.sum(F.col("w") * F.col(value)).alias("out"))
    rows = stencil(stream.withWatermark(time, late), mesh, location, order, [value, time])
    return rows.groupBy(F.window(time, window).alias("window"), *mesh.axes).agg(F.sum(F.col("w") * F.col(value)).alias("out"))
