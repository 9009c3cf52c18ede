"""Fields and grid operators: a catalogue of columns by location and label, and functors applied over
particles or entities with declared dependencies.

A catalogue entry is a DataFrame (i, j, k, value) for a location, or the particle DataFrame. With
global keys a gather between owner and copy is the equi-join itself, and a scatter-sum is the groupBy
on wrapped keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshquill.operators import transfer
from meshquill.operators.mesh import Mesh
from meshquill.operators.spline import Place, based


@dataclass(frozen=True)
class Field:
    """A column type: label, rank and extents; components are flattened row-major."""

    label: str
    dims: tuple[int, ...] = ()
    kind: T.DataType = T.DoubleType()

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        n = 1
        for d in self.dims:
            n *= d
        return n

    def struct_field(self) -> T.StructField:
        kind = T.ArrayType(self.kind, containsNull=False) if self.dims else self.kind
        return T.StructField(self.label, kind, False, {"rank": self.rank, "dims": list(self.dims)})

    def zero(self) -> Column:
        one = F.lit(0).cast(self.kind)
        return F.array_repeat(one, self.size) if self.dims else one


PhysicalPosition = lambda n=3: Field("physical_position", (n,))
LogicalPosition = lambda n=3: Field("logical_position", (n,))
SignedDistance, DistanceEstimate = Field("signed_distance"), Field("distance_estimate")
Color, VolumeId, BoundaryId, CommRank = (Field(x, (), T.IntegerType()) for x in ("color", "volume_id", "boundary_id", "comm_rank"))


@dataclass(frozen=True)
class Layout:
    location: str
    tag: Field

    @property
    def key(self) -> str:
        return f"{self.location.title().replace('_', '')}_{self.tag.label}"


def particle_schema(*tags: Field) -> T.StructType:
    """The schema of a particle list: pid and its fields."""
    return T.StructType([T.StructField("pid", T.LongType(), False), *(t.struct_field() for t in tags)])


class FieldCatalog:
    """Fields of a mesh by "<Location>_<label>". Adding twice keeps the first."""

    def __init__(self, mesh: Mesh, spark: SparkSession):
        self.mesh, self.spark, self._rows = mesh, spark, {}
        if mesh.kind in ("uniform", "adaptive"):
            nodes = mesh.nodes(spark).select(*mesh.axes, F.array(*"xyz"[: mesh.dim]).alias("physical_position"))
            self._rows[Layout("node", PhysicalPosition(mesh.dim)).key] = nodes

    def add(self, layout: Layout, rows: DataFrame | None = None) -> None:
        if layout.key not in self._rows:
            self._rows[layout.key] = rows if rows is not None else create_array(self.spark, self.mesh, layout)

    def array(self, layout: Layout) -> DataFrame:
        if layout.key not in self._rows:
            raise RuntimeError(f"{layout.key} field doesn't exist")
        return self._rows[layout.key]

    view = array

    def put(self, layout: Layout, rows: DataFrame) -> None:
        self.array(layout)
        self._rows[layout.key] = rows

    def scatter(self, layout: Layout, contributions: DataFrame) -> DataFrame:
        """Contributions at any index, copies included, summed to their owners."""
        return scatter_sum(self.mesh, layout.location, contributions, [layout.tag.label])

    def gather(self, layout: Layout, places: DataFrame) -> DataFrame:
        """The field's values at places, which may be copies beyond a periodic edge."""
        return gather_copies(self.mesh, layout.location, self.array(layout), places)


def create_array(spark: SparkSession, mesh: Mesh, layout: Layout) -> DataFrame:
    return mesh.entities(spark, layout.location).withColumn(layout.tag.label, layout.tag.zero())


def scatter_sum(mesh: Mesh, location: str, rows: DataFrame, values: list[str]) -> DataFrame:
    wrapped = rows.select(*(mesh.wrapped(d, location, F.col(a)).alias(a) for d, a in enumerate(mesh.axes)), *values)
    inside = mesh.inside(location)
    wrapped = wrapped if inside is None else wrapped.filter(inside)
    return wrapped.groupBy(*mesh.axes).agg(*(F.sum(v).alias(v) for v in values))


def gather_copies(mesh: Mesh, location: str, owned: DataFrame, places: DataFrame) -> DataFrame:
    """places (i, j, k, any integers) with the values of the entity each wraps to."""
    own = owned.select(*(F.col(a).alias(f"_o{a}") for a in mesh.axes), *(c for c in owned.columns if c not in mesh.axes))
    same = [mesh.wrapped(d, location, F.col(a)) == F.col(f"_o{a}") for d, a in enumerate(mesh.axes)]
    test = same[0]
    for x in same[1:]:
        test = test & x
    return places.join(own, test).drop(*(f"_o{a}" for a in mesh.axes))


@dataclass
class GridOperator:
    """gather: read at stencil entities; scatter: zeroed, then summed; local: read and written in place."""

    mesh: Mesh
    gather: list[Layout] = field(default_factory=list)
    scatter: list[Layout] = field(default_factory=list)
    local: list[Layout] = field(default_factory=list)

    def setup(self, catalog: FieldCatalog) -> None:
        for layout in [*self.gather, *self.scatter, *self.local]:
            catalog.add(layout)

    def apply_particles(
        self, catalog: FieldCatalog, particles: DataFrame, location: str, order: int, fn: Callable[[Place], dict[str, str]], members: tuple[str, ...] = ("value",), key: str = "pid"
    ) -> DataFrame:
        """fn(place) names values at one stencil entity, as SQL text over particle columns and a Place that reads the
        gathered fields of the location. Those named like a scatter field's label are summed into that field (untouched
        entities get 0), the others by particle, as columns of the result."""
        both = None
        for x in self.gather:
            if x.location == location:
                both = catalog.array(x) if both is None else both.join(catalog.array(x), list(self.mesh.axes))
        names = list(fn(based(particles, self.mesh, location, order, [], members)[1][0][1]))
        sums = {n: lambda p, n=n: fn(p)[n] for n in names}
        keep = [c for c in particles.columns]
        to_grid = {x.tag.label: x for x in self.scatter if x.tag.label in sums}
        if to_grid:
            # one shuffle for all fields that are summed at this location
            summed = transfer.scatter(particles, self.mesh, location, order, {n: sums[n] for n in to_grid}, keep, members, field=both)
            summed = self.mesh.entities(catalog.spark, location).join(summed, list(self.mesh.axes), "left")
            for n, x in to_grid.items():
                catalog.put(x, summed.select(*self.mesh.axes, F.coalesce(n, F.lit(0.0)).alias(n)))
        rest = {n: e for n, e in sums.items() if n not in to_grid}
        if not rest:
            return particles
        rows, places = transfer.placed(particles, self.mesh, location, order, keep, members, field=both)
        made = {n: transfer.total(e, places).alias(n) for n, e in rest.items()}
        return rows.select(*(c for c in keep if c not in made), *made.values())

    def apply_entities(self, catalog: FieldCatalog, location: str, fn: Callable[[], dict[str, Column]]) -> DataFrame:
        """fn() gives new values of local or scatter fields at a location from the fields there."""
        rows = self.mesh.entities(catalog.spark, location)
        for x in dict.fromkeys([*self.gather, *self.local]):
            if x.location == location:
                rows = rows.join(catalog.array(x), list(self.mesh.axes))
        out = rows.select(*self.mesh.axes, *(e.alias(n) for n, e in fn().items()))
        for x in [*self.local, *self.scatter]:
            if x.location == location and x.tag.label in out.columns:
                catalog.put(x, out.select(*self.mesh.axes, x.tag.label))
        return out


def create_grid_operator(mesh: Mesh, gather=(), scatter=(), local=()) -> GridOperator:
    return GridOperator(mesh, list(gather), list(scatter), list(local))
