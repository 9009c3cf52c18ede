"""Level sets: distance to the nearest particle, and Hopf-Lax redistancing.

Nearest particle: entities first look in the 27 bins of a cell's size around them. Those that find none near
enough go down a pyramid of bins, each level's twice as wide as the one below, that holds a bounding box per
occupied bin: at every level an entity keeps the bins that may be nearer than what another is sure to hold,
and at the lowest it looks at the particles in those. So a far entity meets few particles, and each entity
finds its nearest one, however far.

Redistancing has one definition at every size of mesh. The surface is marked by the points where grid lines
cross it; a node farther from them than the reach (the halo's width) gets that distance, found as above; a
nearer one gets the radius of the ball round it that just touches the zero level, by a secant search that
looks at no node beyond its reach. Those searches run on tiles with a margin as wide as the reach, so how the
field is cut into tiles changes nothing, and only tiles that hold such nodes are dealt out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshquill.operators.mesh import Mesh
from meshquill.sources.shared import checkpoint

TILE = 32


@dataclass(frozen=True)
class LevelSet:
    """Parameters, from a configuration's `level_set` block."""

    secant_tol: float = 0.25
    max_secant_iter: int = 10
    num_random_guess: int = 5
    projection_tol: float = 1e-4
    max_projection_iter: int = 200

    @classmethod
    def of(cls, config: dict) -> LevelSet:
        p = config.get("level_set", {})
        names = {"secant_tol": "redistance_secant_tol", "max_secant_iter": "redistance_max_secant_iter", "num_random_guess": "redistance_num_random_guess", "projection_tol": "redistance_projection_tol", "max_projection_iter": "redistance_max_projection_iter"}
        return cls(**{k: p[v] for k, v in names.items() if v in p})


def particle_radius(config: dict, mesh: Mesh) -> float:
    return config.get("particle_level_set", {}).get("particle_radius", 0.5) * mesh.cell_size[0]


def of_color(particles: DataFrame, color: int) -> DataFrame:
    """Particles of a colour; a negative one means all."""
    return particles if color < 0 else particles.filter(F.col("color") == color)


def color_count(particles: DataFrame, color: int) -> int:
    return of_color(particles, color).count()


def estimate_distance(particles: DataFrame, mesh: Mesh, location: str, radius: float) -> DataFrame:
    """i, j, k, distance_estimate: single-precision distance to the nearest particle less the radius;
    without particles, the halo width."""
    spark = particles.sparkSession
    at = mesh.coordinates(location)
    entities = mesh.entities(spark, location).select(*mesh.axes, *(c.alias(f"e{d}") for d, c in enumerate(at)))
    points = particles.select(*(F.col(c).cast("double").alias(f"p{d}") for d, c in enumerate("xyz"))).dropna()
    if points.isEmpty():
        return entities.select(*mesh.axes, F.lit(float(mesh.cell_size[0] * mesh.halo)).alias("distance_estimate"))
    near = nearest(points, entities, list(mesh.axes), mesh.low, float(mesh.cell_size[0]), "float")
    return near.select(*mesh.axes, (F.col("near") - F.lit(radius).cast("float")).cast("double").alias("distance_estimate"))


def nearest(points: DataFrame, entities: DataFrame, keys: list[str], low: tuple[float, ...], size: float, kind: str = "double", place: bool = False) -> DataFrame:
    """keys and near, the distance of every entity (keys, e0, e1, e2) to the nearest of the points (p0, p1, p2; one
    at least), in arithmetic of that kind. place: with that point too (of equally near ones the first by coordinates)."""
    bins, at = ["b0", "b1", "b2"], [*keys, "e0", "e1", "e2"]
    key = lambda c, d: F.floor((F.col(c) - low[d]) / size).cast("long")
    diff = [(F.col(f"p{d}").cast(kind) - F.col(f"e{d}").cast(kind)).cast(kind) for d in range(3)]
    distance = F.sqrt((diff[0] * diff[0] + diff[1] * diff[1] + diff[2] * diff[2]).cast(kind)).cast(kind)
    least = F.min(F.struct(distance.alias("near"), "p0", "p1", "p2")).alias("best") if place else F.min(distance).alias("near")
    found_columns = [f"best.{c}" for c in ("near", "p0", "p1", "p2")] if place else ["near"]
    leaves = checkpoint(points.select("p0", "p1", "p2", *(key(f"p{d}", d).alias(f"b{d}") for d in range(3))))
    around = entities.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(26))))
    around = around.select(*keys, "e0", "e1", "e2", *((key(f"e{d}", d) + F.expr(f"(n div {3**d}) % 3 - 1")).alias(f"b{d}") for d in range(3)))
    close = around.join(leaves, bins).groupBy(*keys).agg(least).select(*keys, *found_columns).filter(F.col("near") <= size * 0.999)
    tried = checkpoint(entities.select(*at).join(close, keys, "left"))
    done, left = tried.filter("near IS NOT NULL").select(*close.columns), tried.filter("near IS NULL").select(*at)
    if left.isEmpty():
        return done
    levels = [checkpoint(leaves.groupBy(*bins).agg(*(F.min(f"p{d}").alias(f"lo{d}") for d in range(3)), *(F.max(f"p{d}").alias(f"hi{d}") for d in range(3))))]
    ends = levels[0].agg(*(f(b) for b in bins for f in (F.min, F.max))).first()
    while any((ends[2 * d + 1] >> (len(levels) - 1)) - (ends[2 * d] >> (len(levels) - 1)) > 1 for d in range(3)):
        up = levels[-1].select(*(F.shiftright(b, 1).alias(b) for b in bins), *(f"{e}{d}" for e in ("lo", "hi") for d in range(3)))
        levels.append(up.groupBy(*bins).agg(*(F.min(f"lo{d}").alias(f"lo{d}") for d in range(3)), *(F.max(f"hi{d}").alias(f"hi{d}") for d in range(3))))
        if len(levels) % 4 == 0:
            levels[-1] = checkpoint(levels[-1])
    top = len(levels) - 1
    tops = [range(ends[2 * d] >> top, (ends[2 * d + 1] >> top) + 1) for d in range(3)]  # two a dimension at most
    kept = left
    for d in range(3):
        kept = kept.withColumn(f"b{d}", F.explode(F.array(*(F.lit(x).cast("long") for x in tops[d]))))
    far = lambda d, least: F.greatest(F.col(f"lo{d}") - F.col(f"e{d}"), F.col(f"e{d}") - F.col(f"hi{d}"), F.lit(0.0)) if least else F.greatest(F.abs(F.col(f"lo{d}") - F.col(f"e{d}")), F.abs(F.col(f"hi{d}") - F.col(f"e{d}")))
    square = lambda least: sum((far(d, least) * far(d, least) for d in (1, 2)), far(0, least) * far(0, least))
    for n in range(top, -1, -1):
        met = kept.join(levels[n], bins).select(*at, *bins, square(True).alias("lowest"), square(False).alias("highest"))
        sure = F.min("highest").over(Window.partitionBy(*keys))
        kept = met.withColumn("sure", sure).filter(F.col("lowest") <= F.col("sure") * (1 + 1e-5)).select(*at, *bins)
        if n:
            for d in range(3):
                kept = kept.withColumn(f"b{d}", F.explode(F.array(F.col(f"b{d}") * 2, F.col(f"b{d}") * 2 + 1)))
        if n % 4 == 0:
            kept = checkpoint(kept)
    found = kept.join(leaves, bins).groupBy(*keys).agg(least).select(*keys, *found_columns)
    return done.unionByName(checkpoint(found))


def crossings(field: DataFrame, mesh: Mesh, value: str) -> DataFrame:
    """p0, p1, p2, in cells from the mesh's low corner: where a grid line's linear interpolant is zero."""
    ahead = F.array(*(F.struct(F.lit(n).alias("n"), *((F.col(a) - (1 if n == d + 1 else 0)).alias(a) for d, a in enumerate("ijk"))) for n in range(4)))
    rows = field.select(F.col(value).alias("_v"), F.explode(ahead).alias("_p")).select("_v", "_p.n", *(mesh.wrapped(d, "node", F.col(f"_p.{a}")).cast("long").alias(a) for d, a in enumerate("ijk")))
    ends = rows.groupBy("i", "j", "k").agg(*(F.max(F.when(F.col("n") == n, F.col("_v"))).alias(f"v{n}") for n in range(4))).filter("v0 IS NOT NULL")
    cut = lambda n: F.col("v0") * F.col(f"v{n}") < 0
    along = lambda n: F.col("v0") / (F.col("v0") - F.col(f"v{n}"))
    places = [F.when(F.col("v0") == 0, F.array(*(F.col(a).cast("double") for a in "ijk")))]
    places += [F.when(cut(d + 1), F.array(*(F.col(a) + (along(d + 1) if e == d else F.lit(0.0)) for e, a in enumerate("ijk")))) for d in range(3)]
    rows = ends.select(F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("p")).select(*(F.col("p")[d].alias(f"p{d}") for d in range(3)))
    for d, (n, w) in enumerate(zip(mesh.num_cell, mesh.periodic)):
        if w:  # the images within half a period of the mesh
            rows = rows.withColumn(f"p{d}", F.expr(f"explode(filter(array(p{d} - {n}, p{d}, p{d} + {n}), x -> x BETWEEN {-0.5 * n} AND {1.5 * n}))"))
    return rows


class Piece:
    """A dense part of a field. Places are in cells from the mesh's low corner; first is the part's lowest index,
    last the mesh's highest in dimensions that don't wrap."""

    def __init__(self, phi: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.phi, self.first, self.last = phi, first, last

    def clamp(self, y: np.ndarray) -> np.ndarray:
        return np.clip(y, np.where(np.isfinite(self.last), 0.001, -np.inf), self.last - 0.001)

    def at(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The multilinear interpolant and its gradient."""
        b = np.floor(y).astype(np.int64)
        f = y - b
        n = b - self.first
        value, slope = np.zeros(len(y)), np.zeros((len(y), 3))
        for c in range(8):
            bit = np.array([c >> 2 & 1, c >> 1 & 1, c & 1])
            v = self.phi[tuple((n + bit).T)]
            w = np.where(bit, f, 1 - f)
            value += w[:, 0] * w[:, 1] * w[:, 2] * v
            for d in range(3):
                x, y2 = (e for e in range(3) if e != d)
                slope[:, d] += (1.0 if bit[d] else -1.0) * w[:, x] * w[:, y2] * v
        return value, slope


def _unit(ids: np.ndarray, *salts: int) -> np.ndarray:
    """In [0, 1), by a hash of the node's number: no matter which task draws."""
    x = ids.astype(np.uint64)
    for salt in salts:
        x = (x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)) / float(1 << 53)


def _starts(ids: np.ndarray, x: np.ndarray, t: np.ndarray, n: int, turn: int) -> np.ndarray:
    """n places a node, drawn evenly from its ball."""
    out = np.empty((n, *x.shape))
    for k in range(n):
        r, high, round_ = (_unit(ids, turn, k, e) for e in range(3))
        up, angle = 2 * high - 1, 2 * np.pi * round_
        flat = np.sqrt(1 - up * up)
        out[k] = x + (t * np.cbrt(r))[:, None] * np.stack((flat * np.cos(angle), flat * np.sin(angle), up), 1)
    return out


def _lowest(piece: Piece, sign, x, t, starts, p: LevelSet, h: float) -> tuple[np.ndarray, np.ndarray]:
    """The least of sign * field over each ball, by projected descent from several starts (starts, nodes, 3) at once."""
    n = len(starts)
    y = starts.reshape(-1, 3)
    s, centre, r = np.tile(sign, n), np.tile(x, (n, 1)), np.tile(t, n)
    live = np.arange(len(y))

    def inside(z, of):
        off = z - centre[of]
        size = np.sqrt((off * off).sum(axis=1))
        shrink = np.minimum(1.0, r[of] / np.maximum(size, 1e-300))
        return piece.clamp(centre[of] + off * shrink[:, None])

    y = inside(y, live)
    for _ in range(p.max_projection_iter):
        if not len(live):
            break
        _, slope = piece.at(y[live])
        new = inside(y[live] - (s[live] / h)[:, None] * slope, live)
        still = ((new - y[live]) ** 2).sum(axis=1) >= p.projection_tol**2 * np.maximum((new * new).sum(axis=1), 1e-300)
        y[live] = new
        live = live[still]
    value = (s * piece.at(y)[0]).reshape(n, -1)
    best = value.argmin(axis=0)
    pick = np.arange(value.shape[1])
    return value[best, pick], y.reshape(n, -1, 3)[best, pick]


def ball_radius(piece: Piece, ids: np.ndarray, x: np.ndarray, phi: np.ndarray, near: np.ndarray, foot: np.ndarray, p: LevelSet, h: float, reach: float) -> np.ndarray:
    """Radius, in cells, of the ball round each x that just touches the zero level: a secant search from the
    distance of the surface's nearest marked point, foot, never beyond the reach. Each ball is searched from
    that point, from where the last one's lowest value was and from random places."""
    sign = np.copysign(1.0, phi)
    tol = h * p.secant_tol
    t, t_old, value_old = np.minimum(near, reach), np.zeros(len(x)), np.abs(phi)
    low, high = np.zeros(len(x)), np.full(len(x), np.inf)  # radii known to be too small, and too large
    y, live = x.copy(), np.flatnonzero(value_old >= 1e-12 * h)
    t[value_old < 1e-12 * h] = 0.0
    for turn in range(p.max_secant_iter + 1):
        if not len(live):
            break
        starts = np.concatenate((foot[live][None], y[live][None], _starts(ids[live], x[live], t[live], p.num_random_guess, turn)))
        value, y[live] = _lowest(piece, sign[live], x[live], t[live], starts, p, h)
        on = np.abs(value) >= tol
        live, value = live[on], value[on]
        now, under = t[live], value > 0
        low[live] = np.where(under, np.maximum(low[live], now), low[live])
        high[live] = np.where(under, high[live], np.minimum(high[live], now))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = now + value * (now - t_old[live]) / (value_old[live] - value)
        t_old[live], value_old[live] = now, value
        # a step out of what is known halves the range, or goes a cell further where its end is not known
        bounded = np.isfinite(high[live])
        half = np.where(bounded, (low[live] + np.where(bounded, high[live], 0.0)) / 2, now + 1)
        t[live] = np.minimum(np.where((new > low[live]) & (new < high[live]) & (new < now + 5), new, half), reach)
        live = live[np.abs(t[live] - t_old[live]) > 1e-12]  # at the reach for good, or as near as can be told
    return t


def _distances(field: DataFrame, mesh: Mesh, value: str, targets: Column, p: LevelSet, tile: int) -> DataFrame:
    """i, j, k, out: the distance at the targets."""
    n, h, wrap = np.array(mesh.num_cell), mesh.cell_size[0], np.array(mesh.periodic)
    extent = np.array(mesh.extent("node"))
    reach = float(max(1, mesh.halo))
    margin = int(reach) + 2
    points = checkpoint(crossings(field, mesh, value))
    nodes = field.filter(targets).select("i", "j", "k", *(F.col(a).cast("double").alias(f"e{d}") for d, a in enumerate("ijk")))
    if points.isEmpty():  # no surface: as far as the mesh is wide
        diagonal = float(h * np.sqrt((n * n).sum()))
        return field.filter(targets).select("i", "j", "k", F.when(F.col(value) < 0, -diagonal).otherwise(diagonal).alias("out"))
    near = nearest(points, nodes, ["i", "j", "k"], (0.0, 0.0, 0.0), 1.0, place=True)
    rows = checkpoint(field.select("i", "j", "k", F.col(value).cast("double").alias("v")).join(near, ["i", "j", "k"], "left"))
    far = rows.filter(F.col("near") > reach).select("i", "j", "k", (F.when(F.col("v") < 0, -h).otherwise(h) * F.col("near")).alias("out"))
    rows = rows.withColumn("near", F.when(F.col("near") <= reach, F.col("near")))
    active = rows.filter("near IS NOT NULL").select(*(F.floor(F.col(a) / tile).alias(f"t{a}") for a in "ijk")).distinct()
    # every node goes to the tiles whose margin holds it, under its index there (beyond a periodic edge: shifted)
    for d, a in enumerate("ijk"):
        shifts = f"array({a}, {a} - {n[d]}L, {a} + {n[d]}L)" if wrap[d] else f"array({a})"
        held = f"flatten(transform({shifts}, s -> transform(sequence(floor((s - {margin}) / {tile}), floor((s + {margin}) / {tile})), t -> named_struct('s', s, 't', t))))"
        rows = rows.withColumn(f"h{a}", F.expr(f"explode(filter({held}, x -> x.t BETWEEN 0 AND {int((extent[d] - 1) // tile)}))"))
    rows = rows.select("i", "j", "k", "v", "near", "p0", "p1", "p2", *(F.col(f"h{a}.s").alias(f"s{a}") for a in "ijk"), *(F.col(f"h{a}.t").alias(f"t{a}") for a in "ijk")).join(active, ["ti", "tj", "tk"], "left_semi")
    last = np.where(wrap, np.inf, extent - 1.0)

    def run_tile(key, pdf):
        s = pdf[["si", "sj", "sk"]].to_numpy()
        first = s.min(axis=0)
        phi = np.zeros(s.max(axis=0) - first + 1)
        phi[tuple((s - first).T)] = pdf.v
        ijk = pdf[["i", "j", "k"]].to_numpy()
        begin = np.array(key) * tile
        own = pdf.near.notna().to_numpy() & (s >= begin).all(axis=1) & (s < begin + tile).all(axis=1) & (s == ijk).all(axis=1)
        at, v, out = ijk[own], pdf.v.to_numpy(float)[own], np.zeros(int(own.sum()))
        ids = at[:, 0] + extent[0] * (at[:, 1] + extent[1] * at[:, 2])
        piece, near, foot = Piece(phi, first, last), pdf.near.to_numpy(float)[own], pdf[["p0", "p1", "p2"]].to_numpy(float)[own]
        for lo in range(0, len(at), 2048):
            c = slice(lo, lo + 2048)
            out[c] = np.copysign(h, v[c]) * ball_radius(piece, ids[c], at[c].astype(float), v[c], near[c], foot[c], p, h, reach)
        return pd.DataFrame({"i": at[:, 0], "j": at[:, 1], "k": at[:, 2], "out": out})

    return rows.groupBy("ti", "tj", "tk").applyInPandas(run_tile, "i long, j long, k long, out double").unionByName(far)


def interpolate_odd(coarse: DataFrame, mesh: Mesh) -> DataFrame:
    """Entities with an odd index get the mean of their 2, 4 or 8 even neighbours, the others their own
    value: i, j, k, out from even entities (i, j, k, out)."""
    offs = F.explode(F.sequence(F.lit(0), F.lit(26)))
    rows = coarse.select("i", "j", "k", "out", offs.alias("n"))
    at = [F.col(a) + F.expr(f"(n div {3**d}) % 3 - 1") for d, a in enumerate("ijk")]
    at = [F.pmod(c, F.lit(s)) if w else c for c, s, w in zip(at, mesh.num_cell, mesh.periodic)]
    rows = rows.select(*(c.cast("long").alias(a) for a, c in zip("ijk", at)), "out")
    for a, e, w in zip("ijk", mesh.extent("node"), mesh.periodic):
        rows = rows if w else rows.filter(F.col(a).between(0, e - 1))
    # a neighbour reaches an entity only along its odd dimensions: even ones must match exactly
    return rows.groupBy("i", "j", "k").agg(F.avg("out").alias("out"))


def redistance(field: DataFrame, mesh: Mesh, p: LevelSet, value: str = "phi", tile: int = TILE) -> DataFrame:
    """i, j, k, signed_distance: even entities first, odd ones between them, then the narrow band again. tile is
    how many nodes a task's cube is wide; it changes no result."""
    even = (F.col("i") % 2 == 0) & (F.col("j") % 2 == 0) & (F.col("k") % 2 == 0)
    coarse = checkpoint(_distances(field, mesh, value, even, p, tile))
    between = checkpoint(interpolate_odd(coarse, mesh).withColumnRenamed("out", "est"))
    band = F.abs("est") < mesh.cell_size[0] * mesh.halo
    fine = _distances(between, mesh, "est", band, p, tile)
    return between.join(fine, ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("out", "est").alias("signed_distance"))
