"""SQL text that computes the same stencils, for a second engine to check against."""

from __future__ import annotations

LI = """li as (select (l_quantity * 4 + l_orderkey % 4) / 16e0 as x, (round(l_discount * 100) * 8 + l_partkey % 8) / 16e0 as y,
  (round(l_tax * 100) * 8 + l_suppkey % 8) / 16e0 as z, cast(l_partkey % 7 + 1 as double) as m, l_partkey as a, l_suppkey as b from lineitem)"""
EV = "ev as (select event_id as pid, (event_id * 7 % 160) / 16e0 as x, (user_id * 3 % 96) / 16e0 as y, (event_id * 5 % 80) / 16e0 as z from events)"
OFF = {"node": (0, 0, 0), "cell": (0.5, 0.5, 0.5), "face_i": (0, 0.5, 0.5), "face_j": (0.5, 0, 0.5), "face_k": (0.5, 0.5, 0)}
CELLS = (16, 8, 8)


def state(r: int, d: int) -> str:
    """Component (r, d) of the lineitem particles' modes."""
    return f"cast((a * {r + 1} + b * {d + 1}) % 9 - 4 as double)"


def vec(d: int) -> str:
    return f"cast((a * {d + 1}) % 5 - 2 as double)"


def ten(d: int) -> str:
    return f"cast((a + b * {d + 1}) % 5 - 2 as double)"


PHI = "(cast(i as double) * i - 2 * cast(j as double) * k + 3 * cast(k as double))"
U = ["(cast(i as double) + 2 * j - k)", "(cast(i as double) * j - 3 * cast(k as double))", "(cast(k as double) * k - cast(i as double))"]


def _weights(order: int, f: str) -> tuple[list[str], list[str]]:
    g = f"(1e0 - {f})"
    if order == 0:
        return ["1e0"], ["0e0"]
    if order == 1:
        return [g, f], ["-1e0", "1e0"]
    if order == 2:
        lo, hi = f"(5e-1 - {f})", f"(5e-1 + {f})"
        return [f"5e-1 * {lo} * {lo}", f"(75e-2 - {f} * {f})", f"5e-1 * {hi} * {hi}"], [f"-{lo}", f"-2e0 * {f}", hi]
    return (
        [f"{g} * {g} * {g} / 6e0", f"(3e0 * {f} * {f} * {f} - 6e0 * {f} * {f} + 4e0) / 6e0", f"(-3e0 * {f} * {f} * {f} + 3e0 * {f} * {f} + 3e0 * {f} + 1e0) / 6e0", f"{f} * {f} * {f} / 6e0"],
        [f"-5e-1 * {g} * {g}", f"(15e-1 * {f} * {f} - 2e0 * {f})", f"(-15e-1 * {f} * {f} + {f} + 5e-1)", f"5e-1 * {f} * {f}"],
    )


def stencil(source: str, order: int, location: str, periodic: bool = False) -> str:
    """CTEs ending in s: the source's columns, i j k, w0..2, g0..2, w, gi gj gk, di dj dk."""
    lo = -1 if order >= 2 else 0
    half = "+ 5e-1" if order in (0, 2) else ""
    xs = ", ".join(f"{c} - {float(o)} as q{d}" for d, (c, o) in enumerate(zip("xyz", OFF[location])))
    bs = ", ".join(f"floor(q{d} {half}) as p{d}" for d in range(3))
    pick = lambda d, what: "case t{0} ".format(d) + " ".join(f"when {n + lo} then {e}" for n, e in enumerate(_weights(order, f"(q{d} - p{d})")[what])) + " end"
    cols = ", ".join(f"{pick(d, 0)} as w{d}, {pick(d, 1)} as g{d}, p{d} + t{d} - q{d} as d{d}, cast(p{d} + t{d} as bigint) as r{d}" for d in range(3))
    size = [n + (0 if OFF[location][d] or periodic else 1) for d, n in enumerate(CELLS)]
    if periodic:
        idx, cut = ", ".join(f"((r{d} % {size[d]}) + {size[d]}) % {size[d]} as {a}" for d, a in enumerate("ijk")), "true"
    else:
        idx, cut = ", ".join(f"r{d} as {a}" for d, a in enumerate("ijk")), " and ".join(f"r{d} between 0 and {size[d] - 1}" for d in range(3))
    ts = ", ".join(f"(select unnest(range({lo}, {lo + order + 1})) as t{d}) as h{d}" for d in range(3))
    return f"""s0 as (select *, {xs} from {source}), s1 as (select *, {bs} from s0), s2 as (select *, {cols} from s1, {ts}),
s as (select *, {idx}, w0 * w1 * w2 as w, g0 * w1 * w2 as gi, w0 * g1 * w2 as gj, w0 * w1 * g2 as gk, d0 as di, d1 as dj, d2 as dk from s2 where {cut})"""


def p2g(order: int, location: str, sums: dict[str, str], digits: int | None = None, periodic: bool = False) -> str:
    return by("li", LI, "i, j, k", order, location, sums, digits, periodic)


def g2p(order: int, location: str, sums: dict[str, str], digits: int | None = None) -> str:
    return by("ev", EV, "pid", order, location, sums, digits)


def by(source: str, cte: str, keys: str, order: int, location: str, sums: dict[str, str], digits: int | None, periodic: bool = False) -> str:
    wrap = (lambda e: f"round(sum({e}), {digits}) + 0e0") if digits is not None else (lambda e: f"sum({e}) + 0e0")
    return f"with {cte}, {stencil(source, order, location, periodic)} select {keys}, " + ", ".join(f"{wrap(e)} as {n}" for n, e in sums.items()) + f" from s group by {keys}"
