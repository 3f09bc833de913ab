"""SQL of boxes with six numbers: cell matrix, fractional coordinates, whole-box displacements."""

from __future__ import annotations

import math


def cell_numbers(a: float, b: float, c: float, alpha: float = 90.0, beta: float = 90.0, gamma: float = 90.0) -> list[str]:
    if alpha == beta == gamma == 90.0:
        numbers = (a, 0.0, b, 0.0, 0.0, c)
    else:
        ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
        sg = math.sin(math.radians(gamma))
        cx, cy = c * cb, c * (ca - cb * cg) / sg
        numbers = (a, b * cg, b * sg, cx, cy, math.sqrt(c * c - cx * cx - cy * cy))
    return [f"CAST({x!r} AS DOUBLE)" for x in numbers]


def fraction_sql(dx: str, dy: str, dz: str, cell: list[str]) -> list[str]:
    ax, bx, by, cx, cy, cz = cell
    fz = f"(({dz}) / {cz})"
    fy = f"((({dy}) - {fz} * {cy}) / {by})"
    return [f"((({dx}) - {fy} * {bx} - {fz} * {cx}) / {ax})", fy, fz]


def boxes_sql(x: str, y: str, z: str, cell: list[str]) -> list[str]:
    ax, bx, by, cx, cy, cz = cell
    x, y, z = (f"({c})" for c in (x, y, z))
    return [f"({x} * {ax} + {y} * {bx} + {z} * {cx})", f"({y} * {by} + {z} * {cy})", f"({z} * {cz})"]
