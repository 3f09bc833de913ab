"""Periodic-box arithmetic as Column expressions (all JVM-side, whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

RIGHT_ANGLE_TOLERANCE = 1e-4  # degrees; fixed value


class Vector(NamedTuple):
    x: Column
    y: Column
    z: Column

    def minus(self, other: "Vector") -> "Vector":
        return Vector(*(a - b for a, b in zip(self, other)))

    def plus(self, other: "Vector") -> "Vector":
        return Vector(*(a + b for a, b in zip(self, other)))

    def scaled(self, factor: Column | float) -> "Vector":
        return Vector(*(a * factor for a in self))

    def dot(self, other: "Vector") -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def norm2(self) -> Column:
        return self.dot(self)

    def norm(self) -> Column:
        return F.sqrt(self.norm2())


def vector(x: str, y: str, z: str) -> Vector:
    return Vector(F.col(x), F.col(y), F.col(z))


def fields(parent: str | Column, names: tuple[str, str, str] = ("x", "y", "z")) -> Vector:
    """The three components of a struct column."""
    col = F.col(parent) if isinstance(parent, str) else parent
    return Vector(*(col[n] for n in names))


def image_shift(d: Column, length: Column) -> Column:
    """Whole boxes to subtract from ``d``; ties go to the even image."""
    return F.rint(d / length)


def minimum_image(d: Vector, lengths: Vector) -> Vector:
    """Shortest periodic image of a displacement in an orthorhombic box."""
    return Vector(*(c - l * image_shift(c, l) for c, l in zip(d, lengths)))


class Cell(NamedTuple):
    """Lower-triangular cell matrix: a=(ax,0,0), b=(bx,by,0), c=(cx,cy,cz)."""

    ax: Column
    bx: Column
    by: Column
    cx: Column
    cy: Column
    cz: Column


def cell_matrix(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Cell:
    """Cell rows from lengths and angles in degrees."""
    ca, cb, cg = (F.cos(F.radians(v)) for v in (alpha, beta, gamma))
    sg = F.sin(F.radians(gamma))
    cx = c * cb
    cy = c * (ca - cb * cg) / sg
    cz = F.sqrt(c * c - cx * cx - cy * cy)
    return Cell(a, b * cg, b * sg, cx, cy, cz)


def fractional(d: Vector, cell: Cell) -> Vector:
    """Solve f·M = d by back substitution."""
    fz = d.z / cell.cz
    fy = (d.y - fz * cell.cy) / cell.by
    fx = (d.x - fy * cell.bx - fz * cell.cx) / cell.ax
    return Vector(fx, fy, fz)


def cartesian(f: Vector, cell: Cell) -> Vector:
    return Vector(
        f.x * cell.ax + f.y * cell.bx + f.z * cell.cx,
        f.y * cell.by + f.z * cell.cy,
        f.z * cell.cz,
    )


def is_orthorhombic(alpha: Column, beta: Column, gamma: Column) -> Column:
    tests = [F.abs(v - 90.0) <= RIGHT_ANGLE_TOLERANCE for v in (alpha, beta, gamma)]
    return tests[0] & tests[1] & tests[2]


def minimum_image_triclinic(
    d: Vector, a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column
) -> Vector:
    """Fractional wrap in a general cell; right-angled cells take the orthorhombic path."""
    cell = cell_matrix(a, b, c, alpha, beta, gamma)
    f = fractional(d, cell)
    wrapped = cartesian(Vector(*(v - F.rint(v) for v in f)), cell)
    plain = minimum_image(d, Vector(a, b, c))
    square = is_orthorhombic(alpha, beta, gamma)
    return Vector(*(F.when(square, p).otherwise(w) for p, w in zip(plain, wrapped)))


#: Three edge lengths and three angles in degrees.
BOX_COLUMNS = ("box_a", "box_b", "box_c", "alpha", "beta", "gamma")


def box_cell(box: Sequence[str | Column]) -> Cell:
    """Cell of one cubic length, three lengths, or three lengths and three angles; a missing number is an error, not a cube."""

    def known(c: str | Column) -> Column:
        return F.coalesce(F.col(c) if isinstance(c, str) else c, F.raise_error(F.lit("box number missing")).cast("double"))

    if len(box) not in (1, 3, 6):
        raise ValueError("a box has one, three or six numbers")
    cols = [known(c) for c in box]
    a, b, c = cols[:3] if len(cols) > 1 else cols * 3
    none = F.lit(0.0)
    if len(cols) < 6:
        return Cell(a, none, b, none, none, c)
    square = is_orthorhombic(*cols[3:])
    right, slanted = Cell(a, none, b, none, none, c), cell_matrix(*cols)
    return Cell(*(F.when(square, r).otherwise(s) for r, s in zip(right, slanted)))


def heights(cell: Cell) -> Vector:
    """Distances between opposite faces."""
    ax, bx, by, cx, cy, cz = cell
    across_a = F.sqrt((by * cz) ** 2 + (bx * cz) ** 2 + (bx * cy - by * cx) ** 2)
    return Vector(ax * by * cz / across_a, by * cz / F.sqrt(cy * cy + cz * cz), cz)


def mean_cell(box: tuple[Column, ...], previous: tuple[Column, ...]) -> tuple[Column, ...]:
    """Average of two boxes, component by component."""
    return tuple((p + q) / 2.0 for p, q in zip(box, previous))
