"""Boxes in EMU: columns x, y, w, h, all long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EMU per inch, a twentieth of it (the tolerance of places), a tenth of it (the tolerance of alignment), slide size.
INCH = 914400
STEP = INCH // 20
TENTH = INCH // 10
SLIDE_W, SLIDE_H = 12192000, 6858000


def col(alias: str, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def overlap_w(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.least(col(a, "x") + col(a, "w"), col(b, "x") + col(b, "w")) - F.greatest(col(a, "x"), col(b, "x")))


def overlap_h(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.least(col(a, "y") + col(a, "h"), col(b, "y") + col(b, "h")) - F.greatest(col(a, "y"), col(b, "y")))


def intersection(a: str, b: str) -> Column:
    return overlap_w(a, b) * overlap_h(a, b)


def area(a: str = "") -> Column:
    return col(a, "w") * col(a, "h")


def center_in(a: str, b: str) -> Column:
    """Whether b contains the centre of a."""
    cx, cy = col(a, "x") + col(a, "w") / 2, col(a, "y") + col(a, "h") / 2
    return (cx >= col(b, "x")) & (cx <= col(b, "x") + col(b, "w")) & (cy >= col(b, "y")) & (cy <= col(b, "y") + col(b, "h"))


def same_box(a: str, b: str, tolerance: int = STEP) -> Column:
    found = F.lit(True)
    for name in ("x", "y", "w", "h"):
        found = found & (F.abs(col(a, name) - col(b, name)) <= tolerance)
    return found


def stepped(c: Column) -> Column:
    """The nearest multiple of STEP, half to even, in steps."""
    return F.bround(c / STEP, 0).cast("long")
