"""Plane geometry as column arithmetic, for plot-ready tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_cart(angle: Column, length: Column) -> tuple[Column, Column]:
    """Angles run clockwise from the top."""
    a = math.pi / 2 - angle
    return F.cos(a) * length, F.sin(a) * length


def to_rad(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def rectify_angle(a: Column) -> Column:
    """Negative angles turned up to the first that is not."""
    return F.when(a < 0, a + 2 * math.pi * F.ceil(-a / (2 * math.pi))).otherwise(a)


def box(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """Left, right, bottom and top of a box with its centre at x, y."""
    return x - w / 2, x + w / 2, y - h / 2, y + h / 2


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @classmethod
    def of(cls, dx: float = 0, dy: float = 0, rotation: float = 0, sx: float = 1, sy: float | None = None) -> Affine:
        """Rotate (counter-clockwise), then move, then scale."""
        sy = sx if sy is None else sy
        cos, sin = math.cos(rotation), math.sin(rotation)
        return cls(sx * cos, -sx * sin, sx * dx, sy * sin, sy * cos, sy * dy)

    def then(self, o: Affine) -> Affine:
        return Affine(
            o.a * self.a + o.b * self.d, o.a * self.b + o.b * self.e, o.a * self.c + o.b * self.f + o.c,
            o.d * self.a + o.e * self.d, o.d * self.b + o.e * self.e, o.d * self.c + o.e * self.f + o.f,
        )

    def apply(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f


def line_quad(sx: Column, sy: Column, ex: Column, ey: Column, width: float = 0.01) -> Column:
    """The four corners of a line of some width, as an array of (x, y)."""
    dx, dy = ex - sx, ey - sy
    length = F.sqrt(dx * dx + dy * dy)
    ox = F.when(length > 0, -dy / F.nullif(length, F.lit(0.0)) * width / 2).otherwise(width / 2)
    oy = F.when(length > 0, dx / F.nullif(length, F.lit(0.0)) * width / 2).otherwise(0.0)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(sx - ox, sy - oy), at(sx + ox, sy + oy), at(ex + ox, ey + oy), at(ex - ox, ey - oy))


def arc_points(start: Column, end: Column, radius: float = 0.5, width: float = 0.01, resolution: int = 128, cx: float = 0.0, cy: float = 0.0) -> Column:
    """Outline of an arc: points of the inner edge from start to end, then of the outer edge back. Angles run clockwise from the top."""
    stop = F.when(end < start, end + 2 * math.pi * F.ceil((start - end) / (2 * math.pi))).otherwise(end)
    n = F.greatest(F.lit(2), (F.floor(F.abs(stop - start) / (2 * math.pi) * resolution) + 1).cast("int"))
    angle = lambda i: math.pi / 2 - (start + (stop - start) * i / (n - 1))
    edge = lambda i, r: F.struct((cx + r * F.cos(angle(i))).alias("x"), (cy + r * F.sin(angle(i))).alias("y"))
    inner = F.transform(F.sequence(F.lit(0), n - 1), lambda i: edge(i, radius - width / 2))
    outer = F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: edge(i, radius + width / 2))
    return F.concat(inner, outer)


def svg_path(points: Column) -> Column:
    """Path text of a closed polygon."""
    steps = F.transform(points, lambda p, i: F.concat(F.when(i == 0, "M ").otherwise("L "), F.format_string("%.6f", p["x"]), F.lit(","), F.format_string("%.6f", p["y"])))
    return F.concat(F.array_join(steps, " "), F.lit(" Z"))


def text_angle(angle: Column) -> Column:
    """Degrees by which a label on a spoke is turned so that it can be read."""
    r = F.when(angle >= math.pi, angle + math.pi).otherwise(angle) - math.pi / 2
    return F.degrees(rectify_angle(r))
