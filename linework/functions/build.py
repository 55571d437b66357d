"""Column builders that make rings of segments."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.functions.rings import next_points
from linework.functions.segments import TAU, arc, circle as circle_segment, col, line, point, rotate_point, rotated


def polygon(points: Column) -> Column:
    """Lines around at least three points; null for fewer. An error would also come from rows that a query leaves out, as
    the optimizer evaluates this inside filters; who reads input checks it there."""
    made = F.zip_with(points, next_points(points), lambda p, q: line(p["x"], p["y"], q["x"], q["y"]))
    return F.when(F.size(points) >= 3, made)


def rectangle_points(length, width, cx=0.0, cy=0.0, angle=0.0) -> Column:
    l, w, cx, cy, a = map(col, (length, width, cx, cy, angle))
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    return F.array(*[rotate_point(point(cx + sx * l / 2, cy + sy * w / 2), a, cx, cy) for sx, sy in corners])


def rectangle(length, width, cx=0.0, cy=0.0, angle=0.0) -> Column:
    return polygon(rectangle_points(length, width, cx, cy, angle))


def regular_points(sides: Column, radius, cx=0.0, cy=0.0, angle=0.0) -> Column:
    r, cx, cy, a = map(col, (radius, cx, cy, angle))
    return F.transform(F.sequence(F.lit(0), sides - 1), lambda i: point(cx + r * F.cos(a + TAU * i / sides), cy + r * F.sin(a + TAU * i / sides)))


def regular_polygon(sides: Column, radius, cx=0.0, cy=0.0, angle=0.0) -> Column:
    return polygon(regular_points(sides, radius, cx, cy, angle))


def circle(radius, cx=0.0, cy=0.0) -> Column:
    return F.array(circle_segment(cx, cy, radius))


def stadium(length, width, cx=0.0, cy=0.0, angle=0.0) -> Column:
    """Two lines and two half circles; null unless it is longer than wide."""
    l, w, cx, cy, a = map(col, (length, width, cx, cy, angle))
    h, r = (l - w) / 2, w / 2
    made = F.array(line(cx - h, cy - r, cx + h, cy - r), arc(cx + h, cy, r, -pi / 2, pi / 2), line(cx + h, cy + r, cx - h, cy + r), arc(cx - h, cy, r, pi / 2, 3 * pi / 2))
    return F.when(l > w, F.transform(made, lambda s: rotated(s, a, cx, cy)))


def dashes(x0, y0, x1, y1, head: float, tail: float, middle: float = 0.0, n_middle: int = 0) -> Column:
    """A line cut into a head, n middles and a tail with equal gaps; the whole line if they cover it. Lengths below zero
    are an error."""
    if min(head, tail, middle, n_middle) < 0:
        raise ValueError("dashes have no negative length")
    x0, y0, x1, y1 = map(col, (x0, y0, x1, y1))
    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    drawn = head + tail + middle * n_middle
    gap = (length - drawn) / (n_middle + 1)
    spans, at = [(F.lit(0.0), F.lit(float(head)))], F.lit(float(head))
    for _ in range(n_middle):
        spans.append((at + gap, at + gap + middle))
        at = at + gap + middle
    spans.append((length - tail, length))
    cut = lambda a, b: line(x0 + (x1 - x0) * a / length, y0 + (y1 - y0) * a / length, x0 + (x1 - x0) * b / length, y0 + (y1 - y0) * b / length)
    return F.when(length <= drawn, F.array(line(x0, y0, x1, y1))).otherwise(F.filter(F.array(*[cut(a, b) for a, b in spans]), lambda s: (s["x0"] != s["x1"]) | (s["y0"] != s["y1"])))
