"""Column builders for closed rings: arrays of points without the repeated first one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.functions.segments import distance, point


def next_points(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: Column) -> Column:
    """Shoelace sum around the ring's first point, positive counter-clockwise."""
    o = ring[0]
    cross = lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])
    return _sum(F.zip_with(ring, next_points(ring), cross)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _sum(F.zip_with(ring, next_points(ring), distance))


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x_lo"), F.array_min(ys).alias("y_lo"), F.array_max(xs).alias("x_hi"), F.array_max(ys).alias("y_hi"))


def centroid(ring: Column) -> Column:
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    a = _sum(F.zip_with(ring, next_points(ring), cross)) / 2
    cx = _sum(F.zip_with(ring, next_points(ring), lambda p, q: (p["x"] + q["x"]) * cross(p, q))) / (6 * a)
    cy = _sum(F.zip_with(ring, next_points(ring), lambda p, q: (p["y"] + q["y"]) * cross(p, q))) / (6 * a)
    return point(cx, cy)


def to_segment_distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / n))).otherwise(0.0)
    ex, ey = x - p["x"] - t * dx, y - p["y"] - t * dy
    return F.sqrt(ex * ex + ey * ey)


def border_distance(ring: Column, x: Column, y: Column) -> Column:
    """The least to_segment_distance of the sides. Lambdas work out what they name at each mention, so that a side is taken
    in steps, each of which names what the one before has worked out."""
    at = lambda p, q: F.struct((x - p["x"]).alias("wx"), (y - p["y"]).alias("wy"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"))
    more = lambda s: F.struct(*[s[c].alias(c) for c in ("wx", "wy", "dx", "dy")], (s["dx"] * s["dx"] + s["dy"] * s["dy"]).alias("n"))
    t = lambda s: F.when(s["n"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s["wx"] * s["dx"] + s["wy"] * s["dy"]) / s["n"]))).otherwise(0.0)
    foot = lambda s: F.struct(*[s[c].alias(c) for c in ("wx", "wy", "dx", "dy")], t(s).alias("t"))
    off = lambda s: F.struct((s["wx"] - s["t"] * s["dx"]).alias("x"), (s["wy"] - s["t"] * s["dy"]).alias("y"))
    away = reduce(F.transform, (more, foot, off), F.zip_with(ring, next_points(ring), at))
    return F.array_min(F.transform(away, lambda e: F.sqrt(e["x"] * e["x"] + e["y"] * e["y"])))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; which side a point on the border is on is left to covers() and side()."""
    crosses = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
    hits = F.zip_with(ring, next_points(ring), lambda p, q: F.when(p["y"] == q["y"], 0).otherwise(crosses(p, q).cast("int")))
    return F.pmod(F.aggregate(hits, F.lit(0), lambda a, h: a + h), F.lit(2)) == 1


def covers(ring: Column, x: Column, y: Column, tolerance: float = 1e-9) -> Column:
    """Inside or on the border."""
    return contains_point(ring, x, y) | (border_distance(ring, x, y) <= tolerance)


def side(ring: Column, x: Column, y: Column, border: float = 5e-5) -> Column:
    """1 inside, -1 outside, 0 on the border."""
    return F.when(border_distance(ring, x, y) <= border, 0).when(contains_point(ring, x, y), 1).otherwise(-1)


def interior_angle_deg(p: Column, c: Column, n: Column) -> Column:
    """Angle at c between its neighbours; 180 where two of them meet."""
    ux, uy, vx, vy = p["x"] - c["x"], p["y"] - c["y"], n["x"] - c["x"], n["y"] - c["y"]
    lengths = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(lengths < 1e-12, 180.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / lengths)))))


def corner_flags(points: Column, threshold: float = 50.0, closed: bool = True) -> Column:
    """For each point whether the line turns there by at least the threshold; ends of open runs are none."""
    n = F.size(points)
    around = lambda c, i: 180 - interior_angle_deg(points[F.pmod(i - 1 + n, n)], c, points[F.pmod(i + 1, n)]) >= threshold
    return F.transform(points, lambda c, i: around(c, i) if closed else (i > 0) & (i < n - 1) & around(c, i))


def drop_repeated(points: Column, tolerance: float = 1e-6) -> Column:
    """Without points that are within tolerance of the last one kept."""
    start = F.slice(points, 1, 1)
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), start, lambda a, p: F.when(distance(F.element_at(a, -1), p) > tolerance, F.concat(a, F.array(p))).otherwise(a))


def chord_angle_deg(p: Column, q: Column) -> Column:
    """Direction of a chord without its sense, in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])), F.lit(180.0))


def clip_length(x0: Column, y0: Column, x1: Column, y1: Column, box: Column) -> Column:
    """Length of a line inside a box, by its parameter where it enters and leaves."""
    dx, dy = x1 - x0, y1 - y0

    def span(o: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        inside = (o >= lo) & (o <= hi)
        a, b = (lo - o) / F.when(d == 0, None).otherwise(d), (hi - o) / F.when(d == 0, None).otherwise(d)
        return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    xa, xb = span(x0, dx, box["x_lo"], box["x_hi"])
    ya, yb = span(y0, dy, box["y_lo"], box["y_hi"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), xb, yb) - F.greatest(F.lit(0.0), xa, ya)) * F.sqrt(dx * dx + dy * dy)


def point_line_distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    """To the line through p and q, or to p if they are one point."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n > 0, F.abs(dx * (y - p["y"]) - dy * (x - p["x"])) / F.when(n > 0, n)).otherwise(distance(point(x, y), p))


def are_collinear(p: Column, q: Column, r: Column, s: Column, tolerance: float = 0.1, angle_tolerance: float = 1e-6) -> Column:
    """Whether segments pq and rs lie on one line: directions agree and both ends of rs are near it."""
    from math import pi

    a, b = F.atan2(q["y"] - p["y"], q["x"] - p["x"]), F.atan2(s["y"] - r["y"], s["x"] - r["x"])
    d = F.pmod(a - b, F.lit(pi))
    return (F.least(d, pi - d) <= angle_tolerance) & (point_line_distance(r["x"], r["y"], p, q) <= tolerance) & (point_line_distance(s["x"], s["y"], p, q) <= tolerance)


def line_crossing(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Where two infinite lines meet, null if they are as good as parallel."""
    dx, dy, ex, ey = p2["x"] - p1["x"], p2["y"] - p1["y"], p4["x"] - p3["x"], p4["y"] - p3["y"]
    det = dx * ey - dy * ex
    t = ((p3["x"] - p1["x"]) * ey - (p3["y"] - p1["y"]) * ex) / F.when(F.abs(det) > 1e-10, det)
    return F.when(F.abs(det) > 1e-10, point(p1["x"] + t * dx, p1["y"] + t * dy))


def circle_line(cx: Column, cy: Column, r: Column, p: Column, q: Column) -> Column:
    """Points where an infinite line meets a circle: none, one (touching) or two, along the line."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    n = dx * dx + dy * dy
    t = ((cx - p["x"]) * dx + (cy - p["y"]) * dy) / F.when(n > 0, n)
    fx, fy = p["x"] + t * dx, p["y"] + t * dy
    rest = r * r - ((fx - cx) * (fx - cx) + (fy - cy) * (fy - cy))
    h = F.sqrt(F.greatest(rest, F.lit(0.0)) / F.when(n > 0, n))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.when((n == 0) | (rest < -1e-9), none).when(rest <= 1e-9, F.array(point(fx, fy))).otherwise(F.array(point(fx - h * dx, fy - h * dy), point(fx + h * dx, fy + h * dy)))


def circle_circle(ax: Column, ay: Column, ar: Column, bx: Column, by: Column, br: Column) -> Column:
    """Points where two circles meet."""
    d = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    safe = F.when(d > 1e-10, d)
    a = (ar * ar - br * br + d * d) / (2 * safe)
    rest = ar * ar - a * a
    h = F.sqrt(F.greatest(rest, F.lit(0.0)))
    mx, my = ax + a * (bx - ax) / safe, ay + a * (by - ay) / safe
    none = F.array().cast("array<struct<x:double,y:double>>")
    one = F.array(point(mx, my))
    two = F.array(point(mx + h * (by - ay) / safe, my - h * (bx - ax) / safe), point(mx - h * (by - ay) / safe, my + h * (bx - ax) / safe))
    return F.when((d <= 1e-10) | (rest < -1e-9), none).when(rest <= 1e-9, one).otherwise(two)


def closest(candidates: Column, ref: Column) -> Column:
    """The candidate nearest to a point; of equally near ones the first by coordinates."""
    return F.array_min(F.transform(candidates, lambda p: F.struct(distance(p, ref).alias("d"), p.alias("p"))))["p"]


def circular(ring: Column, segments: Column) -> Column:
    """Centre and diameter by the box, where one primitive makes the ring and the box is square to 15 %."""
    b = bbox(ring)
    w, h = b["x_hi"] - b["x_lo"], b["y_hi"] - b["y_lo"]
    ok = (F.size(segments) == 1) & (F.abs(w - h) <= 0.15 * F.greatest(w, h))
    return F.when(ok, F.struct(((w + h) / 2).alias("diameter"), ((b["x_lo"] + b["x_hi"]) / 2).alias("cx"), ((b["y_lo"] + b["y_hi"]) / 2).alias("cy")))
