"""Column builders that recognise shapes in rings of segments."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.functions.segments import TAU, distance, end_point, let, point, seg_sweep, start_point

TOLERANCE, ANGLE_DEG = 0.01, 1.0
NOTHING = "struct<shape:string,cx:double,cy:double,length:double,width:double,angle:double,sides:int>"


def _facts(shape: str, cx, cy, length_, width, angle, sides) -> Column:
    return F.struct(F.lit(shape).alias("shape"), cx.alias("cx"), cy.alias("cy"), length_.alias("length"), width.alias("width"), angle.alias("angle"), sides.cast("int").alias("sides"))


def _all(segments: Column, *kinds: str) -> Column:
    return F.forall(segments, lambda s: s["kind"].isin(*kinds))


def as_circle(segments: Column, tolerance: float = TOLERANCE) -> Column:
    """Arcs and circles of one centre and radius, to 1 %, that make a full turn to a degree."""
    s0 = segments[0]
    same = F.forall(segments, lambda s: (F.abs(s["r"] - s0["r"]) <= tolerance * s0["r"]) & (distance(point(s["cx"], s["cy"]), point(s0["cx"], s0["cy"])) <= tolerance * s0["r"]))
    turn = F.aggregate(segments, F.lit(0.0), lambda a, s: a + F.when(s["kind"] == "circle", TAU).otherwise(seg_sweep(s)))
    ok = _all(segments, "arc", "circle") & same & (F.abs(turn - TAU) <= ANGLE_DEG * pi / 180)
    return F.when(ok, _facts("circle", s0["cx"], s0["cy"], 2 * s0["r"], 2 * s0["r"], F.lit(0.0), F.lit(0)))


def _heading(s: Column) -> Column:
    return F.atan2(s["y1"] - s["y0"], s["x1"] - s["x0"])


def _turn_deg(a: Column, b: Column) -> Column:
    """Angle between two directions without sense, 0 to 90 degrees."""
    d = F.pmod(F.degrees(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def _run(s: Column) -> Column:
    """Length of a line."""
    return F.sqrt((s["x1"] - s["x0"]) * (s["x1"] - s["x0"]) + (s["y1"] - s["y0"]) * (s["y1"] - s["y0"]))


def as_rectangle(segments: Column, tolerance: float = TOLERANCE) -> Column:
    """Four lines that have a length, right angles to a degree, opposite sides equal to 1 % of the longest."""
    l = [_run(segments[i]) for i in range(4)]
    h = [_heading(segments[i]) for i in range(4)]
    longest = F.greatest(*l)
    square = F.lit(True)
    for i in range(4):
        square = square & (F.abs(_turn_deg(h[i], h[(i + 1) % 4]) - 90) <= ANGLE_DEG)
    ok = (F.size(segments) == 4) & _all(segments, "line") & (F.least(*l) > 0) & square & (F.abs(l[0] - l[2]) <= tolerance * longest) & (F.abs(l[1] - l[3]) <= tolerance * longest)
    cx = F.aggregate(segments, F.lit(0.0), lambda a, s: a + s["x0"]) / 4
    cy = F.aggregate(segments, F.lit(0.0), lambda a, s: a + s["y0"]) / 4
    angle = F.pmod(F.degrees(F.when(l[0] >= l[1], h[0]).otherwise(h[1])), F.lit(180.0))
    return F.when(ok, _facts("rectangle", cx, cy, F.greatest(l[0], l[1]), F.least(l[0], l[1]), F.when(angle > 180 - 1e-9, 0.0).otherwise(angle), F.lit(4)))


def as_stadium(segments: Column, tolerance: float = TOLERANCE) -> Column:
    """Two half circles of one radius joined by two lines that are parallel and as long as the axis."""
    first = F.when(segments[0]["kind"] == "arc", 0).otherwise(1)
    at = lambda i: segments[F.pmod(first + i, F.lit(4))]
    a, l1, b, l2 = at(0), at(1), at(2), at(3)
    axis = distance(point(a["cx"], a["cy"]), point(b["cx"], b["cy"]))
    half = lambda s: F.abs(seg_sweep(s) - pi) <= ANGLE_DEG * pi / 180
    ok = (F.size(segments) == 4) & (a["kind"] == "arc") & (b["kind"] == "arc") & (l1["kind"] == "line") & (l2["kind"] == "line")
    ok = ok & (F.abs(a["r"] - b["r"]) <= tolerance * a["r"]) & half(a) & half(b) & (_turn_deg(_heading(l1), _heading(l2)) <= ANGLE_DEG)
    ok = ok & (F.abs(_run(l1) - axis) <= tolerance * F.greatest(axis, a["r"])) & (F.abs(_run(l2) - axis) <= tolerance * F.greatest(axis, a["r"]))
    angle = F.pmod(F.degrees(F.atan2(b["cy"] - a["cy"], b["cx"] - a["cx"])), F.lit(180.0))
    return F.when(ok, _facts("stadium", (a["cx"] + b["cx"]) / 2, (a["cy"] + b["cy"]) / 2, axis + 2 * a["r"], 2 * a["r"], F.when(angle > 180 - 1e-9, 0.0).otherwise(angle), F.lit(4)))


def as_other(segments: Column) -> Column:
    """A polygon of at least three lines, or other; its size is that of the least turned box along one of its sides."""
    kind = F.when((F.size(segments) >= 3) & _all(segments, "line"), "polygon").otherwise("other")

    def of(points: Column) -> Column:
        headings = F.transform(F.filter(segments, lambda s: s["kind"] == "line"), _heading)
        mean = lambda c: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / F.size(points)
        best = F.array_min(F.transform(headings, lambda a: _box_along(points, a)))
        return let(best, lambda b: F.struct(kind.alias("shape"), mean("x").alias("cx"), mean("y").alias("cy"), b["length"].alias("length"), b["width"].alias("width"), b["angle"].alias("angle"), F.size(segments).cast("int").alias("sides")))

    return let(F.transform(segments, start_point), of)


def _box_along(points: Column, a: Column) -> Column:
    """In steps, each of which names what the one before has worked out."""
    turned = lambda t: F.transform(points, lambda p: F.struct((p["x"] * t["c"] + p["y"] * t["s"]).alias("u"), (p["y"] * t["c"] - p["x"] * t["s"]).alias("v")))
    size = lambda q: F.struct(*[(F.array_max(q[c]) - F.array_min(q[c])).alias(n) for c, n in (("u", "w"), ("v", "h"))])

    def box(q: Column) -> Column:
        w, h = q["w"], q["h"]
        angle = F.pmod(F.degrees(F.when(w >= h, a).otherwise(a + pi / 2)), F.lit(180.0))
        return F.struct(F.round(w * h, 9).alias("area"), F.greatest(w, h).alias("length"), F.least(w, h).alias("width"), angle.alias("angle"))

    return let(let(let(F.struct(F.cos(a).alias("c"), F.sin(a).alias("s")), turned), size), box)


def contour_shape(segments: Column) -> Column:
    """Circle, stadium, rectangle, polygon or other, with centre, length, width, direction in degrees and sides."""
    return F.coalesce(as_circle(segments), as_stadium(segments), as_rectangle(segments), as_other(segments))


def chains(segments: Column, tolerance: float = 0.01) -> Column:
    """Whether each segment starts where the one before it ends, round the ring."""
    n = F.size(segments)
    return F.forall(F.sequence(F.lit(0), n - 1), lambda i: distance(end_point(segments[i]), start_point(segments[F.pmod(i + 1, n)])) <= tolerance)
