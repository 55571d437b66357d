"""Column builders for primitives: lines, arcs, circles, ellipses and splines as tagged structs."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.schema import NODE_DECIMALS, SAGITTA, SEGMENT

TAU = 2 * pi
#: Least samples of an arc, the step of arcs no larger than the tolerance (degrees), and samples of a full circle.
ARC_SAMPLES, SMALL_STEP_DEG, CIRCLE_SAMPLES = 32, 10.0, (64, 128)


def col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it. Lambdas work out what they name at each mention."""
    return F.transform(F.array(value), f)[0]


def point(x: Column | str | float, y: Column | str | float) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def _segment(kind: str, **fields: Column) -> Column:
    return F.struct(*[(F.lit(kind) if f.name == "kind" else fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in SEGMENT.fields])


def line(x0, y0, x1, y1) -> Column:
    return _segment("line", x0=col(x0), y0=col(y0), x1=col(x1), y1=col(y1))


def arc(cx, cy, r, a0, a1, ccw: Column | bool = True) -> Column:
    """Angles in radians; a radius that is not positive is an error."""
    return _segment("arc", cx=col(cx), cy=col(cy), r=positive(col(r)), a0=col(a0), a1=col(a1), ccw=ccw if isinstance(ccw, Column) else F.lit(ccw))


def circle(cx, cy, r) -> Column:
    return _segment("circle", cx=col(cx), cy=col(cy), r=positive(col(r)))


def ellipse(cx, cy, mx, my, ratio=1.0, a0=0.0, a1=TAU, ccw: Column | bool = True) -> Column:
    return _segment("ellipse", cx=col(cx), cy=col(cy), mx=col(mx), my=col(my), ratio=col(ratio), a0=col(a0), a1=col(a1), ccw=ccw if isinstance(ccw, Column) else F.lit(ccw))


def spline(ctrl: Column, knots: Column, degree: Column | int = 3, weights: Column | None = None, samples: Column | None = None) -> Column:
    more = {k: v for k, v in (("weights", weights), ("samples", samples)) if v is not None}
    return _segment("spline", ctrl=ctrl, knots=knots, degree=degree if isinstance(degree, Column) else F.lit(degree), **more)


def positive(r: Column) -> Column:
    return F.when(r > 0, r).otherwise(F.raise_error(F.lit("radius must be positive")).cast("double"))


def sweep(a0: Column, a1: Column, ccw: Column) -> Column:
    """Angle travelled from a0 to a1, in (0, 2 pi]; angles that differ by whole turns are a full turn, equal ones none."""
    way = F.when(ccw, a1 - a0).otherwise(a0 - a1)
    turn = F.pmod(way, F.lit(TAU))
    return F.when((turn < 1e-9) & (F.abs(way) > 1e-9), F.lit(TAU)).otherwise(turn)


def on_circle(cx: Column, cy: Column, r: Column, a: Column) -> Column:
    return point(cx + r * F.cos(a), cy + r * F.sin(a))


def angle_from_start(cx: Column, cy: Column, a0: Column, ccw: Column, x: Column, y: Column) -> Column:
    """Angle travelled along the direction from a0 until the point is seen, in [0, 2 pi)."""
    to = F.atan2(y - cy, x - cx)
    return F.pmod(F.when(ccw, to - a0).otherwise(a0 - to), F.lit(TAU))


def sagitta_step(r: Column, tolerance: float = SAGITTA) -> Column:
    """Largest angle of a chord that stays within tolerance of the circle; null if the circle is no larger than that."""
    return F.when(r > tolerance, 2 * F.acos(F.greatest(F.lit(-1.0), 1 - tolerance / r)))


def seg_sweep(s: Column) -> Column:
    return sweep(s["a0"], s["a1"], s["ccw"])


def arc_point(s: Column, share: Column) -> Column:
    """Point after this share of an arc's sweep."""
    way = F.when(s["ccw"], 1.0).otherwise(-1.0)
    return on_circle(s["cx"], s["cy"], s["r"], s["a0"] + way * share * seg_sweep(s))


def ellipse_point(s: Column, share: Column) -> Column:
    way = F.when(s["ccw"], 1.0).otherwise(-1.0)
    a = s["a0"] + way * share * seg_sweep(s)
    return point(s["cx"] + s["mx"] * F.cos(a) - s["my"] * s["ratio"] * F.sin(a), s["cy"] + s["my"] * F.cos(a) + s["mx"] * s["ratio"] * F.sin(a))


def start_point(s: Column) -> Column:
    k = s["kind"]
    picked = F.when(F.size(s["samples"]) > 0, s["samples"][0]).otherwise(s["ctrl"][0])
    return F.when(k == "line", point(s["x0"], s["y0"])).when(k == "arc", arc_point(s, F.lit(0.0))).when(k == "circle", point(s["cx"] + s["r"], s["cy"])).when(k == "ellipse", ellipse_point(s, F.lit(0.0))).otherwise(picked)


def end_point(s: Column) -> Column:
    k = s["kind"]
    picked = F.when(F.size(s["samples"]) > 0, F.element_at(s["samples"], -1)).otherwise(F.element_at(s["ctrl"], -1))
    return F.when(k == "line", point(s["x1"], s["y1"])).when(k == "arc", arc_point(s, F.lit(1.0))).when(k == "circle", point(s["cx"] + s["r"], s["cy"])).when(k == "ellipse", ellipse_point(s, F.lit(1.0))).otherwise(picked)


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def is_closed(s: Column, tolerance: float = SAGITTA) -> Column:
    return distance(start_point(s), end_point(s)) < tolerance


def round_point(p: Column, decimals: int = NODE_DECIMALS) -> Column:
    return point(F.round(p["x"], decimals), F.round(p["y"], decimals))


def length(s: Column, tolerance: float = SAGITTA) -> Column:
    """Closed form for lines, arcs and circles, along samples for the others."""
    k = s["kind"]
    straight = F.sqrt((s["x1"] - s["x0"]) * (s["x1"] - s["x0"]) + (s["y1"] - s["y0"]) * (s["y1"] - s["y0"]))
    return F.when(k == "line", straight).when(k == "arc", s["r"] * seg_sweep(s)).when(k == "circle", TAU * s["r"]).otherwise(track_length(discretize(s, tolerance)))


def discretize(s: Column, tolerance: float = SAGITTA) -> Column:
    """Points along a primitive. Ellipses are sampled evenly, densely enough for their sharpest bend; splines by their
    samples where they have some, else by their control points (kernels.splines evaluates those)."""
    k = s["kind"]
    step = F.coalesce(sagitta_step(s["r"], tolerance), F.lit(SMALL_STEP_DEG * pi / 180))
    n_arc = F.greatest(F.lit(ARC_SAMPLES), F.ceil(seg_sweep(s) / step)).cast("int")
    n_circle = F.least(F.lit(CIRCLE_SAMPLES[1]), F.greatest(F.lit(CIRCLE_SAMPLES[0]), F.ceil(TAU / step))).cast("int")
    a = F.sqrt(s["mx"] * s["mx"] + s["my"] * s["my"])
    bend = F.greatest(F.lit(tolerance * 1.5), a * s["ratio"] * s["ratio"])
    n_ellipse = F.least(F.lit(400), F.greatest(F.lit(ARC_SAMPLES), F.ceil(seg_sweep(s) / sagitta_step(bend, tolerance)))).cast("int")
    along = lambda n, f: F.transform(F.sequence(F.lit(0), n), lambda i: f(i / n))
    # the whole turn of an arc and its number of steps are worked out once, not for each sample
    facts = F.struct(s["cx"].alias("cx"), s["cy"].alias("cy"), s["r"].alias("r"), s["a0"].alias("a0"), (F.when(s["ccw"], 1.0).otherwise(-1.0) * seg_sweep(s)).alias("turn"), n_arc.alias("n"))
    bent = let(facts, lambda q: along(q["n"], lambda t: on_circle(q["cx"], q["cy"], q["r"], q["a0"] + t * q["turn"])))
    round_ = along(n_circle, lambda t: on_circle(s["cx"], s["cy"], s["r"], t * TAU))
    free = F.when(F.size(s["samples"]) > 0, s["samples"]).otherwise(s["ctrl"])
    return F.when(k == "line", F.array(point(s["x0"], s["y0"]), point(s["x1"], s["y1"]))).when(k == "arc", bent).when(k == "circle", round_).when(k == "ellipse", along(n_ellipse, lambda t: ellipse_point(s, t))).otherwise(free)


def arc_from_chord(x0, y0, x1, y1, bulge) -> Column:
    """Arc through two points with a bulge (tangent of a quarter of the sweep, negative clockwise); null for a bulge of zero,
    which is a line."""
    x0, y0, x1, y1, b = map(col, (x0, y0, x1, y1, bulge))
    b = F.when(b != 0, b)
    half = (1 / b - b) / 4
    cx, cy = (x0 + x1) / 2 - (y1 - y0) * half, (y0 + y1) / 2 + (x1 - x0) * half
    r = F.sqrt((x0 - cx) * (x0 - cx) + (y0 - cy) * (y0 - cy))
    return arc(cx, cy, r, F.atan2(y0 - cy, x0 - cx), F.atan2(y1 - cy, x1 - cx), b > 0)


def bulge(s: Column) -> Column:
    return F.tan(seg_sweep(s) / 4) * F.when(s["ccw"], 1.0).otherwise(-1.0)


def bulge_samples(b: Column) -> Column:
    """Chords that a bulge's arc is drawn with: one for each ten degrees, eight at least."""
    return F.greatest(F.lit(8), F.floor(F.abs(F.atan(b)) * 4 / (SMALL_STEP_DEG * pi / 180))).cast("int")


def rotate_point(p: Column, angle: Column, ox: Column | float = 0.0, oy: Column | float = 0.0) -> Column:
    ox, oy = col(ox), col(oy)
    dx, dy = p["x"] - ox, p["y"] - oy
    return point(ox + dx * F.cos(angle) - dy * F.sin(angle), oy + dx * F.sin(angle) + dy * F.cos(angle))


def _with(s: Column, **fields: Column) -> Column:
    return F.struct(*[(fields[f.name] if f.name in fields else s[f.name]).cast(f.dataType).alias(f.name) for f in SEGMENT.fields])


def rotated(s: Column, angle: Column | float, ox: Column | float = 0.0, oy: Column | float = 0.0) -> Column:
    angle = col(angle)
    turn = lambda x, y: rotate_point(point(x, y), angle, ox, oy)
    p, q, c = turn(s["x0"], s["y0"]), turn(s["x1"], s["y1"]), turn(s["cx"], s["cy"])
    axis = rotate_point(point(s["mx"], s["my"]), angle)
    every = lambda a: F.transform(a, lambda t: rotate_point(t, angle, ox, oy))
    own = s["kind"] == "arc"
    return _with(s, x0=p["x"], y0=p["y"], x1=q["x"], y1=q["y"], cx=c["x"], cy=c["y"], a0=F.when(own, s["a0"] + angle).otherwise(s["a0"]), a1=F.when(own, s["a1"] + angle).otherwise(s["a1"]), mx=axis["x"], my=axis["y"], ctrl=every(s["ctrl"]), samples=every(s["samples"]))


def reversed_(s: Column) -> Column:
    """The same primitive run through the other way; knots are mirrored in their domain, circles stay."""
    ends = s["knots"][0] + F.element_at(s["knots"], -1)
    mirrored = F.reverse(F.transform(s["knots"], lambda k: ends - k))
    turned = s["kind"].isin("arc", "ellipse")
    return _with(s, x0=s["x1"], y0=s["y1"], x1=s["x0"], y1=s["y0"], a0=F.when(turned, s["a1"]).otherwise(s["a0"]), a1=F.when(turned, s["a0"]).otherwise(s["a1"]), ccw=F.when(turned, ~s["ccw"]).otherwise(s["ccw"]), ctrl=F.reverse(s["ctrl"]), weights=F.reverse(s["weights"]), samples=F.reverse(s["samples"]), knots=mirrored)


def bezier(p1: Column, p2: Column, p3: Column, p4: Column, n: int = 16) -> Column:
    """n + 1 even samples of a cubic."""

    def at(t: Column) -> Column:
        u = 1 - t
        mix = lambda f: u * u * u * p1[f] + 3 * u * u * t * p2[f] + 3 * u * t * t * p3[f] + t * t * t * p4[f]
        return point(mix("x"), mix("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: at(i / n))


def track_length(points: Column) -> Column:
    """Sum of the chords of a run of points."""
    steps = lambda p: F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), distance)
    return F.aggregate(let(points, steps), F.lit(0.0), lambda a, x: a + x)


def track_points(segments: Column, tolerance: float = SAGITTA) -> Column:
    """Points along a run of segments; joints that two of them share appear once."""
    chained = F.aggregate(segments, F.array().cast("array<struct<x:double,y:double>>"), lambda a, s: F.when((F.size(a) > 0) & (distance(F.element_at(a, -1), discretize(s, tolerance)[0]) < 1e-9), F.concat(a, F.slice(discretize(s, tolerance), 2, 100000))).otherwise(F.concat(a, discretize(s, tolerance))))
    return chained


def track_shape(points: Column) -> Column:
    return F.when(F.size(points) == 2, "line").otherwise("curve")


def line_key(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Carrier of a line: direction in [0, pi) to 7 decimals, signed offset from the origin to 3."""
    a = F.pmod(F.atan2(y1 - y0, x1 - x0), F.lit(pi))
    a = F.round(F.when(pi - a < 5e-8, 0.0).otherwise(a), 7)
    return F.struct(a.alias("angle"), F.round(x0 * F.sin(a) - y0 * F.cos(a), 3).alias("offset"))


def arc_key(cx: Column, cy: Column, r: Column) -> Column:
    return F.struct(F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"), F.round(r, 3).alias("r"))


def segment_key(s: Column, decimals: int = 6) -> Column:
    """Text that equal primitives share; lines count as equal both ways."""
    at = lambda *names: F.concat_ws(",", *[F.format_number(F.round(s[n], decimals), decimals) for n in names])
    ends = F.array_sort(F.array(at("x0", "y0"), at("x1", "y1")))
    free = F.concat_ws(";", F.transform(F.coalesce(s["ctrl"], s["samples"]), lambda p: F.concat_ws(",", F.round(p["x"], decimals).cast("string"), F.round(p["y"], decimals).cast("string"))))
    k = s["kind"]
    rest = F.when(k == "line", F.concat_ws("|", ends)).when(k == "circle", at("cx", "cy", "r")).when(k == "arc", F.concat_ws(",", at("cx", "cy", "r", "a0", "a1"), s["ccw"].cast("string"))).when(k == "ellipse", at("cx", "cy", "mx", "my", "ratio", "a0", "a1")).otherwise(free)
    return F.concat_ws(":", k, rest)


def moved_end(s: Column, at_start: Column, to: Column) -> Column:
    """The segment with one end moved: lines follow it, arcs keep their circle and take the angle towards it."""
    a = F.atan2(to["y"] - s["cy"], to["x"] - s["cx"])
    own = s["kind"] == "arc"
    return _with(
        s, x0=F.when(at_start, to["x"]).otherwise(s["x0"]), y0=F.when(at_start, to["y"]).otherwise(s["y0"]), x1=F.when(at_start, s["x1"]).otherwise(to["x"]), y1=F.when(at_start, s["y1"]).otherwise(to["y"]),
        a0=F.when(own & at_start, a).otherwise(s["a0"]), a1=F.when(own & ~at_start, a).otherwise(s["a1"]),
    )
