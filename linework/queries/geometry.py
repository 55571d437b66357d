"""Queries for primitives, rings and shapes."""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions import build, rings, shapes
from linework.functions import segments as S
from linework.kernels.primitives import refined
from linework.plans.once import each_kind
from linework.queries.views import ARCS, BOXES, CIRCLES, NUDGE, POINTS, SEGS, SIDES, Views, query, r6, rnd


@query("proj1_line_segments", f"WITH {SEGS} SELECT d, i, 'line' AS kind, {rnd('x0')} AS x0, {rnd('y0')} AS y0, {rnd('x1')} AS x1, {rnd('y1')} AS y1 FROM segs")
def line_segments(v: Views) -> DataFrame:
    return v.lines().select("d", "i", "s.kind", *[r6(F.col(f"s.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("proj2_arc_segments", f"WITH {ARCS} SELECT id, {rnd('cx')} AS cx, {rnd('cy')} AS cy, {rnd('r')} AS r, {rnd('a0')} AS a0, {rnd('a1')} AS a1, ccw FROM arcs")
def arc_segments(v: Views) -> DataFrame:
    return v.arcs().select("id", *[r6(F.col(f"s.{c}")).alias(c) for c in ("cx", "cy", "r", "a0", "a1")], "s.ccw")


@query("proj3_circle_segments", f"WITH {CIRCLES} SELECT id, {rnd('cx')} AS cx, {rnd('cy')} AS cy, {rnd('r')} AS r FROM circles")
def circle_segments(v: Views) -> DataFrame:
    return v.circles().withColumn("s", S.circle("cx", "cy", "r")).select("id", *[r6(F.col(f"s.{c}")).alias(c) for c in ("cx", "cy", "r")])


ELLIPSES = f"{POINTS}, e AS (SELECT id, x AS cx, y AS cy, (label + 1)::DOUBLE AS mx, 0.5::DOUBLE AS my, 0.5::DOUBLE AS ratio FROM points)"


def ellipses(v: Views) -> DataFrame:
    return v.points().withColumn("s", S.ellipse("x", "y", (F.col("label") + 1).cast("double"), 0.5, 0.5))


@query("proj4_ellipse_points", f"WITH {ELLIPSES} SELECT id, {rnd('cx + mx * cos(pi() / 2) - my * ratio * sin(pi() / 2)')} AS qx, {rnd('cy + my * cos(pi() / 2) + mx * ratio * sin(pi() / 2)')} AS qy FROM e")
def ellipse_points(v: Views) -> DataFrame:
    q = S.ellipse_point(F.col("s"), F.lit(0.25))
    return ellipses(v).select("id", r6(q["x"]).alias("qx"), r6(q["y"]).alias("qy"))


@query("proj10_ellipse_discretize")
def ellipse_discretize(v: Views) -> DataFrame:
    d = S.discretize(F.col("s"))
    return ellipses(v).select("id", F.size(d).alias("n"), r6(S.track_length(d)).alias("length"))


@query("proj5_spline_segments", f"WITH {SIDES} SELECT d, count(*) AS n_ctrl, 3 AS degree FROM sides WHERE n >= 4 GROUP BY d")
def spline_segments(v: Views) -> DataFrame:
    n = F.size("ring")
    knots = F.concat(F.array_repeat(F.lit(0.0), 4), F.transform(F.slice(F.sequence(F.lit(1), n), 1, n - 4), lambda i: i / (n - 3)), F.array_repeat(F.lit(1.0), 4))
    s = v.ring_rows().where(n >= 4).withColumn("s", S.spline(F.col("ring"), knots))
    return s.select("d", F.size("s.ctrl").cast("long").alias("n_ctrl"), F.col("s.degree").alias("degree"))


@query("proj6_line_discretize", f"WITH {SEGS} SELECT d, i, 2 AS n, {rnd('x0')} AS fx, {rnd('x1')} AS lx FROM segs")
def line_discretize(v: Views) -> DataFrame:
    p = S.discretize(F.col("s"))
    return v.lines().select("d", "i", F.size(p).alias("n"), r6(p[0]["x"]).alias("fx"), r6(F.element_at(p, -1)["x"]).alias("lx"))


ARC_N = "greatest(32, ceil(sweep / CASE WHEN r > 0.01 THEN 2 * acos(greatest(-1.0, 1 - 0.01 / r)) ELSE pi() / 18 END))"


@query("proj7_arc_discretize", f"WITH {ARCS} SELECT id, ({ARC_N})::INTEGER + 1 AS n, {rnd(f'r * 2 * ({ARC_N}) * sin(sweep / ({ARC_N}) / 2)')} AS length FROM arcs")
def arc_discretize(v: Views) -> DataFrame:
    a = v.arcs().select("id", S.discretize(F.col("s")).alias("p"))
    return a.select("id", F.size("p").alias("n"), r6(S.track_length(F.col("p"))).alias("length"))


CIRCLE_N = "least(128, greatest(64, ceil(2 * pi() / (2 * acos(greatest(-1.0, 1 - 0.01 / r))))))"


@query("proj8_circle_discretize", f"WITH {CIRCLES} SELECT id, ({CIRCLE_N})::INTEGER + 1 AS n, {rnd(f'r * 2 * ({CIRCLE_N}) * sin(pi() / ({CIRCLE_N}))')} AS length FROM circles")
def circle_discretize(v: Views) -> DataFrame:
    p = S.discretize(S.circle("cx", "cy", "r"))
    return v.circles().select("id", F.size(p).alias("n"), r6(S.track_length(p)).alias("length"))


@query("proj9_spline_discretize")
def spline_discretize(v: Views) -> DataFrame:
    """Splines over the vertices of each ring, evaluated in the kernel: number of samples and length."""
    from linework.operators import curves

    return curves.spline_lengths(v.ring_rows().where(F.size("ring") >= 4).select(F.col("d").alias("id"), F.col("ring").alias("ctrl"))).select("id", "n", r6(F.col("length")).alias("length"))


CHORD = "d, i, x0, y0, x1, y1, CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE ELSE -0.25::DOUBLE END AS b"


@query("proj13_arc_from_chord", f"WITH {SEGS}, c AS (SELECT {CHORD} FROM segs WHERE x0 <> x1 OR y0 <> y1) SELECT d, i, {rnd('1e-8 + sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * (b * b + 1) / (4 * abs(b))')} AS r, {rnd('4 * atan(abs(b))')} AS sweep FROM c")
def arc_from_chord(v: Views) -> DataFrame:
    b = F.when(F.col("i") % 2 == 0, 0.5).otherwise(-0.25)
    s = v.segs().where("x0 <> x1 or y0 <> y1").withColumn("s", S.arc_from_chord("x0", "y0", "x1", "y1", b))
    return s.select("d", "i", r6(F.col("s.r") + NUDGE).alias("r"), r6(S.seg_sweep(F.col("s"))).alias("sweep"))


@query("proj14_angular_sweep", f"WITH {ARCS} SELECT id, {rnd('sweep')} AS sweep FROM arcs")
def angular_sweep(v: Views) -> DataFrame:
    return v.arcs().select("id", r6(S.sweep(F.col("a0"), F.col("a1"), F.col("ccw"))).alias("sweep"))


@query("proj15_sagitta_step", f"WITH {CIRCLES} SELECT id, {rnd('CASE WHEN r > 2 THEN 2 * acos(greatest(-1.0, 1 - 2 / r)) END')} AS step FROM circles")
def sagitta_step(v: Views) -> DataFrame:
    return v.circles().select("id", r6(S.sagitta_step(F.col("r"), 2.0)).alias("step"))


@query("proj16_point_on_circle", f"WITH {ARCS} SELECT id, {rnd('cx + r * cos(a0)')} AS x, {rnd('cy + r * sin(a0)')} AS y FROM arcs")
def point_on_circle(v: Views) -> DataFrame:
    p = S.on_circle(F.col("cx"), F.col("cy"), F.col("r"), F.col("a0"))
    return v.arcs().select("id", r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


FROM_START = "CASE WHEN ccw THEN ((atan2(50.5 - cy, 50.25 - cx) - a0) % (2 * pi()) + 2 * pi()) % (2 * pi()) ELSE ((a0 - atan2(50.5 - cy, 50.25 - cx)) % (2 * pi()) + 2 * pi()) % (2 * pi()) END"


@query("proj17_angle_from_start", f"WITH {ARCS} SELECT id, {rnd(FROM_START)} AS angle FROM arcs")
def angle_from_start(v: Views) -> DataFrame:
    c = F.col
    return v.arcs().select("id", r6(S.angle_from_start(c("cx"), c("cy"), c("a0"), c("ccw"), F.lit(50.25), F.lit(50.5))).alias("angle"))


@query("proj18_segment_endpoints", f"WITH {ARCS} SELECT id, {rnd('cx + r * cos(a0)')} AS x0, {rnd('cy + r * sin(a0)')} AS y0, {rnd('cx + r * cos(a1)')} AS x1, {rnd('cy + r * sin(a1)')} AS y1 FROM arcs")
def segment_endpoints(v: Views) -> DataFrame:
    p, q = S.start_point(F.col("s")), S.end_point(F.col("s"))
    return v.arcs().select("id", r6(p["x"]).alias("x0"), r6(p["y"]).alias("y0"), r6(q["x"]).alias("x1"), r6(q["y"]).alias("y1"))


@query("proj19_segment_is_closed", f"WITH {SEGS} SELECT d, i, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) < 2 AS closed FROM segs")
def segment_is_closed(v: Views) -> DataFrame:
    return v.lines().select("d", "i", S.is_closed(F.col("s"), 2.0).alias("closed"))


@query("proj20_arc_reversed", f"WITH {ARCS} SELECT id, {rnd('a1')} AS a0, {rnd('a0')} AS a1, NOT ccw AS ccw, {rnd('r * sweep')} AS length FROM arcs")
def arc_reversed(v: Views) -> DataFrame:
    s = S.reversed_(F.col("s"))
    return v.arcs().select("id", r6(s["a0"]).alias("a0"), r6(s["a1"]).alias("a1"), s["ccw"].alias("ccw"), r6(S.length(s)).alias("length"))


@query("proj21_spline_reversed", f"WITH {SIDES} SELECT d, {rnd('arg_max(x0, i)')} AS x_first, {rnd('arg_min(x0, i)')} AS x_last, {rnd('1.0 - 0.75')} AS knot FROM sides GROUP BY d")
def spline_reversed(v: Views) -> DataFrame:
    knots = F.array(*[F.lit(k) for k in (0.0, 0.0, 0.75, 1.0, 1.0)])
    s = S.reversed_(F.col("s"))
    return v.ring_rows().withColumn("s", S.spline(F.col("ring"), knots)).select("d", r6(s["ctrl"][0]["x"]).alias("x_first"), r6(F.element_at(s["ctrl"], -1)["x"]).alias("x_last"), r6(s["knots"][2]).alias("knot"))


TURN = "cos(0.5) AS c, sin(0.5) AS n"


@query("proj22_segment_rotated", f"WITH {SEGS}, t AS (SELECT *, {TURN} FROM segs) SELECT d, i, {rnd('x0 * c - y0 * n')} AS x0, {rnd('x0 * n + y0 * c')} AS y0, {rnd('x1 * c - y1 * n')} AS x1, {rnd('x1 * n + y1 * c')} AS y1 FROM t")
def segment_rotated(v: Views) -> DataFrame:
    s = S.rotated(F.col("s"), 0.5)
    return v.lines().select("d", "i", *[r6(s[c]).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("proj23_rotate_point", f"WITH {POINTS}, t AS (SELECT *, {TURN} FROM points) SELECT id, {rnd('1 + (x - 1) * c - (y - 2) * n')} AS x, {rnd('2 + (x - 1) * n + (y - 2) * c')} AS y FROM t")
def rotate_point(v: Views) -> DataFrame:
    p = S.rotate_point(S.point("x", "y"), F.lit(0.5), 1.0, 2.0)
    return v.points().select("id", r6(p["x"]).alias("x"), r6(p["y"]).alias("y"))


@query("proj12_bezier_samples", f"WITH {SEGS}, t AS (SELECT d, i, x0, y0, x1, y1, unnest(range(0, 17)) AS k FROM segs WHERE i = 0) SELECT d, k::INTEGER AS k, {rnd('1e-8 + (1 - k / 16) ^ 3 * x0 + 3 * (1 - k / 16) ^ 2 * (k / 16) * x0 + 3 * (1 - k / 16) * (k / 16) ^ 2 * x1 + (k / 16) ^ 3 * x1')} AS x, {rnd('1e-8 + (1 - k / 16) ^ 3 * y0 + 3 * (1 - k / 16) ^ 2 * (k / 16) * y1 + 3 * (1 - k / 16) * (k / 16) ^ 2 * y0 + (k / 16) ^ 3 * y1')} AS y FROM t")
def bezier_samples(v: Views, whole: bool = False) -> DataFrame:
    """17 even samples of a curve over each segment. Without whole over first segments only, as in the SQL."""
    b = S.bezier(S.point("x0", "y0"), S.point("x0", "y1"), S.point("x1", "y0"), S.point("x1", "y1"))
    segs = v.segs() if whole else v.segs().where("i = 0")
    return segs.select("d", *["i"] * whole, F.posexplode(b).alias("k", "p")).select("d", *["i"] * whole, "k", r6(F.col("p.x") + NUDGE).alias("x"), r6(F.col("p.y") + NUDGE).alias("y"))


@query("proj12_bezier_samples_whole")
def bezier_samples_whole(v: Views) -> DataFrame:
    """Over all segments, i is the segment's."""
    return bezier_samples(v, whole=True)


@query("proj12_adaptive_polyline")
def adaptive_polyline(v: Views) -> DataFrame:
    """The same curves over all segments, eight even steps halved until each is within 0.05 of the curve."""

    ends = ["x0", "y0", "x1", "y1"]

    def points(frames):
        for x in frames:
            out = []
            for i, x0, y0, x1, y1 in zip(x.id, x.x0, x.y0, x.x1, x.y1, strict=True):
                c = np.array([(x0, y0), (x0, y1), (x1, y0), (x1, y1)])
                at = lambda t, c=c: np.stack([(1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2, t**3], axis=-1) @ c
                out.append((i, [{"x": px, "y": py} for px, py in refined(at, 0.0, 1.0, 8, 0.05)]))
            yield pd.DataFrame(out, columns=["id", "p"])

    # the curve of a segment depends on its ends alone
    found = each_kind(v.segs().select(F.struct("d", F.col("i").cast("int").alias("i")).alias("id"), *ends), ends, points, "p array<struct<x:double,y:double>>")
    return found.select("id", F.posexplode("p").alias("k", "p")).select("id.d", "id.i", "k", r6(F.col("p.x") + NUDGE).alias("x"), r6(F.col("p.y") + NUDGE).alias("y"))


@query("proj28_polygon_ring", f"WITH {SIDES} SELECT d, i::INTEGER AS i, {rnd('x0')} AS x0, {rnd('y0')} AS y0, {rnd('x1')} AS x1, {rnd('y1')} AS y1 FROM sides")
def polygon_ring(v: Views) -> DataFrame:
    return v.ring_rows().select("d", F.posexplode(build.polygon(F.col("ring"))).alias("i", "s")).select("d", "i", *[r6(F.col(f"s.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("proj29_rectangle", f"SELECT p_partkey AS id, {rnd('p_size * (p_size + 2.0)')} AS area, {rnd('2 * (p_size + p_size + 2.0)')} AS perimeter FROM part")
def rectangle(v: Views) -> DataFrame:
    ring = build.rectangle_points(F.col("p_size").cast("double"), F.col("p_size") + 2.0, 3.0, 4.0, 0.7)
    return v.table("part").select(F.col("p_partkey").alias("id"), ring.alias("ring")).select("id", r6(rings.area(F.col("ring"))).alias("area"), r6(rings.perimeter(F.col("ring"))).alias("perimeter"))


@query("proj30_regular_polygon", f"SELECT p_partkey AS id, {rnd('0.5 * (3 + p_size) * 4 * sin(2 * pi() / (3 + p_size))')} AS area FROM part")
def regular_polygon(v: Views) -> DataFrame:
    ring = build.regular_points((F.col("p_size") + 3).cast("int"), 2.0, 1.0, -1.0, 0.3)
    return v.table("part").select(F.col("p_partkey").alias("id"), ring.alias("ring")).select("id", r6(rings.area(F.col("ring"))).alias("area"))


@query("proj31_circle_ring", f"SELECT p_partkey AS id, 1 AS n, {rnd('2 * pi() * p_size')} AS length FROM part")
def circle_ring(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("id"), build.circle(F.col("p_size").cast("double"), 1.0, 2.0).alias("c")).select("id", F.size("c").alias("n"), r6(S.length(F.col("c")[0])).alias("length"))


@query("proj32_stadium", f"SELECT p_partkey AS id, 4 AS n, {rnd('2.0 * p_size + pi() * p_size')} AS perimeter FROM part")
def stadium(v: Views) -> DataFrame:
    s = build.stadium(2.0 * F.col("p_size"), F.col("p_size").cast("double"), 1.0, 2.0, 0.4)
    return v.table("part").select(F.col("p_partkey").alias("id"), s.alias("s")).select("id", F.size("s").alias("n"), r6(F.aggregate("s", F.lit(0.0), lambda a, x: a + S.length(x))).alias("perimeter"))


@query("proj33_round_point", f"WITH {SEGS} SELECT d, i, round(x0 + 1e-8, 3) + 0e0 AS x, round(y0 + 1e-8, 3) + 0e0 AS y FROM segs")
def round_point(v: Views) -> DataFrame:
    p = S.round_point(S.point(F.col("x0") + NUDGE, F.col("y0") + NUDGE))
    return v.segs().select("d", "i", (p["x"] + F.lit(0.0)).alias("x"), (p["y"] + F.lit(0.0)).alias("y"))


@query("proj34_track_points", f"WITH {SIDES} SELECT d, count(*) + 1 AS n FROM sides GROUP BY d")
def track_points(v: Views) -> DataFrame:
    return v.ring_rows().select("d", F.size(S.track_points(build.polygon(F.col("ring")))).cast("long").alias("n"))


@query("proj35_track_length", f"WITH {SEGS} SELECT d, {rnd('sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))')} AS length FROM segs GROUP BY d HAVING count(*) >= 2")
def track_length(v: Views) -> DataFrame:
    return v.ring_rows().select("d", r6(S.track_length(F.col("ring"))).alias("length"))


@query("proj36_track_shape_type", f"WITH {SIDES} SELECT d, CASE WHEN count(*) = 2 THEN 'line' ELSE 'curve' END AS shape FROM sides GROUP BY d")
def track_shape_type(v: Views) -> DataFrame:
    return v.ring_rows().select("d", S.track_shape(F.col("ring")).alias("shape"))


@query("proj37_segment_length", f"WITH {SEGS}, {ARCS} SELECT 'line' AS kind, d AS a, i AS b, {rnd('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))')} AS length FROM segs UNION ALL SELECT 'arc', id, 0, {rnd('r * sweep')} FROM arcs")
def segment_length(v: Views) -> DataFrame:
    lines = v.lines().select("s.kind", F.col("d").alias("a"), F.col("i").cast("long").alias("b"), r6(S.length(F.col("s"))).alias("length"))
    return lines.unionAll(v.arcs().select("s.kind", F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), r6(S.length(F.col("s"))).alias("length")))


CLIP = """greatest(0, least(1, xb, yb) - greatest(0, xa, ya)) * sqrt(dx * dx + dy * dy)"""


@query("proj38_length_inside", f"""WITH {SEGS}, e AS (SELECT d, i, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM segs),
c AS (SELECT d, i, dx, dy,
 CASE WHEN dx = 0 THEN CASE WHEN x0 BETWEEN 10 AND 40 THEN 0 ELSE 2 END ELSE least((10 - x0) / dx, (40 - x0) / dx) END AS xa, CASE WHEN dx = 0 THEN CASE WHEN x0 BETWEEN 10 AND 40 THEN 1 ELSE -1 END ELSE greatest((10 - x0) / dx, (40 - x0) / dx) END AS xb,
 CASE WHEN dy = 0 THEN CASE WHEN y0 BETWEEN 5 AND 30 THEN 0 ELSE 2 END ELSE least((5 - y0) / dy, (30 - y0) / dy) END AS ya, CASE WHEN dy = 0 THEN CASE WHEN y0 BETWEEN 5 AND 30 THEN 1 ELSE -1 END ELSE greatest((5 - y0) / dy, (30 - y0) / dy) END AS yb FROM e)
SELECT d, i, {rnd(CLIP)} AS length FROM c""")
def length_inside(v: Views) -> DataFrame:
    box = F.struct(F.lit(10.0).alias("x_lo"), F.lit(5.0).alias("y_lo"), F.lit(40.0).alias("x_hi"), F.lit(30.0).alias("y_hi"))
    return v.segs().select("d", "i", r6(rings.clip_length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), box)).alias("length"))


@query("proj39_chord_angle", f"WITH {SEGS} SELECT d, i, {rnd('(degrees(atan2(y1 - y0, x1 - x0)) % 180 + 180) % 180')} AS angle FROM segs")
def chord_angle(v: Views) -> DataFrame:
    return v.segs().select("d", "i", r6(rings.chord_angle_deg(S.point("x0", "y0"), S.point("x1", "y1"))).alias("angle"))


@query("proj40_circular_geometry", f"WITH {CIRCLES} SELECT id, {rnd('2 * r')} AS diameter FROM circles")
def circular_geometry(v: Views) -> DataFrame:
    s = S.circle("cx", "cy", "r")
    ring = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: S.on_circle(F.col("cx"), F.col("cy"), F.col("r"), k * (pi / 2)))
    return v.circles().select("id", r6(rings.circular(ring, F.array(s))["diameter"]).alias("diameter"))


@query("proj41_segments_for_bulge", "SELECT p_partkey AS id, greatest(8, floor(abs(atan(p_size / 10.0::DOUBLE)) * 4 / (10.0::DOUBLE * pi() / 180)))::INTEGER AS n FROM part")
def segments_for_bulge(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("id"), S.bulge_samples(F.col("p_size") / 10.0).alias("n"))


@query("sink11_arc_bulge", f"WITH {ARCS} SELECT id, {rnd('CASE WHEN ccw THEN tan(sweep / 4) ELSE -tan(sweep / 4) END')} AS bulge FROM arcs WHERE sweep < 6")
def arc_bulge(v: Views) -> DataFrame:
    s = F.col("s")
    return v.arcs().where(S.seg_sweep(s) < 6).select("id", r6(S.bulge(s)).alias("bulge"))


@query("proj42_contour_shape", f"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'circle' WHEN 1 THEN 'rectangle' WHEN 2 THEN 'stadium' ELSE 'polygon' END AS shape, {rnd('CASE p_partkey % 4 WHEN 0 THEN 2.0 * p_size WHEN 3 THEN NULL ELSE 2.0 * p_size + 1 END')} AS length FROM part")
def contour_shape(v: Views) -> DataFrame:
    """Circles, rectangles, stadiums and triangles made from parts are recognised as what they are."""
    n, k = F.col("p_size").cast("double"), F.col("p_partkey") % 4
    made = F.when(k == 0, build.circle(n, 1.0, 2.0)).when(k == 1, build.rectangle(2 * n + 1, n, 1.0, 2.0, 0.3)).when(k == 2, build.stadium(2 * n + 1, n, 1.0, 2.0, 0.3)).otherwise(build.regular_polygon(F.lit(3), n))
    s = v.table("part").select(F.col("p_partkey").alias("id"), made.alias("m")).select("id", shapes.contour_shape(F.col("m")).alias("f"))
    return s.select("id", "f.shape", r6(F.when(F.col("f.shape") != "polygon", F.col("f.length"))).alias("length"))


@query("proj66_circle_of_arcs", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS is_circle FROM part")
def circle_of_arcs(v: Views) -> DataFrame:
    r = F.col("p_size").cast("double")
    last = F.when(F.col("p_partkey") % 2 == 0, 2 * pi).otherwise(2 * pi - 0.2)
    segs = F.array(S.arc(1.0, 2.0, r, 0.0, 2.0), S.arc(1.0, 2.0, r, 2.0, 4.0), S.arc(1.0, 2.0, r, F.lit(4.0), last))
    return v.table("part").select(F.col("p_partkey").alias("id"), shapes.as_circle(segs).isNotNull().alias("is_circle"))


@query("proj67_stadium_check", "SELECT p_partkey AS id, true AS ok FROM part")
def stadium_check(v: Views) -> DataFrame:
    m = build.stadium(F.col("p_size") + 2.0, 1.5, 4.0, 5.0, 1.1)
    return v.table("part").select(F.col("p_partkey").alias("id"), m.alias("m")).select("id", shapes.as_stadium(F.col("m")).isNotNull().alias("ok"))


@query("proj68_rectangle_check", f"WITH {SIDES}, s AS (SELECT d, n FROM sides GROUP BY d, n) SELECT d, false AS ok FROM s WHERE n = 4 UNION ALL SELECT -p_partkey, true FROM part")
def rectangle_check(v: Views) -> DataFrame:
    """Four random vertices are no rectangle; turned rectangles are."""
    free = v.ring_rows().where(F.size("ring") == 4).select("d", build.polygon(F.col("ring")).alias("m"))
    own = v.table("part").select((-F.col("p_partkey")).alias("d"), build.rectangle(F.col("p_size") + 2.0, F.col("p_size").cast("double"), 0.0, 0.0, F.col("p_partkey") / 10.0).alias("m"))
    return free.unionAll(own).select("d", shapes.as_rectangle(F.col("m")).isNotNull().alias("ok"))


@query("proj69_generic_shape", f"WITH {SIDES} SELECT d, 'polygon' AS shape, count(*)::INTEGER AS sides, {rnd('1e-8 + avg(x0)')} AS cx FROM sides WHERE n > 4 GROUP BY d")
def generic_shape(v: Views) -> DataFrame:
    m = v.ring_rows().where(F.size("ring") > 4).select("d", build.polygon(F.col("ring")).alias("m")).select("d", shapes.as_other(F.col("m")).alias("f"))
    return m.select("d", "f.shape", "f.sides", r6(F.col("f.cx") + NUDGE).alias("cx"))


@query("proj45_point_line_distance", f"WITH {SEGS} SELECT d, i, {rnd('CASE WHEN x0 = x1 AND y0 = y1 THEN sqrt((30 - x0) * (30 - x0) + (20 - y0) * (20 - y0)) ELSE abs((x1 - x0) * (20 - y0) - (y1 - y0) * (30 - x0)) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) END')} AS dist FROM segs")
def point_line_distance(v: Views) -> DataFrame:
    return v.segs().select("d", "i", r6(rings.point_line_distance(F.lit(30.0), F.lit(20.0), S.point("x0", "y0"), S.point("x1", "y1"))).alias("dist"))


@query("proj46_dash_line", f"WITH {SEGS}, l AS (SELECT d, i, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM segs) SELECT d, i, CASE WHEN len <= 6 THEN 1 ELSE 3 END AS n, {rnd('CASE WHEN len <= 6 THEN len ELSE 6 END')} AS drawn FROM l")
def dash_line(v: Views) -> DataFrame:
    m = build.dashes("x0", "y0", "x1", "y1", 2.0, 2.0, 2.0, 1)
    return v.segs().select("d", "i", m.alias("m")).select("d", "i", F.when(F.size("m") == 3, 3).otherwise(1).alias("n"), r6(F.aggregate("m", F.lit(0.0), lambda a, s: a + S.length(s))).alias("drawn"))


ANGLE = "CASE WHEN l < 1e-12 THEN 180 ELSE degrees(acos(greatest(-1.0, least(1.0, dot / l)))) END"
ANGLES = f"""{SIDES}, w AS (SELECT d, i, x0 - lag(x0, 1, xl) OVER o AS ax, y0 - lag(y0, 1, yl) OVER o AS ay, x1 - x0 AS bx, y1 - y0 AS byy FROM (SELECT *, last_value(x0) OVER p AS xl, last_value(y0) OVER p AS yl FROM sides WINDOW p AS (PARTITION BY d ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WINDOW o AS (PARTITION BY d ORDER BY i)),
g AS (SELECT d, i, sqrt(ax * ax + ay * ay) * sqrt(bx * bx + byy * byy) AS l, -(ax * bx + ay * byy) AS dot FROM w)"""


@query("proj47_interior_angle", f"WITH {ANGLES} SELECT d, i::INTEGER AS i, round({ANGLE}, 4) + 0e0 AS angle FROM g")
def interior_angle(v: Views) -> DataFrame:
    n = F.size("ring")
    a = F.transform("ring", lambda c, i: rings.interior_angle_deg(F.col("ring")[F.pmod(i - 1 + n, n)], c, F.col("ring")[F.pmod(i + 1, n)]))
    return v.ring_rows().select("d", F.posexplode(a).alias("i", "a")).select("d", "i", (F.round("a", 4) + F.lit(0.0)).alias("angle"))


@query("proj48_detect_corners", f"WITH {ANGLES} SELECT d, count(*) FILTER (180 - ({ANGLE}) >= 50) AS corners FROM g GROUP BY d")
def detect_corners(v: Views) -> DataFrame:
    return v.ring_rows().select("d", F.size(F.filter(rings.corner_flags(F.col("ring")), lambda c: c)).cast("long").alias("corners"))


@query("proj49_drop_duplicate_points", f"WITH {SIDES} SELECT d, 2 * count(*) AS before, count(*) AS after FROM sides GROUP BY d")
def drop_duplicate_points(v: Views) -> DataFrame:
    twice = F.flatten(F.transform("ring", lambda p: F.array(p, p)))
    return v.ring_rows().select("d", F.size(twice).cast("long").alias("before"), F.size(rings.drop_repeated(twice)).cast("long").alias("after"))


@query("agg5_ring_area", f"WITH {SIDES} SELECT d, {rnd('abs(sum((x0 - xf) * (y1 - yf) - (x1 - xf) * (y0 - yf))) / 2')} AS area FROM sides GROUP BY d")
def ring_area(v: Views) -> DataFrame:
    return v.ring_rows().select("d", r6(rings.area(F.col("ring"))).alias("area"))


@query("agg6_ring_bbox", f"WITH {SIDES} SELECT d, {rnd('min(x0)')} AS x_lo, {rnd('min(y0)')} AS y_lo, {rnd('max(x0)')} AS x_hi, {rnd('max(y0)')} AS y_hi FROM sides GROUP BY d")
def ring_bbox(v: Views) -> DataFrame:
    b = v.ring_rows().select("d", rings.bbox(F.col("ring")).alias("b"))
    return b.select("d", *[r6(F.col(f"b.{c}")).alias(c) for c in ("x_lo", "y_lo", "x_hi", "y_hi")])


@query("q_ring_perimeter", f"WITH {SIDES} SELECT d, {rnd('sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))')} AS perimeter FROM sides GROUP BY d")
def ring_perimeter(v: Views) -> DataFrame:
    return v.ring_rows().select("d", r6(rings.perimeter(F.col("ring"))).alias("perimeter"))


INSIDE = "sum(CASE WHEN (y0 > 25) <> (y1 > 25) AND 30 < (x1 - x0) * (25 - y0) / nullif(y1 - y0, 0) + x0 THEN 1 ELSE 0 END) % 2 = 1"


@query("pred11_point_in_ring", f"WITH {SIDES} SELECT d, {INSIDE} AS inside FROM sides GROUP BY d")
def point_in_ring(v: Views) -> DataFrame:
    return v.ring_rows().select("d", rings.contains_point(F.col("ring"), F.lit(30.0), F.lit(25.0)).alias("inside"))


@query("pred11_side_of_ring", f"WITH {SIDES} SELECT d, CASE WHEN min(abs((x1 - x0) * (25 - y0) - (y1 - y0) * (30 - x0))) < 1e-9 THEN NULL WHEN {INSIDE} THEN 1 ELSE -1 END AS side FROM sides GROUP BY d")
def side_of_ring(v: Views) -> DataFrame:
    on_line = F.exists(build.polygon(F.col("ring")), lambda s: F.abs((s["x1"] - s["x0"]) * (25 - s["y0"]) - (s["y1"] - s["y0"]) * (30 - s["x0"])) < 1e-9)
    return v.ring_rows().select("d", F.when(~on_line, rings.side(F.col("ring"), F.lit(30.0), F.lit(25.0), 1e-12)).alias("side"))


NEIGHBOURS = f"{SEGS}, n AS (SELECT d, i, x0, y0, x1, y1, lead(x0) OVER w AS x2, lead(y0) OVER w AS y2, lead(x1) OVER w AS x3, lead(y1) OVER w AS y3 FROM segs WINDOW w AS (PARTITION BY d ORDER BY i))"


def neighbours(v: Views) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("d").orderBy("i")
    out = v.segs()
    for new, old in (("x2", "x0"), ("y2", "y0"), ("x3", "x1"), ("y3", "y1")):
        out = out.withColumn(new, F.lead(old).over(w))
    return out.where("x2 is not null")


@query("pred8_are_collinear", f"""WITH {NEIGHBOURS}, a AS (SELECT d, i, ((atan2(y1 - y0, x1 - x0) - atan2(y3 - y2, x3 - x2)) % pi() + pi()) % pi() AS t, abs((x1 - x0) * (y3 - y0) - (y1 - y0) * (x3 - x0)) / nullif(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 0) AS far FROM n WHERE x2 IS NOT NULL)
SELECT d, i, coalesce(least(t, pi() - t) <= 0.2 AND far <= 3, false) AS collinear FROM a""")
def are_collinear(v: Views) -> DataFrame:
    p = S.point
    c = rings.are_collinear(p("x0", "y0"), p("x1", "y1"), p("x2", "y2"), p("x3", "y3"), 3.0, 0.2)
    return neighbours(v).select("d", "i", F.coalesce(F.when((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")), c), F.lit(False)).alias("collinear"))


CROSS = "(x1 - x0) * (y3 - y2) - (y1 - y0) * (x3 - x2)"
CROSS_T = f"((x2 - x0) * (y3 - y2) - (y2 - y0) * (x3 - x2)) / ({CROSS})"


@query("join6_line_intersection", f"WITH {NEIGHBOURS.replace('lead(x0) OVER w', 'lead(x0, 2) OVER w').replace('lead(y0) OVER w', 'lead(y0, 2) OVER w').replace('lead(x1) OVER w', 'lead(x1, 2) OVER w').replace('lead(y1) OVER w', 'lead(y1, 2) OVER w')} SELECT d, i, round(CASE WHEN abs({CROSS}) > 1e-10 THEN x0 + {CROSS_T} * (x1 - x0) END, 4) + 0e0 AS x, round(CASE WHEN abs({CROSS}) > 1e-10 THEN y0 + {CROSS_T} * (y1 - y0) END, 4) + 0e0 AS y FROM n WHERE x2 IS NOT NULL AND (abs({CROSS}) > 1 OR abs({CROSS}) < 1e-12)")
def line_intersection(v: Views) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("d").orderBy("i")
    n = v.segs()
    for new, old in (("x2", "x0"), ("y2", "y0"), ("x3", "x1"), ("y3", "y1")):
        n = n.withColumn(new, F.lead(old, 2).over(w))
    p = S.point
    n = n.where("x2 is not null").where(f"abs({CROSS}) > 1 or abs({CROSS}) < 1e-12").withColumn("m", rings.line_crossing(p("x0", "y0"), p("x1", "y1"), p("x2", "y2"), p("x3", "y3")))
    return n.select("d", "i", (F.round("m.x", 4) + F.lit(0.0)).alias("x"), (F.round("m.y", 4) + F.lit(0.0)).alias("y"))


HITS = "CASE WHEN abs(cx - 30) > r + 1e-12 THEN 0 WHEN abs(abs(cx - 30) - r) < 1e-12 THEN 1 ELSE 2 END"


@query("join7_circle_line", f"WITH {ARCS} SELECT id, ({HITS})::INTEGER AS n, {rnd('CASE WHEN abs(cx - 30) < r - 1e-12 THEN cy - sqrt(r * r - (cx - 30) * (cx - 30)) END')} AS y_first FROM arcs WHERE abs(abs(cx - 30) - r) > 1e-6")
def circle_line(v: Views) -> DataFrame:
    c = F.col
    m = rings.circle_line(c("cx"), c("cy"), c("r"), S.point(30.0, 0.0), S.point(30.0, 10.0))
    return v.arcs().where("abs(abs(cx - 30) - r) > 1e-6").select("id", m.alias("m")).select("id", F.size("m").alias("n"), r6(F.get("m", F.lit(0))["y"]).alias("y_first"))


@query("join8_circle_circle", f"WITH {ARCS}, p AS (SELECT id, sqrt((cx - 50) * (cx - 50) + (cy - 50) * (cy - 50)) AS dist, r FROM arcs) SELECT id, (CASE WHEN dist < r + 20 AND dist > abs(r - 20) THEN 2 ELSE 0 END)::INTEGER AS n FROM p WHERE dist > 1e-6 AND abs(dist - r - 20) > 1e-6 AND abs(dist - abs(r - 20)) > 1e-6")
def circle_circle(v: Views) -> DataFrame:
    c = F.col
    dist = F.sqrt((c("cx") - 50) * (c("cx") - 50) + (c("cy") - 50) * (c("cy") - 50))
    m = rings.circle_circle(c("cx"), c("cy"), c("r"), F.lit(50.0), F.lit(50.0), F.lit(20.0))
    return v.arcs().where((dist > 1e-6) & (F.abs(dist - c("r") - 20) > 1e-6) & (F.abs(dist - F.abs(c("r") - 20)) > 1e-6)).select("id", F.size(m).alias("n"))


@query("sort4_closest_to", f"WITH {SIDES}, k AS (SELECT d, x0, y0, row_number() OVER (PARTITION BY d ORDER BY sqrt((x0 - 30) * (x0 - 30) + (y0 - 25) * (y0 - 25)), x0, y0) AS n FROM sides) SELECT d, {rnd('x0')} AS x, {rnd('y0')} AS y FROM k WHERE n = 1")
def closest_to(v: Views) -> DataFrame:
    p = rings.closest(F.col("ring"), S.point(30.0, 25.0))
    return v.ring_rows().select("d", p.alias("p")).select("d", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query("join9_polyline_line", f"WITH {SIDES} SELECT d, i::INTEGER AS side, {rnd('y0 + (30 - x0) / (x1 - x0) * (y1 - y0)')} AS y FROM sides WHERE (x0 - 30) * (x1 - 30) < 0")
def polyline_line(v: Views) -> DataFrame:
    """Where the sides of rings cross the line x = 30."""
    s = v.ring_rows().select("d", F.posexplode(build.polygon(F.col("ring"))).alias("side", "s")).where((F.col("s.x0") - 30) * (F.col("s.x1") - 30) < 0)
    m = rings.line_crossing(S.point("s.x0", "s.y0"), S.point("s.x1", "s.y1"), S.point(30.0, 0.0), S.point(30.0, 1.0))
    return s.select("d", "side", r6(m["y"]).alias("y"))


@query("agg24_line_key", f"WITH {SEGS}, a AS (SELECT *, (atan2(y1 - y0, x1 - x0) % pi() + pi()) % pi() AS t FROM segs) SELECT d, i, round(round(CASE WHEN pi() - t < 5e-8 THEN 0 ELSE t END, 7) + 1e-9, 5) + 0e0 AS angle FROM a")
def line_key(v: Views) -> DataFrame:
    k = S.line_key(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return v.segs().select("d", "i", (F.round(k["angle"] + 1e-9, 5) + F.lit(0.0)).alias("angle"))


@query("agg25_arc_key", f"WITH {ARCS} SELECT cx, cy, r, count(*) AS n FROM arcs GROUP BY ALL")
def arc_key(v: Views) -> DataFrame:
    k = S.arc_key(F.col("cx"), F.col("cy"), F.col("r"))
    return v.arcs().groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k.cx", "k.cy", "k.r", "n")


@query("graph27_moved_segment", f"WITH {SEGS} SELECT d, i, {rnd('sqrt((x1 - 1) * (x1 - 1) + (y1 - 2) * (y1 - 2))')} AS length FROM segs")
def moved_segment(v: Views) -> DataFrame:
    m = v.lines().select("d", "i", S.moved_end(F.col("s"), F.lit(True), S.point(1.0, 2.0)).alias("m"))
    return m.select("d", "i", r6(S.length(F.col("m"))).alias("length"))


@query("proj60_contour_chains", f"WITH {SIDES} SELECT d, true AS chains FROM sides GROUP BY d")
def contour_chains(v: Views) -> DataFrame:
    m = v.ring_rows().select("d", build.polygon(F.col("ring")).alias("m"))
    both = F.transform("m", lambda s: F.struct(S.start_point(s).alias("p"), S.end_point(s).alias("q")))
    return m.select("d", both.alias("e")).select("d", F.forall(F.sequence(F.lit(0), F.size("e") - 1), lambda i: S.distance(F.col("e")[i]["q"], F.col("e")[F.pmod(i + 1, F.size("e"))]["p"]) <= 0.01).alias("chains"))


@query("q_box_overlap_share", f"WITH {BOXES} SELECT id, {rnd('greatest(0, least(x_hi, 60) - greatest(x_lo, 40)) * greatest(0, least(y_hi, 60) - greatest(y_lo, 40)) / nullif(area, 0)')} AS share FROM boxes")
def box_overlap_share(v: Views) -> DataFrame:
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c("x_hi"), F.lit(60.0)) - F.greatest(c("x_lo"), F.lit(40.0)))
    h = F.greatest(F.lit(0.0), F.least(c("y_hi"), F.lit(60.0)) - F.greatest(c("y_lo"), F.lit(40.0)))
    return v.boxes().select("id", r6(w * h / F.when(c("area") > 0, c("area"))).alias("share"))
