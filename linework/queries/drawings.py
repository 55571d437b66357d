"""Queries that read whole drawings. Plates made from parts have known answers, so most have SQL too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions import segments as S
from linework.operators import curves
from linework.operators import drawings as D
from linework.queries.views import SIDES, Views, query, r6, rnd
from linework.schema import STYLE
from linework.sinks import export
from linework.sources import records

W, H = "p_size::DOUBLE", "(p_size / 2.0::DOUBLE + 1)"


@query("recipe1_heal", f"SELECT p_partkey AS d, 1 AS clusters, 1 AS inners, 1 AS trash, round({W} * {H}, 6) AS outer_area, true AS valid FROM part")
def heal(v: Views) -> DataFrame:
    """Each plate has one outline with one hole, and its chord is left over."""
    c = D.heal_drawings(v.plates())
    return c.groupBy(F.col("drawing_id").alias("d")).agg(
        F.count_distinct("cluster_id").cast("int").alias("clusters"), F.sum((F.col("kind") == "inner").cast("int")).cast("int").alias("inners"), F.sum((F.col("kind") == "trash").cast("int")).cast("int").alias("trash"),
        F.round(F.max(F.when(F.col("kind") == "outer", F.col("area"))), 6).alias("outer_area"), (F.sum((F.col("kind") == "error").cast("int")) == 0).alias("valid"),
    )


@query("recipe1_heal_orders")
def heal_orders(v: Views) -> DataFrame:
    """Contours of the closed outlines of all orders, which cross themselves in any way."""
    c = D.heal_drawings(v.edges())
    return c.where("contour_id is not null").select("drawing_id", "cluster_id", "contour_id", "kind", "depth", r6(F.col("area")).alias("area"))


@query("recipe2_island", f"SELECT p_partkey AS d, 1 AS outlines, round({W} * {H}, 6) AS outer_area FROM part")
def island(v: Views) -> DataFrame:
    c = D.read_views(v.plates(), 0.1).where("kind = 'outer'")
    return c.groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).cast("int").alias("outlines"), F.round(F.max("area"), 6).alias("outer_area"))


@query("recipe3_island_inners")
def island_inners(v: Views) -> DataFrame:
    return D.read_views(v.plates(), 0.1).groupBy("drawing_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("graph14_outer_face", f"SELECT p_partkey AS d, round({W} * {H}, 6) AS area, round(2 * {W} + 2 * {H}, 6) AS perimeter FROM part")
def outer_face(v: Views) -> DataFrame:
    return D.outer_faces(v.plates()).select(F.col("drawing_id").alias("d"), F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"))


@query("graph29_polygonize_faces", f"SELECT p_partkey AS d, round({W} * {H}, 3) AS total FROM part")
def polygonize_faces(v: Views) -> DataFrame:
    """The faces on both sides of the chord make up the plate."""
    rows = v.plates().where("seg.kind = 'line'")
    return D.face_areas(rows).groupBy(F.col("drawing_id").alias("d")).agg(F.round(F.sum("area"), 3).alias("total"))


@query("graph18_non_contour", "SELECT p_partkey AS d, 5 AS edge_id, false AS joins FROM part")
def non_contour(v: Views) -> DataFrame:
    return D.non_contour_candidates(v.plates()).select(F.col("drawing_id").alias("d"), "edge_id", "joins")


@query("join4_split_at_crossings", "SELECT p_partkey AS d, count(*) AS pieces FROM part, range(4) GROUP BY p_partkey")
def split_at_crossings(v: Views) -> DataFrame:
    """The chord of a plate meets its hole twice: three pieces of the chord, and of the hole two; here the chord's and one side's."""
    cut = D.split_at_crossings(v.plates())
    return cut.where("edge_id in (0, 5)").groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).alias("pieces"))


@query("join1_spatial_islands", "SELECT p_partkey AS d, 1::BIGINT AS islands FROM part")
def spatial_islands(v: Views) -> DataFrame:
    return D.spatial_islands(v.plates(), 0.5).groupBy(F.col("drawing_id").alias("d")).agg(F.count_distinct("island").alias("islands"))


def broken_plates(v: Views) -> DataFrame:
    """Plates whose first side is too short by 0.03 at its end."""
    s = F.col("seg")
    short = S.line(s["x0"], s["y0"], s["x1"] - 0.03, s["y1"])
    return v.plates().where("edge_id < 4").withColumn("seg", F.when(F.col("edge_id") == 0, short).otherwise(s))


@query("join10_gap_pairs", "SELECT p_partkey AS d, 0 AS edge_a, 1 AS end_a, 1 AS edge_b, 0 AS end_b FROM part")
def gap_pairs(v: Views) -> DataFrame:
    return D.gap_pairs(broken_plates(v), 0.05).select(F.col("drawing_id").alias("d"), "edge_a", "end_a", "edge_b", "end_b")


@query("graph25_close_free_gaps", f"SELECT p_partkey AS d, 4::BIGINT AS edges, round(2 * {W} + 2 * {H}, 6) AS length FROM part")
def close_free_gaps(v: Views) -> DataFrame:
    e = D.close_free_gaps(broken_plates(v))
    return e.groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum(S.length(F.col("seg"))), 6).alias("length"))


def cut_lines(v: Views) -> DataFrame:
    """Each part as a line in three pieces that overlap, and one more that lies apart."""
    n, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 10).cast("double")
    segs = F.array(S.line(F.lit(0.0), y, n, y), S.line(n / 2, y, n * 2, y), S.line(n * 2, y, n * 3, y), S.line(n * 5, y, n * 6, y))
    p = v.table("part").select(F.col("p_partkey").alias("drawing_id"), F.posexplode(segs).alias("edge_id", "seg"))
    return p.select("drawing_id", F.col("edge_id").cast("int").alias("edge_id"), F.lit("unknown").alias("role"), "seg", F.lit(None).cast(STYLE).alias("style"))


@query("agg14_merge_collinear", "SELECT p_partkey AS d, 2::BIGINT AS edges, p_size * 3.0::DOUBLE AS longest FROM part")
def merge_collinear(v: Views) -> DataFrame:
    e = D.merge_collinear(cut_lines(v))
    return e.groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).alias("edges"), r6(F.max(S.length(F.col("seg")))).alias("longest"))


@query("agg15_merge_cocircular", "SELECT p_partkey AS d, 'circle' AS kind, count(*) AS edges FROM part GROUP BY p_partkey")
def merge_cocircular(v: Views) -> DataFrame:
    r = F.col("p_size").cast("double")
    segs = F.array(S.arc(1.0, 2.0, r, 0.0, 2.5), S.arc(1.0, 2.0, r, 2.0, 4.5), S.arc(1.0, 2.0, r, 4.0, 6.5))
    p = v.table("part").select(F.col("p_partkey").alias("drawing_id"), F.posexplode(segs).alias("edge_id", "seg"))
    e = D.merge_cocircular(p.select("drawing_id", F.col("edge_id").cast("int").alias("edge_id"), F.lit("unknown").alias("role"), "seg", F.lit(None).cast(STYLE).alias("style")))
    return e.groupBy(F.col("drawing_id").alias("d"), F.col("seg.kind").alias("kind")).agg(F.count(F.lit(1)).alias("edges"))


@query("graph24_close_near_full_arcs", "SELECT p_partkey AS d, CASE WHEN p_partkey % 2 = 0 AND p_size * 0.0174 <= 0.05 THEN 'circle' ELSE 'arc' END AS kind FROM part")
def close_near_full_arcs(v: Views) -> DataFrame:
    r, gap = F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(10.0) * 0.017453292519943295
    seg = S.arc(F.lit(1.0), F.lit(2.0), r, F.lit(0.0), 6.283185307179586 - gap)
    p = v.table("part").select(F.col("p_partkey").alias("drawing_id"), F.lit(0).alias("edge_id"), F.lit("unknown").alias("role"), seg.alias("seg"), F.lit(None).cast(STYLE).alias("style"))
    return D.close_near_full_arcs(p).select(F.col("drawing_id").alias("d"), F.col("seg.kind").alias("kind"))


@query("agg17_weld_short_lines", "SELECT p_partkey AS d, 2::BIGINT AS edges FROM part")
def weld_short_lines(v: Views) -> DataFrame:
    n = F.col("p_size").cast("double")
    segs = F.array(S.line(F.lit(0.0), F.lit(0.0), n, F.lit(0.0)), S.line(n, F.lit(0.0), n + 0.03, F.lit(0.0)), S.line(n + 0.03, F.lit(0.0), n, n))
    p = v.table("part").select(F.col("p_partkey").alias("drawing_id"), F.posexplode(segs).alias("edge_id", "seg"))
    e = D.weld_short(p.select("drawing_id", F.col("edge_id").cast("int").alias("edge_id"), F.lit("unknown").alias("role"), "seg", F.lit(None).cast(STYLE).alias("style")))
    return e.groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).alias("edges"))


@query("agg16_refit_tessellations", "SELECT p_partkey AS d, 'circle' AS kind, 1::BIGINT AS edges FROM part WHERE p_partkey <= 200")
def refit_tessellations(v: Views, whole: bool = False) -> DataFrame:
    """Circles drawn as 60 short lines become circles. Without whole those of 200 parts, as in the SQL."""
    at = lambda i: S.on_circle(F.lit(5.0), F.lit(5.0), F.lit(0.5), i * 0.10471975511965977)
    segs = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: S.line(at(i)["x"], at(i)["y"], at(i + 1)["x"], at(i + 1)["y"]))
    parts = v.table("part") if whole else v.table("part").where("p_partkey <= 200")
    p = parts.select(F.col("p_partkey").alias("drawing_id"), F.posexplode(segs).alias("edge_id", "seg"))
    e = D.refit_tessellations(p.select("drawing_id", F.col("edge_id").cast("int").alias("edge_id"), F.lit("unknown").alias("role"), "seg", F.lit(None).cast(STYLE).alias("style")))
    return e.groupBy(F.col("drawing_id").alias("d"), F.col("seg.kind").alias("kind")).agg(F.count(F.lit(1)).alias("edges"))


@query("agg16_refit_tessellations_whole")
def refit_tessellations_whole(v: Views) -> DataFrame:
    """Of all parts."""
    return refit_tessellations(v, whole=True)


@query("agg18_longest_structural", f"WITH {SIDES}, l AS (SELECT d, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM sides) SELECT d, {rnd('max(len)')} AS length FROM l GROUP BY d")
def longest_structural(v: Views) -> DataFrame:
    return D.longest_segment(v.edges()).select(F.col("drawing_id").alias("d"), r6(F.col("length")).alias("length"))


@query("agg21_rotate_to_longest", f"WITH {SIDES} SELECT d, true AS level FROM sides GROUP BY d")
def rotate_to_longest(v: Views) -> DataFrame:
    """After turning, the longest edge of each drawing is level."""
    a = D.longest_segment(D.rotate_to_longest(v.edges()))
    return a.select(F.col("drawing_id").alias("d"), (F.least("angle", 180 - F.col("angle")) < 1e-6).alias("level"))


@query("proj56_rotate_document", f"WITH {SIDES} SELECT d, {rnd('sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))')} AS length FROM sides GROUP BY d")
def rotate_document(v: Views) -> DataFrame:
    """Turning keeps lengths."""
    e = D.rotate_edges(v.edges(), 1.0, 3.0, 4.0)
    return e.groupBy(F.col("drawing_id").alias("d")).agg(r6(F.sum(S.length(F.col("seg")))).alias("length"))


@query("pred14_validate", "SELECT 0 AS n WHERE false")
def validate(v: Views) -> DataFrame:
    """Plates have no open ends, nothing degenerate and nothing infinite."""
    return D.validate_edges(v.plates().where("edge_id < 4")).select(F.col("n").cast("int").alias("n"))


@query("pred15_validate_result", "SELECT 0::BIGINT AS n WHERE false")
def validate_result(v: Views) -> DataFrame:
    return D.validate_contours(D.heal_drawings(v.plates())).select("n")


@query("agg7_cluster_count", f"SELECT p_partkey AS d, 1::BIGINT AS clusters, 1::BIGINT AS inners, round(2 * {W} + 2 * {H}, 6) AS outer_perimeter FROM part")
def cluster_count(v: Views) -> DataFrame:
    c = D.clusters(D.heal_drawings(v.plates()))
    return c.groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("inners").alias("inners"), F.round(F.max("outer_perimeter"), 6).alias("outer_perimeter"))


@query("sink22_to_svg", "SELECT p_partkey AS d, 2::BIGINT AS paths FROM part")
def to_svg(v: Views) -> DataFrame:
    s = export.to_svg(D.heal_drawings(v.plates()))
    return s.select(F.col("drawing_id").alias("d"), F.regexp_count("svg", F.lit("<path ")).cast("long").alias("paths"))


@query("sink24_to_text", "SELECT p_partkey AS d, 4::BIGINT AS lines FROM part")
def to_text(v: Views) -> DataFrame:
    t = export.to_text(D.heal_drawings(v.plates()))
    return t.select(F.col("drawing_id").alias("d"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("sink1_to_dxf", "SELECT p_partkey AS d, 5::BIGINT AS lines, 1::BIGINT AS circles, 1::BIGINT AS trash FROM part")
def to_dxf(v: Views) -> DataFrame:
    e = v.plates()
    t = export.to_dxf(e, D.heal_drawings(e))
    n = lambda p: F.regexp_count("dxf", F.lit(p)).cast("long")
    return t.select(F.col("drawing_id").alias("d"), n("0\nLINE\n").alias("lines"), n("0\nCIRCLE\n").alias("circles"), n("8\nTrash\n").alias("trash"))


@query("sink21_view_model", f"SELECT p_partkey AS d, 2 AS contours, round((p_partkey % 100) + {W}, 4) AS x_hi FROM part")
def view_model(v: Views) -> DataFrame:
    m = export.view_model(D.heal_drawings(v.plates()))
    return m.select(F.col("drawing_id").alias("d"), F.size("view.contours").alias("contours"), F.col("view.box.x_hi").alias("x_hi"))


@query("src5_load_geometry", "SELECT 1::BIGINT AS d, 7::BIGINT AS edges, 3::BIGINT AS kinds")
def load_geometry(v: Views) -> DataFrame:
    own = [{"type": "polygon", "points": [(0, 0), (4, 0), (4, 3), (0, 3)]}, {"type": "circle", "center": (2, 1), "radius": 0.5}, {"type": "arc", "center": (0, 0), "radius": 1, "start_angle": 0, "end_angle": 90}, {"type": "line", "start": (0, 0), "end": (1, 1)}]
    e = records.load_geometry(v.spark, {1: own})
    return e.groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("seg.kind").alias("kinds"))


@query("src6_load_segments", f"WITH {SIDES} SELECT d, count(*) AS edges FROM sides GROUP BY d")
def load_segments(v: Views) -> DataFrame:
    from linework.functions import build

    e = records.load_segments(v.ring_rows().select(F.col("d").alias("drawing_id"), build.polygon(F.col("ring")).alias("segs")))
    return e.groupBy(F.col("drawing_id").alias("d")).agg(F.count(F.lit(1)).alias("edges"))


@query("join23_contour_minus", "SELECT p_partkey AS d, round(p_size * p_size - p_size * p_size / 4.0::DOUBLE, 4) AS area FROM part")
def contour_minus(v: Views) -> DataFrame:
    """A square without the quarter that a second square, moved by half a side, covers."""
    n = F.col("p_size").cast("double")
    sq = lambda o: F.array(S.point(o, o), S.point(o + n, o), S.point(o + n, o + n), S.point(o, o + n))
    r = v.table("part").select(F.col("p_partkey").alias("id"), sq(F.lit(0.0)).alias("ring"), sq(n / 2).alias("region"))
    return curves.ring_minus(r).groupBy(F.col("id").alias("d")).agg(F.round(F.sum("area"), 4).alias("area"))


@query("proj51_interpolate_bspline", f"WITH {SIDES} SELECT d, true AS passes FROM sides GROUP BY d")
def interpolate_bspline(v: Views) -> DataFrame:
    """The spline through a ring's vertices passes them all."""
    i = curves.interpolated(v.ring_rows().select(F.col("d").alias("id"), F.col("ring").alias("pts")))
    return i.select(F.col("id").alias("d"), (F.col("miss") < 0.05).alias("passes"))


@query("proj53_simplify_points")
def simplify_points(v: Views) -> DataFrame:
    p = v.vertices().select(F.col("d").alias("drawing_id"), "i", "x", "y")
    return D.simplify_points(p).groupBy("drawing_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("proj57_bridge_tabs", "SELECT p_partkey AS d, 4::BIGINT AS tabs FROM part")
def bridge_tabs(v: Views) -> DataFrame:
    n = F.col("p_size").cast("double") + 4
    sq = lambda h: F.array(S.point(-h, -h), S.point(h, -h), S.point(h, h), S.point(-h, h))
    r = v.table("part").select(F.col("p_partkey").alias("id"), sq(n).alias("parent"), sq(n / 2).alias("child"))
    return curves.bridge_tabs(r, 0.5).groupBy(F.col("id").alias("d")).agg(F.count(F.lit(1)).alias("tabs"))


@query("proj27_build_polygon_repair")
def build_polygon_repair(v: Views) -> DataFrame:
    """Rings that cross themselves fall into faces; the largest is kept."""
    f = curves.ring_facts(v.ring_rows().select(F.col("d").alias("id"), "ring"))
    return f.select("id", "faces", r6(F.col("largest")).alias("largest"))
