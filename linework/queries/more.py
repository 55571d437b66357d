"""Queries for crossings, carriers, overlays, styles and exports over the derived tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import build, rings, roles
from linework.functions import segments as S
from linework.plans import relational as R
from linework.queries.views import ARCS, BOXES, SEGS, SIDES, Views, query, r6, rnd

T = "((bx0 - ax0) * (by1 - by0) - (by0 - ay0) * (bx1 - bx0)) / nullif((ax1 - ax0) * (by1 - by0) - (ay1 - ay0) * (bx1 - bx0), 0)"
U = "((bx0 - ax0) * (ay1 - ay0) - (by0 - ay0) * (ax1 - ax0)) / nullif((ax1 - ax0) * (by1 - by0) - (ay1 - ay0) * (bx1 - bx0), 0)"
CROSSINGS = f"{SEGS}, p AS (SELECT a.d, a.i AS a, b.i AS b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM segs a JOIN segs b ON a.d = b.d AND a.i + 1 < b.i), x AS (SELECT *, {T} AS t, {U} AS u FROM p)"


@query("join5_intersections", f"WITH {CROSSINGS} SELECT d, a, b, {rnd('ax0 + t * (ax1 - ax0)')} AS x FROM x WHERE t > 1e-9 AND t < 1 - 1e-9 AND u > 1e-9 AND u < 1 - 1e-9")
def intersections(v: Views) -> DataFrame:
    """Where lines of one order that are not neighbours cross."""
    s = v.segs()
    a = s.select("d", F.col("i").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    b = s.select(F.col("d"), F.col("i").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    both = a.join(b, "d").where("a + 1 < b").withColumn("t", F.expr(T)).withColumn("u", F.expr(U)).where("t > 1e-9 and t < 1 - 1e-9 and u > 1e-9 and u < 1 - 1e-9")
    m = rings.line_crossing(S.point("ax0", "ay0"), S.point("ax1", "ay1"), S.point("bx0", "by0"), S.point("bx1", "by1"))
    return both.select("d", "a", "b", r6(m["x"]).alias("x"))


@query("agg23_merge_on_carrier", f"WITH {SEGS}, h AS (SELECT d, y0 AS y, least(x0, x1) AS lo, greatest(x0, x1) AS hi FROM segs WHERE y0 = y1 AND x0 <> x1), s AS (SELECT *, max(hi) OVER (PARTITION BY d, y ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY d, y ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT d, y, {rnd('min(lo)')} AS lo, {rnd('max(hi)')} AS hi, count(*) AS n FROM g GROUP BY d, y, run")
def merge_on_carrier(v: Views) -> DataFrame:
    """Level lines of one order at one height that overlap or touch."""
    h = v.segs().where("y0 = y1 and x0 <> x1").select("d", F.col("y0").alias("y"), F.least("x0", "x1").alias("lo"), F.greatest("x0", "x1").alias("hi"))
    return R.interval_union(h, ["d", "y"], tolerance=1e-6).select("d", "y", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n")


@query("pred7_sides_on_border", f"WITH {BOXES}, b AS (SELECT *, min(x_lo) OVER w AS bx, max(x_hi) OVER w AS cx, min(y_lo) OVER w AS bo, max(y_hi) OVER w AS co FROM boxes WINDOW w AS (PARTITION BY d)) SELECT id, (x_lo - bx <= 1)::INTEGER + (cx - x_hi <= 1)::INTEGER + (y_lo - bo <= 1)::INTEGER + (co - y_hi <= 1)::INTEGER AS sides FROM b")
def sides_on_border(v: Views) -> DataFrame:
    """How many sides of each box lie on the border of its drawing, to 1."""
    b = v.boxes()
    whole = b.groupBy("d").agg(F.min("x_lo").alias("bx"), F.max("x_hi").alias("cx"), F.min("y_lo").alias("bo"), F.max("y_hi").alias("co"))
    on = sum(((c <= 1).cast("int") for c in (F.col("cx") - F.col("x_hi"), F.col("y_lo") - F.col("bo"), F.col("co") - F.col("y_hi"))), (F.col("x_lo") - F.col("bx") <= 1).cast("int"))
    return b.join(whole, "d").select("id", on.alias("sides"))


@query("pred16_near_full_arc", f"WITH {ARCS} SELECT id, 2 * pi() - sweep <= 0.3 AND 2 * r * sin((2 * pi() - sweep) / 2) <= 5 AS near_full FROM arcs WHERE abs(2 * pi() - sweep - 0.3) > 1e-9")
def near_full_arc(v: Views) -> DataFrame:
    s = v.arcs().withColumn("missing", 2 * pi - S.seg_sweep(F.col("s"))).where("abs(missing - 0.3) > 1e-9")
    gap = S.distance(S.start_point(F.col("s")), S.end_point(F.col("s")))
    return s.select("id", ((F.col("missing") <= 0.3) & (gap <= 5)).alias("near_full"))


@query("sort3_largest_loop", f"WITH {SIDES}, a AS (SELECT d, abs(sum((x0 - xf) * (y1 - yf) - (x1 - xf) * (y0 - yf))) / 2 AS area FROM sides GROUP BY d), c AS (SELECT o_custkey AS c, d, area FROM a JOIN orders ON o_orderkey = d) SELECT c, {rnd('max(area)')} AS area, count(*) AS loops FROM c GROUP BY c")
def largest_loop(v: Views) -> DataFrame:
    """The largest ring among the orders of each customer."""
    a = v.ring_rows().select("d", rings.area(F.col("ring")).alias("area"))
    o = v.table("orders").select(F.col("o_orderkey").alias("d"), F.col("o_custkey").alias("c"))
    return a.join(o, "d").groupBy("c").agg(r6(F.max("area")).alias("area"), F.count(F.lit(1)).alias("loops"))


@query("sink9_open_runs", "WITH s AS (SELECT l_orderkey AS d, l_returnflag AS k, row_number() OVER w AS i, lag(l_returnflag) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity)) SELECT d, count(*) FILTER (p IS NULL OR k <> p) AS runs FROM s GROUP BY d")
def open_runs(v: Views) -> DataFrame:
    """Runs of primitives of one kind, which become one entity each."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity")
    s = v.table("lineitem").withColumn("p", F.lag("l_returnflag").over(w))
    new = F.col("p").isNull() | (F.col("l_returnflag") != F.col("p"))
    return s.groupBy(F.col("l_orderkey").alias("d")).agg(F.sum(new.cast("long")).alias("runs"))


@query("sink10_native_segments", f"WITH {SIDES} SELECT d, count(*) AS entities FROM sides GROUP BY d")
def native_segments(v: Views) -> DataFrame:
    return v.ring_rows().select("d", F.explode(build.polygon(F.col("ring"))).alias("s")).groupBy("d").agg(F.count(F.lit(1)).alias("entities"))


@query("sink8_polyline_tags", f"WITH {SIDES} SELECT d, i::INTEGER AS i, {rnd('x0')} AS x, {rnd('y0')} AS y, 0.0::DOUBLE AS bulge FROM sides")
def polyline_tags(v: Views) -> DataFrame:
    from linework.sinks.export import polyline_tags as tags

    m = v.ring_rows().select("d", build.polygon(F.col("ring")).alias("m"))
    return m.select("d", F.posexplode(tags(F.col("m"))).alias("i", "t")).select("d", "i", r6(F.col("t.x")).alias("x"), r6(F.col("t.y")).alias("y"), "t.bulge")


@query("graph35_make_inner", "SELECT l_returnflag AS own, l_linestatus AS root, CASE WHEN l_returnflag <> 'N' THEN l_returnflag WHEN l_linestatus <> 'O' THEN l_linestatus ELSE 'inner' END AS role, count(*) AS n FROM lineitem GROUP BY ALL")
def make_inner(v: Views) -> DataFrame:
    """Own role unless it is none, else the root's unless it is none, else inner."""
    own = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    root = F.when(F.col("l_linestatus") != "O", F.col("l_linestatus"))
    return v.table("lineitem").groupBy(F.col("l_returnflag").alias("own"), F.col("l_linestatus").alias("root"), F.coalesce(own, root, F.lit("inner")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def overlay(v: Views) -> DataFrame:
    """d, detected: named collections of line numbers of each order."""
    m = v.table("lineitem").groupBy(F.col("l_orderkey").alias("d"), F.col("l_returnflag").alias("name")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("items"))
    return m.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("detected"))


@query("udf10_overlay_items", "SELECT l_orderkey AS d, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY ALL")
def overlay_items(v: Views) -> DataFrame:
    return overlay(v).select("d", F.explode("detected").alias("name", "items")).select("d", "name", F.size("items").cast("long").alias("n"))


@query("udf11_overlay_names", "SELECT l_orderkey AS d, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS names FROM lineitem GROUP BY l_orderkey")
def overlay_names(v: Views) -> DataFrame:
    return overlay(v).select("d", F.array_join(F.array_sort(F.map_keys("detected")), ",").alias("names"))


@query("udf7_overlay_attach", "SELECT l_orderkey AS d, 1::BIGINT AS n FROM lineitem GROUP BY l_orderkey")
def overlay_attach(v: Views) -> DataFrame:
    """Attaching replaces the collection of that name."""
    new = F.map_concat(F.map_filter("detected", lambda k, _: k != "A"), F.create_map(F.lit("A"), F.array(F.lit(99))))
    return overlay(v).select("d", F.size(new["A"]).cast("long").alias("n"))


@query("udf8_overlay_add", "SELECT l_orderkey AS d, count(*) FILTER (l_returnflag = 'A') + 1 AS n FROM lineitem GROUP BY l_orderkey")
def overlay_add(v: Views) -> DataFrame:
    items = F.concat(F.coalesce(F.try_element_at("detected", F.lit("A")), F.array().cast("array<int>")), F.array(F.lit(99)))
    return overlay(v).select("d", F.size(items).cast("long").alias("n"))


@query("src14_layer_filter", "SELECT p_partkey AS id, p_type AS layer FROM part WHERE NOT contains(upper(p_type), 'BRASS') AND upper(p_type) NOT IN ('TRASH', 'ANNOTATION')")
def layer_filter(v: Views) -> DataFrame:
    low = F.upper("p_type")
    return v.table("part").where(~F.contains(low, F.lit("BRASS")) & ~low.isin("TRASH", "ANNOTATION")).select(F.col("p_partkey").alias("id"), F.col("p_type").alias("layer"))


@query("src15_entity_style", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'OWN' ELSE n_name END AS style FROM customer JOIN nation ON n_nationkey = c_nationkey")
def entity_style(v: Views) -> DataFrame:
    """An entity's own style, or that of its layer (here: the nation)."""
    layers = v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = F.when(F.col("c_custkey") % 3 == 0, F.lit("OWN"))
    return v.table("customer").join(layers, "c_nationkey").select(F.col("c_custkey").alias("id"), F.coalesce(own, "n_name").alias("style"))


@query("src37_node_tolerance", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size / 100.0::DOUBLE ELSE 0.05::DOUBLE END AS tolerance FROM part")
def node_tolerance(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("id"), F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 100.0), F.lit(0.05)).alias("tolerance"))


@query("proj73_contour_to_dict", f"WITH {SIDES} SELECT d, 'outer' AS role, round(abs(sum((x0 - xf) * (y1 - yf) - (x1 - xf) * (y0 - yf))) / 2 + 1e-8, 3) AS area FROM sides GROUP BY d")
def contour_to_dict(v: Views) -> DataFrame:
    """Contours as JSON, read again."""
    j = v.ring_rows().select("d", F.to_json(F.struct(F.lit("outer").alias("role"), F.round(rings.area(F.col("ring")) + 1e-8, 3).alias("area"))).alias("j"))
    return j.select("d", F.from_json("j", "role string, area double").alias("c")).select("d", "c.role", "c.area")


@query("udf5_rule_needs_condition", "SELECT true AS refused")
def rule_needs_condition(v: Views) -> DataFrame:
    try:
        roles.RoleRule("x")
        refused = False
    except ValueError:
        refused = True
    return v.spark.createDataFrame([(refused,)], "refused boolean")


@query("proj26_nearest_on_segment", f"WITH {SEGS}, t AS (SELECT *, greatest(0, least(1, ((30 - x0) * (x1 - x0) + (25 - y0) * (y1 - y0)) / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0))) AS t FROM segs) SELECT d, i, {rnd('sqrt(pow(30 - x0 - t * (x1 - x0), 2) + pow(25 - y0 - t * (y1 - y0), 2))')} AS dist FROM t")
def nearest_on_segment(v: Views) -> DataFrame:
    return v.segs().select("d", "i", r6(rings.to_segment_distance(F.lit(30.0), F.lit(25.0), S.point("x0", "y0"), S.point("x1", "y1"))).alias("dist"))


@query("agg3_polygon_with_holes", "SELECT o_custkey AS c, count(*) AS rings FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey HAVING count(*) >= 3) GROUP BY o_custkey")
def polygon_with_holes(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("d"), F.col("o_custkey").alias("c"))
    return v.ring_rows().join(o, "d").groupBy("c").agg(F.size(F.collect_list("ring")).cast("long").alias("rings"))


@query("agg4_overlay_voids", "SELECT l_orderkey AS d, count(*) FILTER (l_linenumber % 2 = 0) AS voids FROM lineitem GROUP BY l_orderkey")
def overlay_voids(v: Views) -> DataFrame:
    items = v.table("lineitem").groupBy(F.col("l_orderkey").alias("d")).agg(F.collect_list(F.struct((F.col("l_linenumber") % 2 == 0).alias("is_void"), "l_partkey")).alias("items"))
    return items.select("d", F.size(F.filter("items", lambda x: x["is_void"])).cast("long").alias("voids"))
