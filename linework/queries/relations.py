"""Queries for node graphs, intervals, joins, containment, sets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from linework.functions import segments as S
from linework.operators import drawings as D
from linework.plans import relational as R
from linework.plans.anchors import Anchors
from linework.queries.views import BOXES, CIRCLES, INTERVALS, NUDGE, POINTS, SEGS, SIDES, Views, query, r6, rnd

#: Edges between rounded vertices: enough of them meet.
NODES = f"{SEGS}, e AS (SELECT d, i, round(x0, 0) AS ax, round(y0, -1) AS ay, round(x1, 0) AS bx, round(y1, -1) AS by_ FROM segs), inc AS (SELECT d, i, ax AS x, ay AS y, bx AS ox, by_ AS oy FROM e WHERE ax <> bx OR ay <> by_ UNION ALL SELECT d, i, bx, by_, ax, ay FROM e WHERE ax <> bx OR ay <> by_), deg AS (SELECT d, x, y, count(*) AS degree FROM inc GROUP BY ALL)"


def graph_edges(v: Views) -> DataFrame:
    n = lambda x, y: S.point(F.round(x, 0), F.round(y, -1))
    return v.segs().select(F.col("d").alias("drawing_id"), F.col("i").alias("edge_id"), n("x0", "y0").alias("n0"), n("x1", "y1").alias("n1"))


def flat(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("drawing_id").alias("d"), F.col("node.x").alias("x"), F.col("node.y").alias("y"), *more)


@query("graph1_degree", f"WITH {NODES} SELECT * FROM deg")
def degree(v: Views) -> DataFrame:
    return flat(R.degrees(graph_edges(v)), "degree")


@query("graph2_branching_nodes", f"WITH {NODES} SELECT d, x, y FROM deg WHERE degree > 2")
def branching_nodes(v: Views) -> DataFrame:
    return flat(R.branching_nodes(graph_edges(v)))


@query("graph3_open_nodes", f"WITH {NODES} SELECT d, x, y FROM deg WHERE degree = 1")
def open_nodes(v: Views) -> DataFrame:
    return flat(R.open_nodes(graph_edges(v)))


@query("join3_node_graph", f"WITH {NODES} SELECT d, x, y, i, ox, oy FROM inc")
def node_graph(v: Views) -> DataFrame:
    g = R.incidence(graph_edges(v))
    return flat(g, F.col("edge_id").alias("i"), F.col("other.x").alias("ox"), F.col("other.y").alias("oy"))


@query("graph13_renode", f"WITH {SEGS} SELECT d, i, round(x0 + 1e-8, 3) + 0e0 AS ax, round(y0 + 1e-8, 3) + 0e0 AS ay, round(x1 + 1e-8, 3) + 0e0 AS bx, round(y1 + 1e-8, 3) + 0e0 AS by_ FROM segs")
def renode(v: Views) -> DataFrame:
    near = lambda p: S.round_point(S.point(p["x"] + NUDGE, p["y"] + NUDGE))
    p, q = near(S.start_point(F.col("s"))), near(S.end_point(F.col("s")))
    return v.lines().select("d", "i", *[(c + F.lit(0.0)).alias(n) for n, c in (("ax", p["x"]), ("ay", p["y"]), ("bx", q["x"]), ("by_", q["y"]))])


#: Vectors and the labels near them as a graph over all points: chains of near points.
NEAR = f"{POINTS}, near AS (SELECT p.id AS a, q.id AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM points p JOIN points q ON p.id < q.id AND sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) <= 1.5)"


def near_points(v: Views) -> DataFrame:
    return R.points_within(v.points().withColumn("g", F.lit(0)), ["g"], 1.5)


@query("join_distance_within", f"WITH {NEAR} SELECT a, b, {rnd('dist')} AS dist FROM near")
def distance_within(v: Views) -> DataFrame:
    return near_points(v).select("a", "b", r6(F.col("d")).alias("dist"))


COMPONENTS = f"WITH RECURSIVE {NEAR}, pairs AS (SELECT a, b FROM near UNION SELECT b, a FROM near UNION SELECT id, id FROM points), r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, pairs.b FROM r JOIN pairs ON r.b = pairs.a)"


@query("join2_cluster_points", f"{COMPONENTS} SELECT a AS id, min(b) AS cluster FROM r GROUP BY a")
def cluster_points(v: Views) -> DataFrame:
    """Points within 1.5 of each other, over chains; the cluster is its least id."""
    return R.near_clusters(v.points(), 1.5)


@query("graph4_connected_components", f"{COMPONENTS}, c AS (SELECT a, min(b) AS root FROM r GROUP BY a) SELECT root AS component, count(*) AS n FROM c GROUP BY root HAVING count(*) > 1")
def connected_components(v: Views) -> DataFrame:
    return cluster_points(v).groupBy(F.col("cluster").alias("component")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("graph6_merged_clusters", f"{COMPONENTS}, c AS (SELECT a, min(b) AS root FROM r GROUP BY a) SELECT root AS cluster, max(a) AS last FROM c GROUP BY root HAVING count(*) > 1")
def merged_clusters(v: Views) -> DataFrame:
    return cluster_points(v).groupBy("cluster").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster", "last")


@query("graph7_canonical", f"{COMPONENTS} SELECT a AS id, min(b) <> a AS moved FROM r GROUP BY a")
def canonical(v: Views) -> DataFrame:
    return cluster_points(v).select("id", (F.col("cluster") != F.col("id")).alias("moved"))


@query("sort1_free_ends", f"WITH {POINTS}, p AS (SELECT p.id AS a, q.id AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS dist FROM points p JOIN points q ON p.id <> q.id), k AS (SELECT a, min(dist) AS dist FROM p WHERE dist <= 4 GROUP BY a) SELECT a AS id, {rnd('dist')} AS dist FROM k")
def free_ends(v: Views) -> DataFrame:
    """Distance of each point to the nearest other one, where it is at most 4."""
    pairs = R.points_within(v.points().withColumn("g", F.lit(0)), ["g"], 4.0)
    both = pairs.select(F.col("a").alias("id"), "d").unionAll(pairs.select(F.col("b").alias("id"), "d"))
    return both.groupBy("id").agg(F.min("d").alias("dist")).select("id", r6(F.col("dist")).alias("dist"))


@query("agg9_merge_intervals", f"WITH {INTERVALS}, s AS (SELECT *, max(hi) OVER (PARTITION BY d ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT d, round(min(lo), 3) AS lo, round(max(hi), 3) AS hi, count(*) AS n FROM g GROUP BY d, run")
def merge_intervals(v: Views) -> DataFrame:
    u = R.interval_union(v.intervals(), ["d"], tolerance=60.0)
    return u.select("d", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "n")


@query("agg10_interval_coverage", f"WITH {INTERVALS}, b AS (SELECT floor(min(lo)) AS a, floor(min(lo)) + 86400 * 5 AS z FROM intervals), c AS (SELECT d, greatest(lo, a) AS lo, least(hi, z) AS hi, z - a AS len FROM intervals, b WHERE least(hi, z) > greatest(lo, a)), s AS (SELECT *, max(hi) OVER (PARTITION BY d ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c) SELECT d, round(sum(greatest(0, hi - greatest(lo, coalesce(reach, lo)))) / max(len), 9) AS share FROM s GROUP BY d")
def interval_coverage(v: Views) -> DataFrame:
    start = v.intervals().agg(F.floor(F.min("lo")).cast("double").alias("a"))
    own = v.intervals().crossJoin(F.broadcast(start)).withColumn("z", F.col("a") + 86400.0 * 5)  # one row
    c = R.coverage(own.withColumnRenamed("a", "_a").withColumnRenamed("z", "_z"), ["d"], "_a", "_z")
    return c.select("d", F.round("share", 9).alias("share"))


@query("win1_chain", f"WITH {INTERVALS}, s AS (SELECT *, max(hi) OVER (PARTITION BY d ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals) SELECT d, event_id, sum(CASE WHEN reach IS NOT NULL AND lo > reach + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY lo, hi ROWS UNBOUNDED PRECEDING)::BIGINT AS chain FROM s")
def chain(v: Views) -> DataFrame:
    return R.chain_ids(v.intervals(), ["d"], gap=60.0).select("d", "event_id", "chain")


@query("win4_cluster_values", "WITH RECURSIVE s AS (SELECT p_size AS g, p_retailprice::DOUBLE AS v FROM part), r AS (SELECT g, min(v) AS v FROM s GROUP BY g UNION ALL SELECT r.g, (SELECT min(s.v) FROM s WHERE s.g = r.g AND s.v > r.v + 40) FROM r WHERE r.v IS NOT NULL) SELECT g, round(v, 4) AS v FROM r WHERE v IS NOT NULL")
def cluster_values(v: Views) -> DataFrame:
    p = v.table("part").select(F.col("p_size").alias("g"), F.col("p_retailprice").cast("double").alias("v"))
    return R.cluster_values(p, ["g"], "v", 40.0).select("g", F.round("v", 4).alias("v"))


HOSTS = f"{BOXES}, c AS (SELECT a.d, a.id, b.id AS host, b.area AS host_area FROM boxes a JOIN boxes b ON a.d = b.d AND a.x_lo > b.x_lo AND a.x_hi < b.x_hi AND a.y_lo > b.y_lo AND a.y_hi < b.y_hi), t AS (SELECT x.d, x.id, x.area, p.parent, coalesce(p.root, x.id) AS root, coalesce(p.depth, 0) AS depth FROM boxes x LEFT JOIN (SELECT d, id, arg_min(host, {{'a': host_area, 'h': host}}) AS parent, arg_max(host, {{'a': host_area, 'h': host}}) AS root, count(*) AS depth FROM c GROUP BY d, id) p ON x.d = p.d AND x.id = p.id)"


def tree(v: Views) -> DataFrame:
    b = v.boxes().select("d", "id", "area", F.struct("x_lo", "y_lo", "x_hi", "y_hi").alias("box"))
    return R.containment_tree(b, ["d"])


@query("join25_containment_tree", f"WITH {HOSTS} SELECT d, id, parent, root, depth FROM t")
def containment_tree(v: Views) -> DataFrame:
    return tree(v).select("d", "id", "parent", "root", "depth")


@query("graph36_collect_inners", f"WITH {HOSTS} SELECT d, root, depth, count(*) AS n FROM t WHERE depth > 0 GROUP BY ALL")
def collect_inners(v: Views) -> DataFrame:
    return tree(v).where("depth > 0").groupBy("d", "root", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("agg1_cluster_net_area", f"WITH {HOSTS} SELECT d, root, {rnd('sum(CASE WHEN depth % 2 = 0 THEN area ELSE -area END)')} AS net_area, count(*) AS contours FROM t GROUP BY d, root")
def cluster_net_area(v: Views) -> DataFrame:
    return R.net_area(tree(v), ["d"]).select("d", "root", r6(F.col("net_area")).alias("net_area"), "contours")


@query("sort2_hierarchy_order", f"WITH {HOSTS} SELECT d, id, row_number() OVER (PARTITION BY d ORDER BY area DESC, id)::INTEGER - 1 AS cluster_id FROM t WHERE depth = 0")
def hierarchy_order(v: Views) -> DataFrame:
    return ordered_roots(v).select("d", "id", "cluster_id")


def ordered_roots(v: Views) -> DataFrame:
    """The roots with area and cluster_id, their place by area in their drawing."""
    from pyspark.sql import Window

    w = Window.partitionBy("d").orderBy(F.desc("area"), "id")
    return tree(v).where("depth = 0").select("d", "id", "area", (F.row_number().over(w) - 1).alias("cluster_id"))


@query("join26_covered_boxes", f"WITH {BOXES} SELECT a.id AS id, b.id AS other FROM boxes a JOIN boxes b ON a.d = b.d AND a.id < b.id AND a.x_lo <= b.x_hi AND b.x_lo <= a.x_hi AND a.y_lo <= b.y_hi AND b.y_lo <= a.y_hi WHERE a.id % 7 = 0 AND b.id % 7 = 0")
def box_pairs(v: Views, whole: bool = False) -> DataFrame:
    """Boxes that overlap, by the grid join. Without whole only every seventh box, as in the SQL; no covered rectangles."""
    b = (v.boxes() if whole else v.boxes().where("id % 7 = 0")).select("d", "id", F.struct("x_lo", "y_lo", "x_hi", "y_hi").alias("box"))
    # equal boxes overlap the same ones: each is met once and its pairs are dealt out to its copies
    kinds = b.groupBy("d", "box").agg(F.min("id").alias("k"), F.collect_list("id").alias("ids"))
    met = R.grid_join(kinds, kinds, ["d"], 0.0, 8.0).where("l.k <= r.k").select((F.col("l.k") == F.col("r.k")).alias("own"), F.explode("l.ids").alias("a"), F.col("r.ids").alias("ids"))
    pairs = met.select("own", "a", F.explode("ids").alias("b")).where("not own or a < b")
    return pairs.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("other"))


@query("box_pairs_whole")
def box_pairs_whole(v: Views) -> DataFrame:
    """All boxes that overlap. The pairs of a place grow with the square of its boxes."""
    return box_pairs(v, whole=True)


@query("join26_covered_rectangles")
def covered_rectangles(v: Views) -> DataFrame:
    """Rectangles of the plates whose four sides are covered, with the edges on them."""
    return D.covered_rectangles(v.plates(), 2.0).select(F.col("drawing_id").alias("d"), *[r6(F.col(c)).alias(c) for c in ("x_lo", "y_lo", "x_hi", "y_hi")], "edges")


PIP = f"{SIDES}, {POINTS}, q AS (SELECT id, 30 + x / 4 AS x, 25 + y / 4 AS y FROM points WHERE id < 60), g AS (SELECT * FROM sides WHERE d < 400), h AS (SELECT g.d, q.id, sum(CASE WHEN (y0 > q.y) <> (y1 > q.y) AND q.x < (x1 - x0) * (q.y - y0) / nullif(y1 - y0, 0) + x0 THEN 1 ELSE 0 END) % 2 = 1 AS inside, min(sqrt(pow(q.x - x0 - t * (x1 - x0), 2) + pow(q.y - y0 - t * (y1 - y0), 2))) AS dist FROM (SELECT g.*, q.id, q.x, q.y, greatest(0, least(1, ((q.x - x0) * (x1 - x0) + (q.y - y0) * (y1 - y0)) / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0))) AS t FROM g, q) g JOIN q ON g.id = q.id GROUP BY g.d, q.id)"

SHARES = 16


def pip(v: Views, reach: float = 0.0, whole: bool = False) -> DataFrame:
    """Points and the rings that cover them or are within reach. Without whole only the rows that PIP takes."""
    points, ring_rows = v.points(), v.ring_rows()
    if not whole:
        points, ring_rows = points.where("id < 60"), ring_rows.where("d < 400")
    # all rings lie in a few cells: each meets the points in shares, so that they are not one task
    q = points.select(F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int").alias("g"), "id", (30 + F.col("x") / 4).alias("x"), (25 + F.col("y") / 4).alias("y"))
    r = ring_rows.select(F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("g"), F.col("d").alias("ring_id"), "ring")
    return R.points_in_rings(q, r, ["g"], reach)


@query("join14_anchor_cover", f"WITH {PIP} SELECT id, min(d) AS ring_id FROM h WHERE inside GROUP BY id")
def anchor_cover(v: Views, whole: bool = False) -> DataFrame:
    """The first ring that covers each anchor."""
    return pip(v, whole=whole).where("covers").groupBy("id").agg(F.min("ring_id").alias("ring_id"))


@query("join18_texts_per_ring", f"WITH {PIP} SELECT d AS ring_id, count(*) AS n FROM h WHERE inside GROUP BY d")
def texts_per_ring(v: Views, whole: bool = False) -> DataFrame:
    return pip(v, whole=whole).where("covers").groupBy("ring_id").agg(F.count(F.lit(1)).alias("n"))


@query("join15_leader_target", f"WITH {PIP}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, d) AS n FROM h WHERE dist <= 0.5) SELECT id, d AS target, {rnd('dist')} AS dist FROM k WHERE n = 1")
def leader_target(v: Views, whole: bool = False) -> DataFrame:
    near = pip(v, 0.5, whole).where("d <= 0.5")
    return R.nearest(near, ["id"], ["d", "ring_id"]).select("id", F.col("ring_id").alias("target"), r6(F.col("d")).alias("dist"))


@query("join19_nearest_within", f"WITH {PIP} SELECT id, {rnd('min(dist)')} AS dist FROM h WHERE dist <= 2 GROUP BY id")
def nearest_within(v: Views, whole: bool = False) -> DataFrame:
    return pip(v, 2.0, whole).where("d <= 2").groupBy("id").agg(F.min("d").alias("dist")).select("id", r6(F.col("dist")).alias("dist"))


def anchors(v: Views) -> Anchors:
    """The points and rings of pip, all of them, without making their pairs."""
    q = v.points().select("id", (30 + F.col("x") / 4).alias("x"), (25 + F.col("y") / 4).alias("y"))
    return Anchors(q, v.ring_rows().select(F.col("d").alias("ring_id"), "ring"))


@query("join14_anchor_cover_whole")
def anchor_cover_whole(v: Views) -> DataFrame:
    """Of all points and rings; brute force in SQL is too slow for them, a test has it on the smallest tables."""
    return anchors(v).first_covering()


@query("join18_texts_per_ring_whole")
def texts_per_ring_whole(v: Views) -> DataFrame:
    return anchors(v).counts()


@query("join15_leader_target_whole")
def leader_target_whole(v: Views) -> DataFrame:
    return anchors(v).nearest(0.5).select("id", F.col("ring_id").alias("target"), r6(F.col("d")).alias("dist"))


@query("join19_nearest_within_whole")
def nearest_within_whole(v: Views) -> DataFrame:
    return anchors(v).nearest(2.0).select("id", r6(F.col("d")).alias("dist"))


@query("pred5_items_inside", f"WITH {SEGS} SELECT d, i FROM segs WHERE x0 BETWEEN 9 AND 41 AND x1 BETWEEN 9 AND 41 AND y0 BETWEEN 4 AND 31 AND y1 BETWEEN 4 AND 31")
def items_inside(v: Views) -> DataFrame:
    inside = lambda c, lo, hi: F.col(c).between(lo - 1, hi + 1)
    return v.segs().where(inside("x0", 10, 40) & inside("x1", 10, 40) & inside("y0", 5, 30) & inside("y1", 5, 30)).select("d", "i")


@query("pred20_axis_lines", f"WITH {SEGS} SELECT d, i, CASE WHEN abs(y1 - y0) <= 0.5 AND abs(x1 - x0) > 0.5 THEN 'H' ELSE 'V' END AS axis, {rnd('CASE WHEN abs(y1 - y0) <= 0.5 THEN least(x0, x1) ELSE least(y0, y1) END')} AS lo, {rnd('CASE WHEN abs(y1 - y0) <= 0.5 THEN greatest(x0, x1) ELSE greatest(y0, y1) END')} AS hi FROM segs WHERE (abs(y1 - y0) <= 0.5) <> (abs(x1 - x0) <= 0.5)")
def axis_lines(v: Views) -> DataFrame:
    h = F.abs(F.col("y1") - F.col("y0")) <= 0.5
    w = F.abs(F.col("x1") - F.col("x0")) <= 0.5
    pick = lambda f: F.when(h, f("x0", "x1")).otherwise(f("y0", "y1"))
    return v.segs().where(h != w).select("d", "i", F.when(h, "H").otherwise("V").alias("axis"), r6(pick(F.least)).alias("lo"), r6(pick(F.greatest)).alias("hi"))


@query("pred1_split_non_finite", "SELECT l_linenumber AS k, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS broken FROM lineitem GROUP BY l_linenumber")
def split_non_finite(v: Views) -> DataFrame:
    """Vertices of first lines made infinite are told from the others."""
    x = F.when(F.col("l_linenumber") == 1, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    return v.table("lineitem").select(F.col("l_linenumber").alias("k"), x.alias("x")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("broken"))


@query("pred3_structural_loops", "SELECT l_orderkey AS d, bool_and(l_returnflag IN ('A', 'R')) AS structural FROM lineitem GROUP BY l_orderkey")
def structural_loops(v: Views) -> DataFrame:
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("d")).agg(F.bool_and(F.col("l_returnflag").isin("A", "R")).alias("structural"))


@query("set1_find_duplicates", "SELECT l_partkey, l_quantity, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n > 1")
def find_duplicates(v: Views) -> DataFrame:
    li = v.table("lineitem").select("l_partkey", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice")
    return R.duplicates_of_key(li, ["l_partkey", "l_quantity"], ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("set2_deduplicate", f"WITH {SEGS}, k AS (SELECT d, i, least(round(x0, 0), round(x1, 0)) AS a, greatest(round(x0, 0), round(x1, 0)) AS b FROM segs) SELECT d, min(i) AS i, a, b FROM k GROUP BY d, a, b")
def deduplicate(v: Views) -> DataFrame:
    k = v.segs().select("d", "i", F.least(F.round("x0", 0), F.round("x1", 0)).alias("a"), F.greatest(F.round("x0", 0), F.round("x1", 0)).alias("b"))
    return R.first_of_key(k, ["d", "a", "b"], ["i"])


@query("set4_segment_key", f"WITH {SEGS} SELECT count(DISTINCT d) AS drawings, count(*) AS edges, count(*) AS kinds FROM segs")
def segment_key(v: Views) -> DataFrame:
    """A line and the same line run backwards have one key: as many keys as lines."""
    both = v.lines().select("d", "i", S.segment_key(F.col("s")).alias("k"), S.segment_key(S.reversed_(F.col("s"))).alias("b"))
    return both.agg(F.count_distinct("d").alias("drawings"), F.count(F.lit(1)).alias("edges"), F.sum((F.col("k") == F.col("b")).cast("long")).alias("kinds"))


@query("set5_dedup_loops", "SELECT DISTINCT list_sort(list(l_linenumber)) AS loop_ FROM lineitem GROUP BY l_orderkey".replace("list_sort(list(l_linenumber))", "array_to_string(list_sort(list(l_linenumber)), ',')"))
def dedup_loops(v: Views) -> DataFrame:
    loops = v.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("e"))
    return loops.select(F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("loop_")).distinct()


@query("set6_merge_annotations", "SELECT o_orderkey AS id, o_orderpriority AS text, 'base' AS origin FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderpriority, 'extra' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def merge_annotations(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"))
    base = o.where("id % 2 = 0").withColumn("origin", F.lit("base"))
    extra = o.where("id % 3 = 0").withColumn("origin", F.lit("extra"))
    return base.unionByName(extra.join(base.select("id", "text"), ["id", "text"], "left_anti").select("id", "text", "origin"))


@query("set10_delete_entities", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def delete_entities(v: Views) -> DataFrame:
    gone = v.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return v.table("lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("graph12_open_curves", f"WITH {SIDES}, s AS ({'SELECT DISTINCT d FROM sides'}) SELECT l_orderkey AS d, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT d FROM s) GROUP BY l_orderkey")
def open_curves(v: Views) -> DataFrame:
    """Vertices of orders that make no ring."""
    return v.vertices().join(v.ring_rows().select("d"), "d", "left_anti").groupBy("d").agg(F.count(F.lit(1)).alias("n"))


FIT = f"""{POINTS}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM points GROUP BY label), u AS (SELECT label, mx, my, x - mx AS u, y - my AS v FROM points JOIN m USING (label)),
t AS (SELECT label, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * u * u + u * v * v) AS zu, sum(v * v * v + v * u * u) AS zv FROM u GROUP BY label),
c AS (SELECT *, (zu * vv - zv * uv) / (2 * (uu * vv - uv * uv)) AS uc, (zv * uu - zu * uv) / (2 * (uu * vv - uv * uv)) AS vc FROM t)"""


@query("agg8_fit_circle", f"WITH {FIT} SELECT label, round(mx + uc, 4) AS cx, round(my + vc, 4) AS cy, round(sqrt(uc * uc + vc * vc + (uu + vv) / n), 4) AS r FROM c")
def fit_circle(v: Views) -> DataFrame:
    return R.circle_fit(v.points(), ["label"]).select("label", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "r")])


@query("agg11_axis_aligned_share", f"WITH {SEGS}, l AS (SELECT d, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, (degrees(atan2(y1 - y0, x1 - x0)) % 90 + 90) % 90 AS a FROM segs) SELECT d, {rnd('sum(CASE WHEN least(a, 90 - a) <= 10 THEN len ELSE 0 END) / nullif(sum(len), 0)')} AS share FROM l GROUP BY d")
def axis_aligned_share(v: Views) -> DataFrame:
    a = F.pmod(F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))), F.lit(90.0))
    told = v.lines().select("d", S.length(F.col("s")).alias("len"), (F.least(a, 90 - a) <= 10).alias("near"))
    total = F.sum("len")
    return told.groupBy("d").agg((F.sum(F.when(F.col("near"), F.col("len")).otherwise(0.0)) / F.when(total > 0, total)).alias("share")).select("d", r6(F.col("share")).alias("share"))


@query("agg12_concentric_groups", f"WITH {CIRCLES} SELECT round(cx, -1) + 0e0 AS gx, round(cy, -1) + 0e0 AS gy, count(*) AS n, max(r) AS r FROM circles GROUP BY 1, 2")
def concentric_groups(v: Views) -> DataFrame:
    return v.circles().groupBy((F.round("cx", -1) + F.lit(0.0)).alias("gx"), (F.round("cy", -1) + F.lit(0.0)).alias("gy")).agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"))


@query("join20_arcs_around", f"WITH {CIRCLES} SELECT a.id, b.id AS around, {rnd('b.r / a.r')} AS ratio FROM circles a JOIN circles b ON a.id <> b.id AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 0.5 AND b.r > a.r")
def arcs_around(v: Views) -> DataFrame:
    p = v.circles().select(F.lit(0).alias("g"), "id", "cx", "cy", "r", R.point_box(F.col("cx"), F.col("cy")).alias("box"))
    near = R.grid_join(p, p, ["g"], 0.5, 0.5)
    d = S.distance(S.point("l.cx", "l.cy"), S.point("r.cx", "r.cy"))
    return near.where((F.col("l.id") != F.col("r.id")) & (d <= 0.5) & (F.col("r.r") > F.col("l.r"))).select(F.col("l.id").alias("id"), F.col("r.id").alias("around"), r6(F.col("r.r") / F.col("l.r")).alias("ratio"))


@query("agg19_longest_segment", f"WITH {SEGS}, l AS (SELECT d, i, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM segs) SELECT d, {rnd('max(len)')} AS length FROM l GROUP BY d")
def longest_segment(v: Views) -> DataFrame:
    return v.lines().groupBy("d").agg(r6(F.max(S.length(F.col("s")))).alias("length"))


@query("agg20_bbox_of_drawing", f"WITH {BOXES} SELECT d, {rnd('min(x_lo)')} AS x_lo, {rnd('min(y_lo)')} AS y_lo, {rnd('max(x_hi)')} AS x_hi, {rnd('max(y_hi)')} AS y_hi FROM boxes GROUP BY d")
def bbox_of_drawing(v: Views) -> DataFrame:
    return v.boxes().groupBy("d").agg(*[r6(f(c)).alias(c) for f, c in ((F.min, "x_lo"), (F.min, "y_lo"), (F.max, "x_hi"), (F.max, "y_hi"))])


@query("win5_outer_candidates", f"WITH {BOXES}, l AS (SELECT d, unnest(range(0, 100, 5)) + 0.5 AS y FROM (SELECT DISTINCT d FROM boxes)), h AS (SELECT l.d, l.y, b.id, b.x_lo, b.x_hi FROM l JOIN boxes b ON l.d = b.d AND l.y BETWEEN b.y_lo AND b.y_hi) SELECT d, y::DOUBLE AS y, arg_min(id, {{'x': x_lo, 'i': id}}) AS first_hit, arg_max(id, {{'x': x_hi, 'i': id}}) AS last_hit FROM h GROUP BY d, y")
def outer_candidates(v: Views) -> DataFrame:
    """The first and the last box that each of twenty level rays meets."""
    b = v.boxes().withColumn("y", F.explode(F.transform(F.sequence(F.lit(0), F.lit(95), F.lit(5)), lambda k: k + F.lit(0.5).cast("double"))))
    return b.where("y between y_lo and y_hi").groupBy("d", "y").agg(F.min_by("id", F.struct("x_lo", "id")).alias("first_hit"), F.max_by("id", F.struct("x_hi", "id")).alias("last_hit"))


@query("sink2_split_parts", f"WITH {HOSTS}, k AS (SELECT d, id, area, row_number() OVER (PARTITION BY d ORDER BY area DESC, id) AS n FROM t WHERE depth = 0) SELECT d, id, '_P' || n AS label FROM k WHERE area >= 50")
def split_parts(v: Views) -> DataFrame:
    from linework.sinks.export import parts

    return parts(ordered_roots(v).withColumn("outer_area", F.col("area"))).select("d", "id", "label")


@query("join35_ring_elements", f"WITH {SIDES} SELECT DISTINCT 'clusters[' || d || '].outer' AS path, n::BIGINT AS sides FROM sides")
def ring_elements(v: Views) -> DataFrame:
    return v.ring_rows().select(F.format_string("clusters[%d].outer", F.col("d")).alias("path"), F.size("ring").cast("long").alias("sides"))


@query("q_events_sessions", f"WITH {INTERVALS}, s AS (SELECT *, lag(lo) OVER (PARTITION BY d ORDER BY lo, event_id) AS p FROM intervals), g AS (SELECT *, sum(CASE WHEN p IS NULL OR lo - p > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY lo, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT d, count(*) AS n, count(DISTINCT run) AS sessions FROM g GROUP BY d")
def events_sessions(v: Views) -> DataFrame:
    from linework.streaming.sessions import session_windows

    e = v.table("events").select(F.col("user_id").alias("d"), F.col("ts").cast("timestamp").alias("ts"))
    return session_windows(e, "d", "30 minutes").groupBy("d").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sessions"))


