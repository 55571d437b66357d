"""Plans over whole tables: node graphs, intervals, spatial joins, containment. Each works for all drawings at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import rings
from linework.functions.segments import distance, point
from linework.plans.once import tasks
from linework.plans.shared import cut

#: Cells that one box may cover in the finest grid; larger boxes go to a coarser one.
MOST_CELLS = 64


def incidence(edges: DataFrame) -> DataFrame:
    """edges: drawing_id, edge_id, n0, n1 (points): a row for each end, drawing_id, node, edge_id, other."""
    ends = F.array(F.struct(F.col("n0").alias("node"), F.col("n1").alias("other")), F.struct(F.col("n1").alias("node"), F.col("n0").alias("other")))
    return edges.where(F.col("n0") != F.col("n1")).select("drawing_id", "edge_id", F.explode(ends).alias("e")).select("drawing_id", "e.node", "edge_id", "e.other")


def degrees(edges: DataFrame) -> DataFrame:
    return incidence(edges).groupBy("drawing_id", "node").agg(F.count(F.lit(1)).alias("degree"))


def branching_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree > 2")


def open_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree = 1")


def node_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """drawing_id, node, component: the least node that is reachable. Labels are written after each round, and pointers
    are followed, so long chains take few rounds."""
    pairs = cut(incidence(edges).select("drawing_id", "node", "other").distinct())
    labels = cut(pairs.groupBy("drawing_id", "node").agg(F.min("other").alias("m")).select("drawing_id", "node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        near = pairs.join(labels.withColumnRenamed("node", "other"), ["drawing_id", "other"]).groupBy("drawing_id", "node").agg(F.min("component").alias("near"))
        jump = labels.select("drawing_id", F.col("node").alias("component"), F.col("component").alias("far"))
        new = labels.join(near, ["drawing_id", "node"]).join(jump, ["drawing_id", "component"], "left")
        new = cut(new.select("drawing_id", "node", F.least("component", "near", "far").alias("next"), (F.least("component", "near", "far") != F.col("component")).alias("changed")))
        labels = new.select("drawing_id", "node", F.col("next").alias("component"))
        if new.where("changed").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def interval_union(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", tolerance: float = 0.0) -> DataFrame:
    """Union of intervals by key: keys, lo, hi, n. Intervals that are at most tolerance apart become one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach + tolerance), 1).otherwise(0))
    runs = starts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("_run")


def chain_ids(df: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", gap: float = 1e-6) -> DataFrame:
    """df with chain, the number of the run of touching spans that each belongs to."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNotNull() & (F.col(lo) > reach + gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def coverage(df: DataFrame, keys: list[str], lo: float | str, hi: float | str) -> DataFrame:
    """Share of [lo, hi] that the union of each key's intervals covers."""
    a, b = (F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (lo, hi))
    clipped = df.withColumn("lo", F.greatest("lo", a)).withColumn("hi", F.least("hi", b)).where("hi > lo")
    merged = interval_union(clipped, keys + [x for x in (lo, hi) if isinstance(x, str)])
    return merged.groupBy(*keys).agg((F.sum(F.col("hi") - F.col("lo")) / F.max(b - a)).alias("share"))


def cluster_values(df: DataFrame, keys: list[str], value: str = "v", tolerance: float = 1.5) -> DataFrame:
    """keys, v: sorted values without those within tolerance of the last one kept."""
    grow = lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > tolerance), F.concat(a, F.array(x))).otherwise(a)
    kept = F.aggregate(F.array_sort(F.collect_set(value)), F.array().cast("array<double>"), grow)
    return df.groupBy(*keys).agg(kept.alias("all")).select(*keys, F.explode("all").alias(value))


def _cells(box: Column, size: Column) -> Column:
    xs = F.sequence(F.floor(box["x_lo"] / size), F.floor(box["x_hi"] / size))
    ys = F.sequence(F.floor(box["y_lo"] / size), F.floor(box["y_hi"] / size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("i"), y.alias("j")))))


def _level(box: Column, size: float) -> Column:
    """Doublings of the grid that a box needs to cover few cells."""
    across = F.greatest(box["x_hi"] - box["x_lo"], box["y_hi"] - box["y_lo"]) / size
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(across, F.lit(1.0)) / (MOST_CELLS**0.5 - 1)))).cast("int")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], reach: float, cell: float) -> DataFrame:
    """Pairs of rows whose boxes are at most reach apart, and some a rounding error farther if there is a reach: left's
    columns as l.*, right's as r.* in structs.

    Both have a column box. A box lives in the grid whose cells are large enough for it to cover few, and is looked up in
    every grid that the other side uses, so a long line does not fall into thousands of cells. A pair is reported once,
    in the cell of its boxes' common corner."""
    l = left.select(*keys, F.struct(*left.columns).alias("l"), "box").withColumn("level", _level(F.col("box"), cell))
    r = right.select(*keys, F.struct(*right.columns).alias("r"), "box").withColumn("level", _level(F.col("box"), cell))
    # what is added is rounded, so that boxes just reach apart may seem farther: callers with a reach measure pairs themselves
    more = lambda c: reach + (F.abs(F.col("box")[c]) + reach) * 1e-15 if reach else F.lit(0.0)
    wide = F.struct(*[(F.col("box")[c] - more(c)).alias(c) for c in ("x_lo", "y_lo")], *[(F.col("box")[c] + more(c)).alias(c) for c in ("x_hi", "y_hi")])
    levels = l.select("level").unionAll(r.select("level")).distinct().select(F.col("level").alias("at"))
    place = lambda d, box: d.crossJoin(F.broadcast(levels)).where("at >= level").withColumn("size", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("at"))).withColumn("c", F.explode(_cells(box, F.col("size"))))  # noqa: E731  a grid level for each doubling: a handful of rows
    a = place(l.withColumn("wide", wide), F.col("wide")).select(*keys, "l", "wide", F.col("level").alias("ll"), "at", "size", "c.i", "c.j")
    b = place(r, F.col("box")).select(*keys, "r", F.col("box").alias("rb"), F.col("level").alias("rl"), "at", "c.i", "c.j")
    n = tasks(left)
    both = a.repartition(n, *keys, "at", "i", "j").join(b.repartition(n, *keys, "at", "i", "j"), [*keys, "at", "i", "j"]).where(F.col("at") == F.greatest("ll", "rl"))
    meets = (F.col("wide")["x_lo"] <= F.col("rb")["x_hi"]) & (F.col("rb")["x_lo"] <= F.col("wide")["x_hi"]) & (F.col("wide")["y_lo"] <= F.col("rb")["y_hi"]) & (F.col("rb")["y_lo"] <= F.col("wide")["y_hi"])
    corner = (F.floor(F.greatest(F.col("wide")["x_lo"], F.col("rb")["x_lo"]) / F.col("size")) == F.col("i")) & (F.floor(F.greatest(F.col("wide")["y_lo"], F.col("rb")["y_lo"]) / F.col("size")) == F.col("j"))
    return both.where(meets & corner).select(*keys, "l", "r")


def point_box(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x_lo"), y.alias("y_lo"), x.alias("x_hi"), y.alias("y_hi"))


def points_within(points: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    """points: keys, id, x, y: pairs (a, b), a < b, at most epsilon apart, with their distance d."""
    boxed = points.select(*keys, "id", "x", "y", point_box(F.col("x"), F.col("y")).alias("box"))
    near = grid_join(boxed, boxed, keys, epsilon, max(epsilon, 1e-6)).where("l.id < r.id")
    d = distance(point(F.col("l.x"), F.col("l.y")), point(F.col("r.x"), F.col("r.y")))
    return near.select(*keys, F.col("l.id").alias("a"), F.col("r.id").alias("b"), d.alias("d")).where(F.col("d") <= epsilon)


def near_clusters(points: DataFrame, epsilon: float) -> DataFrame:
    """points: id, x, y: id, cluster (the least id that chains of points at most epsilon apart reach). Points of one small
    cell are near each other, so cells are what is linked: two of them where any points are near, until one pair is found."""
    size = 0.7 * epsilon  # the diagonal is shorter than epsilon by 1 %, whatever rounding does
    cell = lambda c: F.floor(F.col(c) / size)
    placed = points.select("id", "x", "y", cell("x").alias("i"), cell("y").alias("j"))
    finite = F.abs("x") + F.abs("y") < float("inf")  # other points are near none
    cells = cut(placed.where(finite).groupBy("i", "j").agg(F.min("id").alias("least"), F.collect_set(F.struct("x", "y")).alias("p")), "cells")
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(3) for b in range(-2, 3) if (a, b) > (0, 0)]
    looked = cells.select("i", "j", "p", F.explode(F.array(*steps)).alias("s")).select(F.col("i").alias("i0"), F.col("j").alias("j0"), F.col("p").alias("q"), (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    n = tasks(points)
    met = looked.repartition(n, "i", "j").join(cells.select("i", "j", "p").repartition(n, "i", "j"), ["i", "j"])
    near = met.where(F.exists("p", lambda p: F.exists("q", lambda q: distance(p, q) <= epsilon)))
    links = near.select(F.lit(0).cast("long").alias("drawing_id"), F.lit(0).alias("edge_id"), point("i", "j").alias("n0"), point("i0", "j0").alias("n1"))
    found = node_components(links).select(F.col("node.x").cast("long").alias("i"), F.col("node.y").cast("long").alias("j"), "component")
    named = cells.select("i", "j", "least").join(found, ["i", "j"], "left").withColumn("component", F.coalesce("component", point("i", "j")))
    least = named.groupBy("component").agg(F.min("least").alias("cluster"))
    both = placed.join(named.join(least, "component").select("i", "j", "cluster"), ["i", "j"], "left")
    return both.select("id", F.coalesce(F.when(finite, F.col("cluster")), "id").alias("cluster"))


def containment_tree(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, area, parent (the least container, null for roots), root, depth (number of containers). Containers are
    boxes that hold the other strictly. Equal boxes have the same ones, so each box is met once with its number of copies."""
    own = F.struct("area", "id")
    kinds = boxes.groupBy(*keys, "box").agg(F.min(own).alias("lo"), F.max(own).alias("hi"), F.count(F.lit(1)).alias("n"))
    # the place in the order of containers stands for them: it is a number, which costs nothing to compare
    place = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(f"{c}.area", f"{c}.id"))
    kinds = cut(kinds.withColumn("first", place("lo")).withColumn("last", place("hi")))
    held = containers(kinds, keys).groupBy(*keys, "kind").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("depth"))
    named = lambda c, at, name: kinds.select(*keys, at, F.col(f"{c}.id").alias(name))
    found = held.join(named("lo", "first", "parent"), [*keys, "first"]).join(named("hi", "last", "root"), [*keys, "last"])
    found = kinds.select(*keys, "box", F.col("first").alias("kind")).join(found.select(*keys, "kind", "parent", "root", "depth"), [*keys, "kind"])
    out = boxes.select(*keys, "id", "area", "box").join(found, [*keys, "box"], "left")
    return out.select(*keys, "id", "area", "parent", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def containers(kinds: DataFrame, keys: list[str], cell: float = 8.0) -> DataFrame:
    """kinds: keys, box, first, last, n, no box twice: keys, kind (first of the inner box) and first, last and n of each
    box that holds it strictly. Such a box holds its lower left corner too, so boxes are met in the cell of that."""
    placed = kinds.withColumn("at", _level(F.col("box"), cell)).withColumn("size", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("at")))
    levels = placed.select("at", "size").distinct()
    n = tasks(kinds)
    host = placed.select(*keys, "at", F.explode(_cells(F.col("box"), F.col("size"))).alias("c"), F.col("box").alias("hb"), "first", "last", "n")
    host = host.select(*keys, "at", "c.i", "c.j", "hb", "first", "last", "n").repartition(n, *keys, "at", "i", "j")
    inner = kinds.crossJoin(F.broadcast(levels))  # a grid level for each doubling: a handful of rows
    inner = inner.select(*keys, "at", F.floor(F.col("box.x_lo") / F.col("size")).alias("i"), F.floor(F.col("box.y_lo") / F.col("size")).alias("j"), "box", F.col("first").alias("kind")).repartition(n, *keys, "at", "i", "j")
    inside = (F.col("box.x_lo") > F.col("hb.x_lo")) & (F.col("box.x_hi") < F.col("hb.x_hi")) & (F.col("box.y_lo") > F.col("hb.y_lo")) & (F.col("box.y_hi") < F.col("hb.y_hi"))
    return inner.join(host, [*keys, "at", "i", "j"]).where(inside).select(*keys, "kind", "first", "last", "n")


def net_area(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Area of each root without what is inside it at odd depths and with what is at even ones."""
    signed = F.when(F.col("depth") % 2 == 0, F.col("area")).otherwise(-F.col("area"))
    return tree.groupBy(*keys, "root").agg(F.sum(signed).alias("net_area"), F.count(F.lit(1)).alias("contours"))


def points_in_rings(points: DataFrame, ring_rows: DataFrame, keys: list[str], reach: float = 0.0, cell: float = 8.0) -> DataFrame:
    """points: keys, id, x, y; ring_rows: keys, ring_id, ring: pairs with covers and the border's distance d, where the
    ring covers the point or its border is within reach."""
    p = points.select(*keys, "id", "x", "y", point_box(F.col("x"), F.col("y")).alias("box"))
    r = ring_rows.select(*keys, "ring_id", "ring", rings.bbox(F.col("ring")).alias("box"))
    near = grid_join(p, r, keys, reach, cell)
    out = near.select(*keys, F.col("l.id").alias("id"), F.col("r.ring_id").alias("ring_id"), rings.covers(F.col("r.ring"), F.col("l.x"), F.col("l.y")).alias("covers"), rings.border_distance(F.col("r.ring"), F.col("l.x"), F.col("l.y")).alias("d"))
    return out.where(F.col("covers") | (F.col("d") <= reach))


def nearest(pairs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first of each key's pairs."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_of_key(df: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """Without the second and later rows of a key; rows of which a part of the key is null all stay."""
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*position)))
    return numbered.where(~known | (F.col("_n") == 1)).drop("_n")


def duplicates_of_key(df: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """The second and later rows of each key."""
    numbered = df.dropna(subset=key).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*position)))
    return numbered.where("_n > 1").drop("_n")


def circle_fit(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares circle of each key's points: cx, cy, r, n; null for points on a line. Sums are taken around the
    mean, which keeps them exact enough far from the origin."""
    mean = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    d = df.join(mean, keys).withColumn("u", F.col(x) - F.col("_mx")).withColumn("v", F.col(y) - F.col("_my"))
    s = lambda e, n: F.sum(F.expr(e)).alias(n)
    t = d.groupBy(*keys).agg(F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.count(F.lit(1)).alias("n"), s("u*u", "uu"), s("u*v", "uv"), s("v*v", "vv"), s("u*u*u + u*v*v", "zu"), s("v*v*v + v*u*u", "zv"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    safe = F.when(F.abs(det) > 1e-12, det)
    uc = (F.col("zu") * F.col("vv") - F.col("zv") * F.col("uv")) / (2 * safe)
    vc = (F.col("zv") * F.col("uu") - F.col("zu") * F.col("uv")) / (2 * safe)
    return t.select(*keys, (F.col("mx") + uc).alias("cx"), (F.col("my") + vc).alias("cy"), F.sqrt(uc * uc + vc * vc + (F.col("uu") + F.col("vv")) / F.col("n")).alias("r"), "n")
