"""Whole-drawing operators: one grouped-map kernel a drawing, relational plans around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import pi

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.functions import rings
from linework.functions import segments as S
from linework.kernels import axis as A
from linework.kernels import normalise as N
from linework.kernels import planar as P
from linework.kernels import reading as R
from linework.kernels.primitives import edge, length, path_length, prim_from_row
from linework.plans.once import kinds_of_drawings, settled, tasks
from linework.plans.relational import containment_tree, nearest, points_in_rings
from linework.plans.shared import cut
from linework.schema import CONTOURS, DEFAULT_TOLERANCE, EDGES


def edges_of(pdf: pd.DataFrame) -> list:
    """Kernel edges of one drawing, in the order of edge_id."""
    return [edge(int(r.edge_id), prim_from_row(r.seg), r.role or "unknown", r.style) for r in pdf.itertuples()]


def each_drawing(df: DataFrame, f: Callable, schema, order: str = "edge_id", by_frame: bool = False) -> DataFrame:
    """Rows f(drawing_id, edges) of every drawing, f(drawing_id, frame) with by_frame. Drawings that have the same rows, but
    for the drawing_id, go through f once. One shuffle and sort by drawing; many small drawings go through Python together,
    and a large one is put together from its batches."""
    names = [x.strip().split()[0] for x in schema.split(",")] if isinstance(schema, str) else schema.names
    whole = {n: "Int32" for n in names if n in ("cluster_id", "contour_id", "depth", "parent_id")}

    def rows(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, own in x.groupby("drawing_id", sort=False):
            out += f(d, own if by_frame else edges_of(own))
        return pd.DataFrame(out, columns=names).astype(whole)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for x in frames:
            if not len(x):
                continue
            last = x.drawing_id.iloc[-1]
            if held and held[0].drawing_id.iloc[0] == last:
                held.append(x)
                continue
            more = x.drawing_id == last
            done = pd.concat([*held, x[~more]]) if held else x[~more]
            held = [x[more]]
            if len(done):
                yield rows(done)
        if held:
            yield rows(pd.concat(held))

    df = settled(df.where("drawing_id is not null"))
    kinds = kinds_of_drawings(df)
    firsts = df.join(kinds.where("drawing_id = first").select("drawing_id"), "drawing_id", "left_semi")
    dealt = firsts.repartition(tasks(df), "drawing_id").sortWithinPartitions("drawing_id", order)
    found = dealt.mapInPandas(run, schema).withColumnRenamed("drawing_id", "first")
    return kinds.join(found, "first").select(*names)


def contour_rows(drawing_id: int, found: R.Reading) -> list[tuple]:
    rows = []
    for i, c in enumerate(found.curves):
        rows.append((drawing_id, c.cluster, i, c.kind, c.role, c.depth, c.parent, c.area, path_length([*c.ring, c.ring[0]]), [{"x": float(x), "y": float(y)} for x, y in c.ring], c.edges, None))
    rows += [(drawing_id, None, None, "trash", role, None, None, None, None, None, [i], None) for i, role in found.trash]
    rows += [(drawing_id, None, None, level, None, None, None, None, None, None, None, text) for level, text in found.messages]
    return rows


def spanning_lines(edges: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """drawing_id, ys, xs: where level and upright lines cross the bounds from side to side."""

    def of(drawing_id: int, own: pd.DataFrame) -> list[tuple]:
        return [(drawing_id, *A.spanning_lines(bounds, _lines(own)))]

    return each_drawing(edges.select("drawing_id", "edge_id", *_line_columns()), of, "drawing_id long, ys array<double>, xs array<double>", by_frame=True)


def bridged_runs(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """drawing_id, x0, y0, x1, y1, edges: rows of lines on one straight line whose gaps lie in bridges (drawing_id,
    rings, one row a drawing)."""

    def of(drawing_id: int, own: pd.DataFrame) -> list[tuple]:
        rings = own.rings.iloc[0]
        found = A.bridged_runs(_lines(own), [] if rings is None else [[(p["x"], p["y"]) for p in r] for r in rings])
        return [(drawing_id, *run) for run in found]

    both = edges.select("drawing_id", "edge_id", *_line_columns()).join(bridges.select("drawing_id", "rings"), "drawing_id", "left")
    return each_drawing(both, of, "drawing_id long, x0 double, y0 double, x1 double, y1 double, edges array<int>", by_frame=True)


def _line_columns() -> list:
    return [F.col(f"seg.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]


def _lines(own: pd.DataFrame) -> list[tuple]:
    return list(zip(own.edge_id.astype(int), own.x0, own.y0, own.x1, own.y1, strict=True))


def inspect_edges(edges: DataFrame) -> DataFrame:
    """drawing_id, text: how many edges a drawing has, by role and by kind, and their length."""
    by = edges.groupBy("drawing_id", "role", F.col("seg.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(S.length(F.col("seg"))).alias("length"))
    told = F.array_sort(F.collect_list(F.format_string("%s %s: %d, length %.2f", "role", "kind", "n", "length")))
    text = F.concat(F.lit("edges: "), F.sum("n").cast("string"), F.lit("\n"), F.array_join(told, "\n"))
    return by.groupBy("drawing_id").agg(text.alias("text"))


def inspect_contours(contours: DataFrame) -> DataFrame:
    """drawing_id, text: clusters, inners and what is left over of a reading, and each message."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).cast("string")
    notes = F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.concat(F.col("kind"), F.lit(": "), F.col("message")))))
    text = F.concat(F.lit("clusters: "), n("outer"), F.lit("\ninners: "), n("inner"), F.lit("\nleft over: "), n("trash"), F.array_join(F.transform(notes, lambda x: F.concat(F.lit("\n"), x)), ""))
    return contours.groupBy("drawing_id").agg(text.alias("text"))


def covered_rectangles(edges: DataFrame, min_side: float) -> DataFrame:
    """drawing_id, x_lo, y_lo, x_hi, y_hi, edges: rectangles on the axes with four covered sides and the lines on them."""

    def of(drawing_id: int, own: pd.DataFrame) -> list[tuple]:
        lines = list(zip(own.edge_id.astype(int), own.x0, own.y0, own.x1, own.y1, strict=True))
        return [(drawing_id, *found) for found in A.covered_rectangles(lines, min_side)]

    lines = edges.where("seg.kind = 'line'").select("drawing_id", "edge_id", "seg.x0", "seg.y0", "seg.x1", "seg.y1")
    return each_drawing(lines, of, "drawing_id long, x_lo double, y_lo double, x_hi double, y_hi double, edges array<int>", by_frame=True)


def heal_drawings(edges: DataFrame, tolerance: float = DEFAULT_TOLERANCE, structural: tuple[str, ...] = ()) -> DataFrame:
    """edges (EDGES) of many drawings: their contours with cluster, depth and parent, the edges that are none (kind
    trash) and what is to be said about the drawing (kind warning or error). Drawings are independent: one shuffle."""
    more = frozenset(structural)
    return each_drawing(edges, lambda d, es: contour_rows(d, R.heal(es, tolerance, more)), CONTOURS)


def read_views(edges: DataFrame, max_gap: float, tolerance: float = DEFAULT_TOLERANCE, structural: tuple[str, ...] = ()) -> DataFrame:
    """The outside-in reading: pieces by nearness, their outlines and inner contours."""
    more = frozenset(structural)
    return each_drawing(edges, lambda d, es: contour_rows(d, R.views(es, max_gap, tolerance, more)), CONTOURS)


def _edge_rows(drawing_id: int, edges: list) -> list[tuple]:
    def seg(q):
        s = dict.fromkeys(f.name for f in EDGES["seg"].dataType.fields) | {"kind": q.kind}
        names = {"line": ("x0", "y0", "x1", "y1"), "arc": ("cx", "cy", "r", "a0", "a1"), "circle": ("cx", "cy", "r"), "ellipse": ("cx", "cy", "mx", "my", "ratio", "a0", "a1")}.get(q.kind, ())
        s |= dict(zip(names, q.p))
        if q.kind in ("arc", "ellipse"):
            s["ccw"] = q.ccw
        if q.kind == "spline":
            s |= {"degree": q.degree, "ctrl": [{"x": x, "y": y} for x, y in q.ctrl], "knots": list(q.knots), "weights": list(q.weights) or None, "samples": [{"x": x, "y": y} for x, y in q.samples] or None}
        return s

    return [(drawing_id, e.id, e.role, seg(e.prim), e.style) for e in edges]


def _mapped(edges: DataFrame, f) -> DataFrame:
    """Edges of each drawing through a kernel that returns edges."""
    return each_drawing(edges, lambda d, es: _edge_rows(d, f(es)), EDGES)


def merge_collinear(edges: DataFrame, keep_junctions: bool = False) -> DataFrame:
    return _mapped(edges, lambda es: N.merge_lines(es, keep_junctions))


def merge_cocircular(edges: DataFrame) -> DataFrame:
    return _mapped(edges, N.merge_arcs)


def weld_short(edges: DataFrame) -> DataFrame:
    return _mapped(edges, N.weld)


def refit_tessellations(edges: DataFrame) -> DataFrame:
    return _mapped(edges, N.refit)


def close_near_full_arcs(edges: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    return _mapped(edges, lambda es: N.close_full_arcs(es, tolerance))


def close_free_gaps(edges: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    return _mapped(edges, lambda es: N.close_gaps(es, tolerance))


def split_at_crossings(edges: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """Pieces; edge_id is that of the edge they come from."""
    return _mapped(edges, lambda es: P.planarise(es, tolerance))


def non_contour_candidates(edges: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """drawing_id, edge_id of edges that are no part of an outline, and whether their ends need them to be connected."""

    def found(d, es):
        ids = P.non_contour(es, tolerance)
        joins = P.joining(es, ids)
        return [(d, i, i in joins) for i in sorted(ids)]

    return each_drawing(edges, found, "drawing_id long, edge_id int, joins boolean")


def outer_faces(edges: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """drawing_id, area, perimeter, edge_ids of each drawing's outline, read from the outside."""

    def found(d, es):
        cut = P.planarise(es, tolerance)
        best = P.outer_ring(cut)
        return [] if best is None else [(d, best[0], path_length([*best[1], best[1][0]]), sorted({cut[k].parent for k in best[2]}))]

    return each_drawing(edges, found, "drawing_id long, area double, perimeter double, edge_ids array<int>")


def face_areas(edges: DataFrame, tolerance: float = DEFAULT_TOLERANCE) -> DataFrame:
    """drawing_id, face, area of every bounded face of the planar drawing, largest first."""

    def found(d, es):
        areas = sorted((a for a, _, _ in P.faces(P.merge_nodes(P.planarise(es, tolerance), 0.01))), reverse=True)
        return [(d, i, a) for i, a in enumerate(areas)]

    return each_drawing(edges, found, "drawing_id long, face int, area double")


def spatial_islands(edges: DataFrame, gap: float) -> DataFrame:
    """drawing_id, edge_id, island: the number of the group of near edges, 0 for the largest box."""

    found = lambda d, es: [(d, e.id, i) for i, group in enumerate(N.islands(es, gap)) for e in group]
    return each_drawing(edges, found, "drawing_id long, edge_id int, island int")


def gap_pairs(edges: DataFrame, tolerance: float) -> DataFrame:
    """drawing_id, edge_a, end_a, edge_b, end_b: free ends that are joined, nearest first, each once."""

    def found(d, es):
        es, _ = N.split_finite(es)
        return [(d, es[i].id, ka, es[j].id, kb) for (_, i, ka), (_, j, kb) in N.pair_ends(N.free_ends(es), tolerance)]

    return each_drawing(edges, found, "drawing_id long, edge_a int, end_a int, edge_b int, end_b int")


def simplify_points(points: DataFrame, closed: bool = True, arc_tolerance: float | None = None) -> DataFrame:
    """points: drawing_id, i, x, y: the primitives that are fitted to each run, as kinds and lengths in order."""

    def found(d, x):
        prims = N.simplify(list(zip(x.x.tolist(), x.y.tolist())), closed, arc_tolerance=arc_tolerance) if len(x) > 1 else []
        return [(d, i, q.kind, length(q)) for i, q in enumerate(prims)]

    return each_drawing(points, found, "drawing_id long, part int, kind string, length double", "i", True)


def clusters(contours: DataFrame) -> DataFrame:
    """One row a cluster: outer and net area, number of inners, perimeters, box."""
    own = contours.where("contour_id is not null")
    signed = F.when(F.col("depth") % 2 == 0, F.col("area")).otherwise(-F.col("area"))
    outer = F.col("kind") == "outer"
    box = rings.bbox(F.first(F.when(outer, F.col("ring")), ignorenulls=True))
    return own.groupBy("drawing_id", "cluster_id").agg(
        F.max(F.when(outer, F.col("area"))).alias("outer_area"), F.sum(signed).alias("area"), F.sum(F.when(outer, 0).otherwise(1)).alias("inners"),
        F.sum(F.when(outer, F.col("perimeter"))).alias("outer_perimeter"), F.coalesce(F.sum(F.when(~outer, F.col("perimeter"))), F.lit(0.0)).alias("inner_perimeter"), box.alias("box"),
    )


def validate_edges(edges: DataFrame) -> DataFrame:
    """drawing_id, level, code, n: what is wrong with the input."""
    length_ = S.length(F.col("seg"))
    p, q = S.start_point(F.col("seg")), S.end_point(F.col("seg"))
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    broken = bad(p["x"]) | bad(p["y"]) | bad(q["x"]) | bad(q["y"])
    told = edges.select("drawing_id", broken.alias("broken"), (length_ <= 1e-9).alias("flat"), S.round_point(p).alias("n0"), S.round_point(q).alias("n1"))
    each = told.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("broken").cast("int")).alias("broken"), F.sum(F.col("flat").cast("int")).alias("flat"))
    ends = told.where("not broken and n0 <> n1").select("drawing_id", F.explode(F.array("n0", "n1")).alias("node")).groupBy("drawing_id", "node").count().where("count = 1").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("open"))
    all_ = each.join(ends, "drawing_id", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    checks = F.array(
        F.struct(F.lit("error").alias("level"), F.lit("non_finite").alias("code"), F.col("broken").alias("n")),
        F.struct(F.lit("error").alias("level"), F.lit("all_degenerate").alias("code"), F.when(F.col("flat") == F.col("n"), F.col("n")).otherwise(0).alias("n")),
        F.struct(F.lit("warning").alias("level"), F.lit("open_ends").alias("code"), F.col("open").alias("n")),
    )
    return all_.select("drawing_id", F.explode(checks).alias("c")).select("drawing_id", "c.level", "c.code", "c.n").where("n > 0")


def validate_contours(contours: DataFrame) -> DataFrame:
    """drawing_id, level, code, n: what is wrong with the result."""
    # written once: three branches read it, and each would read the drawings anew
    own = cut(contours.where("contour_id is not null").select("drawing_id", "cluster_id", "contour_id", "kind", "area", "ring"), "contours")
    empty = own.where("kind = 'outer' and not area > 0").groupBy("drawing_id").agg(F.count(F.lit(1)).alias("n")).select("drawing_id", F.lit("error").alias("level"), F.lit("empty_outer").alias("code"), "n")
    inner = own.where("kind = 'inner'").select("drawing_id", "cluster_id", "contour_id", F.explode("ring").alias("p"))
    outer = own.where("kind = 'outer'").select("drawing_id", "cluster_id", F.col("ring").alias("outer"))
    out = inner.join(outer, ["drawing_id", "cluster_id"]).where(~rings.covers(F.col("outer"), F.col("p.x"), F.col("p.y"), 1e-6))
    beyond = out.groupBy("drawing_id").agg(F.count_distinct("contour_id").alias("n")).select("drawing_id", F.lit("warning").alias("level"), F.lit("inner_outside").alias("code"), "n")
    return empty.unionAll(beyond)


def anchor_points(points: DataFrame, contours: DataFrame, snap: float = 0.0) -> DataFrame:
    """points: drawing_id, id, x, y: the cluster of each: the first whose outer covers it, else the nearest within snap."""
    outers = contours.where("kind = 'outer'").select("drawing_id", F.col("cluster_id").alias("ring_id"), "ring")
    near = points_in_rings(points, outers, ["drawing_id"], snap).withColumn("away", F.when(F.col("covers"), 0.0).otherwise(F.col("d")))
    best = nearest(near, ["drawing_id", "id"], ["away", "ring_id"]).select("drawing_id", "id", F.col("ring_id").alias("cluster_id"))
    return points.join(best, ["drawing_id", "id"], "left")


def leader_targets(points: DataFrame, contours: DataFrame, distance: float = 0.5) -> DataFrame:
    """The contour that each leader's tip points at: the nearest border within distance (then the smaller, then the first
    by number), else the smallest inner one that covers the tip."""
    own = contours.where("contour_id is not null").select("drawing_id", F.col("contour_id").alias("ring_id"), "ring")
    facts = contours.where("contour_id is not null").select("drawing_id", F.col("contour_id").alias("ring_id"), "area", "kind")
    near = points_in_rings(points, own, ["drawing_id"], distance).join(facts, ["drawing_id", "ring_id"])
    border = F.col("d") <= distance
    rank = near.where(border | (F.col("covers") & (F.col("kind") != "outer"))).withColumn("way", F.when(border, 0).otherwise(1)).withColumn("away", F.when(border, F.col("d")).otherwise(0.0))
    best = nearest(rank, ["drawing_id", "id"], ["way", "away", "area", "ring_id"]).select("drawing_id", "id", F.col("ring_id").alias("target"))
    return points.join(best, ["drawing_id", "id"], "left")


def dimension_references(points: DataFrame, contours: DataFrame, distance: float = 0.5) -> DataFrame:
    """points: drawing_id, id (of the measured point), dim_id, pos, x, y: drawing_id, dim_id, refs: distinct contours on
    whose borders the points of each dimension lie, in order."""
    hit = leader_targets(points, contours, distance).where("target is not null")
    return hit.groupBy("drawing_id", "dim_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda t: t["target"])).alias("refs"))


def texts_by_cluster(points: DataFrame, contours: DataFrame, snap: float = 0.0) -> DataFrame:
    """points: drawing_id, id, x, y, text: texts of each cluster: of all that cover a text's anchor, else of the nearest."""
    outers = contours.where("kind = 'outer'").select("drawing_id", F.col("cluster_id").alias("ring_id"), "ring")
    near = points_in_rings(points, outers, ["drawing_id"], snap)
    inside = near.where("covers")
    rest = nearest(near.join(inside.select("drawing_id", "id").distinct(), ["drawing_id", "id"], "left_anti"), ["drawing_id", "id"], ["d", "ring_id"])
    both = inside.unionByName(rest).join(points.select("drawing_id", "id", "text"), ["drawing_id", "id"])
    return both.groupBy("drawing_id", F.col("ring_id").alias("cluster_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda t: t["text"]).alias("texts"))


def inject(clusters_: DataFrame, texts: DataFrame, injector, schema: str = "map<string,string>") -> DataFrame:
    """clusters_ with custom, what the caller's function makes of each cluster's texts, and warning, where it failed."""

    @F.pandas_udf(f"struct<custom:{schema},warning:string>")
    def run(all_: pd.Series) -> pd.DataFrame:
        out = []
        for t in all_:
            try:
                out.append((injector(list(t) if t is not None else []), None))
            except Exception as e:  # the caller's code may fail in any way; that is told, not raised
                out.append(({}, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["custom", "warning"])

    both = clusters_.join(texts, ["drawing_id", "cluster_id"], "left").withColumn("_r", run(F.col("texts")))
    return both.select(*clusters_.columns, "_r.custom", "_r.warning")


def rotate_contours(contours: DataFrame, angle: Column | float, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    return contours.withColumn("ring", F.transform("ring", lambda p: S.rotate_point(p, S.col(angle), ox, oy)))


def rotate_edges(edges: DataFrame, angle: Column | float, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    return edges.withColumn("seg", S.rotated(F.col("seg"), S.col(angle), ox, oy))


def longest_segment(edges: DataFrame) -> DataFrame:
    """drawing_id, edge_id, length, angle (degrees in [0, 180)) of each drawing's longest edge."""
    s = F.col("seg")
    a = rings.chord_angle_deg(S.start_point(s), S.end_point(s))
    told = edges.select("drawing_id", "edge_id", S.length(s).alias("length"), a.alias("angle"))
    return told.groupBy("drawing_id").agg(F.max_by(F.struct("edge_id", "length", "angle"), F.struct("length", -F.col("edge_id"))).alias("m")).select("drawing_id", "m.*")


def rotate_to_longest(edges: DataFrame, target_deg: float = 0.0) -> DataFrame:
    """Edges of each drawing turned so that its longest edge has this direction."""
    turn = longest_segment(edges).select("drawing_id", ((target_deg - F.col("angle")) * pi / 180).alias("_a"))
    both = edges.join(turn, "drawing_id")
    return both.withColumn("seg", S.rotated(F.col("seg"), F.col("_a"))).drop("_a")


def containment(boxes: DataFrame) -> DataFrame:
    return containment_tree(boxes, ["drawing_id"])
