"""Queries over the whole tables whose SQL takes a part, and the rows of the survey under their own ids."""

import duckdb
import numpy as np

from linework.kernels.axis import covered_rectangles
from linework.queries import QUERIES
from linework.queries.views import BOXES

SF = "/root/testdata/sf0.001"


def test_all_parts_are_refitted(spark):
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").count()
    got = QUERIES["agg16_refit_tessellations_whole"](spark, "/root/testdata/sf0.01").collect()
    assert parts > 200 and len(got) == parts and {(r.kind, r.edges) for r in got} == {("circle", 1)}


def test_all_boxes_that_overlap(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    want = con.sql(f"WITH {BOXES} SELECT a.id, b.id FROM boxes a JOIN boxes b ON a.d = b.d AND a.id < b.id AND a.x_lo <= b.x_hi AND b.x_lo <= a.x_hi AND a.y_lo <= b.y_hi AND b.y_lo <= a.y_hi").fetchall()
    assert sorted(tuple(r) for r in QUERIES["box_pairs_whole"](spark, SF).collect()) == sorted(want)


def test_curves_of_all_segments(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    segs = lines.count() - lines.select("l_orderkey").distinct().count()
    assert QUERIES["proj12_bezier_samples_whole"](spark, SF).count() == 17 * segs
    got = QUERIES["proj12_adaptive_polyline"](spark, SF).toPandas()
    ends = {(r.d, r.i): r for r in QUERIES["proj1_line_segments"](spark, SF).collect()}
    assert len(got.groupby(["d", "i"])) == segs
    sizes = got.groupby(["d", "i"]).size()
    assert sizes.nunique() > 1 and sizes.max() <= 800
    t = np.linspace(0, 1, 501)[:, None]
    for (d, i), own in list(got.sort_values("k").groupby(["d", "i"]))[:200]:
        e, p = ends[d, i], own[["x", "y"]].to_numpy()
        curve = (1 - t) ** 3 * (e.x0, e.y0) + 3 * (1 - t) ** 2 * t * (e.x0, e.y1) + 3 * (1 - t) * t**2 * (e.x1, e.y0) + t**3 * (e.x1, e.y1)
        a, step = p[:-1], np.diff(p, axis=0)
        square = np.maximum((step**2).sum(1), 1e-12)
        u = np.clip(((curve[:, None] - a) * step).sum(2) / square, 0, 1)
        assert np.hypot(*np.moveaxis(curve[:, None] - a - u[..., None] * step, 2, 0)).min(1).max() < 0.08


def test_covered_rectangles():
    box = lambda i, x, y, w, h: [(i, x, y, x + w, y), (i + 1, x + w, y, x + w, y + h), (i + 2, x + w, y + h, x, y + h), (i + 3, x, y + h, x, y)]
    assert covered_rectangles(box(0, 0, 0, 10, 5), 2.0) == [(0, 0, 10, 5, [0, 1, 2, 3])]
    assert covered_rectangles(box(0, 0, 0, 10, 5)[:3], 2.0) == []
    split = [*box(0, 0, 0, 10, 5), (4, 4, 0, 4, 5)]
    assert [r[:4] for r in covered_rectangles(split, 2.0)] == [(0, 0, 4, 5), (0, 0, 10, 5), (4, 0, 10, 5)]
    notched = [(0, 0, 0, 4.5, 0), (1, 5.5, 0, 10, 0), *box(2, 0, 0, 10, 5)[1:], (9, 20, 20, 30, 21)]
    assert covered_rectangles(notched, 2.0) == [(0, 0, 10, 5, [0, 1, 3, 4, 5])]
    assert covered_rectangles([(0, 0, 0, 3, 0), (1, 7, 0, 10, 0), *box(2, 0, 0, 10, 5)[1:]], 2.0) == []


def test_plates_are_covered_rectangles(spark):
    got = {r.d: r for r in QUERIES["join26_covered_rectangles"](spark, SF).collect()}
    parts = [r for r in spark.read.parquet(f"{SF}/part.parquet").collect() if r.p_size >= 2]
    assert sorted(got) == sorted(r.p_partkey for r in parts)
    for r in parts:
        q, x, y = got[r.p_partkey], r.p_partkey % 100, r.p_partkey % 50
        assert (q.x_lo, q.y_lo, q.x_hi, q.y_hi) == (x, y, x + r.p_size, y + r.p_size / 2 + 1) and sorted(q.edges) == [0, 1, 2, 3]
