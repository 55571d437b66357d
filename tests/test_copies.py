"""Rows that many others equal are worked out once, and the whole result is returned."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from linework.operators import drawings as D
from linework.plans import relational as R
from linework.plans.once import each_kind
from linework.queries import QUERIES
from linework.queries.views import Views


def test_copies_of_nested_boxes(spark):
    """40,000 copies each of three nested boxes: 4.8 billion pairs of boxes, 3 of different ones."""
    at = F.col("id") % 3
    box = F.struct((0.0 + at).alias("x_lo"), (0.0 + at).alias("y_lo"), (30.0 - at).alias("x_hi"), (20.0 - at).alias("y_hi"))
    boxes = spark.range(120_000).select(F.lit(1).alias("d"), "id", box.alias("box"), (600.0 - at * 96).alias("area"))
    got = R.containment_tree(boxes, ["d"]).groupBy((F.col("id") % 3).alias("k"), "depth", "parent").agg(F.count("*").alias("n"), F.max(F.when(F.col("root") == F.col("id"), 1).otherwise(0)).alias("own"), F.max("root").alias("root")).orderBy("k").collect()
    assert [(r.k, r.depth, r.parent, r.n, r.own) for r in got] == [(0, 0, None, 40_000, 1), (1, 40_000, 0, 40_000, 0), (2, 80_000, 1, 40_000, 0)]
    assert [r.root for r in got[1:]] == [119_997, 119_997]


def test_pairs_of_equal_boxes(spark, tmp_path):
    """Parts whose keys differ by thousands have one box if they are of one size; pairs of copies are pairs too."""
    parts = spark.range(0, 60_000, 250).select(F.col("id").alias("p_partkey"), (F.col("id") % 3 * 9 + 5).cast("int").alias("p_size"))
    parts.write.parquet(str(tmp_path / "part.parquet"))
    boxes = Views(spark, str(tmp_path)).boxes().collect()
    assert len({(b.d, b.x_lo, b.y_lo, b.x_hi, b.y_hi) for b in boxes}) * 10 < len(boxes)
    want = sorted((a.id, b.id) for a in boxes for b in boxes if a.d == b.d and a.id < b.id and a.x_lo <= b.x_hi and b.x_lo <= a.x_hi and a.y_lo <= b.y_hi and b.y_lo <= a.y_hi)
    assert want and sorted(map(tuple, QUERIES["box_pairs_whole"](spark, str(tmp_path)).collect())) == want


def test_kernels_see_equal_drawings_once(spark):
    """Each call of the kernel gives a value of its own, so drawings that share one went through it together."""
    edge = lambda k: F.struct((k % 3).alias("x"), F.when(k % 3 == 1, -0.0).otherwise(0.0).alias("z"), F.lit(None).cast("double").alias("nothing"))
    rows = spark.range(300).select(F.col("id").alias("drawing_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("edge_id")).withColumn("seg", edge(F.col("drawing_id")))
    rows = rows.unionByName(rows.where("drawing_id = 6 and edge_id = 1"))
    got = D.each_drawing(rows, lambda d, x: [(d, len(x), str(uuid.uuid4()))], "drawing_id long, n int, call string", by_frame=True).toPandas()
    assert sorted(got.drawing_id) == list(range(300)) and got.call.nunique() == 4
    assert set(got[got.n == 3].drawing_id) == {6} and got[got.drawing_id != 6].groupby(got.drawing_id % 3).call.nunique().tolist() == [1, 1, 1]


def test_kernels_see_equal_rows_once(spark):
    def of(frames):
        for x in frames:
            yield x[["id"]].assign(call=[str(uuid.uuid4()) for _ in x.id], size=[len(v) for v in x.v])

    rows = spark.createDataFrame([(i % 50, [float(i % 4), None][: 1 + i % 2]) for i in range(200)], "id long, v array<double>")
    got = each_kind(rows, ["v"], of, "call string, size int").toPandas()
    assert len(got) == 200 and got.call.nunique() == 4 and sorted(got.id) == sorted(i % 50 for i in range(200))


def test_clusters_of_crowded_points(spark):
    """300,000 points in two crowds and some beside them: pairs of a crowd are never made."""
    free = [(900_000, 3.0, 0.0), (900_001, 4.4, 0.0), (900_002, 6.0, 0.0), (900_003, float("nan"), 0.0), (900_004, None, 0.0), (900_005, float("inf"), 0.0), (900_006, 7.5, 0.0), (900_007, 103.0, 0.0)]
    crowds = spark.range(300_000).select("id", (F.col("id") % 2 * 100 + F.col("id") % 1499 / 1000).alias("x"), F.lit(0.0).alias("y"))
    got = dict(map(tuple, R.near_clusters(crowds.unionAll(spark.createDataFrame(free, "id long, x double, y double")), 1.5).where("id < 4 or id >= 900000").collect()))
    # 3.0 is more than 1.5 from 1.498, so is 6.0 from 4.4; 7.5 is 1.5 from 6.0, and 103.0 is 1.502 from 101.498
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 900_000: 900_000, 900_001: 900_000, 900_002: 900_002, 900_003: 900_003, 900_004: 900_004, 900_005: 900_005, 900_006: 900_002, 900_007: 900_007}


def test_clusters_of_free_points(spark):
    rng = np.random.default_rng(5)
    at = rng.uniform(-30, 30, (900, 2)).round(1)
    label = np.arange(900)
    near = np.sqrt((at[:, None, 0] - at[None, :, 0]) ** 2 + (at[:, None, 1] - at[None, :, 1]) ** 2) <= 1.5
    while True:
        new = np.where(near, label[None], 900).min(1)
        if (new == label).all():
            break
        label = new
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    assert dict(map(tuple, R.near_clusters(rows, 1.5).collect())) == dict(enumerate(label.tolist()))
