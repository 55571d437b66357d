"""The distance of a ring's border, taken in steps."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from linework.functions import rings


def test_steps_give_the_least_distance_of_the_sides(spark):
    r = random.Random(3)
    places = [[(r.uniform(-9, 9), r.uniform(-9, 9)) for _ in range(n)] for n in (1, 2, 3, 5, 13)] + [[], None, [(1.0, 1.0)] * 4, [(0.0, 0.0), (0.0, 0.0), (3.0, 0.0)]]
    rows = [(i, p, r.uniform(-9, 9), r.uniform(-9, 9)) for i, p in enumerate(places * 20)] + [(999, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], 2.0, 0.0), (1000, [(0.0, None), (4.0, 0.0)], 1.0, 1.0), (1001, [(0.0, 0.0), (4.0, 0.0)], None, 1.0)]
    df = spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>, x double, y double")
    ring, x, y = F.col("ring"), F.col("x"), F.col("y")
    plain = F.array_min(F.zip_with(ring, rings.next_points(ring), lambda p, q: rings.to_segment_distance(x, y, p, q)))
    got = df.select("id", rings.border_distance(ring, x, y).alias("d"), plain.alias("want"))
    assert got.where(~F.col("d").eqNullSafe(F.col("want"))).count() == 0 and got.where("d > 0").count() > 100
    plan = got.select("d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" / ") == 1, "a side is worked out once"
