"""Where Spark and the engine of the SQL differ in the last digit or in a sign of zero, results follow the SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from linework.functions import build, regions, shapes
from linework.functions import segments as S
from linework.operators import curves
from linework.plans import relational as R
from linework.queries.views import r6


def test_rounding_near_halves(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = [*((rng.integers(0, 10**9, 20_000) + 0.5) / 1e6), *(-(rng.integers(0, 10**7, 20_000) + 0.5) / 1e6), -0.0, 4.9999999999999994e-7, 5e-7, 1e300, 5e9, -1e15 / 7, 1e302, float("nan"), float("inf")]
    pd.DataFrame({"i": range(len(x)), "x": x}).to_parquet(tmp_path / "x.parquet")
    got = spark.read.parquet(str(tmp_path / "x.parquet")).select("i", r6(F.col("x")).alias("r")).toPandas().sort_values("i").r.to_numpy()
    want = duckdb.connect().sql(f"SELECT i, round(x, 6) + 0e0 AS r FROM '{tmp_path}/x.parquet' ORDER BY i").df().r.to_numpy()
    np.testing.assert_array_equal(got, want)
    assert spark.range(1).select(r6(F.lit(None).cast("double"))).first()[0] is None


def test_a_path_that_turns_back_keeps_the_sign_of_zero(spark):
    at = lambda x, y: S.point(F.lit(x), F.lit(y))
    turns = spark.range(1).select(regions.turn_at(at(9.0, 1.0), at(1.0, 1.0), at(5.0, 1.0)).alias("a"), regions.turn_at(at(1.0, 1.0), at(9.0, 1.0), at(5.0, 1.0)).alias("b"), regions.turn_at(at(1.0, 1.0), at(3.0, 1.0), at(5.0, 1.0)).alias("c")).first()
    cross = lambda u, v: np.arctan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1])
    assert tuple(turns) == (cross((-8.0, 0.0), (4.0, 0.0)), cross((8.0, 0.0), (-4.0, 0.0)), 0.0) and turns.a == -np.pi and turns.b == np.pi


def test_points_just_the_reach_apart(spark):
    """Differences that are at most the reach though their sum is rounded to less."""
    rng = np.random.default_rng(4)
    x = rng.integers(-50_000, 50_000, 3000) / 1000
    rows = [(2 * k + j, float(v), 7.0 * k, k) for k, a in enumerate(x) for j, v in enumerate((a, (round(a * 1000) + 1500) / 1000))]
    near = {k for k in range(len(x)) if rows[2 * k + 1][1] - rows[2 * k][1] <= 1.5}
    assert any(a[1] + 1.5 < b[1] for a, b in zip(rows[::2], rows[1::2], strict=True) if a[3] in near)
    got = R.points_within(spark.createDataFrame(rows, "id long, x double, y double, g long").select("g", "id", "x", F.lit(0.0).alias("y")), ["g"], 1.5)
    assert {r.g for r in got.collect()} == near


def test_a_long_spline_passes_its_points(spark):
    """Forty points that go to and fro: samples of the curve are farther from them than the curve."""
    pts = [(float(5 + 95 * (i % 2)), float(1 + (i * 37) % 50)) for i in range(40)]
    got = curves.interpolated(spark.createDataFrame([(1, pts)], "id long, pts array<struct<x:double,y:double>>")).first()
    assert got.n_ctrl == 40 and got.miss < 1e-6


def test_no_rectangle_without_sides(spark):
    ring = lambda *p: build.polygon(F.array(*[S.point(float(x), float(y)) for x, y in p]))
    flat, made = ring((3, 1), (3, 1), (3, 9), (3, 9)), ring((0, 0), (3, 0), (3, 9), (0, 9))
    assert tuple(spark.range(1).select(shapes.as_rectangle(flat).isNotNull(), shapes.as_rectangle(made).isNotNull()).first()) == (False, True)
