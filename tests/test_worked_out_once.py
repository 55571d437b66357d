"""Lambdas work out what they name at each mention, so values that cost something are named once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linework.functions import build, regions, shapes
from linework.functions import segments as S


@pytest.mark.parametrize(("made", "sign"), [(lambda m, p, q: shapes.as_other(m), "cos("), (lambda m, p, q: regions.splits_ring(m, p, q, 0.1), "zip_with("), (lambda m, p, q: S.track_length(S.discretize(m)), "acos(")])
def test_mentions(spark, made, sign):
    assert str(made(*map(F.col, "mpq"))).lower().count(sign) <= 10


def test_values_stay(spark):
    ring = F.array(*[S.point(float(x), float(y)) for x, y in ((0, 0), (8, 0), (8, 4), (4, 1), (0, 4))])
    split = lambda y: regions.splits_ring(ring, S.point(-1.0, y), S.point(9.0, y), 0.1)
    got = spark.range(1).select(split(3.0).alias("a"), split(0.0).alias("b"), split(5.0).alias("c"), regions.splits_ring(ring, S.point(1.0, 1.0), S.point(1.0, 1.0)).alias("d"), shapes.as_other(build.polygon(ring)).alias("o")).first()
    assert (got.a, got.b, got.c, got.d) == (True, False, False, False)
    assert (got.o.shape, got.o.sides, got.o.length, got.o.width, got.o.angle, got.o.cx, got.o.cy) == ("polygon", 5, 8.0, 4.0, 0.0, 4.0, 1.8)
