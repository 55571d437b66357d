"""Points and rings that all lie in a few cells are met in shares, not by one task."""

from __future__ import annotations

from linework.queries import relations
from linework.queries.views import Views


def test_points_are_met_in_shares(spark):
    n = [r["count"] for r in relations.pip(Views(spark, "/root/testdata/sf0.001"), whole=True).groupBy("g").count().collect()]
    assert len(n) >= 8 and max(n) < sum(n) / 4
