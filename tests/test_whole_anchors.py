"""Points in rings over the whole tables against brute force, which has no cut of ids."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from linework.queries import QUERIES
from linework.queries.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def brute(spark):
    """(id, ring, inside, distance of the border) of all points with all rings."""
    v = Views(spark, SF)
    points = v.points().toPandas()
    qx, qy = 30 + points.x.to_numpy() / 4, 25 + points.y.to_numpy() / 4
    out = []
    for r in v.ring_rows().collect():
        a = np.array([(p.x, p.y) for p in r.ring])
        inside, dist = np.zeros(len(qx), bool), np.full(len(qx), np.inf)
        for (x0, y0), (x1, y1) in zip(a, np.roll(a, -1, axis=0), strict=True):
            square = (x1 - x0) ** 2 + (y1 - y0) ** 2
            t = np.clip(((qx - x0) * (x1 - x0) + (qy - y0) * (y1 - y0)) / square, 0, 1) if square else np.zeros(len(qx))
            dist = np.minimum(dist, np.hypot(qx - x0 - t * (x1 - x0), qy - y0 - t * (y1 - y0)))
            if y0 != y1:
                inside ^= ((y0 > qy) != (y1 > qy)) & (qx < (x1 - x0) * (qy - y0) / (y1 - y0) + x0)
        out += [(int(i), r.d, bool(w), float(d)) for i, w, d in zip(points.id, inside, dist, strict=True) if w or d <= 2]
    return out


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, SF).collect()]


def test_covers_of_all_points(spark, brute):
    first = {}
    for i, d, inside, _ in brute:
        if inside:
            first[i] = min(first.get(i, d), d)
    assert max(first) >= 60 and dict(rows(spark, "join14_anchor_cover_whole")) == first


def test_points_of_all_rings(spark, brute):
    want = Counter(d for _, d, inside, _ in brute if inside)
    assert max(want) >= 400 and dict(rows(spark, "join18_texts_per_ring_whole")) == dict(want)


def test_nearest_rings_of_all_points(spark, brute):
    near = defaultdict(list)
    for i, d, _, dist in brute:
        near[i].append((dist, d))
    best = {i: min(x) for i, x in near.items()}
    got = {i: dist for i, dist in rows(spark, "join19_nearest_within_whole")}
    want = {i: x[0] for i, x in best.items() if x[0] <= 2}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    got = {i: (d, dist) for i, d, dist in rows(spark, "join15_leader_target_whole")}
    want = {i: x for i, x in best.items() if x[0] <= 0.5}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][1] for i in want)
