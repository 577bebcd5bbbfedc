"""Clusters over zooms against taking the markers one after the other."""

import math
import random

import pytest

from fieldmark.operators import clusters


def one_after_the_other(points, zooms, radius, off):
    """(zoom, lead): members, by hand; points are (id, order, lat, lng)."""
    level, found = [(p, o, lat, lng, [p]) for p, o, lat, lng in sorted(points, key=lambda p: (p[1], p[0]))], {}
    for zoom in range(off - 1, min(zooms) - 1, -1):
        heads = []
        for p, o, lat, lng, members in level:
            sine = math.sin(math.radians(max(-85.0511287798, min(85.0511287798, lat))))
            x, y = (lng + 180) / 360 * 256 * 2**zoom, (0.5 - math.log((1 + sine) / (1 - sine)) / (4 * math.pi)) * 256 * 2**zoom
            near = [(way, k) for k, h in enumerate(heads) if (way := (x - h[0]) ** 2 + (y - h[1]) ** 2) <= radius * radius]
            if near:
                heads[min(near)[1]][2][4].extend(members)
            else:
                heads.append((x, y, (p, o, lat, lng, list(members))))
        level = [h[2] for h in heads]
        if zoom in zooms:
            found |= {(zoom, h[0]): sorted(h[4]) for h in level}
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_at_two_zooms(spark, seed):
    rng = random.Random(seed)
    points = [(i, rng.randrange(200), rng.gauss(45, 6), rng.gauss(10, 8)) for i in range(300)]
    points += [(1000 + i, 500 + i, 45.0 + i * 1e-7, 10.0) for i in range(200)]  # a dense place
    where = {p: (lat, lng) for p, _, lat, lng in points}
    got = clusters.marker_clusters(spark.createDataFrame([*points, (9999, 1, None, 3.0)], "id long, _ord long, lat double, lng double").repartition(3), [5, 3], off=6).collect()
    want = one_after_the_other(points, [5, 3], 50, 6)
    assert {(r.zoom, r.lead): r.n for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        members = want[r.zoom, r.lead]
        assert r.lat == pytest.approx(sum(where[m][0] for m in members) / len(members)) and r.lng == pytest.approx(sum(where[m][1] for m in members) / len(members))


def test_markers_stand_for_themselves_from_a_zoom_on(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 1.0), (2, 2, 1.0, 1.0)], "id long, _ord long, lat double, lng double")
    assert sorted((r.zoom, r.lead, r.n) for r in clusters.marker_clusters(rows, [10, 9]).collect()) == [(9, 1, 2), (10, 1, 1), (10, 2, 1)]
    assert clusters.marker_clusters(rows.limit(0), [9]).count() == 0
