"""Polygons laid over each other, against coverage counted at many places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.operators import overlay as O

RINGS = "array<array<struct<x:double,y:double>>>"
PLACES = np.stack([v.ravel() for v in np.meshgrid(np.linspace(-1.0137, 11.0291, 211), np.linspace(-1.0519, 11.0173, 197))], axis=1)


def winding(ring, places=PLACES):
    out = np.zeros(len(places), int)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if ay != by:
            spans = (ay <= places[:, 1]) != (by <= places[:, 1])
            out += np.where(spans & (ax + (places[:, 1] - ay) / (by - ay) * (bx - ax) > places[:, 0]), 1 if by > ay else -1, 0)
    return out


def covered(polygons):
    """Where polygons lie; every place in one of them at most, outlines counter-clockwise and holes clockwise."""
    out = np.zeros(len(PLACES), int)
    for p in polygons:
        assert O.area(p[0][:-1]) > 0 and all(O.area(h[:-1]) < 0 for h in p[1:])
        assert all((r[0] == r[-1]).all() and len({tuple(x) for x in r[:-1]}) == len(r) - 1 for r in p)
        out += sum(winding(r[:-1]) for r in p)
    assert set(out.tolist()) <= {0, 1}
    return out == 1


def total(polygons):
    return sum(O.area(r[:-1]) for p in polygons for r in p)


@pytest.mark.parametrize("seed", range(40))
def test_random_polygons(seed):
    rng = np.random.default_rng(seed)
    polygons = [[rng.random((rng.integers(3, 9), 2)) * 10 for _ in range(rng.integers(1, 3))] for _ in range(rng.integers(2, 6))]
    if seed % 2:  # corners on a coarse grid touch and overlap in all ways; places lie between
        polygons = [[np.rint(r) for r in p] for p in polygons]
    own = [sum(winding(r) for r in p) % 2 == 1 for p in polygons]
    for p, c in zip(polygons, own, strict=True):
        assert (covered(O.simple(p)) == c).all()
    union = O.united(polygons)
    assert (covered(union) == np.any(own, axis=0)).all()
    both = O.common([polygons[0]], [polygons[1]])
    assert (covered(both) == (own[0] & own[1])).all()
    a, b = O.simple(polygons[0]), O.simple(polygons[1])
    assert abs(total(O.united(polygons[:2])) + total(both) - total(a) - total(b)) < 1e-6
    assert abs(total(O.united([*union, *union])) - total(union)) < 1e-7


def test_holes_of_holes_and_touching_corners():
    box = lambda a, b: np.array([(a, a), (b, a), (b, b), (a, b)], float)
    nested = O.simple([box(0, 9), box(1, 8), box(2, 7), box(3, 6)])
    assert [len(p) for p in nested] == [2, 2] and total(nested) == 81 - 49 + 25 - 9
    corner = O.united([[box(0, 1)], [box(1, 2)]])
    assert len(corner) == 2 and total(corner) == 2
    touching = O.simple([box(0, 4), np.array([(0, 2), (2, 1), (2, 3)], float)])  # a hole that touches the outline
    assert [len(p) for p in touching] == [2] and total(touching) == 14


def test_nothing_comes_of_no_area(spark):
    rows = [(1, None), (2, []), (3, [[]]), (4, [None]), (5, [[(0.0, 0.0), (1.0, 1.0)]]), (6, [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]]), (7, [[(0.0, 0.0), None, (2.0, 0.0), (2.0, float("nan")), (2.0, 2.0)]])]
    df = spark.createDataFrame(rows, f"id int, rings {RINGS}")
    out = O.resolved(df, ["id"], "rings").collect()
    assert [(r["id"], r["part"], len(r["rings"][0])) for r in out] == [(7, 0, 4)]
    assert O.dissolved(df.withColumn("g", F.lit("x")), "g", "id", "rings").count() == 1
    assert O.clipped_parts(df, ["id"], "rings", [(0, 0), (1, 0), (1, 1)]).count() <= 1


@pytest.mark.parametrize("crowd", [2, 5, 1000])
def test_large_groups_are_united_in_rounds(spark, crowd):
    """Two thirds of all footprints are one group; null is a group of its own."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        x, y = (rng.random(2) * 8).tolist()
        rows.append((i, "hot" if i % 3 else ["a", "b", None][i // 3 % 3], [[(x, y), (x + 1.5, y), (x + 1.5, y + 1.5), (x, y + 1.5)]]))
    out = O.dissolved(spark.createDataFrame(rows, f"id int, g string, rings {RINGS}").repartition(5), "g", "id", "rings", crowd).collect()
    for g in {r[1] for r in rows}:
        got = covered([[np.array([(p["x"], p["y"]) for p in ring]) for ring in r["rings"]] for r in out if r["g"] == g])
        assert (got == np.any([winding(np.array(r[2][0])) != 0 for r in rows if r[1] == g], axis=0)).all()
        assert sorted(r["part"] for r in out if r["g"] == g) == list(range(sum(r["g"] == g for r in out)))
