"""Operators without a SQL twin against numpy, and cases that SQL tables don't hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.operators import domain, geometry, graph, joins, regrid, triangles


@pytest.fixture(scope="module")
def plane(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1, (400, 2))
    rows = [(k, float(x), float(y), float(2 * x - 3 * y + 1 + x * y)) for k, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "vec_id bigint, px double, py double, val double"), p, np.array([r[3] for r in rows])


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(4)
    q = rng.uniform(0.2, 0.8, (30, 2))
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(q)], "qid bigint, qx double, qy double"), q


def nearest(p, q, k):
    d = np.hypot(*(p - q).T)
    return np.lexsort((np.arange(len(p)), d))[:k], d


def test_kriging_is_the_solved_system(plane, asked):
    df, p, v = plane
    got = dict(regrid.kriging(asked[0], df, "val", 12, 0.3).collect())
    for i, q in enumerate(asked[1]):
        at, d = nearest(p, q, 12)
        a = np.ones((13, 13))
        a[:12, :12] = 1 - np.exp(-np.hypot(*(p[at][:, None] - p[at]).transpose(2, 0, 1)) / 0.3)
        a[12, 12] = 0
        w = np.linalg.solve(a, np.r_[1 - np.exp(-d[at] / 0.3), 1])[:12]
        assert got[i] == pytest.approx(np.clip(w @ v[at], v[at].min(), v[at].max()), abs=1e-9)


def test_least_squares_meet_a_quadratic(plane, asked):
    got = dict(regrid.moving_least_squares(asked[0], plane[0], "val", 24).collect())
    for i, (x, y) in enumerate(asked[1]):
        assert got[i] == pytest.approx(2 * x - 3 * y + 1 + x * y, abs=1e-5)


def test_barycentric_weights_meet_planes(spark, plane, asked):
    df, p, _ = plane
    far = asked[0].union(spark.createDataFrame([(99, 50.0, 50.0)], asked[0].schema))
    got = triangles.barycentric(far, df).join(df, "vec_id").groupBy("qid").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("px")).alias("x"), F.count("*").alias("n")).collect()
    for r in got:
        assert r["w"] == pytest.approx(1)
        if r["qid"] == 99:
            assert r["n"] == 1
        else:
            assert r["x"] == pytest.approx(asked[1][r["qid"]][0], abs=1e-7)
    # The same triangles, however many are near: one whose circle holds no other point.
    for near in (3, 40):
        rows = triangles.barycentric(asked[0], df, near).collect()
        for i, q in enumerate(asked[1]):
            at = sorted(r["vec_id"] for r in rows if r["qid"] == i)
            assert len(at) == 3 and all(-1e-9 <= r["weight"] <= 1 for r in rows if r["qid"] == i)
            a, b, c = p[at]
            m = np.array([b - a, c - a]) * 2
            centre = np.linalg.solve(m, [b @ b - a @ a, c @ c - a @ a])
            assert (np.hypot(*(p - centre).T) >= np.hypot(*(a - centre)) * (1 - 1e-9)).all()


def test_triangles_among_uneven_columns(spark):
    """Most columns are crowded into two spots; triangles reach from one to the other and to the rim."""
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random((300, 2)) * 1e-3 + 0.3, rng.random((300, 2)) * 1e-2 + 0.7, rng.random((30, 2)), [[0, 0], [1, 0], [0, 1], [1, 1]]])
    q = np.concatenate([rng.random((40, 2)) * 1e-3 + 0.3, rng.random((60, 2)), [[0.5, 0.0], [1.0, 1.0]]])
    columns = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "vec_id bigint, px double, py double")
    places = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "qid bigint, qx double, qy double")
    rows = triangles.barycentric(places, columns, 6).collect()
    for i, v in enumerate(q):
        own = {r["vec_id"]: r["weight"] for r in rows if r["qid"] == i}
        assert len(own) == 3 and min(own.values()) >= -1e-9 and np.allclose(sum(w * p[k] for k, w in own.items()), v, atol=1e-9)
        a, b, c = p[list(own)]
        centre = np.linalg.solve(np.array([b - a, c - a]) * 2, [b @ b - a @ a, c @ c - a @ a])
        assert (np.hypot(*(p - centre).T) >= np.hypot(*(a - centre)) * (1 - 1e-6)).all()


def test_barycentric_weights_of_few_columns(spark):
    q = spark.createDataFrame([(1, 0.1, 0.1), (2, 9.0, 9.0)], "qid bigint, qx double, qy double")
    at = lambda rows: spark.createDataFrame(rows, "vec_id bigint, px double, py double")
    assert triangles.barycentric(q, at([])).count() == 0
    assert sorted(map(tuple, triangles.barycentric(q, at([(7, 0.0, 0.0)])).collect())) == [(1, 7, 1.0), (2, 7, 1.0)]
    got = triangles.barycentric(q, at([(5, 0.0, 0.0), (6, 1.0, 0.0), (8, 0.0, 1.0), (9, 0.0, 0.0)])).collect()
    assert sorted((r["qid"], r["vec_id"], round(r["weight"], 9)) for r in got)[:3] == [(1, 5, 0.8), (1, 6, 0.1), (1, 8, 0.1)] and len(got) == 4


def test_spline_passes_through_samples(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 8))
    df = spark.createDataFrame([(0, y, x, float(a[y, x])) for y in range(6) for x in range(8)], "z bigint, y bigint, x bigint, u double")
    got = {r["target"]: r["value"] for r in regrid.spline_layer(df, 8, 6, "u", [(0.0, 0.0), (7.0, 5.0), (3.0, 2.0), (7.5, 1.0)]).collect()}
    assert got[0] == pytest.approx(a[0, 0]) and got[1] == pytest.approx(a[5, 7]) and got[2] == pytest.approx(a[2, 3]) and (got[3] is None or np.isnan(got[3]))


def test_volume_spectrum_keeps_the_variance(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 3, 5))
    df = spark.createDataFrame([(z, y, x, float(a[z, y, x])) for z in range(4) for y in range(3) for x in range(5)], "z bigint, y bigint, x bigint, u double")
    total = regrid.volume_spectrum(df, 5, 3, 4, "u").agg(F.sum("energy")).first()[0]
    assert total == pytest.approx(a.var())


def test_short_side_of_a_turned_rectangle():
    c, s = np.cos(0.7), np.sin(0.7)
    p = np.array([(0, 0), (4, 0), (4, 1.5), (0, 1.5), (2, 0.7)]) @ np.array([[c, s], [-s, c]])
    assert geometry.short_side(p) == pytest.approx(1.5)
    assert geometry.short_side(p[:2]) == 0


def test_clip_to_a_triangle():
    box = np.array([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])
    ring = np.array([(1.0, 1.0), (5.0, 1.0), (5.0, 2.0), (1.0, 2.0), (1.0, 1.0)])
    p = geometry.clip_ring(ring, box)
    area = abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2
    assert area == pytest.approx(1.5)
    assert len(geometry.clip_ring(ring + 10, box)) == 0


def test_nearest_joins_with_nothing_to_find(spark, plane, asked):
    none = plane[0].where("vec_id < 0")
    assert joins.k_nearest(asked[0], none, 3).count() == 0
    assert joins.k_nearest(asked[0].where("qid < 0"), plane[0], 3).count() == 0
    lost = spark.createDataFrame([(1, None, 0.5), (2, float("nan"), 0.5), (3, 9e3, 9e3)], asked[0].schema)
    assert {r["qid"] for r in joins.k_nearest(lost, plane[0], 2).collect()} == {3}


def test_components_with_lone_nodes(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a bigint, b bigint")
    nodes = spark.range(1, 8).withColumnRenamed("id", "node")
    assert dict(graph.components(links, nodes).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}


def test_coverage_policies():
    assert domain.coverage(0) and domain.coverage(9, "warn") and domain.coverage(9, "ignore")
    with pytest.raises(ValueError):
        domain.coverage(9)
