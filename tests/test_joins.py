"""Joins by nearness on repeated rows, hot keys and uneven places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.operators import joins as J


def test_repeated_queries_are_rows_of_their_own(spark):
    cells = spark.createDataFrame([(x, y, 5.0 + x) for x in range(3) for y in range(3)], "x bigint, y bigint, u double")
    q = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (1, 2.0, 2.0), (2, 1.25, 0.0), (3, 9.0, 9.0)], "id int, fx double, fy double")
    out = sorted((r["id"], r["fx"], r["value"]) for r in J.bilinear(q, cells, F.col("fx"), F.col("fy"), "u").collect())
    assert out == [(1, 0.5, 5.5), (1, 0.5, 5.5), (1, 2.0, 7.0), (2, 1.25, 6.25)]
    within = J.bilinear_within(q, cells, F.col("fx"), F.col("fy"), "u", 3, 3).collect()
    assert sorted((r["id"], r["value"] is None) for r in within) == [(1, False), (1, False), (1, False), (2, False), (3, True)]


@pytest.mark.parametrize("parts,one_task", [(1, 0), (7, 0), (40, 100), (7, 10**6)])
def test_as_of_with_one_hot_key(spark, parts, one_task):
    """Half of all rows have one key, a few have none; repeated rows stay."""
    rng = np.random.default_rng(parts)
    keys = lambda n: [None if k > 9 else "hot" if k > 4 else f"k{k}" for k in rng.integers(0, 11, n).tolist()]
    left = [(k, t, i) for i, (k, t) in enumerate(zip(keys(400), rng.integers(0, 300, 400).tolist(), strict=True))]
    left += left[:5]
    right = [(k, 2 * t, float(t)) for t, k in enumerate(keys(150))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = J.as_of(spark.createDataFrame(left, "k string, t int, id int"), spark.createDataFrame(right, "k string, rt int, v double"), ["k"], "t", "rt", "v", one_task).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for k, t, i in left:
        own = sorted((rt, v) for kk, rt, v in right if kk == k)
        low, high = [x for x in own if x[0] <= t], [x for x in own if x[0] > t]
        # A value at the very time is the one before; the one after is the next from there.
        want.append((i, low[-1] if low else (None, None), high[0] if high else (None, None)))
    got = [(r["id"], (r["before_at"], r["before"]), (r["after_at"], r["after"])) for r in out]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def uneven(rng, n):
    """Nine of ten places in one square of a thousandth of the extent, some of them in one point."""
    dense = rng.random((n * 9 // 10, 2)) * 1e-3 + 0.4
    dense[:40] = dense[0]
    return np.concatenate([dense, rng.random((n - len(dense), 2))])


@pytest.mark.parametrize("k,crowd", [(1, 8), (5, 16), (12, 512)])
def test_nearest_among_uneven_places(spark, k, crowd):
    rng = np.random.default_rng(k)
    p, q = uneven(rng, 1500), np.concatenate([uneven(rng, 150), [[9.0, -3.0], [0.4005, 0.4005]]])
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "vec_id bigint, px double, py double")
    asked = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "qid bigint, qx double, qy double")
    got = {(r["qid"], r["rank"]): (r["vec_id"], r["distance"]) for r in J.k_nearest(asked, points, k, crowd).collect()}
    for i, v in enumerate(q):
        d = np.sqrt((p[:, 0] - v[0]) * (p[:, 0] - v[0]) + (p[:, 1] - v[1]) * (p[:, 1] - v[1]))
        for rank, at in enumerate(np.lexsort((np.arange(len(p)), d))[:k]):
            assert got[i, rank + 1] == (at, pytest.approx(d[at], abs=1e-15))
    assert len(got) == k * len(q)


def test_dense_squares_are_split(spark):
    """No leaf holds more than the crowd but those of one place, and queries meet few leaves."""
    from windrift.operators.quadtree import candidates, tree

    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(uneven(rng, 4000))], "vec_id bigint, px double, py double")
    t = tree(points, 32)
    leaves = t.places.groupBy("level", "sx", "sy").agg(F.count("*").alias("n"), F.count_distinct("px").alias("distinct")).collect()
    assert sum(r["n"] for r in leaves) == 4000 and all(r["n"] <= 32 or r["distinct"] == 1 for r in leaves)
    asked = points.select(F.col("vec_id").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    assert candidates(t, asked, 5).groupBy("qid").count().agg(F.max("count")).first()[0] <= 40
