"""Nearest neighbours against brute force: exact scores and ranks, recall, hot groups and hard rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.llm.common import Scratch
from windrift.llm.neighbours import Index, Search, buckets, probes, search

SCHEMA = "vec_id bigint, embedding array<float>, bucket string, block string, q string, rid string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "b", "c", "d", "e") for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    """query_id -> the k nearest (score, vec_id) of the distinct sound rows, queries of one id together."""
    sound = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v):
            v = np.array(v, np.float32).astype(float)
            sound[i, v.tobytes()] = v
    out = defaultdict(list)
    for (i, _), v in sound.items():
        if i is not None and i % every == 0:
            near = [(float(np.sqrt(((w - v) ** 2).sum())), j is None, j) for (j, _), w in sound.items() if j != i and len(w) == len(v)]
            out[i].append([(d, j) for d, _, j in sorted(near, key=lambda t: (t[0], t[1], t[2] or 0))[:k]])
    return out


def result(spark, rows, how=Search(), parts=4):
    out = defaultdict(list)
    for r in search(Scratch(spark), table(spark, rows).repartition(parts), F.col("vec_id") % 100 == 0, how).collect():
        out[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return {k: [(s, i) for _, s, i in sorted(v, key=lambda t: t[0])] for k, v in out.items()}


def recall(got, want):
    """The share of true neighbours found; every row found must have its exact score and be in order."""
    hit = total = 0
    for i, lists in want.items():
        assert len(lists) == 1 and got[i] == sorted(got[i], key=lambda t: (t[0], t[1])) and len(got[i]) == len(lists[0])
        hit += len({j for _, j in got[i]} & {j for _, j in lists[0]})
        total += len(lists[0])
    assert set(got) == {i for i in want if want[i][0]}
    return hit / total


def test_probes_come_in_order_of_success():
    """The estimated success of probed buckets is what falls into them."""
    rng = np.random.default_rng(1)
    how, index = Search(tables=3, recall=0.9), Index(6, 1.0, 2.0)
    q = rng.standard_normal((4, 20))
    who, bucket, beyond = probes(q, np.ones(4), how, index)
    assert not beyond.any() and len(set(zip(who, bucket, strict=True))) == len(who)
    for i in range(4):
        near = rng.standard_normal((4000, 20))
        near = q[i] + near / np.linalg.norm(near, axis=1)[:, None]
        asked = set(bucket[who == i].tolist())
        own = buckets(q[i : i + 1], how, index)[:, 0]
        assert set(own.tolist()) <= asked
        found = np.isin(buckets(near, how, index), list(asked)).any(axis=0).mean()
        assert found >= 0.85


@pytest.mark.parametrize("parts", [1, 30])
def test_recall_of_spread_and_clustered_vectors(spark, parts):
    rng = np.random.default_rng(2)
    spread = rng.standard_normal((2500, 24))
    centres = rng.standard_normal((40, 24)) * 4
    near = centres[rng.integers(0, 40, 2500)] + rng.standard_normal((2500, 24)) * 0.2
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(np.r_[spread, near])]
    assert recall(result(spark, rows, Search(block=256, askers=8), parts), brute(rows)) >= 0.93


def test_a_third_are_copies_or_near_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, rng.standard_normal(16)) for i in range(1500)]
    rows += [(1500 + i, base) for i in range(1000)] + [(2500 + i, base + rng.standard_normal(16) * 1e-3) for i in range(500)]
    rows = [(i, v.astype(np.float32)) for i, v in rows]
    got, want = result(spark, rows, Search(block=128, askers=4)), brute(rows)
    assert recall(got, want) >= 0.93
    assert got[2000] == want[2000][0] and [i for _, i in got[2000]] == list(range(1500, 1510))


def test_hard_rows(spark):
    rows = [(100, [1.0, 0.0]), (200, [1.0, 0.0]), (200, [1.0, 0.0]), (-100, [0.5, 0.5]), (None, [1.0, 0.1]), (7, None), (8, []), (9, [0.0, 0.0]), (300, [float("nan"), 1.0]), (11, [float("inf"), 0.0]), (400, [1.0, None]), (500, [1.0, 2.0, 3.0]), (0, [1e6, -1e6]), (12, [1.0, 0.0])]
    got, want = result(spark, rows, parts=3), brute(rows)
    assert set(got) == {100, 200, -100, 0} and all(got[i] == want[i][0] for i in got)
    # Two queries of one id are answered each.
    two = [(100, [1.0, 0.0]), (100, [5.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.5])]
    assert sorted(result(spark, two)[100]) == sorted(x for v in brute(two)[100] for x in v)


def test_far_queries_find_all_that_is_theirs(spark):
    """A query far from everything has no filled buckets around it: it is compared with every row."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype(np.float32)) for i in range(1, 600)] + [(0, np.full(8, 1e4, np.float32))]
    got, want = result(spark, rows, Search(block=64)), brute(rows)
    assert got[0] == want[0][0]


def test_nothing_to_find(spark):
    assert result(spark, []) == {} and result(spark, [(1, [1.0])]) == {} and result(spark, [(100, [1.0])]) == {}


def test_recall_on_the_table(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(path).collect()]
    assert recall(result(spark, rows), brute(rows)) >= 0.93
