"""Whitening against exact whole-number sums and numpy's own decompositions."""

from collections import defaultdict

import numpy as np
import pytest

from windrift.llm.common import Scratch
from windrift.llm.whitening import Whiten, rotated, whitened

SCHEMA = "vec_id bigint, embedding array<float>, width string, n string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "w", "n", "c") for i, v in rows], SCHEMA)


def exact(rows):
    """For each length: n, sums, whole numbers and ids."""
    groups = defaultdict(list)
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v):
            groups[len(v)].append((i, [int(np.floor(1024 * np.float64(np.float32(x)))) + 100000 for x in v]))
    return {d: (len(g), [sum(x[k] for _, x in g) for k in range(d)], g) for d, g in groups.items()}


def check(spark, rows, how=Whiten(), parts=5):
    out = whitened(Scratch(spark), table(spark, rows).repartition(parts), how).collect()
    groups = exact(rows)
    assert len(out) == sum(n * min(how.components, d) for d, (n, _, _) in groups.items())
    for d, (n, sums, own) in groups.items():
        x = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for _, v in own], dtype=object)
        centred = x.astype(float) / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        order = np.argsort(-values)
        values, vectors = values[order], vectors[:, order]
        k = min(how.components, d)
        seen = defaultdict(list)
        for r in out:
            if r["n"] == n:
                seen[r["component"]].append(r)
        want_dev = sorted(((i if i is not None else -1), sum(int(a) ** 2 for a in row)) for (i, _), row in zip(own, x, strict=True))
        for c in range(1, k + 1):
            got = sorted(seen[c], key=lambda r: (r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"]))
            assert [(r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"]) for r in got] == want_dev
            assert {r["explained"] for r in got} and abs(got[0]["explained"] - values[c - 1] / values.sum()) <= 1e-9 * max(1e-3, values[c - 1] / values.sum())
            assert got[0]["identity_error"] <= 1e-9
            z = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
            rank = sorted(range(n), key=lambda q: (own[q][0] if own[q][0] is not None else -1, sum(int(a) ** 2 for a in x[q])))
            z, w = z[rank], np.array([r["whitened"] for r in got])
            assert min(np.abs(z - w).max(), np.abs(z + w).max()) < 1e-6


def test_rotations_find_the_singular_values():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 32):
        a = rng.standard_normal((d, d)) * 10.0 ** rng.integers(-6, 3, d)
        lengths, v = rotated(np.triu(a))
        assert np.allclose(lengths, np.linalg.svd(np.triu(a), compute_uv=False), rtol=1e-11)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert rotated(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_small_deviations_stay_accurate():
    """Singular values 10^8 apart: a squared matrix would lose the small ones."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    want = 10.0 ** -np.arange(0, 12, 2)
    lengths, _ = rotated(np.linalg.qr(np.linalg.qr(rng.standard_normal((50, 6)))[0] * want @ np.eye(6), mode="r"))
    assert np.allclose(lengths, want, rtol=1e-6) and q.shape == (6, 6)


@pytest.mark.parametrize("parts", [1, 70])
def test_against_numpy(spark, parts):
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.standard_normal(12) * np.arange(1, 13) / 5).astype(np.float32)) for i in range(400)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (5, rows[9][1])]
    rows += [(900, None), (901, []), (902, [float("nan")] * 12), (903, [1.0] * 11 + [None]), (904, [float("inf")] + [0.0] * 11)]
    rows += [(1000 + i, rng.standard_normal(3).astype(np.float32)) for i in range(40)]
    check(spark, rows, Whiten(block=64, fan=4), parts)


def test_one_row_copies_and_nothing(spark):
    out = whitened(Scratch(spark), table(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in sorted(out, key=lambda r: r["component"])] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = whitened(Scratch(spark), table(spark, [(i, [float(i), 1.0]) for i in range(4)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in flat)
    none = whitened(Scratch(spark), table(spark, [(1, None), (2, [])]))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries_do_not_crash(spark):
    out = whitened(Scratch(spark), table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert len(out) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in out)
