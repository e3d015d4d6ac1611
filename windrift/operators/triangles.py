"""Places within the Delaunay triangles of scattered columns, without a triangulation.

The triangle around a place is the one whose circle holds no column. It is found by pivoting: from any
triangle around the place, a column inside its circle takes the seat of one corner such that the place
stays inside; circles only shrink, and the last one is empty. Each place starts with a triangle of the
hull's corners, pivots among the columns near it, and is then asked about all columns: the one nearest
to the circle's centre, from a quad-tree, either lies inside and goes on, or proves the triangle.
So every place needs its near columns and a few rounds, however uneven the columns are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrift.operators.geometry import hull
from windrift.operators.graph import checkpoint_folder
from windrift.operators.joins import nearest_in
from windrift.operators.quadtree import tree

STATE = "qid bigint, qx double, qy double, ids array<bigint>, xs array<double>, ys array<double>, cx double, cy double, radius double, proven boolean"


def corners_of(columns: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places) of the convex hull's corners: hulls of the tasks' columns, then the hull of these. Hulls have few corners."""

    def corners(batches):
        for b in batches:
            if len(b):
                b = b.sort_values("vec_id").drop_duplicates(["px", "py"])
                yield pd.DataFrame(hull(b[["px", "py"]].to_numpy(float)), columns=["px", "py"]).merge(b, on=["px", "py"])[["vec_id", "px", "py"]]

    schema = "vec_id bigint, px double, py double"
    found = columns.select("vec_id", "px", "py").mapInPandas(corners, schema).repartition(1).mapInPandas(corners, schema).toPandas().sort_values("vec_id").drop_duplicates(["px", "py"])
    h = hull(found[["px", "py"]].to_numpy(float)) if len(found) else np.empty((0, 2))
    id_of = {(x, y): i for i, x, y in found[["vec_id", "px", "py"]].itertuples(index=False)}
    return np.array([id_of[tuple(p)] for p in h.tolist()], np.int64), h


def weights(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """[n, 3] barycentric weights of places q [n, 2] in triangles t [n, 3, 2]; not finite where a triangle is flat."""
    u, v, w = t[:, 0] - q, t[:, 1] - q, t[:, 2] - q
    part = lambda a, b: a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
    s = np.stack([part(v, w), part(w, u), part(u, v)], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return s / s.sum(axis=1, keepdims=True)


def circles(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the circles through triangles [n, 3, 2]."""
    a, b = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
    d = 2 * (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.stack([(b[:, 1] * aa - a[:, 1] * bb) / d, (a[:, 0] * bb - b[:, 0] * aa) / d], axis=1)
    return t[:, 0] + c, np.sqrt((c * c).sum(1))


def pivoted(q: np.ndarray, ids: np.ndarray, t: np.ndarray, near_ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, triangles, moved): triangles around places q after pivoting among near columns [n, m, 2] (NaN where there are fewer).

    Columns on a circle are not inside it, so of equally good triangles the first one found stays.
    """
    ids, t, moved = ids.copy(), t.copy(), np.zeros(len(q), bool)
    open_ = np.arange(len(q))
    for _ in range(200):
        if not len(open_):
            break
        centre, radius = circles(t[open_])
        d = np.sqrt(((near[open_] - centre[:, None]) ** 2).sum(2))
        d = np.where(np.isfinite(d), d, np.inf)
        best = d.argmin(axis=1) if d.shape[1] else np.zeros(len(open_), np.int64)
        inside = d[np.arange(len(open_)), best] < radius * (1 - 1e-9) if d.shape[1] else np.zeros(len(open_), bool)
        open_, best = open_[inside], best[inside]
        new = near[open_, best]
        own, steps = weights(q[open_], t[open_]), weights(new, t[open_])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(steps > 1e-12, np.maximum(own, 0) / steps, np.inf)
        seat = ratio.argmin(axis=1)
        fine = np.isfinite(ratio.min(axis=1))
        open_, best, seat = open_[fine], best[fine], seat[fine]
        t[open_, seat], ids[open_, seat] = near[open_, best], near_ids[open_, best]
        moved[open_] = True
    return ids, t, moved


def barycentric(queries: DataFrame, columns: DataFrame, near: int = 24) -> DataFrame:
    """(qid, vec_id, weight): the three source columns around each place and their weights; outside the hull the nearest one.

    queries: qid, qx, qy; columns: vec_id, px, py. Of columns at one place the lowest id counts. The
    weights serve every level: join them to the levels and sum weight * value.
    """
    spark = queries.sparkSession
    checkpoint_folder(spark)
    columns = columns.where("px IS NOT NULL AND py IS NOT NULL AND NOT isnan(px) AND NOT isnan(py)").groupBy("px", "py").agg(F.min("vec_id").cast("long").alias("vec_id")).select("vec_id", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).checkpoint()
    queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qx").cast("double").alias("qx"), F.col("qy").cast("double").alias("qy")).where("qx IS NOT NULL AND qy IS NOT NULL AND NOT isnan(qx) AND NOT isnan(qy)")
    squares = tree(columns)
    if squares is None:
        return queries.select("qid", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("weight")).where("false")
    hull_ids, h = corners_of(columns)

    def told(b: pd.DataFrame, q: np.ndarray, ids: np.ndarray, t: np.ndarray, proven: np.ndarray) -> pd.DataFrame:
        centre, radius = circles(t) if len(t) else (np.empty((0, 2)), np.empty(0))
        return pd.DataFrame({"qid": b["qid"].to_numpy(), "qx": q[:, 0], "qy": q[:, 1], "ids": list(ids), "xs": list(t[:, :, 0]), "ys": list(t[:, :, 1]), "cx": centre[:, 0], "cy": centre[:, 1], "radius": radius, "proven": proven})

    def padded(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = max((len(v) for v in b["near"]), default=0)
        ids, places = np.full((len(b), n), -1, np.int64), np.full((len(b), n, 2), np.nan)
        for i, some in enumerate(b["near"]):  # a few columns each
            for j, s in enumerate(some):
                ids[i, j], places[i, j] = s["vec_id"], (s["px"], s["py"])
        return ids, places

    def start(batches):
        """Places within the hull: the triangle of its first corner and two others around them, pivoted among near columns."""
        angle = np.unwrap(np.arctan2(*(h[1:] - h[0]).T[::-1])) if len(h) > 2 else np.empty(0)
        for b in batches:
            if len(h) < 3 or not len(b):
                continue
            q = b[["qx", "qy"]].to_numpy(float)
            a = np.arctan2(*(q - h[0]).T[::-1])
            a += 2 * np.pi * np.round((angle.mean() - a) / (2 * np.pi))
            k = np.clip(np.searchsorted(angle, a, "right"), 1, len(angle) - 1)
            seats = np.stack([np.zeros(len(k), np.int64), k, k + 1], axis=1)
            inside = (weights(q, h[seats]) >= -1e-12).all(axis=1)
            b, q, seats = b[inside], q[inside], seats[inside]
            ids, t, _ = pivoted(q, hull_ids[seats], h[seats], *padded(b))
            yield told(b, q, ids, t, np.zeros(len(b), bool))

    def go_on(batches):
        for b in batches:
            q, ids = b[["qx", "qy"]].to_numpy(float), np.array(b["ids"].tolist(), np.int64).reshape(-1, 3)
            t = np.stack([np.array(b[c].tolist(), float).reshape(-1, 3) for c in ("xs", "ys")], axis=2)
            ids, t, moved = pivoted(q, ids, t, *padded(b))
            yield told(b, q, ids, t, ~moved)

    gathered = lambda rows: rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "px", "py"))).alias("near"))  # noqa: E731 - a few columns for each place
    first = gathered(nearest_in(squares, queries, near)).join(queries, "qid")
    state = first.mapInPandas(start, STATE).checkpoint()
    lone = queries.join(state.select("qid"), "qid", "left_anti")
    done = nearest_in(squares, lone, 1).select("qid", "vec_id", F.lit(1.0).alias("weight"))
    while not state.isEmpty():
        asked = gathered(nearest_in(squares, state.select("qid", F.col("cx").alias("qx"), F.col("cy").alias("qy")), 4))
        state = state.join(asked, "qid").mapInPandas(go_on, STATE).checkpoint()
        corner = state.where("proven").select("qid", "qx", "qy", F.posexplode(F.arrays_zip("ids", "xs", "ys")).alias("seat", "c"), "xs", "ys")
        x1, y1, x2, y2 = (F.try_element_at(c, F.pmod(F.col("seat") + k, F.lit(3)).cast("int") + 1) for k in (1, 2) for c in ("xs", "ys"))
        # A corner's weight is the area between the place and the other two, of the whole.
        part = (x1 - F.col("qx")) * (y2 - F.col("qy")) - (y1 - F.col("qy")) * (x2 - F.col("qx"))
        whole = (x1 - F.col("c.xs")) * (y2 - F.col("c.ys")) - (y1 - F.col("c.ys")) * (x2 - F.col("c.xs"))
        done = done.unionByName(corner.select("qid", F.col("c.ids").alias("vec_id"), (part / whole).alias("weight")))
        state = state.where("NOT proven")
    return done
