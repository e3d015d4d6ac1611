"""Footprints as arrays of ring points: measures, checks, clipping and meshes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrift.operators.graph import spread
from windrift.operators.ordered import carried, in_ranges


def ring_area(ring: Column) -> Column:
    """Signed area of a ring of (x, y) points, first point repeated at the end or not."""
    n = F.size(ring)
    ahead = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, ahead, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v) / 2


def footprint_area(rings: Column) -> Column:
    """Area of the outer (first) ring less its holes."""
    return F.abs(ring_area(rings[0])) - F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda a, r: a + F.abs(ring_area(r)))


def without_small_holes(rings: Column, least: float) -> Column:
    return F.filter(rings, lambda r, i: (i == 0) | (F.abs(ring_area(r)) >= least))


def defect(ring: Column) -> Column:
    """Why a ring is no area: null, empty, too few points, not closed, no area; null if it is one."""
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    return (
        F.when(ring.isNull(), "null")
        .when(F.size(ring) == 0, "empty")
        .when(F.size(ring) < 4, "too_few_points")
        .when((first["x"] != last["x"]) | (first["y"] != last["y"]), "not_closed")
        .when(F.abs(ring_area(ring)) < 1e-12, "zero_area")
    )


def repaired(rings: Column) -> Column:
    """Rings without missing and doubled points, closed; those that are no area go, null if the outer one does."""
    points = lambda r: F.filter(r, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))

    def once(r: Column) -> Column:
        return F.filter(r, lambda p, i: (i == 0) | (r[F.greatest(i - 1, F.lit(0))]["x"] != p["x"]) | (r[F.greatest(i - 1, F.lit(0))]["y"] != p["y"]))

    def closed(r: Column) -> Column:
        first, last = F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(-1))
        return F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), r).otherwise(F.concat(r, F.slice(r, 1, 1)))

    mended = F.transform(F.transform(F.transform(F.filter(rings, lambda r: r.isNotNull()), points), once), closed)
    fine = lambda r: (F.size(r) >= 4) & (F.abs(ring_area(r)) >= 1e-12)
    return F.when(F.size(mended) > 0, F.when(fine(mended[0]), F.filter(mended, fine)))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """Twice the signed area of the triangle a, b, c."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points):
        out: list = []
        for q in points:
            while len(out) > 1 and turn(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def short_side(p: np.ndarray) -> float:
    """Shorter side of the smallest rectangle around the points."""
    h = hull(p)
    if len(h) < 3:
        return 0.0
    e = np.roll(h, -1, axis=0) - h
    e /= np.hypot(e[:, 0], e[:, 1])[:, None]
    a, b = h @ e.T, h @ np.stack([-e[:, 1], e[:, 0]], axis=1).T
    wide, deep = np.ptp(a, axis=0), np.ptp(b, axis=0)
    best = (wide * deep).argmin()
    return float(min(wide[best], deep[best]))


def short_sides(buildings: DataFrame, key: str, ring: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "short_side": [short_side(np.array([(p["x"], p["y"]) for p in r], float)) if r is not None and len(r) else 0.0 for r in b[ring]]})

    return spread(buildings.select(key, ring)).mapInPandas(run, f"{key} {buildings.schema[key].dataType.simpleString()}, short_side double")


def clip_ring(p: np.ndarray, box: np.ndarray) -> np.ndarray:
    """The ring's part inside a convex counter-clockwise box, edge by edge."""
    for a, b in zip(box, np.roll(box, -1, axis=0), strict=True):
        if not len(p):
            break
        side = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
        out = []
        for i in range(len(p)):
            j = (i + 1) % len(p)
            if side[i] >= 0:
                out.append(p[i])
            if side[i] * side[j] < 0:
                out.append(p[i] + (p[j] - p[i]) * side[i] / (side[i] - side[j]))
        p = np.array(out).reshape(-1, 2)
    return p


def clipped(buildings: DataFrame, key: str, ring: str, box: list[tuple[float, float]]) -> DataFrame:
    """(key, ring): footprints cut to a convex box; those outside go. Bounds are compared before Python sees a row."""
    b = np.array(box, float)
    near = buildings.withColumn("bounds", bounds(F.col(ring))).where((F.col("bounds.x1") >= b[:, 0].min()) & (F.col("bounds.x0") <= b[:, 0].max()) & (F.col("bounds.y1") >= b[:, 1].min()) & (F.col("bounds.y0") <= b[:, 1].max()))

    def run(batches):
        for batch in batches:
            rows = [(k, clip_ring(np.array([(p["x"], p["y"]) for p in r], float), b)) for k, r in zip(batch[key], batch[ring], strict=True)]
            rows = [(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in rows if len(p) > 2]
            yield pd.DataFrame({key: [k for k, _ in rows], ring: [p for _, p in rows]})

    return near.select(key, ring).mapInPandas(run, f"{key} {buildings.schema[key].dataType.simpleString()}, {ring} array<struct<x:double,y:double>>")


def terrain_triangles(cells: DataFrame, nx: int, ny: int, height: str) -> DataFrame:
    """(triangle, corner, x, y, height): two triangles for each grid square, from the corner heights; one join."""
    square = F.col("sy") * nx + F.col("sx")
    corners = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(c).alias("corner"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for t, tri in enumerate((((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))) for c, (dx, dy) in enumerate(tri)))
    # Seen from a grid point: the squares of which it is a corner.
    seen = cells.withColumn("k", F.explode(corners)).withColumns({"sx": F.col("x") - F.col("k.dx"), "sy": F.col("y") - F.col("k.dy")})
    seen = seen.where((F.col("sx") >= 0) & (F.col("sx") < nx - 1) & (F.col("sy") >= 0) & (F.col("sy") < ny - 1))
    return seen.select((square * 2 + F.col("k.t")).cast("bigint").alias("triangle"), F.col("k.corner").cast("int").alias("corner"), "x", "y", F.col(height).alias("height"))


# ---------------------------------------------------------------- solids

CORNERS = "array<struct<x:double,y:double,z:double>>"


def open_ring(p: np.ndarray, clockwise: bool = False) -> np.ndarray:
    """The ring without its repeated end, counter-clockwise (or clockwise, as holes are)."""
    p = p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p
    area = (p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()
    return p[::-1] if (area < 0) != clockwise else p


def bridged(outer: np.ndarray, holes: list[np.ndarray]) -> np.ndarray:
    """One ring around the outline and its holes, each joined by a cut to a corner that it can see: holes from the right first."""
    ring = outer
    for hole in sorted(holes, key=lambda h: -h[:, 0].max()):
        start = int(hole[:, 0].argmax())
        m = hole[start]
        # The edge met by a ray to the right, and of the corners in the triangle to its end the one nearest in angle.
        a, b = ring, np.roll(ring, -1, axis=0)
        crossing = (a[:, 1] <= m[1]) != (b[:, 1] <= m[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 0] + (m[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        x = np.where(crossing & (x >= m[0] - 1e-12), x, np.inf)
        edge = int(x.argmin())
        end = edge if a[edge, 0] > b[edge, 0] else (edge + 1) % len(ring)
        hit, p = np.array([x[edge], m[1]]), ring[end]
        side = lambda u, v, w: (v[0] - u[0]) * (w[:, 1] - u[1]) - (v[1] - u[1]) * (w[:, 0] - u[0])
        s = np.stack([side(m, hit, ring), side(hit, p, ring), side(p, m, ring)])
        inside = np.flatnonzero(((s > 1e-12).all(axis=0)) | ((s < -1e-12).all(axis=0)))
        if len(inside):
            d = ring[inside] - m
            end = int(inside[np.argmin(np.abs(np.arctan2(d[:, 1], d[:, 0])))])
        ring = np.concatenate([ring[: end + 1], np.roll(hole, -start, axis=0), [m], ring[end:]])
    return ring


def ears(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a counter-clockwise ring that does not cross itself, by cutting ears.

    Corners are walked around once and again; only hollow corners can lie in an ear, so only these are
    kept and tried. Plain numbers: rings are short, and arrays of three would cost more than they save.
    """
    n = len(p)
    x, y = (p - p[0]).T.tolist()
    least = 1e-10 * max(max(x) - min(x), max(y) - min(y)) ** 2
    before, after = [(i - 1) % n for i in range(n)], [(i + 1) % n for i in range(n)]

    def side(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    hollow = {i for i in range(n) if side(before[i], i, after[i]) <= least}

    def ear(i: int, j: int, m: int, slack: float) -> bool:
        low, high, left, right = min(y[i], y[j], y[m]) - least, max(y[i], y[j], y[m]) + least, min(x[i], x[j], x[m]) - least, max(x[i], x[j], x[m]) + least
        for q in hollow:
            if left <= x[q] <= right and low <= y[q] <= high and not any(max(abs(x[q] - x[c]), abs(y[q] - y[c])) <= least for c in (i, j, m)):
                if side(i, j, q) >= -least and side(j, m, q) >= -least and side(m, i, q) > slack:
                    return False
        return True

    out, j, left, missed, slack = [], 0, n, 0, -least
    while left > 3:
        i, m = before[j], after[j]
        if j not in hollow and ear(i, j, m, slack):
            out.append((i, j, m))
        elif missed < left:
            j, missed = m, missed + 1
            continue
        elif slack < 0:  # corners on the new edge are passed by if no ear does without
            slack, missed = least, 0
            continue
        else:  # only flat corners are left: the flattest goes without a triangle
            ring = [j]
            while after[ring[-1]] != j:
                ring.append(after[ring[-1]])
            j = min(ring, key=lambda k: abs(side(before[k], k, after[k])))
            i, m = before[j], after[j]
        after[i], before[m] = m, i
        hollow.discard(j)
        for k in (i, m):
            (hollow.add if side(before[k], k, after[k]) <= least else hollow.discard)(k)
        j, left, missed, slack = m, left - 1, 0, -least
    if left == 3 and side(before[j], j, after[j]) > least:
        out.append((before[j], j, after[j]))
    return out


def extruded(buildings: DataFrame, key: str, rings: str, base: str, top: str) -> DataFrame:
    """(key, triangle, corners): each footprint as a closed solid from base to top: floor, roof and walls, seen from outside.

    rings: outline first, then holes. Footprints without an area, and solids without a height, give nothing.
    """

    from windrift.operators.overlay import rings_of

    point = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])

    def run(batches):
        for b in batches:
            source, number, corners = [], [], []
            for row, (some, low, high) in enumerate(zip(rings_of(b.column(rings)), *(b.column(c).to_pylist() for c in (base, top)), strict=True)):
                if not some or low is None or high is None or not high > low:
                    continue
                parts = [open_ring(r, clockwise=i > 0) for i, r in enumerate(some)]
                flat = bridged(parts[0], parts[1:])
                cut = np.array(ears(flat), int).reshape(-1, 3)
                solid = [np.dstack([flat[cut[:, order]], np.full((len(cut), 3, 1), z)]) for order, z in (([0, 2, 1], low), ([0, 1, 2], high))]
                for p in parts:
                    q = np.roll(p, -1, axis=0)
                    up = lambda xy, z: np.column_stack([xy, np.full(len(xy), z)])
                    solid += [np.stack([up(p, low), up(q, low), up(q, high)], axis=1), np.stack([up(p, low), up(q, high), up(p, high)], axis=1)]
                all_ = np.concatenate(solid)
                source.append(np.full(len(all_), row))
                number.append(np.arange(len(all_)))
                corners.append(all_)
            if source:
                xyz = np.concatenate(corners).reshape(-1, 3)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(xyz) + 1, 3, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(xyz[:, c]) for c in range(3)], fields=list(point)))
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(np.concatenate(source))), pa.array(np.concatenate(number).astype(np.int32)), lists], [key, "triangle", "corners"])

    return spread(buildings.select(key, rings, base, top)).mapInArrow(run, f"{key} {buildings.schema[key].dataType.simpleString()}, triangle int, corners {CORNERS}")


def base_block(spark: SparkSession, x0: float, x1: float, y0: float, y1: float, z0: float, z1: float) -> DataFrame:
    """(triangle, corners): a box as twelve triangles, seen from outside."""
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    one = spark.range(1).select(F.col("id").alias("k"), F.array(ring).alias("rings"), F.lit(float(z0)).alias("low"), F.lit(float(z1)).alias("high"))
    return extruded(one, "k", "rings", "low", "high").drop("k")


def joined_meshes(*parts: DataFrame) -> DataFrame:
    """(facet, part, corners): meshes (order columns, corners) as one, facets numbered on from part to part.

    Each part is put in the order of its other columns by ranges; only a count for each range and part is summed up.
    """
    out = None
    for i, p in enumerate(parts):
        keys = [c for c in p.columns if c != "corners"]
        rows = in_ranges(p, *keys)
        nth = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
        counted = carried(rows.groupBy("part").agg(F.count("*").alias("n")), n="n")
        placed = rows.withColumn("nth", nth).join(F.broadcast(counted), "part").select(F.lit(i).alias("part"), (F.col("nth") + F.col("before_n")).alias("facet"), "corners")
        out = placed if out is None else out.unionByName(placed)
    counts = out.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a mesh
    return out.join(F.broadcast(before), "part").select((F.col("facet") + F.col("before")).alias("facet"), "part", "corners")


def signed_volume(corners: Column) -> Column:
    """A triangle's share of the volume of the closed mesh that it is part of."""
    a, b, c = corners[0], corners[1], corners[2]
    return (a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) - a["y"] * (b["x"] * c["z"] - b["z"] * c["x"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])) / 6


def fitted(vertices: DataFrame, bounds: dict[str, tuple[float, float]], scaled: bool = True) -> DataFrame:
    """vertices moved so that each axis begins at its target's low end, and scaled to reach the high one."""
    have = vertices.agg(*(f(c).alias(f"{c}_{n}") for c in bounds for n, f in (("low", F.min), ("high", F.max))))
    out = vertices.join(F.broadcast(have))
    for c, (low, high) in bounds.items():
        span = F.col(f"{c}_high") - F.col(f"{c}_low")
        factor = F.when(span > 0, (high - low) / span).otherwise(1.0) if scaled else F.lit(1.0)
        out = out.withColumn(c, (F.col(c) - F.col(f"{c}_low")) * factor + low)
    return out.select(*vertices.columns)


def centroid(ring: Column) -> Column:
    """The centre of a ring's area as a struct of x and y; of its points where it has none. Sums are taken from its first point."""
    n = F.size(ring)
    first = ring[0]
    near = F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    ahead = F.concat(F.slice(near, 2, F.greatest(n - 1, F.lit(0))), F.slice(near, 1, 1))
    part = lambda axis: F.aggregate(F.zip_with(near, ahead, lambda p, q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"])), F.lit(0.0), lambda a, v: a + v)
    area = ring_area(near)
    mean = lambda axis: F.aggregate(near, F.lit(0.0), lambda a, p: a + p[axis]) / n
    axis = lambda c: (first[c] + F.when(area == 0, mean(c)).otherwise(part(c) / (6 * area))).alias(c)
    return F.struct(axis("x"), axis("y"))


def rotated(ring: Column, centre: Column, degrees: float | Column) -> Column:
    """The ring turned counter-clockwise about a centre."""
    a = F.radians(F.lit(degrees) if isinstance(degrees, (int, float)) else degrees)
    dx, dy = (lambda p: p["x"] - centre["x"]), (lambda p: p["y"] - centre["y"])
    return F.transform(ring, lambda p: F.struct((centre["x"] + dx(p) * F.cos(a) - dy(p) * F.sin(a)).alias("x"), (centre["y"] + dx(p) * F.sin(a) + dy(p) * F.cos(a)).alias("y")))
