"""Polygons laid over each other: unions, clips that fall apart, and rings that cross themselves made simple.

All three are one construction for each group of rings. Edges are cut where they meet, on a grid fine
enough to keep footprints and coarse enough for exact signs (2^29 steps across the group); a sweep from
left to right gives each piece the winding numbers on its two sides; pieces with the result on one side
only are its outline and are put together to rings, cut where a ring touches itself, and holes are
given to the rings around them. Corners keep their own coordinates; points that bend nothing go.

A polygon is an array of rings, the outline first; results have closed rings, outlines
counter-clockwise and holes clockwise. Null points, rings and polygons, and those without an area,
give nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from windrift.operators.graph import checkpoint_folder, spread, spread_over
from windrift.operators.ordered import numbered

Polygon = list[np.ndarray]
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))
STEPS = 1 << 29  # products of two differences still fit a long


def cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


class Edges:
    """Edges between numbered corners; steps[corner] on the grid, place[corner] as given; turns[edge, layer] net traversals from a to b."""

    def __init__(self, rings: list[np.ndarray], layers: list[int]):
        count = max(layers, default=0) + 1
        p = np.concatenate(rings) if rings else np.empty((0, 2))
        self.low = p.min(axis=0) if len(p) else np.zeros(2)
        span = float(np.ptp(p, axis=0).max()) if len(p) else 0.0
        self.unit = span / STEPS if span > 0 else 1.0
        steps = np.rint((p - self.low) / self.unit).astype(np.int64)
        _, first, at = np.unique(self.key(steps), return_index=True, return_inverse=True)
        self.steps, self.place = steps[first], p[first]
        lengths = [len(r) for r in rings]
        start = np.cumsum(lengths) - lengths
        after = np.arange(len(p)) + 1
        after[start + np.array(lengths, np.int64) - 1] = start
        turns = np.zeros((len(p), count), np.int64)
        turns[np.arange(len(p)), np.repeat(layers, lengths)] = 1
        self.set(at, at[after], turns)

    @staticmethod
    def key(steps: np.ndarray) -> np.ndarray:
        return steps[:, 0] * (4 * STEPS) + steps[:, 1]

    def set(self, a: np.ndarray, b: np.ndarray, turns: np.ndarray) -> None:
        """Keep each pair of corners once, with all its traversals added up; edges that cancel out go."""
        turned = a > b
        a, b, turns = np.where(turned, b, a), np.where(turned, a, b), np.where(turned[:, None], -turns, turns)
        fine = a != b
        pair, at = np.unique(a[fine] * (len(self.steps) + 1) + b[fine], return_inverse=True)
        total = np.zeros((len(pair), turns.shape[1]), np.int64)
        np.add.at(total, at, turns[fine])
        some = total.any(axis=1)
        self.a, self.b = np.divmod(pair[some], len(self.steps) + 1)
        self.turns = total[some]

    def corner(self, steps: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Numbers of corners at steps; new ones are added at their place."""
        have = self.key(self.steps)
        order = np.argsort(have)
        wanted, first, at = np.unique(self.key(steps), return_index=True, return_inverse=True)
        i = np.minimum(np.searchsorted(have[order], wanted), max(0, len(have) - 1))
        known = have[order[i]] == wanted
        number = np.where(known, order[i], len(have) + np.cumsum(~known) - 1)
        self.steps, self.place = np.concatenate([self.steps, steps[first[~known]]]), np.concatenate([self.place, place[first[~known]]])
        return number[at]

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of edges whose bounds meet, in blocks."""
        p, q = self.steps[self.a], self.steps[self.b]
        low, high = np.minimum(p, q), np.maximum(p, q)
        order = np.argsort(low[:, 0], kind="stable")
        low, high = low[order], high[order]
        stop = np.searchsorted(low[:, 0], high[:, 0], "right")
        n = stop - np.arange(len(order)) - 1
        ends = np.cumsum(n)
        i = 0
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 2_000_000, "right")))
            own = np.repeat(np.arange(i, j), n[i:j])
            other = own + 1 + np.arange(len(own)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
            meet = (low[own, 1] <= high[other, 1]) & (low[other, 1] <= high[own, 1])
            yield order[own[meet]], order[other[meet]]
            i = j

    def cut(self) -> None:
        """Cut edges where they meet others, until they meet at corners only."""
        for _ in range(50):
            edge, number = [], []
            crossing = []
            for i, j in self.near():
                pi, qi, pj, qj = (self.steps[v] for v in (self.a[i], self.b[i], self.a[j], self.b[j]))
                di, dj = qi - pi, qj - pj
                s = [cross(di, pj - pi), cross(di, qj - pi), cross(dj, pi - pj), cross(dj, qi - pj)]
                for on, side, corner, start, d in ((i, s[0], self.a[j], pi, di), (i, s[1], self.b[j], pi, di), (j, s[2], self.a[i], pj, dj), (j, s[3], self.b[i], pj, dj)):
                    along = ((self.steps[corner] - start) * d).sum(axis=1)
                    hit = (side == 0) & (along > 0) & (along < (d * d).sum(axis=1))
                    edge.append(on[hit])
                    number.append(corner[hit])
                both = np.flatnonzero((np.sign(s[0]) * np.sign(s[1]) < 0) & (np.sign(s[2]) * np.sign(s[3]) < 0))
                if len(both):
                    crossing.append((i[both], j[both], s[2][both] / (s[2] - s[3])[both]))
            if crossing:
                i, j, t = (np.concatenate(v) for v in zip(*crossing, strict=True))
                t = t[:, None]
                steps = np.rint(self.steps[self.a[i]] + t * (self.steps[self.b[i]] - self.steps[self.a[i]])).astype(np.int64)
                place = self.place[self.a[i]] + t * (self.place[self.b[i]] - self.place[self.a[i]])
                for axis in (0, 1):  # where the other edge lies along an axis, its own coordinate holds
                    flat = self.place[self.a[j], axis] == self.place[self.b[j], axis]
                    place[flat, axis], steps[flat, axis] = self.place[self.a[j[flat]], axis], self.steps[self.a[j[flat]], axis]
                at = self.corner(steps, place)
                edge += [i, j]
                number += [at, at]
            edge, number = np.concatenate(edge or [np.empty(0, np.int64)]), np.concatenate(number or [np.empty(0, np.int64)])
            fresh = (number != self.a[edge]) & (number != self.b[edge])
            edge, number = edge[fresh], number[fresh]
            if not len(edge):
                return
            every = np.arange(len(self.a))
            edge, number = np.r_[every, edge, every], np.r_[self.a, number, self.b]
            start = self.steps[self.a[edge]]
            along = ((self.steps[number] - start) * (self.steps[self.b[edge]] - start)).sum(axis=1)
            order = np.lexsort((along, edge))
            edge, number = edge[order], number[order]
            same = edge[1:] == edge[:-1]
            self.set(number[:-1][same], number[1:][same], self.turns[edge[1:][same]])

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """[edges, layers] winding numbers to the left and to the right of each edge, seen from a to b."""
        p, q = self.steps[self.a], self.steps[self.b]
        back = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
        p, q = np.where(back[:, None], q, p), np.where(back[:, None], p, q)
        turns = np.where(back[:, None], -self.turns, self.turns)  # from left to right, or upwards
        left, right = np.zeros_like(turns), np.zeros_like(turns)
        upright = p[:, 0] == q[:, 0]
        slope = (q[:, 1] - p[:, 1]) / np.where(upright, 1, q[:, 0] - p[:, 0])
        xs = np.unique(np.r_[p[:, 0], q[:, 0]])
        lying, standing = np.flatnonzero(~upright), np.flatnonzero(upright)
        lying, standing = lying[np.argsort(p[lying, 0], kind="stable")], standing[np.argsort(p[standing, 0], kind="stable")]
        from_, until = np.searchsorted(p[lying, 0], xs, "left"), np.searchsorted(p[lying, 0], xs, "right")
        s_from, s_until = np.searchsorted(p[standing, 0], xs, "left"), np.searchsorted(p[standing, 0], xs, "right")
        active = np.empty(0, np.int64)
        for k, x in enumerate(xs):
            if s_from[k] < s_until[k]:  # upright edges see the strip to their left
                own = standing[s_from[k] : s_until[k]]
                y = np.where(q[active, 0] == x, q[active, 1], p[active, 1] + slope[active] * (x - p[active, 0]))
                order = np.argsort(y, kind="stable")
                total = np.concatenate([np.zeros((1, turns.shape[1]), np.int64), np.cumsum(turns[active[order]], axis=0)])
                left[own] = total[np.searchsorted(y[order], (p[own, 1] + q[own, 1]) / 2)]
                right[own] = left[own] - turns[own]
            active = active[q[active, 0] > x]
            new = lying[from_[k] : until[k]]
            if len(new):
                active = np.concatenate([active, new])
                middle = (x + xs[k + 1]) / 2
                order = np.argsort(p[active, 1] + slope[active] * (middle - p[active, 0]), kind="stable")
                above = np.cumsum(turns[active[order]], axis=0)
                fresh = np.flatnonzero(order >= len(active) - len(new))
                left[active[order[fresh]]] = above[fresh]
                right[active[order[fresh]]] = above[fresh] - turns[active[order[fresh]]]
        return np.where(back[:, None], right, left), np.where(back[:, None], left, right)


def rings_around(place: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Simple rings (corner numbers) of directed edges that have the inside on their left."""
    d = place[end] - place[start]
    angle = np.arctan2(d[:, 1], d[:, 0])
    leaving: dict[int, list[int]] = {}
    for e, v in enumerate(start.tolist()):
        leaving.setdefault(v, []).append(e)
    used = np.zeros(len(start), bool)
    out = []
    for first in range(len(start)):
        if used[first]:
            continue
        path, seen, e = [], {}, first
        while not used[e]:
            used[e] = True
            v, w = int(start[e]), int(end[e])
            if v in seen:  # it touches itself: what lies between is a ring of its own
                at = seen[v]
                out.append(path[at:])
                for u in path[at:]:
                    del seen[u]
                del path[at:]
            seen[v] = len(path)
            path.append(v)
            options = [o for o in leaving[w] if not used[o]]
            if not options:
                break
            if len(options) > 1:  # the first one clockwise from where we come from
                back = angle[e] + np.pi
                options.sort(key=lambda o: (back - angle[o]) % (2 * np.pi) or 2 * np.pi)
            e = options[0]
        out.append(path)
    return [r for r in out if len(r) > 2]


def without_flat(steps: np.ndarray) -> np.ndarray:
    """Which corners of a ring bend it."""
    return np.flatnonzero(cross(steps - np.roll(steps, 1, axis=0), np.roll(steps, -1, axis=0) - steps))


def area(ring: np.ndarray) -> float:
    p = ring - ring[0]
    return float(cross(p, np.roll(p, -1, axis=0)).sum()) / 2


def around(point: np.ndarray, ring: np.ndarray) -> bool:
    """Whether a ring goes around a point that is not on it."""
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] <= point[1]) != (b[:, 1] <= point[1])
    a, b = a[spans], b[spans]
    return bool((((point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) + a[:, 0]) > point[0]).sum() % 2)


def assembled(steps: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[Polygon]:
    """Polygons of directed edges between corners that have the inside on their left: outlines with their holes, closed."""
    found = []
    for numbers in rings_around(place, start, end):
        numbers = np.array(numbers)
        numbers = numbers[without_flat(steps[numbers])]
        if len(numbers) > 2:
            ring = place[numbers]
            ring = np.roll(ring, -int(np.lexsort((ring[:, 1], ring[:, 0]))[0]), axis=0)
            found.append((area(ring), ring))
    outer = sorted((f for f in found if f[0] > 0), key=lambda f: (f[1][0, 0], f[1][0, 1], f[0]))
    out = [[ring] for _, ring in outer]
    for size, hole in sorted((f for f in found if f[0] < 0), key=lambda f: (f[1][0, 0], f[1][0, 1])):
        middle = (hole[0] + hole[1]) / 2
        home = [k for k, (a, r) in enumerate(outer) if a > -size and (r.min(axis=0) <= middle).all() and (middle <= r.max(axis=0)).all() and around(middle, r)]
        if home:
            out[min(home, key=lambda k: outer[k][0])].append(hole)
    closed = lambda r: np.concatenate([r, r[:1]])
    return [[closed(r) for r in p] for p in out]


def overlay(rings: list[np.ndarray], layers: list[int], inside: Callable[[np.ndarray], np.ndarray]) -> list[Polygon]:
    """The polygons where inside(windings [n, layers]) holds. A ring may be closed or not, and run either way."""
    fine = []
    for r, layer in zip(rings, layers, strict=True):
        r = r[np.isfinite(r).all(axis=1)] if len(r) else r
        r = r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r
        if len(r) > 2:
            fine.append((r, layer))
    if not fine:
        return []
    e = Edges([r for r, _ in fine], [layer for _, layer in fine])
    e.turns = np.pad(e.turns, ((0, 0), (0, max(layers) + 1 - e.turns.shape[1])))
    e.cut()
    left, right = e.sides()
    on_left, on_right = inside(left), inside(right)
    edge = np.flatnonzero(on_left != on_right)
    start, end = np.where(on_left[edge], e.a[edge], e.b[edge]), np.where(on_left[edge], e.b[edge], e.a[edge])
    return assembled(e.steps, e.place, start, end)


def convex(ring: np.ndarray) -> np.ndarray | None:
    """A short ring that is convex beyond doubt, closed, counter-clockwise from its lowest corner; None if it may not be."""
    p = ring.tolist()
    p = p[:-1] if len(p) > 1 and p[0] == p[-1] else p
    if not 2 < len(p) <= 16:
        return None
    d = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    least = 1e-6 * max(max(abs(x), abs(y)) for x, y in d)  # far above the grid of an overlay
    turn = [a[0] * b[1] - a[1] * b[0] for a, b in zip(d, d[1:] + d[:1], strict=True)]
    way = 1 if turn[0] > 0 else -1
    if not all(max(abs(x), abs(y)) > least for x, y in d) or not all(way * t > least * least for t in turn):
        return None
    right = [x > 0 for x, _ in d if x]
    if sum(a != b for a, b in zip(right, right[1:] + right[:1], strict=True)) != 2:
        return None  # it goes around more than once
    p = p if way > 0 else p[::-1]
    low = p.index(min(p))
    p = p[low:] + p[:low]
    return np.array([*p, p[0]])


def simple(polygon: Polygon) -> list[Polygon]:
    """A polygon's area by even-odd, as simple polygons: crossings resolved, holes where they belong."""
    if len(polygon) == 1 and (ring := convex(polygon[0])) is not None:
        return [[ring]]
    return overlay(polygon, [0] * len(polygon), lambda w: w[:, 0] % 2 == 1)


def united(polygons: list[Polygon]) -> list[Polygon]:
    """The area that any of the polygons covers."""
    if len(polygons) == 1:
        return simple(polygons[0])
    rings = [r for p in polygons for s in simple(p) for r in s]
    return overlay(rings, [0] * len(rings), lambda w: w[:, 0] > 0)


def common(polygons: list[Polygon], others: list[Polygon]) -> list[Polygon]:
    """The area that both lists of polygons cover, each list's members apart from each other."""
    sides = [[r for p in some for s in simple(p) for r in s] for some in (polygons, others)]
    return overlay(sides[0] + sides[1], [0] * len(sides[0]) + [1] * len(sides[1]), lambda w: (w > 0).all(axis=1)) if all(sides) else []


# ---------------------------------------------------------------- columns of polygons


def rings_of(column: pa.Array) -> list[list[np.ndarray]]:
    """The rings of each row of an Arrow column of polygons; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rings = column.flatten()
    points = rings.flatten()
    none = np.asarray(points.is_null())
    # A struct that is null may still hold numbers.
    xy = np.stack([np.where(none, np.nan, points.field(c).fill_null(float("nan")).to_numpy(zero_copy_only=False)) for c in ("x", "y")], axis=1)
    ends = np.cumsum(rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    parts = np.split(xy, ends[:-1]) if len(ends) else []
    stops = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return [parts[a:z] for a, z in zip(np.r_[0, stops[:-1]], stops, strict=True)]


def listed(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)


def polygons_to(polygons: list[Polygon]) -> pa.Array:
    """An Arrow column of polygons, one each row."""
    rings = [r for p in polygons for r in p]
    xy = np.concatenate(rings) if rings else np.empty((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, i])) for i in (0, 1)], ["x", "y"])
    return listed([len(p) for p in polygons], listed([len(r) for r in rings], points))


def in_parts(df: DataFrame, keys: list[str], rings: str, parts: Callable[[Polygon], list[Polygon]]) -> DataFrame:
    """(keys, part, rings): the polygons that parts makes of each row's, numbered from 0."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("part", T.IntegerType()), T.StructField(rings, RINGS)])

    def run(batches):
        for b in batches:
            found = [parts(p) if p else [] for p in rings_of(b.column(rings))]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            number = np.concatenate([np.arange(len(f)) for f in found] or [np.empty(0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in keys), pa.array(number), polygons_to([p for f in found for p in f])], [*keys, "part", rings])

    return spread(df.select(*keys, rings)).mapInArrow(run, schema)


def resolved(df: DataFrame, keys: list[str], rings: str) -> DataFrame:
    """(keys, part, rings): footprints as simple polygons; rings that cross themselves or each other fall into parts by even-odd."""
    return in_parts(df, keys, rings, simple)


def clipped_parts(df: DataFrame, keys: list[str], rings: str, outline: list[tuple[float, float]]) -> DataFrame:
    """(keys, part, rings): what lies of each footprint inside an outline of any form, one row for each part; holes stay holes.

    Bounds are compared before Python sees a row.
    """
    from windrift.operators.geometry import bounds, clip_ring

    box = np.array(outline, float)
    (x0, y0), (x1, y1) = box.min(axis=0).tolist(), box.max(axis=0).tolist()
    near = df.withColumn("bounds", bounds(F.get(rings, F.lit(0)))).where((F.col("bounds.x1") >= x0) & (F.col("bounds.x0") <= x1) & (F.col("bounds.y1") >= y0) & (F.col("bounds.y0") <= y1))

    def cut(p: Polygon) -> list[Polygon]:
        # Only what the outline does around the footprint matters: far corners would make the grid coarse.
        points = np.concatenate(p)
        points = points[np.isfinite(points).all(axis=1)]
        if not len(points):
            return []
        low, high = points.min(axis=0), points.max(axis=0)
        room = 0.01 * (high - low).max() + 1e-12
        (a, b), (c, d) = low - room, high + room
        window = clip_ring(box if area(box) > 0 else box[::-1], np.array([(a, b), (c, b), (c, d), (a, d)]))
        # Both by even-odd, in one overlay.
        return overlay([*p, window], [0] * len(p) + [1], lambda w: (w % 2 == 1).all(axis=1)) if len(window) > 2 else []

    return in_parts(near, keys, rings, cut)


def dissolved(df: DataFrame, group: str, order: str, rings: str, crowd: int = 256) -> DataFrame:
    """(group, part, rings): the union of each group's footprints.

    A group's footprints are united `crowd` at a time in the order given (near ones should be near in
    it), then the unions of these, until one is left: a task never holds more than `crowd` outlines.
    order must tell a group's rows apart; null groups are a group. Rows are dealt by ranges of group and
    order, and small groups are done in one pass over their range; only groups that are cut go on.
    """
    many = T.ArrayType(RINGS)
    rows = df.select(group, F.col(order).alias("order"), F.array(F.col(rings).cast(RINGS)).alias("parts")).where(F.col(rings).isNotNull())
    kinds = [rows.schema[group].dataType, rows.schema["order"].dataType]
    types = to_arrow_schema(rows.select(group, "order").schema)

    def packed(told: list[tuple]) -> pa.RecordBatch:
        g, o, whole, parts = zip(*told, strict=True)
        lists = listed([len(p) for p in parts], polygons_to([q for p in parts for q in p]))
        return pa.RecordBatch.from_arrays([pa.array(g, types[0].type), pa.array(o, types[1].type), pa.array(whole), lists], [group, "order", "whole", "parts"])

    def passed(batches):
        """Runs of equal groups, united; whole where no other range and no other run holds rows of the group."""
        told, held, key, first, cuts = [], [], None, None, 1
        for b in batches:
            polygons = rings_of(b.column("parts").flatten())
            for g, o, p in zip(b.column(group).to_pylist(), b.column("order").to_pylist(), polygons, strict=True):
                same = bool(held) and (g == key or (g != g and key != key))
                if held and (not same or len(held) == crowd):
                    told.append((key, first, not same and not cuts, united(held)))
                    cuts, held = (1 if same else 0), []
                if not held:
                    key, first = g, o
                held.append(p)
            if len(told) > 1000:
                yield packed(told)
                told = []
        if held:
            told.append((key, first, False, united(held)))  # the range after this one may hold more of it
        if told:
            yield packed(told)

    ranges = spread_over(df)
    checkpoint_folder(df.sparkSession)
    schema = T.StructType([T.StructField(group, kinds[0]), T.StructField("order", kinds[1]), T.StructField("whole", T.BooleanType()), T.StructField("parts", many)])
    once = rows.repartitionByRange(ranges, group, "order").sortWithinPartitions(group, "order").mapInArrow(passed, schema).checkpoint()
    out = lambda t: t.select(group, F.posexplode("parts").alias("part", rings)).select(group, F.col("part").cast("int").alias("part"), rings)
    done = out(once.where("whole"))
    rows = once.where("not whole").select(group, "order", "parts")
    schema = T.StructType([rows.schema[group], T.StructField("chunk", T.LongType()), T.StructField("parts", many)])

    def unite(t: pa.Table) -> pa.Table:
        parts = t.column("parts").combine_chunks()
        found = united(rings_of(parts.flatten()))
        return pa.table({group: t.column(group).slice(0, 1), "chunk": t.column("chunk").slice(0, 1), "parts": listed([len(found)], polygons_to(found))})

    while True:
        # Sizes are merged, not broadcast: there may be millions of groups, and the driver would hold them.
        sizes = rows.groupBy(group).agg(F.count("*").alias("members")).select(F.col(group).alias("_g"), "members").hint("merge")
        counted = rows.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
        done = done.unionByName(out(counted.where("members = 1")))
        left = counted.where("members > 1").drop("members")
        if left.isEmpty():
            return done
        placed = numbered(left, [group, "order"]).withColumn("chunk", F.floor(F.col("at") / crowd))
        rows = placed.select(group, "chunk", "parts").groupBy(group, "chunk").applyInArrow(unite, schema).select(group, F.col("chunk").alias("order"), "parts").checkpoint()
