"""Joins by nearness: bracketing, nearest, k nearest, overlap, tolerance and grid cells.

None compares all pairs: values are bracketed by sorting, boxes meet in square buckets, places through a quad-tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.operators.graph import checkpoint_folder, spread
from windrift.operators.ordered import carried, in_ranges
from windrift.operators.quadtree import CROWD, Tree, candidates, tree


def bracketed(queries: DataFrame, profile: DataFrame, at: str, z: str, value: str) -> DataFrame:
    """queries with the profile's value at `at`: linear between the samples below and above, held at the ends.

    A profile is a bounded table (one row a height of one column of air): its sorted samples, as
    one array, go to every row, so queries of any number keep their partitioning.
    """
    table = profile.agg(F.array_sort(F.collect_list(F.struct(F.col(z).cast("double").alias("z"), F.col(value).cast("double").alias("v")))).alias("samples"))
    table = table.withColumn("heights", F.transform("samples", lambda s: s["z"]))
    joined = queries.join(F.broadcast(table)).withColumn("below", F.size(F.filter("heights", lambda h: h <= F.col(at))))
    lo, hi = F.try_element_at("samples", F.when(F.col("below") > 0, F.col("below"))), F.try_element_at("samples", F.col("below") + 1)
    held = F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (F.col(at) - lo["z"]) / (hi["z"] - lo["z"]))
    return joined.select(*queries.columns, held.alias("value"), lo["z"].alias("z_below"), hi["z"].alias("z_above"))


def two_level(queries: DataFrame, samples: DataFrame, patch: str, a: str, b: str, value: str, at_a: str, at_b: str) -> DataFrame:
    """queries with the value at (at_a, at_b) on their patch: between the two columns around at_a, in each between
    the samples around at_b; held at the ends of either.

    samples: patch, a, b, value. A patch's columns are one axis of a face, a bounded list; the samples
    around at_b come from one sorted pass over each column. Queries whose patch has no samples are left out.
    """
    axes = samples.groupBy(patch).agg(F.array_sort(F.collect_set(a)).alias("axis"))
    checkpoint_folder(queries.sparkSession)
    # Numbered once: a checkpoint keeps the numbers when a lost task runs again.
    q = spread(queries).withColumn("qid_", F.monotonically_increasing_id()).checkpoint().join(F.broadcast(axes), patch)
    x = F.col(at_a)
    lo, hi = F.try_element_at(F.filter("axis", lambda c: c <= x), F.lit(-1)), F.try_element_at(F.filter("axis", lambda c: c > x), F.lit(1))
    t = F.when(lo.isNull() | hi.isNull(), 0.0).otherwise((x - lo) / (hi - lo))
    sides = F.array(F.struct(F.coalesce(lo, hi).alias("a"), (1 - t).alias("w")), F.struct(F.coalesce(hi, lo).alias("a"), t.alias("w")))
    asked = q.withColumn("side_", F.explode(F.filter(sides, lambda s: s["w"] > 0))).select("qid_", *queries.columns, F.col(patch).alias("p_"), F.col("side_.a").alias("a_"), F.col("side_.w").alias("w_"), F.col(at_b).cast("double").alias("b_"))
    met = as_of(asked, samples.select(F.col(patch).alias("p_"), F.col(a).alias("a_"), F.col(b).cast("double").alias("z_"), F.col(value).cast("double").alias("v_")), ["p_", "a_"], "b_", "z_", "v_")
    c = F.col
    held = F.when(c("before").isNull(), c("after")).when(c("after").isNull(), c("before")).otherwise(c("before") + (c("after") - c("before")) * (c("b_") - c("before_at")) / (c("after_at") - c("before_at")))
    return met.groupBy("qid_", *queries.columns).agg(F.sum(c("w_") * held).alias("value")).drop("qid_")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, one_task: int = 4_000_000, a_task: int = 100_000) -> DataFrame:
    """left with the right value at or before `at` and the one after, for equal keys: one sorted pass over both.

    The last value seen from either end is carried along. Keys of up to `one_task` rows are a window
    each, dealt to a task for every `a_task` rows. If there is a larger one, rows are dealt by ranges of (keys, time), so a key of any size
    spreads over tasks; where a key goes on in further ranges, the last and first values of each range
    are carried over them: two keys a range. The result is the same. Null keys are a key of their own.
    """
    both = left.select(*keys, F.col(at).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(None).cast(right.schema[right_at].dataType).alias("vt")).unionByName(
        right.select(*keys, F.col(right_at).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("row")).schema["row"].dataType).alias("row"), F.col(value).alias("v"), F.col(right_at).alias("vt"))
    )
    sizes = [d.groupBy(*keys).agg(F.count("*").alias("n")) for d in (left, right)]
    largest, total = (n or 0 for n in sizes[0].unionByName(sizes[1]).groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first())
    split = largest > one_task
    # Tasks grow in number with the rows; left to itself Spark joins them by bytes, and these rows compress well.
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-total // a_task))
    rows = in_ranges(both, *keys, "t", "side") if split else both.repartition(tasks, *keys)
    by = ["part", *keys] if split else keys
    w = Window.partitionBy(*by).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    # The next value is the last one seen from the other end, so either frame only grows.
    ahead = Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    one = F.when(F.col("side") == 0, F.struct("vt", "v"))
    found = rows.withColumn("before", F.last(one, ignorenulls=True).over(w)).withColumn("after", F.last(one, ignorenulls=True).over(ahead))

    if not split:
        return found.where("side = 1").select("row.*", F.col("before.v").alias("before"), F.col("before.vt").alias("before_at"), F.col("after.v").alias("after"), F.col("after.vt").alias("after_at"))
    # Only the first and the last key of a range can go on beyond it.
    key = F.struct(*keys)
    edges = rows.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b")).select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("key"))
    there = rows.withColumn("key", key).join(F.broadcast(edges.select(F.col("part").alias("_range"), F.col("key").alias("_key"))), (F.col("part") == F.col("_range")) & F.col("key").eqNullSafe(F.col("_key")))
    order = F.when(F.col("side") == 0, F.col("t"))
    ends = there.groupBy("part", "key").agg(F.max_by(F.struct("vt", "v"), order).alias("last"), F.min_by(F.struct("vt", "v"), order).alias("first"))
    some = lambda c: F.when(F.col(c).isNotNull() & F.col(f"{c}.vt").isNotNull(), F.col(c))
    over = Window.partitionBy("key").orderBy("part")
    passed = ends.select(F.col("part").alias("_range"), F.col("key").alias("_key"), F.last(some("last"), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first(some("first"), ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    met = found.where("side = 1").join(F.broadcast(passed), (F.col("part") == F.col("_range")) & key.eqNullSafe(F.col("_key")), "left")
    met = met.select("row", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))
    return met.select("row.*", F.col("before.v").alias("before"), F.col("before.vt").alias("before_at"), F.col("after.v").alias("after"), F.col("after.vt").alias("after_at"))


def k_nearest(queries: DataFrame, points: DataFrame, k: int, crowd: int = CROWD) -> DataFrame:
    """(qid, vec_id, distance, rank): the k nearest points of each query; ties go to the lower vec_id.

    queries: qid, qx, qy; points: vec_id, px, py. Points lie in the leaves of a quad-tree, `crowd` in
    each at most (unless they share a place), however uneven they are; a query meets the points of the
    few leaves that can hold its nearest, and nothing else. Rows without a place are left out.
    """
    placed = lambda x, y: F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    points, queries = points.select("vec_id", "px", "py").where(placed("px", "py")), queries.where(placed("qx", "qy"))
    squares = tree(points, crowd)
    if squares is None:
        return queries.select("qid", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank")).where("false")
    return nearest_in(squares, queries, k).select("qid", "vec_id", "distance", "rank")


def nearest_in(squares: Tree, queries: DataFrame, k: int) -> DataFrame:
    """(qid, vec_id, px, py, distance, rank): as `k_nearest`, of the points (vec_id, px, py) that a tree holds."""
    d = F.sqrt((F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")) + (F.col("py") - F.col("qy")) * (F.col("py") - F.col("qy")))
    met = candidates(squares, queries, k).join(squares.places, ["level", "sx", "sy"]).select("qid", "vec_id", "px", "py", d.alias("distance"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)


def overlapping(boxes: DataFrame, size: float) -> DataFrame:
    """(a, b) with a < b: boxes whose interiors meet; boxes that only touch do not.

    boxes: vec_id, x0, x1, y0, y1. A box stands in each bucket that it covers; a pair is reported
    by the first bucket that both cover, so it comes once.
    """
    cover = boxes.withColumn("bx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("by", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    a, b = cover.alias("a"), cover.alias("b")
    on = (F.col("a.bx") == F.col("b.bx")) & (F.col("a.by") == F.col("b.by")) & (F.col("a.vec_id") < F.col("b.vec_id"))
    meet = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")) & (F.col("a.y0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a.y1"))
    first = (F.col("a.bx") == F.floor(F.greatest("a.x0", "b.x0") / size)) & (F.col("a.by") == F.floor(F.greatest("a.y0", "b.y0") / size))
    return a.join(b, on).where(meet & first).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"))


def linked(boxes: DataFrame, size: float) -> DataFrame:
    """(a, b): links that join boxes just as all pairs of `overlapping` do, but no more than one a box and bucket.

    In a bucket boxes that reach each other by overlaps are linked to one of them, so a crowd of n
    gives n - 1 links, not n^2 / 2. Pairs that overlap share a bucket.
    """
    cover = boxes.withColumn("bx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("by", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    kind = boxes.schema["vec_id"].dataType

    def stars(bounds: np.ndarray) -> list[tuple[int, int]]:
        links, left = [], np.arange(len(bounds))
        while len(left) > 1:
            root, left = int(left[0]), left[1:]
            reached = [root]
            while reached and len(left):
                x0, x1, y0, y1 = bounds[reached.pop()]
                o = bounds[left]
                hit = (x0 < o[:, 1]) & (o[:, 0] < x1) & (y0 < o[:, 3]) & (o[:, 2] < y1)
                near, left = left[hit].tolist(), left[~hit]
                reached += near
                links += [(root, i) for i in near]
        return links

    def run(batches):
        def told(held: pa.Table) -> pa.RecordBatch:
            bx, by = (held.column(c).to_numpy() for c in ("bx", "by"))
            starts = np.flatnonzero(np.r_[True, (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])])
            bounds = np.stack([held.column(c).to_numpy() for c in ("x0", "x1", "y0", "y1")], axis=1)
            links = np.array([(s + i, s + j) for s, e in zip(starts, np.r_[starts[1:], len(bx)], strict=True) if e - s > 1 for i, j in stars(bounds[s:e])], np.int64).reshape(-1, 2)
            ids = held.column("vec_id").combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(links[:, i])) for i in (0, 1)], ["a", "b"])

        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            # The last bucket may go on in the next batch.
            bx, by = (held.column(c).to_numpy() for c in ("bx", "by"))
            other = np.flatnonzero((bx != bx[-1]) | (by != by[-1]))
            if len(other):
                yield told(held.slice(0, int(other[-1]) + 1))
                held = held.slice(int(other[-1]) + 1)
        if held is not None:
            yield told(held)

    columns = [F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1")]
    dealt = cover.select("vec_id", "bx", "by", *columns).repartition("bx", "by").sortWithinPartitions("bx", "by")
    return dealt.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def bilinear(queries: DataFrame, cells: DataFrame, fx: Column, fy: Column, value: str) -> DataFrame:
    """queries with the value at fractional indices (fx, fy), from the four cells around; held inside the grid by the caller.

    cells: x, y and value, once each. Every cell first learns its three neighbours up, so each query
    asks one row for all its corners and stays a row of its own, however often it repeats. Corners of
    no weight are not needed; of the others those that are missing count nothing, and queries that
    miss them all are left out.
    """
    steps = [(i, j) for j in (0, 1) for i in (0, 1)]
    corner = F.explode(F.array(*(F.struct((F.col("x") - i).cast("bigint").alias("cx"), (F.col("y") - j).cast("bigint").alias("cy"), F.lit(f"v{i}{j}").alias("name")) for i, j in steps)))
    seen = cells.select(corner.alias("c"), F.col(value).alias("v"))
    squares = seen.groupBy("c.cx", "c.cy").agg(*(F.max(F.when(F.col("c.name") == f"v{i}{j}", F.col("v"))).alias(f"v{i}{j}") for i, j in steps))
    asked = queries.withColumns({"x0_": F.floor(fx), "y0_": F.floor(fy)}).withColumns({"tx_": fx - F.col("x0_"), "ty_": fy - F.col("y0_")})
    met = asked.join(squares, (F.col("x0_") == F.col("cx")) & (F.col("y0_") == F.col("cy")))
    weight = {(i, j): (F.col("tx_") if i else 1 - F.col("tx_")) * (F.col("ty_") if j else 1 - F.col("ty_")) for i, j in steps}
    there = [F.when((weight[k] > 0) & F.col(f"v{k[0]}{k[1]}").isNotNull(), weight[k] * F.col(f"v{k[0]}{k[1]}")) for k in steps]
    total = sum((F.coalesce(t, F.lit(0.0)) for t in there[1:]), F.coalesce(there[0], F.lit(0.0)))
    return met.where(F.coalesce(*there).isNotNull()).select(*queries.columns, total.alias("value"))


def bilinear_within(queries: DataFrame, cells: DataFrame, fx: Column, fy: Column, value: str, nx: int, ny: int) -> DataFrame:
    """As `bilinear`, and null for queries outside the grid of nx by ny cells."""
    q = queries.withColumn("inside_", fx.between(0, nx - 1) & fy.between(0, ny - 1))
    held = bilinear(q.where("inside_").drop("inside_"), cells, fx, fy, value)
    return held.unionByName(q.where("not coalesce(inside_, false)").drop("inside_").withColumn("value", F.lit(None).cast("double")))


def islands(df: DataFrame, x: str, tolerance: float, group: list[str]) -> DataFrame:
    """df with `island`: rows of a group in order of x, a new island after each gap above the tolerance."""
    w = Window.partitionBy(*group).orderBy(x)
    return df.withColumn("fresh", F.coalesce((F.col(x) - F.lag(x).over(w) > tolerance).cast("int"), F.lit(0))).withColumn("island", F.sum("fresh").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("fresh")


def all_islands(df: DataFrame, x: str, tolerance: float) -> DataFrame:
    """As `islands` with one group of all rows, dealt by ranges of x. df: distinct values of x."""
    rows = in_ranges(df, x)
    ends = rows.groupBy("part").agg(F.max(x).alias("high"))
    ends = ends.select("part", F.max("high").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("high"))  # a row for each range
    w = Window.partitionBy("part").orderBy(x)
    marked = rows.join(F.broadcast(ends), "part").withColumn("fresh", F.coalesce((F.col(x) - F.coalesce(F.lag(x).over(w), "high") > tolerance).cast("int"), F.lit(0)))
    before = carried(marked.groupBy("part").agg(F.sum("fresh").alias("s")), s="s")
    return marked.withColumn("own", F.sum("fresh").over(w)).join(F.broadcast(before), "part").withColumn("island", F.col("own") + F.col("before_s")).select(*df.columns, "island")


def alias_lookup(df: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """df with `canonical`: the alias table's name for the key, or the key. aliases: alias, name (a fixed, small table)."""
    return df.join(F.broadcast(aliases.withColumnRenamed("alias", key)), key, "left").withColumn("canonical", F.coalesce("name", key)).drop("name")
