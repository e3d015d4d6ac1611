"""A quad-tree of squares from the places of a table: dense squares are split, thin ones stay whole.

The tree is a table of squares (level, sx, sy, n), made from counts level by level: only the places of
squares with more than `crowd` go on to the next. Squares of a level are numbered from the corner of
the places' extent; a level halves their sides `STEP` times. Nothing holds a square's places together
but the task that compares a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.operators.graph import checkpoint_folder

STEP, DEPTH = 2, 24
CROWD = 256  # a query meets all places of the few leaves it asks, so small leaves keep what is moved small


@dataclass
class Tree:
    nodes: DataFrame  # (level, sx, sy, n, leaf)
    places: DataFrame  # the places with the leaf (level, sx, sy) that they lie in
    levels: list[int]
    x0: float
    y0: float
    side: float

    def width(self, level: Column) -> Column:
        return F.lit(self.side) / F.pow(F.lit(2.0), level)


def tree(points: DataFrame, crowd: int = CROWD) -> Tree | None:
    """The tree of points (px, py and other columns); None if there are none. Rows without a place must be left out before.

    No more than `crowd` points are one square, and go to every task that asks.
    """
    checkpoint_folder(points.sparkSession)
    low = points.agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"), F.count("*").alias("n")).first()
    if low["x0"] is None:
        return None
    side = max(low["x1"] - low["x0"], low["y1"] - low["y0"]) * (1 + 1e-9) or 1.0
    if low["n"] <= crowd:
        square = [F.lit(0).alias("level"), F.lit(0).cast("long").alias("sx"), F.lit(0).cast("long").alias("sy")]
        root = points.sparkSession.range(1).select(*square, F.lit(low["n"]).cast("long").alias("n"), F.lit(True).alias("leaf"))
        return Tree(root, F.broadcast(points.select(*square, *points.columns)), [0], low["x0"], low["y0"], side)
    fine = lambda c, first: F.least(F.floor((F.col(c) - first) / side * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")
    rest = points.withColumns({"fx_": fine("px", low["x0"]), "fy_": fine("py", low["y0"])})
    nodes, places, levels = None, None, []
    for level in range(0, DEPTH + 1, STEP):
        at = {"sx": F.shiftright("fx_", DEPTH - level), "sy": F.shiftright("fy_", DEPTH - level)}
        rest = rest.withColumns(at)
        levels.append(level)
        counts = rest.groupBy("sx", "sy").agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "sx", "sy", "n", ((F.col("n") <= crowd) | F.lit(level >= DEPTH)).alias("leaf")).checkpoint()
        nodes = counts if nodes is None else nodes.unionByName(counts)
        leaf = counts.where("leaf").select("sx", "sy")
        there = rest.join(leaf, ["sx", "sy"]).select(F.lit(level).alias("level"), "sx", "sy", *points.columns)
        places = there if places is None else places.unionByName(there)
        if counts.where("not leaf").isEmpty():
            break
        rest = rest.join(counts.where("not leaf").select("sx", "sy"), ["sx", "sy"]).select(*points.columns, "fx_", "fy_")
    return Tree(nodes, places.checkpoint(), levels, low["x0"], low["y0"], side)


def candidates(t: Tree, queries: DataFrame, k: int) -> DataFrame:
    """(qid, qx, qy, level, sx, sy): the leaves that can hold one of the k nearest places of each query, and only few others.

    Queries go down the tree together. Of the squares a query still looks at, those whose farthest
    corners are nearest and hold k places bound how far it must look; squares beyond that bound go.
    """
    width = t.width(F.col("level"))
    # Distances to a square's nearest and farthest point; a little slack covers rounding.
    gap = lambda q, first, s: F.greatest(F.lit(0.0), F.lit(first) + F.col(s) * width - F.col(q), F.col(q) - (F.lit(first) + (F.col(s) + 1) * width))
    far = lambda q, first, s: F.greatest(F.abs(F.col(q) - (F.lit(first) + F.col(s) * width)), F.abs(F.col(q) - (F.lit(first) + (F.col(s) + 1) * width)))
    length = lambda a, b: F.sqrt(a * a + b * b)
    near_, far_ = length(gap("qx", t.x0, "sx"), gap("qy", t.y0, "sy")), length(far("qx", t.x0, "sx"), far("qy", t.y0, "sy"))
    root = t.nodes.where("level = 0")
    open_ = queries.select("qid", "qx", "qy").join(F.broadcast(root))  # the root is one square
    slack = 1e-9 * t.side
    for level in t.levels[1:]:
        children = t.nodes.where(F.col("level") == level).select(F.shiftright("sx", STEP).alias("ux"), F.shiftright("sy", STEP).alias("uy"), "level", "sx", "sy", "n", "leaf")
        split = open_.where("not leaf").select("qid", "qx", "qy", F.col("sx").alias("ux"), F.col("sy").alias("uy"))
        down = split.join(children, ["ux", "uy"]).select("qid", "qx", "qy", "level", "sx", "sy", "n", "leaf")
        every = down.unionByName(open_.where("leaf").select(*down.columns)).withColumns({"near_": near_, "far_": far_})
        w = Window.partitionBy("qid").orderBy("far_", "level", "sx", "sy").rowsBetween(Window.unboundedPreceding, 0)
        bound = F.min(F.when(F.col("have_") >= k, F.col("far_"))).over(Window.partitionBy("qid"))
        kept = every.withColumn("have_", F.sum("n").over(w)).withColumn("bound_", bound)
        open_ = kept.where(F.col("bound_").isNull() | (F.col("near_") <= F.col("bound_") + slack)).select(*down.columns).checkpoint()
        if open_.where("not leaf").isEmpty():
            break
    return open_.select("qid", "qx", "qy", "level", "sx", "sy")
