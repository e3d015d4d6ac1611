"""Cells of equal value that touch along an edge, as regions with their outlines.

Each tile of cells finds its own regions and their edges; regions of neighbouring tiles are linked
where cells of equal value face each other across a border, and linked regions are one. Two cells of
equal value that share an edge always belong together, so an edge is outline exactly where the values
on its two sides differ; no tile needs the cells of another. A region's edges then
meet in one task and are put together to rings: what that holds is the outline, not the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.operators import graph
from windrift.operators.overlay import assembled, listed, polygons_to

EDGE = T.StructType([T.StructField(c, T.LongType()) for c in ("r0", "c0", "r1", "c1")])
SIDE = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("upright", T.BooleanType()), T.StructField("before", T.BooleanType())])
PART = T.StructType([T.StructField("label", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("cells", T.LongType()), T.StructField("edges", T.ArrayType(EDGE)), T.StructField("sides", T.ArrayType(SIDE))])


def linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the links (a, b) reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], least)
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            return label


def structs(columns: dict[str, np.ndarray]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def traced(t: pa.Table, tile: int) -> dict[str, pa.Array]:
    """The regions of one tile: label, value, cells, edges within the tile (inside on the left), and sides on its border."""
    row, col, value = (t.column(c).to_numpy() for c in ("row", "col", "value"))
    top, left = row.min() // tile * tile, col.min() // tile * tile
    grid, there = np.zeros((tile, tile)), np.zeros((tile, tile), bool)
    grid[row - top, col - left], there[row - top, col - left] = value, True
    number = np.arange(tile * tile).reshape(tile, tile)
    across = there[:, :-1] & there[:, 1:] & (grid[:, :-1] == grid[:, 1:])
    down = there[:-1] & there[1:] & (grid[:-1] == grid[1:])
    label = linked(np.r_[number[:, :-1][across], number[:-1][down]], np.r_[number[:, 1:][across], number[1:][down]], tile * tile).reshape(tile, tile)
    edges = []
    # A cell's edge runs with the cell on its left, seen with rows going up: to the right along its low row.
    for same, cells, near, (r0, c0, r1, c1) in (
        (across, np.s_[:, :-1], True, (0, 1, 1, 1)), (across, np.s_[:, 1:], False, (1, 0, 0, 0)),
        (down, np.s_[:-1], True, (1, 1, 1, 0)), (down, np.s_[1:], False, (0, 0, 0, 1)),
    ):
        own = ~same & there[cells]
        at = number[cells][own]
        r, c = at // tile + top, at % tile + left
        edges.append((label.ravel()[at], r + r0, c + c0, r + r1, c + c1))
    sides = []
    for cells, upright, before in ((np.s_[:, -1], True, True), (np.s_[:, 0], True, False), (np.s_[-1], False, True), (np.s_[0], False, False)):
        at = number[cells][there[cells]]
        r, c = at // tile + top, at % tile + left
        # A side is named by the cell before it, to the left or below.
        sides.append((label.ravel()[at], r if before or upright else r - 1, c if before or not upright else c - 1, np.full(len(at), upright), np.full(len(at), before)))
    e, s = ([np.concatenate(v) for v in zip(*some, strict=True)] for some in (edges, sides))
    names, cells = np.unique(label[there], return_counts=True)
    lists = []
    for some, fields in ((e, EDGE.names), (s, SIDE.names)):
        order = np.argsort(some[0], kind="stable")
        counts = np.searchsorted(some[0][order], names, "right") - np.searchsorted(some[0][order], names, "left")
        lists.append(listed(counts.tolist(), structs({f: v[order] for f, v in zip(fields, some[1:], strict=True)})))
    # Labels are places of the whole raster, so they tell regions of all tiles apart.
    whole = ((names // tile + top) << 32) | (names % tile + left)
    return {"label": pa.array(whole), "value": pa.array(grid.ravel()[names]), "cells": pa.array(cells), "edges": lists[0], "sides": lists[1]}


def regions(cells: DataFrame, tile: int = 256, transform: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """(region, value, cells, rings): each region of cells (row, col, value) with its outline, holes after it.

    Cells without a value belong to no region; cells must not repeat. Regions that touch at corners only
    are apart. transform gives the place of a cell's first corner: (a, b, c, d, e, f) with
    x = a * col + b * row + c and y = d * col + e * row + f.
    """
    graph.checkpoint_folder(cells.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    part_arrow = to_arrow_schema(PART)
    some = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")

    def trace(t: pa.Table) -> pa.Table:
        found = traced(t, tile)
        return pa.table({f.name: found[f.name].cast(f.type) for f in part_arrow}, schema=part_arrow)

    parts = some.groupBy(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).applyInArrow(trace, PART).checkpoint()
    sides = parts.select("label", "value", F.explode("sides").alias("s")).select("label", "value", "s.*")
    key = ["row", "col", "upright"]
    # At most two cells face each other across a side.
    faced = sides.groupBy(*key).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.min("label").alias("a"), F.max("label").alias("b")).where("n = 2 AND low = high").select(*key, "a", "b").checkpoint()
    named = graph.components(faced.where("a <> b").select("a", "b"), parts.select(F.col("label").alias("node")))
    # The outline along tile borders: sides without a cell of equal value beyond them.
    up, r, c, before = F.col("upright"), F.col("row"), F.col("col"), F.col("before")
    ends = {"r0": F.when(up, r + F.when(before, 0).otherwise(1)).otherwise(r + 1), "c0": F.when(up, c + 1).otherwise(c + F.when(before, 1).otherwise(0)), "r1": F.when(up, r + F.when(before, 1).otherwise(0)).otherwise(r + 1), "c1": F.when(up, c + 1).otherwise(c + F.when(before, 0).otherwise(1))}
    border = sides.join(faced.select(*key), key, "left_anti").groupBy("label").agg(F.collect_list(F.struct(*(v.cast("long").alias(k) for k, v in ends.items()))).alias("edges"))
    edges = parts.select("label", "edges").unionByName(border)
    totals = parts.join(named, parts.label == named.node).groupBy("component").agg(F.first("value").alias("value"), F.sum("cells").alias("cells"))
    out = T.StructType([T.StructField("region", T.LongType()), T.StructField("rings", T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))])
    a, b, x, d, e, y = transform

    def outline(t: pa.Table) -> pa.Table:
        flat = t.column("edges").combine_chunks().flatten()
        r0, c0, r1, c1 = (flat.field(f).to_numpy() for f in EDGE.names)
        corners, at = np.unique(np.stack([np.r_[c0, c1], np.r_[r0, r1]], axis=1), axis=0, return_inverse=True)
        n = len(r0)
        found = assembled(corners, corners.astype(float), at[:n], at[n:])
        rings = [[np.stack([a * p[:, 0] + b * p[:, 1] + x, d * p[:, 0] + e * p[:, 1] + y], axis=1) for p in polygon] for polygon in found]
        if a * e - b * d < 0:  # the raster is turned over: outlines run counter-clockwise again
            rings = [[p[::-1] for p in polygon] for polygon in rings]
        return pa.table({"region": t.column("component").slice(0, 1), "rings": polygons_to([[p for polygon in rings for p in polygon]])})

    shapes = edges.join(named, edges.label == named.node).select("component", "edges").groupBy("component").applyInArrow(outline, out)
    return shapes.join(totals.withColumnRenamed("component", "region"), "region").select("region", "value", "cells", "rings")
