"""Queries of self-describing grid files: written from the given tables, read back by what is wanted of them."""

import json
import os

from pyspark.sql import functions as F

from windrift.plans import adapters as D
from windrift.plans.registry import query
from windrift.plans.tables import shared_folder
from windrift.sources import outputs as W


def netcdf(spark):
    from windrift.sources.netcdf import NetcdfSource

    spark.dataSource.register(NetcdfSource)
    return spark.read.format("netcdf")


def written(spark, sf, path: str) -> int:
    """The grid as a NetCDF file with levels as records: winds, one of them packed, heights and terrain; returns how many levels it has."""
    from windrift.sources.netcdf import whole_grid

    netcdf(spark)
    g = D.grid(spark, sf)
    levels = (g.agg(F.max("z")).first()[0] or 0) + 1
    cells = g.select("z", "y", "x", F.when((F.col("x") + F.col("y") + F.col("z")) % 13 > 0, F.col("u")).alias("U"), "w", F.format_string("L%03d", "z").alias("name"))
    whole = whole_grid(cells, {"z": levels, "y": 10, "x": 20}).withColumns({"height": F.col("z") * 5.0, "terrain": F.col("y") * 100 + F.col("x"), "name": F.format_string("L%03d", "z")})
    attributes = {"": {"title": "winds", "Conventions": "CF-1.8"}, "U": {"units": "m s-1", "_FillValue": -999.0}, "w": {"scale_factor": 0.2, "add_offset": 1.0, "grid_mapping": "crs"}, "height": {"units": "m above sea"}}
    out = whole.repartitionByRange(4, "z").sortWithinPartitions("z", "y", "x").write.format("netcdf").option("dims", f"z=*{levels},y=10,x=20")
    out = out.option("attributes", json.dumps(attributes)).option("types", json.dumps({"U": "float", "w": "short", "height": "double", "terrain": "int", "name": "char6"}))
    out = out.option("over", json.dumps({"height": ["z"], "terrain": ["y", "x"], "name": ["z"]})).option("scalars", json.dumps({"crs": {"grid_mapping_name": "transverse_mercator", "epsg": 32650}}))
    out.mode("append").save(path)
    return levels


@query(f"WITH {D.GRID} SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CASE WHEN (x + y + z) % 13 > 0 THEN CAST(u AS FLOAT) END AS \"U\", round(w, 6) AS w, CAST(z * 5.0 AS DOUBLE) AS height, CAST(y * 100 + x AS INTEGER) AS terrain, printf('L%03d', z) AS name FROM grid WHERE z >= 2 AND x BETWEEN 3 AND 12")
def netcdf_round_trip(spark, sf):
    """A cube with records, packed values, fill values, texts and coordinates written as NetCDF; a slab of it read back."""
    path = f"{shared_folder(spark)}/cube.nc"
    written(spark, sf, path)
    slab = netcdf(spark).option("variables", "U,w,height,terrain,name").option("ranges", "z=2:,x=3:12").option("cells", "5000").load(path)
    return slab.where("w IS NOT NULL").withColumn("w", F.round("w", 6))


@query(f"""WITH {D.GRID} SELECT CAST(z AS INTEGER) AS z, count(*) AS cells, round(sum(w), 4) AS total, z * 5.0::DOUBLE AS height, 'm above sea' AS heights, 'EPSG:32650' AS crs, 'crs' AS mapping, 'CF-1.8' AS conventions, (SELECT max(z) + 1 FROM grid)::INTEGER AS levels FROM grid GROUP BY 1, 4""")
def netcdf_levels(spark, sf):
    """Level sums of a cube from one variable and its coordinate, with the coordinate system and units that the file states."""
    from windrift.sources.netcdf import meta

    path = f"{shared_folder(spark)}/cube.nc"
    written(spark, sf, path)
    said = meta(path)
    of = {k: v["attributes"] for k, v in said["variables"].items()}
    cube = netcdf(spark).option("variables", "w,height").load(path).where("w IS NOT NULL")
    sums = cube.groupBy("z").agg(F.count("*").alias("cells"), F.round(F.sum("w"), 4).alias("total"), F.first("height").alias("height"))
    told = {"heights": of["height"]["units"], "crs": f"EPSG:{of['crs']['epsg']}", "mapping": of["w"]["grid_mapping"], "conventions": said["attributes"]["Conventions"]}
    return sums.withColumns({k: F.lit(v) for k, v in told.items()} | {"levels": F.lit(said["dims"]["z"])})


@query("""WITH e AS (SELECT user_id % 3 AS c, event_id, value FROM events) SELECT 'case' || c AS "case", count(*) AS rows, round(sum(value), 4) AS total, 'case' || c || '_20990101.nc' AS file FROM e GROUP BY c""")
def netcdf_case_files(spark, sf):
    """Of a project's files the one of its case and time, else its only one, opened and summed."""
    netcdf(spark)
    root = shared_folder(spark)
    e = D.read(spark, sf, "events").select((F.col("user_id") % 3).alias("c"), "event_id", "value")
    counts = {r["c"]: r["count"] for r in e.groupBy("c").count().collect()}  # three cases
    out = None
    for c, n in sorted(counts.items()):
        folder = f"{root}/{c}"
        # Rows are numbered in the order of their ids, so that each has its place in the file.
        from windrift.operators.ordered import numbered

        rows = numbered(e.where(F.col("c") == c), ["event_id"]).select(F.col("at").cast("int").alias("row"), "value")
        rows.write.format("netcdf").option("dims", f"row={n}").mode("append").save(f"{folder}/case{c}_20990101.nc")
        if c:  # an older run beside it
            W.touch(folder, f"case{c}_20980101.nc")
        name = W.case_file(spark, folder, f"case{c}", "20990101" if c else "20000101")
        part = spark.read.format("netcdf").load(name).agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total"))
        part = part.select(F.lit(f"case{c}").alias("case"), "rows", "total", F.lit(os.path.basename(name)).alias("file"))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "case string, rows bigint, total double, file string")


@query("""WITH c AS (SELECT event_id // 20 AS r, event_id % 20 AS c, event_id // 140 * 4 + event_id % 20 // 5 AS block, value FROM events), n AS (SELECT max(r) + 1 AS rows FROM c),
b AS (SELECT block, min(r) AS r0, min(value) AS low, count(*) AS all_cells, count(*) FILTER (r % 7 = 3 AND c % 5 = 2) AS holes FROM c GROUP BY 1)
SELECT round(low + block * 1000, 6) AS elevation, all_cells - holes AS cells, CAST(1 + holes AS INTEGER) AS rings, round((all_cells - holes) * 30.0 * 30.0, 3)::DOUBLE AS area, CAST(500000 + block % 4 * 150 AS DOUBLE) AS west, CAST(4000000 - r0 * 30 AS DOUBLE) AS north FROM b
UNION ALL SELECT round(value - 1000000 - event_id, 6), 1, 1, 900.0, CAST(500000 + (event_id % 20) * 30 AS DOUBLE), CAST(4000000 - (event_id // 20) * 30 AS DOUBLE) FROM events WHERE event_id // 20 % 7 = 3 AND event_id % 5 = 2""")
def raster_regions(spark, sf):
    """A raster of blocks of equal elevation, each around a cell of its own, written in compressed tiles, read back and cut to outlines; each region comes back once, whatever tiles it lies across."""
    from windrift.operators.geometry import footprint_area
    from windrift.operators.regions import regions
    from windrift.sources.geotiff import GeotiffSource, meta, tiled

    spark.dataSource.register(GeotiffSource)
    path = f"{shared_folder(spark)}/terrain.tif"
    i = F.col("event_id")
    cells = D.read(spark, sf, "events").select(F.expr("event_id div 20").alias("row"), (i % 20).alias("col"), (F.expr("event_id div 140") * 4 + F.expr("event_id % 20 div 5")).alias("block"), "event_id", "value")
    low = cells.groupBy("block").agg(F.min("value").alias("low"))
    middle = (F.col("row") % 7 == 3) & (F.col("col") % 5 == 2)
    planted = cells.join(low, "block").select("row", "col", F.when(middle, F.col("value") - 1000000 - F.col("event_id")).otherwise(F.col("low") + F.col("block") * 1000).alias("value"))
    rows = (cells.agg(F.max("row")).first()[0] or 0) + 1
    tiled(planted, 16).write.format("geotiff").option("size", f"{rows},20").option("tile", 16).option("origin", "500000,4000000").option("spacing", "30,30").option("epsg", 32650).mode("append").save(path)
    raster = spark.read.format("geotiff").load(path).where("value <> -9999")
    out = regions(raster, 64, meta(path)["transform"])
    points = F.col("rings")[0]
    return out.select(F.round("value", 6).alias("elevation"), "cells", F.size("rings").alias("rings"), F.round(footprint_area(F.col("rings")), 3).alias("area"), F.array_min(F.transform(points, lambda p: p["x"])).alias("west"), F.array_max(F.transform(points, lambda p: p["y"])).alias("north"))
