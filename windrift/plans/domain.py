"""Queries of the domain, outputs and barycentric regridding."""

from pyspark.sql import functions as F

from windrift.operators import domain as O
from windrift.operators.triangles import barycentric
from windrift.plans import adapters as D
from windrift.plans.projection import A, E2, EP2, K0
from windrift.plans.registry import query
from windrift.plans.tables import decks, shared_folder
from windrift.sources import outputs as W


def utm_sql(lon, lat):
    phi, l0 = f"radians({lat})", "radians(zone * 6 - 183)"
    n, t, c, a = f"({A} / sqrt(1 - {E2} * pow(sin({phi}), 2)))", f"pow(tan({phi}), 2)", f"({EP2} * pow(cos({phi}), 2))", f"((radians({lon}) - {l0}) * cos({phi}))"
    m = f"({A} * ({1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256} * {phi} - {3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024} * sin(2 * {phi}) + {15 * E2**2 / 256 + 45 * E2**3 / 1024} * sin(4 * {phi}) - {35 * E2**3 / 3072} * sin(6 * {phi})))"
    east = f"({K0} * {n} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 + (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {EP2}) * pow({a}, 5) / 120) + 500000)"
    north = f"({K0} * ({m} + {n} * tan({phi}) * ({a} * {a} / 2 + (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24 + (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {EP2}) * pow({a}, 6) / 720)))"
    return east, north


_C = {k: utm_sql(lon, lat) for k, lon, lat in (("sw", "lon0", "lat0"), ("se", "lon1", "lat0"), ("nw", "lon0", "lat1"), ("ne", "lon1", "lat1"))}


@query(f"""WITH b AS (SELECT id, lon0, lat0, lon0 + 0.05 AS lon1, lat0 + 0.03 AS lat1 FROM (SELECT c_custkey AS id, (c_custkey * 0.37) % 340 - 170 AS lon0, (c_custkey * 0.11) % 70 + 1 AS lat0 FROM (SELECT CAST(c_custkey AS DOUBLE) AS c_custkey FROM customer))),
z AS (SELECT *, CAST(floor(((lon0 + lon1) / 2 + 180) / 6) AS INTEGER) + 1 AS zone FROM b), m AS (SELECT id, zone, {', '.join(f'{e} AS {k}_e, {n} AS {k}_n' for k, (e, n) in _C.items())} FROM z)
SELECT id, zone, round((sw_e + se_e + nw_e + ne_e) / 4, 3) AS px, round((sw_n + se_n + nw_n + ne_n) / 4, 3) AS py, round(atan2(se_n - sw_n, se_e - sw_e), 9) AS angle FROM m""")
def turned_domains(spark, sf):
    """Pivot and turn of a domain given in degrees."""
    k = F.col("c_custkey").cast("double")
    boxes = D.read(spark, sf, "customer").select(k.alias("id"), ((k * 0.37) % 340 - 170).alias("lon0"), ((k * 0.11) % 70 + 1).alias("lat0")).withColumns({"lon1": F.col("lon0") + 0.05, "lat1": F.col("lat0") + 0.03})
    return O.turned_domain(boxes).select("id", "zone", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"), F.round("angle", 9).alias("angle"))


@query(f"WITH {D.GRID} SELECT z * 10.0::DOUBLE - 50 + 12.5 AS height, count(*) AS n, round(max(u), 6) AS top FROM grid WHERE z * 10 >= 50 GROUP BY 1")
def pedestal_removed(spark, sf):
    """Levels above the pedestal, from sea level."""
    g = D.grid(spark, sf).withColumn("height", F.col("z") * 10.0)
    return O.without_pedestal(g, "height", 50.0, 12.5).groupBy("height").agg(F.count("*").alias("n"), F.round(F.max("u"), 6).alias("top"))


@query(f"""WITH RECURSIVE {D.GRID}, c AS (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, (x - 9.5) * (x - 9.5) + (y - 4.5) * (y - 4.5) <= 64 AS ok FROM grid WHERE z = 0),
b(k, x0, x1, y0, y1) AS (SELECT 0, min(x), max(x), min(y), max(y) FROM c UNION ALL SELECT k + 1, x0 + (x1 - x0) * 0.02, x1 - (x1 - x0) * 0.02, y0 + (y1 - y0) * 0.02, y1 - (y1 - y0) * 0.02 FROM b WHERE k < 11),
s AS (SELECT b.*, (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0 END) FROM c WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS share FROM b)
SELECT round(x0, 9) AS x0, round(x1, 9) AS x1, round(y0, 9) AS y0, round(y1, 9) AS y1 FROM s WHERE share = 1 ORDER BY k LIMIT 1""")
def shrunk_box(spark, sf):
    """A target box drawn in until it lies inside the data."""
    c = D.grid(spark, sf).where("z = 0").select(F.col("x").cast("double"), F.col("y").cast("double"))
    inside = (F.col("x") - 9.5) * (F.col("x") - 9.5) + (F.col("y") - 4.5) * (F.col("y") - 4.5) <= 64
    box = O.shrunk_box(c, "x", "y", inside)
    return spark.createDataFrame([tuple(round(v, 9) for v in box)] if box else [], "x0 double, x1 double, y0 double, y1 double")


@query(f"WITH {D.GRID} SELECT 100 + 2.5 * x AS x, 50 + 2.5 * y AS y, u AS elevation FROM (SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, u FROM grid WHERE z = 2)")
def cached_terrain(spark, sf):
    """A cached grid of elevations as points."""
    g = D.grid(spark, sf).where("z = 2")
    cache = g.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "u"))), lambda s: s["u"]).alias("line"))
    return O.cached_points(cache, "y", "line", F.lit(100.0), F.lit(50.0), F.lit(2.5))


@query(f"WITH {D.GRID} SELECT CAST(z AS INTEGER) AS z, count(*) AS n, round(sum(u), 4) AS total, 'EPSG:32650' AS crs, 'm above sea' AS heights FROM grid WHERE z BETWEEN 10 AND 20 GROUP BY 1")
def levels_round_trip(spark, sf):
    """A cube written by level with its coordinate system, a range of levels read back (other folders are not opened)."""
    path = f"{shared_folder(spark)}/cube"
    W.write_levels(D.grid(spark, sf), path, meta={"crs": "EPSG:32650", "heights": "m above sea"})
    cube, meta = W.read_levels(spark, path)
    sums = cube.where("z BETWEEN 10 AND 20").groupBy(F.col("z").cast("int").alias("z")).agg(F.count("*").alias("n"), F.round(F.sum("u"), 4).alias("total"))
    return sums.withColumns({k: F.lit(v) for k, v in meta.items()})


@query(f"""WITH {D.GRID}, p AS (SELECT o_orderkey AS id, (o_orderkey % 41) * 1.0 AS x, (o_orderkey % 23) * 1.0 AS y, (o_orderkey % 17) * 1.0 AS z FROM orders)
SELECT id, g.u AS mean_velocity_x, round((g.u - 1) / 3, 6) AS mean_pressure FROM p JOIN grid g ON g.x = least(floor(p.x / 2 + 0.5), 19) AND g.y = least(floor(p.y / 2 + 0.5), 9) AND g.z = least(floor(p.z / 2 + 0.5), 4)""")
def sampled_means(spark, sf):
    """Mean fields at given places."""
    k = F.col("o_orderkey")
    p = D.read(spark, sf, "orders").select(k.alias("id"), ((k % 41) * 1.0).alias("x"), ((k % 23) * 1.0).alias("y"), ((k % 17) * 1.0).alias("z"))
    return W.sampled_means(p, D.grid(spark, sf).withColumn("rho", F.col("u")), 2.0, (20, 10, 5)).select("id", "mean_velocity_x", F.round("mean_pressure", 6).alias("mean_pressure"))


@query("""SELECT printf('%.3f', CAST(l_orderkey AS DOUBLE)) AS "X", printf('%.3f', CAST(l_linenumber AS DOUBLE)) AS "Y", printf('%.3f', l_quantity) AS "Z", l_discount AS u FROM lineitem""")
def boundary_output(spark, sf):
    """Boundary samples as they are written."""
    s = D.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("double").alias("X"), F.col("l_linenumber").cast("double").alias("Y"), F.col("l_quantity").alias("Z"), F.col("l_discount").alias("u"))
    return W.boundary_csv(s)


@query("SELECT o_orderkey AS deck, CASE o_orderkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN '2' ELSE 'maybe' END AS high_order, '[12, ' || o_orderkey % 20 || ']' AS cut_lon_manual FROM orders")
def key_value_texts(spark, sf):
    """Single settings read from whole texts."""
    return W.key_values(decks(spark, sf), "text", "high_order", "cut_lon_manual").select("deck", "high_order", "cut_lon_manual")


@query(f"""WITH {D.POINTS}, q AS (SELECT vec_id AS qid, px * 0.4 + 0.004 AS x, py * 0.4 - 0.003 AS y FROM points) SELECT qid, CAST(1 AS DOUBLE) AS weight, round(2 * x - 3 * y + 1, 6) AS value FROM q""")
def barycentric_regrid(spark, sf):
    """Weights of the source columns around places: they sum to one and meet a planted plane; the tests hold them against all triangles."""
    p = D.points(spark, sf)
    q = p.select(F.col("vec_id").alias("qid"), (F.col("px") * 0.4 + 0.004).alias("qx"), (F.col("py") * 0.4 - 0.003).alias("qy"))
    sources = p.withColumn("val", 2 * F.col("px") - 3 * F.col("py") + 1)
    w = barycentric(q, sources).join(sources.select("vec_id", "val"), "vec_id")
    return w.groupBy("qid").agg(F.round(F.sum("weight"), 9).alias("weight"), F.round(F.sum(F.col("weight") * F.col("val")), 6).alias("value"))


_CELLS = lambda k: f"(greatest(floor({k} * a), 1) * greatest(floor({k} * b), 1) * greatest(floor({k} * c), 1))"
_MEGABYTES = lambda k: " + ".join(f"floor({_CELLS(k)} * {b} / 1048576)" for b in (38, 4, 12, 1))


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size + 1.0::DOUBLE AS a, p_retailprice / 100 AS b, 5.0::DOUBLE AS c, CAST(1000 + p_partkey % 7 * 500 AS DOUBLE) AS m FROM part),
s(id, a, b, c, m, k, lo, hi) AS (SELECT id, a, b, c, m, 0, cbrt(m * 1048576.0::DOUBLE / (55 * a * b * c)) / 2, cbrt(m * 1048576.0::DOUBLE / (55 * a * b * c)) * 4 FROM p UNION ALL
SELECT id, a, b, c, m, k + 1, CASE WHEN {_MEGABYTES('((lo + hi) / 2)')} <= m THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_MEGABYTES('((lo + hi) / 2)')} <= m THEN hi ELSE (lo + hi) / 2 END FROM s WHERE k < 48)
SELECT id, CAST(greatest(floor(lo * a), 1) AS BIGINT) AS nx, CAST(greatest(floor(lo * b), 1) AS BIGINT) AS ny, CAST(greatest(floor(lo * c), 1) AS BIGINT) AS nz, CAST({_MEGABYTES('lo')} AS BIGINT) AS megabytes FROM s WHERE k = 48""")
def largest_grids(spark, sf):
    """The finest grid of a box's proportions that a memory budget holds."""
    k = F.col("p_partkey")
    boxes = D.read(spark, sf, "part").select(k.alias("id"), (F.col("p_size") + 1.0).alias("a"), (F.col("p_retailprice") / 100).alias("b"), F.lit(5.0).alias("c"), (1000 + k % 7 * 500).cast("double").alias("m"))
    return O.largest_grid(boxes, ("a", "b", "c"), F.col("m"), (38, 4, 12, 1)).select("id", "nx", "ny", "nz", "megabytes")
