"""Queries of interpolation, spectra and geometry."""

from pyspark.sql import functions as F

from windrift.operators import geometry, regrid as R
from windrift.operators.graph import spread
from windrift.plans import adapters as D
from windrift.plans.joining import KNN, knn_queries
from windrift.plans.registry import query


@query(f"WITH {KNN}, w AS (SELECT qid, val, 1 / pow(greatest(distance, 1e-10), 2) AS w FROM r WHERE rank <= 12) SELECT qid, round(sum(w * val) / sum(w), 6) AS value FROM w GROUP BY 1")
def inverse_distance(spark, sf):
    """Means by inverse distance."""
    return R.inverse_distance(knn_queries(spark, sf), D.points(spark, sf), "val", 12).select("qid", F.round("value", 6).alias("value"))


@query(f"""WITH {D.GRID}, a AS (SELECT i, CAST(least(floor(i * 19.0 / 30), 18) AS BIGINT) AS lo, i * 19.0 / 30 - least(floor(i * 19.0 / 30), 18) AS t FROM range(31) r(i)), b AS (SELECT i, CAST(least(floor(i * 9.0 / 14), 8) AS BIGINT) AS lo, i * 9.0 / 14 - least(floor(i * 9.0 / 14), 8) AS t FROM range(15) r(i)),
x AS (SELECT i, lo AS o, 1 - t AS w FROM a UNION ALL SELECT i, lo + 1, t FROM a), y AS (SELECT i, lo AS o, 1 - t AS w FROM b UNION ALL SELECT i, lo + 1, t FROM b)
SELECT z, y.i AS y, x.i AS x, round(sum(x.w * y.w * u), 6) AS u FROM grid JOIN x ON grid.x = x.o JOIN y ON grid.y = y.o GROUP BY 1, 2, 3""")
def linear_resampling(spark, sf):
    """Each layer on more points, ends kept."""
    return R.resampled(D.grid(spark, sf), [("y", 10, 15), ("x", 20, 31)], "u", ["z"]).select("z", "y", "x", F.round("u", 6).alias("u"))


LEVELS = [-5.0, 0.0, 3.5, 7.25, 12.0, 33.3, 48.0, 5000.0]


@query(f"""WITH {D.GRID}, q AS (SELECT x, y, level FROM (SELECT DISTINCT x, y FROM grid), (SELECT CAST(unnest({LEVELS}) AS DOUBLE) AS level)), g AS (SELECT x, y, CAST(z AS DOUBLE) AS zz, u FROM grid),
b AS (SELECT q.*, g.zz AS z0, g.u AS u0 FROM q ASOF LEFT JOIN g ON q.x = g.x AND q.y = g.y AND q.level >= g.zz), c AS (SELECT b.*, g.zz AS z1, g.u AS u1 FROM b ASOF LEFT JOIN g ON b.x = g.x AND b.y = g.y AND b.level < g.zz)
SELECT x, y, level, round(CASE WHEN u0 IS NULL THEN u1 WHEN u1 IS NULL THEN u0 ELSE u0 + (u1 - u0) * (level - z0) / (z1 - z0) END, 6) AS value FROM c""")
def vertical_resampling(spark, sf):
    """Columns on fixed levels."""
    return R.vertical(D.grid(spark, sf), ["x", "y"], "z", "u", LEVELS).select("x", "y", "level", F.round("value", 6).alias("value"))


@query(f"WITH {D.GRID}, h AS (SELECT x, y, greatest(v, 0) AS h FROM grid WHERE z = 3) SELECT x, y, round((h - (SELECT min(h) FROM h)) * 1.5, 6) AS h FROM h")
def terrain_surface(spark, sf):
    """A surface without negatives, from 0 up, scaled."""
    return R.surface(D.grid(spark, sf).where("z = 3").select("x", "y", F.col("v").alias("h")), "h", 1.5).select("x", "y", F.round("h", 6).alias("h"))


@query(f"""WITH {D.GRID}, {D.PROFILE}, c AS (SELECT i % 20 AS x, (i // 20) % 10 AS y, i // 200 AS z FROM range(4000) r(i)), f AS (SELECT *, CAST(CASE WHEN z = 19 THEN 1 WHEN z = 0 THEN 0 WHEN y = 0 THEN 2 WHEN y = 9 THEN 3 WHEN x = 0 THEN 4 WHEN x = 19 THEN 5 ELSE -1 END AS INTEGER) AS patch FROM c),
g AS (SELECT x, y, min(u) AS h FROM grid GROUP BY 1, 2), q AS (SELECT f.*, f.z * 3.0 - h AS agl FROM f JOIN g USING (x, y) WHERE patch >= 0),
b AS (SELECT q.*, p.z AS z0, p.U AS u0 FROM q ASOF LEFT JOIN profile p ON q.agl >= p.z), d AS (SELECT b.*, p.z AS z1, p.U AS u1 FROM b ASOF LEFT JOIN profile p ON b.agl < p.z)
SELECT patch, x, y, z, round(CASE WHEN agl < 0 THEN 0 WHEN u0 IS NULL THEN u1 WHEN u1 IS NULL THEN u0 ELSE u0 + (u1 - u0) * (agl - z0) / (z1 - z0) END, 6) AS value FROM d""")
def terrain_following_faces(spark, sf):
    """Speeds on the box's faces by height above the ground."""
    ground = D.grid(spark, sf).groupBy("x", "y").agg(F.min("u").alias("h"))
    f = R.boundary_faces(20, 10, 20, spark)
    return R.profile_field(f, ground, D.profile(spark, sf), F.col("z") * 3.0).select("patch", "x", "y", "z", F.round("value", 6).alias("value"))


@query(f"""WITH {D.GRID}, {D.PROFILE}, {D.POINTS}, c AS (SELECT i % 20 AS x, (i // 20) % 10 AS y, i // 200 AS z FROM range(4000) r(i)), f AS (SELECT *, CAST(CASE WHEN z = 19 THEN 1 WHEN z = 0 THEN 0 WHEN y = 0 THEN 2 WHEN y = 9 THEN 3 WHEN x = 0 THEN 4 WHEN x = 19 THEN 5 ELSE -1 END AS INTEGER) AS patch FROM c),
t AS (SELECT f.*, least(z * 0.25, (SELECT max(z) FROM grid)) AS b FROM f WHERE patch IN (2, 3)), w AS (SELECT *, CAST(floor(b) AS BIGINT) AS z0, CAST(ceil(b) AS BIGINT) AS z1 FROM t),
p AS (SELECT w.patch, w.x, w.y, w.z, g0.u + (g1.u - g0.u) * (b - z0) AS value FROM w JOIN grid g0 ON (g0.x, g0.y, g0.z) = (w.x, w.y, z0) JOIN grid g1 ON (g1.x, g1.y, g1.z) = (w.x, w.y, z1)),
n AS (SELECT f.patch, f.x, f.y, f.z, val, row_number() OVER (PARTITION BY f.x, f.y, f.z ORDER BY sqrt(pow(px - (f.y * 0.02 - 0.1), 2) + pow(py - (f.z * 0.02 - 0.2), 2)), vec_id) AS k FROM f, points WHERE patch = 4),
h AS (SELECT x, y, min(u) AS h FROM grid GROUP BY 1, 2), q AS (SELECT f.*, f.z * 3.0 - h AS agl FROM f JOIN h USING (x, y) WHERE patch = 5), o AS (SELECT q.*, p.z AS p0, p.U AS u0 FROM q ASOF LEFT JOIN profile p ON q.agl >= p.z), d AS (SELECT o.*, p.z AS p1, p.U AS u1 FROM o ASOF LEFT JOIN profile p ON o.agl < p.z)
SELECT patch, x, y, z, CAST(0 AS DOUBLE) AS value FROM f WHERE patch = 0 UNION ALL SELECT patch, x, y, z, 7.5 FROM f WHERE patch = 1 UNION ALL SELECT patch, x, y, z, round(value, 6) FROM p UNION ALL SELECT patch, x, y, z, round(val, 6) FROM n WHERE k = 1
UNION ALL SELECT patch, x, y, z, round(CASE WHEN agl < 0 THEN 0 WHEN u0 IS NULL THEN u1 WHEN u1 IS NULL THEN u0 ELSE u0 + (u1 - u0) * (agl - p0) / (p1 - p0) END, 6) FROM d""")
def boundary_fields(spark, sf):
    """A box's faces by branch: none, uniform, mapped from a patch's samples, nearest sample, profile above the ground."""
    from windrift.operators.joins import k_nearest, two_level

    grid, points, c = D.grid(spark, sf), D.points(spark, sf), F.col

    def mapped(face):
        return two_level(face.select("patch", "x", "y", "z", c("x").cast("double").alias("a"), (c("z") * 0.25).alias("b")), grid.select(c("y"), c("x").alias("gx"), c("z").alias("gz"), "u"), "y", "gx", "gz", "u", "a", "b")

    def closest(face):
        q = face.withColumn("qid", (c("z") * 10 + c("y")) * 20 + c("x"))
        near = k_nearest(q.select("qid", (c("y") * 0.02 - 0.1).alias("qx"), (c("z") * 0.02 - 0.2).alias("qy")), points, 1)
        return q.join(near, "qid").join(points.select("vec_id", c("val").alias("value")), "vec_id")

    ground = grid.groupBy("x", "y").agg(F.min("u").alias("h"))
    still, steady = (lambda face: face.withColumn("value", F.lit(0.0))), (lambda face: face.withColumn("value", F.lit(7.5)))
    by_height = lambda face: R.profile_field(face, ground, D.profile(spark, sf), c("z") * 3.0)
    fields = R.face_fields(R.boundary_faces(20, 10, 20, spark), {0: still, 1: steady, 2: mapped, 3: mapped, 4: closest, 5: by_height})
    return fields.select("patch", "x", "y", "z", F.round("value", 6).alias("value"))


@query(f"""WITH {D.GRID}, m AS (SELECT i, 0.1 * (i + 1) AS kx, 0.05 * i AS ky, 0.02 * i AS kz, 0.3 * i AS omega, 1.0 / (i + 1) AS a, 0.7 * i AS ph FROM range(16) r(i))
SELECT z, y, x, round(sum(a * cos(kx * x + ky * y + kz * z - omega * 2.5 + ph)), 6) AS u FROM grid, m GROUP BY 1, 2, 3""")
def synthetic_inflow(spark, sf):
    """Inflow as a sum of modes at a time."""
    i = F.col("id")
    modes = spark.range(16).select((0.1 * (i + 1)).alias("kx"), (0.05 * i).alias("ky"), (0.02 * i).alias("kz"), (0.3 * i).alias("omega"), (1.0 / (i + 1)).alias("amplitude"), (0.7 * i).alias("phase"))
    return R.mode_sum(D.grid(spark, sf).select("z", "y", "x"), modes, 2.5).select("z", "y", "x", F.round("u", 6).alias("u"))


def dft(source: str, out: str, axis: str, others: str, n: str, real: bool) -> str:
    """A step of a Fourier transform in SQL: `axis` becomes its wave number."""
    angle = f"2 * pi() * k * {axis} / {n}"
    re, im = (f"sum(re * cos({angle}) + im * sin({angle}))", f"sum(im * cos({angle}) - re * sin({angle}))") if not real else (f"sum(re * cos({angle}))", f"-sum(re * sin({angle}))")
    return f"{out} AS (SELECT {others}, k AS {axis}, {re} / {n} AS re, {im} / {n} AS im FROM {source}, (SELECT unnest(range({n})) AS k) GROUP BY ALL)"


SIGNED = lambda k, n: f"CASE WHEN 2 * {k} > {n} THEN {k} - {n} ELSE {k} END"


@query(f"""WITH {D.GRID}, m AS (SELECT z, avg(u) AS mu FROM grid GROUP BY 1), s AS (SELECT z, y, x, u - mu AS re, 0.0 AS im FROM grid JOIN m USING (z)), {dft("s", "a", "x", "z, y", "20", True)}, {dft("a", "b", "y", "z, x", "10", False)}
SELECT z, CASE WHEN x >= 10 THEN x - 20 ELSE x END AS kx, CASE WHEN y >= 5 THEN y - 10 ELSE y END AS ky, round(re * re + im * im + 1.0000017, 5) AS energy FROM b""")
def layer_spectrum(spark, sf):
    """Energy of every wave number of each layer."""
    return R.layer_spectrum(D.grid(spark, sf), 20, 10, "u").select("z", "kx", "ky", F.round(F.col("energy") + 1.0000017, 5).alias("energy"))


VOLUME = f"""{D.GRID}, n AS (SELECT max(z) + 1 AS nz, avg(u) AS mu FROM grid), s AS (SELECT z, y, x, u - mu AS re, 0.0 AS im FROM grid, n), {dft("s", "a", "x", "z, y", "20", True)}, {dft("a", "b", "y", "z, x", "10", False)},
c AS (SELECT x, y, k AS z, sum(re * cos(2 * pi() * k * z / nz) + im * sin(2 * pi() * k * z / nz)) / max(nz) AS re, sum(im * cos(2 * pi() * k * z / nz) - re * sin(2 * pi() * k * z / nz)) / max(nz) AS im, max(nz) AS nz FROM b, n, (SELECT unnest(range((SELECT max(z) + 1 FROM grid))) AS k) GROUP BY ALL)"""


def spectrum_of(spark, sf):
    g = D.grid(spark, sf)
    nz = g.agg(F.max("z")).first()[0] + 1
    return R.volume_spectrum(g, 20, 10, nz, "u"), nz


@query(f"WITH {VOLUME} SELECT CASE WHEN x > 10 THEN x - 20 ELSE x END AS kx, CASE WHEN y > 5 THEN y - 10 ELSE y END AS ky, CASE WHEN 2 * z >= nz THEN z - nz ELSE z END AS kz, round(re * re + im * im + 1.0000017, 5) AS energy FROM c")
def volume_spectrum(spark, sf):
    """Energy of every wave number of the volume, by planes and pencils."""
    s, _ = spectrum_of(spark, sf)
    return s.select("kx", "ky", "kz", F.round(F.col("energy") + 1.0000017, 5).alias("energy"))


@query(f"""WITH {VOLUME}, k AS (SELECT x AS mx, CASE WHEN y > 5 THEN 10 - y ELSE y END AS my, CASE WHEN 2 * z >= nz THEN nz - z ELSE z END AS mz, nz, re * re + im * im AS e FROM c WHERE x <= 10),
r AS (SELECT sqrt(pow(2 * pi() * mx / 40.0, 2) + pow(2 * pi() * my / 20.0, 2) + pow(2 * pi() * mz / (5.0 * nz), 2)) AS k, CASE WHEN mx IN (0, 10) THEN 1 ELSE 2 END AS w, e FROM k)
SELECT CAST(least(floor(k / 0.2 + 1e-9), 11) AS BIGINT) AS shell, round(sum(0.5 * e * w) + 1, 6) AS shell_energy, CAST(sum(w) AS BIGINT) AS mode_weight FROM r GROUP BY 1""")
def isotropic_spectrum(spark, sf):
    """The volume's energy by shells of wave number; half of the modes stand for both halves."""
    s, nz = spectrum_of(spark, sf)
    half = s.where("kx >= 0").withColumn("weight", F.when(F.col("kx").isin(0, 10), 1).otherwise(2)).withColumn("half", F.col("energy") * 0.5)
    import math

    k = F.sqrt(sum(F.pow(F.col(c) * (2 * math.pi / length), F.lit(2)) for c, length in (("kx", 40.0), ("ky", 20.0), ("kz", 5.0 * nz))))
    from windrift.operators import aggregates as A

    shells = A.shell_sums(half, k + 0.2e-9, 0.2, 12, "half", "weight")
    return shells.select(F.col("shell").cast("bigint"), F.round(F.col("shell_energy") + 1, 6).alias("shell_energy"), "mode_weight")


QUADRATIC = "1 + 2 * {x} - {y} + 0.5 * {x} * {x} - 0.25 * {x} * {y} + 2 * {y} * {y}"


def planted(spark, sf, f):
    return D.points(spark, sf).withColumn("val", F.expr(f.format(x="px", y="py")))


@query(f"WITH {D.POINTS} SELECT vec_id AS qid, round(3.5, 6)::DOUBLE AS even, round(val, 6) AS own FROM points")
def local_kriging(spark, sf):
    """Kriging of the nearest points: equal values give that value, a sample its own; the tests hold the rest against numpy."""
    even = R.kriging(knn_queries(spark, sf), planted(spark, sf, "3.5 + 0 * {x} * {y}"), "val", 12, 0.1).select("qid", F.round("value", 6).alias("even"))
    p = D.points(spark, sf)
    own = R.kriging(p.select(F.col("vec_id").alias("qid"), F.col("px").alias("qx"), F.col("py").alias("qy")), p, "val", 12, 0.1).select("qid", F.round("value", 6).alias("own"))
    return even.join(own, "qid")


@query(f"WITH {D.POINTS}, q AS (SELECT vec_id AS qid, px + 0.003 AS x, py - 0.002 AS y FROM points) SELECT qid, round({QUADRATIC.format(x='x', y='y')}, 4) AS value FROM q")
def moving_least_squares(spark, sf):
    """Quadratic fits of the nearest points meet a planted quadratic."""
    return R.moving_least_squares(knn_queries(spark, sf), planted(spark, sf, QUADRATIC), "val", 24, 1e-13).select("qid", F.round("value", 4).alias("value"))


@query(f"WITH {D.POINTS}, q AS (SELECT vec_id AS qid, px + 0.003 AS x, py - 0.002 AS y FROM points) SELECT qid, round({QUADRATIC.format(x='x', y='y')} + 10 * (qid % 5), 4) AS value FROM q")
def face_fits(spark, sf):
    """Fits over the nearest samples of the same face meet that face's planted quadratic."""
    face = F.col("vec_id") % 5
    p = planted(spark, sf, QUADRATIC).withColumn("face", face).withColumn("val", F.col("val") + 10 * F.col("face"))
    return R.face_fit(knn_queries(spark, sf).withColumn("face", F.col("qid") % 5), p, "val", 64).select("qid", F.round("value", 4).alias("value"))


@query(f"""WITH {D.GRID}, t(target, x, y) AS (VALUES (0, 0, 0), (1, 3, 4), (2, 19, 9), (3, 7, 0), (4, 11, 5)) SELECT z, CAST(target AS BIGINT) AS target, round(u, 5) AS value FROM grid JOIN t USING (x, y) UNION ALL SELECT DISTINCT z, CAST(5 AS BIGINT), CAST(NULL AS DOUBLE) FROM grid""")
def spline_layers(spark, sf):
    """Cubic splines of each layer meet the samples, and are nothing outside; the tests hold the rest."""
    return R.spline_layer(D.grid(spark, sf), 20, 10, "u", [(0.0, 0.0), (3.0, 4.0), (19.0, 9.0), (7.0, 0.0), (11.0, 5.0), (19.5, 3.0)]).select("z", "target", F.round("value", 5).alias("value"))


REFLECT = "CASE WHEN {i} < 0 THEN -{i} - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - {i} ELSE {i} END"


@query(f"""WITH {D.POINTS}, q AS (SELECT i AS qid, i % 20 AS x, i // 20 AS y, (i % 20 - 9.5) * 0.02 AS qx, (i // 20 - 4.5) * 0.02 AS qy FROM range(200) r(i)), d AS (SELECT qid, x, y, vec_id, val, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) AS distance FROM q, points),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank, 1 / pow(greatest(distance, 1e-10), 2) AS w FROM d), i AS (SELECT x, y, sum(w * val) / sum(w) AS v FROM r WHERE rank <= 12 GROUP BY 1, 2),
k AS (SELECT d, g / sum(g) OVER () AS g FROM (SELECT d, exp(-0.5 * d * d) AS g FROM (SELECT unnest(range(-4, 5)) AS d))),
h AS (SELECT a.y, a.x, sum(b.v * g) AS v FROM (SELECT y, x FROM i) a, k JOIN i b ON b.y = a.y AND b.x = {REFLECT.format(i='(a.x + d)', n=20)} GROUP BY 1, 2), s AS (SELECT a.y, a.x, greatest(sum(b.v * g), 0) AS v FROM (SELECT y, x FROM h) a, k JOIN h b ON b.x = a.x AND b.y = {REFLECT.format(i='(a.y + d)', n=10)} GROUP BY 1, 2)
SELECT x, y, round((v - (SELECT min(v) FROM s)) * 1.5, 6) AS value FROM s""")
def terrain_pipeline(spark, sf):
    """A terrain surface from scattered points: interpolated, smoothed, without negatives, from 0 up, scaled."""
    nodes = spark.range(200).select(F.col("id").alias("qid"), (F.col("id") % 20).alias("x"), F.expr("id div 20").alias("y")).withColumns({"qx": (F.col("x") - 9.5) * 0.02, "qy": (F.col("y") - 4.5) * 0.02})
    return R.terrain_surface(nodes, D.points(spark, sf), "val", 12, 1.0, 1.5).select("x", "y", F.round("value", 6).alias("value"))


@query(f"""WITH {D.GRID}, m AS (SELECT 0.1 * (i + 1) AS kx, 0.05 * i AS ky, 0.02 * i AS kz, 0.3 * i AS omega, 1.0 / (i + 1) AS a, 0.7 * i AS ph FROM range(16) r(i)), p AS (SELECT z, y, x, z % 13 AS step, (z % 13) // 5 * 5 AS s0 FROM grid)
SELECT z, y, x, round(sum(a * (cos(kx * x + ky * y + kz * z - omega * s0 * 0.5 + ph) * (1 - (step - s0) / 5.0) + cos(kx * x + ky * y + kz * z - omega * (s0 + 5) * 0.5 + ph) * (step - s0) / 5.0)), 6) AS u FROM p, m GROUP BY 1, 2, 3""")
def inflow_between_updates(spark, sf):
    """Inflow that is summed every fifth step and blended in between."""
    i = F.col("id")
    modes = spark.range(16).select((0.1 * (i + 1)).alias("kx"), (0.05 * i).alias("ky"), (0.02 * i).alias("kz"), (0.3 * i).alias("omega"), (1.0 / (i + 1)).alias("amplitude"), (0.7 * i).alias("phase"))
    return R.strided_inflow(D.grid(spark, sf).select("z", "y", "x"), modes, F.col("z") % 13, 5, 0.5).select("z", "y", "x", F.round("u", 6).alias("u"))


def rings(spark, sf):
    """A right-angled footprint for each part: p_size wide, p_retailprice / 100 deep, with a small hole."""
    w, d, k = F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.col("p_partkey").cast("double")
    point = lambda x, y: F.struct((k + x).alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "alias") else y.alias("y"))
    ring = F.array(point(F.lit(0.0), 0.0), point(w, 0.0), point(w, d), point(F.lit(0.0), d), point(F.lit(0.0), 0.0))
    return D.read(spark, sf, "part").select("p_partkey", ring.alias("ring"), F.array(ring, F.slice(F.transform(ring, lambda p: F.struct((p["x"] / 4).alias("x"), (p["y"] / 4).alias("y"))), 1, 5)).alias("rings"))


@query("""SELECT p_partkey, round(p_size * p_retailprice / 100 + 1e-7, 4) AS area, round(p_size * p_retailprice / 100 * 15 / 16 + 1e-7, 4) AS net, CAST(CASE WHEN p_size * p_retailprice / 1600 >= 5 THEN 2 ELSE 1 END AS INTEGER) AS rings, round(p_partkey + p_size, 6) AS x1, CAST(CASE p_partkey % 3 WHEN 0 THEN 'not_closed' WHEN 1 THEN 'too_few_points' END AS VARCHAR) AS defect FROM (SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) WHERE p_size * p_retailprice / 100 >= 20""")
def footprints(spark, sf):
    """Areas with and without holes, small holes, bounds, defects."""
    r = rings(spark, sf).withColumn("area", F.abs(geometry.ring_area(F.col("ring"))))
    k = F.col("p_partkey")
    spoilt = F.when(k % 3 == 0, F.slice("ring", 1, 4)).when(k % 3 == 1, F.slice("ring", 1, 3)).otherwise(F.col("ring"))
    return r.where("area >= 20").select(k.cast("double").alias("p_partkey"), F.round(F.col("area") + 1e-7, 4).alias("area"), F.round(geometry.footprint_area(F.col("rings")) + 1e-7, 4).alias("net"), F.size(geometry.without_small_holes(F.col("rings"), 5.0)).alias("rings"), F.round(geometry.bounds(F.col("ring"))["x1"], 6).alias("x1"), geometry.defect(spoilt).alias("defect"))


@query("SELECT p_partkey, round(least(p_size, p_retailprice / 100), 6) AS short_side FROM part")
def short_sides(spark, sf):
    """Shorter side of the smallest rectangle around a footprint."""
    return geometry.short_sides(rings(spark, sf), "p_partkey", "ring").select("p_partkey", F.round("short_side", 6).alias("short_side"))


@query("SELECT p_partkey, round((least(p_partkey + p_size, 900.5) - greatest(p_partkey, 100.25)) * (least(p_retailprice / 100, 7.5) - 1), 5) AS area FROM part WHERE least(p_partkey + p_size, 900.5) > greatest(p_partkey, 100.25) AND p_retailprice / 100 > 1")
def clipped_footprints(spark, sf):
    """Footprints cut to a box."""
    c = geometry.clipped(rings(spark, sf), "p_partkey", "ring", [(100.25, 1.0), (900.5, 1.0), (900.5, 7.5), (100.25, 7.5)])
    return c.select("p_partkey", F.round(F.abs(geometry.ring_area(F.col("ring"))), 5).alias("area"))


@query(f"""WITH {D.GRID}, c AS (SELECT x, y, u AS h FROM grid WHERE z = 1), k(t, corner, dx, dy) AS (VALUES (0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 1, 1), (1, 0, 0, 0), (1, 1, 1, 1), (1, 2, 0, 1))
SELECT CAST(((y - dy) * 20 + (x - dx)) * 2 + t AS BIGINT) AS triangle, CAST(corner AS INTEGER) AS corner, x, y, h AS height FROM c, k WHERE x - dx BETWEEN 0 AND 18 AND y - dy BETWEEN 0 AND 8""")
def terrain_mesh(spark, sf):
    """The terrain as triangles."""
    return geometry.terrain_triangles(D.grid(spark, sf).where("z = 1").select("x", "y", F.col("u").alias("h")), 20, 10, "h")


@query("""WITH b AS (SELECT min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part)
SELECT p_partkey, round((p_size - x0) * (90.0 / (x1 - x0)) + 10, 6) AS x, round((p_retailprice - y0) * (40.0 / (y1 - y0)) - 20, 6) AS y FROM part, b""")
def moved_mesh(spark, sf):
    """Vertices scaled and moved to given bounds."""
    v = D.read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return geometry.fitted(v, {"x": (10.0, 100.0), "y": (-20.0, 20.0)}).select("p_partkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def outlines(spark, sf):
    """A footprint in the form of an L for each part, every other one with a hole in its foot."""
    k, a, b = F.col("p_partkey"), F.col("p_size") + 1.0, F.col("p_retailprice") / 100
    at = lambda *xy: F.array(*(F.struct((k * 100 + x).alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "alias") else y.alias("y")) for x, y in xy))
    outer = at((F.lit(0.0), 0.0), (3 * a, 0.0), (3 * a, b), (a, b), (a, 2 * b), (F.lit(0.0), 2 * b), (F.lit(0.0), 0.0))
    hole = at((1.5 * a, b / 4), (2.5 * a, b / 4), (2.5 * a, b / 2), (1.5 * a, b / 2), (1.5 * a, b / 4))
    return D.read(spark, sf, "part").select(k, F.when(k % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"), (k % 5).cast("double").alias("low"), (k % 5 + a).alias("high"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 40 ELSE 20 END AS BIGINT) AS triangles, round((p_size + 1) * (p_size + 1) * (p_retailprice / 100) * CASE WHEN p_partkey % 2 = 0 THEN 3.75 ELSE 4 END, 4) AS volume FROM part""")
def extruded_buildings(spark, sf):
    """Footprints with and without holes as closed solids: how many triangles, and what they enclose."""
    t = geometry.extruded(outlines(spark, sf), "p_partkey", "rings", "low", "high")
    away = F.transform("corners", lambda c: F.struct((c["x"] - F.col("p_partkey") * 100).alias("x"), c["y"].alias("y"), c["z"].alias("z")))  # near the origin, for the sum's sake
    return t.groupBy("p_partkey").agg(F.count("*").alias("triangles"), F.round(F.sum(geometry.signed_volume(away)), 4).alias("volume"))


@query(f"""WITH {D.GRID}, n AS (SELECT count(*) AS parts, sum(CASE WHEN p_partkey % 2 = 0 THEN 40 ELSE 20 END) AS triangles FROM part)
SELECT CAST(0 AS INTEGER) AS part, CAST(0 AS BIGINT) AS first, CAST(11 AS BIGINT) AS last, CAST(12 AS BIGINT) AS facets FROM n UNION ALL SELECT 1, 12, 12 + 341, 342 FROM n UNION ALL SELECT 2, 12 + 342, CAST(12 + 342 + triangles - 1 AS BIGINT), CAST(triangles AS BIGINT) FROM n""")
def joined_meshes(spark, sf):
    """Base block, terrain and buildings as one mesh, its facets numbered without a gap."""
    cells = D.grid(spark, sf).where("z = 1").select("x", "y", F.col("u").alias("h"))
    corners = geometry.terrain_triangles(cells, 20, 10, "h")
    terrain = corners.groupBy("triangle").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", "x", "y", "height"))), lambda c: F.struct(c["x"].cast("double").alias("x"), c["y"].cast("double").alias("y"), c["height"].alias("z"))).alias("corners"))
    buildings = geometry.extruded(outlines(spark, sf), "p_partkey", "rings", "low", "high")
    mesh = geometry.joined_meshes(geometry.base_block(spark, 0, 19, 0, 9, -5, 0), terrain, buildings)
    return mesh.groupBy("part").agg(F.min("facet").alias("first"), F.max("facet").alias("last"), F.count_distinct("facet").alias("facets"))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS d FROM part)
SELECT k AS p_partkey, CAST(CASE WHEN k % 6 = 5 THEN 1 ELSE 2 END AS INTEGER) AS rings, CAST(5 AS INTEGER) AS points, round(w * d + 1e-7, 4) AS area FROM p WHERE k % 6 NOT IN (3, 4)""")
def repaired_footprints(spark, sf):
    """rings closed, doubled and missing points gone; what is no area goes."""
    k, r = F.col("p_partkey"), F.col("rings")
    nothing = F.lit(None).cast("struct<x:double,y:double>")
    outer, hole = r[0], F.transform(r[0], lambda p: F.struct(((p["x"] - F.col("p_partkey")) / 4 + F.col("p_partkey")).alias("x"), (p["y"] / 4).alias("y")))
    spoilt = (
        F.when(k % 6 == 0, F.array(F.slice(outer, 1, 4), hole))  # not closed
        .when(k % 6 == 1, F.array(F.flatten(F.transform(outer, lambda p: F.array(p, p))), hole))  # points doubled
        .when(k % 6 == 2, F.array(F.concat(F.slice(outer, 1, 2), F.array(nothing), F.slice(outer, 3, 3)), hole))  # a point missing
        .when(k % 6 == 3, F.array(F.slice(outer, 1, 2), hole))  # a line
        .when(k % 6 == 4, F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
        .otherwise(F.array(outer, F.slice(hole, 1, 2)))
    )
    fixed = spread(rings(spark, sf)).withColumn("fixed", geometry.repaired(spoilt)).where("fixed is not null")
    return fixed.select("p_partkey", F.size("fixed").alias("rings"), F.size(F.col("fixed")[0]).alias("points"), F.round(F.abs(geometry.ring_area(F.col("fixed")[0])) + 1e-7, 4).alias("area"))
