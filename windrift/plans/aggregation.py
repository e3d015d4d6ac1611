"""Queries of the aggregations."""

from pyspark.sql import functions as F

from windrift.operators import aggregates as A
from windrift.plans import adapters as D
from windrift.plans.registry import query


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {D.GRID}, long AS (SELECT 'u' AS variable, u AS x FROM grid UNION ALL SELECT 'v', v FROM grid UNION ALL SELECT 'w', w FROM grid)
SELECT variable, count(x) AS n, min(x) AS low, round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.95), 6) AS q95, max(x) AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM long GROUP BY 1""")
def variable_summary(spark, sf):
    """Profile of each variable."""
    return rounded(A.summary(D.grid(spark, sf), "u", "v", "w"), "q05", "median", "q95", "mean", "deviation")


@query(f"""WITH {D.POINTS}, long AS (SELECT 'px' AS axis, px AS x FROM points UNION ALL SELECT 'py', py FROM points)
SELECT axis, min(x) AS low, max(x) AS high, max(x) - min(x) AS span FROM long GROUP BY 1""")
def axis_extents(spark, sf):
    """Extents of a layer."""
    return A.extents(D.points(spark, sf), "px", "py")


@query(f"""WITH {D.POINTS}, b AS (SELECT px * 1.0005 AS px, py FROM points),
e AS (SELECT abs((SELECT max(px) - min(px) FROM points) - (SELECT max(px) - min(px) FROM b)) / (SELECT max(px) - min(px) FROM b) AS error)
SELECT round(error, 9) AS error, error < 0.001 AS passed FROM e""")
def extents_verdict(spark, sf):
    """Two layers' extents compared axis by axis."""
    p = D.points(spark, sf)
    return rounded(A.extents_agree(A.extents(p, "px", "py"), A.extents(p.withColumn("px", F.col("px") * 1.0005), "px", "py")), "error", digits=9)


@query(f"WITH {D.GRID} SELECT z, count(*) AS n, round(avg(u), 6) AS mean_u, round(avg(v), 6) AS mean_v FROM grid GROUP BY 1")
def level_means(spark, sf):
    """Domain mean of each level."""
    return rounded(A.level_means(D.grid(spark, sf), "u", "v"), "mean_u", "mean_v")


@query(f"WITH {D.STEPS} SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS variance FROM steps GROUP BY 1")
def online_moments(spark, sf):
    """Count, mean and population variance of each key."""
    return A.online_moments(D.steps(spark, sf), ["user_id"], "value").select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


@query(f"WITH {D.GRID} SELECT z, avg(CASE WHEN v <> 0 OR w <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage, CAST(sum(CASE WHEN v <> 0 OR w <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM grid GROUP BY 1")
def layer_coverage(spark, sf):
    """Share of valid cells in each layer."""
    return A.layer_coverage(D.grid(spark, sf), "v", "w")


BINS = "bins AS (SELECT * FROM (VALUES (0, 0.0, 50.0), (1, 50.0, 100.0), (2, 100.0, 150.0), (3, 150.0, 200.0), (4, 200.0, 250.0), (5, 250.0, 300.0), (6, 300.0, NULL)) t(bin, lower, upper)), speeds AS (SELECT bin, CAST(CASE WHEN upper IS NOT NULL THEN (lower + upper) / 2 ELSE lower + 0.5 * (SELECT sum(upper - lower) FROM bins) END AS DOUBLE) AS speed FROM bins)"
WEIGHTS = f"{D.WINDROSE}, {BINS}, weights AS (SELECT angle, sum(p) AS p, sum(p * speed / 160.0) AS wv, sum(p * (speed / 160.0) * (speed / 160.0)) AS we FROM windrose JOIN speeds USING (bin) GROUP BY 1)"


def speeds(spark):
    return A.bin_speeds(spark.createDataFrame([(k, 50.0 * k, 50.0 * k + 50 if k < 6 else None) for k in range(7)], "bin bigint, lower double, upper double"))


@query(f"WITH {WEIGHTS} SELECT CAST(angle AS DOUBLE) AS angle, round(p + 3e-9, 7) AS p, round(wv + 3e-9, 7) AS velocity_weight, round(we + 3e-9, 7) AS energy_weight FROM weights")
def direction_weights(spark, sf):
    """Weights of the wind directions."""
    w = A.direction_weights(D.windrose(spark, sf), speeds(spark), 160.0)
    return w.select("angle", *(F.round(F.col(c) + 3e-9, 7).alias(c) for c in ("p", "velocity_weight", "energy_weight")))


@query(f"""WITH {D.WINDROSE}, {BINS}, {D.PROFILE}, {D.GRID},
ref AS (SELECT lo.U + (hi.U - lo.U) * (10.5 - lo.z) / (hi.z - lo.z) AS speed FROM (SELECT * FROM profile WHERE z <= 10.5 ORDER BY z DESC LIMIT 1) lo, (SELECT * FROM profile WHERE z > 10.5 ORDER BY z LIMIT 1) hi),
weights AS (SELECT angle, sum(p * s.speed / r.speed) AS wv, sum(p * (s.speed / r.speed) * (s.speed / r.speed)) AS we FROM windrose JOIN speeds s USING (bin), ref r GROUP BY 1),
fields AS (SELECT 22.5 * (x % 16) AS angle, z, y, x % 4 AS x4, u, v, w, 0.5 * (v * v + w * w) AS tke FROM grid)
SELECT z, y, CAST(x4 AS BIGINT) AS x, round(sum(wv * u), 6) AS u, round(sum(wv * v), 6) AS v, round(sum(wv * w), 6) AS w, round(sum(wv * sqrt(u * u + v * v + w * w)), 6) AS vm, round(sum(we * tke), 6) AS tke
FROM fields JOIN weights USING (angle) GROUP BY 1, 2, 3""")
def season_average(spark, sf):
    """The season's average field from one field a direction."""
    from windrift.operators.joins import bracketed

    query_at = spark.range(1).select(F.lit(10.5).alias("height"))
    reference = bracketed(query_at, D.profile(spark, sf), "height", "z", "U").select(F.col("value").alias("reference"))
    rose = D.windrose(spark, sf).join(F.broadcast(reference))
    weights = A.direction_weights(rose, speeds(spark), F.col("reference"))
    g = D.grid(spark, sf).select((22.5 * (F.col("x") % 16)).alias("angle"), "z", "y", (F.col("x") % 4).alias("x"), "u", "v", "w", (0.5 * (F.col("v") * F.col("v") + F.col("w") * F.col("w"))).alias("tke"))
    return rounded(A.season_average(g, weights, ["z", "y", "x"]), "u", "v", "w", "vm", "tke")


@query(f"""WITH {D.GRID}, cells AS (SELECT a.x AS ix, b.y AS iy FROM (SELECT DISTINCT x FROM grid) a, (SELECT DISTINCT y FROM grid) b),
s AS (SELECT x AS ix, y AS iy, u FROM grid WHERE (x + y) % 3 = 0), m AS (SELECT ix, iy, avg(u) AS mean FROM s GROUP BY 1, 2)
SELECT ix, iy, round(coalesce(mean, (SELECT avg(u) FROM s)), 6) AS value FROM cells LEFT JOIN m USING (ix, iy)""")
def cell_means(spark, sf):
    """Samples averaged into cells, with a default for cells that have none."""
    g = D.grid(spark, sf)
    cells = spark.range(20).select(F.col("id").alias("ix"), F.explode(F.expr("sequence(0L, 9L)")).alias("iy"))
    return rounded(A.cell_means(g.where((F.col("x") + F.col("y")) % 3 == 0), F.col("x"), F.col("y"), cells, "u"), "value")


@query(f"""WITH {D.BUILDINGS}, q AS (SELECT quantile_cont(length, 0.75) AS q3, quantile_cont(length, 0.25) AS q1, min(length) AS low, max(length) AS high, count(length) AS n, sum(weight) AS total FROM buildings),
b AS (SELECT *, greatest(ceil((high - low) / (2 * (q3 - q1) / pow(n, 1.0 / 3))), 1) AS bins FROM q), p AS (SELECT *, (high - low) / bins AS width FROM b)
SELECT CAST(least(floor((length - low) / width), bins - 1) AS BIGINT) AS bin, round(sum(weight) / max(total) / max(width), 9) AS density, round(max(low + least(floor((length - low) / width), bins - 1) * width), 6) AS low, count(*) AS n FROM buildings, p GROUP BY 1""")
def weighted_histogram(spark, sf):
    """Density of building lengths by weight."""
    return A.weighted_histogram(D.buildings(spark, sf), "length", "weight").select(F.col("bin").cast("bigint"), F.round("density", 9).alias("density"), F.round("low", 6).alias("low"), "n")


@query(f"WITH {D.GRID} SELECT CAST(least(floor((u - 0.1) / (300.0 - 0.1) * 50) + 1, 50) AS INTEGER) AS bin, count(*) AS n FROM grid WHERE u BETWEEN 0.1 AND 300 GROUP BY 1")
def fixed_histogram(spark, sf):
    """Fifty equal bins with a lower cut."""
    return A.fixed_histogram(D.grid(spark, sf), "u", 0.1, 300.0, 50)


@query(f"WITH {D.GRID} SELECT round(quantile_cont(v, 0.02), 6) AS low, round(quantile_cont(v, 0.98), 6) AS high FROM grid")
def robust_limits(spark, sf):
    """Colour limits."""
    return rounded(A.robust_limits(D.grid(spark, sf), "v"), "low", "high")


@query(f"WITH {D.STEPS} SELECT event_type AS reason, count(*) AS n FROM steps GROUP BY 1")
def counts_by_reason(spark, sf):
    """Counts, most frequent first."""
    return A.counts_by_reason(D.steps(spark, sf).withColumnRenamed("event_type", "reason"), "reason")


@query(f"""WITH {D.SAMPLES}, f AS (SELECT patch, un, un * area AS f FROM samples)
SELECT patch, round(sum(CASE WHEN f > 0 THEN f ELSE 0 END) + 1e-5, 3) AS flux_out, round(sum(CASE WHEN f < 0 THEN -f ELSE 0 END) + 1e-5, 3) AS flux_in, round(sum(f) + 1e-5, 3) AS net, round(avg(abs(un)), 6) AS mean_size FROM f GROUP BY ROLLUP (patch)""")
def boundary_flux(spark, sf):
    """Flux through each face and all."""
    return A.boundary_flux(D.samples(spark, sf), "patch", "un", "area").select("patch", *(F.round(F.col(c) + 1e-5, 3).alias(c) for c in ("flux_out", "flux_in", "net")), F.round("mean_size", 6).alias("mean_size"))


@query(f"""WITH {D.SAMPLES}, d AS (SELECT sum(un * area) / sum(area) AS excess FROM samples)
SELECT patch, round(sum((un - excess) * area), 3) AS net FROM samples, d GROUP BY 1""")
def flux_correction(spark, sf):
    """A constant is taken off so that nothing is gained or lost."""
    return A.corrected_flux(D.samples(spark, sf), "un", "area").groupBy("patch").agg(F.round(F.sum(F.col("un") * F.col("area")), 3).alias("net"))


@query(f"""WITH {D.GRID}, d AS (SELECT x - lag(x) OVER (PARTITION BY z, y ORDER BY x) AS gap FROM (SELECT DISTINCT z, y, x FROM grid)) SELECT CAST(median(gap) AS DOUBLE) AS spacing FROM d WHERE gap IS NOT NULL""")
def median_spacing(spark, sf):
    """The usual distance of grid points."""
    return A.median_spacing(D.grid(spark, sf), "x", ["z", "y"])


@query(f"WITH {D.SAMPLES} SELECT patch, count(*) AS n, min(\"T\") AS low, max(\"T\") AS high FROM samples GROUP BY 1")
def patch_statistics(spark, sf):
    """Samples and temperature range of each patch."""
    return D.samples(spark, sf).groupBy("patch").agg(F.count("*").alias("n"), F.min("T").alias("low"), F.max("T").alias("high"))


@query(f"""WITH {D.GRID} SELECT z % 5 AS body, round(sum(u * x) / sum(u), 6) AS cx, round(sum(u * y) / sum(u), 6) AS cy, round(sum(v), 5) AS fx, round(sum(w), 5) AS fy, round(sum(x * w - y * v), 4) AS torque FROM grid GROUP BY 1""")
def body_forces(spark, sf):
    """Centre of mass, force and torque of bodies."""
    b = A.body_forces(D.grid(spark, sf).withColumn("body", F.col("z") % 5), "body", "x", "y", "v", "w", "u")
    return b.select("body", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("fx", 5).alias("fx"), F.round("fy", 5).alias("fy"), F.round("torque", 4).alias("torque"))


@query(f"""WITH {D.GRID} SELECT CAST(least(floor(sqrt(x * x + y * y) / 2.0), 6) AS BIGINT) AS shell, round(sum(u * (CASE WHEN x = 0 THEN 1 ELSE 2 END)), 5) AS shell_energy, CAST(sum(CASE WHEN x = 0 THEN 1 ELSE 2 END) AS BIGINT) AS mode_weight FROM grid GROUP BY 1""")
def spectral_shells(spark, sf):
    """Energy by wave-number shell."""
    g = D.grid(spark, sf).withColumn("weight", F.when(F.col("x") == 0, 1).otherwise(2))
    return A.shell_sums(g, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 2.0, 7, "u", "weight").select(F.col("shell").cast("bigint"), F.round("shell_energy", 5).alias("shell_energy"), "mode_weight")
