"""Queries of the projections, filters and scalar functions."""

from pyspark.sql import functions as F

from windrift.functions import geo as G, text as X
from windrift.operators import filters
from windrift.plans import adapters as D
from windrift.plans.registry import query

A, E2, K0, EP2 = G.A, G.E2, G.K0, G.EP2
PLACES = "places AS (SELECT c_custkey AS id, (c_custkey * 0.37) % 360 - 180 AS lon, (c_custkey * 0.11) % 160 - 80 AS lat, CAST(floor(((c_custkey * 0.37) % 360 - 180 + 180) / 6) AS INTEGER) + 1 AS zone FROM (SELECT CAST(c_custkey AS DOUBLE) AS c_custkey FROM customer))"
UTM = f"""{PLACES}, r AS (SELECT *, radians(lat) AS phi, radians(zone * 6 - 183) AS l0 FROM places), s AS (SELECT *, sin(phi) AS sn, cos(phi) AS cs, pow(tan(phi), 2) AS t FROM r),
v AS (SELECT *, {A} / sqrt(1 - {E2} * sn * sn) AS n, {EP2} * cs * cs AS c, (radians(lon) - l0) * cs AS a FROM s),
m AS (SELECT *, {A} * ({1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256} * phi - {3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024} * sin(2 * phi) + {15 * E2**2 / 256 + 45 * E2**3 / 1024} * sin(4 * phi) - {35 * E2**3 / 3072} * sin(6 * phi)) AS m FROM v),
utm AS (SELECT id, lon, lat, zone, {K0} * n * (a + (1 - t + c) * pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {EP2}) * pow(a, 5) / 120) + 500000 AS east,
{K0} * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {EP2}) * pow(a, 6) / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS north FROM m)"""


def places(spark, sf):
    k = F.col("c_custkey").cast("double")
    p = D.read(spark, sf, "customer").select(k.cast("double").alias("id"), ((k * 0.37) % 360 - 180).alias("lon"), ((k * 0.11) % 160 - 80).alias("lat"))
    return p.withColumn("zone", G.utm_zone(F.col("lon")))


@query(f"WITH {UTM} SELECT id, zone, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS INTEGER) AS epsg, round(east, 3) AS east, round(north, 3) AS north FROM utm")
def utm_projection(spark, sf):
    """Degrees to UTM metres, zone and code."""
    e, n = G.lonlat_to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    return places(spark, sf).select("id", "zone", G.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), F.round(e, 3).alias("east"), F.round(n, 3).alias("north"))


@query(f"WITH {PLACES} SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM places")
def utm_round_trip(spark, sf):
    """To UTM, turned about a pivot and back, and back to degrees."""
    e, n = G.lonlat_to_utm(F.col("lon"), F.col("lat"), F.col("zone"))
    p = places(spark, sf).withColumns({"east": e, "north": n})
    x, y = G.rotate(F.col("east"), F.col("north"), 0.3, 500000.0, 4000000.0)
    p = p.withColumns({"x": x, "y": y})
    e, n = G.rotate(F.col("x"), F.col("y"), -0.3, 500000.0, 4000000.0)
    lon, lat = G.utm_to_lonlat(e, n, F.col("zone"), F.col("lat") >= 0)
    return p.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""WITH {D.GRID} SELECT z, y, x, CAST(100.0 + x * 2.5 AS DOUBLE) AS px, round(10 + (x - 10) * cos(0.4) - (y - 5) * sin(0.4), 6) AS rx, round(5 + (x - 10) * sin(0.4) + (y - 5) * cos(0.4), 6) AS ry,
round(sqrt(u * u + v * v + w * w), 6) AS vm, round(u * cos(0.2) - v * sin(0.2) + 1, 6) AS ue, round(u * sin(0.2) + v * cos(0.2) + 1, 6) AS vn FROM grid""")
def grid_projection(spark, sf):
    """Coordinates of cells, turned; speed; components to the east and north (each one up)."""
    g = D.grid(spark, sf)
    rx, ry = G.rotate(F.col("x"), F.col("y"), 0.4, 10, 5)
    ue, vn = G.to_east_north(F.col("u"), F.col("v"), 0.2)
    return g.select("z", "y", "x", G.axis(100.0, 2.5, F.col("x")).alias("px"), F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), F.round(G.speed(F.col("u"), F.col("v"), F.col("w")), 6).alias("vm"), F.round(ue + 1, 6).alias("ue"), F.round(vn + 1, 6).alias("vn"))


@query("""SELECT event_id, round(-value * sin(radians(CAST((user_id * 7) % 360 AS DOUBLE))) + 1, 6) AS u, round(-value * cos(radians(CAST((user_id * 7) % 360 AS DOUBLE))) + 1, 6) AS v, round(value + 273.15, 6) AS kelvin, round(value / 100, 6) AS hpa, round(value * 0.05, 6) AS lattice,
round((value * 100 + 50) / 9.81 - 3, 6) AS agl, round((value - 1) / 3 + 1, 6) AS pressure, CASE WHEN abs(value) >= abs(100.0 - user_id) THEN CASE WHEN value >= 0 THEN 'east' ELSE 'west' END WHEN 100.0 - user_id >= 0 THEN 'north' ELSE 'south' END AS face, round(degrees(atan2(100.0 - user_id, value + 1)), 6) AS yaw FROM events""")
def wind_and_units(spark, sf):
    """Winds by direction, units, heights, pressure, face and yaw of the mean flow."""
    u, v = G.wind_from(F.col("value"), ((F.col("user_id") * 7) % 360).cast("double"))
    across = 100.0 - F.col("user_id")
    return D.read(spark, sf, "events").select(
        "event_id", F.round(u + 1, 6).alias("u"), F.round(v + 1, 6).alias("v"), F.round(G.kelvin(F.col("value")), 6).alias("kelvin"), F.round(G.hectopascal(F.col("value")), 6).alias("hpa"), F.round(G.to_lattice(F.col("value"), 2.0, 0.1), 6).alias("lattice"),
        F.round(G.height_above_ground(F.col("value") * 100, F.lit(50.0), F.lit(3.0)), 6).alias("agl"), F.round(G.pressure_of_density(F.col("value")) + 1, 6).alias("pressure"), G.downstream_face(F.col("value"), across).alias("face"), F.round(G.yaw(F.col("value") + 1, across), 6).alias("yaw"),
    )


@query("""SELECT event_id, CAST(round_even(value / 10, 0) AS DOUBLE) AS even, CAST(CASE WHEN value / 10 < 0 THEN -1 ELSE 1 END * floor(abs(value / 10) + 0.5) AS DOUBLE) AS away, CAST(floor(value / 10 + 0.5) AS BIGINT) AS up, CAST(least(greatest(floor(value / 7.5 + 0.5), 0), 19) AS INTEGER) AS cell FROM events WHERE value > 0""")
def layer_rounding(spark, sf):
    """Height to layer by each rounding rule; nearest cell."""
    h = F.col("value") / 10
    return D.read(spark, sf, "events").where("value > 0").select("event_id", G.half_even(h).alias("even"), G.half_away(h).cast("double").alias("away"), G.half_up_floor(h).cast("bigint").alias("up"), G.snapped(F.col("value"), 7.5, 20).alias("cell"))


@query(f"""WITH {D.GRID}, n AS (SELECT z, y, x, u, v, w, lag(u) OVER r AS b, lead(u) OVER r AS a FROM grid WINDOW r AS (PARTITION BY z, y ORDER BY x)), d AS (SELECT *, coalesce((a - b) / 2, a - u, u - b) AS g FROM n), s AS (SELECT z, var_pop(u) + var_pop(v) + var_pop(w) AS q, avg(u) AS mu, avg(v) AS mv, avg(w) AS mw, avg(g * g) AS gg FROM d GROUP BY 1)
SELECT z, round(0.5 * q, 5) AS tke, round(sqrt(q / 3) / sqrt(mu * mu + mv * mv + mw * mw), 6) AS ti, round(sqrt(0.5 * q) / sqrt(gg), 6) AS length FROM s""")
def turbulence(spark, sf):
    """Energy, intensity and length scale from moments and gradients."""
    from windrift.operators.sequences import differences

    d = differences(D.grid(spark, sf), "x", ["z", "y"], ["u"], 1.0)
    s = d.groupBy("z").agg((F.var_pop("u") + F.var_pop("v") + F.var_pop("w")).alias("q"), *(F.avg(c).alias(f"m{c}") for c in "uvw"), F.avg(F.col("du_dx") * F.col("du_dx")).alias("gg"))
    return s.select("z", F.round(0.5 * F.col("q"), 5).alias("tke"), F.round(F.sqrt(F.col("q") / 3) / G.speed(F.col("mu"), F.col("mv"), F.col("mw")), 6).alias("ti"), F.round(F.sqrt(0.5 * F.col("q")) / F.sqrt("gg"), 6).alias("length"))


@query(f"WITH {D.BUILDINGS} SELECT p_partkey, round(pow(length, 5.0 / 3) * weight, 4) AS compensated, round(2 * 7.2921e-5 * sin(radians(length)), 10) AS f FROM buildings")
def spectrum_and_coriolis(spark, sf):
    """Compensated spectrum; Coriolis parameter."""
    return D.buildings(spark, sf).select("p_partkey", F.round(G.compensated(F.col("length"), F.col("weight")), 4).alias("compensated"), F.round(G.coriolis(F.col("length")), 10).alias("f"))


@query(f"""WITH {D.GRID}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid WHERE 3 * x + y BETWEEN 12 AND 30 AND y - x BETWEEN -6 AND 2) SELECT z, y, x, u FROM grid, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z <= floor((333 - 0) / 10.0 + 1e-9)""")
def bounding_crop(spark, sf):
    """the tight index window of a turned box, up to a height."""
    g = D.grid(spark, sf)
    inside = (3 * F.col("x") + F.col("y")).between(12, 30) & (F.col("y") - F.col("x")).between(-6, 2)
    return filters.tight_window(g, inside, "x", "y").where(F.col("z") <= filters.top_level(333.0, 0.0, 10.0)).select("z", "y", "x", "u")


@query(f"""WITH {D.BOXES} SELECT vec_id, x0 >= -0.05 AND x1 <= 0.1 AND y0 >= -0.05 AND y1 <= 0.1 AS inside, round(greatest(0, (-0.05 - x0), (x1 - 0.1)) / 0.15 * 100, 6) AS miss_x FROM boxes""")
def coverage_of_boxes(spark, sf):
    """boxes inside a domain, and by how many percent they stand out."""
    return D.boxes(spark, sf).select("vec_id", filters.contains((-0.05, 0.1, -0.05, 0.1), "x0", "x1", "y0", "y1").alias("inside"), F.round(filters.miss_percent(-0.05, 0.1, F.col("x0"), F.col("x1")), 6).alias("miss_x"))


@query(f"""WITH {D.GRID} SELECT z, y, x, CAST(CASE WHEN z = 49 THEN 1 WHEN z = 0 THEN 0 WHEN y = 0 THEN 2 WHEN y = 9 THEN 3 WHEN x = 0 THEN 4 WHEN x = 19 THEN 5 ELSE -1 END AS INTEGER) AS patch FROM grid WHERE v <> 0 OR w <> 0""")
def boundary_cells(spark, sf):
    """valid cells and their face."""
    from windrift.operators.aggregates import valid

    return D.grid(spark, sf).where(valid("v", "w")).select("z", "y", "x", G.boundary_patch(F.col("x"), F.col("y"), F.col("z"), 20, 10, 50).alias("patch"))


@query(f"""WITH {D.GRID}, ground AS (SELECT x, y, min(u) AS h FROM grid GROUP BY 1, 2) SELECT z, y, x, u FROM grid JOIN ground USING (x, y) WHERE z * 3.0 >= h AND u > 20 AND x + y - 2 <= 15""")
def terrain_clip(spark, sf):
    """cells above the ground, above a threshold and on one side of a plane."""
    g = D.grid(spark, sf)
    return filters.above_ground(g, g.groupBy("x", "y").agg(F.min("u").alias("h")), F.col("z") * 3.0, "h").where((F.col("u") > 20) & (filters.signed_distance("x", "y", 1, 1, 17) <= 0)).select("z", "y", "x", "u")


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN '2' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN 'T' WHEN 6 THEN '0.0' ELSE '' END AS x FROM orders)
SELECT id, CASE WHEN trim(lower(x)) IN ('yes', 't', '2') THEN true WHEN trim(lower(x)) IN ('off', '0', '0.0') THEN false END AS truth FROM t""")
def loose_booleans(spark, sf):
    """2.11: yes and no in many words."""
    k, words = F.col("o_orderkey"), [" Yes ", "off", "2", "0", "maybe", "T", "0.0", ""]
    return D.read(spark, sf, "orders").select(k.alias("id"), X.truth(F.element_at(F.array(*map(F.lit, words)), (k % 8 + 1).cast("int"))).alias("truth"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 100 AS n FROM orders) SELECT id, CAST(n + 0.5 AS DOUBLE) AS speed, CAST(n * 22.5 % 360 AS DOUBLE) AS angle, CAST(n + 0.25 AS DOUBLE) AS low, CAST(n + 7.0 AS DOUBLE) AS high, CAST(2 AS INTEGER) AS tokens FROM t""")
def loose_numbers(spark, sf):
    """2.11: numbers with odd points and units, compass points, pairs and lists."""
    n = F.col("o_orderkey") % 100
    names = F.array(*map(F.lit, X.COMPASS))
    pair = X.pair(F.concat(F.lit("["), (n + 7).cast("string"), F.lit(", "), n.cast("string"), F.lit("p25]")))
    return D.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), X.number(F.concat(n.cast("string"), F.lit("p5 m/s"))).alias("speed"), X.compass_degrees(F.element_at(names, (n % 16 + 1).cast("int"))).alias("angle"), pair[0].alias("low"), pair[1].alias("high"), F.size(X.tokens(F.concat(F.lit("["), n.cast("string"), F.lit(", , b]")))).alias("tokens")
    )


@query("""SELECT page_id, page_id * 10 AS step, CAST(22.5 * (page_id % 16) AS DOUBLE) AS angle, 'case_' || page_id || '_x' AS stem, CASE WHEN page_id % 2 = 0 THEN '20240131093000' ELSE '20990101120000' END AS stamp FROM pages""")
def name_tokens(spark, sf):
    """F12, S20, S21, 2.11: step, angle, safe stem and time stamp from names."""
    k = F.col("page_id")
    angle = F.regexp_replace((22.5 * (k % 16)).cast("string"), r"\.", "p")
    name = F.concat(F.lit("case_"), angle, F.lit("_avg-"), (k * 10).cast("string"), F.lit(".vtk"))
    return D.read(spark, sf, "pages").select("page_id", X.step_of(name).alias("step"), X.angle_of(name).alias("angle"), X.file_stem(F.concat(F.lit(" case "), k.cast("string"), F.lit("/x."))).alias("stem"), X.stamp(F.when(k % 2 == 0, F.lit("run 20240131093000 a")).otherwise("run 20241331093000")).alias("stamp"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_field(spark, sf):
    """S22, 2.11: one field of a JSON column."""
    return D.read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'cli' WHEN p_size BETWEEN 1 AND 40 THEN 'deck' ELSE 'default' END AS origin, CAST(CASE WHEN p_partkey % 3 = 0 THEN 12 WHEN p_size BETWEEN 1 AND 40 THEN p_size ELSE 8 END AS INTEGER) AS neighbours FROM part""")
def option_precedence(spark, sf):
    """A04, 2.11: the first valid of command line, deck and default, and where it came from."""
    from windrift.operators.deck import resolved

    p = D.read(spark, sf, "part").withColumn("cli", F.when(F.col("p_partkey") % 3 == 0, F.lit("12")))
    value, origin = resolved([("cli", X.number(F.col("cli"))), ("deck", F.col("p_size").cast("double"))], F.lit(8.0), lambda v: v.between(1, 40))
    return p.select("p_partkey", origin.alias("origin"), value.cast("int").alias("neighbours"))
