"""Queries of the joins and set operations."""

from pyspark.sql import functions as F

from windrift.operators import graph, joins as J
from windrift.plans import adapters as D
from windrift.plans.registry import query


@query(f"""WITH {D.PROFILE}, q AS (SELECT o_orderkey AS qid, (o_orderkey % 600) / 10.0 AS h FROM orders),
b AS (SELECT q.qid, q.h, lo.z AS z_below, lo.U AS ub FROM q ASOF LEFT JOIN profile lo ON q.h >= lo.z),
c AS (SELECT b.*, hi.z AS z_above, hi.U AS ua FROM b ASOF LEFT JOIN profile hi ON b.h < hi.z)
SELECT qid, z_below, z_above, round(CASE WHEN ub IS NULL THEN ua WHEN ua IS NULL THEN ub ELSE ub + (ua - ub) * (h - z_below) / (z_above - z_below) END, 6) AS value FROM c""")
def bracket_profile(spark, sf):
    """Value of a profile at any height, held at its ends."""
    q = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), ((F.col("o_orderkey") % 600) / 10.0).alias("h"))
    return J.bracketed(q, D.profile(spark, sf), "h", "z", "U").select("qid", "z_below", "z_above", F.round("value", 6).alias("value"))


@query("""WITH l AS (SELECT event_id, user_id % 50 AS k, event_id AS t FROM events), r AS (SELECT user_id % 50 AS k, event_id * 4 + 1 AS t, value FROM events),
b AS (SELECT l.event_id, l.k, l.t, r.value AS before, r.t AS before_at FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t)
SELECT b.event_id, b.before, b.before_at, r.value AS after, r.t AS after_at FROM b ASOF LEFT JOIN r ON b.k = r.k AND b.t < r.t""")
def as_of_both_sides(spark, sf):
    """The last value up to a time and the first after it, in each key."""
    e = D.read(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("k"), F.col("event_id").alias("t"), "value")
    left = e.select("event_id", "k", F.col("t").alias("at"))
    right = e.select("k", (F.col("t") * 4 + 1).alias("rt"), "value")
    return J.as_of(left, right, ["k"], "at", "rt", "value").select("event_id", "before", "before_at", "after", "after_at")


@query(f"""WITH {D.GRID}, n AS (SELECT max(z) AS top FROM grid), q AS (SELECT o_orderkey AS qid, o_orderkey % 10 AS y, (o_orderkey % 220) / 10.0 - 1 AS a, (o_orderkey % 530) / 10.0 - 1 AS b FROM orders),
c AS (SELECT qid, y, a, b, CAST(least(greatest(floor(a), 0), 19) AS BIGINT) AS x0, CAST(least(greatest(ceil(a), 0), 19) AS BIGINT) AS x1, CAST(least(greatest(floor(b), 0), top) AS BIGINT) AS z0, CAST(least(greatest(ceil(b), 0), top) AS BIGINT) AS z1 FROM q, n),
w AS (SELECT *, CASE WHEN x1 > x0 THEN a - x0 ELSE 0 END AS t, CASE WHEN z1 > z0 THEN b - z0 ELSE 0 END AS s FROM c)
SELECT qid, round((1 - t) * ((1 - s) * g00.u + s * g01.u) + t * ((1 - s) * g10.u + s * g11.u), 6) AS value FROM w JOIN grid g00 ON (g00.x, g00.y, g00.z) = (x0, w.y, z0) JOIN grid g01 ON (g01.x, g01.y, g01.z) = (x0, w.y, z1) JOIN grid g10 ON (g10.x, g10.y, g10.z) = (x1, w.y, z0) JOIN grid g11 ON (g11.x, g11.y, g11.z) = (x1, w.y, z1)""")
def two_level_lookup(spark, sf):
    """Values of a patch between its columns and, in each, between its samples."""
    k = F.col("o_orderkey")
    q = D.read(spark, sf, "orders").select(k.alias("qid"), (k % 10).alias("y"), ((k % 220) / 10.0 - 1).alias("a"), ((k % 530) / 10.0 - 1).alias("b"))
    return J.two_level(q, D.grid(spark, sf), "y", "x", "z", "u", "a", "b").select("qid", F.round("value", 6).alias("value"))


KNN = f"""{D.POINTS}, q AS (SELECT vec_id AS qid, px + 0.003 AS qx, py - 0.002 AS qy FROM points),
d AS (SELECT qid, vec_id, val, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) AS distance FROM q, points),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM d)"""


def knn_queries(spark, sf):
    return D.points(spark, sf).select(F.col("vec_id").alias("qid"), (F.col("px") + 0.003).alias("qx"), (F.col("py") - 0.002).alias("qy"))


@query(f"WITH {KNN} SELECT qid, vec_id, round(distance, 9) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12")
def k_nearest(spark, sf):
    """The twelve nearest samples."""
    return J.k_nearest(knn_queries(spark, sf), D.points(spark, sf), 12).select("qid", "vec_id", F.round("distance", 9).alias("distance"), "rank")


@query(f"WITH {KNN} SELECT qid, vec_id, val FROM r WHERE rank = 1")
def nearest(spark, sf):
    """The nearest sample's value."""
    p = D.points(spark, sf)
    return J.k_nearest(knn_queries(spark, sf), p, 1).join(p.select("vec_id", "val"), "vec_id").select("qid", "vec_id", "val")


OVERLAPS = f"{D.BOXES}, o AS (SELECT a.vec_id AS a, b.vec_id AS b FROM boxes a JOIN boxes b ON a.vec_id < b.vec_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"


@query(f"WITH {OVERLAPS} SELECT a, b FROM o")
def overlapping_boxes(spark, sf):
    """Footprints that overlap; touching is no overlap."""
    return J.overlapping(D.boxes(spark, sf), 0.02)


@query(f"""WITH RECURSIVE {OVERLAPS}, e AS (SELECT a, b FROM o UNION SELECT b, a FROM o UNION SELECT vec_id, vec_id FROM boxes),
reach(node, seen) AS (SELECT vec_id, vec_id FROM boxes UNION SELECT r.node, e.b FROM reach r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)
SELECT component, count(*) AS members, max(height) AS height, min(vec_id) AS first_member FROM c JOIN boxes ON node = vec_id GROUP BY 1""")
def merged_buildings(spark, sf):
    """Overlapping footprints as one building: members, largest height, first member."""
    b = D.boxes(spark, sf)
    comp = graph.components(J.linked(b, 0.02), b.select(F.col("vec_id").alias("node")))
    return comp.join(b, comp.node == b.vec_id).groupBy("component").agg(F.count("*").alias("members"), F.max("height").alias("height"), F.min("vec_id").alias("first_member"))


@query(f"""WITH {D.GRID}, q AS (SELECT event_id AS qid, (event_id % 1801) / 100.0 + 0.3 AS fx, (event_id % 777) / 100.0 + 0.2 AS fy FROM events),
c AS (SELECT qid, fx, fy, CAST(floor(fx) AS BIGINT) AS x0, CAST(floor(fy) AS BIGINT) AS y0 FROM q), g AS (SELECT x, y, u FROM grid WHERE z = 0),
w AS (SELECT qid, x0 AS x, y0 AS y, (1 - (fx - x0)) * (1 - (fy - y0)) AS w FROM c UNION ALL SELECT qid, x0 + 1, y0, (fx - x0) * (1 - (fy - y0)) FROM c UNION ALL SELECT qid, x0, y0 + 1, (1 - (fx - x0)) * (fy - y0) FROM c UNION ALL SELECT qid, x0 + 1, y0 + 1, (fx - x0) * (fy - y0) FROM c)
SELECT qid, round(sum(w * u), 6) AS value FROM w JOIN g USING (x, y) GROUP BY 1""")
def bilinear_lookup(spark, sf):
    """Values between grid points."""
    q = D.read(spark, sf, "events").select(F.col("event_id").alias("qid"), ((F.col("event_id") % 1801) / 100.0 + 0.3).alias("fx"), ((F.col("event_id") % 777) / 100.0 + 0.2).alias("fy"))
    return J.bilinear(q, D.grid(spark, sf).where("z = 0"), F.col("fx"), F.col("fy"), "u").select("qid", F.round("value", 6).alias("value"))


@query(f"""WITH {D.GRID}, q AS (SELECT event_id AS qid, (event_id % 2501) / 100.0 - 2 AS fx, (event_id % 1303) / 100.0 - 1.5 AS fy FROM events), c AS (SELECT qid, fx, fy, CAST(floor(fx) AS BIGINT) AS x0, CAST(floor(fy) AS BIGINT) AS y0 FROM q), g AS (SELECT x, y, u FROM grid WHERE z = 0),
w AS (SELECT qid, x0 AS x, y0 AS y, (1 - (fx - x0)) * (1 - (fy - y0)) AS w FROM c UNION ALL SELECT qid, x0 + 1, y0, (fx - x0) * (1 - (fy - y0)) FROM c UNION ALL SELECT qid, x0, y0 + 1, (1 - (fx - x0)) * (fy - y0) FROM c UNION ALL SELECT qid, x0 + 1, y0 + 1, (fx - x0) * (fy - y0) FROM c),
v AS (SELECT qid, sum(w * u) AS v FROM w JOIN g USING (x, y) GROUP BY 1) SELECT q.qid, CASE WHEN fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 9 THEN round(v, 6) END AS value FROM q LEFT JOIN v USING (qid)""")
def masked_lookup(spark, sf):
    """Values between grid points, none outside the grid."""
    q = D.read(spark, sf, "events").select(F.col("event_id").alias("qid"), ((F.col("event_id") % 2501) / 100.0 - 2).alias("fx"), ((F.col("event_id") % 1303) / 100.0 - 1.5).alias("fy"))
    return J.bilinear_within(q, D.grid(spark, sf).where("z = 0"), F.col("fx"), F.col("fy"), "u", 20, 10).select("qid", F.round("value", 6).alias("value"))


@query("""WITH d AS (SELECT DISTINCT round(o_totalprice / 100, 1) AS x FROM orders), f AS (SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) > 0.5 THEN 1 ELSE 0 END AS fresh FROM d),
i AS (SELECT x, sum(fresh) OVER (ORDER BY x) AS island FROM f) SELECT CAST(island AS BIGINT) AS island, min(x) AS low, max(x) AS high, round(avg(x), 6) AS middle, count(*) AS n FROM i GROUP BY 1""")
def tolerance_clusters(spark, sf):
    """Coordinates within a tolerance become one, their mean."""
    d = D.read(spark, sf, "orders").select(F.round(F.col("o_totalprice") / 100, 1).alias("x")).distinct()
    return J.all_islands(d, "x", 0.5).groupBy("island").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.avg("x"), 6).alias("middle"), F.count("*").alias("n"))


@query("""WITH a(alias, name) AS (VALUES ('click', 'press'), ('view', 'look'), ('purchase', 'buy')) SELECT coalesce(name, event_type) AS canonical, count(*) AS n FROM events LEFT JOIN a ON event_type = alias GROUP BY 1""")
def alias_names(spark, sf):
    """Names and their aliases."""
    aliases = spark.createDataFrame([("click", "press"), ("view", "look"), ("purchase", "buy")], "alias string, name string")
    return J.alias_lookup(D.read(spark, sf, "events").select("event_type"), "event_type", aliases).groupBy("canonical").agg(F.count("*").alias("n"))


@query("SELECT a.angle, CAST(b.l AS BIGINT) AS inflow FROM (SELECT DISTINCT CAST(22.5 * (user_id % 16) AS DOUBLE) AS angle FROM events) a, (SELECT DISTINCT l_linenumber AS l FROM lineitem) b")
def case_grid(spark, sf):
    """Every inflow with every angle; both lists are fixed and short."""
    angles = D.read(spark, sf, "events").select((22.5 * (F.col("user_id") % 16)).alias("angle")).distinct()
    inflows = D.read(spark, sf, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("inflow")).distinct()
    return angles.crossJoin(F.broadcast(inflows))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def missing_cases(spark, sf):
    """What is required and not there."""
    return D.read(spark, sf, "customer").select("c_custkey").join(D.read(spark, sf, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def wanted_cases(spark, sf):
    """What is known of the wanted."""
    done = D.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return D.read(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(done, "c_custkey", "left_semi")


@query(f"WITH {D.GRID} SELECT z, y, x, a.u - b.v AS s FROM (SELECT z, y, x, u FROM grid) a JOIN (SELECT z, y, x, v FROM grid) b USING (z, y, x)")
def positional_join(spark, sf):
    """Fields of one grid put together by cell."""
    g = D.grid(spark, sf)
    return g.select("z", "y", "x", "u").join(g.select("z", "y", "x", "v"), ["z", "y", "x"]).select("z", "y", "x", (F.col("u") - F.col("v")).alias("s"))


@query(f"""WITH {D.BUILDINGS}, s AS (SELECT log10(length) AS lk, log10(avg(weight)) AS le FROM buildings GROUP BY length), a AS (SELECT lk, le FROM s WHERE lk <= log10(20.5) ORDER BY lk DESC LIMIT 1), b AS (SELECT lk, le FROM s WHERE lk > log10(20.5) ORDER BY lk LIMIT 1)
SELECT round(pow(10, a.le + (b.le - a.le) * (log10(20.5) - a.lk) / (b.lk - a.lk)), 6) AS anchor FROM a, b""")
def log_log_anchor(spark, sf):
    """Anchor of a reference slope, read off a spectrum in log-log space."""
    s = D.buildings(spark, sf).groupBy("length").agg(F.avg("weight").alias("e")).select(F.log10("length").alias("lk"), F.log10("e").alias("le"))
    return J.bracketed(spark.range(1).select(F.log10(F.lit(20.5)).alias("k")), s, "k", "lk", "le").select(F.round(F.pow(F.lit(10.0), "value"), 6).alias("anchor"))


@query(f"""WITH {D.POINTS}, r AS (SELECT vec_id, unnest([0, 1, 1, 0]) AS dx, unnest([0, 0, 1, 1]) AS dy FROM points), {D.GRID}, g AS (SELECT x, y, min(u) AS h FROM grid GROUP BY 1, 2)
SELECT r.vec_id, min(h) AS base FROM r JOIN g ON g.x = (r.vec_id + dx) % 20 AND g.y = (r.vec_id + dy) % 10 GROUP BY 1""")
def base_elevation(spark, sf):
    """Lowest ground under a footprint's corners."""
    ground = D.grid(spark, sf).groupBy("x", "y").agg(F.min("u").alias("h"))
    corner = lambda i, j: F.struct(((F.col("vec_id") + i) % 20).alias("x"), ((F.col("vec_id") + j) % 10).alias("y"))
    ring = D.points(spark, sf).select("vec_id", F.explode(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("c"))
    return ring.select("vec_id", "c.x", "c.y").join(ground, ["x", "y"]).groupBy("vec_id").agg(F.min("h").alias("base"))


@query("""SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS height, CAST(NULL AS INTEGER) AS corner_id FROM part UNION ALL SELECT -c, NULL, CAST(c AS INTEGER) FROM (VALUES (1), (2), (3), (4)) t(c)""")
def buildings_with_markers(spark, sf):
    """Buildings and four corner markers, by name, missing columns null."""
    b = D.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("height"))
    m = spark.range(1, 5).select((-F.col("id")).alias("id"), F.col("id").cast("int").alias("corner_id"))
    return b.unionByName(m, allowMissingColumns=True)


@query("SELECT DISTINCT url FROM (SELECT url FROM pages WHERE page_id % 2 = 0 UNION SELECT url FROM pages WHERE page_id % 3 = 0)")
def union_of_globs(spark, sf):
    """Files found by any of several patterns, once."""
    p = D.read(spark, sf, "pages")
    return p.where(F.col("page_id") % 2 == 0).select("url").union(p.where(F.col("page_id") % 3 == 0).select("url")).distinct()
