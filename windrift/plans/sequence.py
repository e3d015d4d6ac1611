"""Queries of the ordered operators, sorting and step-driven statistics."""

from pyspark.sql import functions as F

from windrift.operators import sequences as S
from windrift.plans import adapters as D
from windrift.plans.registry import query

GAPPY = f"{D.GRID}, g AS (SELECT x, y, z, CASE WHEN (x + 2 * y + 3 * z) % 5 < 2 THEN NULL ELSE u END AS u, v FROM grid)"


def gappy(spark, sf):
    return D.grid(spark, sf).withColumn("u", F.when((F.col("x") + 2 * F.col("y") + 3 * F.col("z")) % 5 >= 2, F.col("u")))


@query(f"""WITH {GAPPY}, f AS (SELECT x, y, z, last_value(CASE WHEN u IS NOT NULL THEN {{'u': u, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY x, y ORDER BY z ROWS UNBOUNDED PRECEDING) AS b,
first_value(CASE WHEN u IS NOT NULL THEN {{'u': u, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM g)
SELECT x, y, z, coalesce(b.u, a.u) AS u, CASE WHEN b IS NOT NULL THEN b.v ELSE a.v END AS v FROM f""")
def forward_fill(spark, sf):
    """Missing layers take the valid one below."""
    return S.filled_levels(gappy(spark, sf).drop("w"), ["x", "y"], "z", "u", ["v"])


@query(f"""WITH RECURSIVE {D.GRID}, g AS (SELECT x, y, z, round(u / 100, 0) + z * 0.0004 AS h, row_number() OVER (PARTITION BY x, y ORDER BY z) AS k FROM grid),
r(x, y, z, k, h) AS (SELECT x, y, z, k, h FROM g WHERE k = 1 UNION ALL SELECT g.x, g.y, g.z, g.k, CASE WHEN g.h <= r.h THEN r.h + 0.001 ELSE g.h END FROM r JOIN g ON g.x = r.x AND g.y = r.y AND g.k = r.k + 1)
SELECT x, y, z, round(h, 6) AS h FROM r""")
def monotone_heights(spark, sf):
    """Heights made strictly rising, level by level."""
    g = D.grid(spark, sf).select("x", "y", "z", (F.round(F.col("u") / 100, 0) + F.col("z") * 0.0004).alias("h"))
    return S.strictly_rising(g, ["x", "y"], "z", "h").select("x", "y", "z", F.round("h", 6).alias("h"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def keep_last(spark, sf):
    """Of entries with one key the last counts."""
    return S.last_of_each(D.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query(f"WITH {D.BUILDINGS}, b AS (SELECT length, sum(weight) AS w FROM buildings GROUP BY 1) SELECT length, round(sum(w) OVER (ORDER BY length DESC) / sum(w) OVER (), 9) AS share FROM b")
def cumulative_distribution(spark, sf):
    """Share of the stock at or above each length."""
    return S.cumulative_share(D.buildings(spark, sf), "length", "weight").select("length", F.round("share", 9).alias("share"))


@query(f"""WITH {D.GRID}, n AS (SELECT z, y, x, u, lag(u) OVER w AS b, lead(u) OVER w AS a FROM grid WINDOW w AS (PARTITION BY z, y ORDER BY x))
SELECT z, y, x, round(CASE WHEN b IS NULL THEN (a - u) / 2.0 WHEN a IS NULL THEN (u - b) / 2.0 ELSE (a - b) / 4.0 END, 6) AS du_dx FROM n""")
def central_differences(spark, sf):
    """Gradients on the grid."""
    return S.differences(D.grid(spark, sf), "x", ["z", "y"], ["u"], 2.0).select("z", "y", "x", F.round("du_dx", 6).alias("du_dx"))


@query(f"""WITH {D.GRID}, n AS (SELECT z, y, x, (u + lead(u) OVER (PARTITION BY z, y ORDER BY x)) / 2 AS u FROM grid) SELECT * FROM n WHERE u IS NOT NULL""")
def destaggered(spark, sf):
    """Values on faces averaged to cell centres."""
    return S.destaggered(D.grid(spark, sf).select("z", "y", "x", "u"), "x", ["z", "y"], "u")


@query(f"""WITH {D.GRID}, k AS (SELECT unnest(range(-2, 3)) AS d), n AS (SELECT a.z, a.y, a.x, sum(b.u * exp(-0.5 * d * d / 2.25)) / sum(exp(-0.5 * d * d / 2.25)) AS s FROM grid a, k JOIN grid b ON b.z = a.z AND b.y = a.y AND b.x = a.x + d GROUP BY 1, 2, 3)
SELECT z, y, x, round(s, 6) AS smooth FROM n""")
def gaussian_smoothing(spark, sf):
    """Gaussian mean along a line."""
    return S.smoothed(D.grid(spark, sf), "x", ["z", "y"], "u", 1.5, 2).select("z", "y", "x", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {D.PROFILE}, s AS (SELECT z, "U" AS v, (lead("U") OVER w - "U") / (lead(z) OVER w - z) AS a, ("U" - lag("U") OVER w) / (z - lag(z) OVER w) AS b FROM profile WINDOW w AS (ORDER BY z)),
m AS (SELECT z, v, coalesce((a + b) / 2, a, b) AS m FROM s), c AS (SELECT z, v, m, lead(z) OVER w AS z1, lead(v) OVER w AS v1, lead(m) OVER w AS m1 FROM m WINDOW w AS (ORDER BY z)),
q AS (SELECT o_orderkey AS qid, (o_orderkey % 490) / 10.0 + 1.05 AS h FROM orders WHERE (o_orderkey % 490) / 10.0 + 1.05 < 50), j AS (SELECT * FROM q ASOF JOIN c ON q.h >= c.z), t AS (SELECT *, z1 - z AS d, (h - z) / (z1 - z) AS t FROM j)
SELECT qid, round((2 * t * t * t - 3 * t * t + 1) * v + (t * t * t - 2 * t * t + t) * d * m + (3 * t * t - 2 * t * t * t) * v1 + (t * t * t - t * t) * d * m1, 5) AS value FROM t""")
def hermite_profile(spark, sf):
    """Cubic interpolation of a profile."""
    q = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), ((F.col("o_orderkey") % 490) / 10.0 + 1.05).alias("h")).where("h < 50")
    return S.hermite(q, D.profile(spark, sf), "h", "z", "U").select("qid", F.round("value", 5).alias("value"))


@query("SELECT user_id, event_id AS file FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def preferred_file(spark, sf):
    """The file of a case that ranks first."""
    return S.preferred_file(D.read(spark, sf, "events").select("user_id", F.col("event_id").alias("file"), "value"), ["user_id"], "file", "value")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def forward_section(spark, sf):
    """Each line under the last header before it."""
    return S.forward_section(D.read(spark, sf, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", "section")


@query(f"WITH {D.STEPS} SELECT event_id, t FROM steps WHERE t >= (SELECT max(t) FROM steps) - 600 + 1 AND (t - ((SELECT max(t) FROM steps) - 600 + 1)) % 7 = 0")
def trailing_window(spark, sf):
    """Every seventh step of the last 600."""
    from windrift.streaming import steps as T

    s = D.steps(spark, sf)
    total = s.agg(F.max("t").alias("total"))
    return s.join(F.broadcast(total)).where(T.accumulates(F.col("t"), F.col("total"), 600, 7)).select("event_id", "t")


@query(f"WITH {D.STEPS}, m AS (SELECT max(t) AS total FROM steps) SELECT event_id, CAST((SELECT count(*) FROM range(0, 600, 7) r(k) WHERE total - 600 + 1 + k > t) AS BIGINT) AS remaining FROM steps, m")
def remaining_samples(spark, sf):
    """How many samples are still to come, in closed form."""
    from windrift.streaming import steps as T

    s = D.steps(spark, sf)
    total = s.agg(F.max("t").alias("total"))
    return s.join(F.broadcast(total)).select("event_id", T.remaining(F.col("t"), F.col("total"), 600, 7).alias("remaining"))


@query("""WITH RECURSIVE s AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r(user_id, n, e) AS (SELECT user_id, n, v FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.n, CASE WHEN s.n <= 8 THEN r.e + (s.v - r.e) / s.n ELSE 0.2 * s.v + 0.8 * r.e END FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, n, round(e, 6) AS estimate FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM r) WHERE n = m""")
def step_estimate(spark, sf):
    """Running estimate of a step's time."""
    return S.step_estimate(D.read(spark, sf, "events"), "user_id", "event_id", "value").select("user_id", "n", F.round("estimate", 6).alias("estimate"))


@query("""WITH b AS (SELECT user_id, event_id, CAST(floor(event_id / (SELECT max(event_id) + 1.0 FROM events) * 20) AS BIGINT) AS bucket FROM events), l AS (SELECT *, lag(bucket) OVER w AS was, lead(bucket) OVER w AS more FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, bucket FROM l WHERE was IS NULL OR bucket <> was OR more IS NULL""")
def progress_throttling(spark, sf):
    """Progress is told when it moves on, first and last in any case."""
    e = D.read(spark, sf, "events").select("user_id", "event_id")
    total = e.agg((F.max("event_id") + 1.0).alias("total"))
    return S.throttled(e.join(F.broadcast(total)), ["user_id"], "event_id", F.col("event_id") / F.col("total"), 20).drop("total")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_results(spark, sf):
    """The first results in a stated order."""
    return D.read(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query(f"WITH {D.GRID} SELECT z, y, x, u FROM grid WHERE x % 4 = 0 AND y % 4 = 0")
def stride_sampling(spark, sf):
    """Every fourth grid point each way (the operator is a subsample)."""
    return D.grid(spark, sf).where("x % 4 = 0 AND y % 4 = 0").select("z", "y", "x", "u")


@query(f"WITH {D.GRID} SELECT z, arg_max(y * 20 + x, u + (y * 20 + x) * 1e-9) AS cell FROM grid GROUP BY 1")
def largest_part(spark, sf):
    """The largest part of each group."""
    cell = F.col("y") * 20 + F.col("x")
    return D.grid(spark, sf).groupBy("z").agg(F.max_by(cell, F.col("u") + cell * 1e-9).alias("cell"))


REFLECT = "CASE WHEN {i} % (2 * {n}) + CASE WHEN {i} < 0 THEN 2 * {n} ELSE 0 END < {n} THEN ({i} % (2 * {n}) + CASE WHEN {i} < 0 THEN 2 * {n} ELSE 0 END) % (2 * {n}) ELSE 2 * {n} - 1 - ({i} % (2 * {n}) + CASE WHEN {i} < 0 THEN 2 * {n} ELSE 0 END) % (2 * {n}) END"


@query(f"""WITH {D.GRID}, k AS (SELECT d, exp(-0.5 * d * d / 2.25) AS g FROM (SELECT unnest(range(-6, 7)) AS d)), w AS (SELECT d, g / sum(g) OVER () AS g FROM k),
h AS (SELECT a.z, a.y, a.x, sum(b.u * g) AS u FROM (SELECT z, y, x FROM grid) a, w JOIN grid b ON b.z = a.z AND b.y = a.y AND b.x = {REFLECT.format(i='(a.x + d)', n=20)} GROUP BY 1, 2, 3)
SELECT a.z, a.y, a.x, round(sum(b.u * g), 6) AS u FROM (SELECT z, y, x FROM grid) a, w JOIN h b ON b.z = a.z AND b.x = a.x AND b.y = {REFLECT.format(i='(a.y + d)', n=10)} GROUP BY 1, 2, 3""")
def smoothed_planes(spark, sf):
    """Gaussian mean over each layer, mirrored at its edges: along x, then along y."""
    g = D.grid(spark, sf).select("z", "y", "x", "u")
    return S.reflected(S.reflected(g, "x", ["z", "y"], "u", 1.5), "y", ["z", "x"], "u", 1.5).select("z", "y", "x", F.round("u", 6).alias("u"))


LEVELS = [0.0, 0.25, 1.5, 2.0, 3.75, 4.0, 7.9, 12.5]


@query(f"""WITH {D.GRID}, c AS (SELECT x, y, CAST(z AS DOUBLE) AS z, u AS v FROM grid), s AS (SELECT *, lead(z) OVER w - z AS h, (lead(v) OVER w - v) / (lead(z) OVER w - z) AS d FROM c WINDOW w AS (PARTITION BY x, y ORDER BY z)),
n AS (SELECT *, lag(h) OVER w AS h0, lag(d) OVER w AS d0, lead(h) OVER w AS h1, lead(d) OVER w AS d1, lag(h, 2) OVER w AS hb, lag(d, 2) OVER w AS db FROM s WINDOW w AS (PARTITION BY x, y ORDER BY z)),
e AS (SELECT *, ((2 * h + h1) * d - h * d1) / (h + h1) AS e0, ((2 * h0 + hb) * d0 - h0 * db) / (h0 + hb) AS e1 FROM n),
m AS (SELECT *, CASE WHEN h0 IS NULL THEN CASE WHEN h1 IS NULL THEN d WHEN sign(e0) <> sign(d) THEN 0 WHEN sign(d) <> sign(d1) AND abs(e0) > 3 * abs(d) THEN 3 * d ELSE e0 END
WHEN h IS NULL THEN CASE WHEN hb IS NULL THEN d0 WHEN sign(e1) <> sign(d0) THEN 0 WHEN sign(d0) <> sign(db) AND abs(e1) > 3 * abs(d0) THEN 3 * d0 ELSE e1 END
WHEN d0 * d <= 0 THEN 0 ELSE 3 * (h + h0) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) END AS m FROM e),
q AS (SELECT x, y, z, v, h, m, lead(m) OVER w AS m1, lead(v) OVER w AS v1, lead(h) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY x, y ORDER BY z)),
t AS (SELECT *, (level - z) / h AS t FROM q, (SELECT CAST(unnest({LEVELS}) AS DOUBLE) AS level) WHERE h IS NOT NULL AND level >= z AND (level < z + h OR (last AND level <= z + h)))
SELECT x, y, level, round((2 * t * t * t - 3 * t * t + 1) * v + (t * t * t - 2 * t * t + t) * h * m + (3 * t * t - 2 * t * t * t) * v1 + (t * t * t - t * t) * h * m1 + 3.3e-7, 5) AS value FROM t""")
def monotone_cubic_levels(spark, sf):
    """Columns on fixed levels by monotone piecewise cubics."""
    return S.pchip(D.grid(spark, sf), ["x", "y"], "z", "u", LEVELS).select("x", "y", "level", F.round(F.col("value") + 3.3e-7, 5).alias("value"))


@query("""WITH s AS (SELECT user_id, event_id, value AS s, event_id % 3 = 0 AS sampled FROM events WHERE value > 0), n AS (SELECT *, avg(CASE WHEN NOT sampled THEN s END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS normal FROM s),
g AS (SELECT user_id, avg(CASE WHEN NOT sampled THEN s END) AS normal_step, coalesce(avg(CASE WHEN sampled AND normal IS NOT NULL THEN greatest(s - normal, 0) END), 0) AS sample_extra FROM n GROUP BY 1)
SELECT user_id, round(normal_step, 6) AS normal_step, round(sample_extra, 6) AS sample_extra, round(normal_step + sample_extra / 7, 6) AS average_step FROM g""")
def two_phase_estimate(spark, sf):
    """Times of plain and of sampled steps."""
    e = S.two_phase_step(D.read(spark, sf, "events"), "user_id", "event_id", "value", F.col("event_id") % 3 == 0, 7)
    return e.select("user_id", *(F.round(c, 6).alias(c) for c in ("normal_step", "sample_extra", "average_step")))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value / 100 AS t0, CAST(floor(event_id / (SELECT max(event_id) + 1.0 FROM events) * 20) AS BIGINT) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, b, sum(t0) OVER (PARTITION BY user_id ORDER BY event_id) / 10 AS t FROM e),
r(user_id, n, event_id, told, t, b) AS (SELECT user_id, n, event_id, true, t, b FROM s WHERE n = 1 UNION ALL
SELECT s.user_id, s.n, s.event_id, s.b <> r.b OR s.t - r.t >= 0.15, CASE WHEN s.b <> r.b OR s.t - r.t >= 0.15 THEN s.t ELSE r.t END, CASE WHEN s.b <> r.b OR s.t - r.t >= 0.15 THEN s.b ELSE r.b END FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, event_id FROM r WHERE told""")
def emitted_progress(spark, sf):
    """Progress rows that are told: a new bucket, or 0.15 s after the last one."""
    e = D.read(spark, sf, "events")
    total = e.agg((F.max("event_id") + 1.0).alias("total"))
    e = e.join(F.broadcast(total))
    return S.emitted(e, "user_id", "event_id", F.col("value") / 100, F.floor(F.col("event_id") / F.col("total") * 20), unit=10)
