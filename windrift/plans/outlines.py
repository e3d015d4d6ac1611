"""Queries of polygons laid over each other."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrift.operators import geometry, graph, overlay
from windrift.operators import joins as J
from windrift.plans import adapters as D
from windrift.plans.joining import OVERLAPS
from windrift.plans.registry import query


def ring(*points: tuple) -> Column:
    side = lambda v, name: (v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(name)
    return F.array(*(F.struct(side(x, "x"), side(y, "y")) for x, y in points))


def rectangle(x0, y0, x1, y1) -> Column:
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


def measured(parts, *keys: str):
    """Each part's rings, points of its outline and area; parts by their lowest corner."""
    return parts.select(*keys, "part", F.size("rings").alias("rings"), F.size(F.col("rings")[0]).alias("points"), F.round(geometry.footprint_area(F.col("rings")), 6).alias("area"))


@query(f"""WITH RECURSIVE {OVERLAPS}, e AS (SELECT a, b FROM o UNION SELECT b, a FROM o UNION SELECT vec_id, vec_id FROM boxes),
reach(node, seen) AS (SELECT vec_id, vec_id FROM boxes UNION SELECT r.node, e.b FROM reach r JOIN e ON r.seen = e.a),
m AS (SELECT component, boxes.* FROM (SELECT node, min(seen) AS component FROM reach GROUP BY 1) JOIN boxes ON node = vec_id),
x AS (SELECT component, x, lead(x) OVER (PARTITION BY component ORDER BY x) AS xn FROM (SELECT component, x0 AS x FROM m UNION SELECT component, x1 FROM m)),
y AS (SELECT component, y, lead(y) OVER (PARTITION BY component ORDER BY y) AS yn FROM (SELECT component, y0 AS y FROM m UNION SELECT component, y1 FROM m)),
c AS (SELECT DISTINCT x.component, x, xn, y, yn FROM x JOIN y USING (component) JOIN m ON m.component = x.component AND x0 <= x AND xn <= x1 AND y0 <= y AND yn <= y1)
SELECT component, CAST(1 AS BIGINT) AS parts, round(sum((xn - x) * (yn - y)), 9) AS area, max(height) AS height FROM c JOIN (SELECT component, max(height) AS height FROM m GROUP BY 1) USING (component) GROUP BY 1""")
def dissolved_outlines(spark, sf):
    """Overlapping footprints as one building: its outline, by its area, and the largest height."""
    b = D.boxes(spark, sf)
    comp = graph.components(J.linked(b, 0.02), b.select(F.col("vec_id").alias("node")))
    members = comp.join(b, comp.node == b.vec_id).withColumn("rings", F.array(rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))
    # Near ones follow each other: squares of 8 x 8 smaller squares.
    square = [F.floor(F.col(c) / side).alias(f"{c}_{i}") for i, side in enumerate((0.16, 0.02)) for c in ("x0", "y0")]
    union = overlay.dissolved(members.withColumn("place", F.struct(*square, "vec_id")), "component", "place", "rings")
    whole = union.groupBy("component").agg(F.count("*").alias("parts"), F.round(F.sum(geometry.footprint_area(F.col("rings"))), 9).alias("area"))
    return whole.join(members.groupBy("component").agg(F.max("height").alias("height")), "component")


@query("""WITH p AS (SELECT p_partkey, p_size + 2.0 AS w, p_retailprice / 100 + 2 AS d FROM part)
SELECT p_partkey, CAST(0 AS INTEGER) AS part, CAST(2 AS INTEGER) AS rings, CAST(5 AS INTEGER) AS points, round(CAST(w * d - (w - 1) * (d - 1) AS DOUBLE), 6) AS area FROM p UNION ALL SELECT p_partkey, 1, 1, 5, 1.0 FROM p""")
def framed_footprints(spark, sf):
    """Bars that only touch become one frame around a court; what stands apart stays a part of its own."""
    p = D.read(spark, sf, "part").select("p_partkey", (F.col("p_size") + 2.0).alias("w"), (F.col("p_retailprice") / 100 + 2).alias("d"))
    w, d = F.col("w"), F.col("d")
    bars = [rectangle(0, 0, w, 0.5), rectangle(0, d - 0.5, w, d), rectangle(0, 0.5, 0.5, d - 0.5), rectangle(w - 0.5, 0.5, w, d - 0.5), rectangle(w + 1, 0, w + 2, 1)]
    each = p.select("p_partkey", F.posexplode(F.array(*(F.array(b) for b in bars))).alias("bar", "rings"))
    return measured(overlay.dissolved(each, "p_partkey", "bar", "rings", crowd=64), "p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, CAST(p_size AS DOUBLE) AS w, p_retailprice / 100 AS d FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS part, CAST(1 AS INTEGER) AS rings, CAST(CASE k WHEN 0 THEN 4 WHEN 3 THEN CASE i WHEN 0 THEN 9 ELSE 5 END ELSE 5 END AS INTEGER) AS points,
round(CASE k WHEN 0 THEN w * d / 4 WHEN 1 THEN w * d WHEN 2 THEN CASE i WHEN 0 THEN w * d ELSE w * d / 8 END ELSE CASE i WHEN 0 THEN w * d * 7 / 8 ELSE w * d / 8 END END, 6) AS area FROM p, range(2) r(i) WHERE k <> 1 OR i = 0""")
def crossed_footprints(spark, sf):
    """bow ties, spikes, holes outside their outline and holes across it, each as simple polygons."""
    k, w, d = F.col("p_partkey") % 4, F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    tie = F.array(ring((0, 0), (w, d), (w, 0), (0, d), (0, 0)))
    spike = F.array(ring((0, 0), (w, 0), (w + 5, 0), (w, 0), (w, d), (0, d), (0, 0)))
    apart = F.array(rectangle(0, 0, w, d), rectangle(w + 1, 0, w + 1 + w / 2, d / 4))
    across = F.array(rectangle(0, 0, w, d), rectangle(w / 2, d / 4, w * 1.5, d / 2))
    crossed = D.read(spark, sf, "part").select("p_partkey", F.when(k == 0, tie).when(k == 1, spike).when(k == 2, apart).otherwise(across).alias("rings"))
    return measured(overlay.resolved(crossed, ["p_partkey"], "rings"), "p_partkey")


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 + 1 AS n, p_size + 1.0 AS h FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS part, CAST(CASE WHEN i = 0 AND p_partkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS rings, CAST(5 AS INTEGER) AS points, round(CAST(h - 0.5 - CASE WHEN i = 0 AND p_partkey % 2 = 0 THEN 0.1 ELSE 0 END AS DOUBLE), 6) AS area FROM p, range(5) r(i) WHERE i < n""")
def multipart_clips(spark, sf):
    """Combs cut above their backs: every tooth is a part, holes stay."""
    at, n, h = F.col("p_partkey") * 20.0, F.col("p_partkey") % 5 + 1, F.col("p_size") + 1.0
    tooth = lambda i: F.array(*(F.struct((at + 2 * i + x).alias("x"), y.alias("y")) for x, y in ((1, F.lit(1.0)), (1, h + 1), (0, h + 1), (0, F.lit(1.0)))))
    # From the right end of the back, tooth by tooth to the left.
    teeth = F.flatten(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), tooth))
    comb = F.concat(ring((at, 0.0), (at + 2 * n - 1, 0.0)), teeth, ring((at, 0.0)))
    hole = rectangle(at + 0.25, 1.6, at + 0.75, 1.8)
    combs = D.read(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.array(comb, hole)).otherwise(F.array(comb)).alias("rings"))
    return measured(overlay.clipped_parts(combs, ["p_partkey"], "rings", [(-1e9, 1.5), (1e9, 1.5), (1e9, 99.0), (-1e9, 99.0)]), "p_partkey")
