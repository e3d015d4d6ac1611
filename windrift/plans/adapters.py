"""The wind and city tables that the queries run on, made from the star-schema tables.

Each has a DataFrame and, for the oracle, the same definition as a DuckDB common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A 20 x 10 x n grid of wind vectors: one event a cell."""
    i, value = F.col("event_id"), F.col("value")
    return read(spark, sf, "events").select(
        F.expr("event_id div 200").alias("z"), F.expr("event_id div 20").alias("y0"), (i % 20).alias("x"), value.alias("u"), (value * ((i % 7) - 3) / 3).alias("v"), (((i % 11) - 5) / 5).alias("w")
    ).select("z", (F.col("y0") % 10).alias("y"), "x", "u", "v", "w")


def windrose(spark: SparkSession, sf: str) -> DataFrame:
    """Joint counts of direction and speed bin as shares of all events, each with the first event of its cell."""
    e = read(spark, sf, "events").select("event_id", (22.5 * (F.col("user_id") % 16)).alias("angle"), F.least(F.floor(F.col("value") / 50), F.lit(6)).cast("bigint").alias("bin"))
    cells = e.groupBy("angle", "bin").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    total = cells.agg(F.sum("n").alias("total"))
    return cells.join(F.broadcast(total)).select("angle", "bin", (F.col("n") / F.col("total")).alias("p"), "first")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("z")).agg(F.avg("p_retailprice").alias("U"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k, name: F.col("embedding")[k].cast("double").alias(name)
    return read(spark, sf, "embeddings").select("vec_id", at(0, "px"), at(1, "py"), at(2, "val"))


def boxes(spark: SparkSession, sf: str, half: float = 0.01) -> DataFrame:
    p = points(spark, sf)
    return p.select("vec_id", (F.col("px") - half).alias("x0"), (F.col("px") + half).alias("x1"), (F.col("py") - half).alias("y0"), (F.col("py") + half).alias("y1"), F.col("val").alias("height"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 6).alias("patch"), (F.col("l_discount") - 0.05).alias("un"), F.col("l_quantity").alias("T"), F.col("l_extendedprice").alias("area"))


def buildings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("length"), F.col("p_retailprice").alias("weight"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") + 1).alias("t"), "value", "event_type")


GRID = "grid AS (SELECT event_id // 200 AS z, (event_id // 20) % 10 AS y, event_id % 20 AS x, value AS u, value * ((event_id % 7) - 3) / 3.0 AS v, ((event_id % 11) - 5) / 5.0 AS w FROM events)"
WINDROSE = "windrose AS (SELECT angle, bin, n / sum(n) OVER () AS p FROM (SELECT 22.5 * (user_id % 16) AS angle, CAST(least(floor(value / 50), 6) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2))"
PROFILE = "profile AS (SELECT CAST(p_size AS DOUBLE) AS z, avg(p_retailprice) AS \"U\" FROM part GROUP BY 1)"
POINTS = "points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py, CAST(embedding[3] AS DOUBLE) AS val FROM embeddings)"
BOXES = f"{POINTS}, boxes AS (SELECT vec_id, px - 0.01 AS x0, px + 0.01 AS x1, py - 0.01 AS y0, py + 0.01 AS y1, val AS height FROM points)"
SAMPLES = "samples AS (SELECT l_orderkey, l_linenumber, l_linenumber % 6 AS patch, l_discount - 0.05 AS un, l_quantity AS \"T\", l_extendedprice AS area FROM lineitem)"
BUILDINGS = "buildings AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS length, p_retailprice AS weight FROM part)"
STEPS = "steps AS (SELECT event_id, user_id, event_id + 1 AS t, value, event_type FROM events)"
