"""Running totals, ranks and exact quantiles over whole tables in order, without a window over all rows.

Rows are dealt by ranges of their order and marked with the range they are in; the marked rows are a
checkpoint, so that the marks hold. Windows then run within ranges, and only one row a range (there
are as many as shuffle partitions) is summed up over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrift.operators.graph import checkpoint_folder


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with `part`: ranges of `order`, numbered in their order; equal keys share a range."""
    checkpoint_folder(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).checkpoint()


def carried(parts: DataFrame, **sums: str) -> DataFrame:
    """(part, before_<name>): the sums over all earlier ranges. parts has a row for each range."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{k}") for k, c in sums.items()))


def numbered(df: DataFrame, order: list) -> DataFrame:
    """df with `at`: how many rows come before each one in the order, which must tell rows apart."""
    rows = in_ranges(df, *order)
    before = carried(rows.groupBy("part").agg(F.count("*").alias("n")), n="n")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(F.broadcast(before), "part").withColumn("at", F.col("own") + F.col("before_n")).drop("part", "own", "before_n")


def running_total(df: DataFrame, order: list, value: str) -> DataFrame:
    """df with `upto`: the sum of value over all rows up to and with each one, and `whole`, that over all. Ties of order share it."""
    rows = in_ranges(df, *order)
    parts = rows.groupBy("part").agg(F.sum(value).alias("s"))
    before = carried(parts, s="s").join(F.broadcast(parts.agg(F.sum("s").alias("whole"))))
    own = F.sum(value).over(Window.partitionBy("part").orderBy(*order))
    return rows.withColumn("own", own).join(F.broadcast(before), "part").withColumn("upto", F.col("own") + F.col("before_s")).drop("part", "own", "before_s")


def quantiles(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """(groups, q): exact quantiles of each group, linear between ranks, in the order of shares; null values left out.

    Every row learns its rank; no task holds a group.
    """
    rows = in_ranges(df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("x")), *groups, "x")
    parts = rows.groupBy("part", *groups).agg(F.count("*").alias("n"))
    # Ranges of a group follow each other; a group has at most a row for each range.
    w = Window.partitionBy(*groups).orderBy("part")
    spans = parts.select("part", *groups, F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*groups)).alias("total"))
    rank = F.row_number().over(Window.partitionBy("part", *groups).orderBy("x")) - 1
    placed = rows.withColumn("nth", rank).join(spans, ["part", *groups]).withColumn("rank", F.col("nth") + F.col("before"))
    at = F.array(*(F.lit(float(s)) * (F.col("total") - 1) for s in shares))
    wanted = placed.withColumn("at", F.explode(F.transform(at, lambda p, i: F.struct(i.alias("i"), p.alias("p"))))).where(F.col("rank").between(F.floor("at.p"), F.ceil("at.p")))
    share = F.when(F.col("rank") == F.floor("at.p"), 1 - (F.col("at.p") - F.floor("at.p"))).otherwise(F.col("at.p") - F.floor("at.p"))
    each = wanted.groupBy(*groups, "at.i").agg(F.sum(F.col("x") * share).alias("v"))
    return each.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("q"))
