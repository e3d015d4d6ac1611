"""Connected components of links, by rounds of joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder of spark.checkpoint.dir; to a temporary one only where it is unset on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="windrift-"))


def spread_over(df: DataFrame) -> int:
    """How many tasks to deal rows to that cost much each: four a core, at least as many as a shuffle has."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores. Rows that Python works on long may come from a file of few megabytes, which is one or two tasks."""
    return df.repartition(spread_over(df))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) reach, for every node.

    Each round takes the smallest label near, then that label's own label, so long chains settle in
    few rounds. Rounds are cut by checkpoints in the shared folder of spark.checkpoint.dir.
    """
    checkpoint_folder(links.sparkSession)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("component")).checkpoint()
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        least = F.least("component", "near", "far")
        new = labels.join(near, "node", "left").join(hop, "component", "left").select("node", least.alias("component"), (least < F.col("component")).alias("moved")).checkpoint()
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
