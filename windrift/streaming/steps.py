"""Step-driven statistics: which steps count, and the same statistics over a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accumulates(t: Column, total: Column, window: int, stride: int) -> Column:
    """A step of the trailing window that falls on its stride."""
    start = total - window + 1
    return (t >= start) & ((t - start) % stride == 0)


def remaining(t: Column, total: Column, window: int, stride: int) -> Column:
    """Samples still to come after step t."""
    start = total - window + 1
    last = F.floor((total - start) / stride)
    done = F.when(t < start, F.lit(-1)).otherwise(F.floor((t - start) / stride))
    return (last - done).cast("bigint")


def online_statistics(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and population variance of each key so far; for update or complete output."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def welford(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, n, mean, m2) after each batch, kept as explicit state; for append output.

    A step of a key counts once, in whatever order steps come: Spark's state of the steps seen leaves
    out those that come again. A null value counts as no step. Blocks of a key's rows are merged by
    their count, mean and sum of squares, so that their order and their cut do not matter.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for b in batches:
            x = b[value].dropna().to_numpy(float)
            if len(x):
                d, both = x.mean() - mean, n + len(x)
                m2 += ((x - x.mean()) ** 2).sum() + d * d * n * len(x) / both
                n, mean = both, mean + d * len(x) / both
        state.update((n, float(mean), float(m2)))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean if n else None], "m2": [m2]})

    kind = stream.schema[key].dataType.simpleString()
    once = stream.dropDuplicates([key, order])
    return once.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n bigint, mean double, m2 double", "n bigint, mean double, m2 double", "append", "NoTimeout")


def probe_samples(stream: DataFrame, probes: DataFrame, cell: list[str], step: str, total: int, last: int) -> DataFrame:
    """Rows of the probes' cells in the last steps: a join of the stream with the (short) table of probes."""
    return stream.join(F.broadcast(probes), cell).where(F.col(step) > total - last)


def each_batch(stream: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None]):
    """One read of each batch, given to several sinks; they must take the same batch twice without harm."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def snapshots(path: str, step: str, every: int) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the rows of every n-th step, in a folder for each batch (written anew if it comes again)."""
    return lambda batch, number: batch.where((F.col(step) % every == 0) & (F.col(step) > 0)).write.mode("overwrite").parquet(f"{path}/batch={number}")


def windowed(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window with a watermark: an addition of this engine. Naive times are taken as UTC."""
    t = F.col(time).cast("timestamp")
    return events.withColumn(time, t).withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Counts by session: an addition of this engine."""
    return events.withColumn(time, F.col(time).cast("timestamp")).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
