"""What the corpus operators share: scratch tables, ordered running totals, linked components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step handles at a time; it bounds a worker's memory, not the work.
SLICE_BYTES = 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where it is unset on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(_root, "own"):
        _root.own = tempfile.mkdtemp(prefix="windrift-")
    return _root.own


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """Written tables of one query in the shared folder. They cut lineage and survive lost executors.

    A table that a later one replaces is dropped at once; the rest go when the process ends, since
    the returned DataFrame still reads them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{_root(spark)}/windrift-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            p, fs = _path(self.spark, t._scratch_path)
            fs.delete(p, True)

    def close(self) -> None:
        try:
            p, fs = _path(self.spark, self.at)
            fs.delete(p, True)
        except Exception:  # the session is gone; nothing can be deleted through it
            pass


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about `limit` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_of(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in ((n, columns[n]) for n in schema.names)], schema=schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- ordered running totals


def in_order(scratch: Scratch, df: DataFrame, keys: list[str], totals: list[str], group: str | None = None) -> tuple[DataFrame, dict]:
    """Give each row its place and running totals in the order of `keys`, over the whole table.

    Returns the rows with `at` (how many rows come before) and, for each total, `before_<name>`
    (its sum over the rows before); with `group`, a column that leads `keys`, both start anew in
    each group. The second value holds each group's overall counts (key None without group).

    Rows are dealt by ranges of `keys`, so a group of any size spreads over many tasks. Each task
    counts its own rows; the driver only adds up one row for each task and group that meet, of
    which there are at most tasks + groups.
    """
    spark = scratch.spark
    base = df.schema
    schema = T.StructType([*base.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), *(T.StructField(f"before_{t}", T.LongType()) for t in totals)])
    wanted = arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, sums = object(), [0] * (1 + len(totals))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if group:
                codes = b.column(group).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                head = b.column(group)[0].as_py()
            else:
                starts, head = np.zeros(1, np.int64), None
            if head != last:
                sums = [0] * len(sums)
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            out = []
            for i, v in enumerate([np.ones(n, np.int64), *(b.column(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in totals)]):
                before = np.cumsum(v) - v
                own = before - before[starts][run_of]
                own[run_of == 0] += sums[i]
                out.append(own)
                sums[i] = int(own[-1] + v[-1])
            last = b.column(group)[n - 1].as_py() if group else None
            yield record(wanted, **{f.name: b.column(f.name) for f in base.fields}, part=np.full(n, part, np.int32), at=out[0], **{f"before_{t}": o for t, o in zip(totals, out[1:], strict=True)})

    rows = scratch.save(df.repartitionByRange(partitions_of(spark), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema))
    by = ["part", group] if group else ["part"]
    ends = [F.max(F.col("at") + 1).alias("n"), *(F.max(F.col(f"before_{t}") + F.col(t)).alias(t) for t in totals)]
    met = rows.groupBy(*by).agg(*ends).collect()
    overall: dict = {}
    shift = []
    # Tasks hold rising ranges, so the order of their numbers is the order of the keys.
    for r in sorted(met, key=lambda r: r["part"]):
        g = r[group] if group else None
        so_far = overall.setdefault(g, [0] * (1 + len(totals)))
        shift.append((r["part"], g, *so_far))
        overall[g] = [a + r[c] for a, c in zip(so_far, ["n", *totals], strict=True)]
    shifts = spark.createDataFrame(
        shift,
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("g", base[group].dataType if group else T.StringType()), T.StructField("s_at", T.LongType()), *(T.StructField(f"s_{t}", T.LongType()) for t in totals)]),
    )
    on = F.col("r.part") == F.col("s.part")
    if group:
        on &= F.col(f"r.{group}").eqNullSafe(F.col("s.g"))
    placed = rows.alias("r").join(F.broadcast(shifts).alias("s"), on).select(
        *(F.col(f"r.{c}") for c in base.names), (F.col("at") + F.col("s_at")).alias("at"), *((F.col(f"before_{t}") + F.col(f"s_{t}")).alias(f"before_{t}") for t in totals)
    )
    return placed, {g: dict(zip(["n", *totals], v, strict=True)) for g, v in overall.items()}


# ---------------------------------------------------------------- linked components


def components(scratch: Scratch, links: DataFrame, spread: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """(node, component) for the undirected links (a, b): the smallest node that can be reached.

    Each round every node takes the smallest label among itself and its neighbours, then the label
    of that label (pointer jumping), so a chain of n links settles in about log n rounds. Only
    joins and pre-aggregated minima: no list of a hub's neighbours is ever built. Every round is a
    written table. Nodes are those that have a link.
    """
    links = links.where("a <> b")
    both = scratch.save(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"))
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = scratch.save(
            labels.join(near, "node").join(hop, "component", "left").select("node", F.least("component", "near", "far").alias("component"), (F.least("component", "near", "far") < F.col("component")).alias("moved"))
        )
        moved = new.where("moved").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            scratch.drop(both)
            return labels.select("node", "component")
