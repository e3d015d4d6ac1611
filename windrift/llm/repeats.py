"""What tells rows apart, groups of equal texts, and keys packed for the tasks that count them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema

PACKED = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("keys", "uids", "docs", "places"))])


def uid() -> Column:
    """What tells texts apart: the row's id and its text. Rows equal in both share their results."""
    return F.xxhash64("doc_id", "text")


def same_text(text: str = "text") -> list[Column]:
    """What equal texts share and others do not: two hashes and the length."""
    return [F.xxhash64(text).alias("h"), F.crc32(F.col(text).cast("binary")).alias("c"), F.octet_length(text).alias("bytes")]


def with_groups(scratch: Scratch, rows: DataFrame, on: list[str], values: dict[str, Column], least: int = 2) -> DataFrame:
    """The rows of groups of `least` and more, each with its group's values and `members`, how many there are.

    A group may hold a third of all rows: groups of more than a 10,000th of the rows, fewer than
    10,000 of them, are sent to every task, so their rows stay where they are; the others are joined.
    """
    groups = scratch.save(rows.groupBy(*on).agg(F.count("*").alias("members"), *(v.alias(k) for k, v in values.items())).where(F.col("members") >= least))
    total = groups.agg(F.sum("members")).first()[0] or 0
    large = groups.where(F.col("members") > total / 10_000)
    small = groups.where(F.col("members") <= total / 10_000)
    there = rows.join(F.broadcast(large), on)
    return there.unionByName(rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(small, on))


def pack(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, uids: np.ndarray, parts: int) -> pa.RecordBatch:
    part = (keys % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    keys, docs, places = keys[order], docs[order], places[order]
    out: dict[str, list] = {"part": [], "keys": [], "uids": [], "docs": [], "places": []}
    for p in range(parts):
        a, b = (int(ends[p - 1]) if p else 0), int(ends[p])
        if a < b:
            some, index = np.unique(docs[a:b], return_inverse=True)
            for c, v in (("part", p), ("keys", keys[a:b].tobytes()), ("uids", uids[some].tobytes()), ("docs", index.astype(np.uint32).tobytes()), ("places", places[a:b].astype(np.uint32).tobytes())):
                out[c].append(v)
    return pa.RecordBatch.from_pydict(out, schema=arrow_schema(PACKED))
