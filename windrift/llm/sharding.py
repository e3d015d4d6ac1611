"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups (equal texts) stand in the order of a hash of their text. The smallest capacity at which a
greedy fill needs no more than the wanted shards is found by binary search, and the shards are cut
there. The driver never sees all groups: it holds a bounded index of cut places, knows which gaps
between them may hide further ones, searches with both the pessimistic and the optimistic reading
of each gap, and asks Spark to open only the gaps on which the two still disagree.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, in_order, record


class Cuts:
    """Known places where a shard may end (running sizes at group ends), and the gaps not yet opened."""

    def __init__(self, total: int):
        self.known: dict[int, int] = {0: 0}
        self.closed: set[int] = set()  # gaps, by their lower end, that hide no further place
        self.total = total
        self.places: list[int] = [0]

    def add(self, places: list[tuple[int, int]]) -> None:
        self.known |= dict(places)
        self.places = sorted(self.known)

    def step(self, start: int, capacity: int) -> tuple[int, int]:
        """The furthest end of a shard that begins at start: the one known to be there, and the most it can be."""
        i = bisect_right(self.places, start + capacity) - 1
        low = self.places[i]
        return low, low if low in self.closed or low == self.total else min(start + capacity, self.places[i + 1] - 1)

    def path(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            new = self.step(at, capacity)[hopeful]
            out.append(new)
            if new >= self.total or new == at:
                break
            at = new
        return out

    def least(self, shards: int, low: int, hopeful: bool) -> int:
        """The smallest capacity, at least low, that fills no more than `shards` shards."""
        high = max(self.total, low)
        while low < high:
            middle = (low + high) // 2
            if self.path(middle, shards, hopeful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int, index_rows: int = 20_000) -> tuple[int, list[tuple[int, int]]]:
    """(capacity, cuts): the smallest largest-shard size, and for each shard the running size and row count at its end.

    ends: one row for each group with `upto` and `rows_upto`, the running totals after it.
    """
    cuts = Cuts(total)

    found_in = T.StructType([T.StructField(c, T.LongType()) for c in ("gap", "slot", "upto", "rows_upto")])
    wanted = arrow_schema(found_in)

    def opened(gaps: list[tuple[int, int]]) -> None:
        """Up to index_rows places inside the gaps, the last in each of equal slots."""
        lows, highs = np.array(gaps, np.int64).T
        widths = np.maximum(1, -(-(highs - lows) // max(2, index_rows // len(gaps))))

        def run(batches):
            for b in batches:
                upto = b.column(0).to_numpy(zero_copy_only=False)
                gap = np.searchsorted(lows, upto, "left") - 1
                here = (gap >= 0) & (upto <= highs[gap])
                g = gap[here]
                yield record(wanted, gap=lows[g], slot=(upto[here] - 1 - lows[g]) // widths[g], upto=upto[here], rows_upto=b.column(1).to_numpy(zero_copy_only=False)[here])

        found = ends.select("upto", "rows_upto").mapInArrow(run, found_in).groupBy("gap", "slot").agg(F.max("upto").alias("upto"), F.max("rows_upto").alias("rows_upto"), F.count("*").alias("n")).collect()
        cuts.add([(r["upto"], r["rows_upto"]) for r in found])
        for r in found:  # a slot with a single group hides nothing below it
            if r["n"] == 1:
                cuts.closed.add(cuts.places[bisect_left(cuts.places, r["upto"]) - 1])

    opened([(0, total)])
    while True:
        high = cuts.least(shards, largest, False)
        low = cuts.least(shards, largest, True)
        if low >= high:
            break
        first, last = cuts.path(low, shards, False), cuts.path(high, shards, True)
        gaps = {}
        for a, b in zip(first, [*last, *[total] * len(first)], strict=False):
            i, j = bisect_right(cuts.places, a) - 1, bisect_right(cuts.places, b) - 1
            gaps |= {cuts.places[k]: cuts.places[k + 1] for k in range(i, min(j + 1, len(cuts.places) - 1)) if cuts.places[k] not in cuts.closed}
        if not gaps:
            break
        opened(sorted(gaps.items()))
    capacity = cuts.least(shards, largest, False)

    # The slack that is left is spread: each shard aims at an equal share of the rest, within the
    # capacity and not below what the shards after it can hold.
    need = [total]
    for _ in range(shards):
        need.append(cuts.places[bisect_left(cuts.places, max(0, need[-1] - capacity))])
    at, out = 0, []
    for k in range(shards):
        floor, top = max(at, need[shards - 1 - k]), cuts.step(at, capacity)[0]
        aim = at + (total - at) / (shards - k)
        i = bisect_left(cuts.places, aim)
        near = min((p for p in cuts.places[max(0, i - 1) : i + 1]), key=lambda p: abs(p - aim), default=top)
        at = min(max(near, floor), top)
        out.append((at, cuts.known[at]))
    return capacity, out


def shard_documents(scratch: Scratch, docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row: sizes near equal, equal texts together.

    Size is the UTF-8 bytes of the text plus 16. Null texts count as one group and have no
    checksum. Shards that the largest group leaves without rows stay empty; an empty table has none.
    """
    thin = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("h"))
    rows, overall = in_order(scratch, thin, ["h", "doc_id"], ["size"])
    if not overall:
        return thin.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ends = scratch.save(rows.groupBy("h").agg(F.max(F.col("before_size") + F.col("size")).alias("upto"), F.max(F.col("at") + 1).alias("rows_upto"), F.sum("size").alias("size")))
    total = overall[None]["size"]
    _, cuts = minimax_cuts(ends, total, ends.agg(F.max("size")).first()[0], shards)
    scratch.drop(ends)
    sizes, counts = [0, *(c[0] for c in cuts[:-1])], [0, *(c[1] for c in cuts[:-1])]
    shard = F.lit(0)
    first = F.lit(0).cast("long")
    for k in range(1, shards):
        if sizes[k] < total:
            shard = F.when(F.col("before_size") >= sizes[k], F.lit(k)).otherwise(shard)
            first = F.when(F.col("before_size") >= sizes[k], F.lit(counts[k]).cast("long")).otherwise(first)
    return rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("at") - first).alias("slot"))
