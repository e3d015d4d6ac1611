"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class first, so a group of copies of any size is one vector with
a weight. Each pass gives every class the signs of its projections on random directions as a sort
key; classes are put in order of (label, key), numbered, and dealt in blocks of `block` rows. Each
block is compared with itself and the block before it; of the verified pairs a block reports no more
than join its vectors into its local components, so what is reported grows with the rows and not
with the pairs. Pairs of all passes are united to components.

Then each component is compared in full, in squares of blocks, to count every vector's links: in a
dense group a window holds a part of a vector's neighbours only, but any chain of them leads to
the component, so the counts are exact within it. What the passes can miss is a pair that no chain
of other pairs connects.

Two vectors at the threshold angle share a sign with probability p = 1 - angle / pi. In a label
of n vectors the first b = log2(n / block) signs decide who is near, so a pass finds a pair with
probability p^b, and the number of passes is what `recall` needs at the largest label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, components, in_order, record
from windrift.llm.repeats import with_groups


@dataclass(frozen=True)
class Near:
    threshold: float = 0.93
    block: int = 1024
    signs: int = 63
    recall: float = 0.999
    seed: int = 5


def passes(near: Near, largest_label: int) -> int:
    same = 1 - math.acos(near.threshold) / math.pi
    bits = max(1.0, math.log2(max(2, largest_label) / near.block))
    return max(4, math.ceil(math.log(1 - near.recall) / math.log(1 - same**bits)))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of 0..n-1 that the pairs (a, b) join to a smaller one."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, which rows have one). Rows may differ in length: each length stands alone, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    fine = np.isfinite(out).all(axis=1)
    out[~fine] = 0
    top = np.abs(out).max(axis=1, initial=0)
    fine &= top > 0
    out[fine] /= top[fine, None]  # keeps squares from over- and underflow
    norm = np.sqrt((out * out).sum(axis=1))
    out[fine] /= norm[fine, None]
    return out, fine


def near_duplicates(scratch: Scratch, vectors: DataFrame, near: Near = Near()) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal, and their
    cosine is at least the threshold. Null, zero and unsound vectors link with nothing. Copies
    count as links of each other, rows that repeat a vec_id too: every row is a vector of its own.
    """
    base = vectors.select("vec_id", "embedding", "label")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    lonely = lambda rows: rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = scratch.save(base.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    if largest is None:
        return lonely(base)
    turns = passes(near, largest)

    key_schema = T.StructType([T.StructField("turn", T.IntegerType()), classes.schema["label"], T.StructField("width", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("rep", T.LongType())])
    key_arrow = arrow_schema(key_schema)

    def keyed(batches):
        directions: dict[int, np.ndarray] = {}
        bits = (1 << np.arange(near.signs - 1, -1, -1, dtype=np.int64)).astype(np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, _ = matrix(b.column("embedding"))
            d = x.shape[1]
            if d not in directions:
                directions[d] = np.random.default_rng([near.seed, d]).standard_normal((turns, d, near.signs))
            width = b.column("embedding").value_lengths().cast(pa.int32())
            for turn in range(turns):
                key = ((x @ directions[d][turn]) > 0).astype(np.int64) @ bits
                yield record(key_arrow, turn=np.full(len(x), turn, np.int32), label=b.column("label"), width=width, key=key, rep=b.column("rep"))

    thin = classes.select("rep", "label", "embedding").mapInArrow(keyed, key_schema)
    placed, _ = in_order(scratch, thin, ["turn", "label", "width", "key", "rep"], [])
    # Each row goes to its own block, to be compared with all of it, and to the next, to be compared with its own rows only.
    own = F.floor(F.col("at") / near.block)
    dealt = placed.select("turn", "rep", F.explode(F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.struct((own + 1).alias("block"), F.lit(False).alias("own")))).alias("d"))
    dealt = dealt.select("turn", "rep", "d.block", "d.own").join(classes.select("rep", "label", "embedding"), "rep")
    link_schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    link_arrow = arrow_schema(link_schema)

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, _ = matrix(t.column("embedding"))
        width = t.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        own_ = t.column("own").to_numpy(zero_copy_only=False)
        turn, rep = (t.column(c).to_numpy(zero_copy_only=False) for c in ("turn", "rep"))
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        i = np.flatnonzero(own_)
        same = (x[i] @ x.T >= near.threshold) & (label[i][:, None] == label) & (width[i][:, None] == width) & (turn[i][:, None] == turn)
        p, q = np.nonzero(same)
        node, root = forest(i[p], q, len(x))
        return pa.table({"a": rep[node], "b": rep[root]}, schema=link_arrow)

    links = scratch.save(dealt.groupBy("block").applyInArrow(compare, link_schema).distinct())
    linked = scratch.save(components(scratch, links))

    # Every component against itself: its members in order, cut in blocks; each two blocks of a component meet once.
    placed, _ = in_order(scratch, linked, ["component", "node"], [])
    placed = scratch.save(placed)
    ends = placed.groupBy("component").agg(F.min("at").alias("start"), F.count("*").alias("members"))
    own = F.floor((F.col("at") - F.col("start")) / near.block)
    last = F.floor((F.col("members") - 1) / near.block)
    # Components of one block share squares with others, so that small ones make no task of their own.
    square = F.when(last == 0, F.struct(F.lit(-1).cast("long").alias("home"), F.floor(F.col("start") / near.block).alias("i"), F.lit(0).cast("long").alias("j")))
    member = placed.join(ends, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    square = square.otherwise(F.struct(F.col("component").alias("home"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    squares = member.select(F.col("node").alias("rep"), "component", "own", square.alias("square")).join(classes.select("rep", "embedding", "size"), "rep")
    count_schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("n", T.LongType())])
    count_arrow = arrow_schema(count_schema)

    def count(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, _ = matrix(t.column("embedding"))
        width = t.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        rep, home, own_, size = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "own", "size"))
        square_ = t.column("square").combine_chunks()
        i, j = square_.field("i")[0].as_py(), square_.field("j")[0].as_py()
        crossing = square_.field("home")[0].as_py() != -1 and i != j
        order = np.argsort(home, kind="stable")  # rows of one component meet; components lie in runs
        x, width, rep, home, own_, size = (v[order] for v in (x, width, rep, home, own_, size))
        n = np.zeros(len(rep), np.int64)
        for a in range(0, len(rep), near.block):
            mine = slice(a, min(a + near.block, len(rep)))
            low, high = np.searchsorted(home, home[mine.start]), np.searchsorted(home, home[mine.stop - 1], "right")
            met = (x[mine] @ x[low:high].T >= near.threshold) & (home[mine][:, None] == home[low:high]) & (width[mine][:, None] == width[low:high])
            if crossing:
                met &= own_[mine][:, None] != own_[low:high]
            else:
                met &= rep[mine][:, None] != rep[low:high]
            n[mine] = met @ size[low:high]
        return pa.table({"rep": rep, "n": n}, schema=count_arrow)

    per_class = squares.groupBy("square").applyInArrow(count, count_schema).groupBy("rep").agg(F.sum("n").alias("n"))
    found = classes.join(per_class, "rep", "left").join(linked.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    found = scratch.save(found.select("label", "embedding", "component", "least", "size", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    found = with_groups(scratch, found, ["component"], {"component_id": F.min("least")}, least=1).select("label", "embedding", "size", "n_links", "component_id")
    # Copies of one vector may be a third of all rows: classes of more than a 10,000th of them go to every task.
    found = scratch.save(found)
    many = F.col("size") > (found.agg(F.sum("size")).first()[0] or 0) / 10_000
    rows, key = base.where(sound), ["label", "embedding"]
    joined = rows.join(F.broadcast(found.where(many)), key).unionByName(rows.join(F.broadcast(found.where(many).select(*key)), key, "left_anti").join(found.where(~many), key))
    joined = joined.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id").eqNullSafe(F.col("component_id")), F.lit(True)).alias("kept"))
    return joined.unionByName(lonely(base.where(~sound)))
