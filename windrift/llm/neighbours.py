"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table of the index cuts `hashes` random Gaussian projections of every vector into slots of one
width; a bucket is a row of slots. A query asks, in each table, for the buckets around its own in the
order of their estimated success: a neighbour at distance r differs from the query by N(0, r^2) in each
projection, so a perturbed bucket holds it with a product of normal masses. It goes on until the masses
of the visited buckets reach what makes `recall` over all tables. Candidates of all tables are merged
and ranked by their exact distance.

r is fitted: the distance that 9 of 10 of `sample` vectors need for their k nearest among all rows.
A query whose k-th found distance is larger is planned again at that distance, so the estimate holds
for it too; one that found fewer than k, or would have to probe more than `most_probes` buckets a
table, is compared with every row in blocks. The number of hashes follows from the number of rows and
the sample's distances, so that buckets stay small.

The index's rows lie in the order of (table, bucket) in blocks of `block` rows: a hot bucket spreads
over many blocks, and a block that many queries ask is compared in chunks of them. A block reports k
rows for each query at most.

Vectors that are null, zero or hold null or non-finite components take no part. Vectors of different
lengths are no neighbours. Of equal vectors only those of the k + 1 smallest ids can be among
anyone's k nearest; the rest are set aside. Rows equal in id and vector count once, rows of one id and
other vectors each; a query never finds a row of its own id. Ties go to the smaller id, null ids
last; a null id is no query. Without queries or rows there are no results. Of the table only vec_id
and embedding are looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, in_order, partitions_of, record
from windrift.llm.whitening import by_length, sound
from windrift.llm.words import mix


@dataclass(frozen=True)
class Search:
    k: int = 10
    tables: int = 10
    slot: float = 2.5  # width of a slot, in fitted radii
    recall: float = 0.95
    bucket: int = 4  # rows that two vectors at the median distance should share a bucket with
    sample: int = 128
    block: int = 4096
    askers: int = 1024
    most_probes: int = 8192
    seed: int = 12


@dataclass(frozen=True)
class Index:
    """What every task needs to know of the index."""

    hashes: int
    radius: float
    slot: float


_erf = np.vectorize(math.erf, otypes=[float])


def normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


def collision(distance: float, slot: float) -> float:
    """How probable it is that two vectors at a distance share a slot."""
    if distance == 0:
        return 1.0
    c = slot / distance
    return float(2 * normal(np.array(c)) - 1 - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2)))


def directions(how: Search, index: Index, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projections [tables, width, hashes], shifts [tables, hashes], odd multipliers [hashes]) of vectors of a length."""
    rng = np.random.default_rng([how.seed, width])
    return rng.standard_normal((how.tables, width, index.hashes)), rng.random((how.tables, index.hashes)), rng.integers(0, 2**63, index.hashes, np.uint64) * np.uint64(2) + np.uint64(1)


def named(sums: np.ndarray, table: int, width: int) -> np.ndarray:
    """Bucket names from the sums of slots times multipliers."""
    return mix(sums ^ mix(np.full(1, table * 65537 + width + 1, np.uint64))).view(np.int64)


def slots(places: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(places), -(2.0**62), 2.0**62).astype(np.int64)


def buckets(x: np.ndarray, how: Search, index: Index) -> np.ndarray:
    """[tables, rows] names of the buckets of the vectors."""
    a, shift, odd = directions(how, index, x.shape[1])
    return np.stack([named((slots(x @ a[t] / index.slot + shift[t]).view(np.uint64) * odd).sum(1, dtype=np.uint64), t, x.shape[1]) for t in range(how.tables)])


def probes(x: np.ndarray, radius: np.ndarray, how: Search, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, bucket) in the order of estimated success, table by table, and which queries need more than `most_probes`.

    The best products of K independent masses have best products as their beginnings, so keeping the
    `most` best after each hash gives the best buckets in full, without a search from bucket to bucket.
    """
    n, width = x.shape
    a, shift, odd = directions(how, index, width)
    wanted = 1 - (1 - how.recall) ** (1 / how.tables)
    reach = int(math.ceil(4 * float(radius.max(initial=0.0)) / index.slot)) + 1
    out_q, out_b = [], []
    beyond = np.full(n, reach > 64)
    if reach > 64:
        return np.empty(0, np.int64), np.empty(0, np.int64), beyond
    steps = np.arange(-reach, reach + 1)
    most = min(512, how.most_probes)
    for t in range(how.tables):
        place = x @ a[t] / index.slot + shift[t]
        own = slots(place)
        # Masses of the slots around the query's own: [rows, hashes, slots], likeliest first.
        edge = (own[:, :, None] + np.r_[steps, reach + 1] - place[:, :, None]) * (index.slot / np.maximum(radius, 1e-300))[:, None, None]
        mass = np.diff(normal(edge), axis=2)
        order = np.argsort(-mass, axis=2, kind="stable")
        mass = np.take_along_axis(mass, order, 2)
        useful = max(1, int((mass > 1e-6).any(axis=(0, 1)).sum()))
        mass, near = mass[:, :, :useful], own[:, :, None] + steps[order[:, :, :useful]]
        rows = np.flatnonzero(~beyond)
        keep = most
        while len(rows):
            chance, sums = np.ones((len(rows), 1)), np.zeros((len(rows), 1), np.uint64)
            for k in range(index.hashes):
                chance = (chance[:, :, None] * mass[rows, k][:, None, :]).reshape(len(rows), -1)
                sums = (sums[:, :, None] + (near[rows, k].view(np.uint64) * odd[k])[:, None, :]).reshape(len(rows), -1)
                if chance.shape[1] > keep:
                    best = np.argpartition(-chance, keep - 1, axis=1)[:, :keep]
                    chance, sums = np.take_along_axis(chance, best, 1), np.take_along_axis(sums, best, 1)
            best = np.argsort(-chance, axis=1, kind="stable")
            chance, sums = np.take_along_axis(chance, best, 1), np.take_along_axis(sums, best, 1)
            total = np.cumsum(chance, axis=1)
            met = total[:, -1] >= wanted
            count = np.minimum((total < wanted).sum(1) + 1, total.shape[1])
            for i in np.flatnonzero(met):
                out_q.append(np.full(count[i], rows[i]))
                out_b.append(named(sums[i, : count[i]], t, width))
            rows = rows[~met]
            if len(rows) and keep >= how.most_probes:
                beyond[rows] = True
                break
            keep = min(4 * keep, how.most_probes)
    q, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (out_q, out_b))
    fine = ~beyond[q]
    return q[fine], b[fine], beyond


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(1))


def fit(scratch: Scratch, rows: DataFrame, how: Search) -> Index | None:
    """The index of rows (rid, embedding), from `sample` vectors and their distances to all rows."""
    few = rows.orderBy(F.xxhash64("embedding"), "rid").limit(how.sample).select("rid", "embedding").collect()
    if not few:
        return None
    widths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r["embedding"]) for r in few}:
        own = [r for r in few if len(r["embedding"]) == d]
        widths[d] = np.array([r["rid"] for r in own]), np.array([r["embedding"] for r in own], np.float64)
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("distance", T.DoubleType())])
    wanted = arrow_schema(schema)

    def nearest(batches):
        best: dict[int, np.ndarray] = {}
        for b in batches:
            rid = b.column("rid").to_numpy()
            for d, at, x in by_length(b):
                if d in widths:
                    for i, (own, v) in enumerate(zip(*widths[d], strict=True)):
                        new = np.where(rid[at] == own, np.inf, distances(x, v))
                        best[d, i] = np.sort(np.r_[best.get((d, i), np.empty(0)), new])[: how.k]
        for (d, i), v in best.items():
            v = v[np.isfinite(v)]
            yield record(wanted, rid=np.full(len(v), widths[d][0][i]), distance=v)

    # Each task reports k distances for each of the sample.
    rank = F.row_number().over(Window.partitionBy("rid").orderBy("distance"))
    reach = rows.select("rid", "embedding").mapInArrow(nearest, schema).withColumn("rank", rank).where(F.col("rank") <= how.k).groupBy("rid").agg(F.max("distance").alias("d")).collect()
    pairs = np.concatenate([np.zeros(0), *(distances(np.repeat(v, len(v), 0), np.tile(v, (len(v), 1)))[~np.eye(len(v), dtype=bool).ravel()] for _, v in widths.values())])
    pairs = pairs[np.isfinite(pairs) & (pairs > 0)]
    typical = float(np.median(pairs)) if len(pairs) else 1.0
    radius = float(np.quantile([r["d"] for r in reach], 0.9)) if reach else 0.0
    if not radius > 0 or not math.isfinite(radius):
        radius = typical
    count, hashes = rows.count(), 0
    share = min(collision(typical, how.slot * radius), 0.95)
    while count * share**hashes > how.bucket:
        hashes += 1
    return Index(hashes, radius, how.slot * radius)


def search(scratch: Scratch, vectors: DataFrame, is_query: Column, how: Search = Search()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of vectors (vec_id, embedding) that is_query holds for."""
    id_type = vectors.schema["vec_id"].dataType
    fine = F.coalesce(sound() & F.exists("embedding", lambda x: x != 0), F.lit(False))
    some = vectors.select("vec_id", "embedding").where(fine)
    queries = scratch.save(some.where(F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()).distinct().withColumn("q", F.monotonically_increasing_id()))
    least = F.row_number().over(Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last()))
    rows = scratch.save(some.distinct().withColumn("least", least).where(F.col("least") <= how.k + 1).select("vec_id", "embedding", F.monotonically_increasing_id().alias("rid")))
    index = fit(scratch, rows, how)
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    if index is None:
        return scratch.spark.createDataFrame([], out)

    # ------------------------------------------------ the index: a place for each row in each table
    key_schema = T.StructType([T.StructField("turn", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("rid", T.LongType())])
    key_arrow = arrow_schema(key_schema)

    def keyed(batches):
        for b in batches:
            rid = b.column("rid").to_numpy()
            for _, at, x in by_length(b):
                for t, bucket in enumerate(buckets(x, how, index)):
                    yield record(key_arrow, turn=np.full(len(at), t, np.int32), bucket=bucket, rid=rid[at])

    placed, _ = in_order(scratch, rows.select("rid", "embedding").mapInArrow(keyed, key_schema), ["turn", "bucket", "rid"], [])
    placed = scratch.save(placed.select("turn", "bucket", "rid", F.floor(F.col("at") / how.block).alias("block")))
    where = placed.groupBy("bucket").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    last = placed.where("turn = 0").agg(F.max("block")).first()[0]

    # ------------------------------------------------ what queries ask of blocks
    ask_schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("bucket", T.LongType())])
    ask_arrow = arrow_schema(ask_schema)

    def probing(batches):
        for b in batches:
            q, radius = b.column("q").to_numpy(), b.column("radius").to_numpy()
            for _, at, x in by_length(b):
                for i in range(0, len(at), 32):
                    own = at[i : i + 32]
                    who, bucket, beyond = probes(x[i : i + 32], radius[own], how, index)
                    yield record(ask_arrow, q=q[own][who], bucket=bucket)
                    yield record(ask_arrow, q=q[own][beyond], bucket=pa.nulls(int(beyond.sum()), pa.int64()))

    result = T.StructType([T.StructField("q", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    result_arrow = arrow_schema(result)

    def compare(mine: pa.Table, asked: pa.Table) -> pa.Table:
        """The k nearest rows of a block for each query that asks it, among the buckets that it asks for."""
        if not mine.num_rows or not asked.num_rows:
            return result_arrow.empty_table()
        mine, asked = mine.combine_chunks().sort_by("bucket"), asked.combine_chunks()
        bucket, rid = mine.column("bucket").to_numpy(), mine.column("rid").to_numpy()
        ids, id_of = mine.column("vec_id").combine_chunks(), asked.column("vec_id").combine_chunks()
        lists = asked.column("buckets").combine_chunks()
        every = np.asarray(lists.is_null())
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        who = np.repeat(np.arange(len(sizes)), sizes)
        low, high = np.searchsorted(bucket, flat, "left"), np.searchsorted(bucket, flat, "right")
        who = np.r_[who, np.flatnonzero(every)]
        low, high = np.r_[low, np.zeros(every.sum(), np.int64)], np.r_[high, np.full(every.sum(), len(bucket))]
        order = np.argsort(who, kind="stable")
        who, low, count = who[order], low[order], (high - low)[order]
        x_of = {d: (at, x) for d, at, x in by_length(pa.RecordBatch.from_arrays([mine.column("embedding").combine_chunks()], ["embedding"]))}
        seat = np.full((2, len(bucket)), -1, np.int64)
        for n, (d, (at, _)) in enumerate(x_of.items()):
            seat[0, at], seat[1, at] = n, np.arange(len(at))
        # Ids compare by their rank among the block's, nulls last; a row of the query's own id is out.
        rank = np.empty(len(ids), np.int64)
        rank[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        same = pa.compute.index_in(id_of, value_set=ids.dictionary_encode().dictionary if ids.null_count < len(ids) else ids.slice(0, 0)).fill_null(-1).to_numpy(zero_copy_only=False)
        code = ids.dictionary_encode().indices.fill_null(-2).to_numpy(zero_copy_only=False)
        out = []
        numbers = list(x_of)
        for d, own, v in by_length(pa.RecordBatch.from_arrays([asked.column("embedding").combine_chunks()], ["embedding"])):
            if d not in x_of:
                continue
            n, x = numbers.index(d), x_of[d][1]
            for at, q in zip(own, v, strict=True):
                a, z = np.searchsorted(who, [at, at + 1])
                total = int(count[a:z].sum())
                if not total:
                    continue
                c = np.repeat(low[a:z] - np.r_[0, np.cumsum(count[a:z])[:-1]], count[a:z]) + np.arange(total)
                c = c[(seat[0, c] == n) & (code[c] != same[at])]
                c = c[np.unique(rid[c], return_index=True)[1]]  # a block may hold a row in several tables
                score = distances(x[seat[1, c]], q)
                if len(c) > how.k:
                    c_ = score <= np.partition(score, how.k - 1)[how.k - 1]
                    c, score = c[c_], score[c_]
                best = np.lexsort((rank[c], score))[: how.k]
                out.append((np.full(len(best), at), c[best], score[best]))
        if not out:
            return result_arrow.empty_table()
        at, c, score = (np.concatenate(v) for v in zip(*out, strict=True))
        return pa.table({"q": asked.column("q").to_numpy()[at], "rid": rid[c], "vec_id": ids.take(pa.array(c)), "score": score}, schema=result_arrow)

    def nearest(asking: DataFrame) -> DataFrame:
        """Candidates of the queries (q, radius): those of planned buckets; a null radius asks for every row."""
        planned = asking.where("radius IS NOT NULL").join(queries, "q").select("q", "embedding", "radius").repartition(partitions_of(scratch.spark), "q").mapInArrow(probing, ask_schema)
        asked = scratch.save(planned)
        every = asked.where("bucket IS NULL").select("q").union(asking.where("radius IS NULL").select("q"))
        some = asked.join(where, "bucket").select("q", "bucket", F.explode(F.sequence("first", "last")).alias("block")).groupBy("block", "q").agg(F.collect_set("bucket").alias("buckets"))
        every = every.distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("block"), "q", F.lit(None).cast("array<bigint>").alias("buckets"))
        dealt = scratch.save(some.unionByName(every))
        loads = scratch.save(dealt.groupBy("block").agg(F.ceil(F.count("*") / how.askers).cast("int").alias("chunks")))
        asks = dealt.join(loads, "block").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int")).join(queries, "q").select("block", "chunk", "q", "vec_id", "embedding", "buckets")
        held = placed.join(loads, "block").join(rows, "rid").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "bucket", "rid", "vec_id", "embedding")
        found = held.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInArrow(compare, result)
        return found

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy("score", F.col("vec_id").asc_nulls_last(), "rid")
        once = found.groupBy("q", "rid").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k)

    found = scratch.save(best(nearest(queries.select("q", F.lit(index.radius).alias("radius")))))
    reached = queries.select("q").join(found.groupBy("q").agg(F.count("*").alias("n"), F.max("score").alias("radius")), "q", "left")
    short = F.coalesce("n", F.lit(0)) < how.k
    again = scratch.save(reached.where(short | (F.col("radius") > index.radius)).select("q", F.when(~short, F.col("radius")).alias("radius")))
    if not again.isEmpty():
        found = best(found.drop("rank").unionByName(nearest(again)))
    return found.join(queries.select("q", F.col("vec_id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
