"""Mixing sources to target weights, by blocks of words.

Each source's documents, in order of doc_id, form one stream of words, cut into blocks of `block`
words. The output is `shards` shards of equally many slots. Each shard in turn draws how many of its
slots each source fills, from a multinomial whose probabilities are what the sources are still owed;
so what one shard drew too little or too much of a source the next ones tend to make up, and a source
ends off its target by what one shard's draw is off only. A source never gets more slots than `limit`
times its blocks: what a draw has beyond that is drawn again among the others. Slot j of a source maps
to a block through a pseudorandom permutation of the block numbers, a new one each time the source is
used up, so a source taken t times gives each block floor(t) or ceil(t) times. Slots and the
documents' shares of blocks meet by a join on the block number.

Sources are a table like the rest, of any length. A multinomial over groups of sources, then one
within each group, is one over all sources: the driver draws for groups of `few_sources`, tasks within
them, and the driver sees sums of groups only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, in_order, partitions_of, record, slices
from windrift.llm.tallies import expand
from windrift.llm.words import Words


@dataclass(frozen=True)
class Mix:
    """weights: by rank of the source's name, repeating. limit: how often a source may be used at most."""

    weights: tuple[float, ...] = (5, 2, 1)
    limit: int = 3
    block: int = 32
    shards: int = 40
    seed: int = 17
    chunk: int = 1 << 16  # slots that are mapped to blocks at a time
    few_sources: int = 100_000  # up to so many, the table of sources is sent to every task; so many draw together


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each key: a four-round Feistel network, walked until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2)))).astype(np.int64) + 1) // 2
    half = half.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            f = (right + k + np.uint64(turn * 0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def drawn_counts(owed: np.ndarray, most: np.ndarray, per_shard: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """[shards, sources]: how many of per_shard[i] slots each source fills in shard i; no source more than `most` over all.

    The sum of per_shard must not exceed that of most.
    """
    owed, room = owed.astype(float), most.astype(np.int64)
    out = np.zeros((len(per_shard), len(owed)), np.int64)
    for i, wanted in enumerate(per_shard):
        while wanted:
            chance = np.where(room > 0, np.maximum(owed, 0), 0)
            if not chance.sum() > 0:  # all are paid: the rest goes where there is room
                chance = room.astype(float)
            drawn = np.minimum(rng.multinomial(wanted, chance / chance.sum()), room)
            out[i] += drawn
            owed -= drawn
            room -= drawn
            wanted -= int(drawn.sum())
    return out


class Plan:
    """The rows in stream order, the sources' plan, and how often the mix takes each block."""

    def __init__(self, scratch: Scratch, docs: DataFrame, mix: Mix = Mix(), carry: tuple[str, ...] = ()):
        self.mix = mix
        base = docs.select(*dict.fromkeys(["doc_id", "source", "text", *carry])).withColumn("h", F.xxhash64("text"))
        kept = [base.schema[c] for c in dict.fromkeys(["doc_id", "source", "h", *carry])]
        schema = T.StructType([*kept, T.StructField("size", T.LongType())])
        wanted = arrow_schema(schema)

        def sized(batches):
            for b in slices(batches):
                yield record(wanted, **{f.name: b.column(f.name) for f in kept}, size=Words(b.column("text"), hashed=False).counts)

        # Null sorts first here; ranks below put it last. Rows equal in all of this are interchangeable.
        self.rows, overall = in_order(scratch, base.mapInArrow(sized, schema), ["source", "doc_id", "h"], ["size"])
        total = overall[None]["size"] if overall else 0
        found = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before_size").alias("first_word"))
        ranked, known = in_order(scratch, found.withColumn("last", F.col("source").isNull()), ["last", "source"], [])
        self.few = not known or known[None]["n"] <= mix.few_sources
        weights = F.array(*(F.lit(float(w)) for w in mix.weights))
        weighed = scratch.save(ranked.select("source", "source_size", "first_word", F.col("at").alias("source_no"), F.element_at(weights, (F.col("at") % len(mix.weights) + 1).cast("int")).alias("weight")))
        self.sources = scratch.save(self.planned(weighed, total))
        self.slots = self.drawn()

    def planned(self, weighed: DataFrame, total: int) -> DataFrame:
        """Each source's target: its share by weight, no more than limit times its size, the excess shared anew.

        Sources stop at the limit when a unit of weight is worth more than most = limit * size / weight,
        and the unit only grows as they do, so each round is one sum on either side of it.
        """
        b, limit = self.mix.block, self.mix.limit
        most = F.col("source_size") * limit / F.col("weight")
        unit = 0.0
        while True:
            sums = weighed.agg(F.sum(F.when(most < unit, F.col("source_size") * limit).otherwise(0)).alias("closed"), F.sum(F.when(most < unit, 0.0).otherwise(F.col("weight"))).alias("open")).first()
            new = (total - sums["closed"]) / sums["open"] if sums["open"] else unit
            if new <= unit:
                break
            unit = new
        target = F.when(most < unit, (F.col("source_size") * limit).cast("double")).otherwise(F.col("weight") * unit)
        blocks = F.ceil(F.col("source_size") / b)
        # What the target is in blocks, and the most blocks that the mix may take.
        owed = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)
        return weighed.withColumn("target", target).withColumn("blocks", blocks.cast("long")).withColumn("owed", owed)

    def drawn(self) -> DataFrame:
        """One row for each block that the mix takes: (source_no, block, out_shard)."""
        mix = self.mix
        chunks = T.StructType([T.StructField(c, T.LongType()) for c in ("source_no", "blocks", "seed", "out_shard", "first", "n")])
        out = T.StructType([T.StructField("source_no", T.LongType()), T.StructField("block", T.LongType()), T.StructField("out_shard", T.IntegerType())])
        chunks_arrow, out_arrow = arrow_schema(chunks), arrow_schema(out)
        spark = self.sources.sparkSession
        grouped = self.sources.withColumn("team", F.floor(F.col("source_no") / max(1, mix.few_sources)))
        teams = grouped.groupBy("team").agg(F.sum("owed").alias("owed"), F.sum(F.col("blocks") * mix.limit).alias("most")).orderBy("team").collect()
        owed, most = np.array([t["owed"] for t in teams]), np.array([t["most"] for t in teams], np.int64)
        total = min(int(np.rint(owed.sum())), int(most.sum()))
        share = total // mix.shards + (np.arange(mix.shards) < total % mix.shards)
        counts = drawn_counts(owed, most, share, np.random.default_rng([mix.seed, 0]))
        drawn = spark.createDataFrame([(t["team"], counts[:, i].tolist()) for i, t in enumerate(teams)], "team bigint, share array<bigint>")

        def deal(t: pa.Table) -> pa.Table:
            """The slots of a team's sources, shard by shard, in chunks of slots."""
            t = t.sort_by("source_no")
            no, blocks, seed = (t.column(c).to_numpy() for c in ("source_no", "blocks", "seed"))
            rng = np.random.default_rng([mix.seed, 1, t.column("team")[0].as_py()])
            own = drawn_counts(t.column("owed").to_numpy(), blocks * mix.limit, np.array(t.column("share")[0].as_py(), np.int64), rng)
            shard, source = np.nonzero(own)
            n = own[shard, source]
            start = (np.cumsum(own, axis=0) - own)[shard, source]
            pieces = -(-n // mix.chunk)
            nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            shard, source, n, start = (np.repeat(v, pieces) for v in (shard, source, n, start))
            return pa.table({"source_no": no[source], "blocks": blocks[source], "seed": seed[source], "out_shard": shard, "first": start + nth * mix.chunk, "n": np.minimum(n - nth * mix.chunk, mix.chunk)}, schema=chunks_arrow)

        def place(batches):
            for b in batches:
                no, blocks, seed, shard, first, n = (b.column(c).to_numpy(zero_copy_only=False) for c in chunks.names)
                for k in range(0, len(n), 16):
                    some = slice(k, k + 16)
                    j = expand(first[some], n[some])
                    at = np.repeat(np.arange(len(n))[some], n[some])
                    key = (np.uint64(mix.seed) + seed[at].view(np.uint64) + (j // blocks[at]).astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
                    yield record(out_arrow, source_no=no[at], block=permuted(j % blocks[at], blocks[at], key), out_shard=shard[at].astype(np.int32))

        named = grouped.select("team", "source_no", "blocks", "owed", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("seed"))
        dealt = named.join(drawn, "team").groupBy("team").applyInArrow(deal, chunks)
        return dealt.repartition(partitions_of(spark), "source_no", "first").mapInArrow(place, out)

    def placed(self) -> DataFrame:
        """The rows with their source's plan. The table of sources is sent along only where it is short."""
        plan = self.sources.withColumnRenamed("source", "name")
        return self.rows.join(F.broadcast(plan) if self.few else plan, F.col("source").eqNullSafe(F.col("name")))

    def pieces(self) -> DataFrame:
        """Each row's share of each block: (source_no, block, at, words, word), at counting rows, word within the row."""
        size, before = F.col("size"), F.col("before_size") - F.col("first_word")
        b = self.mix.block
        cut = self.placed().where(size > 0).withColumn("block", F.explode(F.sequence(F.floor(before / b), F.floor((before + size - 1) / b))))
        start = F.greatest(before, F.col("block") * b)
        stop = F.least(before + size, (F.col("block") + 1) * b)
        carried = ["uid"] if "uid" in self.rows.columns else []
        return cut.select("source_no", "block", "at", *carried, (stop - start).alias("words"), (start - before).alias("word"))

    def uses(self) -> DataFrame:
        """How often the mix takes each block. Spark takes its size for that of the few sources it is drawn from: it says that it is to be sorted."""
        return self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses")).hint("merge")


def mix_documents(scratch: Scratch, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the row that the mix takes, repeats counted) and shards: how many of these go to each output shard.

    Null text has size 0; null is a source of its own, the last. Repeated rows are rows of their own.
    A row of which nothing is taken has an empty list of shards.
    """
    plan = Plan(scratch, docs, mix)
    slots = plan.slots.groupBy("source_no", "block", "out_shard").agg(F.count("*").alias("uses")).hint("merge")
    each = plan.pieces().join(slots, ["source_no", "block"]).groupBy("at", "out_shard").agg(F.sum(F.col("words") * F.col("uses")).alias("words"))
    # No more entries than shards.
    taken = each.groupBy("at").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("out_shard", "words"))).alias("shards"))
    rows = plan.placed().select("doc_id", "size", "source_size", "target", "at")
    # Both sides have a row for each document: a sorted join at any size.
    return rows.join(taken.hint("merge"), "at", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<struct<out_shard:int,words:bigint>>")).alias("shards"))


def mixed_texts(scratch: Scratch, docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself as rows of docs: each row's taken words as its text, once for each time around.

    A row whose blocks are all taken once gives one row; blocks taken again make up a second and a
    third row of the same doc_id, in the order of their words. Rows of which nothing is taken go.
    n_chars, if docs has it, is the new text's length; other columns stay (none may be named uid, h or shares).
    """
    schema = docs.schema
    others = [c for c in docs.columns if c != "text"]
    base = docs.withColumn("uid", F.xxhash64(*docs.columns))
    plan = Plan(scratch, base, mix, carry=("uid",))
    shares = plan.pieces().join(plan.uses(), ["source_no", "block"]).groupBy("at", "uid").agg(F.sort_array(F.collect_list(F.struct("word", "words", "uses"))).alias("shares"))
    wanted = arrow_schema(schema)

    def run(batches):
        for b in slices(batches, limit=1_000_000):
            index, texts = [], []
            for i, (text, some) in enumerate(zip(b.column("text").to_pylist(), b.column("shares").to_pylist(), strict=True)):
                words = text.encode().split()
                for turn in range(1, max(s["uses"] for s in some) + 1):
                    kept = [w for s in some if s["uses"] >= turn for w in words[s["word"] : s["word"] + s["words"]]]
                    index.append(i)
                    texts.append(b" ".join(kept).decode())
            at = pa.array(index, pa.int64())
            columns = {c: b.column(c).take(at) for c in others} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts]).cast(wanted.field("n_chars").type)
            yield record(wanted, **columns)

    # Rows are told apart by their numbers there, not here: of equal rows one is enough. Mostly there are none.
    if not plan.rows.groupBy("uid").count().where("count > 1").isEmpty():
        base = base.dropDuplicates(["uid"])
    return base.join(shares.select("uid", "shares"), "uid").select(*docs.columns, "shares").mapInArrow(run, schema)
