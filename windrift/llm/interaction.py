"""Filter interaction audit: what each filter removes, in every order of the filters, from one histogram.

Native expressions give each document a mask of the filters that it fails; equal texts are grouped by
their SHA-256 and supply the smallest doc_id of each text. The table is then summed up to at most 32
cells a part (a count for each mask, and how many of them are labelled), and what any order of the
filters does follows from the cells: all orders are enumerated over them, never over documents.

Null text is empty, null part the empty string. A null doc_id is neither smaller nor larger than any
other and has no labels. Rows that repeat a doc_id are documents of their own, none smaller than the
other. A doc_id labelled more than once counts as good (toxic) if any of its labels says so. An empty
table has no parts and gives no rows. Other columns of either table are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.llm.common import Scratch
from windrift.llm.repeats import with_groups

SPACES = "\t\n\x0b\f\r"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that a text fails or passes on its own, as conditions of failure by letter."""
    n, distinct = F.size(words(text)), F.size(F.array_distinct(words(text)))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(scratch: Scratch, docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask; bits are the text filters in order, then repeated texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = text_filters(text)
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(own.values())), F.lit(0))
    rows = scratch.save(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")))
    again = with_groups(scratch, rows, ["digest"], {"least_id": F.min("doc_id")}).where("least_id < doc_id")
    # A repeated text moves from its cell to the one with the last bit too.
    steps = F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + (1 << len(own))).alias("mask"), F.lit(1).alias("n")))
    moves = again.select("doc_id", "part", F.explode(steps).alias("move")).select("doc_id", "part", "move.mask", "move.n")
    every = rows.select("doc_id", "part", "mask", F.lit(1).alias("n")).union(moves)
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    counted = every.groupBy("part", "mask").agg(F.sum("n").alias("n"))
    labelled = every.join(said, "doc_id").groupBy("part", "mask").agg(F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return counted.join(labelled, ["part", "mask"], "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def audit(histogram: DataFrame, letters: str) -> DataFrame:
    """What each step of each order of the filters does to each part, from the cells of its masks."""
    bits = {c: 1 << i for i, c in enumerate(letters)}
    orders = ["".join(p) for p in permutations(letters)]
    sum_of = lambda column: F.map_from_entries(F.collect_list(F.struct("mask", column)))  # noqa: E731 - at most 32 entries a part
    parts = histogram.groupBy("part").agg(*(sum_of(c).alias(c) for c in ("n", "good", "toxic")))
    plan = [(o, s + 1, bits[c], sum(bits[b] for b in o[:s])) for o in orders for s, c in enumerate(o)]
    # The orders are sent as one text: literals for each of 600 steps would make a plan too long to compile.
    text = ";".join(",".join(map(str, p)) for p in plan)
    rows = parts.withColumn("plan", F.explode(F.split(F.lit(text), ";"))).withColumn("plan", F.split("plan", ",")).select("part", "n", "good", "toxic", F.element_at("plan", 1).alias("filter_order"), *(F.element_at("plan", i).cast("int").alias(c) for i, c in ((2, "step"), (3, "bit"), (4, "before"))))
    bit, before = F.col("bit"), F.col("before")

    def total(column, chosen, weight=lambda m, v: v):
        return F.aggregate(F.map_entries(column), F.lit(0).cast("long"), lambda so_far, e: so_far + F.when(chosen(e["key"]), weight(e["key"], e["value"])).otherwise(F.lit(0).cast("long")))

    fails = lambda m: m.bitwiseAND(bit) != 0
    met = lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & met(m)
    # Of all orders, a mask of k filters is removed by each of them in a k-th.
    share = lambda m, v: F.floor(v * F.lit(len(orders)) / F.bit_count(m)).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & met(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & ~met(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", fails, share).alias("shapley"),
    )


def filter_interactions(scratch: Scratch, docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step."""
    return audit(cells(scratch, docs, labels, part), "ABCDE")
