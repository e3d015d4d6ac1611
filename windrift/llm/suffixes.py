"""Substring dedup by sparse suffix arrays.

Of all suffixes of all texts only those are kept that begin at a minimiser: the smallest hash of
`seed` words among the starts in a window of `min_words` words. Every repeated passage of
`min_words` words holds a minimiser, the same at each of its places, so nothing longer is missed.
Suffixes whose first `seed` words occur once cannot match and go first. The rest are dealt by their
seed, so that all suffixes of a seed are in one task, and sorted by content (seed, words after it,
words before it). Each is compared with the neighbours before it, and matches are extended to the
right and left word by word. Only `min_words - seed` words on either side can matter: a longer
passage holds further minimisers whose matches take over from there, and overlapping matches of a
text are united.

Neighbours share most to the right. Where a seed has more suffixes than neighbours are compared, a
match that lies mostly to the left is found by sorting again: for each number of words r to the
right, suffixes with equal r words after and equal min_words - seed - r words before the seed.
Seeds at more than `crowd` places are too many for one task: the windows around them stand for
their matches.

Neighbours are compared by 16 bits a word, which finds every match and now and then one too many. So
each window of `min_words` words within a match is named by 128 bits over all its words and counted
over the corpus: only windows that occur more than once are left, and they alone make the runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, partitions_of, record, slices
from windrift.llm.repeats import same_text, uid, with_groups
from windrift.llm.tallies import ask, ints_of, packed, repeated, unpacked
from windrift.llm.words import Runs, Words, mix, names128


@dataclass(frozen=True)
class Passages:
    min_words: int = 50
    seed: int = 25
    neighbours: int = 4
    crowd: int = 4000  # places of a seed up to which one task compares them


def sliding(x: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + size] for each i at which that fits."""
    width, out = 1, x
    while width * 2 <= size:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(x) - size + 1], out[size - width : len(x) - width + 1])


def minimisers(w: Words, rules: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers at which a minimiser starts, its hash)."""
    if w.n < rules.min_words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    key = Runs(w.hashes).of(np.arange(w.n - rules.seed + 1), rules.seed)
    span = rules.min_words - rules.seed + 1
    least = sliding(key, span, np.minimum)
    least[w.words_left()[: len(least)] < rules.min_words] = 0  # no window of one text starts here
    padded = np.r_[np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]
    at = np.flatnonzero(sliding(padded, span, np.maximum)[: len(key)] == key)
    return at, key[at]


def common_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns two rows share from the first on; 0 marks the end of a text."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def matches(run: np.ndarray, after: np.ndarray, before: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, partner): how far each suffix's matches reach, and a suffix that it matches; partner -1 where none does.

    Rows are sorted by run (the seed), after and before, and hold whole runs.
    """
    n, reach = after.shape
    left, right, partner = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    for d in range(1, min(neighbours, n - 1) + 1):
        j = np.flatnonzero(run[d:] == run[:-d]) + d
        i = j - d
        r, f = common_length(after[i], after[j]), common_length(before[i], before[j])
        good = r + f >= reach
        i, j, r, f = i[good], j[good], r[good], f[good]
        for x, y in ((i, j), (j, i)):
            better = right[x] + left[x] < r + f
            partner[x[better]] = y[better]
            left[x], right[x] = np.maximum(left[x], f), np.maximum(right[x], r)
    long = np.flatnonzero(np.bincount(run)[run] > neighbours + 1)
    if not len(long):
        return left, right, partner
    # Names of the first k words to either side, for each k; a text that ends there has none.
    step = np.uint64(0xA24BAED4963EE407)
    zero = np.zeros(len(long), np.uint64)
    to_right, to_left = [zero], [zero]
    for k in range(reach):
        to_right.append(mix(to_right[-1] * step + after[long, k].astype(np.uint64) + np.uint64(1)))
        to_left.append(mix(to_left[-1] * step + before[long, k].astype(np.uint64) + np.uint64(1)))
    ends_right, ends_left = (np.where((m[long] == 0).any(axis=1), (m[long] == 0).argmax(axis=1), reach) for m in (after, before))
    seeds = mix(run[long].astype(np.uint64))
    for r in range(reach + 1):
        f = reach - r
        fine = np.flatnonzero((ends_right >= r) & (ends_left >= f))
        name = mix(to_right[r][fine] + mix(to_left[f][fine] + np.uint64(f)) * step + seeds[fine])
        order = np.argsort(name, kind="stable")
        same = np.r_[name[order[1:]] == name[order[:-1]], False] if len(order) else np.zeros(0, bool)
        x, y = long[fine[order[:-1][same[:-1]]]], long[fine[order[1:][same[:-1]]]]
        for a, b in ((x, y), (y, x)):
            left[a], right[a] = np.maximum(left[a], f), np.maximum(right[a], r)
            none = partner[a] < 0
            partner[a[none]] = b[none]
    return left, right, partner


def repeated_passages(scratch: Scratch, docs: DataFrame, rules: Passages = Passages()) -> DataFrame:
    """One row for each maximal run of repeated words of a row: doc_id, start_word, end_word, n_words, partner_doc_id.

    A passage counts from `min_words` words on, repeated in another row or the same. The partner is
    a row that holds the run's first `min_words` words. Copies of a whole text give one run over all their words.
    Null, empty and short texts give nothing; neither do texts without a repeat. A null doc_id is a
    row like others; as a partner it shows only where no other row will do.
    """
    spark = scratch.spark
    parts = partitions_of(spark)
    reach = rules.min_words - rules.seed
    base = docs.select("doc_id", "text").withColumn("uid", uid())
    id_type = docs.schema["doc_id"].dataType

    counted = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("h", "c", "bytes", "words"))])
    counted_arrow = arrow_schema(counted)

    def count(batches):
        for b in slices(batches):
            words = Words(b.column("text"), hashed=False).counts
            yield record(counted_arrow, **{c: b.column(c).cast(counted_arrow.field(c).type) for c in ("uid", "doc_id", "h", "c", "bytes")}, words=words)

    thin = scratch.save(base.select("uid", "doc_id", "text", *same_text()).mapInArrow(count, counted).where(F.col("words") >= rules.min_words))
    copies = with_groups(scratch, thin, ["h", "c", "bytes"], {"one": F.min_by("doc_id", "uid"), "two": F.max_by("doc_id", "uid"), "speaker": F.min("uid")})
    copied = scratch.save(copies.select("uid", "doc_id", "words", (F.col("uid") == F.col("speaker")).alias("speaks"), F.when(F.col("uid") == F.col("speaker"), F.col("two")).otherwise(F.col("one")).alias("partner")))

    def seed_keys(b):
        w = Words(b.column("text"))
        at, key = minimisers(w, rules)
        text = w.text_index()[at]
        place = at - w.bounds[text]
        return mix(key), text, place, np.ones(len(at), np.int64), place  # minimisers are small; their names spread

    # Copies of a text are heard once: one of them tells what other texts share with all of them.
    shared = repeated(scratch, base.select("uid", "text"), seed_keys, crowd=rules.crowd)
    chosen = scratch.save(shared.join(copied.where("not speaks").select("uid"), "uid", "left_anti").dropDuplicates(["uid"]))
    texts = base.join(chosen, "uid")

    suffix = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", id_type), T.StructField("place", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("after", T.BinaryType()), T.StructField("before", T.BinaryType())])
    suffix_arrow = arrow_schema(suffix)

    def suffixes(batches):
        for b in slices(batches):
            w = Words(b.column("text"))
            some = [ints_of(v)[ints_of(c, np.uint8) == 0] for v, c in zip(b.column("starts").to_pylist(), b.column("crowded").to_pylist(), strict=True)]
            text = np.repeat(np.arange(b.num_rows), [len(p) for p in some])
            place = np.concatenate(some) if some else np.empty(0, np.int64)
            at = place + w.bounds[text]
            if not len(at):
                continue
            short = (w.hashes % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
            short = np.r_[short, np.zeros(1, np.uint16)]
            right = at[:, None] + rules.seed + np.arange(reach)
            left = at[:, None] - 1 - np.arange(reach)
            after = np.where(right < w.bounds[text + 1][:, None], short[np.minimum(right, w.n)], 0).astype(">u2")
            before = np.where(left >= w.bounds[text][:, None], short[np.maximum(left, 0)], 0).astype(">u2")
            rows = lambda m: pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * reach), len(m), [None, pa.py_buffer(np.ascontiguousarray(m).tobytes())]).cast(pa.binary())
            yield record(suffix_arrow, uid=b.column("uid").take(text), doc_id=b.column("doc_id").take(text), place=place.astype(np.int32), key=Runs(w.hashes).of(at, rules.seed).astype(np.int64), after=rows(after), before=rows(before))

    ordered = texts.select("uid", "doc_id", "text", "starts", "crowded").mapInArrow(suffixes, suffix)
    ordered = ordered.repartition(parts, "key").sortWithinPartitions("key", "after", "before", "uid", "place")

    span = T.StructType([T.StructField("uid", T.LongType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())])
    span_arrow = arrow_schema(span)

    def compare(batches):
        def found(t):
            t = t.combine_chunks()
            n = t.num_rows
            key = t.column("key").to_numpy()
            run = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            wide = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), ">u2").reshape(n, reach)
            left, right, partner = matches(run, wide("after"), wide("before"), rules.neighbours)
            hit = np.flatnonzero(partner >= 0)
            place = t.column("place").to_numpy().astype(np.int64)
            yield record(span_arrow, uid=t.column("uid").take(hit).combine_chunks(), **{"from": (place - left)[hit].astype(np.int32), "to": (place + rules.seed + right)[hit].astype(np.int32)})

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            key = t.column("key").to_numpy()
            # Whole seeds only: the last one may go on in the next batch.
            whole = int(np.searchsorted(key, key[-1], "left"))
            if whole:
                yield from found(t.slice(0, whole))
            held = t.slice(whole)
        if held is not None:
            yield from found(held)

    def around(batches):
        for b in batches:
            some = [ints_of(v)[ints_of(c, np.uint8) > 0] for v, c in zip(b.column("starts").to_pylist(), b.column("crowded").to_pylist(), strict=True)]
            place = np.concatenate(some) if some else np.empty(0, np.int64)
            row = np.repeat(np.arange(len(some)), [len(p) for p in some])
            yield record(span_arrow, uid=b.column("uid").take(row), **{"from": np.maximum(place - reach, 0).astype(np.int32), "to": (place + rules.seed + reach).astype(np.int32)})

    crowds = chosen.where(F.instr(F.hex("crowded"), "01") > 0).mapInArrow(around, span)
    # A text's spans are no more than its minimisers, so a row's list is bounded by its text.
    spans = scratch.save(ordered.mapInArrow(compare, span).unionByName(crowds).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans")))

    # Matches compare words by 16 bits. Every window of a match is now named by 128 bits over all its
    # words; those that occur once only go, and what is left is whole.
    run = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", id_type), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("names", T.BinaryType())])
    run_arrow = arrow_schema(run)

    def windows(b):
        w = Words(b.column("text"))
        near = np.zeros(w.n + 1, np.int64)
        flat = b.column("spans").flatten()
        text = np.repeat(np.arange(b.num_rows), b.column("spans").value_lengths().to_numpy(zero_copy_only=False))
        low, high = (w.bounds[text] + flat.field(c).to_numpy(zero_copy_only=False) for c in ("from", "to"))
        high = np.maximum(np.minimum(high, w.bounds[text + 1]) - rules.min_words + 1, low)
        np.add.at(near, low, 1)
        np.add.at(near, high, -1)
        at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (w.words_left() >= rules.min_words))
        text = w.text_index()[at]
        names = names128(w.hashes, at, rules.min_words)
        ids = np.frombuffer(packed(pa.RecordBatch.from_arrays([b.column("doc_id")], ["doc_id"])), np.uint8)
        return names, np.ones(len(at), np.uint32), (b.column("uid").to_numpy(zero_copy_only=False), ids, text.astype(np.uint32), (at - w.bounds[text]).astype(np.int32), names)

    def runs_of(_, arrays, values):
        uids, ids, text, place, names = arrays
        some = np.flatnonzero(values[:, 0])
        if not len(some):
            return
        t, p, names = text[some].astype(np.int64), place[some].astype(np.int64), names[some]
        cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (p[1:] > p[:-1] + rules.min_words)])
        ends = np.r_[cut[1:], len(t)]
        yield record(run_arrow, uid=uids[t[cut]], doc_id=unpacked(ids).column(0).take(pa.array(t[cut])), start_word=p[cut], end_word=p[ends - 1] + rules.min_words, a=names[cut, 0].view(np.int64), b=names[cut, 1].view(np.int64), names=pa.array([names[a:z].tobytes() for a, z in zip(cut, ends, strict=True)], pa.binary()))

    runs = ask(scratch, base.join(spans, "uid").select("uid", "doc_id", "text", "spans"), windows, runs_of, run, lambda sums: (sums > 1).astype(np.int64), width=2)

    # A partner is a row that holds the run's first window too.
    named = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("doc_id", id_type)])
    named_arrow = arrow_schema(named)

    def every_name(batches):
        for b in batches:
            some = [np.frombuffer(v, np.int64).reshape(-1, 2) for v in b.column("names").to_pylist()]
            if some:
                a, z = np.concatenate(some).T
                yield record(named_arrow, a=a, b=z, doc_id=b.column("doc_id").take(np.repeat(np.arange(len(some)), [len(v) for v in some])))

    holders = scratch.save(runs.select("doc_id", "names").mapInArrow(every_name, named).groupBy("a", "b").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("two"), F.max(F.col("doc_id").isNull()).alias("nameless")))
    told = runs.select("uid", "doc_id", "start_word", "end_word", "a", "b").join(holders.hint("merge"), ["a", "b"]).join(copied.select("uid"), "uid", "left_anti")
    own = lambda c: F.col(c).eqNullSafe(F.col("doc_id"))
    partner = F.when(own("one") & ~(own("two") & F.col("nameless")), F.col("two")).when(~own("one"), F.col("one")).alias("partner")
    whole = copied.select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("words").alias("end_word"), "partner")
    every = told.select("doc_id", "start_word", "end_word", partner).unionByName(whole)
    return every.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("partner").alias("partner_doc_id"))
