"""Substring dedup by recompression.

Texts are sequences of word names. Each round first names maximal runs of one symbol (the symbol
and the run's length), then splits all names into left and right ones by a bit of the name and
round, and names each pair of a left symbol and the right one after it. A name is a hash of what it
stands for, so it is the same in every text, task and run without a dictionary, and equal
substrings get equal symbols in their interior: whether a symbol forms depends only on a few words
around it, its context, which is tracked.

A window of `window` words takes as its anchor one symbol whose context lies inside the window:
a function of the window's words alone, so equal windows have equal anchors. Symbols of the
`level`-th round come first (long ones, then those of smaller hash), then those of lower rounds;
words themselves are the last resort, so no window is without one. Spark finds the anchors that
occur at more than one place of the corpus; only windows with such an anchor can occur again, and
those are verified by two independent hashes of all their words, 128 bits, over the corpus. Words
in a repeated window go.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, record, slices
from windrift.llm.repeats import same_text, uid, with_groups
from windrift.llm.tallies import expand, ints_of, repeated
from windrift.llm.words import Words, covered, mix, names128


@dataclass(frozen=True)
class Repeats:
    window: int = 35
    level: int = 6
    long_symbol: int = 6  # words; shorter symbols are anchors only where a window has no longer one


NONE = np.int64(-(1 << 40))


def levels(w: Words, rounds: int):
    """After each round: names, word ranges and contexts [low, high) of all symbols of a slice of texts."""
    name, start = w.hashes, np.arange(w.n)
    end = start + 1
    text = w.text_index()
    low, high = start.copy(), end.copy()
    yield name, start, end, low, high
    for turn in range(rounds):
        n = len(name)
        follows = np.r_[False, text[1:] == text[:-1]] if n else np.zeros(0, bool)  # a symbol of the same text before it
        # That a symbol is no longer run shows in the word on either side of it, unless that word is
        # like its own: then the neighbour as a whole belongs to the context. Runs of one symbol
        # depend on the symbols around them.
        if n:
            prev, then = np.maximum(start - 1, 0), np.minimum(end, w.n - 1)
            like = follows & (w.hashes[prev] == w.hashes[end - 1])
            low = np.minimum(low, np.where(like, np.r_[NONE, low[:-1]], start - 1))
            like = np.r_[follows[1:], False] & (w.hashes[then] == w.hashes[start])
            high = np.maximum(high, np.where(like, np.r_[high[1:], -NONE], end + 1))
        same = follows & np.r_[False, name[1:] == name[:-1]] if n else follows
        if same.any():
            head = np.flatnonzero(~same)
            size = np.diff(np.r_[head, n])
            tail = head + size - 1
            run = size > 1
            new_low, new_high = low[head].copy(), high[tail].copy()
            before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, n - 1)
            new_low[run] = np.where(follows[head[run]], low[before[run]], NONE)
            ends = np.where(tail[run] + 1 < n, follows[after[run]], False)
            new_high[run] = np.where(ends, high[after[run]], -NONE)
            new_name = name[head].copy()
            new_name[run] = mix(new_name[run] * np.uint64(0xA24BAED4963EE407) + size[run].astype(np.uint64))
            name, start, end, text, low, high, follows = new_name, start[head], end[tail], text[head], new_low, new_high, follows[head]
            n = len(name)
        left = (mix(name + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(63)).astype(bool)
        next_follows = np.r_[follows[1:], False] if n else follows
        first = left & next_follows & np.r_[~left[1:], False] if n else left
        second = np.r_[False, first[:-1]] if n else first
        # A symbol that stays alone depends on the neighbour that could have joined it.
        alone_left, alone_right = left & ~first, ~left & ~second
        new_low, new_high = low.copy(), high.copy()
        i = np.flatnonzero(alone_left)
        new_high[i] = np.where(next_follows[i], np.maximum(high[i], high[np.minimum(i + 1, n - 1)]), -NONE)
        new_low[i] = np.where(next_follows[i], np.minimum(low[i], low[np.minimum(i + 1, n - 1)]), low[i])
        i = np.flatnonzero(alone_right)
        new_low[i] = np.where(follows[i], np.minimum(low[i], low[np.maximum(i - 1, 0)]), NONE)
        new_high[i] = np.where(follows[i], np.maximum(high[i], high[np.maximum(i - 1, 0)]), high[i])
        i = np.flatnonzero(first)
        new_low[i] = np.minimum(low[i], low[i + 1])
        new_high[i] = np.maximum(high[i], high[i + 1])
        new_name, new_end = name.copy(), end.copy()
        new_name[i] = mix(name[i] * np.uint64(0xD1342543DE82EF95) + mix(name[i + 1]))
        new_end[i] = end[i + 1]
        keep = ~second
        name, start, end, text, low, high = new_name[keep], start[keep], new_end[keep], text[keep], new_low[keep], new_high[keep]
        yield name, start, end, low, high


def anchors(w: Words, rules: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start: whether the window fits its text, its anchor's name, and the anchor's first word."""
    size = rules.window
    fits = w.words_left() >= size
    name_of, place_of = np.zeros(w.n, np.uint64), np.full(w.n, -1, np.int64)
    parsed = list(levels(w, rules.level))
    open_ = np.flatnonzero(fits)
    # Long symbols of the last round, then any of it, then those of the rounds before.
    for turn, at_least in [(rules.level, rules.long_symbol), *((k, 0) for k in range(rules.level, -1, -1))]:
        if not len(open_):
            break
        name, start, end, low, high = parsed[turn]
        fine = (low >= 0) & (high <= w.n) & (high - low <= size) & (end - start >= at_least)
        name, start, low, high = name[fine], start[fine], low[fine], high[fine]
        if not len(name):
            continue
        # Contexts may cross; hold them to rising order so that a window's symbols are one range.
        high = np.maximum.accumulate(high)
        low = np.minimum.accumulate(low[::-1])[::-1]
        first = np.searchsorted(low, open_, "left")
        last = np.searchsorted(high, open_ + size, "right")
        rank = mix(name ^ np.uint64(0x5851F42D4C957F2D))
        best, best_rank = np.full(len(open_), -1, np.int64), np.full(len(open_), np.iinfo(np.uint64).max, np.uint64)
        step, live = 0, np.flatnonzero(first < last)
        while len(live):
            i = first[live] + step
            better = rank[i] < best_rank[live]
            best[live[better]], best_rank[live[better]] = i[better], rank[i[better]]
            step += 1
            live = live[first[live] + step < last[live]]
        got = best >= 0
        name_of[open_[got]], place_of[open_[got]] = name[best[got]], start[best[got]]
        open_ = open_[~got]
    return fits, name_of, place_of


def in_steps(keyed, b: pa.RecordBatch, limit: int = 1_000_000):
    """What keyed gives for a batch of texts, from `limit` bytes of text at a time: its arrays are many times their texts."""
    out, first = [], 0
    for part in slices([b], limit=limit):
        keys, text, *rest = keyed(part)
        out.append((keys, text + first, *rest))
        first += part.num_rows
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else keyed(b)


def remove_repeats(scratch: Scratch, docs: DataFrame, rules: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row; with_text adds `kept_text` (the text itself where
    nothing goes, else the kept words joined by a space) and the other columns of docs.

    Words in any window of `window` words that also starts elsewhere (in this or any other row) are
    removed, all at once. Null or empty text: no words, and the checksum of nothing. Rows equal in
    every way repeat each other, and so lose all windows.
    """
    size = rules.window
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_words", "n_removed", "kept_sha256", "kept_text", "uid", "starts", "lengths", "copied")] if with_text else []
    base = docs.select("doc_id", "text", *others).withColumn("uid", uid())

    # Copies of a text: all their windows repeat. One of them speaks for the group below.
    thin = base.select("uid", *same_text()).where("bytes > 0")
    copies = with_groups(scratch, thin, ["h", "c", "bytes"], {"speaker": F.min("uid")})
    copied = scratch.save(copies.groupBy("uid").agg(F.max(F.col("uid") == F.col("speaker")).alias("speaks")))

    def anchor_runs(b):
        """A range for each run of windows with one anchor."""
        w = Words(b.column("text"))
        fits, name, place = anchors(w, rules)
        at = np.flatnonzero(fits)
        text = w.text_index()[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (text[1:] != text[:-1]) | (place[at[1:]] != place[at[:-1]]) | (name[at[1:]] != name[at[:-1]])
        first = np.flatnonzero(new)
        head = at[first]
        return name[head], text[first], head - w.bounds[text[first]], np.diff(np.r_[first, len(at)]), place[head] - w.bounds[text[first]]

    shared = repeated(scratch, base.select("uid", "text"), lambda b: in_steps(anchor_runs, b)).select("uid", "starts", "lengths")
    chosen = scratch.save(shared.join(copied.where(~F.col("speaks")).select("uid"), "uid", "left_anti").dropDuplicates(["uid"]))

    def window_keys(b):
        w = Words(b.column("text"))
        some = [(ints_of(s), ints_of(n)) for s, n in zip(b.column("starts").to_pylist(), b.column("lengths").to_pylist(), strict=True)]
        place = [expand(s, n) for s, n in some]
        text = np.repeat(np.arange(b.num_rows), [len(p) for p in place])
        place = np.concatenate(place) if place else np.empty(0, np.int64)
        return names128(w.hashes, place + w.bounds[text], size), text, place, np.ones(len(place), np.int64), place

    again = repeated(scratch, base.select("uid", "text").join(chosen, "uid"), lambda b: in_steps(window_keys, b), width=2).select("uid", "starts").dropDuplicates(["uid"])
    whole = copied.select("uid", F.lit(True).alias("copied"))
    verdict = scratch.save(again.join(whole, "uid", "full_outer"))
    scratch.drop(chosen, copied)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else []), *(docs.schema[c] for c in others)])
    wanted = arrow_schema(schema)

    def cut(batches):
        for b in slices(batches):
            w = Words(b.column("text"), hashed=False)
            gone = np.zeros(w.n, bool)
            full = b.column("copied").to_pylist()
            for i, value in enumerate(b.column("starts").to_pylist()):
                a, z = int(w.bounds[i]), int(w.bounds[i + 1])
                if full[i]:
                    gone[a:z] = z - a >= size
                elif value:
                    p = ints_of(value)
                    gone[a:z] = covered(p, p + size, z - a)
            sums = np.r_[0, np.cumsum(gone)]
            joined = []
            raw = w.buf.tobytes()
            for i in range(b.num_rows):
                a, z = int(w.bounds[i]), int(w.bounds[i + 1])
                words = raw[int(w.offsets[i]) : int(w.offsets[i + 1])].split()
                if sums[z] > sums[a]:
                    words = [x for x, g in zip(words, gone[a:z].tolist(), strict=True) if not g]
                joined.append(b" ".join(words))
            changed = sums[w.bounds[1:]] > sums[w.bounds[:-1]]
            more = {"kept_text": pa.array([x.decode() if c else t for x, c, t in zip(joined, changed, b.column("text").to_pylist(), strict=True)], pa.string())} if with_text else {}
            yield record(wanted, doc_id=b.column("doc_id"), n_words=w.counts, n_removed=sums[w.bounds[1:]] - sums[w.bounds[:-1]], kept_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()), **more, **{c: b.column(c) for c in others})

    return base.join(verdict, "uid", "left").select("doc_id", "text", "starts", "copied", *others).mapInArrow(cut, schema)
