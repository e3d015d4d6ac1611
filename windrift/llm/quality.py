"""Quality rules: repeated substrings of each text by suffix array, beside counted base rules.

The words that lie in a repeat of at least `shingle` words are found first, by hashes; only those
runs enter the suffix array, with a unique break after each run, so the array is exact for every
repeat of that length and small where texts are clean. Ranks come from prefix doubling, common
prefix lengths from a search by the names of prefixes, so memory is a few arrays of the repeated
words. Each maximal repeat of `min_repeat` words or more (an interval of the common-prefix array)
marks its span at every place it starts; the spans' union gives the covered fraction, the largest
interval the longest repeat. Both are limited: long repeats weigh more than the short ones that
the base rule counts, which prose has by chance.

Null text: no words. Rows pass through one by one; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from windrift.llm.common import arrow_schema, record, slices
from windrift.llm.words import Runs, Words, covered, mix, segment_hashes


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; `min_repeat` words (at least `shingle`) make a repeat, `max_longest` words are too long a one."""

    shingle: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20
    min_repeat: int = 8
    max_covered: float = 0.15
    max_longest: int = 50


SYMBOLS = b"#*$%&|<>"
COLUMNS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType())]
)


def suffix_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the longest common prefix of its suffix with either neighbour in suffix order."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    rank, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while True:
        if int(rank.max()) == n - 1 or k >= n:
            break
        later = np.full(n, -1, np.int64)
        later[: n - k] = rank[k:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        step = np.r_[0, (key[order[1:]] != key[order[:-1]]).astype(np.int64)]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        k *= 2
    order = np.argsort(rank, kind="stable")
    names = Runs(mix(ids.astype(np.uint64) + np.uint64(1)))
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    length = 1 << max(0, n.bit_length() - 1)
    while length:
        inside = np.flatnonzero(np.maximum(a, b) + length <= n)
        same = inside[names.of(a[inside], length) == names.of(b[inside], length)]
        for x in (common, a, b):
            x[same] += length
        length //= 2
    out = np.zeros(n, np.int64)
    out[order[:-1]] = common
    out[order[1:]] = np.maximum(out[order[1:]], common)
    return out


def measure(column, rules: Rules) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for a slice of texts."""
    w = Words(column)
    texts = len(w.counts)
    sums = lambda mask: (lambda c: c[w.offsets[1:]] - c[w.offsets[:-1]])(np.r_[0, np.cumsum(mask)])
    chars = sums(w.solid & ((w.buf & 0xC0) != 0x80))
    symbols = sums(np.isin(w.buf, np.frombuffer(SYMBOLS, np.uint8)))

    # Lines: pieces between \n; those that hold a word count.
    breaks = np.flatnonzero(w.buf == 10)
    line_starts = np.unique(np.r_[w.offsets[:-1], breaks + 1])
    line_starts = line_starts[line_starts < len(w.buf)]
    line_ends = np.r_[line_starts[1:], len(w.buf)].astype(np.int64)[: len(line_starts)]
    line_ends -= w.buf[line_ends - 1] == 10 if len(line_ends) else 0
    solid = np.r_[0, np.cumsum(w.solid)]
    has = solid[line_ends] > solid[line_starts]
    line_starts, line_ends = line_starts[has], line_ends[has]
    line_text = np.searchsorted(w.offsets, line_starts, "right") - 1
    same_line = mix(segment_hashes(w.buf, line_starts, line_ends) ^ mix(line_text.astype(np.uint64)))
    _, firsts = np.unique(same_line, return_index=True)
    dup_lines = np.bincount(line_text, minlength=texts) - np.bincount(line_text[firsts], minlength=texts)

    # Windows of `shingle` words that a text holds twice or more.
    text_of_word = w.text_index()
    at = np.flatnonzero(w.words_left() >= rules.shingle)
    runs = Runs(w.hashes)
    key = mix(runs.of(at, rules.shingle) ^ mix(text_of_word[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    equal = np.r_[False, key[order[1:]] == key[order[:-1]]][: len(key)]
    twice = equal.copy()
    twice[:-1] |= equal[1:]
    repeated = at[order[twice]]
    in_repeat = covered(repeated, repeated + rules.shingle, w.n)
    repeat_words = np.bincount(text_of_word[in_repeat], minlength=texts)

    # The suffix array over the repeated runs of each text, a break of its own after each run.
    words = np.flatnonzero(in_repeat)
    spans, longest = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if len(words):
        last = np.r_[(np.diff(words) > 1) | (np.diff(text_of_word[words]) > 0), True]
        place = np.arange(len(words)) + np.r_[0, np.cumsum(last)[:-1]]
        _, ids = np.unique(mix(w.hashes[words] ^ mix(text_of_word[words].astype(np.uint64))), return_inverse=True)
        line = np.zeros(int(place[-1]) + 2, np.int64)
        line[place] = ids
        stops = place[last] + 1
        line[stops] = len(words) + np.arange(len(stops))
        common = suffix_repeats(line)[place]
        starts = np.flatnonzero(common >= rules.min_repeat)
        inside = covered(starts, starts + common[starts], len(words))
        spans = np.bincount(text_of_word[words[inside]], minlength=texts)
        np.maximum.at(longest, text_of_word[words[starts]], common[starts])

    base_failed = (w.counts < rules.min_words) | (100 * repeat_words > rules.max_repeat_percent * w.counts)
    kept = ~base_failed & (spans <= rules.max_covered * w.counts) & (longest <= rules.max_longest)
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": base_failed, "kept": kept, "covered_words": spans, "longest_repeat": longest}


def quality_rules(docs: DataFrame, rules: Rules = Rules(), keep_columns: list[str] | None = None) -> DataFrame:
    """Each row of `docs` with the columns of COLUMNS; no shuffle. `keep_columns`: those of docs to carry (default all).

    A column of docs named like a result column is left out in favour of the result.
    """
    names = [c for c in (keep_columns if keep_columns is not None else docs.columns) if c not in COLUMNS.names]
    schema = T.StructType([docs.schema[c] for c in names] + COLUMNS.fields)
    wanted = arrow_schema(schema)

    def run(batches):
        for b in slices(batches):
            yield record(wanted, **{c: b.column(c) for c in names}, **measure(b.column("text"), rules))

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)
