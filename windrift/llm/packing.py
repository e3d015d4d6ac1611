"""Best-fit packing of tokenised documents into sequences by bin completion.

Only sizes matter for packing, and a sequence of `capacity` tokens knows at most `capacity` sizes.
So the pieces' sizes are counted by Spark, the counts (at most `capacity` rows, at any corpus
size) are packed on the driver, and the result is a list of patterns with multiplicities. Each
piece then finds its place by its rank among the pieces of its size.

The packing: best-fit decreasing gives the first incumbent. Bin completion takes the largest size left
and enumerates, by waste, the fillings of the room beside it that no other filling dominates: none
of a filling's pieces, alone or some together, could make way for one piece left over that is no
smaller and fits. It branches on each filling in turn and on how many sequences take it, most first,
and comes back to every branch not yet closed. A branch is cut when the sequences so far and a lower
bound of the rest do not beat the incumbent. The tree is left when the incumbent meets the lower
bound, no branch is open, or its budget of nodes is spent.

If a gap is left, the incumbent is improved in its neighbourhood: some sequences, wasteful ones
rather, are emptied and their pieces completed anew around documents drawn at random, each filling one
of least waste. The new sequences are kept if they are fewer, or if they gather the waste in fewer of
them; where they help, all sequences of the same patterns are exchanged together. `Packed` says
whether the result is proved, and how far the lower bound lies.
"""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, in_order, record, slices


@dataclass(frozen=True)
class Pack:
    capacity: int = 1024
    end_id: int = 2
    nodes: int = 4_000  # branches the tree may open
    rounds: int = 20_000  # times that sequences of the incumbent are completed anew
    seed: int = 6


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=1)
def tokenizer(json_path: str):
    """A function from text to ids, equal to the tokenizers library's on the byte-level BPE file json_path.

    The vocabulary's ranks file beside it (same name, .tiktoken) lets a faster library do the work;
    texts that library refuses go to the first one.
    """
    import os

    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    exact = Tokenizer.from_file(json_path)
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    import public_tokenizers

    with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        try:
            return quick.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the library's own panics are no Exceptions
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


PIECES = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32"))])


def cut_pieces(docs: DataFrame, json_path: str, pack: Pack = Pack()) -> DataFrame:
    """One row for each piece: its place in its document and the checksum of its ids."""
    schema = T.StructType([docs.schema["doc_id"], *PIECES.fields[1:]])
    wanted = arrow_schema(schema)

    def run(batches):
        encode = tokenizer(json_path)
        end = np.array([pack.end_id], np.uint32)
        for b in slices(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.concatenate([encode(text) if text else end[:0], end]).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = (len(ids) - 1) % pack.capacity + 1 if not start else pack.capacity
                    rows.append((i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, piece = start + length, piece + 1
            at = np.array(rows, np.int64).T
            yield record(wanted, doc_id=b.column("doc_id").take(at[0]), piece=at[1], start=at[2], length=at[3], ids_crc32=at[4])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- the packing of size counts

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, how often in a sequence), ...), number of such sequences


def smeared(bits: int, first: int, last: int) -> int:
    """The set of x + t for x in bits and first <= t <= last; sets are the bits of an integer."""
    if last < first:
        return 0
    out, width = bits << first, 1
    while width < last - first + 1:
        step = min(width, last - first + 1 - width)
        out, width = out | (out << step), width + step
    return out


def dominated(filling: tuple[tuple[int, int], ...], counts: dict[int, int], waste: int) -> bool:
    """Whether a piece left over fits beside the filling, or in place of a smaller one of its pieces, or of several that are no larger together."""
    used = dict(filling)
    one = many = spare = 0
    for size, times in filling:
        for _ in range(times):
            many |= (many | one) << size
            one |= 1 << size
    for size, n in counts.items():
        if n > used.get(size, 0):
            spare |= 1 << size
    return bool((smeared(one | 1, 1, waste) | smeared(many, 0, waste)) & spare)


def fillings(counts: dict[int, int], room: int) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, ((size, times), ...)): every undominated filling of room, by waste, larger pieces first."""
    sizes = sorted((s for s in counts if s <= room), reverse=True)
    full = (1 << (room + 1)) - 1
    # sums[i]: what the sizes from i on can add up to.
    sums = [1]
    for s in reversed(sizes):
        reach, left, step = sums[-1], min(counts[s], room // s), 1
        while left > 0:
            step = min(step, left)
            reach |= (reach << (s * step)) & full
            left, step = left - step, 2 * step
        sums.append(reach)
    sums.reverse()

    def go(i: int, left: int) -> Iterator[tuple]:
        if not left:
            yield ()
            return
        while i < len(sizes) and sums[i] >> left & 1:
            s = sizes[i]
            for times in range(min(counts[s], left // s), 0, -1):
                if sums[i + 1] >> (left - times * s) & 1:
                    for tail in go(i + 1, left - times * s):
                        yield ((s, times), *tail)
            i += 1

    for waste in range(room + 1):
        if sums[0] >> (room - waste) & 1:
            for filling in go(0, room - waste):
                if not dominated(filling, counts, waste):
                    yield waste, filling


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: pieces of one size go together wherever they fit alike."""
    open_: dict[int, list[list]] = {}  # room left -> [contents, how many sequences]
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                per = capacity // s
                full, rest = divmod(n, per)
                for times, many in ((per, full), (rest, 1 if rest else 0)):
                    if many:
                        open_.setdefault(capacity - s * times, []).append([((s, times),), many])
                break
            contents, many = open_[room].pop()
            if not open_[room]:
                del open_[room]
            used = min(n, many)
            if used < many:
                open_.setdefault(room, []).append([contents, many - used])
            last = contents[-1]
            grown = (*contents[:-1], (s, last[1] + 1)) if last[0] == s else (*contents, (s, 1))
            open_.setdefault(room - s, []).append([grown, used])
            n -= used
    return [(tuple(c), m) for group in open_.values() for c, m in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that no packing can do without: for each k, pieces too large for one of k beside them, those of
    more than half, and what the other pieces from k on need beyond the room beside these."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    size = np.arange(capacity + 1)
    below = np.r_[0, np.cumsum(n)]  # pieces smaller than s
    mass = np.r_[0, np.cumsum(n * size)]
    half = capacity // 2
    k = np.arange(half + 1)
    alone = below[-1] - below[capacity - k + 1]
    large = np.maximum(0, below[capacity - k + 1] - below[half + 1])
    room = capacity * large - np.maximum(0, mass[capacity - k + 1] - mass[half + 1])
    small = mass[half + 1] - mass[k]
    return int(max(-(-int(mass[-1]) // capacity), (alone + large + np.maximum(0, -(-(small - room) // capacity))).max()))


def least_waste(left: dict[int, int], room: int, order: list[int]) -> dict[int, int]:
    """A filling of room of least waste. Of several, it has as few as can be of the sizes that come first in order."""
    sizes = [s for s in order if s <= room and left.get(s)]
    full, sums = (1 << (room + 1)) - 1, [1]
    for s in reversed(sizes):
        reach, some, step = sums[-1], min(left[s], room // s), 1
        while some > 0:
            step = min(step, some)
            reach |= (reach << (s * step)) & full
            some, step = some - step, 2 * step
        sums.append(reach)
        if reach >> room & 1:
            break
    used, goal, out = sizes[len(sizes) - len(sums) + 1 :], sums[-1].bit_length() - 1, {}
    for i, s in enumerate(used):
        rest = sums[len(used) - 1 - i]
        while not rest >> goal & 1:
            goal -= s
            out[s] = out.get(s, 0) + 1
    return out


def completed(counts: dict[int, int], capacity: int, rng: random.Random, share: int) -> list[Pattern]:
    """A packing by completion around documents drawn at random; a filling is taken a share-th as often as it could be."""
    left, order, out = dict(counts), list(counts), []
    while left:
        keys = list(left)
        order = [s for s in order if s in left]
        rng.shuffle(order)
        s = rng.choices(keys, [left[k] * k for k in keys])[0]
        need = least_waste(left | {s: left[s] - 1}, capacity - s, order)
        need[s] = need.get(s, 0) + 1
        many = max(1, min(left[k] // n for k, n in need.items()) // share)
        for k, n in need.items():
            left[k] -= n * many
            if not left[k]:
                del left[k]
        out.append((tuple(sorted(need.items(), reverse=True)), many))
    return out


def improved(patterns: list[Pattern], capacity: int, bound: int, rounds: int, rng: random.Random) -> list[Pattern]:
    """The packing after up to `rounds` exchanges of a few of its sequences for better ones; it never gets longer."""
    fill = lambda contents: sum(s * n for s, n in contents)
    have: Counter = Counter()
    for contents, many in patterns:
        have[tuple(sorted(contents, reverse=True))] += many
    total, names = sum(have.values()), []
    for turn in range(rounds):
        if total <= bound:
            break
        if turn % 200 == 0:
            names = [c for c, n in have.items() if n > 0]
            often = [min(have[c], 50) for c in names]
            waste = [(capacity - fill(c)) * n for c, n in zip(names, often, strict=True)]
        k = rng.randint(4, 12)
        pick: Counter = Counter()
        for c in rng.choices(names, waste if any(waste) else often, k=k // 2) + rng.choices(names, often, k=k - k // 2):
            if have[c] > pick[c]:
                pick[c] += 1
        if not pick:
            continue
        pieces: Counter = Counter()
        for c, n in pick.items():
            for s, times in c:
                pieces[s] += times * n
        new = completed(pieces, capacity, rng, 1 << 60)
        fewer = sum(pick.values()) - sum(n for _, n in new)
        gain = sum(fill(c) ** 2 * n for c, n in new) - sum(fill(c) ** 2 * n for c, n in pick.items())
        if fewer < 0 or (fewer == 0 and gain < 0):
            continue
        times = max(1, min(have[c] // n for c, n in pick.items()) // 2) if fewer or gain else 1
        times = min(times, (total - bound) // fewer) if fewer else times
        for c, n in pick.items():
            have[c] -= n * times
        for c, n in new:
            if have[c] <= 0:
                names.append(c)
                often.append(1)
                waste.append(capacity - fill(c))
            have[c] += n * times
        total -= fewer * times
    return [(c, n) for c, n in have.items() if n > 0]


@dataclass(frozen=True)
class Packed:
    patterns: list[Pattern]
    sequences: int
    bound: int  # no packing has fewer sequences
    proved: bool  # no packing has fewer than this one: the bound is met, or every branch was closed
    nodes: int


def complete_bins(counts: dict[int, int], pack: Pack = Pack()) -> Packed:
    """Patterns that hold every piece once, in as few sequences as the search finds."""
    counts = {s: n for s, n in counts.items() if n}
    bound = lower_bound(counts, pack.capacity)
    best = best_fit(counts, pack.capacity)
    most = sum(m for _, m in best)
    opened = 0

    def branches(left: dict[int, int], after: tuple | None) -> Iterator[tuple[tuple, int, dict[int, int], tuple]]:
        s = max(left)
        rest = {k: n - (k == s) for k, n in left.items() if n > (k == s)}
        for waste, filling in fillings(rest, pack.capacity - s):
            # Sequences of one largest size are taken in order of their fillings, so that no set of them comes twice.
            key = (s, waste, tuple(-size for size, times in filling for _ in range(times)))
            if after and after[0] == s and key <= after:
                continue
            need = dict(filling)
            need[s] = need.get(s, 0) + 1
            for many in range(min(left[size] // times for size, times in need.items()), 0, -1):
                yield tuple(sorted(need.items(), reverse=True)), many, {k: n - many * need.get(k, 0) for k, n in left.items() if n > many * need.get(k, 0)}, key

    path: list[Pattern] = []
    stack = [(branches(counts, None), 0)] if counts and most > bound else []
    while stack and opened < pack.nodes and most > bound:
        options, used = stack[-1]
        option = next(options, None)
        if option is None:
            stack.pop()
            if path:
                path.pop()
            continue
        pattern, many, left, key = option
        opened += 1
        if not left:
            if used + many < most:
                best, most = [*path, (pattern, many)], used + many
        elif used + many + lower_bound(left, pack.capacity) < most:
            path.append((pattern, many))
            stack.append((branches(left, key), used + many))
    proved = most <= bound or not stack
    if not proved:
        rng = random.Random(pack.seed)
        other = completed(counts, pack.capacity, rng, 8) if len(counts) < 512 else best
        if sum(m for _, m in other) < most:
            best = other
        best = improved(best, pack.capacity, bound, pack.rounds, rng)
        most = sum(m for _, m in best)
    return Packed(best, most, bound, proved or most <= bound, opened)


def pack_counts(counts: dict[int, int], pack: Pack = Pack()) -> list[Pattern]:
    return complete_bins(counts, pack).patterns


def place(scratch: Scratch, pieces: DataFrame, pack: Pack = Pack()) -> DataFrame:
    """pieces with sequence_id and offset; sequences are gapless from offset 0."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = pack_counts(counts, pack)
    ranked, _ = in_order(scratch, pieces, ["length", "doc_id", "piece"], [], group="length")
    # For each size, which ranks go to which pattern: first rank, times in a sequence, first sequence, offset.
    used = dict.fromkeys(counts, 0)
    spots: list[tuple[int, int, int, int, int]] = []
    first = 0
    for contents, many in patterns:
        offset = 0
        for size, times in contents:
            spots.append((size, used[size], times, first, offset))
            used[size] += times * many
            offset += size * times
        first += many
    size, rank, times, sequence, offset = np.array(sorted(spots) or [(0, 0, 1, 0, 0)], np.int64).T
    at_size = size * (1 << 48) + rank
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    wanted = arrow_schema(schema)
    names = pieces.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "at"))
            i = np.searchsorted(at_size, n * (1 << 48) + r, "right") - 1
            past = r - rank[i]
            yield record(wanted, **{c: b.column(c) for c in names}, sequence_id=sequence[i] + past // times[i], offset=offset[i] + past % times[i] * n)

    return ranked.select(*names, "at").mapInArrow(run, schema)


def pack_documents(scratch: Scratch, docs: DataFrame, json_path: str, pack: Pack = Pack()) -> DataFrame:
    """Every piece of every document, placed. A document is its ids and the end id; null text is empty.

    A document longer than the capacity is cut into full pieces, the first may be shorter. Rows
    that repeat a doc_id are documents of their own; an empty table gives an empty result.
    """
    return place(scratch, scratch.save(cut_pieces(docs, json_path, pack)), pack)
