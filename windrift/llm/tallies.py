"""What blocks of texts ask the whole corpus about their keys, and the answers.

A block is some megabytes of texts. It names each of its distinct keys once, with its own counts of
it, so a key that every text holds costs one entry a block, not one a text. Keys are dealt to tasks
in buckets; a task adds up one bucket at a time and answers each block that asked. The answers meet
the block's payload, where its texts and places waited, in one task a block.

Blocks are a written table: asking, adding up and finishing read their own columns of it.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, partitions_of, record, slices

ASKED = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("payload", T.BinaryType())])
REPLY = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("payload", T.BinaryType())])
#: Buckets of a task, each added up on its own; keys that a block should have for each bucket, and most keys it waits for.
BUCKETS, KEYS_A_BUCKET, MOST_KEYS = 4, 16, 4_000_000
#: Bytes of a block that is read again.
BLOCK_BYTES = 8_000_000
#: Keys of one name lose so many of their lowest bits: 56 are left, so one in 70,000 of 10^12 keys shares its name.
DROPPED = 8


def to_bytes(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return out.getvalue()


def small(values: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in full. Most are alike, so they are compressed."""
    data = np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u8").tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def counts_of(data: bytes, n: int) -> np.ndarray:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def rising(keys: np.ndarray) -> bytes:
    """Keys [n, width] in order: those of one name each as the steps between them, in as few bytes as the largest needs."""
    if keys.shape[1] > 1 or not len(keys):
        return keys.tobytes()
    steps = np.diff(keys[:, 0]) >> np.uint64(DROPPED)
    size = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return keys[0, 0].tobytes() + bytes([size]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def keys_of(data: bytes, width: int) -> np.ndarray:
    if width > 1 or not data:
        return np.frombuffer(data, np.uint64).reshape(-1, width)
    size = data[8]
    steps = np.zeros(((len(data) - 9) // size, 8), np.uint8)
    steps[:, :size] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, size)
    return np.cumsum(np.r_[np.frombuffer(data, np.uint64, 1), steps.view("<u8").ravel() << np.uint64(DROPPED)])[:, None]


def packed(batch: pa.RecordBatch) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def unpacked(data: np.ndarray) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_next_batch()


def by_run(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """The rows of each run of equal values of a column, as lists."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and held[-1][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): rows in the order of their keys [n, width], and which of them begin a new key."""
    order = np.argsort(keys[:, 0]) if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]).any(axis=1)
    return order, first


def ask(scratch: Scratch, docs: DataFrame, build: Callable, finish: Callable, result: T.StructType, answer: Callable, width: int = 1, tallies: int = 1, answers: int = 1, again: bool = False) -> DataFrame:
    """A written table of the rows of `result` that finish yields for each slice of docs.

    build(batch) gives (keys [n, width], counts [n, tallies], arrays) for a slice; keys may repeat.
    answer(sums [m, tallies]) gives whole numbers [m, answers] for each key of the corpus from its
    counts over all blocks. finish(batch, arrays, answers) has them in the order of build's keys.
    The arrays wait beside the block in a written table, and batch is None. With `again` nothing is
    written: blocks are cut by their bytes, docs are read a second time, the slices go where the
    answers go, and arrays are built again; that costs time and saves disk. docs must then give the
    same rows in the same order each time it is read, as a scan of files does; each answer carries a
    checksum of the keys it is for, so that anything else is an error. docs holds `text`.
    """
    parts = partitions_of(scratch.spark)
    buckets = parts * BUCKETS
    wanted, reply = arrow_schema(ASKED), arrow_schema(REPLY)
    enough = min(KEYS_A_BUCKET * buckets, MOST_KEYS)

    def merged(held):
        """The block's distinct keys in order of bucket, their counts, and for each of build's keys which one it is."""
        keys = np.concatenate([k.reshape(-1, width) for k, _, _ in held])
        if width == 1:
            keys = keys & ~np.uint64((1 << DROPPED) - 1)
        order, first = distinct(keys)
        at = np.flatnonzero(first)
        where = np.empty(len(keys), np.uint32)
        where[order] = (np.cumsum(first) - 1).astype(np.uint32)
        return keys[order[at]], order, at, where

    def bucket_of(keys):
        # Buckets are ranges of the first name, so the order of keys is the order of buckets.
        return ((keys[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)

    def runs_of(bucket):
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        return cut, np.r_[cut[1:], len(bucket)][: len(cut)]

    def asking(number, held):
        """A block's rows for the tasks that add up, and which of its distinct keys each key is."""
        keys, order, at, where = merged(held)
        counts = np.concatenate([c.reshape(-1, tallies) for _, c, _ in held])
        sums = np.add.reduceat(counts[order], at, axis=0, dtype=np.uint32) if len(at) else counts[:0].astype(np.uint32)
        bucket = bucket_of(keys)
        cut, ends = runs_of(bucket)
        rows = record(
            wanted,
            block=np.full(len(cut), number, np.int64),
            bucket=bucket[cut],
            keys=pa.array([rising(keys[a:z]) for a, z in zip(cut, ends, strict=True)], pa.binary()),
            counts=pa.array([small(sums[a:z].T.ravel()) for a, z in zip(cut, ends, strict=True)], pa.binary()),
            payload=pa.array([b""] * len(cut), pa.binary()),
        )
        return rows, where

    def waiting(number, *arrays):
        return record(wanted, block=np.array([number]), bucket=np.array([-1], np.int32), keys=pa.array([b""], pa.binary()), counts=pa.array([b""], pa.binary()), payload=pa.array([to_bytes(*arrays)], pa.binary()))

    def first_number():
        from pyspark import TaskContext

        return TaskContext.get().partitionId() << 32

    def put(batches):
        number, held, size = first_number(), [], 0

        def flush():
            rows, where = asking(number, held)
            yield rows
            yield waiting(number, np.array([len(k) for k, _, _ in held]), np.array([len(arrays) for _, _, arrays in held]), where, *(x for _, _, arrays in held for x in arrays))

        for b in slices(batches):
            held.append(build(b))
            size += len(held[-1][0])
            if size >= enough:
                yield from flush()
                number, held, size = number + 1, [], 0
        if held:
            yield from flush()

    def by_bytes(batches):
        number, some, size = first_number(), [], 0
        for b in slices(batches):
            some.append(b)
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield number, some
                number, some, size = number + 1, [], 0
        if some:
            yield number, some

    def put_keys(batches):
        for number, some in by_bytes(batches):
            yield asking(number, [build(b) for b in some])[0]

    def put_slices(batches):
        for number, some in by_bytes(batches):
            yield waiting(number, np.zeros(len(some), np.int64), *(packed(b) for b in some))

    def meet(batches):
        for rows in by_run(batches, "bucket"):
            named = [keys_of(r["keys"], width) for r in rows]
            ends = np.cumsum([len(k) for k in named])
            counts = np.concatenate([counts_of(r["counts"], len(k) * tallies).reshape(tallies, -1) for r, k in zip(rows, named, strict=True)], axis=1)
            keys = np.concatenate(named)
            order, first = distinct(keys)
            group = np.empty(len(keys), np.int64)
            group[order] = np.cumsum(first) - 1
            sums = np.stack([np.bincount(group, c) for c in counts], axis=1).astype(np.int64)
            values = answer(sums).reshape(-1, answers)[group]
            said = [small(values[a:z].T.ravel()) for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            heads = [len(k).to_bytes(8, "little") + np.bitwise_xor.reduce(k[:, 0]).tobytes() for k in named]
            yield record(reply, block=np.array([r["block"] for r in rows], np.int64), bucket=np.array([r["bucket"] for r in rows], np.int32), payload=pa.array([a + b for a, b in zip(heads, said, strict=True)], pa.binary()))

    def close(batches):
        for rows in by_run(batches, "block"):
            source = io.BytesIO(rows[0]["payload"])
            sizes = np.load(source)
            if again:
                some = [unpacked(np.load(source)) for _ in sizes]
                held = [build(b) for b in some]
                sizes, arrays = [len(k) for k, _, _ in held], [x for _, _, x in held]
                keys, _, _, where = merged(held)
                cut, ends = runs_of(bucket_of(keys))
                sums = [len(keys[a:z]).to_bytes(8, "little") + np.bitwise_xor.reduce(keys[a:z, 0]).tobytes() for a, z in zip(cut, ends, strict=True)]
                if sums != [r["payload"][:16] for r in rows[1:]]:
                    raise RuntimeError("docs gave other rows when they were read again")
            else:
                arrays_of, where = np.load(source), np.load(source)
                some, arrays = [None] * len(sizes), [tuple(np.load(source) for _ in range(n)) for n in arrays_of]
            replies = [counts_of(r["payload"][16:], int.from_bytes(r["payload"][:8], "little") * answers).reshape(answers, -1) for r in rows[1:]]
            values, start = np.concatenate([np.empty((answers, 0), np.int64), *replies], axis=1).T[where], 0
            for b, own, n in zip(some, arrays, sizes, strict=True):
                yield from finish(b, own, values[start : start + n])
                start += n

    asked = docs.mapInArrow(put_keys, ASKED) if again else scratch.save(docs.mapInArrow(put, ASKED), "zstd")
    said = asked.where("bucket >= 0").select("block", "bucket", "keys", "counts").repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(meet, REPLY)
    kept = docs.mapInArrow(put_slices, ASKED) if again else asked.where("bucket < 0")
    both = kept.select("block", "bucket", "payload").union(said)
    out = scratch.save(both.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(close, result))
    if not again:
        scratch.drop(asked)
    return out


# ---------------------------------------------------------------- what occurs more than once

FOUND = T.StructType([T.StructField("uid", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("starts", "lengths", "crowded"))])


def repeated(scratch: Scratch, docs: DataFrame, keyed: Callable, width: int = 1, crowd: int | None = None) -> DataFrame:
    """(uid, starts, lengths, crowded): for each text that has any, the ranges whose key occurs at more than one place of the corpus.

    keyed(batch) gives (keys, texts, starts, lengths, places): a key for each range [start, start +
    length) of a text, and the place it stands for; a key counts once for each place. Ranges come
    back in order as int32 bytes; crowded has a byte for each: 1 if more than `crowd` places hold the key.
    """
    wanted = arrow_schema(FOUND)
    crowd = crowd or 1 << 40

    def build(b):
        keys, texts, starts, lengths, places = keyed(b)
        keys = keys.reshape(-1, width)
        # Ranges of one key that stand for the same place count once.
        order = np.lexsort([places, texts, *keys.T[::-1]])
        k, t, p = keys[order], texts[order], places[order]
        same = np.zeros(len(k), bool)
        same[1:] = (k[1:] == k[:-1]).all(axis=1) & (t[1:] == t[:-1]) & (p[1:] == p[:-1])
        counts = np.empty(len(k), np.uint32)
        counts[order] = ~same
        return keys, counts, (b.column("uid").to_numpy(zero_copy_only=False), texts.astype(np.uint32), starts.astype(np.int32), lengths.astype(np.int32))

    def answer(sums):
        return (sums > 1).astype(np.int64) + (sums > crowd)

    def finish(_, arrays, values):
        uids, texts, starts, lengths = arrays
        values = values[:, 0]
        some = np.flatnonzero(values)
        if not len(some):
            return
        some = some[np.lexsort((starts[some], texts[some]))]
        t = texts[some]
        cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        ends = np.r_[cut[1:], len(t)]
        crowded = (values[some] > 1).astype(np.uint8)
        bits = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())
        yield record(wanted, uid=uids[t[cut]], starts=bits(starts[some]), lengths=bits(lengths[some]), crowded=bits(crowded))

    return ask(scratch, docs, build, finish, FOUND, answer, width)


def ints_of(value: bytes | None, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(value, dtype).astype(np.int64) if value else np.empty(0, np.int64)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, range by range."""
    total = int(lengths.sum())
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total) if total else np.empty(0, np.int64)
