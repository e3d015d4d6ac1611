"""Embedding whitening by a one-sided Jacobi SVD of the centred rows.

Three passes over the vectors. The first sums the whole numbers x = floor(1024 * c) + 100000 of each
dimension exactly. The second compresses the centred rows: each task factors its rows block by block
to one triangle (TSQR), triangles are stacked and factored again in groups of `fan` until one is left.
Plane rotations make the columns of that triangle R orthogonal: their lengths are the standard
deviations times sqrt(n), found without ever squaring R, and the accumulated rotations are the
components. The third pass projects every row; its second moments over the whole table give the
identity error.

Vectors that are null or hold a null or non-finite entry are left out. Vectors of one length are a
fit list of their own; those without entries have no components. Rows that repeat count each; vec_id
may be null or repeat. x is held within a long; deviation is null where the sum is beyond one. A
component without variance (rank deficient, or a single row) has whitened null and stays out of
identity_error, which is null if none is left. An empty table gives no rows. Of the table only vec_id
and embedding are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.llm.common import Scratch, arrow_schema, record


@dataclass(frozen=True)
class Whiten:
    components: int = 8
    block: int = 4096
    fan: int = 32
    scale: float = 1024.0
    shift: int = 100_000


def sound(vector: str = "embedding") -> Column:
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def by_length(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix in double precision) for each length of the vectors of a batch."""
    vectors = batch.column(column)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def whole(x: np.ndarray, how: Whiten) -> np.ndarray:
    """floor(scale * c) + shift as longs, held within a long."""
    x = np.floor(how.scale * x) + how.shift
    top = float(2**63)
    return np.where(x >= top, 2**63 - 1, np.where(x < -top, -(2**63), np.clip(x, -top, top - 1024).astype(np.int64)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S for each entry: (as double, rounded once; exact as long where it is below 2^62, which the double tells)."""
    about = x * float(n) - np.array(sums, np.float64)
    with np.errstate(over="ignore"):
        # Longs wrap, so the difference is right whenever it fits, whatever the product.
        exact = x * np.int64(n) - np.array([((s + 2**63) % 2**64) - 2**63 for s in sums], np.int64)
    return np.where(np.abs(about) < 2.0**62, exact.astype(np.float64), about), exact


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def rotated(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, directions) of the orthogonal columns that plane rotations make of r's, longest first; directions are columns.

    Each round of a sweep rotates disjoint pairs of columns at once; a sweep meets every pair. Done
    when a sweep finds all pairs orthogonal to working precision.
    """
    d = r.shape[1]
    top = float(np.abs(r).max(initial=0.0))
    a, v = (r / top if top else r.copy()), np.eye(d)
    seats = np.arange(d + d % 2)
    eps = np.finfo(float).eps
    turned = top > 0
    for _ in range(60):
        if not turned:
            break
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            some = np.abs(gamma) > eps * np.sqrt(alpha * beta)
            if some.any():
                turned = True
                p, q, ap, aq = p[some], q[some], ap[:, some], aq[:, some]
                zeta = (beta - alpha)[some] / (2 * gamma[some])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order] * top, v[:, order] / np.sqrt((v * v).sum(0))[order]


PARTIAL = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("r", T.BinaryType())])


def compressed(scratch: Scratch, rows: DataFrame, sums: dict[int, tuple[int, list[int]]], how: Whiten) -> DataFrame:
    """(width, part, r): one triangle for each length, of its centred rows."""
    wanted = arrow_schema(PARTIAL)

    def factor(batches):
        from pyspark import TaskContext

        part, held, waiting, count = TaskContext.get().partitionId(), {}, {}, {}

        def fold(d):
            held[d] = triangle(np.concatenate(waiting.pop(d)))
            waiting[d], count[d] = [held[d]], 0

        for b in batches:
            for d, _, x in by_length(b):
                n, s = sums[d]
                for i in range(0, len(x), how.block):
                    centred = deviations(whole(x[i : i + how.block], how), n, s)[0] / n
                    waiting.setdefault(d, []).append(centred)
                    count[d] = count.get(d, 0) + len(centred)
                    if count[d] >= how.block:
                        fold(d)
        for d in list(waiting):
            fold(d)
            yield record(wanted, width=np.array([d], np.int32), part=np.array([part], np.int32), r=pa.array([held[d].tobytes()], pa.binary()))

    def stacked(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        d, some = t.column("width")[0].as_py(), [np.frombuffer(r.as_py()).reshape(-1, t.column("width")[0].as_py()) for r in t.column("r")]
        return pa.table({"width": pa.array([d], pa.int32()), "part": pa.array([t.column("part")[0].as_py() // how.fan], pa.int32()), "r": pa.array([triangle(np.concatenate(some)).tobytes()], pa.binary())}, schema=wanted)

    level = scratch.save(rows.select("embedding").mapInArrow(factor, PARTIAL))
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        below, level = level, scratch.save(level.groupBy("width", F.floor(F.col("part") / how.fan).alias("group")).applyInArrow(stacked, PARTIAL))
        scratch.drop(below)
    return level


def whitened(scratch: Scratch, vectors: DataFrame, how: Whiten = Whiten()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each sound row of vectors (vec_id, embedding) and component."""
    spark, keep = scratch.spark, how.components
    rows = vectors.select("vec_id", "embedding").where(sound() & (F.size("embedding") > 0))

    # Sums of the high and low halves of x, so that none can overflow.
    half = T.StructType([T.StructField(c, T.IntegerType()) for c in ("width", "dim")] + [T.StructField(c, T.LongType()) for c in ("n", "high", "low")])
    half_arrow = arrow_schema(half)

    def halves(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in by_length(b):
                x = whole(x, how)
                total[d] = total.get(d, 0) + np.stack([np.full(d, len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
        for d, v in total.items():
            yield record(half_arrow, width=np.full(d, d, np.int32), dim=np.arange(d, dtype=np.int32), n=v[0], high=v[1], low=v[2])

    found = rows.select("embedding").mapInArrow(halves, half).groupBy("width", "dim").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).orderBy("width", "dim").collect()
    sums: dict[int, tuple[int, list[int]]] = {}
    for r in found:  # one row for each dimension of each length
        sums.setdefault(r["width"], (r["n"], []))[1].append((r["high"] << 32) + r["low"])

    fit_schema = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("component", T.IntegerType()), T.StructField("deviation", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("direction", T.ArrayType(T.DoubleType()))])
    fit_arrow = arrow_schema(fit_schema)

    def fit(t: pa.Table) -> pa.Table:
        d = t.column("width")[0].as_py()
        r = np.frombuffer(t.column("r")[0].as_py()).reshape(-1, d)
        lengths, directions = rotated(r)
        k = min(keep, d)
        trace = float((lengths * lengths).sum())
        fine = lengths > lengths[0] * d * np.finfo(float).eps
        return pa.table(
            {
                "width": pa.array([d] * k, pa.int32()),
                "component": pa.array(range(1, k + 1), pa.int32()),
                "deviation": pa.array([float(v) / sums[d][0] ** 0.5 if ok else None for v, ok in zip(lengths[:k], fine[:k], strict=True)], pa.float64()),
                "explained": pa.array([float(v) ** 2 / trace if trace else None for v in lengths[:k]], pa.float64()),
                "direction": pa.array([directions[:, i].tolist() for i in range(k)], pa.list_(pa.float64())),
            },
            schema=fit_arrow,
        )

    # At most 8 directions a length come to the driver.
    fits = compressed(scratch, rows, sums, how).groupBy("width").applyInArrow(fit, fit_schema).orderBy("width", "component").collect() if sums else []
    basis: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in sums:
        own = [r for r in fits if r["width"] == d]
        basis[d] = np.array([r["direction"] for r in own]).T, np.array([np.nan if r["deviation"] is None else r["deviation"] for r in own])

    out = T.StructType([vectors.schema["vec_id"], T.StructField("width", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))])
    out_arrow = arrow_schema(out)

    def project(batches):
        for b in batches:
            for d, at, x in by_length(b):
                n, s = sums[d]
                about, exact = deviations(whole(x, how), n, s)
                fits_long = (about * about).sum(1) < 2.0**63 * (1 - 1e-9)
                squares = pa.array((exact * exact).sum(1), pa.int64(), mask=~fits_long)
                directions, deviation = basis[d]
                z = about / n @ directions / deviation
                k = z.shape[1]
                z = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k), pa.int32()), pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())))
                yield record(out_arrow, vec_id=b.column("vec_id").take(pa.array(at)), width=np.full(len(x), d, np.int32), n=np.full(len(x), n), deviation=squares, z=z)

    done = scratch.save(rows.mapInArrow(project, out))
    # z is linear in the centred rows, so its products are of centred values.
    cell = lambda i, j: F.abs(F.sum(F.get("z", F.lit(i)) * F.get("z", F.lit(j))) / F.count("*") - (F.avg(F.get("z", F.lit(i))) * F.avg(F.get("z", F.lit(j)))) - int(i == j))
    cells = [cell(i, j).alias(f"c{i}_{j}") for i in range(keep) for j in range(i, keep)]
    errors = {r["width"]: max((v for c, v in r.asDict().items() if c != "width" and v is not None), default=None) for r in done.groupBy("width").agg(*cells).collect()}
    said = spark.createDataFrame([(r["width"], r["component"], r["explained"], errors.get(r["width"])) for r in fits], "width int, component int, explained double, identity_error double")
    long = done.select("vec_id", "width", "n", "deviation", F.posexplode("z").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return long.join(F.broadcast(said), ["width", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
