"""Spark data sources `stl` and `polydata`: triangle meshes, and `shp`: polygon layers with their attributes.

stl rows: (facet, corner, x, y, z). shp rows: (record, rings, and the DBF's columns). Both read
files of a folder that all executors mount; an stl file is read in blocks of facets.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FACET = np.dtype([("normal", "<f4", 3), ("v", "<f4", (3, 3)), ("attribute", "<u2")])
STL = T.StructType([T.StructField("facet", T.LongType()), T.StructField("corner", T.IntegerType()), *(T.StructField(c, T.FloatType()) for c in "xyz")])


class Block(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class StlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = _local(options["path"]), int(options.get("facets", 200_000))

    def partitions(self):
        with open(self.path, "rb") as f:
            f.seek(80)
            (n,) = struct.unpack("<I", f.read(4))
        if os.path.getsize(self.path) < 84 + 50 * n:
            raise ValueError(f"{self.path} is cut off")
        return [Block(self.path, k, min(k + self.block, n)) for k in range(0, n, self.block)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        v = np.fromfile(part.path, FACET, part.high - part.low, offset=84 + 50 * part.low)["v"].reshape(-1, 3)
        n = len(v)
        yield pa.RecordBatch.from_arrays([pa.array(part.low + np.arange(n) // 3), pa.array((np.arange(n) % 3).astype(np.int32)), *(pa.array(v[:, i].astype(np.float32)) for i in range(3))], schema=to_arrow_schema(STL))


def corners_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(facet numbers, [facet, corner, axis]) of a batch of (facet, corners)."""
    points = batch.column("corners").flatten()
    return batch.column("facet").to_numpy(zero_copy_only=False), np.stack([points.field(c).cast(pa.float32()).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1).reshape(-1, 3, 3)


class MeshWriter(DataSourceArrowWriter):
    """Tasks write facets straight into their places of one file. Option facets: how many there are, numbered from 0."""

    def __init__(self, options: dict):
        self.target = _local(options["path"])
        if "://" in self.target:
            raise ValueError(f"{self.target} is no mounted folder")
        self.fresh = f"{self.target}.{uuid.uuid4().hex}"
        self.facets = int(options["facets"])
        os.makedirs(os.path.dirname(self.target), exist_ok=True)
        with open(self.fresh, "wb") as f:
            self.prepare(f)

    def commit(self, messages) -> None:
        os.replace(self.fresh, self.target)

    def abort(self, messages) -> None:
        if os.path.exists(self.fresh):
            os.remove(self.fresh)


def in_runs(at: np.ndarray):
    """(order, [(first, last, place)]): rows in order of their places, and the runs of places next to each other."""
    order = np.argsort(at, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(at[order]) != 1, True]) if len(at) else np.empty(0, int)
    return order, [(i, j, int(at[order[i]])) for i, j in zip(cut, cut[1:], strict=False)]


class StlWriter(MeshWriter):
    def prepare(self, f) -> None:
        f.write(b"\0" * 80 + struct.pack("<I", self.facets))
        f.truncate(84 + 50 * self.facets)

    def write(self, batches) -> WriterCommitMessage:
        with open(self.fresh, "r+b") as f:
            for b in batches:
                at, p = corners_of(b)
                normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
                size = np.linalg.norm(normal, axis=1, keepdims=True)
                rows = np.zeros(len(at), FACET)
                rows["normal"], rows["v"] = np.divide(normal, size, out=normal, where=size > 0), p
                order, runs = in_runs(at)
                for i, j, place in runs:
                    f.seek(84 + 50 * place)
                    f.write(rows[order[i:j]].tobytes())
        return WriterCommitMessage()


class PolyWriter(MeshWriter):
    """Legacy binary VTK POLYDATA: three points of its own for each facet, then the facets as polygons."""

    def prepare(self, f) -> None:
        n = self.facets
        f.write(f"# vtk DataFile Version 3.0\nmesh\nBINARY\nDATASET POLYDATA\nPOINTS {3 * n} float\n".encode())
        self.points = f.tell()
        f.seek(36 * n, 1)
        f.write(f"\nPOLYGONS {n} {4 * n}\n".encode())
        self.polygons = f.tell()
        f.seek(16 * n, 1)
        f.write(b"\n")

    def write(self, batches) -> WriterCommitMessage:
        with open(self.fresh, "r+b") as f:
            for b in batches:
                at, p = corners_of(b)
                order, runs = in_runs(at)
                for i, j, place in runs:
                    k = np.arange(place, place + j - i, dtype=np.int64)[:, None]
                    for offset, rows in ((self.points + 36 * place, p[order[i:j]].astype(">f4")), (self.polygons + 16 * place, np.hstack([np.full_like(k, 3), 3 * k, 3 * k + 1, 3 * k + 2]).astype(">i4"))):
                        f.seek(offset)
                        f.write(rows.tobytes())
        return WriterCommitMessage()


class PolyReader(DataSourceReader):
    """Triangles of a POLYDATA file, in blocks; polygons of more corners are refused."""

    def __init__(self, options: dict):
        self.path, self.block = _local(options["path"]), int(options.get("facets", 200_000))
        with open(self.path, "rb") as f:
            head = [f.readline() for _ in range(4)]
            if not head[0].startswith(b"# vtk DataFile") or head[2].strip() != b"BINARY" or head[3].split()[1:2] != [b"POLYDATA"]:
                raise ValueError(f"{self.path} is no binary POLYDATA file")
            self.n_points = int(f.readline().split()[1])
            self.points = f.tell()
            f.seek(12 * self.n_points + 1, 1)
            words = f.readline().split()
            self.n, numbers = int(words[1]), int(words[2])
            self.polygons = f.tell()
        if numbers != 4 * self.n:
            raise ValueError(f"{self.path} holds polygons that are no triangles")
        if os.path.getsize(self.path) < self.polygons + 16 * self.n:
            raise ValueError(f"{self.path} is cut off")

    def partitions(self):
        return [Block(self.path, k, min(k + self.block, self.n)) for k in range(0, self.n, self.block)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        ids = np.fromfile(part.path, ">i4", 4 * (part.high - part.low), offset=self.polygons + 16 * part.low).reshape(-1, 4)[:, 1:].astype(np.int64).ravel()
        points = np.memmap(part.path, ">f4", "r", self.points, (self.n_points, 3))
        v, n = np.asarray(points[ids]).astype(np.float32), len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(part.low + np.arange(n) // 3), pa.array((np.arange(n) % 3).astype(np.int32)), *(pa.array(v[:, i]) for i in range(3))], schema=to_arrow_schema(STL))


class PolySource(DataSource):
    """Spark data source `polydata`: triangle meshes as VTK files; rows as those of `stl`."""

    @classmethod
    def name(cls) -> str:
        return "polydata"

    def schema(self) -> T.StructType:
        return STL

    def reader(self, schema) -> PolyReader:
        return PolyReader(self.options)

    def writer(self, schema, overwrite: bool) -> PolyWriter:
        return PolyWriter(self.options)


class StlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> T.StructType:
        return STL

    def reader(self, schema) -> StlReader:
        return StlReader(self.options)

    def writer(self, schema, overwrite: bool) -> StlWriter:
        return StlWriter(self.options)


def facets_of(corners: DataFrame) -> DataFrame:
    """(facet, corners) as the stl writer takes them, from (facet, corner, x, y, z); facets without three corners go."""
    rows = corners.groupBy("facet").agg(F.array_sort(F.collect_list(F.struct("corner", "x", "y", "z"))).alias("corners"))
    return rows.where(F.size("corners") == 3)


RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def dbf_fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, header bytes, record bytes, [(name, kind, offset, width)]) of a DBF file."""
    with open(path, "rb") as f:
        head = f.read(32)
        n, size, width = struct.unpack("<IHH", head[4:12])
        fields, at = [], 1
        while (d := f.read(32)) and d[0] != 0x0D and len(d) == 32:
            fields.append((d[:11].split(b"\0")[0].decode("latin-1"), chr(d[11]), at, d[16]))
            at += d[16]
    return n, size, width, fields


class ShpReader(DataSourceReader):
    """Shapes and attributes of one layer, joined by record number; the index file gives each shape's place."""

    def __init__(self, options: dict, schema: T.StructType):
        self.base, self.schema, self.block = os.path.splitext(_local(options["path"]))[0], schema, int(options.get("records", 20_000))

    def partitions(self):
        n = (os.path.getsize(self.base + ".shx") - 100) // 8
        return [Block(self.base, k, min(k + self.block, n)) for k in range(0, n, self.block)]

    def read(self, part: Block):
        _, size, width, fields = dbf_fields(part.path + ".dbf")
        with open(part.path + ".shp", "rb") as shp, open(part.path + ".shx", "rb") as shx, open(part.path + ".dbf", "rb") as dbf:
            for k in range(part.low, part.high):
                shx.seek(100 + 8 * k)
                at, words = struct.unpack(">II", shx.read(8))
                shp.seek(at * 2 + 8)
                body = shp.read(words * 2)
                (kind,) = struct.unpack_from("<i", body)
                rings = []
                if kind in (5, 15, 25):
                    parts, points = struct.unpack_from("<ii", body, 36)
                    starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
                    xy = np.frombuffer(body, "<f8", points * 2, 44 + 4 * parts).reshape(-1, 2)
                    rings = [[(float(x), float(y)) for x, y in xy[a:b]] for a, b in zip(starts, starts[1:], strict=False)]
                dbf.seek(size + width * k)
                row = dbf.read(width)
                values = []
                for _, t, off, w in fields:
                    raw = row[off : off + w].decode("latin-1").strip()
                    try:
                        values.append(float(raw) if t in "NF" else raw)
                    except ValueError:
                        values.append(None)
                yield (k, rings, *values)


class ShpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> T.StructType:
        fields = dbf_fields(os.path.splitext(_local(self.options["path"]))[0] + ".dbf")[3]
        return T.StructType([T.StructField("record", T.LongType()), T.StructField("rings", RINGS), *(T.StructField(n, T.DoubleType() if t in "NF" else T.StringType()) for n, t, _, _ in fields)])

    def reader(self, schema) -> ShpReader:
        return ShpReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShpWriter:
        return ShpWriter(self.options, schema)


@dataclass
class Shapes(WriterCommitMessage):
    part: int
    records: int
    words: int
    box: tuple[float, float, float, float]
    at: str = ""


class ShpWriter(DataSourceArrowWriter):
    """A polygon layer: each task leaves its shapes, index and attributes beside the target, the driver adds up their sizes.

    A layer's three files are the tasks' pieces end to end behind a head, so the last step copies bytes
    and shifts the index; it holds no shape. Rows: rings (closed, outline first) and attributes that are
    numbers or text. Option prj: a coordinate system's text, kept beside the layer. Old files are replaced.
    """

    def __init__(self, options: dict, schema: T.StructType):
        self.base = os.path.splitext(_local(options["path"]))[0]
        if "://" in self.base:
            raise ValueError(f"{self.base} is no mounted folder")
        self.prj, self.work = options.get("prj"), f"{self.base}.{uuid.uuid4().hex}"
        self.columns = [(f.name, "C" if isinstance(f.dataType, T.StringType) else "N") for f in schema if f.name not in ("rings", "record")]
        os.makedirs(os.path.dirname(self.base), exist_ok=True)

    def write(self, batches) -> Shapes:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, records, words, boxes = context.partitionId(), 0, 0, []
        with open(f"{self.work}-{part}-{context.taskAttemptId()}.shp", "wb") as shp, open(f"{self.work}-{part}-{context.taskAttemptId()}.shx", "wb") as shx, open(f"{self.work}-{part}-{context.taskAttemptId()}.dbf", "wb") as dbf:
            for b in batches:
                table = [b.column(n).to_pylist() for n, _ in self.columns]
                for i, rings in enumerate(b.column("rings").to_pylist()):
                    p = np.array([(q["x"], q["y"]) for r in rings or [] for q in r], "<f8").reshape(-1, 2)
                    starts = np.cumsum([0, *(len(r) for r in rings or [])])[:-1].astype("<i4")
                    body = struct.pack("<i4dii", 5, *p.min(axis=0), *p.max(axis=0), len(starts), len(p)) + starts.tobytes() + p.tobytes() if len(p) else struct.pack("<i", 0)
                    boxes += [(*p.min(axis=0), *p.max(axis=0))] if len(p) else []
                    shx.write(struct.pack(">II", words, len(body) // 2))
                    shp.write(struct.pack(">II", records, len(body) // 2) + body)
                    dbf.write(b" " + b"".join((b" " * 24 if v[i] is None else f"{v[i]:>24.10f}".encode()) if t == "N" else str("" if v[i] is None else v[i]).encode("latin-1", "replace")[:80].ljust(80) for (_, t), v in zip(self.columns, table, strict=True)))
                    records, words = records + 1, words + 4 + len(body) // 2
        box = (*np.min(boxes, axis=0)[:2], *np.max(boxes, axis=0)[2:]) if boxes else (np.inf, np.inf, -np.inf, -np.inf)
        return Shapes(part, records, words, tuple(float(v) for v in box), f"{self.work}-{part}-{context.taskAttemptId()}")

    def commit(self, messages) -> None:
        pieces = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        records, words = sum(m.records for m in pieces), sum(m.words for m in pieces)
        some = [m.box for m in pieces if m.box[0] <= m.box[2]] or [(0.0, 0.0, 0.0, 0.0)]
        box = struct.pack("<4d", min(b[0] for b in some), min(b[1] for b in some), max(b[2] for b in some), max(b[3] for b in some)) + struct.pack("<4d", 0, 0, 0, 0)
        head = lambda n: struct.pack(">7I", 9994, 0, 0, 0, 0, 0, n + 50) + struct.pack("<2i", 1000, 5) + box
        width = 1 + sum(24 if t == "N" else 80 for _, t in self.columns)
        table = struct.pack("<4BIHH20x", 3, 124, 1, 1, records, 33 + 32 * len(self.columns), width)
        for n, t in self.columns:
            table += n.encode("latin-1")[:10].ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([24 if t == "N" else 80, 10 if t == "N" else 0]) + b"\0" * 14
        heads = {".shp": head(words), ".shx": head(4 * records), ".dbf": table + b"\x0d"}
        for end, first in heads.items():
            with open(f"{self.work}{end}", "wb") as out:
                out.write(first)
                done, at = 0, 50
                for m in pieces:
                    with open(m.at + end, "rb") as piece:
                        while data := piece.read(8 << 20):  # a multiple of the index's and record heads' size
                            if end == ".shx":
                                rows = np.frombuffer(data, ">u4").reshape(-1, 2).copy()
                                rows[:, 0] += at
                                data = rows.tobytes()
                            out.write(data)
                    done, at = done + m.records, at + m.words
                if end == ".dbf":
                    out.write(b"\x1a")
        if self.prj:
            with open(f"{self.work}.prj", "w") as f:
                f.write(self.prj)
        for end in (*heads, ".prj"):
            if os.path.exists(self.work + end):
                os.replace(self.work + end, self.base + end)
            elif os.path.exists(self.base + end):
                os.remove(self.base + end)
        self.tidy(messages)

    def tidy(self, messages) -> None:
        for m in messages:
            for end in (".shp", ".shx", ".dbf"):
                if m is not None and os.path.exists(m.at + end):
                    os.remove(m.at + end)

    def abort(self, messages) -> None:
        self.tidy(messages)


def prj_of(path: str) -> str | None:
    """The text of the coordinate system beside a layer, if it has one."""
    at = os.path.splitext(_local(path))[0] + ".prj"
    if not os.path.exists(at):
        return None
    with open(at, encoding="latin-1") as f:
        return f.read().strip()
