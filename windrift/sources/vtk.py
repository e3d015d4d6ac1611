"""Spark data source `vtk`: legacy binary STRUCTURED_POINTS grids, read by layers and written by layers.

    spark.dataSource.register(VtkSource)
    spark.read.format("vtk").option("fields", "u_avg,rho").load(path)
    df.write.format("vtk").option("dims", "20,10,50").option("spacing", "2,2,5").mode("append").save(folder)

A read row is (z, y, x, one column for each scalar, name_x/_y/_z for vectors). A layer block is one
partition and only the wanted fields' bytes are read. Tasks write into their own places
of one new file, batch by batch, so no process holds a grid or a layer; rows in order make few writes.
Paths are those of a file system that all executors mount (a shared folder).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Scalar names of the format, all big-endian; `long` takes four bytes.
KINDS = {"char": ">i1", "unsigned_char": ">u1", "short": ">i2", "unsigned_short": ">u2", "int": ">i4", "unsigned_int": ">u4", "long": ">i4", "unsigned_long": ">u4", "float": ">f4", "double": ">f8"}


@dataclass
class Field:
    name: str
    kind: str
    parts: int
    offset: int

    @property
    def width(self) -> int:
        return np.dtype(KINDS[self.kind]).itemsize * self.parts

    @property
    def columns(self) -> list[str]:
        return [self.name] if self.parts == 1 else [f"{self.name}_{c}" for c in ("x", "y", "z")[: self.parts]] if self.parts <= 3 else [f"{self.name}_{i}" for i in range(self.parts)]


@dataclass
class Header:
    dims: tuple[int, int, int] = (0, 0, 0)
    origin: tuple[float, ...] = (0.0, 0.0, 0.0)
    spacing: tuple[float, ...] = (1.0, 1.0, 1.0)
    fields: list[Field] = field(default_factory=list)


def read_header(path: str) -> Header:
    """The head of a file: sizes, place and where each field's bytes begin. Payloads are passed over, not read."""
    out = Header()
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        if not f.readline().startswith(b"# vtk DataFile"):
            raise ValueError(f"{path} is no legacy VTK file")
        f.readline()
        if f.readline().strip().upper() != b"BINARY":
            raise ValueError(f"{path} is not binary")
        while line := f.readline():
            words = line.decode("ascii", "replace").split()
            key = words[0].upper() if words else ""
            if key == "DATASET" and words[1].upper() != "STRUCTURED_POINTS":
                raise ValueError(f"{path} holds {words[1]}, not STRUCTURED_POINTS")
            elif key == "DIMENSIONS":
                out.dims = tuple(map(int, words[1:4]))
            elif key == "ORIGIN":
                out.origin = tuple(map(float, words[1:4]))
            elif key in ("SPACING", "ASPECT_RATIO"):
                out.spacing = tuple(map(float, words[1:4]))
            elif key in ("SCALARS", "VECTORS"):
                parts = 3 if key == "VECTORS" else int(words[3]) if len(words) > 3 else 1
                if words[2] not in KINDS:
                    raise ValueError(f"{path}: unknown type {words[2]}")
                if key == "SCALARS":
                    at = f.tell()
                    if not f.readline().upper().startswith(b"LOOKUP_TABLE"):
                        f.seek(at)
                new = Field(words[1], words[2], parts, f.tell())
                size = new.width * out.dims[0] * out.dims[1] * out.dims[2]
                if new.offset + size > end:
                    raise ValueError(f"{path}: field {new.name} is cut off")
                out.fields.append(new)
                f.seek(size, 1)
    return out


class Layers(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".vtk"))
    return [path]


class VtkReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def partitions(self):
        block = int(self.options.get("layers", 16))
        out = []
        for p in files_of(self.options["path"]):
            nz = read_header(p).dims[2]
            low, high = int(self.options.get("z_min", 0)), min(nz, int(self.options.get("z_max", nz - 1)) + 1)
            out += [Layers(p, k, min(k + block, high)) for k in range(low, high, block)]
        return out

    def read(self, part: Layers) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        h = read_header(part.path)
        nx, ny, _ = h.dims
        plane = nx * ny
        y, x = np.divmod(np.arange(plane), nx)
        with open(part.path, "rb") as f:
            for z in range(part.low, part.high):
                columns = {"z": np.full(plane, z, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32)}
                for fd in h.fields:
                    if any(c in schema.names for c in fd.columns):
                        f.seek(fd.offset + z * plane * fd.width)
                        v = np.frombuffer(f.read(plane * fd.width), KINDS[fd.kind]).reshape(plane, fd.parts)
                        columns |= {c: v[:, i] for i, c in enumerate(fd.columns)}
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(columns[c.name]).astype(c.type.to_pandas_dtype())) for c in schema], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    cells: int


class VtkWriter(DataSourceArrowWriter):
    """Tasks write their layers straight into their places of one file, which gets its name when all are done.

    Option dims (nx,ny,nz) fixes the places; cells that no row gives stay zero. Option vectors
    (name=a,b,c;...) puts three columns together as one vector field; the others are scalars.
    """

    def __init__(self, options: dict, schema: T.StructType):
        folder, name = options["path"].removeprefix("file://").removeprefix("file:"), options.get("name", "grid")
        if "://" in folder:
            raise ValueError(f"{folder} is no mounted folder")
        self.dims = tuple(int(n) for n in options["dims"].split(","))
        vectors = [v.split("=") for v in options.get("vectors", "").split(";") if v.strip()]
        self.fields = [(n.strip(), [c.strip() for c in cs.split(",")]) for n, cs in vectors]
        inside = {c for _, cs in self.fields for c in cs}
        self.fields += [(f.name, [f.name]) for f in schema if f.name not in ("z", "y", "x") and f.name not in inside]
        self.target = f"{folder}/{name}.vtk"
        self.fresh = f"{folder}/.{name}-{uuid.uuid4().hex}"
        nx, ny, nz = self.dims
        triple = lambda key, default: " ".join(options.get(key, default).split(","))
        head = f"# vtk DataFile Version 3.0\n{name}\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\nORIGIN {triple('origin', '0,0,0')}\nSPACING {triple('spacing', '1,1,1')}\nPOINT_DATA {nx * ny * nz}\n"
        os.makedirs(folder, exist_ok=True)
        self.offsets = []
        with open(self.fresh, "wb") as f:
            f.write(head.encode())
            for field_, parts in self.fields:
                f.write(f"VECTORS {field_} float\n".encode() if len(parts) == 3 else f"SCALARS {field_} float 1\nLOOKUP_TABLE default\n".encode())
                self.offsets.append(f.tell())
                f.seek(4 * len(parts) * nx * ny * nz, 1)
                f.write(b"\n")

    def write(self, batches) -> Written:
        nx, ny, _ = self.dims
        n = 0
        with open(self.fresh, "r+b") as f:
            for b in batches:
                z, y, x = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("z", "y", "x"))
                cell = (z * ny + y) * nx + x
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                runs = np.flatnonzero(np.r_[True, np.diff(cell) != 1, True]) if len(cell) else np.empty(0, int)
                for (_, parts), offset in zip(self.fields, self.offsets, strict=True):
                    values = np.stack([b.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)[order] for c in parts], axis=1).astype(">f4")
                    for i, j in zip(runs, runs[1:], strict=False):
                        f.seek(offset + 4 * len(parts) * cell[i])
                        f.write(values[i:j].tobytes())
                n += len(cell)
        return Written(n)

    def commit(self, messages: list[Written]) -> None:
        os.replace(self.fresh, self.target)

    def abort(self, messages) -> None:
        if os.path.exists(self.fresh):
            os.remove(self.fresh)


class VtkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vtk"

    def schema(self) -> T.StructType:
        wanted = [f.strip() for f in self.options.get("fields", "").split(",") if f.strip()]
        h = read_header(files_of(self.options["path"])[0])
        columns = []
        for f in h.fields:
            if wanted and f.name not in wanted:
                continue
            kind = np.dtype(KINDS[f.kind])
            t = T.DoubleType() if kind.itemsize == 8 else T.FloatType() if kind.kind == "f" else T.LongType() if kind.kind == "u" and kind.itemsize == 4 else T.IntegerType()
            columns += [T.StructField(c, t) for c in f.columns]
        return T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("z", "y", "x")), *columns])

    def reader(self, schema: T.StructType) -> VtkReader:
        return VtkReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> VtkWriter:
        return VtkWriter(self.options, schema)


def meta(path: str) -> dict:
    h = read_header(path)
    return {"nx": h.dims[0], "ny": h.dims[1], "nz": h.dims[2], "origin": h.origin, "spacing": h.spacing, "fields": [f.name for f in h.fields], "bytes": os.path.getsize(path)}
