"""Spark data source `netcdf`: classic NetCDF files (CDF-1, CDF-2 and CDF-5), read by hyperslab and written in place.

    spark.dataSource.register(NetcdfSource)
    spark.read.format("netcdf").option("variables", "U,T").option("ranges", "bottom_top=0:4").load(path)
    df.write.format("netcdf").option("dims", "time=*24,y=100,x=200").mode("append").save("/folder/cube.nc")

A read row is one cell of the variables' common grid: the cell's index along each dimension, then one
column for each variable. Variables over fewer of these dimensions (coordinates, terrain) are repeated
along the others; one named like a dimension comes as <name>_value. Packed values are unpacked
(scale_factor, add_offset), fill and missing values are null, text is cut from its last dimension.
Partitions are runs of cells; of a file only its head and the wanted variables' bytes in the wanted
ranges are read. With option pushdown, filters on dimensions narrow the ranges too; that takes
spark.sql.python.filterPushdown.enabled.

Writing takes one row for each cell: index columns named like the dimensions, the other columns are
variables. Tasks write into their places of one new file, which gets its name when all cells are there.
Paths are those of a file system that all executors mount (a shared folder).
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Fixed values of the format: external types by number, and the fill value of each.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NAMES = {"byte": 1, "char": 2, "short": 3, "int": 4, "float": 5, "double": 6, "ubyte": 7, "ushort": 8, "uint": 9, "int64": 10, "uint64": 11}
FILLS = {1: -127, 2: 0, 3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36, 7: 255, 8: 65535, 9: 4294967295, 10: -9223372036854775806, 11: 18446744073709551614}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: int
    attributes: dict
    begin: int = 0
    record: bool = False

    @property
    def text(self) -> bool:
        return self.kind == 2

    @property
    def grid(self) -> tuple[str, ...]:
        """The dimensions of its cells: a text's last one is within the cell."""
        return self.dims[:-1] if self.text and self.dims else self.dims

    @property
    def packed(self) -> bool:
        return "scale_factor" in self.attributes or "add_offset" in self.attributes


@dataclass
class Head:
    version: int = 1
    records: int = 0
    dims: dict[str, int] = field(default_factory=dict)
    unlimited: str | None = None
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    stride: int = 0  # bytes from a record to the next

    def shape(self, names) -> tuple[int, ...]:
        return tuple(self.records if n == self.unlimited else self.dims[n] for n in names)

    def cell(self, v: Variable) -> int:
        """Bytes of a cell of a variable."""
        return np.dtype(KINDS[v.kind]).itemsize * (self.dims[v.dims[-1]] if v.text and v.dims else 1)

    def within(self, v: Variable) -> int:
        """Bytes of a variable, or of its part of a record, before padding."""
        return np.dtype(KINDS[v.kind]).itemsize * math.prod(self.dims[d] for d in v.dims if d != self.unlimited)

    def offsets(self, v: Variable, index: dict[str, np.ndarray], n: int) -> np.ndarray:
        """Where the bytes of n cells begin, from their indices along the dimensions."""
        at, step = np.full(n, v.begin, np.int64), self.cell(v)
        for d in reversed(v.grid):
            if d == self.unlimited:
                at += index[d] * self.stride
            else:
                at += index[d] * step
                step *= self.dims[d]
        return at


def _padded(n: int) -> int:
    return -(-n // 4) * 4


class _Reader:
    def __init__(self, f, path: str):
        self.f, self.path = f, path
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3:] not in (b"\x01", b"\x02", b"\x05"):
            raise ValueError(f"{path} is no classic NetCDF file" + (" (HDF5-based files are not read)" if magic[1:4] == b"HDF" else ""))
        self.version = magic[3]
        self.size = ">i8" if self.version == 5 else ">i4"

    def take(self, n: int) -> bytes:
        data = self.f.read(n)
        if len(data) < n:
            raise ValueError(f"{self.path}: its head is cut off")
        return data

    def number(self, kind: str | None = None) -> int:
        kind = kind or self.size
        return int(np.frombuffer(self.take(np.dtype(kind).itemsize), kind)[0])

    def name(self) -> str:
        n = self.number()
        return self.take(_padded(n))[:n].decode("utf-8")

    def entries(self, tag: int) -> int:
        found, n = self.number(">i4"), self.number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError(f"{self.path}: a list of another kind where {tag} belongs")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.entries(ATTRIBUTES)):
            name, kind, n = self.name(), self.number(">i4"), self.number()
            size = n * np.dtype(KINDS[kind]).itemsize
            data = self.take(_padded(size))[:size]
            values = data.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(data, KINDS[kind]).tolist()
            out[name] = values[0] if kind != 2 and n == 1 else values
        return out


def read_head(path: str) -> Head:
    """Dimensions, attributes and where each variable's bytes lie. Nothing else of the file is read."""
    with open(path, "rb") as f:
        r = _Reader(f, path)
        h = Head(r.version)
        records = r.number()
        names = []
        for _ in range(r.entries(DIMENSIONS)):
            name, n = r.name(), r.number()
            names.append(name)
            h.dims[name] = n
            if n == 0:
                h.unlimited = name
        h.attributes = r.attributes()
        for _ in range(r.entries(VARIABLES)):
            name = r.name()
            dims = tuple(names[r.number()] for _ in range(r.number()))
            attributes, kind = r.attributes(), r.number(">i4")
            r.number()  # its size follows from the dimensions
            v = Variable(name, dims, kind, attributes, r.number(">i4" if r.version == 1 else ">i8"))
            v.record = bool(dims) and dims[0] == h.unlimited
            h.variables[name] = v
    parts = [v for v in h.variables.values() if v.record]
    # A single record variable is not padded.
    h.stride = h.within(parts[0]) if len(parts) == 1 else sum(_padded(h.within(v)) for v in parts)
    if records == -1 and parts:  # written as a stream: as many as the file holds
        records = (os.path.getsize(path) - min(v.begin for v in parts)) // max(1, h.stride)
    h.records = max(0, records)
    return h


def local(path: str) -> str:
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{path} is no mounted folder")
    return path


def files_of(path: str) -> list[str]:
    path = local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".nc", ".cdf", ".nc3")))
    return [path]


def grid_of(h: Head, wanted: list[str]) -> tuple[tuple[str, ...], list[Variable]]:
    """(dimensions, variables): the wanted variables, or all that fit the grid of most dimensions, and their common grid."""
    missing = [n for n in wanted if n not in h.variables]
    if missing:
        raise ValueError(f"no variable {', '.join(missing)}; there are {', '.join(h.variables)}")
    some = [h.variables[n] for n in wanted] or list(h.variables.values())
    dims = max((v.grid for v in some), key=len, default=())
    inside = lambda v: len(set(v.grid)) == len(v.grid) and all(d in dims for d in v.grid)
    if wanted and not all(map(inside, some)):
        raise ValueError(f"variables over other dimensions than {dims}: {[v.name for v in some if not inside(v)]}")
    return dims, [v for v in some if inside(v)]


def ranges_of(text: str) -> dict[str, tuple[int, int]]:
    """Ranges `dim=first:last, ...`, both ends included; either may be left out, a single number is both."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, both = part.partition("=")
        low, colon, high = both.partition(":")
        out[name.strip()] = (int(low) if low.strip() else 0, (int(high) if high.strip() else 1 << 62) if colon else int(low))
    return out


class Cells(InputPartition):
    """Cells first to last (exclusive) of a file's slab."""

    def __init__(self, path: str, slab: list[tuple[str, int, int]], first: int, last: int):
        self.path, self.slab, self.first, self.last = path, slab, first, last


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.wanted = [v.strip() for v in options.get("variables", "").split(",") if v.strip()]
        self.ranges = ranges_of(options.get("ranges", ""))

    def partitions(self):
        size = int(self.options.get("cells", 1 << 20))
        out = []
        for p in files_of(self.options["path"]):
            h = read_head(p)
            dims, _ = grid_of(h, self.wanted)
            unknown = set(self.ranges) - set(dims)
            if unknown:
                raise ValueError(f"{p}: ranges of {', '.join(sorted(unknown))}, but the grid is {dims}")
            slab = []
            for d, n in zip(dims, h.shape(dims), strict=True):
                low, high = self.ranges.get(d, (0, n - 1))
                slab.append((d, max(0, low), max(0, min(high, n - 1) - max(0, low) + 1)))
            total = math.prod(n for _, _, n in slab)
            out += [Cells(p, slab, a, min(a + size, total)) for a in range(0, total, size)]
        return out or [Cells("", [], 0, 0)]

    def read(self, part: Cells) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if part.first >= part.last:
            return
        schema = to_arrow_schema(self.schema)
        h = read_head(part.path)
        dims, variables = grid_of(h, self.wanted)
        column = {v.name: f"{v.name}_value" if v.name in dims else v.name for v in variables}
        with open(part.path, "rb") as f:
            for a in range(part.first, part.last, 1 << 16):
                n = min(1 << 16, part.last - a)
                place = np.unravel_index(np.arange(a, a + n), [s for _, _, s in part.slab]) if part.slab else ()
                index = {d: i + low for (d, low, _), i in zip(part.slab, place, strict=True)}
                arrays = {d: i.astype(np.int32) for d, i in index.items()}
                for v in variables:
                    if column[v.name] in schema.names:
                        arrays[column[v.name]] = values_of(f, h, v, h.offsets(v, index, n))
                yield pa.RecordBatch.from_arrays([x if isinstance(x := arrays[c.name], pa.Array) else pa.array(x, type=c.type) for c in schema], schema=schema)


class PushingReader(NetcdfReader):
    """A reader that Spark hands filters; it refuses to run where Spark may not (spark.sql.python.filterPushdown.enabled)."""

    def pushFilters(self, filters):
        dims = set(grid_of(read_head(files_of(self.options["path"])[0]), self.wanted)[0])
        for f in filters:
            name, value = (f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None), getattr(f, "value", None)
            low, high = self.ranges.get(name, (0, 1 << 62))
            if name in dims and isinstance(value, int) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, value - isinstance(f, LessThan))
                self.ranges[name] = (low, high)
            else:
                yield f


def values_of(f, h: Head, v: Variable, at: np.ndarray) -> pa.Array:
    """The values of cells at byte places: every run of places is one read, repeated places are read once."""
    size = h.cell(v)
    if not size:
        return pa.array([""] * len(at), pa.string())
    places, back = (at, None) if (np.diff(at) == size).all() else np.unique(at, return_inverse=True)
    cut = np.flatnonzero(np.r_[True, np.diff(places) != size, True])
    pieces = []
    for i, j in zip(cut, cut[1:], strict=False):
        f.seek(int(places[i]))
        pieces.append(f.read(int(j - i) * size))
        if len(pieces[-1]) < (j - i) * size:
            raise ValueError(f"variable {v.name} is cut off")
    data = b"".join(pieces)
    if v.text:
        texts = [t.rstrip(b"\0 ").decode("utf-8", "replace") for t in np.frombuffer(data, f"S{size}").tolist()]
        return pa.array(texts if back is None else [texts[i] for i in back], pa.string())
    raw = np.frombuffer(data, KINDS[v.kind])
    raw = raw.astype(raw.dtype.newbyteorder("=")) if back is None else raw[back].astype(raw.dtype.newbyteorder("="))
    none = np.zeros(len(raw), bool)
    for name in ("_FillValue", "missing_value"):
        if name in v.attributes:
            for x in np.atleast_1d(v.attributes[name]):
                none |= raw == np.asarray(x).astype(raw.dtype) if np.isfinite(float(x)) else np.isnan(raw) if raw.dtype.kind == "f" else False
    if "_FillValue" not in v.attributes and v.kind not in (1, 7):
        none |= raw == np.asarray(FILLS[v.kind]).astype(raw.dtype)
    if v.packed:
        raw = raw.astype(np.float64) * float(v.attributes.get("scale_factor", 1)) + float(v.attributes.get("add_offset", 0))
    elif v.kind in (7, 8, 9):
        raw = raw.astype(np.int64 if v.kind == 9 else np.int32)
    elif v.kind == 11:
        raw = raw.astype(np.float64)
    return pa.array(raw, mask=none)


def column_type(v: Variable) -> T.DataType:
    if v.text:
        return T.StringType()
    if v.packed:
        return T.DoubleType()
    return {1: T.ByteType(), 3: T.ShortType(), 4: T.IntegerType(), 5: T.FloatType(), 6: T.DoubleType(), 7: T.IntegerType(), 8: T.IntegerType(), 9: T.LongType(), 10: T.LongType(), 11: T.DoubleType()}[v.kind]


# ---------------------------------------------------------------- writing


def _number(n: int, kind: str) -> bytes:
    return np.array(n, kind).tobytes()


def head_bytes(h: Head) -> bytes:
    """The head of a file; begins and sizes of variables are set in h first. Its length does not depend on their values."""
    size, place = (">i8" if h.version == 5 else ">i4"), (">i4" if h.version == 1 else ">i8")
    name = lambda s: _number(len(s.encode()), size) + s.encode().ljust(_padded(len(s.encode())), b"\0")
    some = lambda tag, items: (_number(tag, ">i4") + _number(len(items), size) if items else _number(0, ">i4") + _number(0, size)) + b"".join(items)

    def attribute(key, value, own: int | None):
        if isinstance(value, str):
            kind, n, data = 2, len(value.encode()), value.encode()
        else:
            many = value if isinstance(value, list) else [value]
            kind = own if key in ("_FillValue", "missing_value") and own else 4 if all(isinstance(x, int) and abs(x) < 2**31 for x in many) else 6
            n, data = len(many), np.array(many, KINDS[kind]).tobytes()
        return name(key) + _number(kind, ">i4") + _number(n, size) + data.ljust(_padded(len(data)), b"\0")

    order = list(h.dims)
    out = b"CDF" + bytes([h.version]) + _number(h.records, size)
    out += some(DIMENSIONS, [name(d) + _number(n, size) for d, n in h.dims.items()])
    out += some(ATTRIBUTES, [attribute(k, v, None) for k, v in h.attributes.items()])
    variables = []
    for v in h.variables.values():
        part = min(_padded(h.within(v)), 2**31 - 1) if h.version < 5 else _padded(h.within(v))
        variables.append(name(v.name) + _number(len(v.dims), size) + b"".join(_number(order.index(d), size) for d in v.dims) + some(ATTRIBUTES, [attribute(k, x, v.kind) for k, x in v.attributes.items()]) + _number(v.kind, ">i4") + _number(part, size) + _number(v.begin, place))
    return out + some(VARIABLES, variables)


def laid_out(h: Head) -> int:
    """Give every variable its place, fixed ones first, then the records; returns the file's length."""
    fixed, parts = [v for v in h.variables.values() if not v.record], [v for v in h.variables.values() if v.record]
    h.stride = h.within(parts[0]) if len(parts) == 1 else sum(_padded(h.within(v)) for v in parts)
    whole = sum(_padded(h.within(v)) for v in fixed) + h.stride * h.records
    if any(v.kind >= 7 for v in h.variables.values()) or any(h.within(v) >= 2**32 - 4 for v in h.variables.values()):
        h.version = 5
    else:
        h.version = 1 if whole < 2**31 - (1 << 20) else 2
    at = len(head_bytes(h))
    for v in fixed + parts:
        v.begin = at
        at += _padded(h.within(v))
    return (parts[0].begin if parts else at) + h.stride * h.records


@dataclass
class Written(WriterCommitMessage):
    cells: int


class NetcdfWriter(DataSourceArrowWriter):
    """Options: dims (`name=size` in order, `name=*size` for the record dimension, which comes first), and as JSON
    attributes ({variable or "" for the file: {name: value}}), types ({variable: byte, short, int, float, double, ...
    or charN}), over ({variable: [dimensions]} for those that do not vary along all), scalars ({name: attributes} of
    variables without dimensions, such as a coordinate system)."""

    def __init__(self, options: dict, schema: T.StructType):
        path = local(options["path"])
        self.target = path if path.endswith((".nc", ".cdf", ".nc3")) else f"{path}/{options.get('name', 'data')}.nc"
        h = self.head = Head()
        for part in options["dims"].split(","):
            name, _, n = part.strip().partition("=")
            if n.startswith("*"):
                if h.dims:
                    raise ValueError("the record dimension comes first")
                h.unlimited, h.records, h.dims[name] = name, int(n[1:]), 0
            else:
                h.dims[name] = int(n)
        self.order = list(h.dims)
        attributes, types, over, scalars = (json.loads(options.get(k, "{}")) for k in ("attributes", "types", "over", "scalars"))
        h.attributes = attributes.get("", {})
        usual = {T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "int64", T.FloatType: "float", T.BooleanType: "byte"}
        self.columns = [f.name for f in schema if f.name not in self.order]
        for f in schema:
            if f.name in self.order:
                continue
            kind = types.get(f.name) or usual.get(type(f.dataType), "double")
            dims = tuple(over.get(f.name, self.order))
            name = f.name.removesuffix("_value") if f.name.removesuffix("_value") in self.order else f.name
            if kind.startswith("char"):
                h.dims[f"{name}_length"] = int(kind[4:])
                dims, kind = (*dims, f"{name}_length"), "char"
            h.variables[f.name] = Variable(name, dims, NAMES[kind], dict(attributes.get(name, {})), record=bool(dims) and dims[0] == h.unlimited)
        for name, own in scalars.items():
            h.variables[name] = Variable(name, (), 4, own)
        self.cells = math.prod(h.shape(self.order))
        length = laid_out(h)
        folder = os.path.dirname(self.target)
        os.makedirs(folder, exist_ok=True)
        self.fresh = f"{folder}/.{os.path.basename(self.target)}-{uuid.uuid4().hex}"
        with open(self.fresh, "wb") as f:
            f.write(head_bytes(h))
            f.truncate(length)

    def coded(self, v: Variable, column: pa.Array) -> np.ndarray:
        """The values of a column as their bytes in the file, one row each."""
        if v.text:
            size = self.head.cell(v)
            return np.array([(t or "").encode()[:size] for t in column.cast(pa.string()).to_pylist()], f"S{size}").view(np.uint8).reshape(len(column), size)
        none = np.asarray(column.is_null())
        kind = np.dtype(KINDS[v.kind])
        fill = v.attributes.get("_FillValue", FILLS[v.kind])
        if v.packed or kind.kind == "f":
            x = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            if v.packed:
                x = (x - v.attributes.get("add_offset", 0)) / v.attributes.get("scale_factor", 1)
            if kind.kind != "f":
                none |= ~np.isfinite(x)
                x = np.rint(np.where(none, 0, x))
                least, most = np.iinfo(kind).min, np.iinfo(kind).max
                if len(x) and (x.min() < least or x.max() > most):
                    raise ValueError(f"values of {v.name} do not fit its packing")
            x = x.astype(kind)
        else:
            x = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        x[none] = np.asarray(fill).astype(kind)
        return x.view(np.uint8).reshape(len(x), kind.itemsize)

    def write(self, batches) -> Written:
        h, n = self.head, 0
        with open(self.fresh, "r+b") as f:
            for b in batches:
                index = {d: b.column(d).to_numpy(zero_copy_only=False).astype(np.int64) for d in self.order}
                for d, size in zip(self.order, h.shape(self.order), strict=True):
                    if b.num_rows and not (0 <= index[d].min() and index[d].max() < size):
                        raise ValueError(f"an index of {d} is outside 0..{size - 1}")
                for c in self.columns:
                    v = h.variables[c]
                    at, data = h.offsets(v, index, b.num_rows), self.coded(v, b.column(c))
                    at, first = np.unique(at, return_index=True)  # rows in order make few writes
                    cut = np.flatnonzero(np.r_[True, np.diff(at) != data.shape[1], True]) if len(at) else []
                    for i, j in zip(cut, cut[1:], strict=False):
                        f.seek(int(at[i]))
                        f.write(data[first[i:j]].tobytes())
                n += b.num_rows
        return Written(n)

    def commit(self, messages: list[Written]) -> None:
        n = sum(m.cells for m in messages)
        if n != self.cells:
            self.abort(messages)
            raise ValueError(f"{n} rows for {self.cells} cells: whole grids only (see whole_grid)")
        os.replace(self.fresh, self.target)

    def abort(self, messages) -> None:
        if os.path.exists(self.fresh):
            os.remove(self.fresh)


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no NetCDF file in {self.options['path']}")
        wanted = [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]
        dims, variables = grid_of(read_head(files[0]), wanted)
        return T.StructType([*(T.StructField(d, T.IntegerType()) for d in dims), *(T.StructField(f"{v.name}_value" if v.name in dims else v.name, column_type(v)) for v in variables)])

    def reader(self, schema: T.StructType) -> NetcdfReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else NetcdfReader)(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options, schema)


def whole_grid(cells: DataFrame, dims: dict[str, int]) -> DataFrame:
    """cells with a row for every place of a grid: those that are missing have null values. Rows of one place must not repeat."""
    place, out = F.col("cell"), []
    for name, n in reversed(dims.items()):
        out.append((place % n).cast("int").alias(name))
        place = F.floor(place / n)
    every = cells.sparkSession.range(math.prod(dims.values())).withColumnRenamed("id", "cell").select(*reversed(out))
    return every.join(cells.withColumns({d: F.col(d).cast("int") for d in dims}), list(dims), "left")


def meta(path: str) -> dict:
    """What a file says of itself: dimensions, its attributes, each variable's dimensions and attributes."""
    h = read_head(local(path))
    return {"dims": dict(zip(h.dims, h.shape(h.dims), strict=True)), "unlimited": h.unlimited, "attributes": h.attributes, "variables": {v.name: {"dims": v.dims, "attributes": v.attributes} for v in h.variables.values()}, "bytes": os.path.getsize(local(path))}
