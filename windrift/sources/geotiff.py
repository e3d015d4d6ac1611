"""Spark data source `geotiff`: elevation rasters, read by tiles or strips and written by tiles.

    spark.dataSource.register(GeotiffSource)
    spark.read.format("geotiff").option("bounds", "500000,510000,4000000,4010000").load(path)
    tiled(cells, 256).write.format("geotiff").option("size", "1000,800").mode("append").save("/folder/dem.tif")

A read row is one cell: (row, col, x, y, value), x and y at its centre in the raster's coordinates; more
bands are band1, band2, ... Cells of no data are null. A partition is some tiles (or strips) that meet
the bounds; only their bytes are read. Known are both byte orders, classic and large files, tiles and
strips, no compression, LZW and deflate, with horizontal or floating-point prediction.

A written file holds one band of doubles (or floats) in deflated tiles. Each tile has a slot as large
as it could get, so tasks write theirs in place; a tile's cells must come together (see tiled). Cells
that no row gives have no data. Paths are those of a file system that all executors mount.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from windrift.sources.netcdf import local

#: Fixed values of the format: tag numbers, and the sizes of value types by number.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_COUNTS, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
EPSG_KEYS = (3072, 2048)  # of projected, then of geographic coordinates


@dataclass
class Head:
    order: str = "<"
    tags: dict[int, list] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if self.tags.get(tag) else default

    @property
    def size(self) -> tuple[int, int]:
        """(rows, columns)"""
        return int(self.one(HEIGHT)), int(self.one(WIDTH))

    @property
    def bands(self) -> int:
        return int(self.one(BANDS, 1))

    @property
    def kind(self) -> np.dtype:
        bits, form = int(self.one(BITS, 1)), int(self.one(FORMAT, 1))
        if bits not in (8, 16, 32, 64) or form not in (1, 2, 3):
            raise ValueError(f"cells of {bits} bits in format {form} are not read")
        return np.dtype(f"{self.order}{'uif'[form - 1]}{bits // 8}")

    @property
    def block(self) -> tuple[int, int]:
        """(rows, columns) of a tile or strip."""
        rows, columns = self.size
        if TILE_WIDTH in self.tags:
            return int(self.one(TILE_HEIGHT)), int(self.one(TILE_WIDTH))
        return min(rows, int(self.one(STRIP_ROWS, rows))), columns

    @property
    def blocks(self) -> tuple[int, int]:
        (rows, columns), (r, c) = self.size, self.block
        return -(-rows // r), -(-columns // c)

    @property
    def places(self) -> tuple[list, list]:
        tiled = TILE_WIDTH in self.tags
        return self.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], self.tags[TILE_COUNTS if tiled else STRIP_COUNTS]

    @property
    def transform(self) -> tuple[float, float, float, float, float, float]:
        """(a, b, c, d, e, f): x = a * col + b * row + c and y = d * col + e * row + f at a cell's first corner."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if PIXEL_SCALE in self.tags and TIE_POINT in self.tags:
            (sx, sy), (i, j, _, x, y) = self.tags[PIXEL_SCALE][:2], self.tags[TIE_POINT][:5]
            return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        return 1.0, 0.0, 0.0, 0.0, 1.0, 0.0

    @property
    def epsg(self) -> int | None:
        keys = [int(k) for k in self.tags.get(GEO_KEYS, [])]
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return next((found[k] for k in EPSG_KEYS if k in found), None)

    @property
    def no_data(self) -> float | None:
        text = self.tags.get(NO_DATA)
        try:
            return float(b"".join(text).split(b"\0")[0]) if text else None
        except ValueError:
            return None


def read_head(path: str) -> Head:
    """The first image's tags. Of the file only the directory and the values it points to are read."""
    with open(path, "rb") as f:
        mark = f.read(4)
        order = {b"II": "<", b"MM": ">"}.get(mark[:2])
        large = order is not None and int(np.frombuffer(mark[2:], f"{order}u2")[0]) == 43
        if order is None or not (large or int(np.frombuffer(mark[2:], f"{order}u2")[0]) == 42):
            raise ValueError(f"{path} is no TIFF file")
        number = lambda kind: int(np.frombuffer(f.read(np.dtype(kind).itemsize), f"{order}{kind}")[0])
        if large:
            f.read(4)
        f.seek(number("u8" if large else "u4"))
        h = Head(order)
        inline = 8 if large else 4
        for _ in range(number("u8" if large else "u2")):
            tag, kind, n = number("u2"), number("u2"), number("u8" if large else "u4")
            here = f.tell()
            if kind in TYPES:
                size = n * np.dtype(TYPES[kind]).itemsize
                if size > inline:
                    f.seek(number("u8" if large else "u4"))
                data = f.read(size)
                if len(data) < size:
                    raise ValueError(f"{path}: its directory is cut off")
                h.tags[tag] = np.frombuffer(data, TYPES[kind] if TYPES[kind] == "S1" else f"{order}{TYPES[kind]}").tolist()
            f.seek(here + inline)
    if WIDTH not in h.tags or not (STRIP_OFFSETS in h.tags or TILE_OFFSETS in h.tags):
        raise ValueError(f"{path} holds no image")
    return h


def unlzw(data: bytes) -> bytes:
    """Bytes from the format's LZW codes: most significant bit first, 9 to 12 bits, widened one code early."""
    single = [bytes([i]) for i in range(256)]
    table: list[bytes] = [*single, b"", b""]
    out, width, last = [], 9, None
    bits = held = 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 256:
            table, width, last = [*single, b"", b""], 9, None
            continue
        if code == 257:
            break
        if last is None:
            text = table[code]
        else:
            text = table[code] if code < len(table) else last + last[:1]
            table.append(last + text[:1])
        out.append(text)
        last = text
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def decoded(h: Head, data: bytes, rows: int) -> np.ndarray:
    """[rows, columns, bands] of a tile's or strip's bytes."""
    how, (_, columns) = int(h.one(COMPRESSION, 1)), h.block
    if how == 5:
        data = unlzw(data)
    elif how in (8, 32946):
        data = zlib.decompress(data)
    elif how != 1:
        raise ValueError(f"compression {how} is not read")
    bands = h.bands if int(h.one(PLANES, 1)) == 1 else 1
    size = rows * columns * bands * h.kind.itemsize
    if len(data) < size:
        raise ValueError("a tile is cut off")
    predictor = int(h.one(PREDICTOR, 1))
    if predictor == 3:  # bytes of a row, highest first, each as the step from the one before
        steps = np.frombuffer(data, np.uint8, size).reshape(rows, columns * h.kind.itemsize, bands) if bands > 1 else np.frombuffer(data, np.uint8, size).reshape(rows, -1, 1)
        plain = np.cumsum(steps.reshape(rows, -1, bands), axis=1, dtype=np.uint8).reshape(rows, h.kind.itemsize, columns * bands)
        return np.ascontiguousarray(plain.transpose(0, 2, 1)).view(h.kind.newbyteorder(">")).reshape(rows, columns, bands)
    cells = np.frombuffer(data, h.kind, rows * columns * bands).reshape(rows, columns, bands)
    if predictor == 2:
        cells = np.cumsum(cells, axis=1, dtype=h.kind.newbyteorder("="))
    return cells


class Blocks(InputPartition):
    def __init__(self, path: str, numbers: list[int]):
        self.path, self.numbers = path, numbers


def files_of(path: str) -> list[str]:
    path = local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith((".tif", ".tiff")))
    return [path]


def bounds_of(options: dict) -> tuple[float, float, float, float] | None:
    text = options.get("bounds")
    return tuple(float(v) for v in text.split(",")) if text else None


def centres(h: Head, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d, e, f = h.transform
    return a * (col + 0.5) + b * (row + 0.5) + c, d * (col + 0.5) + e * (row + 0.5) + f


class GeotiffReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema, self.bounds = options, schema, bounds_of(options)

    def partitions(self):
        out = []
        for p in files_of(self.options["path"]):
            h = read_head(p)
            (down, across), (r, c), (rows, columns) = h.blocks, h.block, h.size
            wanted = list(range(down * across))
            if self.bounds:
                x0, x1, y0, y1 = self.bounds
                k = np.arange(down * across)
                edge = [np.stack(v) for v in zip(*(centres(h, np.minimum((k // across + i) * r, rows) - i * 1.0, np.minimum((k % across + j) * c, columns) - j * 1.0) for i in (0, 1) for j in (0, 1)), strict=True)]
                near = (edge[0].max(0) >= x0) & (edge[0].min(0) <= x1) & (edge[1].max(0) >= y0) & (edge[1].min(0) <= y1)
                wanted = k[near].tolist()
            some = max(1, int(self.options.get("cells", 1 << 20)) // (r * c))
            out += [Blocks(p, wanted[i : i + some]) for i in range(0, len(wanted), some)]
        return out or [Blocks("", [])]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not part.numbers:
            return
        schema, h = to_arrow_schema(self.schema), read_head(part.path)
        (rows, columns), (r, c), (down, across) = h.size, h.block, h.blocks
        offsets, counts = h.places
        planes = h.bands if int(h.one(PLANES, 1)) == 2 else 1
        with open(part.path, "rb") as f:
            for k in part.numbers:
                top, left = k // across * r, k % across * c
                high = r if TILE_WIDTH in h.tags else min(r, rows - top)  # tiles are whole, the last strip is not
                parts = []
                for plane in range(planes):
                    at = k + plane * down * across
                    if not counts[at]:  # nothing was written there
                        parts.append(np.full((r, c, h.bands // planes), h.no_data if h.no_data is not None else 0, h.kind.newbyteorder("=")))
                        continue
                    f.seek(int(offsets[at]))
                    parts.append(decoded(h, f.read(int(counts[at])), high))
                cells = np.concatenate(parts, axis=2)[: rows - top, : columns - left]
                row, col = (v.ravel() for v in np.mgrid[top : top + cells.shape[0], left : left + cells.shape[1]])
                x, y = centres(h, row, col)
                flat = cells.reshape(len(row), -1)
                if self.bounds:
                    x0, x1, y0, y1 = self.bounds
                    keep = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
                    row, col, x, y, flat = row[keep], col[keep], x[keep], y[keep], flat[keep]
                flat = flat.astype(h.kind.newbyteorder("="))
                none = np.zeros(flat.shape, bool)
                if h.no_data is not None:
                    none |= np.isnan(flat) if np.isnan(h.no_data) else flat == np.asarray(h.no_data).astype(flat.dtype)
                arrays = {"row": row, "col": col, "x": x, "y": y} | {n: pa.array(flat[:, i], mask=none[:, i]) for i, n in enumerate(band_names(h))}
                yield pa.RecordBatch.from_arrays([(v if isinstance(v := arrays[n.name], pa.Array) else pa.array(v)).cast(n.type) for n in schema], schema=schema)


def band_names(h: Head) -> list[str]:
    return ["value"] if h.bands == 1 else [f"band{i + 1}" for i in range(h.bands)]


@dataclass
class Written(WriterCommitMessage):
    tiles: list[tuple[int, int]]  # (number, bytes)


class GeotiffWriter(DataSourceArrowWriter):
    """Options: size (rows,columns), tile (cells along a side, 256), origin (x,y of the first corner), spacing (x,y),
    epsg, nodata (-9999), kind (double or float)."""

    def __init__(self, options: dict, schema: T.StructType):
        path = local(options["path"])
        self.target = path if path.lower().endswith((".tif", ".tiff")) else f"{path}/{options.get('name', 'raster')}.tif"
        self.rows, self.columns = (int(v) for v in options["size"].split(","))
        self.tile = int(options.get("tile", 256))
        if self.tile % 16:
            raise ValueError("tiles measure a multiple of 16 cells")
        self.none = float(options.get("nodata", -9999))
        self.kind = np.dtype({"double": "<f8", "float": "<f4"}[options.get("kind", "double")])
        self.down, self.across = -(-self.rows // self.tile), -(-self.columns // self.tile)
        raw = self.tile * self.tile * self.kind.itemsize
        self.slot = raw + raw // 1000 + 64  # what deflate may need at most
        (ox, oy), (sx, sy) = ([float(v) for v in options.get(k, d).split(",")] for k, d in (("origin", "0,0"), ("spacing", "1,1")))
        epsg = int(options.get("epsg", 0))
        n = self.down * self.across
        entries = [(WIDTH, "u4", [self.columns]), (HEIGHT, "u4", [self.rows]), (BITS, "u2", [self.kind.itemsize * 8]), (COMPRESSION, "u2", [8]), (262, "u2", [1]), (BANDS, "u2", [1]), (PREDICTOR, "u2", [1]), (TILE_WIDTH, "u4", [self.tile]), (TILE_HEIGHT, "u4", [self.tile])]
        entries += [(TILE_OFFSETS, "u8", [0] * n), (TILE_COUNTS, "u8", [0] * n), (FORMAT, "u2", [3]), (PIXEL_SCALE, "f8", [sx, sy, 0]), (TIE_POINT, "f8", [0, 0, 0, ox, oy, 0])]
        if epsg:
            projected = epsg >= 32000 or epsg < 4000
            entries.append((GEO_KEYS, "u2", [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, EPSG_KEYS[0 if projected else 1], 0, 1, epsg]))
        text = f"{self.none:g}\0".encode()
        entries.append((NO_DATA, "S1", [bytes([c]) for c in text]))
        number = {v: k for k, v in TYPES.items() if k not in (7, 13, 18)}
        # A large file (64-bit places): head, directory, then values that do not fit in it.
        at = 16 + 8 + 20 * len(entries) + 8
        directory, extra = len(entries).to_bytes(8, "little"), b""
        self.at: dict[int, int] = {}
        for tag, kind, values in entries:
            data = b"".join(values) if kind == "S1" else np.array(values, f"<{kind}").tobytes()
            own = 16 + len(directory) + 12
            if len(data) > 8:
                own = at + len(extra)
                extra += data + b"\0" * (-len(data) % 8)
            self.at[tag] = own
            directory += tag.to_bytes(2, "little") + number[kind].to_bytes(2, "little") + len(values).to_bytes(8, "little") + (data.ljust(8, b"\0") if len(data) <= 8 else own.to_bytes(8, "little"))
        self.first = at + len(extra)
        head = b"II" + (43).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"\0\0" + (16).to_bytes(8, "little") + directory + bytes(8) + extra
        folder = os.path.dirname(self.target)
        os.makedirs(folder, exist_ok=True)
        self.fresh = f"{folder}/.{os.path.basename(self.target)}-{uuid.uuid4().hex}"
        with open(self.fresh, "wb") as f:
            f.write(head)

    def write(self, batches) -> Written:
        done, tile, cells = [], None, None

        def close(f):
            if tile is not None:
                data = zlib.compress(cells.astype(self.kind).tobytes())
                f.seek(self.first + tile * self.slot)
                f.write(data)
                done.append((int(tile), len(data)))

        with open(self.fresh, "r+b") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                row, col = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "col"))
                if not (0 <= row.min() and row.max() < self.rows and 0 <= col.min() and col.max() < self.columns):
                    raise ValueError(f"a cell lies outside {self.rows} rows and {self.columns} columns")
                value = b.column("value").cast(pa.float64()).fill_null(self.none).to_numpy(zero_copy_only=False)
                number = row // self.tile * self.across + col // self.tile
                cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True])
                for i, j in zip(cut, cut[1:], strict=False):
                    if number[i] != tile:
                        close(f)
                        tile, cells = number[i], np.full((self.tile, self.tile), self.none)
                    cells[row[i:j] % self.tile, col[i:j] % self.tile] = value[i:j]
            close(f)
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        tiles = sorted(t for m in messages for t in m.tiles)
        if len({k for k, _ in tiles}) < len(tiles):
            self.abort(messages)
            raise ValueError("a tile's cells came apart: deal rows by tiles first (see tiled)")
        counts = np.zeros(self.down * self.across, "<u8")
        counts[[k for k, _ in tiles]] = [n for _, n in tiles]
        with open(self.fresh, "r+b") as f:
            f.seek(self.at[TILE_OFFSETS])
            f.write((self.first + np.arange(len(counts)) * self.slot).astype("<u8").tobytes())
            f.seek(self.at[TILE_COUNTS])
            f.write(counts.tobytes())
        os.replace(self.fresh, self.target)

    def abort(self, messages) -> None:
        if os.path.exists(self.fresh):
            os.remove(self.fresh)


class GeotiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"no raster in {self.options['path']}")
        h = read_head(files[0])
        kind = h.kind
        t = (T.DoubleType() if kind.itemsize == 8 else T.FloatType()) if kind.kind == "f" else T.LongType() if kind.itemsize == 8 or (kind.kind == "u" and kind.itemsize == 4) else T.IntegerType()
        return T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), *(T.StructField(n, t) for n in band_names(h))])

    def reader(self, schema: T.StructType) -> GeotiffReader:
        return GeotiffReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> GeotiffWriter:
        return GeotiffWriter(self.options, schema)


def tiled(cells: DataFrame, tile: int) -> DataFrame:
    """cells (row, col, ...) dealt so that each tile is in one task, its rows together."""
    down, across = F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)
    return cells.repartition(down, across).sortWithinPartitions(down, across, "row", "col")


def meta(path: str) -> dict:
    h = read_head(local(path))
    return {"size": h.size, "block": h.block, "bands": h.bands, "transform": h.transform, "epsg": h.epsg, "nodata": h.no_data, "compression": int(h.one(COMPRESSION, 1))}
