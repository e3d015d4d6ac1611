"""Rasters in every layout that is read, and regions of equal cells against flood filling."""

import zlib

import numpy as np
import pytest

from windrift.operators.overlay import area
from windrift.operators.regions import regions
from windrift.sources import geotiff as G

KINDS = {"u1": 1, "i2": 2, "u2": 1, "i4": 2, "f4": 3, "f8": 3}


def lzw(data: bytes) -> bytes:
    """The format's LZW codes of bytes."""
    table, width, codes = {bytes([i]): i for i in range(256)}, 9, [(256, 9)]
    size, text = 258, b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if text + c in table:
            text += c
            continue
        codes.append((table[text], width))
        table[text + c] = size
        size += 1
        if size == (1 << width) and width < 12:
            width += 1
        elif size == 4095:
            codes.append((256, width))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        text = c
    codes += [(table[text], width)] if text else []
    size += 1
    codes.append((257, width + (size == (1 << width) and width < 12)))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def tiff(cells, order="<", large=False, tile=None, strip=None, compression=1, predictor=1, nodata=None, planes=1):
    """A file of cells [rows, columns, bands]."""
    rows, columns, bands = cells.shape
    kind = cells.dtype.newbyteorder(order)
    r, c = (tile, tile) if tile else (strip or rows, columns)
    blocks = []
    for part in [cells] if planes == 1 else [cells[:, :, i : i + 1] for i in range(bands)]:
        for top in range(0, rows, r):
            for left in range(0, columns, c):
                b = part[top : top + r, left : left + c]
                if tile:
                    b = np.pad(b, ((0, r - b.shape[0]), (0, c - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
                data = b.astype(kind).tobytes()
                if predictor == 3:
                    high = np.ascontiguousarray(b.astype(b.dtype.newbyteorder(">"))).view(np.uint8).reshape(b.shape[0], -1, b.dtype.itemsize).transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                    data = np.concatenate([high[:, :1], np.diff(high, axis=1)], axis=1).astype(np.uint8).tobytes()
                blocks.append(lzw(data) if compression == 5 else zlib.compress(data) if compression in (8, 32946) else data)
    word, half = ("u8", 8) if large else ("u4", 4)
    tags = [(256, "u4", [columns]), (257, "u4", [rows]), (258, "u2", [kind.itemsize * 8] * bands), (259, "u2", [compression]), (277, "u2", [bands]), (284, "u2", [planes]), (317, "u2", [predictor]), (339, "u2", [KINDS[kind.str[1:]]] * bands), (33550, "f8", [30.0, 30.0, 0.0]), (33922, "f8", [0, 0, 0, 1000.0, 5000.0, 0])]
    tags += [(322, "u2", [tile]), (323, "u2", [tile])] if tile else [(278, "u4", [r])]
    tags += [(42113, "S1", f"{nodata}\0")] if nodata is not None else []
    tags += [(324 if tile else 273, word, None), (325 if tile else 279, word, [len(b) for b in blocks])]
    tags.sort()
    number = {v: k for k, v in G.TYPES.items() if k not in (7, 13, 18)}
    start = 16 if large else 8
    size = (8 if large else 2) + len(tags) * (20 if large else 12) + half
    places, at = [], start + size
    for b in blocks:
        places.append(at)
        at += len(b)
    extra, entries = b"", b""
    for tag, t, values in tags:
        values = places if values is None else values
        data = values.encode() if t == "S1" else np.array(values, f"{order}{t}").tobytes()
        own = data.ljust(half, b"\0") if len(data) <= half else np.array(at + len(extra), f"{order}{word}").tobytes()
        extra += data if len(data) > half else b""
        entries += np.array([tag, number[t]], f"{order}u2").tobytes() + np.array(len(values), f"{order}{word}").tobytes() + own
    head = (b"II" if order == "<" else b"MM") + np.array(43 if large else 42, f"{order}u2").tobytes() + (np.array([8, 0], f"{order}u2").tobytes() if large else b"") + np.array(start, f"{order}{word}").tobytes()
    return head + np.array(len(tags), f"{order}{'u8' if large else 'u2'}").tobytes() + entries + bytes(half) + b"".join(blocks) + extra


@pytest.fixture
def source(spark):
    spark.dataSource.register(G.GeotiffSource)
    return spark


LAYOUTS = [
    dict(), dict(order=">"), dict(large=True), dict(strip=7), dict(tile=16), dict(tile=16, compression=8), dict(strip=5, compression=5), dict(tile=16, compression=5, predictor=2, order=">"),
    dict(strip=9, compression=32946, predictor=2, large=True), dict(tile=32, compression=8, predictor=2, planes=2),
]


@pytest.mark.parametrize("kind", list(KINDS))
def test_every_layout(source, tmp_path, kind):
    rng = np.random.default_rng(1)
    cells = (rng.integers(0, 200, (37, 45, 1)).cumsum(axis=0) % 251).astype(kind)
    for k, layout in enumerate([*LAYOUTS, *([dict(tile=16, compression=8, predictor=3), dict(compression=5, predictor=3, order=">")] if kind[0] == "f" else [])]):
        if kind[0] == "f" and layout.get("predictor") == 2:
            continue
        path = tmp_path / f"{k}.tif"
        path.write_bytes(tiff(cells, **layout))
        got = np.full(cells.shape[:2], -1.0)
        for row, col, x, y, value in source.read.format("geotiff").option("cells", "500").load(str(path)).toPandas().itertuples(index=False):
            got[row, col] = value
            assert (x, y) == (1000 + 30 * (col + 0.5), 5000 - 30 * (row + 0.5))
        assert (got == cells[:, :, 0]).all(), layout


def test_lzw_of_long_data():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"ab" * 9000, rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), rng.integers(0, 3, 80_000).astype(np.uint8).tobytes()):
        assert G.unlzw(lzw(data)) == data


def test_bands_bounds_and_no_data(source, tmp_path):
    cells = np.arange(20 * 30 * 2).reshape(20, 30, 2).astype("i4")
    (tmp_path / "b.tif").write_bytes(tiff(cells, tile=16, compression=8, nodata=64, planes=1))
    df = source.read.format("geotiff").option("bounds", "1090,1200,4800,4940").load(str(tmp_path / "b.tif"))
    got = {(r["row"], r["col"]): (r["band1"], r["band2"]) for r in df.collect()}
    assert set(got) == {(r, c) for r in range(20) for c in range(30) if 1090 <= 1000 + 30 * (c + 0.5) <= 1200 and 4800 <= 5000 - 30 * (r + 0.5) <= 4940}
    assert all(v == tuple(None if x == 64 else x for x in cells[k].tolist()) for k, v in got.items())
    far = source.read.format("geotiff").option("bounds", "0,1,0,1").load(str(tmp_path / "b.tif"))
    assert far.count() == 0


def test_bytes_of_other_tiles_are_not_read(source, tmp_path):
    cells = np.arange(64 * 64).reshape(64, 64, 1).astype("f8")
    data = tiff(cells, tile=32)
    (tmp_path / "whole.tif").write_bytes(data)
    h = G.read_head(str(tmp_path / "whole.tif"))
    spoilt = bytearray(tiff(cells, tile=32, compression=8))
    (tmp_path / "c.tif").write_bytes(spoilt)
    h = G.read_head(str(tmp_path / "c.tif"))
    at = int(h.places[0][3])
    spoilt[at : at + 20] = b"x" * 20  # the last tile cannot be decoded
    (tmp_path / "c.tif").write_bytes(spoilt)
    assert source.read.format("geotiff").option("bounds", "1000,1900,4100,5000").load(str(tmp_path / "c.tif")).count() == 30 * 30
    with pytest.raises(Exception, match="decompress"):
        source.read.format("geotiff").load(str(tmp_path / "c.tif")).count()


@pytest.mark.parametrize("parts", [1, 9])
def test_written_tiles_come_back(source, tmp_path, parts):
    rng = np.random.default_rng(3)
    cells = [(int(r), int(c), None if (r + c) % 11 == 0 else float(rng.random())) for r in range(50) for c in range(70) if not (r < 16 and c < 16)]
    df = source.createDataFrame(cells, "row int, col int, value double").repartition(parts)
    G.tiled(df, 16).write.format("geotiff").option("size", "50,70").option("tile", 16).option("epsg", 32650).option("origin", "10,20").option("spacing", "2,3").mode("append").save(str(tmp_path / "w.tif"))
    said = G.meta(str(tmp_path / "w.tif"))
    assert said["epsg"] == 32650 and said["transform"] == (2.0, 0.0, 10.0, 0.0, -3.0, 20.0) and said["nodata"] == -9999
    got = {(r["row"], r["col"]): r["value"] for r in source.read.format("geotiff").load(str(tmp_path / "w.tif")).collect()}
    assert len(got) == 3500 and {k: v for k, v in got.items() if v is not None} == {(r, c): v for r, c, v in cells if v is not None}
    with pytest.raises(Exception, match="came apart"):
        df.repartition(5).write.format("geotiff").option("size", "50,70").option("tile", 64).mode("append").save(str(tmp_path / "x.tif"))


def test_other_files_are_refused(source, tmp_path):
    (tmp_path / "no.tif").write_bytes(b"not a raster at all")
    with pytest.raises(Exception, match="no TIFF"):
        source.read.format("geotiff").load(str(tmp_path / "no.tif"))


def flooded(grid):
    """Region numbers by walking from cell to cell."""
    seen = np.full(grid.shape, -1)
    n = 0
    for start in np.ndindex(grid.shape):
        if seen[start] >= 0 or np.isnan(grid[start]):
            continue
        stack, seen[start] = [start], n
        while stack:
            r, c = stack.pop()
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= q[0] < grid.shape[0] and 0 <= q[1] < grid.shape[1] and seen[q] < 0 and grid[q] == grid[start]:
                    seen[q] = n
                    stack.append(q)
        n += 1
    return seen


@pytest.mark.parametrize("tile,levels", [(8, 2), (5, 3), (64, 2)])
def test_regions_equal_flood_filling(spark, tile, levels):
    from tests.test_overlay import winding

    rng = np.random.default_rng(tile)
    grid = rng.integers(0, levels, (23, 31)).astype(float)
    grid[rng.random(grid.shape) < 0.05] = np.nan
    grid[4:20, 4] = grid[4:20, 26] = grid[4, 4:27] = grid[19, 4:27] = 9.0  # a frame across tiles
    want = flooded(grid)
    df = spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)], "row int, col int, value double")
    out = regions(df, tile, (2.0, 0.0, 100.0, 0.0, -2.0, 50.0)).collect()
    assert len(out) == want.max() + 1 and sum(r["cells"] for r in out) == (want >= 0).sum()
    centres = np.stack([(100 + 2 * (np.arange(31) + 0.5))[None, :].repeat(23, 0).ravel(), (50 - 2 * (np.arange(23) + 0.5))[:, None].repeat(31, 1).ravel()], axis=1)
    seen = np.full(grid.shape, -1)
    for k, r in enumerate(out):
        rings = [np.array([(p["x"], p["y"]) for p in ring]) for ring in r["rings"]]
        assert area(rings[0][:-1]) > 0 and all(area(h[:-1]) < 0 for h in rings[1:]) and sum(area(h[:-1]) for h in rings) == 4 * r["cells"]
        inside = sum(winding(h[:-1], centres) for h in rings).reshape(grid.shape) == 1
        assert inside.sum() == r["cells"] and (grid[inside] == r["value"]).all() and len(set(want[inside].tolist())) == 1
        seen[inside] = k
    assert (seen >= 0).sum() == (want >= 0).sum()
