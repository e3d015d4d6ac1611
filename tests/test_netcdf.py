"""Classic NetCDF files: published bytes, every version and type, records, slabs, pushed filters and faults."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrift.sources import netcdf as N

#: The example file of the format's published specification: short vx(dim) = 3, 1, 4, 1, 5.
TINY = "43444601 00000000 0000000A 00000001 00000003 64696D00 00000005 00000000 00000000 0000000B 00000001 00000002 76780000 00000001 00000000 00000000 00000000 00000003 0000000C 00000050 00030001 00040001 00058001"


@pytest.fixture
def source(spark):
    spark.dataSource.register(N.NetcdfSource)
    return spark


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def save(df, path, dims, **options):
    w = df.write.format("netcdf").option("dims", dims)
    for k, v in options.items():
        w = w.option(k, v if isinstance(v, str) else json.dumps(v))
    w.mode("append").save(str(path))


def test_published_example(source, tmp_path):
    path = tmp_path / "tiny.nc"
    path.write_bytes(bytes.fromhex(TINY))
    assert rows(source.read.format("netcdf").load(str(path))) == [(0, 3), (1, 1), (2, 4), (3, 1), (4, 5)]
    save(source.createDataFrame([(i, v) for i, v in enumerate((3, 1, 4, 1, 5))], "dim int, vx short"), tmp_path / "again.nc", "dim=5")
    # The same head; of the padding after the last value the published file has the fill value, this one zeros.
    assert (tmp_path / "again.nc").read_bytes()[:-2] == bytes.fromhex(TINY)[:-2]


@pytest.mark.parametrize("records", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_round_trip_of_every_type(source, tmp_path, records, parts):
    kinds = {"b": "byte", "s": "short", "i": "int", "l": "int64", "f": "float", "d": "double", "ub": "ubyte", "us": "ushort", "ui": "uint"}
    df = source.range(4 * 3 * 5).select(*(e.cast("int").alias(n) for n, e in (("t", F.expr("id div 15")), ("y", F.expr("id div 5 % 3")), ("x", F.expr("id % 5")))), *((F.when(F.col("id") % 7 > 0, F.col("id") * 2).cast("double" if k in ("float", "double") else "long")).alias(n) for n, k in kinds.items() if n not in ("b", "ub")), (F.col("id") - 30).cast("byte").alias("b"), F.col("id").alias("ub"), F.format_string("é%d", F.col("id")).alias("label"))
    path = tmp_path / "all.nc"
    save(df.repartition(parts), path, "t=*4,y=3,x=5" if records else "t=4,y=3,x=5", types=kinds | {"label": "char5"})
    back = source.read.format("netcdf").option("cells", "17").load(str(path))
    assert rows(back.select(*df.columns)) == rows(df.select(*(F.col(c).cast(back.schema[c].dataType) for c in df.columns)))
    assert N.read_head(str(path)).version == 5 and N.meta(str(path))["dims"]["t"] == 4


def test_single_record_variable_is_not_padded(source, tmp_path):
    df = source.range(9).select(F.expr("id div 3").cast("int").alias("t"), (F.col("id") % 3).cast("int").alias("x"), F.col("id").cast("short").alias("v"))
    save(df, tmp_path / "one.nc", "t=*3,x=3")
    h = N.read_head(str(tmp_path / "one.nc"))
    assert h.stride == 6 and os.path.getsize(tmp_path / "one.nc") == h.variables["v"].begin + 18
    assert rows(source.read.format("netcdf").load(str(tmp_path / "one.nc"))) == rows(df)
    # Written as a stream: the number of records is told by the file's length.
    data = bytearray((tmp_path / "one.nc").read_bytes())
    data[4:8] = b"\xff" * 4
    (tmp_path / "stream.nc").write_bytes(data)
    assert rows(source.read.format("netcdf").load(str(tmp_path / "stream.nc"))) == rows(df)


def test_slabs_fewer_dimensions_packing_and_pushed_filters(source, tmp_path):
    df = source.range(5 * 4 * 6).select(*(e.cast("int").alias(n) for n, e in (("z", F.expr("id div 24")), ("y", F.expr("id div 6 % 4")), ("x", F.expr("id % 6")))), F.when(F.col("id") % 11 > 0, F.col("id") / 10).alias("T"), (F.expr("id div 24") * 2.5).alias("z_value"), (F.expr("id div 6 % 4") * 10 + F.col("id") % 6).cast("int").alias("ground"))
    path = str(tmp_path / "cube.nc")
    save(df.repartition(3), path, "z=*5,y=4,x=6", types={"T": "short"}, over={"z_value": ["z"], "ground": ["y", "x"]}, attributes={"": {"note": "é", "n": [1, 2]}, "T": {"scale_factor": 0.1, "add_offset": 3.0, "_FillValue": -1}}, scalars={"crs": {"epsg": 32650}})
    said = N.meta(path)
    assert said["attributes"] == {"note": "é", "n": [1, 2]} and said["variables"]["crs"]["attributes"] == {"epsg": 32650} and said["variables"]["z"]["dims"] == ("z",)
    want = df.withColumn("T", F.round("T", 6))
    slab = source.read.format("netcdf").option("variables", "T,z,ground").option("ranges", "z=1:3,y=2,x=4:").option("cells", "5").load(path).withColumn("T", F.round("T", 6))
    assert rows(slab.select(*df.columns)) == rows(want.where("z BETWEEN 1 AND 3 AND y = 2 AND x >= 4"))
    assert source.read.format("netcdf").option("variables", "ground").load(path).count() == 24
    assert source.read.format("netcdf").option("ranges", "z=9:").load(path).count() == 0
    source.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = source.read.format("netcdf").option("pushdown", "true").load(path).where("z >= 3 AND y < 2 AND x = 1 AND T > 0").withColumn("T", F.round("T", 6))
        assert rows(pushed.select(*df.columns)) == rows(want.where("z >= 3 AND y < 2 AND x = 1 AND T > 0"))
    finally:
        source.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_bytes_of_other_variables_are_not_read(source, tmp_path):
    df = source.range(1000).select(F.col("id").cast("int").alias("x"), F.col("id").cast("float").alias("a"), F.col("id").cast("float").alias("b"))
    save(df, tmp_path / "two.nc", "x=1000")
    data = (tmp_path / "two.nc").read_bytes()
    h = N.read_head(str(tmp_path / "two.nc"))
    (tmp_path / "cut.nc").write_bytes(data[: h.variables["b"].begin])  # b is gone
    assert source.read.format("netcdf").option("variables", "a").load(str(tmp_path / "cut.nc")).agg(F.sum("a")).first()[0] == 499500
    with pytest.raises(Exception, match="cut off"):
        source.read.format("netcdf").option("variables", "b").load(str(tmp_path / "cut.nc")).count()


def test_several_files_and_missing_cells(source, tmp_path):
    for k in range(3):
        part = source.createDataFrame([(0, k * 1.0), (2, None)], "x int, v double")
        save(N.whole_grid(part, {"x": 3}), tmp_path / f"f{k}.nc", "x=3")
    assert rows(source.read.format("netcdf").load(str(tmp_path))) == sorted([(0, 0.0), (0, 1.0), (0, 2.0)] + [(1, None), (2, None)] * 3, key=repr)


def test_faults_are_told(source, tmp_path):
    (tmp_path / "h5.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(Exception, match="HDF5"):
        source.read.format("netcdf").load(str(tmp_path / "h5.nc")).count()
    df = source.createDataFrame([(0, 1.0)], "x int, v double")
    with pytest.raises(Exception, match="1 rows for 2 cells"):
        save(df, tmp_path / "short.nc", "x=2")
    assert not [f for f in os.listdir(tmp_path) if "short" in f]
    with pytest.raises(Exception, match="outside"):
        save(source.createDataFrame([(5, 1.0)], "x int, v double"), tmp_path / "out.nc", "x=1")
    with pytest.raises(Exception, match="packing"):
        save(source.createDataFrame([(0, 1e9)], "x int, v double"), tmp_path / "pack.nc", "x=1", types={"v": "short"}, attributes={"v": {"scale_factor": 1.0}})
    save(df, tmp_path / "fine.nc", "x=1")
    with pytest.raises(Exception, match="no variable w"):
        source.read.format("netcdf").option("variables", "w").load(str(tmp_path / "fine.nc"))


def test_places_follow_the_layout():
    h = N.Head(dims={"t": 0, "y": 3, "x": 4}, unlimited="t", records=5)
    for name, dims, kind in (("a", ("y", "x"), 6), ("b", ("t", "y"), 3), ("c", ("t",), 1)):
        h.variables[name] = N.Variable(name, dims, kind, {}, record=dims[0] == "t")
    length = N.laid_out(h)
    index = {"t": np.array([4]), "y": np.array([2]), "x": np.array([3])}
    assert h.stride == 8 + 4 and h.offsets(h.variables["b"], index, 1)[0] == h.variables["b"].begin + 4 * 12 + 4
    assert h.offsets(h.variables["a"], index, 1)[0] == h.variables["a"].begin + 8 * 11 and length == h.variables["b"].begin + 60
