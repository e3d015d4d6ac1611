"""Decks, loosely written text, and file formats."""

import pytest
from pyspark.sql import functions as F

from windrift.functions import text as X
from windrift.operators import deck
from windrift.operators.filters import same_grids
from windrift.sources import outputs, tables
from windrift.sources.vtk import VtkSource, read_header


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("x", "want"), [("true", True), ("YES", True), ("on", True), ("1", True), ("2", True), ("-0.5", True), ("false", False), ("No", False), ("off", False), ("0", False), ("0.0", False), ("maybe", None), ("", None), ("inf", None), ("nan", None), (None, None)])
def test_truth(spark, x, want):
    assert one(spark, x, X.truth) is want


@pytest.mark.parametrize(("x", "want"), [("7p0", 7.0), ("9,4", 9.4), ("12 %", 12.0), ("3 m/s", 3.0), ("1e3", 1000.0), (".5", 0.5), ("abc", None), ("", None), ("1e999", None)])
def test_number(spark, x, want):
    assert one(spark, x, X.number) == want


@pytest.mark.parametrize(("x", "want"), [("nne", 22.5), ("N", 0.0), ("22", 22.5), ("89.6", 90.0), ("45.6", None), ("359.9", None), ("ALL", None)])
def test_compass(spark, x, want):
    assert one(spark, x, X.compass_degrees) == want


@pytest.mark.parametrize(("x", "want"), [('a = 1 // c', "a = 1"), ('a = "x // y" # z', 'a = "x // y"'), ("# only", ""), ("a = b/c", "a = b/c"), ("http://x", "http:")])
def test_comments(spark, x, want):
    assert one(spark, x, X.stripped_comment) == want


def test_lists_and_pairs(spark):
    assert one(spark, "[1, 2p5, 3]", X.floats) == [1.0, 2.5, 3.0]
    assert one(spark, "[1, x]", X.floats) == []
    assert one(spark, "[9, 2]", X.pair) == [2.0, 9.0] and one(spark, "[9]", X.pair) is None
    assert one(spark, "[a, , 'b c']", X.tokens) == ["a", "b c"]
    assert one(spark, "N100E50.5", X.probe_offset) == [50.5, 100.0] and one(spark, "NNW", X.probe_offset) == [-1.0, 2.0] and one(spark, "N1x", X.probe_offset) is None
    assert one(spark, "1536", lambda c: X.human_bytes(c.cast("bigint"))) == "1.5 KB"


DECK = "// Project\nCase Name = c1\ncasename = 'c2' // again\n// CFD Control\nCell-Size = 4\nvk_inlet_aniso_scale = [1, 2, 3]\n// Domain\ncut_lat_manual = [31, 30.5]\nhigh order = Yes\nz_1imit = 7\nnot an entry\n= 3\n"


def test_deck_is_parsed_repaired_and_written(spark):
    decks = spark.createDataFrame([("d", DECK), ("none", ""), ("null", None)], "deck string, text string")
    entries = deck.parse(decks)
    rows = {(r["key"], r["raw"]): r for r in entries.collect()}
    assert ("cell_size", "4") in rows and rows["cell_size", "4"]["section"] == "cfd" and rows["cell_size", "4"]["known"]
    assert not rows["z_1imit", "7"]["known"] and ("casename", "c2") in rows
    assert deck.duplicates(entries.unionByName(entries.where("key = 'casename'"))).first()["key"] == "casename"
    fixed = {(r["deck"], r["key"]): r for r in deck.repaired(entries, decks).collect()}
    assert fixed["d", "high_order"]["value"] == "true" and fixed["d", "cut_lat_manual"]["value"] == "[30.5, 31.0]"
    assert fixed["none", "base_height"]["filled"] and fixed["d", "z_1imit"]["section"] == "custom"
    text = dict(deck.rendered(deck.repaired(entries, decks)).collect())["d"]
    again = deck.parse(spark.createDataFrame([("d", text)], "deck string, text string"))
    assert {(r["key"], r["raw"]) for r in deck.effective(again).collect()} >= {("casename", "c2"), ("cell_size", "4"), ("high_order", "true"), ("z_1imit", "7")}
    assert text.index("// Project") < text.index("// Domain") < text.index("// CFD Controls") < text.index("// Turbulence inflow")
    assert "vk_inlet_anisotropy = [1, 2, 3]" in text.split("\n")


def test_option_precedence(spark):
    df = spark.createDataFrame([("5", "7"), (None, "7"), ("x", "99"), ("200", None)], "cli string, deck string")
    value, origin = deck.resolved([("cli", X.number(F.col("cli"))), ("deck", X.number(F.col("deck")))], F.lit(12.0), lambda v: v.between(1, 64))
    assert [tuple(r) for r in df.select(value, origin).collect()] == [(5.0, "cli"), (7.0, "deck"), (12.0, "default"), (12.0, "default")]


def test_fields_by_mode():
    assert len(deck.FIELDS) == 77 and {f.section for f in deck.FIELDS} <= set(deck.TITLES)
    assert "inflow" not in {f.key for f in deck.visible(deck.FIELDS, "standard")}
    assert "inflow" in {f.key for f in deck.visible(deck.FIELDS, "dataset")}


def test_vtk_vectors_and_refusals(spark, tmp_path):
    import numpy as np

    spark.dataSource.register(VtkSource)
    p = tmp_path / "a.vtk"
    v = np.arange(24, dtype=">f4")
    head = b"# vtk DataFile Version 3.0\nx\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS 2 2 2\nORIGIN 1 2 3\nSPACING 1 1 5\nPOINT_DATA 8\n"
    p.write_bytes(head + b"VECTORS u_avg float\n" + v.tobytes() + b"\nSCALARS id long 1\nLOOKUP_TABLE default\n" + np.arange(8, dtype=">i4").tobytes() + b"\n")
    rows = spark.read.format("vtk").option("layers", "1").load(str(p)).orderBy("z", "y", "x").collect()
    assert [r["u_avg_y"] for r in rows] == [float(3 * k + 1) for k in range(8)] and [r["id"] for r in rows] == list(range(8))
    assert read_header(str(p)).spacing == (1, 1, 5)
    p.write_bytes(head + b"VECTORS u_avg float\n" + v.tobytes()[:50])
    with pytest.raises(ValueError, match="cut off"):
        read_header(str(p))
    p.write_bytes(b"something else")
    with pytest.raises(ValueError, match="no legacy VTK"):
        read_header(str(p))


def test_boundary_samples_by_name_and_place(spark):
    named = spark.createDataFrame([("1", "2", "3", "4", "5", "6", "bad")], "x string, Y string, z string, U string, v string, W string, t string")
    r = tables.boundary_samples(named).first()
    assert (r["X"], r["w"], r["T"], r["patch"]) == (1.0, 6.0, None, -1)
    seven = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 5.0), (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 290.5)], "_c0 double, _c1 double, _c2 double, _c3 double, _c4 double, _c5 double, _c6 double")
    assert [(r["T"], r["patch"]) for r in tables.boundary_samples(seven).collect()] == [(None, 5), (290.5, -1)]


def test_wind_rose_by_hand(spark):
    rows = [(0, ["site", "x"]), (1, ["dir", "deg", "C1_0p0_2p0", "C2_2p0_4p0", "C3_4p0_inf"]), (2, ["N", "0", "5", "10", "5"]), (3, ["E", "90", "20", "30", "10"]), (4, ["S", "180", "5", "5", "2"]), (5, ["ALL", "", "30", "45", "17"])]
    rose = tables.wind_rose(spark.createDataFrame(rows, "line_no int, cells array<string>"))
    from windrift.operators.aggregates import bin_speeds, direction_weights

    speeds = bin_speeds(rose.select("bin", "lower", "upper").distinct())
    assert {r["bin"]: r["speed"] for r in speeds.collect()} == {1: 1.0, 2: 3.0, 3: 6.0}
    w = {r["angle"]: r for r in direction_weights(rose, speeds, 4.0).collect()}
    assert w[0.0]["p"] == pytest.approx(0.20) and w[0.0]["velocity_weight"] == pytest.approx(0.1625) and w[0.0]["energy_weight"] == pytest.approx(0.171875)


def test_files_are_found_in_order(spark, tmp_path):
    for n in ("case_avg-100.vtk", "case_avg-20.vtk", "case.deck"):
        (tmp_path / n).write_text("x")
    c = tables.catalogue(spark, str(tmp_path)).orderBy("step").collect()
    assert [r["step"] for r in c] == [20, 100]
    assert outputs.find_input(spark, str(tmp_path), "*.nc", "*.deck").endswith("case.deck")
    with pytest.raises(FileNotFoundError):
        outputs.find_input(spark, str(tmp_path), "*.nc")
    assert tables.pick_column(["Height_m", "Area"], "height", "HEIGHT-M") == "Height_m"


def test_grids_must_agree(spark):
    meta = spark.createDataFrame([(1, 2), (1, 2)], "nx int, ny int")
    same_grids(meta, "nx", "ny")
    with pytest.raises(ValueError):
        same_grids(meta.union(spark.createDataFrame([(3, 2)], "nx int, ny int")), "nx", "ny")
