"""Cases that a reviewer found."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from windrift.functions.text import fixed
from windrift.operators import aggregates, geometry, graph, joins, overlay, sequences
from windrift.plans import registry
from windrift.sources import outputs
from windrift.streaming import steps


def test_values_at_an_edge_of_a_histogram_fall_where_the_formula_puts_them(spark):
    values = [0.1, 270.01, 300.0, 300.1]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = sorted(min(math.floor((v - 0.1) / (300.0 - 0.1) * 50) + 1, 50) for v in values[:3])
    got = aggregates.fixed_histogram(df, "x", 0.1, 300.0, 50).collect()
    assert sorted(r["bin"] for r in got for _ in range(r["n"])) == want


def test_numbers_are_written_as_printf_rounds_them(spark):
    values = [0.1245, 0.0625, 0.1875, 0.0005, 1234567.0625, -0.0625, 2.0, 0.12349999999999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fixed(F.col("v"), 3)).collect()] == [f"{v:.3f}" for v in values]


def run_on(tmp_path, spark, name, **tables):
    for t, rows in tables.items():
        duckdb.from_arrow(rows).write_parquet(f"{tmp_path}/{t}.parquet")
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, df.collect())), sorted(c.sql(registry.ORACLES[name]).select(*(f'"{x}"' for x in df.columns)).fetchall())


def events(users, values):
    n = len(users)
    return pa.table({"event_id": pa.array(range(n), pa.int64()), "user_id": pa.array(users, pa.int64()), "value": pa.array(values, pa.float64()), "event_type": ["view"] * n})


def test_a_mean_between_two_texts_is_told_as_the_sql_tells_it(spark, tmp_path):
    got, want = run_on(tmp_path, spark, "run_records", events=events([1, 1, 2, 2], [124.0, 125.0, 62.25, 62.75]))
    assert got == want


def test_a_seasons_report_is_the_sqls_where_sums_lie_between_two_texts(spark, tmp_path):
    # One bin a direction: each velocity is an odd multiple of 2.5e-6, which ends in 5 at the seventh place.
    users = [u for u in range(15) for _ in range(2 * u + 101)]
    users += [15] * (100_000 - len(users))
    got, want = run_on(tmp_path, spark, "season_report", events=events(users, [10.0] * len(users)))
    assert got == want


def test_a_grid_at_whose_scale_two_sides_gain_a_cell_is_the_sqls(spark, tmp_path):
    part = duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/part.parquet' WHERE p_partkey IN (540, 17009)").to_arrow_table()
    got, want = run_on(tmp_path, spark, "largest_grids", part=part)
    assert len(got) == 2
    assert got == want


def test_a_keys_steps_count_once_in_any_order_and_over_many_blocks(spark, tmp_path):
    n = 30_000  # more than an Arrow batch holds, in several files, steps falling and some told twice
    source = spark.range(n).select((F.col("id") % 2).alias("k"), (n - F.col("id")).alias("t"), F.when(F.col("id") > 0, (F.col("id") % 1000).cast("double")).alias("v"))
    source.union(source.where("t % 3 = 0")).repartition(3).write.parquet(f"{tmp_path}/in")
    w = steps.welford(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "k", "t", "v")
    q = w.writeStream.outputMode("append").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}"))
    q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("k").agg(F.max_by(F.struct("n", "mean", "m2"), "n").alias("s")).select("k", "s.*").collect()
    want = {r["k"]: r for r in source.groupBy("k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")).collect()}
    assert len(got) == 2
    for r in got:
        assert (r["n"], r["mean"], r["m2"] / r["n"]) == (want[r["k"]]["n"], pytest.approx(want[r["k"]]["mean"]), pytest.approx(want[r["k"]]["var"]))


def test_links_of_a_crowd_of_boxes_are_few_and_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.normal(0, 0.005, (400, 2)), rng.uniform(-0.5, 0.5, (600, 2))])]
    df = spark.createDataFrame(rows, "vec_id bigint, x double, y double")
    boxes = df.select("vec_id", (F.col("x") - 0.01).alias("x0"), (F.col("x") + 0.01).alias("x1"), (F.col("y") - 0.01).alias("y0"), (F.col("y") + 0.01).alias("y1"))
    nodes = boxes.select(F.col("vec_id").alias("node"))
    pairs, links = joins.overlapping(boxes, 0.02), joins.linked(boxes, 0.02)
    assert sorted(graph.components(links, nodes).collect()) == sorted(graph.components(pairs, nodes).collect())
    assert links.count() < 9 * len(rows) < pairs.count()


def test_small_groups_are_dissolved_in_one_pass_and_without_a_broadcast(spark, monkeypatch):
    ranked, numbered = [], overlay.numbered
    monkeypatch.setattr(overlay, "numbered", lambda df, order: (ranked.append(df.count()), numbered(df, order))[1])
    ring = lambda x, y: [[dict(x=float(a), y=float(b)) for a, b in ((x, y), (x + 2, y), (x + 2, y + 1), (x, y + 1), (x, y))]]
    rows = [(i // 3, i, ring(i % 3, 0)) for i in range(900)] + [(None, i, ring(i, 0)) for i in range(900, 1600)] + [(1000, 2000, ring(0, 0))]
    df = spark.createDataFrame(rows, "g bigint, o bigint, rings array<array<struct<x:double,y:double>>>")
    out = overlay.dissolved(df, "g", "o", "rings", 16)
    assert sum(ranked) < 300  # of 1,601 rows: only groups that are cut go on
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["g"]: r["rings"] for r in out.collect()}
    assert out.count() == len(got) == 302
    assert all(max(p["x"] for p in got[k][0]) == 4 and len(got[k][0]) == 5 for k in range(300))
    assert [max(p["x"] for p in got[k][0]) for k in (None, 1000)] == [1601, 2]


def test_long_columns_are_made_to_rise_level_by_level_in_linear_time(spark):
    n = 40_000
    df = spark.range(2 * n).select((F.col("id") % 2).alias("x"), F.expr("id div 2").alias("k"), F.when(F.col("id") > 3, F.expr("double((id div 2) % 7)")).alias("h"))
    got = sequences.strictly_rising(df, ["x"], "k", "h").collect()
    assert len(got) == 2 * n
    last, want = None, {}
    for k in range(n):
        h = float(k % 7) if k > 1 else None
        last = want[k] = last + 1e-3 if last is not None and h <= last else h
    assert all(r["h"] == want[r["k"]] for r in got)


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 1), (0, 1), (0, 0))))
    df = spark.range(0, 100, 1, 1).select("id", ring.alias("ring"), F.array(ring).alias("rings"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    many = spark.sparkContext.defaultParallelism
    for out in (geometry.short_sides(df, "id", "ring"), geometry.extruded(df, "id", "rings", "a", "b"), overlay.resolved(df, ["id"], "rings")):
        assert out.rdd.getNumPartitions() >= many


@pytest.mark.parametrize("name", ["deck_rendering", "deck_repair", "deck_validation", "deck_values", "deck_changes"])
def test_a_deck_is_read_once_and_stays_one_row(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Only changes meet their decks in a shuffle: one of either.
    assert plan.count("Exchange hashpartitioning") == (2 if name == "deck_changes" else 0)
    assert plan.count("\\r?\\n") == 1


def test_tables_of_entries_give_what_whole_decks_give(spark):
    from windrift.operators import deck

    text = "// CFD\nhigh_order = maybe\nCell-Size = 4p5 // m\nodd = '1'\nodd = 2\nn_gpu = [1, 2]"
    d = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "deck string, text string")
    entries, sheets = deck.parse(d), deck.sheets(d)
    changes = spark.createDataFrame([("a", "odd", "3"), ("a", "z_limit", "9"), ("a", "n_gpu", None), ("b", "odd", "1")], "deck string, key string, raw string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    said = rows(deck.validated(entries, d, ["casename"]))
    assert said == rows(deck.validated_sheets(sheets, ["casename"])) == [("a", "fail: missing casename; high_order no boolean; n_gpu no triplet"), ("b", "fail: missing casename"), ("c", "fail: missing casename")]
    assert rows(deck.rendered(deck.repaired(entries, d))) == rows(deck.rendered_sheets(deck.repaired_sheets(sheets)))
    after = rows(deck.written(entries, changes))
    assert after == rows(deck.told(deck.changed(sheets, changes), "entries"))
    assert [(r[0], r[1], r[3], r[4]) for r in after] == [("a", 1, "high_order", "maybe"), ("a", 2, "cell_size", "4p5"), ("a", 4, "odd", "3"), ("a", 7, "z_limit", "9"), ("b", 0, "odd", "1")]


def test_a_place_meets_few_others_on_the_way_to_its_nearest(spark):
    from windrift.operators import quadtree
    from windrift.plans import adapters, joining

    p, q = adapters.points(spark, "/root/testdata/sf0.1"), joining.knn_queries(spark, "/root/testdata/sf0.1")
    t = quadtree.tree(p)
    met = quadtree.candidates(t, q, 12).join(t.places, ["level", "sx", "sy"]).count()
    assert met < 500 * q.count()  # all 2,000 of them when one leaf held the whole table


def test_running_times_are_rounded_once_and_tell_the_rows_that_the_sql_tells(spark, tmp_path):
    # Event 89,280 of user 802 comes 0.15 s after the one told before it: its last bit decides.
    got, want = run_on(tmp_path, spark, "emitted_progress", events=duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/events.parquet'").to_arrow_table())
    assert len(got) == len(want) and got == want


def test_running_sums_go_on_as_doubles_from_a_value_without_a_decimal(spark):
    values = [0.1, 0.2, None, 1e300, 0.3, float("nan"), 0.4]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r[0] for r in df.select("i", sequences.summed_exactly("v", 100, Window.orderBy("i")).alias("s")).orderBy("i").select("s").collect()]
    assert got[:3] == [0.001, 0.003, 0.003] and got[3:5] == [pytest.approx(1e298)] * 2
    assert all(math.isnan(x) for x in got[5:])


def test_files_of_many_projects_are_chosen_in_tasks_and_by_the_rules(spark, tmp_path):
    held = {1: ["case1_d.nc", "z.nc"], 2: ["only.nc", "a.txt"], 3: ["a.nc", "b.nc"], 4: ["b.tif", "a.tif"], 5: ["a.tif", "made.shp"], 6: ["dir.nc/inside.tif"], 7: None}
    rows = [(k, f"{tmp_path}/{k}") for k in held]
    made = [(f"{tmp_path}/{k}/{n}".rsplit("/", 1)[0], [n.rsplit("/", 1)[-1]]) for k, names in held.items() for n in names or []]
    outputs.touch_all(spark.createDataFrame(made, "f string, n array<string>"), "f", "n")
    outputs.touch(f"{tmp_path}/common", "world.tif", "other.txt")
    df = outputs.with_files(spark.createDataFrame(rows, "k bigint, f string"), "f")
    files, case = F.col("files"), F.concat(F.lit("case"), F.col("k").cast("string"))
    got = {r["k"]: (r["c"], r["t"]) for r in df.select("k", outputs.chosen_case(files, case, "d").alias("c"), outputs.chosen_terrain(spark, files, f"{tmp_path}/common").alias("t")).collect()}
    assert got == {1: ("case1_d.nc", "world.tif"), 2: ("only.nc", "world.tif"), 3: (None, "world.tif"), 4: (None, "a.tif"), 5: (None, "made.shp"), 6: (None, "world.tif"), 7: (None, "world.tif")}
    assert df.select(outputs.chosen_terrain(spark, files, f"{tmp_path}/none").alias("t")).where("t IS NULL").count() == 5


def test_files_are_chosen_for_all_suppliers_without_gathering_them(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(outputs, "_names", lambda *a, names=outputs._names: (calls.append(a), names(*a))[1])
    got, want = run_on(tmp_path, spark, "chosen_files", supplier=pa.table({"s_suppkey": pa.array(range(1, 400), pa.int64())}))
    assert got == want
    assert len(calls) <= 1  # the driver lists the common folder only


def test_as_of_joins_deal_their_rows_to_tasks_by_number(spark):
    n, keys = 250_000, 40
    rows = spark.range(n).select((F.col("id") % keys).alias("k"), F.expr(f"id div {keys}").alias("i"))
    left, right = rows.select("k", (F.col("i") * 2 + 1).alias("t"), "i"), rows.select("k", (F.col("i") * 2).alias("rt"), F.col("i").cast("double").alias("v"))
    out = joins.as_of(left, right, ["k"], "t", "rt", "v")
    assert out.rdd.getNumPartitions() == 5  # 100,000 rows each, whatever number of partitions is set
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < n // 2
    last = F.col("i") == F.expr(f"({n - 1} - k) div {keys}")
    assert out.where((F.col("before") == F.col("i")) & (F.col("before_at") == F.col("t") - 1) & F.when(last, F.col("after").isNull()).otherwise((F.col("after") == F.col("i") + 1) & (F.col("after_at") == F.col("t") + 1))).count() == n
