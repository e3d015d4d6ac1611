"""Cases that a reviewer found in the fourth round."""

import duckdb
import numpy as np

from tests.test_findings_r03 import events
from windrift.operators import deck, sequences
from windrift.plans import registry

EVENTS = "'/root/testdata/sf0.1/events.parquet'"


def run_on(path, spark, name, **tables):
    """Rows of a query and of its SQL, in any order, which may be null."""
    c = duckdb.connect()
    for t, rows in tables.items():
        duckdb.from_arrow(rows).write_parquet(f"{path}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(path))
    return sorted(map(tuple, df.collect()), key=repr), sorted(c.sql(registry.ORACLES[name]).select(*(f'"{x}"' for x in df.columns)).fetchall(), key=repr)


def test_running_times_are_added_as_the_sql_adds_them(spark, tmp_path):
    # Ties that sums of decimals tell otherwise: 13 rows of six copies.
    six = duckdb.sql(f"SELECT event_id + k * 100000 AS event_id, user_id + k * 1500 AS user_id, value, event_type FROM {EVENTS}, range(6) t(k)").to_arrow_table()
    got, want = run_on(tmp_path, spark, "emitted_progress", events=six)
    assert len(got) == len(want) and got == want


def test_progress_without_a_time_or_a_user_is_told_as_the_sql_tells_it(spark, tmp_path):
    users = [1] * 60 + [None] * 60 + [2] * 60
    got, want = run_on(tmp_path, spark, "emitted_progress", events=events(users, ([None] * 9 + [15.0, 0.0, float("nan"), 7.5, 7.5, 1e300]) * 12))
    assert got == want


def test_sums_follow_the_tree_of_a_window(spark):
    c = duckdb.connect()
    c.sql("CREATE TABLE t AS SELECT i, 7 AS k, (hash(i) % 10000) / 100.0::DOUBLE AS x FROM range(5000) s(i)")
    rows = c.sql("SELECT x, sum(x) OVER (PARTITION BY k ORDER BY i) AS s FROM t ORDER BY i").fetchnumpy()
    assert (sequences.tree_sums(rows["x"], 0)[1:] == rows["s"]).all()
    want = c.sql("SELECT DISTINCT k, hash(k) FROM (SELECT unnest([NULL, 0, 5, -3, 900000000000]) AS k)").fetchall()
    df = spark.createDataFrame([(k,) for k, _ in want], "k bigint")
    got = {r["k"]: r["b"] for r in df.select("k", sequences.hash_byte(df.k).alias("b")).collect()}
    assert got == {k: h >> 40 & 255 for k, h in want}


def test_a_seasons_shares_are_added_as_the_sql_adds_them(spark, tmp_path):
    # Of 100,000 events: half the velocities are odd multiples of 2.5e-6, which their last bit rounds up or down.
    random = np.random.default_rng(4)
    users, values = random.integers(0, 1500, 100_000).tolist(), np.round(random.exponential(50.0, 100_000), 2).tolist()
    got, want = run_on(tmp_path, spark, "season_report", events=events(users, values))
    assert got == want


def test_a_report_has_no_line_for_what_is_unknown(spark, tmp_path):
    for name, users in (("some", [None, 1, 2, 1]), ("none", [])):
        (tmp_path / name).mkdir()
        got, want = run_on(tmp_path / name, spark, "season_report", events=events(users, [70.0] * len(users)))
        assert got == want


def test_decks_written_line_by_line_are_those_written_by_columns(spark):
    values = ["on", "OFF", "maybe", "0", "2p5", "[2, 1]", "[ \"3\" , '1p5' ]", "[1,2,3]", "12%", "3 m/s, 1", "1e400, 1", "-3,4e21", "[0.001, 1e7]", "\"a # b\" // c", "\" // \"", "", "a=b", "5\r", "x\ry", "v\u2028", "[1,2]\r", "/ 3 // 4", "\"u # x", "5\x85", "1,2,", "5 \r", "1_0, 2", "\u0661, 2"]
    odd = ["", "// Domain", "# x = 3", "== 3", "/a = 1", "b/ = 1", "\tTab-Key = 2", "\u2028k = 3", "x\r= 4", "k\"ey = 2 // \"c\"", "it's = 3 // 4'", "A B-_C = '1'", "\u0391\u03a3 = 2"]
    names = [k for f in deck.FIELDS for k in (f.key, *f.aliases)]
    lines = [f"{k.upper() if i % 3 else k.replace('_', '-')} = {v}" for i, k in enumerate(names) for v in values] + odd * 40
    random = np.random.default_rng(1)
    texts = [("\r\n" if i % 2 else "\n").join(lines[j] for j in random.integers(0, len(lines), i % 25)) for i in range(2000)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "deck bigint, text string").repartition(4)
    want = dict(map(tuple, deck.rendered_sheets(deck.repaired_sheets(deck.sheets(df))).collect()))
    assert dict(map(tuple, deck.rendered_texts(df).collect())) == want and len(want) == 2001


def test_a_deck_is_rendered_without_a_column_function_for_each_line(spark):
    plan = registry.QUERIES["deck_rendering"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "rlike" not in plan.lower() and plan.count("lambdafunction") <= 1


def test_a_runs_values_are_added_in_order_as_the_sql_adds_them(spark, tmp_path):
    # Exactly their mean lies between two texts; the sum of doubles, in order, does not.
    values = [190.64, 194.28, 111.58]
    got, want = run_on(tmp_path, spark, "run_records", events=events([1] * len(values), values))
    assert got == want


def test_a_run_without_a_time_step_has_no_text(spark, tmp_path):
    odd = [None, None, float("nan"), 1.0, float("inf"), 160.0, None, 3.0]
    got, want = run_on(tmp_path, spark, "run_records", events=events([1, 1, 2, 2, 3, 3, 4, 4], odd))
    assert got == want and (1, None) in got
