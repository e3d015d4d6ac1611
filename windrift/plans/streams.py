"""Queries of the step-driven statistics, run as streams over files until all is read."""

from pyspark.sql import functions as F

from windrift.plans import adapters as D
from windrift.plans.registry import query
from windrift.plans.tables import shared_folder
from windrift.streaming import steps as T


def stream(spark, sf, table):
    return spark.readStream.schema(D.read(spark, sf, table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def drain(writer, folder):
    q = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query("SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS variance FROM events GROUP BY 1")
def streamed_statistics(spark, sf):
    """Mean and variance of each key, kept up to date by a stream."""
    folder = shared_folder(spark)
    out = T.online_statistics(stream(spark, sf, "events"), ["user_id"], "value")
    drain(out.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out")), folder)
    return spark.read.parquet(f"{folder}/out").select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


@query("SELECT user_id, count(value) AS n, round(avg(value) + 1e-8, 5) AS mean, round(var_pop(value), 5) AS variance FROM events GROUP BY 1")
def streamed_welford(spark, sf):
    """The same from explicit state, which leaves out steps that come again."""
    folder = shared_folder(spark)
    w = T.welford(stream(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    drain(w.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")), folder)
    rows = spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "m2"), "n").alias("s"))
    return rows.select("user_id", "s.n", F.round(F.col("s.mean") + 1e-8, 5).alias("mean"), F.round(F.col("s.m2") / F.col("s.n"), 5).alias("variance"))


@query("SELECT event_id, value, CAST('probe' AS VARCHAR) AS sink FROM events WHERE user_id % 20 IN (3, 7) AND event_id + 1 > (SELECT max(event_id) + 1 - 1000 FROM events) UNION ALL SELECT event_id, value, 'snapshot' FROM events WHERE (event_id + 1) % 500 = 0")
def streamed_probes(spark, sf):
    """Probes of the last steps and periodic snapshots, two sinks of one read."""
    folder = shared_folder(spark)
    events = stream(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("cell"), (F.col("event_id") + 1).alias("t"), "value")
    probes = spark.createDataFrame([(3,), (7,)], "cell bigint")
    total = D.read(spark, sf, "events").agg(F.max("event_id") + 1).first()[0] or 0

    def probe_sink(batch, number):
        T.probe_samples(batch, probes, ["cell"], "t", total, 1000).write.mode("overwrite").parquet(f"{folder}/probes/batch={number}")

    drain(T.each_batch(events, f"{folder}/checkpoint", probe_sink, T.snapshots(f"{folder}/snapshots", "t", 500)), folder)
    p = spark.read.parquet(f"{folder}/probes").select("event_id", "value", F.lit("probe").alias("sink"))
    return p.union(spark.read.parquet(f"{folder}/snapshots").select("event_id", "value", F.lit("snapshot").alias("sink")))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    """Extension: tumbling windows with a watermark over event time."""
    folder = shared_folder(spark)
    w = T.windowed(stream(spark, sf, "events"), "ts", "1 hour", "30 days", "event_type")
    drain(w.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")), folder)
    rows = spark.read.parquet(f"{folder}/out").groupBy("window", "event_type").agg(F.max("n").alias("n"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1, 2""")
def session_counts(spark, sf):
    """Extension: sessions of each user, by length."""
    return T.sessions(D.read(spark, sf, "events"), "ts", "6 hours", "user_id").groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS deck, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS casename, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 2 ELSE n_nationkey END AS DOUBLE) AS cell_size FROM nation")
def watched_decks(spark, sf):
    """A folder of decks watched as a stream of files: a deck that is written again takes the place of what was read of it."""
    from windrift.operators import deck

    folder = shared_folder(spark)
    nations = D.read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    text = lambda name, factor: F.concat(F.lit(f"casename = {name}\ncell_size = "), (F.col("k") * factor).cast("string"))
    state = spark.createDataFrame([], "deck string, at bigint, casename string, cell_size double")
    state.write.parquet(f"{folder}/state-0")
    turn = [0]

    def keep(batch, number):
        """The newest version of each deck, beside what is known; a batch that comes again changes nothing."""
        rows = deck.typed(deck.effective(deck.parse(batch.select("deck", "text"))))
        new = rows.groupBy("deck").agg(F.max(F.when(F.col("key") == "casename", F.col("raw"))).alias("casename"), F.max(F.when(F.col("key") == "cell_size", F.col("as_double"))).alias("cell_size"))
        new = new.withColumn("at", F.lit(number).cast("bigint")).select("deck", "at", "casename", "cell_size")
        known = spark.read.parquet(f"{folder}/state-{turn[0]}").where(F.col("at") < number)
        both = known.unionByName(new)
        turn[0] += 1
        both.groupBy("deck").agg(F.max("at").alias("at"), F.max_by("casename", "at").alias("casename"), F.max_by("cell_size", "at").alias("cell_size")).write.mode("overwrite").parquet(f"{folder}/state-{turn[0]}")

    for version, rows in (("old", nations), ("new", nations.where("k % 2 = 0"))):
        rows.select(F.concat(F.col("k").cast("string"), F.lit(f"-{version}")).alias("file"), text(version, 1 if version == "old" else 2).alias("value")).write.mode("append").partitionBy("file").text(f"{folder}/decks")
        seen = spark.readStream.schema("value string, file string").text(f"{folder}/decks", wholetext=True).select(F.split("file", "-")[0].alias("deck"), F.col("value").alias("text"))
        drain(seen.writeStream.foreachBatch(keep), folder)
    return spark.read.parquet(f"{folder}/state-{turn[0]}").select("deck", "casename", "cell_size")
