"""What a wind project writes besides grids: cubes by level, CSV tables, summaries; and how inputs are found."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.functions.text import fixed


def write_levels(cube: DataFrame, path: str, level: str = "z", meta: dict[str, str] | None = None) -> None:
    """A cube as Parquet, one folder a level; rows of a level go to one file, sorted by row. meta (coordinate system, units) is kept beside it."""
    cube.repartition(level).sortWithinPartitions(*(c for c in ("y", "x") if c in cube.columns)).write.mode("overwrite").partitionBy(level).parquet(path)
    if meta:
        cube.sparkSession.createDataFrame(sorted(meta.items()), "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/_meta")


def read_levels(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A cube that `write_levels` wrote, and what is kept beside it."""
    try:
        meta = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}/_meta").collect()}  # a few entries
    except AnalysisException:
        meta = {}
    return spark.read.parquet(path), meta


def boundary_csv(samples: DataFrame) -> DataFrame:
    """Boundary samples as they are written: places with three decimals."""
    return samples.select(*(fixed(F.col(c), 3).alias(c) for c in ("X", "Y", "Z")), *(c for c in samples.columns if c not in ("X", "Y", "Z")))


def sampled_means(points: DataFrame, grid: DataFrame, spacing: float, dims: tuple[int, int, int]) -> DataFrame:
    """points (x, y, z in metres) with the mean field of their nearest cell: one equi-join on the cell."""
    from windrift.functions.geo import pressure_of_density, snapped

    nx, ny, nz = dims
    cells = points.select("*", *(snapped(F.col(c), spacing, n).cast("bigint").alias(f"c{c}") for c, n in (("x", nx), ("y", ny), ("z", nz))))
    g = grid.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), F.col("u").alias("mean_velocity_x"), F.col("v").alias("mean_velocity_y"), F.col("w").alias("mean_velocity_z"), pressure_of_density(F.col("rho")).alias("mean_pressure"))
    return cells.join(g, ["cx", "cy", "cz"]).drop("cx", "cy", "cz")


def summary_lines(weights: DataFrame) -> DataFrame:
    """A text line for each direction of a season's average, in order of angle."""
    return weights.select("angle", F.concat(F.format_string("%5.1f deg", "angle"), *(x for n, c in (("p", "p"), ("velocity", "velocity_weight"), ("energy", "energy_weight")) for x in (F.lit(f"  {n}="), fixed(F.col(c), 6)))).alias("line"))


def key_values(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """texts with a column for each key: the value of its last `key = value` line, without comments."""
    return texts.withColumns({k: F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?im)^\s*{k}\s*=\s*([^/#\r\n]*)"), F.lit(1)), F.lit(-1))) for k in keys})


def find_input(spark: SparkSession, folder: str, *patterns: str) -> str:
    """The first pattern's newest file under a folder (later patterns only if the earlier find none); an error if none does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    names = [(r["path"], r["modificationTime"]) for r in files.collect()]  # a project's own folder: names and times only
    for p in patterns:
        found = [(t, n) for n, t in names if fnmatch.fnmatch(n.rsplit("/", 1)[-1], p)]
        if found:
            return max(found)[1]
    raise FileNotFoundError(f"no {' or '.join(patterns)} in {folder}")


def case_file(spark: SparkSession, folder: str, case: str, date: str, ending: str = "nc") -> str:
    """The file of a case and time, `<case>_<date>.<ending>`; else the only one with that ending; else an error."""
    names = _names(spark, folder, f"*.{ending}")
    exact = [n for n in names if n.rsplit("/", 1)[-1] == f"{case}_{date}.{ending}"]
    if exact or len(names) == 1:
        return (exact or names)[0]
    raise FileNotFoundError(f"{len(names)} files *.{ending} in {folder}, none of them {case}_{date}.{ending}")


def with_files(folders: DataFrame, folder: str) -> DataFrame:
    """folders with `files`: names of a folder's own files (a project's, some tens) in order, none if there is no such folder.

    Tasks list the folders of their rows, so these must be mounted by all executors; contents are not read.
    """

    @F.udf("array<string>")
    def names(path):
        try:
            with os.scandir(path or "") as found:
                return sorted(e.name for e in found if e.is_file())
        except FileNotFoundError:
            return []

    return folders.withColumn("files", names.asNondeterministic()(folder))


def chosen_case(files: Column, case: Column, date: str, ending: str = "nc") -> Column:
    """As `case_file`, of a row's file names; null where that is an error."""
    exact, own = F.concat(case, F.lit(f"_{date}.{ending}")), F.filter(files, lambda n: n.endswith(f".{ending}"))
    return F.when(F.array_contains(own, exact), exact).when(F.size(own) == 1, F.try_element_at(own, F.lit(1)))


def chosen_terrain(spark: SparkSession, files: Column, common: str) -> Column:
    """What terrain is made from, of a row's file names in order: the project's layer if it is made already, else its rasters (the first by name), else that of the common folder; null if there is none."""
    first = lambda ending: F.try_element_at(F.filter(files, lambda n: n.endswith(ending)), F.lit(1))
    shared = next((n.rsplit("/", 1)[-1] for n in _names(spark, common, "*.tif")), None)
    return F.coalesce(first(".shp"), first(".tif"), F.lit(shared).cast("string"))


def _names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of a folder's own files (a project's, some tens), by name; contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def touch(folder: str, *names: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for n in names:
        with open(f"{folder}/{n}", "w") as f:
            f.write("x")


def touch_all(files: DataFrame, folder: str, names: str) -> None:
    """For each row its folder with files of these names, made by the tasks; folders must be mounted by all executors."""

    def run(rows: Iterator) -> None:
        for r in rows:
            touch(r[0], *r[1])

    files.select(folder, names).foreachPartition(run)


def spectrum_rows(shells: DataFrame, dk: float) -> DataFrame:
    """A spectrum as it is written: shell centre, energy density, the same by k^(5/3), energy and mode weight of each shell."""
    k = (F.col("shell") + 0.5) * dk
    e = F.col("shell_energy") / dk
    return shells.orderBy("shell").select(k.alias("k_rad_per_m"), e.alias("E_k"), (e * F.pow(k, F.lit(5 / 3))).alias("k_5_3_E_k"), "shell_energy", F.col("mode_weight").alias("shell_mode_weight"))


def headed(title: str, lines: DataFrame) -> DataFrame:
    """(rank, line) with a title before them."""
    return lines.sparkSession.range(1).select(F.lit(-1.0).alias("rank"), F.lit(title).alias("line")).unionByName(lines.select(F.col("rank").cast("double").alias("rank"), "line"))


def write_report(parts: list[DataFrame], path: str) -> None:
    """A report of some tens of lines, part by part in order of rank, as one text file. What is null makes no line."""
    lines = None
    for i, p in enumerate(parts):
        one = p.select(F.lit(i).alias("part"), F.col("rank").cast("double").alias("rank"), "line")
        lines = one if lines is None else lines.unionByName(one)
    lines.where("line IS NOT NULL").coalesce(1).sortWithinPartitions("part", "rank").select("line").write.mode("overwrite").text(path)


def run_records(runs: DataFrame, key: str) -> DataFrame:
    """(key, text): for each run its time step, steps and state as `name = value` lines; null where one of them is. runs: key, dt, steps, state."""
    return runs.select(key, F.concat(F.lit("dt = "), fixed(F.col("dt"), 3), F.lit(" s\nsteps = "), F.col("steps").cast("string"), F.lit("\nstate = "), "state").alias("text"))
