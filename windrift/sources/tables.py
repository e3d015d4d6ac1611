"""Text tables of a wind project as DataFrames: lines in, typed rows out. Bad rows are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windrift.functions import text as X
from windrift.operators.ordered import in_ranges


def _cells(line: Column) -> Column:
    """The cells of a line without its comment, by comma, semicolon, tab or blanks."""
    bare = F.trim(X.stripped_comment(line))
    return F.when(bare != "", F.split(bare, r"\s*[,;\t]\s*|\s+"))


def profile(lines: DataFrame, line: str = "value", top: float | None = None, order: str | None = None) -> DataFrame:
    """(z, U) from lines of a profile; headers and bad lines have no numbers and go. With an order column, of equal heights the last line counts."""
    c = _cells(F.col(line))
    rows = lines.select(*([order] if order else []), X.number(F.try_element_at(c, F.lit(1))).alias("z"), X.number(F.try_element_at(c, F.lit(2))).alias("U")).where("z is not null and U is not null")
    rows = rows.where(F.col("z") <= top) if top is not None else rows
    return rows.groupBy("z").agg(F.max_by("U", order).alias("U")) if order else rows


def elevations(lines: DataFrame, line: str = "value") -> DataFrame:
    """(x, y, elevation) from lines of a terrain table."""
    c = _cells(F.col(line))
    n = lambda i: X.number(F.try_element_at(c, F.lit(i)))
    return lines.select(n(1).alias("x"), n(2).alias("y"), n(3).alias("elevation")).where("x is not null and y is not null and elevation is not null")


def boundary_samples(df: DataFrame) -> DataFrame:
    """X, Y, Z, u, v, w, T, patch from a boundary table: by name in any case, else by position.

    Without names, a seventh of seven columns is a patch if it is a whole number from 0 to 5, else
    a temperature. Missing T is null, missing patch -1; rows without place or wind go.
    """
    names = {c.lower(): c for c in df.columns}
    wanted = ["x", "y", "z", "u", "v", "w"]
    n = lambda c: F.col(f"`{c}`").try_cast("double") if dict(df.dtypes)[c] == "string" else F.col(f"`{c}`").cast("double")
    if all(c in names for c in wanted):
        cols = [n(names[c]) for c in wanted]
        t = n(names["t"]) if "t" in names else F.lit(None).cast("double")
        patch = n(names["patch"]) if "patch" in names else F.lit(None).cast("double")
    else:
        cols = [n(c) for c in df.columns[:6]]
        seventh = n(df.columns[6]) if len(df.columns) > 6 else F.lit(None).cast("double")
        is_patch = seventh.between(-0.5, 5.5) & (F.abs(seventh - F.round(seventh)) <= 1e-4)
        if len(df.columns) > 7:
            t, patch = seventh, n(df.columns[7])
        else:
            t, patch = F.when(~is_patch, seventh), F.when(is_patch, seventh)
    out = df.select(*(c.alias(k.upper() if k in "xyz" else k) for c, k in zip(cols, wanted, strict=True)), t.alias("T"), F.coalesce(F.round(patch), F.lit(-1)).cast("int").alias("patch"))
    return out.dropna(subset=["X", "Y", "Z", "u", "v", "w"])


def wind_rose(rows: DataFrame, order: str = "line_no", cells: str = "cells") -> DataFrame:
    """(angle, bin, lower, upper, p) from the cell arrays of a wind-rose table.

    The header is the first row with names like C7_7p0_9p4 or C9_12p0_inf; the direction is the
    last readable label left of the bins; values of one direction and bin add up; percent become shares.
    """
    spec = r"^\s*[Cc](\d+)_(\d+(?:[p.]\d+)?)_(\d+(?:[p.]\d+)?|inf)\s*$"
    named = rows.withColumn("is_head", F.exists(cells, lambda c: c.rlike(spec)))
    head = named.where("is_head").agg(F.min_by(cells, order).alias("head"), F.min(order).alias("head_at"))  # one row: the header
    body = named.join(F.broadcast(head)).where(F.col(order) > F.col("head_at"))
    first = F.array_position(F.transform("head", lambda c: c.rlike(spec)), F.lit(True)).cast("int")
    labels = F.filter(F.transform(F.slice(cells, 1, first - 1), X.compass_degrees), lambda a: a.isNotNull())
    long = body.withColumn("angle", F.try_element_at(labels, F.lit(1))).where("angle is not null").select("angle", F.explode(F.arrays_zip(F.col("head").alias("h"), F.col(cells).alias("v"))).alias("c"))
    part = lambda k: F.regexp_extract("c.h", spec, k)
    values = long.where(F.col("c.h").rlike(spec)).select("angle", part(1).cast("bigint").alias("bin"), X.number(part(2)).alias("lower"), F.when(F.lower(part(3)) != "inf", X.number(part(3))).alias("upper"), F.coalesce(X.number(F.col("c.v")), F.lit(0.0)).alias("p"))
    sums = values.groupBy("angle", "bin").agg(F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.sum("p").alias("p"))
    from windrift.operators.aggregates import as_shares

    return as_shares(sums)


def terrain_minima(lines: DataFrame, order: str = "line_no", line: str = "value") -> DataFrame:
    """(case, asl) from lines that name a case and then say `terrain_min_asl_m = x` or `x m`; the last of a case counts."""
    t = F.trim(F.col(line))
    value = F.coalesce(X.number(F.regexp_extract(t, r"terrain_min_asl_m\s*=\s*(\S+)", 1)), X.number(F.regexp_extract(t, r"^([+-]?[\d.]+)\s*m$", 1)))
    name = F.when(value.isNull() & (t != ""), t)
    # The last name before a line: within its range of lines, or the last one of an earlier range.
    rows = in_ranges(lines.select(F.col(order).alias("n"), name.alias("name"), value.alias("asl")), "n")
    w = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("part").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("n"))).alias("last"))
    ends = ends.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))  # a row for each range
    found = rows.join(F.broadcast(ends), "part").select("n", "asl", F.coalesce(F.last("name", ignorenulls=True).over(w), "earlier").alias("case")).where("asl is not null and case is not null")
    return found.groupBy("case").agg(F.max_by("asl", "n").alias("asl"))


def catalogue(spark: SparkSession, folder: str, pattern: str = "*.vtk") -> DataFrame:
    """path, name, length, modified, step, angle of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), X.step_of(name).alias("step"), X.angle_of(name).alias("angle"))


def pick_column(columns: list[str], *candidates: str) -> str | None:
    """The first candidate name that a table has, whatever its case and punctuation."""
    import re

    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    have = {plain(c): c for c in columns}
    return next((have[plain(c)] for c in candidates if plain(c) in have), None)


def output_names(columns: DataFrame, name: str = "name") -> DataFrame:
    """columns with `output`: safe names, repeated ones numbered in order."""
    safe = F.when(X.file_stem(F.col(name)) == "", "var").otherwise(X.file_stem(F.col(name)))
    k = F.row_number().over(Window.partitionBy(safe).orderBy(name))
    return columns.withColumn("output", F.when(k > 1, F.concat_ws("_", safe, k - 1)).otherwise(safe))


def packed_probes(samples: DataFrame) -> DataFrame:
    """height and one column a time, cells `u:v:w`: the wide form of (height, t, u, v, w). Times are a short list."""
    cell = samples.select("height", F.col("t").cast("string").alias("t"), F.concat_ws(":", *(F.format_string("%.6f", c) for c in "uvw")).alias("c"))
    return cell.groupBy("height").pivot("t").agg(F.first("c"))


def unpacked_probes(wide: DataFrame) -> DataFrame:
    """(height, t, u, v, w) from the wide form."""
    long = wide.unpivot("height", [c for c in wide.columns if c != "height"], "t", "c").where("c is not null")
    part = lambda k: F.split("c", ":")[k].cast("double")
    return long.select("height", F.col("t").cast("bigint").alias("t"), part(0).alias("u"), part(1).alias("v"), part(2).alias("w"))


def perimeter(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    return cells.where((F.col("x").isin(0, nx - 1)) | (F.col("y").isin(0, ny - 1)))


def renamed(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with columns found by candidate names (first that is there, in any case and punctuation) under the wanted ones; the others stay."""
    found = {pick_column(df.columns, *candidates): wanted for wanted, candidates in names.items()}
    return df.withColumnsRenamed({old: new for old, new in found.items() if old is not None and old != new})


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with more names for its columns: each alias repeats the first candidate that is there, if it is not a column yet."""
    have = {a: pick_column(df.columns, *candidates) for a, candidates in aliases.items() if a not in df.columns}
    return df.withColumns({a: F.col(f"`{c}`") for a, c in have.items() if c is not None})
