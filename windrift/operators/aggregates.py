"""Statistics over grids, layers, roses and building stocks; each is one or two pre-aggregated group-bys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.operators.ordered import quantiles


def valid(*components: str) -> Column:
    """A cell counts when any component is not zero; NaN and null do not count."""
    some = F.lit(False)
    for c in components:
        some = some | F.coalesce(~F.isnan(c) & (F.col(c) != 0), F.lit(False))
    return some


def finite(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """count, min, 5 and 95 percent points, median, mean, population deviation and max of each column, NaN left out."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), finite(c).cast("double").alias("x")) for c in columns))).alias("v")).select("v.*")
    out = long.groupBy("variable").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    out = out.join(quantiles(long, ["variable"], "x", [0.05, 0.5, 0.95]), "variable", "left")
    return out.select("variable", "n", "low", F.col("q")[0].alias("q05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q95"), "high", "mean", "deviation")


def extents(df: DataFrame, *axes: str) -> DataFrame:
    """Lowest, highest and span of each axis."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("x")) for c in axes))).alias("v")).select("v.*")
    return long.groupBy("axis").agg(F.min("x").alias("low"), F.max("x").alias("high")).withColumn("span", F.col("high") - F.col("low"))


def extents_agree(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Largest relative difference of two tables' spans, and whether it stays below the tolerance."""
    both = a.alias("a").join(b.alias("b"), "axis").select((F.abs(F.col("a.span") - F.col("b.span")) / F.greatest(F.abs("b.span"), F.lit(1e-12))).alias("error"))
    return both.agg(F.max("error").alias("error")).withColumn("passed", F.col("error") < tolerance)


def level_means(grid: DataFrame, *fields: str) -> DataFrame:
    return grid.groupBy("z").agg(F.count("*").alias("n"), *(F.avg(finite(f)).alias(f"mean_{f}") for f in fields))


def online_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and population variance: mergeable, so partial sums meet before the shuffle."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def layer_coverage(grid: DataFrame, *components: str) -> DataFrame:
    return grid.groupBy("z").agg(F.avg(valid(*components).cast("double")).alias("coverage"), F.sum(valid(*components).cast("bigint")).alias("cells"))


def direction_weights(rose: DataFrame, bins: DataFrame, reference: float | Column) -> DataFrame:
    """Each direction's share, and its weights for velocity (by speed ratio) and turbulent energy (by its square).

    rose: angle, bin, p; bins: bin, speed. Directions come from the rose; all 16 can be had by a left join.
    """
    ratio = F.col("speed") / reference
    return rose.join(F.broadcast(bins), "bin").groupBy("angle").agg(F.sum("p").alias("p"), F.sum(F.col("p") * ratio).alias("velocity_weight"), F.sum(F.col("p") * ratio * ratio).alias("energy_weight"))


def bin_speeds(bins: DataFrame) -> DataFrame:
    """bin, speed from bin, lower, upper: the middle; an open bin is its lower end and half of the sum of all widths."""
    widths = bins.agg(F.sum(F.col("upper") - F.col("lower")).alias("all_widths"))
    return bins.join(F.broadcast(widths)).select("bin", F.when(F.col("upper").isNotNull(), (F.col("lower") + F.col("upper")) / 2).otherwise(F.col("lower") + 0.5 * F.col("all_widths")).alias("speed"))


def as_shares(cells: DataFrame, value: str = "p") -> DataFrame:
    """Values whose total is above 1.5 are percent and are divided by 100."""
    total = cells.agg(F.sum(value).alias("total"))
    return cells.join(F.broadcast(total)).withColumn(value, F.when(F.col("total") > 1.5, F.col(value) * 0.01).otherwise(F.col(value))).drop("total")


def season_average(fields: DataFrame, weights: DataFrame, cell: list[str]) -> DataFrame:
    """Weighted sums over directions: velocity parts and speed by velocity weight, energy by energy weight.

    fields: angle, the cell's columns, u, v, w, tke. Directions without weight are left out before
    the join, and the few weights (one a direction) go to every task.
    """
    used = weights.where((F.col("velocity_weight") > 1e-10) | (F.col("energy_weight") > 1e-10))
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w"))
    wv, we = F.col("velocity_weight"), F.col("energy_weight")
    return fields.join(F.broadcast(used), "angle").groupBy(*cell).agg(*(F.sum(wv * F.col(c)).alias(c) for c in ("u", "v", "w")), F.sum(wv * speed).alias("vm"), F.sum(we * F.col("tke")).alias("tke"))


def cell_means(samples: DataFrame, ix: Column, iy: Column, cells: DataFrame, value: str) -> DataFrame:
    """Mean of the samples in each of the given cells (ix, iy); empty cells take the mean of all samples."""
    means = samples.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.avg(value).alias("mean"))
    whole = samples.agg(F.avg(value).alias("whole"))
    return cells.join(means, ["ix", "iy"], "left").join(F.broadcast(whole)).select("ix", "iy", F.coalesce("mean", "whole").alias("value"))


def weighted_histogram(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted density over bins of Freedman-Diaconis width: bin, low, density. The last bin is closed on the right."""
    quarters = quantiles(df.withColumn("all", F.lit(0)), ["all"], value, [0.25, 0.75]).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    q = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"), F.sum(weight).alias("total")).join(F.broadcast(quarters))
    width = 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n"), 1 / 3)
    q = q.withColumn("bins", F.greatest(F.ceil((F.col("high") - F.col("low")) / width), F.lit(1))).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    placed = df.join(F.broadcast(q)).withColumn("bin", F.least(F.floor((F.col(value) - F.col("low")) / F.col("width")), F.col("bins") - 1))
    return placed.groupBy("bin").agg((F.sum(weight) / F.max("total") / F.max("width")).alias("density"), F.max(F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.count("*").alias("n"))


def fixed_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of `bins` equal bins from low to high; values outside are left out, the last bin is closed."""
    x = F.col(value)
    # Not width_bucket: it multiplies before it divides and puts some values at a bin's edge one bin up.
    nth = F.floor((x - low) / (F.lit(high) - F.lit(low)) * bins) + 1
    return df.where(x.between(low, high)).groupBy(F.least(nth, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def robust_limits(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    return quantiles(df.withColumn("all", F.lit(0)), ["all"], value, [low, high]).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def counts_by_reason(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def boundary_flux(faces: DataFrame, patch: str, flux: str, area: str) -> DataFrame:
    """In, out and net flux and mean size for each face, and for all (face null)."""
    f = F.col(flux) * F.col(area)
    return faces.rollup(patch).agg(F.sum(F.when(f > 0, f).otherwise(0.0)).alias("flux_out"), F.sum(F.when(f < 0, -f).otherwise(0.0)).alias("flux_in"), F.sum(f).alias("net"), F.avg(F.abs(flux)).alias("mean_size"))


def corrected_flux(faces: DataFrame, flux: str, area: str) -> DataFrame:
    """The same faces with one constant taken off, so that the net flux is none."""
    total = faces.agg((F.sum(F.col(flux) * F.col(area)) / F.sum(area)).alias("excess"))
    return faces.join(F.broadcast(total)).withColumn(flux, F.col(flux) - F.col("excess")).drop("excess")


def median_spacing(df: DataFrame, axis: str, group: list[str]) -> DataFrame:
    """Median distance of neighbours on an axis, over all groups (rows of a grid)."""
    from pyspark.sql import Window

    d = df.select(*group, axis).distinct().withColumn("gap", F.col(axis) - F.lag(axis).over(Window.partitionBy(*group).orderBy(axis)))
    return quantiles(d.withColumn("all", F.lit(0)), ["all"], "gap", [0.5]).select(F.col("q")[0].alias("spacing"))


def body_forces(cells: DataFrame, body: str, x: str, y: str, fx: str, fy: str, mass: str) -> DataFrame:
    """Centre of mass, force and torque about the origin for each body."""
    m = F.sum(mass)
    return cells.groupBy(body).agg((F.sum(F.col(mass) * F.col(x)) / m).alias("cx"), (F.sum(F.col(mass) * F.col(y)) / m).alias("cy"), F.sum(fx).alias("fx"), F.sum(fy).alias("fy"), F.sum(F.col(x) * F.col(fy) - F.col(y) * F.col(fx)).alias("torque"))


def shell_sums(modes: DataFrame, k: Column, dk: float, shells: int, energy: str, weight: str) -> DataFrame:
    """Energy and mode weight of each spectral shell; wave numbers beyond the last go to it."""
    shell = F.least(F.floor(k / dk), F.lit(shells - 1))
    return modes.groupBy(shell.alias("shell")).agg(F.sum(F.col(energy) * F.col(weight)).alias("shell_energy"), F.sum(weight).alias("mode_weight"))
