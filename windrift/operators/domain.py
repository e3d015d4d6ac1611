"""The project's domain: where it lies, how it is turned, whether data cover it, and regridding onto it."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrift.functions import geo
from windrift.functions.text import fixed

log = logging.getLogger("windrift")


def turned_domain(boxes: DataFrame) -> DataFrame:
    """Each box (lon0, lon1, lat0, lat1) with zone, pivot (px, py: mean of its corners in metres) and angle of its southern edge.

    The zone is that of the middle longitude; corners are projected with plain expressions.
    """
    zone = geo.utm_zone((F.col("lon0") + F.col("lon1")) / 2)
    corners = {}
    for name, lon, lat in (("sw", "lon0", "lat0"), ("se", "lon1", "lat0"), ("nw", "lon0", "lat1"), ("ne", "lon1", "lat1")):
        e, n = geo.lonlat_to_utm(F.col(lon), F.col(lat), F.col("zone"))
        corners |= {f"{name}_e": e, f"{name}_n": n}
    out = boxes.withColumn("zone", zone).withColumns(corners)
    mean = lambda axis: (F.col(f"sw_{axis}") + F.col(f"se_{axis}") + F.col(f"nw_{axis}") + F.col(f"ne_{axis}")) / 4
    return out.withColumns({"px": mean("e"), "py": mean("n"), "angle": F.atan2(F.col("se_n") - F.col("sw_n"), F.col("se_e") - F.col("sw_e"))}).drop(*corners)


def without_pedestal(df: DataFrame, z: str, base: float, above_sea: float) -> DataFrame:
    """Levels at or above the pedestal's top, measured from sea level."""
    return df.where(F.col(z) >= base).withColumn(z, F.col(z) - base + above_sea)


def coverage(miss_percent: float, policy: str = "error", allowed: float = 0.0) -> bool:
    """Whether work may go on with data that miss the domain by so many percent. policy: error, warn or ignore."""
    if miss_percent <= allowed or policy == "ignore":
        return True
    if policy == "warn":
        log.warning("data miss the domain by %.2f %%", miss_percent)
        return True
    raise ValueError(f"data miss the domain by {miss_percent:.2f} %")


def shrunk_box(cells: DataFrame, x: str, y: str, inside: Column, attempts: int = 12, margin: float = 0.02) -> tuple[float, float, float, float] | None:
    """The bounds of the cells, drawn in by `margin` on each side until all cells in them are inside; None if never.

    Each attempt is one aggregation over the cells.
    """
    x0, x1, y0, y1 = cells.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    for _ in range(attempts):
        share = cells.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1)).agg(F.avg(inside.cast("double"))).first()[0]
        if share == 1.0:
            return x0, x1, y0, y1
        dx, dy = (x1 - x0) * margin, (y1 - y0) * margin
        x0, x1, y0, y1 = x0 + dx, x1 - dx, y0 + dy, y1 - dy
    return None


def generated(entries: DataFrame, values: dict[str, str]) -> DataFrame:
    """(key, value) rows to write beside a deck; the deck itself stays as it is."""
    spark = entries.sparkSession
    return spark.createDataFrame(sorted(values.items()), "key string, value string")


def cached_points(cache: DataFrame, number: str, line: str, x0: Column, y0: Column, step: Column) -> DataFrame:
    """(x, y, elevation) from cached lines of elevations, each an array and its number, from (x0, y0)."""
    cells = cache.select(x0.alias("x0"), y0.alias("y0"), step.alias("step"), F.col(number).alias("j"), F.posexplode(line).alias("i", "elevation"))
    return cells.select((F.col("x0") + F.col("i") * F.col("step")).alias("x"), (F.col("y0") + F.col("j") * F.col("step")).alias("y"), "elevation")


def grid_memory(nx: np.ndarray, ny: np.ndarray, nz: np.ndarray, arrays: tuple[int, ...]) -> np.ndarray:
    """Whole megabytes that a grid's arrays take together; arrays: the bytes a cell of each."""
    return sum(np.floor(nx * ny * nz * b / 1048576) for b in arrays)


def largest_grid(boxes: DataFrame, sides: tuple[str, str, str], memory: Column, arrays: tuple[int, ...], rounds: int = 48) -> DataFrame:
    """boxes with nx, ny, nz and megabytes: the finest grid in a box's proportions whose arrays fit the memory, by halving the range of its scale.

    Two sides may gain a cell at one scale; then the last bits of the first guess decide, so its product runs over the sides in order.
    """
    names, found = boxes.columns, ("nx", "ny", "nz", "megabytes")
    rows = boxes.withColumns({"memory_": memory.cast("double"), **{f"side{i}_": F.col(s).cast("double") for i, s in enumerate(sides)}})
    schema = T.StructType([*boxes.schema, *(T.StructField(c, T.LongType()) for c in found)])

    def run(batches):
        for b in batches:
            m, *lengths = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("memory_", "side0_", "side1_", "side2_"))
            at = lambda scale: [np.fmax(np.floor(scale * n), 1.0) for n in lengths]  # noqa: B023, E731
            volume = sum(arrays) * lengths[0] * lengths[1] * lengths[2]
            with np.errstate(divide="ignore", invalid="ignore"):
                guess = np.cbrt(m * 1048576.0 / volume)
                low, high = guess / 2, guess * 4
                for _ in range(rounds):
                    middle = (low + high) / 2
                    fits = grid_memory(*at(middle), arrays) <= m
                    low, high = np.where(fits, middle, low), np.where(fits, high, middle)
                cells = at(low)
                numbers = [*cells, grid_memory(*cells, arrays)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(n, from_pandas=True).cast(pa.int64()) for n in numbers)], [*names, *found])

    return rows.mapInArrow(run, schema)


def generated_ranges(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(key, value): the range of each column as a deck writes it; the deck itself stays as it is."""
    sums = df.agg(*(f(c).alias(f"{k}_{n}") for k, c in columns.items() for n, f in (("low", F.min), ("high", F.max))))
    entry = lambda k: F.struct(F.lit(k).alias("key"), F.concat(F.lit("["), fixed(F.col(f"{k}_low"), 3), F.lit(", "), fixed(F.col(f"{k}_high"), 3), F.lit("]")).alias("value"))
    return sums.select(F.explode(F.array(*map(entry, columns))).alias("e")).select("e.*")


def chained(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """The last step's table, and (step, rank, rows) for each step, which is logged; a step that fails says its name."""
    told = []
    for rank, (name, step) in enumerate(steps):
        try:
            df = step(df)
            told.append((name, rank, df.count()))
        except Exception as e:
            raise RuntimeError(f"step {name} failed") from e
        log.info("%s: %d rows", name, told[-1][2])
    return df, told
