"""Interpolation between scattered points, columns and grids.

Neighbour searches and weighted sums are joins and aggregations; only small dense solves (one
neighbourhood, one layer) run in numpy, on groups that Spark has dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrift.operators.joins import bracketed, k_nearest
from windrift.operators.sequences import reflected


def inverse_distance(queries: DataFrame, points: DataFrame, value: str, k: int, power: float = 2.0, floor: float = 1e-10) -> DataFrame:
    """(qid, value): mean of the k nearest by 1 / distance^power."""
    near = k_nearest(queries, points.select("vec_id", "px", "py"), k).join(points.select("vec_id", value), "vec_id")
    w = 1 / F.pow(F.greatest("distance", F.lit(floor)), power)
    return near.groupBy("qid").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"))


def resampled(grid: DataFrame, axes: list[tuple[str, int, int]], value: str, kept: list[str] | None = None) -> DataFrame:
    """The grid on new numbers of points along each axis, ends kept: linear in each axis.

    axes: (column, old points, new points); kept: columns that stay as they are (layers). Each new index names its two old ones and their
    weights (tables as short as an axis, sent to every task); a grid point goes to the new points
    that it has weight in, and these sum up.
    """
    spark = grid.sparkSession
    out, weight = grid, F.lit(1.0)
    for c, n, m in axes:
        at = F.col("i") * ((n - 1) / (m - 1)) if m > 1 else F.lit(0.0)
        low = F.least(F.floor(at), F.lit(n - 2)).cast("bigint") if n > 1 else F.lit(0).cast("bigint")
        t = at - low
        pairs = spark.range(m).withColumnRenamed("id", "i").select(F.col("i").alias(f"{c}_new"), F.explode(F.array(F.struct(low.alias(c), (1 - t).alias("w")), F.struct((low + 1).alias(c), t.alias("w")))).alias("p"))
        table = pairs.select(f"{c}_new", f"p.{c}", F.col("p.w").alias(f"{c}_w")).where(F.col(f"{c}_w") > 0)
        out, weight = out.join(F.broadcast(table), c), weight * F.col(f"{c}_w")
    return out.groupBy(*(kept or []), *(F.col(f"{c}_new").alias(c) for c, _, _ in axes)).agg(F.sum(weight * F.col(value)).alias(value))


def vertical(columns: DataFrame, keys: list[str], z: str, value: str, levels: list[float]) -> DataFrame:
    """Each column of values on fixed levels: linear between samples, end values outside. One row a column and level."""
    rows = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(z).cast("double").alias("z"), F.col(value).cast("double").alias("v")))).alias("s"))
    asked = rows.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    lo = F.try_element_at(F.filter("s", lambda s: s["z"] <= F.col("level")), F.lit(-1))
    hi = F.try_element_at(F.filter("s", lambda s: s["z"] > F.col("level")), F.lit(1))
    return asked.select(*keys, "level", F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(lo["v"] + (hi["v"] - lo["v"]) * (F.col("level") - lo["z"]) / (hi["z"] - lo["z"])).alias("value"))


def terrain_surface(nodes: DataFrame, points: DataFrame, value: str, k: int, sigma: float, scale: float = 1.0, power: float = 2.0) -> DataFrame:
    """(x, y, value) over a grid of nodes (qid, x, y, qx, qy): inverse distances, Gaussian smoothing, no negatives, from 0 up, scaled."""
    raw = inverse_distance(nodes.select("qid", "qx", "qy"), points, value, k, power).join(nodes.select("qid", "x", "y"), "qid").select("x", "y", "value")
    return surface(reflected(reflected(raw, "x", ["y"], "value", sigma), "y", ["x"], "value", sigma), "value", scale).select("x", "y", "value")


def surface(cells: DataFrame, value: str, scale: float = 1.0) -> DataFrame:
    """Elevations without negatives, lowered so that the lowest is 0, scaled."""
    held = cells.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    low = held.agg(F.min(value).alias("lowest"))
    return held.join(F.broadcast(low)).withColumn(value, (F.col(value) - F.col("lowest")) * scale).drop("lowest")


def boundary_faces(nx: int, ny: int, nz: int, spark) -> DataFrame:
    """(patch, x, y, z): every point of the box's faces, top first where faces meet; made in place, not collected."""
    from windrift.functions.geo import boundary_patch

    cells = spark.range(nx * ny * nz).select((F.col("id") % nx).alias("x"), (F.expr(f"id div {nx}") % ny).alias("y"), F.expr(f"id div {nx * ny}").alias("z"))
    return cells.withColumn("patch", boundary_patch(F.col("x"), F.col("y"), F.col("z"), nx, ny, nz)).where("patch >= 0")


def profile_field(points: DataFrame, ground: DataFrame, profile: DataFrame, height: Column) -> DataFrame:
    """points with the inflow speed by height above the ground at (x, y); none below the ground.

    points: x, y and more; ground: x, y, h; profile: z, U.
    """
    above = points.join(ground, ["x", "y"]).withColumn("agl", height - F.col("h"))
    return bracketed(above, profile, "agl", "z", "U").withColumn("value", F.when(F.col("agl") < 0, 0.0).otherwise(F.col("value"))).drop("z_below", "z_above", "h")


def strided_inflow(points: DataFrame, modes: DataFrame, step: Column, stride: int, dt: float, between: bool = True) -> DataFrame:
    """points with u at their step: modes are summed at every stride-th step; between two of them the sums are blended by time, or the earlier one holds."""
    first = F.floor(step / stride) * stride
    share = (step - first) / stride if between else F.lit(0.0)
    early = mode_sum(points.withColumn("t_", first * dt), modes, F.col("t_")).withColumnRenamed("u", "u0")
    both = mode_sum(early.withColumn("t_", (first + stride) * dt), modes, F.col("t_"))
    return both.select(*points.columns, (F.col("u0") + (F.col("u") - F.col("u0")) * share).alias("u"))


def face_fields(faces: DataFrame, branches: dict[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The faces' points (patch, x, y, z) with `value`: each patch by its own branch, which adds that column to its points. Patches without a branch go."""
    out = None
    for patch, branch in branches.items():
        one = branch(faces.where(F.col("patch") == patch)).select("patch", "x", "y", "z", F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def mode_sum(points: DataFrame, modes: DataFrame, t: float | Column) -> DataFrame:
    """points with u: the sum over modes of amplitude * cos(kx x + ky y + kz z - omega t + phase).

    modes (kx, ky, kz, omega, amplitude, phase) is a fixed list of some hundred rows; it goes to
    every task as one array, so points don't multiply.
    """
    table = modes.agg(F.array_sort(F.collect_list(F.struct("kx", "ky", "kz", "omega", "amplitude", "phase"))).alias("modes"))
    phase = lambda m: m["kx"] * F.col("x") + m["ky"] * F.col("y") + m["kz"] * F.col("z") - m["omega"] * t + m["phase"]
    return points.join(F.broadcast(table)).select(*points.columns, F.aggregate("modes", F.lit(0.0), lambda a, m: a + m["amplitude"] * F.cos(phase(m))).alias("u"))


# ---------------------------------------------------------------- dense solves


def _neighbourhoods(queries: DataFrame, points: DataFrame, value: str, k: int) -> DataFrame:
    near = k_nearest(queries, points.select("vec_id", "px", "py"), k).join(points.select("vec_id", "px", "py", value), "vec_id").join(queries, "qid")
    rows = near.groupBy("qid").agg(F.first("qx").alias("qx"), F.first("qy").alias("qy"), F.array_sort(F.collect_list(F.struct("rank", "px", "py", F.col(value).alias("v")))).alias("s"))
    return rows.select("qid", "qx", "qy", F.transform("s", lambda s: s["px"]).alias("xs"), F.transform("s", lambda s: s["py"]).alias("ys"), F.transform("s", lambda s: s["v"]).alias("vs"))


def _solved(rows: DataFrame, system) -> DataFrame:
    """(qid, value) from neighbourhoods (qid, qx, qy, xs, ys, vs): system(dx, dy, v) takes all of one size at once, [rows, neighbours]."""

    def run(batches):
        for b in batches:
            out = np.full(len(b), np.nan)
            sizes = b["xs"].map(len).to_numpy()
            for n in np.unique(sizes):
                i = np.flatnonzero(sizes == n)
                x, y, v = (np.stack(b[c].to_numpy()[i]).astype(float) for c in ("xs", "ys", "vs"))
                out[i] = system(x - b["qx"].to_numpy()[i, None], y - b["qy"].to_numpy()[i, None], v)
            yield pd.DataFrame({"qid": b["qid"], "value": out})

    return rows.mapInPandas(run, "qid bigint, value double")


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a x = b for stacked systems; rows whose system is singular are NaN."""
    try:
        return np.linalg.solve(a, b[..., None])[..., 0]
    except np.linalg.LinAlgError:
        out = np.full(b.shape, np.nan)
        for k in np.flatnonzero(np.linalg.matrix_rank(a) == a.shape[-1]):
            out[k] = np.linalg.solve(a[k], b[k])
        return out


def kriging(queries: DataFrame, points: DataFrame, value: str, k: int, reach: float) -> DataFrame:
    """(qid, value): ordinary kriging of the k nearest points with an exponential variogram of the given reach.

    A point at the query is taken as it is; equal values give that value; results stay within the
    neighbours' range; where a system can't be solved, inverse distances stand in.
    """

    def system(dx, dy, v):
        m, n = v.shape
        d0 = np.hypot(dx, dy)
        a = np.ones((m, n + 1, n + 1))
        a[:, :n, :n] = 1 - np.exp(-np.hypot(dx[:, :, None] - dx[:, None], dy[:, :, None] - dy[:, None]) / reach)
        a[:, n, n] = 0
        w = _solve(a, np.concatenate([1 - np.exp(-d0 / reach), np.ones((m, 1))], axis=1))[:, :n]
        far = 1 / np.maximum(d0, 1e-10) ** 2
        w = np.where(np.isfinite(w).all(axis=1, keepdims=True), w, far / far.sum(axis=1, keepdims=True))
        out = np.clip((w * v).sum(axis=1), v.min(axis=1), v.max(axis=1))
        return np.where(d0.min(axis=1) <= 1e-10, v[np.arange(m), d0.argmin(axis=1)], out)

    return _solved(_neighbourhoods(queries, points, value, k), system)


def _quadratic(dx: np.ndarray, dy: np.ndarray, v: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Values at (0, 0) of weighted quadratic fits."""
    m = np.stack([np.ones_like(dx), dx, dy, dx * dx, dx * dy, dy * dy], axis=2)
    mw = m * w[:, :, None]
    a = np.einsum("rni,rnj->rij", mw, m) + ridge * np.eye(6)
    return _solve(a, np.einsum("rni,rn->ri", mw, v))[:, 0]


def moving_least_squares(queries: DataFrame, points: DataFrame, value: str, k: int, ridge: float = 1e-9) -> DataFrame:
    """(qid, value): a quadratic fitted to the k nearest points with Wendland weights, a little regularised.

    A fit that leaves the neighbours' range by more than half of it has weights below zero that
    outweigh the rest; it is drawn back to the weighted mean by what it is too far.
    """

    def system(dx, dy, v):
        r = np.hypot(dx, dy)
        h = np.maximum(r.max(axis=1, keepdims=True) * 1.05, 1e-12)
        w = (1 - r / h) ** 4 * (4 * r / h + 1)
        fit = _quadratic(dx / h, dy / h, v, w, ridge)
        mean = (w * v).sum(axis=1) / w.sum(axis=1)
        low, high = v.min(axis=1), v.max(axis=1)
        over = np.maximum(np.maximum(fit - high, low - fit) - 0.5 * (high - low), 0)
        return np.where(np.isfinite(fit), fit + (mean - fit) * over / np.maximum(over + high - low, 1e-300), mean)

    return _solved(_neighbourhoods(queries, points, value, k), system)


def face_fit(queries: DataFrame, samples: DataFrame, value: str, k: int = 64) -> DataFrame:
    """(qid, value): a quadratic over the k nearest samples of the query's own face, by Gaussian weights.

    queries: qid, face, qx, qy; samples: vec_id, face, px, py and value, places within the face. The
    weights' spread is half the distance of the farthest sample used. Fewer than six samples, or a fit
    that can't be solved, give the weighted mean; a sample at the query is taken as it is; faces
    without samples give no row.
    """

    def system(dx, dy, v):
        r2 = dx * dx + dy * dy
        far = np.maximum(r2.max(axis=1, keepdims=True), 1e-12)
        w = np.exp(-r2 / (0.5 * far))
        mean = (w * v).sum(axis=1) / w.sum(axis=1)
        unit = np.sqrt(far)
        fit = _quadratic(dx / unit, dy / unit, v, w, 0.0) if v.shape[1] >= 6 else np.full(len(v), np.nan)
        out = np.where(np.isfinite(fit), fit, mean)
        return np.where(r2.min(axis=1) <= 1e-16, v[np.arange(len(v)), r2.argmin(axis=1)], out)

    faces = [r[0] for r in samples.select("face").distinct().orderBy("face").collect()]  # the six sides of a box
    out = None
    for f in faces:
        one = _solved(_neighbourhoods(queries.where(F.col("face") == f), samples.where(F.col("face") == f), value, k), system)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else queries.select("qid", F.lit(None).cast("double").alias("value")).where("false")


def layer_spectrum(grid: DataFrame, nx: int, ny: int, value: str) -> DataFrame:
    """(z, kx, ky, energy): squared Fourier amplitudes of each layer about its mean, by integer wave numbers.

    A layer is the unit of the transform and goes to one task; missing cells count as the mean.
    """

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((ny, nx), np.nan)
        a[pdf["y"], pdf["x"]] = pdf[value]
        a = np.nan_to_num(a - np.nanmean(a))
        e = np.abs(np.fft.fft2(a) / (nx * ny)) ** 2
        ky, kx = np.meshgrid(np.fft.fftfreq(ny, 1 / ny), np.fft.fftfreq(nx, 1 / nx), indexing="ij")
        return pd.DataFrame({"z": int(pdf["z"].iloc[0]), "kx": kx.ravel().astype(int), "ky": ky.ravel().astype(int), "energy": e.ravel()})

    return grid.select("z", "y", "x", value).groupBy("z").applyInPandas(transform, "z bigint, kx bigint, ky bigint, energy double")


def volume_spectrum(grid: DataFrame, nx: int, ny: int, nz: int, value: str) -> DataFrame:
    """(kx, ky, kz, energy) of the whole volume: layers first, then pencils along z, so that no task holds the volume."""
    mean = grid.agg(F.avg(value).alias("whole"))
    centred = grid.join(F.broadcast(mean)).withColumn(value, F.col(value) - F.col("whole"))

    def planes(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((ny, nx))
        a[pdf["y"], pdf["x"]] = pdf[value]
        c = np.fft.fft2(a) / (nx * ny)
        ky, kx = np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij")
        return pd.DataFrame({"z": int(pdf["z"].iloc[0]), "kx": kx.ravel(), "ky": ky.ravel(), "re": c.real.ravel(), "im": c.imag.ravel()})

    def pencils(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(nz, complex)
        a[pdf["z"]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        signed = lambda k, n: k - n if 2 * k > n else k
        return pd.DataFrame({"kx": signed(int(pdf["kx"].iloc[0]), nx), "ky": signed(int(pdf["ky"].iloc[0]), ny), "kz": np.fft.fftfreq(nz, 1 / nz).astype(int), "energy": np.abs(np.fft.fft(a) / nz) ** 2})

    layers = centred.select("z", "y", "x", value).groupBy("z").applyInPandas(planes, "z bigint, kx bigint, ky bigint, re double, im double")
    return layers.groupBy("kx", "ky").applyInPandas(pencils, "kx bigint, ky bigint, kz bigint, energy double")


def spline_layer(grid: DataFrame, nx: int, ny: int, value: str, targets: list[tuple[float, float]]) -> DataFrame:
    """(z, target, value): each layer's cubic B-spline at fractional indices (fx, fy); null outside the grid."""

    def prefilter(a: np.ndarray) -> np.ndarray:
        """Coefficients along the last axis: a tridiagonal solve with mirrored ends."""
        n, c = a.shape[-1], 6 * a
        if n == 1:
            return a
        # Sweeps down and up the diagonals (1, 4, 1); the mirror doubles the neighbour of either end.
        up, out = np.empty(n), np.empty_like(c)
        up[0], out[..., 0] = 2 / 4, c[..., 0] / 4
        for i in range(1, n):
            left = 2.0 if i == n - 1 else 1.0
            pivot = 4 - left * up[i - 1]
            up[i], out[..., i] = 1 / pivot, (c[..., i] - left * out[..., i - 1]) / pivot
        for i in range(n - 2, -1, -1):
            out[..., i] -= up[i] * out[..., i + 1]
        return out

    def basis(t: float) -> np.ndarray:
        return np.array([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3]) / 6

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((ny, nx))
        a[pdf["y"], pdf["x"]] = pdf[value]
        c = prefilter(prefilter(a).T).T
        mirror = lambda i, n: abs(i) if i < n else 2 * (n - 1) - i
        out = []
        for k, (fx, fy) in enumerate(targets):
            if not (0 <= fx <= nx - 1 and 0 <= fy <= ny - 1):
                out.append((k, None))
                continue
            ix, iy = int(fx), int(fy)
            wx, wy = basis(fx - ix), basis(fy - iy)
            v = sum(wy[j] * wx[i] * c[mirror(iy - 1 + j, ny), mirror(ix - 1 + i, nx)] for j in range(4) for i in range(4))
            out.append((k, float(v)))
        return pd.DataFrame({"z": int(pdf["z"].iloc[0]), "target": [k for k, _ in out], "value": [v for _, v in out]})

    return grid.select("z", "y", "x", value).groupBy("z").applyInPandas(evaluate, "z bigint, target bigint, value double")
