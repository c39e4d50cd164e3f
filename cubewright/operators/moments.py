"""Intensity-weighted moments, truncation at the edges and status of fits."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.core.cube import KEY, Cube

NO_SIGNAL, OK, EDGE_CLIPPED, FAILED = 0, 1, 2, 3


def _middle(cube: Cube, d: int) -> Column:
    """An axis's coordinate in the middle of the grid, as a constant where the axes are formulas of
    the indexes; 0 where they are columns of the table."""
    middle = {f"i{k}": m // 2 for k, m in enumerate(cube.grid)}
    spark = cube.voxels.sparkSession
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in middle.items()])
    try:
        return F.lit(float(row.select(cube.axes[d]).first()[0]))
    except AnalysisException:
        return F.lit(0.0)


def moments(cube: Cube, order: int = 2, mask: DataFrame | None = None) -> DataFrame:
    """(scan_id, y, x, mu, cov[, skew, kurt]) of each pixel, weighted by counts.

    mu array<double>; cov array<array<double>>; order 4 adds skew and excess kurtosis an axis,
    0 where the standard deviation is at most 1e-12. Pixels without counts have zeros, and so
    have pixels outside of mask. One aggregate does it, with coordinates counted from the
    middle of the grid, so that raw sums keep their digits.
    """
    if order not in (2, 4):
        raise ValueError("order must be 2 or 4")
    dims = range(len(cube.grid))
    shift = [_middle(cube, d) for d in dims]
    rows = cube.voxels if mask is None else cube.masked(mask).voxels
    rows = rows.select(*KEY, F.col("v").cast("double").alias("v"), *[(cube.axes[d] - shift[d]).alias(f"c{d}") for d in dims])
    aggs = [F.sum("v").alias("s")]
    for d in dims:
        aggs += [F.sum(F.col("v") * F.pow(F.col(f"c{d}"), F.lit(float(p)))).alias(f"s{d}_{p}") for p in range(1, 5 if order == 4 else 3)]
        aggs += [F.sum(F.col("v") * F.col(f"c{d}") * F.col(f"c{e}")).alias(f"x{d}_{e}") for e in dims if e > d]
    sums = rows.groupBy(*KEY).agg(*aggs)

    def mean(c: Column) -> Column:
        return F.when(F.col("s") != 0, c / F.col("s")).otherwise(F.lit(0.0))

    m = {(d, p): mean(F.col(f"s{d}_{p}")) for d in dims for p in range(1, 5 if order == 4 else 3)}

    def cov(d: int, e: int) -> Column:
        if d == e:
            return F.greatest(m[d, 2] - m[d, 1] * m[d, 1], F.lit(0.0))
        d, e = min(d, e), max(d, e)
        return mean(F.col(f"x{d}_{e}")) - m[d, 1] * m[e, 1]

    cols = [F.array(*[F.when(F.col("s") != 0, m[d, 1] + shift[d]).otherwise(F.lit(0.0)) for d in dims]).alias("mu"), F.array(*[F.array(*[cov(d, e) for e in dims]) for d in dims]).alias("cov")]
    if order == 4:
        skew, kurt = [], []
        for d in dims:
            u, var = m[d, 1], cov(d, d)
            sd = F.sqrt(var)
            m3 = m[d, 3] - 3 * u * m[d, 2] + 2 * u * u * u
            m4 = m[d, 4] - 4 * u * m[d, 3] + 6 * u * u * m[d, 2] - 3 * u * u * u * u
            skew.append(F.when(sd > 1e-12, F.try_divide(m3, sd * sd * sd)).otherwise(F.lit(0.0)))
            kurt.append(F.when(sd > 1e-12, F.try_divide(m4, var * var) - 3).otherwise(F.lit(0.0)))
        cols += [F.array(*skew).alias("skew"), F.array(*kurt).alias("kurt")]
    out = sums.select(*KEY, *cols)
    if mask is None:
        return out
    every = cube.pixels().join(out, list(KEY), "left")
    k = len(cube.grid)
    zero = F.array_repeat(F.lit(0.0), k)
    fill = {"mu": zero, "cov": F.array_repeat(zero, k), "skew": zero, "kurt": zero}
    return every.select(*KEY, *[F.coalesce(c, fill[c]).alias(c) for c in out.columns[len(KEY) :]])


def motor_ranges_steps(motors: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, lo, hi, step) of each column: ends of its finite values and the median positive step of
    the sorted distinct ones, 0 for a single one."""
    long = motors.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("c")) for a in axes])).alias("e")).select("e.axis", "e.c")
    long = long.where(F.col("c").isNotNull() & ~F.isnan("c") & (F.abs("c") < float("inf"))).distinct()
    step = F.col("c") - F.lag("c").over(Window.partitionBy("axis").orderBy("c"))
    return long.select("axis", "c", step.alias("step")).groupBy("axis").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.coalesce(F.median(F.when(F.col("step") > 0, F.col("step"))), F.lit(0.0)).alias("step")
    )


def axis_peaks(cube: Cube, axis: int) -> DataFrame:
    """(scan_id, y, x, peak): where the profile along an axis is highest; the first, of equals."""
    profile = cube.voxels.groupBy(*KEY, f"i{axis}").agg(F.sum("v").alias("p"))
    return profile.groupBy(*KEY).agg((-F.max(F.struct("p", (-F.col(f"i{axis}")).alias("k")))["k"]).alias("peak"))


def per_axis_edge(cube: Cube, edge_bins: int = 3) -> DataFrame:
    """(scan_id, y, x, e0[, e1, ...]): whether the profile peaks within edge_bins of either end."""
    out = None
    for d, m in enumerate(cube.grid):
        p = axis_peaks(cube, d).select(*KEY, ((F.col("peak") < edge_bins) | (F.col("peak") >= m - edge_bins)).alias(f"e{d}"))
        out = p if out is None else out.join(p, list(KEY))
    return out


def edge_peak_mask(cube: Cube, edge_bins: int = 3, axes: list[int] | None = None) -> DataFrame:
    """(scan_id, y, x, edge): whether any of the axes' profiles peaks at an end. Dark pixels do."""
    axes = list(range(len(cube.grid))) if axes is None else axes
    flags = per_axis_edge(cube, edge_bins)
    any_edge = F.lit(False)
    for d in axes:
        any_edge = any_edge | F.col(f"e{d}")
    return flags.select(*KEY, any_edge.alias("edge"))


def fit_status(mu: list[Column], success: Column, ranges: list[tuple[float, float]], steps: list[float], in_mask: Column | None = None, edge_tol_steps: float = 1.0, data_edge: Column | None = None, amplitude: Column | None = None) -> Column:
    """0 no signal, 1 good, 2 clipped at an edge, 3 failed, as a byte column.

    A converged fit with a centre within edge_tol_steps of a range's end is clipped, one further
    out or not finite has failed; a failed pixel whose data peak at the edge is clipped. A fit
    whose amplitude isn't positive and finite has not converged.
    """
    if not len(mu) == len(ranges) == len(steps):
        raise ValueError("one range and one step are needed for each axis")
    converged = success > 0.5
    if amplitude is not None:
        converged = converged & (amplitude > 0) & ~F.isnan(amplitude) & (amplitude < float("inf"))
    near, out = F.lit(False), F.lit(False)
    for c, (lo, hi), step in zip(mu, ranges, steps, strict=True):
        tol = edge_tol_steps * step
        near = near | (c <= lo + tol) | (c >= hi - tol)
        out = out | c.isNull() | F.isnan(c) | (c < lo - tol) | (c > hi + tol)
    status = F.when(converged & ~out & near, F.lit(EDGE_CLIPPED)).when(converged & ~out & ~near, F.lit(OK))
    if data_edge is not None:
        status = status.when(data_edge, F.lit(EDGE_CLIPPED))
    status = status.otherwise(F.lit(FAILED))
    if in_mask is not None:
        status = F.when(in_mask, status).otherwise(F.lit(NO_SIGNAL))
    return status.cast("tinyint")


def clamp(mu: list[Column], ranges: list[tuple[float, float]]) -> list[Column]:
    """Centres clipped to the scanned range, for display only."""
    return [F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))) for c, (lo, hi) in zip(mu, ranges, strict=True)]


def robust_limits(values: DataFrame, col: str, n_sigma: float = 3.0, symmetric: bool = False) -> DataFrame:
    """(lo, hi): median and so many population standard deviations; (0, 1) without finite values."""
    x = F.col(col).cast("double")
    fine = values.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    got = fine.agg(F.median(x).alias("m"), F.greatest(F.stddev_pop(x), F.lit(1e-12)).alias("s"))
    reach = F.abs("m") + n_sigma * F.col("s")
    lo, hi = (-reach, reach) if symmetric else (F.col("m") - n_sigma * F.col("s"), F.col("m") + n_sigma * F.col("s"))
    return got.select(F.coalesce(lo, F.lit(0.0)).alias("lo"), F.coalesce(hi, F.lit(1.0)).alias("hi"))
