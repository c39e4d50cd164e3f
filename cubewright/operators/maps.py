"""Orientation, mosaicity, strain, misorientation and comparison maps; instrument geometry."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, functions as F

from cubewright.core.cube import KEY

FWHM_FACTOR = 2 * math.sqrt(2 * math.log(2))
NOMINAL_PIXEL_UM = 6.5


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue of hue (in turns), saturation and value."""

    def channel(n: int) -> Column:
        k = (F.lit(float(n)) + h * 6) % 6
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return [channel(n) for n in (5, 3, 1)]


def orientation(df: DataFrame, axes: tuple[int, ...] = (0, 1), mu: str = "mu", full_scale: float | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(scan_id, y, x, o0[, o1], r, g, b): selected components of the mean, and their colour.

    Hue is the direction of the deviation from the scan's median, saturation its size against
    full_scale or the 98th percentile; white where there is no data or no mask. The median and
    the scale are two rows a scan that join back.
    """
    comps = [F.get(mu, F.lit(a)) for a in axes[:2]]
    rows = df.select(*KEY, *[c.alias(f"o{i}") for i, c in enumerate(comps)])
    names = [f"o{i}" for i in range(len(comps))]
    inside = rows.join(mask.select(*KEY), list(KEY), "left_semi") if mask is not None else rows
    ref = inside.groupBy("scan_id").agg(*[F.median(F.when(~F.isnan(n), F.col(n))).alias(f"m{i}") for i, n in enumerate(names)])

    def deviated(d: DataFrame) -> DataFrame:
        d = d.join(ref, "scan_id")
        dy = F.col("o1") - F.col("m1") if len(names) > 1 else F.lit(0.0)
        return d.withColumns({"dx": F.col("o0") - F.col("m0"), "dy": dy}).withColumn("mag", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))

    if full_scale is None:
        scale = deviated(inside).where(_finite(F.col("mag"))).groupBy("scan_id").agg(F.greatest(F.percentile("mag", 0.98), F.lit(1e-12)).alias("scale"))
    else:
        scale = ref.select("scan_id", F.lit(max(full_scale, 1e-12)).alias("scale"))
    out = deviated(rows).join(scale, "scan_id", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    hue = F.pmod(F.atan2("dy", "dx") / (2 * math.pi), F.lit(1.0))
    sat = F.least(F.greatest(F.col("mag") / F.col("scale"), F.lit(0.0)), F.lit(1.0))
    valid = _finite(F.col("mag"))
    if mask is not None:
        out = out.join(mask.select(*KEY, F.lit(True).alias("_in")), list(KEY), "left")
        valid = valid & F.coalesce("_in", F.lit(False))
    rgb = [F.when(valid, c).otherwise(F.lit(1.0)).alias(n) for n, c in zip("rgb", hsv_to_rgb(hue, sat, F.lit(1.0)), strict=True)]
    return out.select(*KEY, *names, *rgb)


def orientation_stamp(df: DataFrame, ranges: list[tuple[float, float]], mu: str = "mu", mask: DataFrame | None = None) -> DataFrame:
    """(scan_id, y, x, r, g, b) from a fixed range an axis: hue around the range's middle, saturation
    outwards. Grey (0.2) out of range, black without data or mask. The colour wheel is our own."""
    if len(ranges) != 2 or any(hi <= lo for lo, hi in ranges):
        raise ValueError("two axes with ranges that aren't empty are needed")
    u, v = ((F.get(mu, F.lit(i)) - lo) / (hi - lo) * 2 - 1 for i, (lo, hi) in enumerate(ranges))
    rows = df.select(*KEY, u.alias("u"), v.alias("v"))
    valid = _finite(F.col("u")) & _finite(F.col("v"))
    if mask is not None:
        rows = rows.join(mask.select(*KEY, F.lit(True).alias("_in")), list(KEY), "left")
        valid = valid & F.coalesce("_in", F.lit(False))
    inside = (F.abs("u") <= 1) & (F.abs("v") <= 1)
    rgb = hsv_to_rgb(F.pmod(F.atan2("v", "u") / (2 * math.pi), F.lit(1.0)), F.least(F.greatest(F.abs("u"), F.abs("v")), F.lit(1.0)), F.lit(1.0))
    return rows.select(*KEY, *[F.when(valid & inside, c).when(valid, F.lit(0.2)).otherwise(F.lit(0.0)).alias(n) for n, c in zip("rgb", rgb, strict=True)])


def mosaicity(df: DataFrame, mode: str = "scalar", axes: tuple[int, ...] | None = None, cov: str = "cov") -> DataFrame:
    """Spread of the orientation: scalar gives sqrt of the trace; ellipse the full widths along the
    axes of the 2 by 2 block and the major one's angle in degrees, from -90 to 90."""

    def at(i: int, j: int) -> Column:
        return F.get(F.get(cov, F.lit(i)), F.lit(j))

    if mode == "scalar":
        trace = F.aggregate(F.sequence(F.lit(0), F.size(cov) - 1), F.lit(0.0), lambda s, i: s + F.get(F.get(F.col(cov), i), i)) if axes is None else sum((at(a, a) for a in axes[1:]), at(axes[0], axes[0]))
        return df.select(*KEY, F.sqrt(F.greatest(trace, F.lit(0.0))).alias("mosaicity"))
    if mode != "ellipse":
        raise ValueError(f"mode must be scalar or ellipse, not {mode}")
    i, j = axes or (0, 1)
    a, b, d = at(i, i), (at(i, j) + at(j, i)) / 2, at(j, j)
    middle, reach = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + b * b)

    def width(x: Column) -> Column:
        return FWHM_FACTOR * F.sqrt(F.greatest(x, F.lit(0.0)))

    angle = F.degrees(F.atan2(2 * b, a - d) / 2)
    return df.select(*KEY, width(middle + reach).alias("major_fwhm"), width(middle - reach).alias("minor_fwhm"), angle.alias("angle_deg"))


def _reference(df: DataFrame, c: Column, given: float | None, mask: DataFrame | None) -> DataFrame:
    rows = df if mask is None else df.join(mask.select(*KEY), list(KEY), "left_semi")
    ref = F.lit(float(given)) if given is not None else F.median(F.when(~F.isnan(c), c))
    return rows.groupBy("scan_id").agg(ref.alias("ref"))


def strain(df: DataFrame, c: Column, motor: str = "ccmth", reference: float | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(scan_id, y, x, strain) from a map of angles in degrees; the reference defaults to the scan's
    median over mask. Null where the reference's tangent is 0.

    ccmth: (t - t0) / tan t0; obpitch: -(o - o0) / (2 tan(o0 / 2)).
    """
    rows = df.select(*KEY, c.alias("_c"))
    rows = rows.join(_reference(rows, F.col("_c"), reference, mask), "scan_id")
    delta = F.radians(F.col("_c")) - F.radians(F.col("ref"))
    if motor == "ccmth":
        value = F.try_divide(delta, F.tan(F.radians("ref")))
    elif motor == "obpitch":
        value = F.try_divide(-delta, 2 * F.tan(F.radians("ref") / 2))
    else:
        raise ValueError(f"no strain formula for {motor}")
    return rows.select(*KEY, value.alias("strain"))


def kam(df: DataFrame, comps: list[Column], size: tuple[int, int] = (3, 3), min_neighbors: int = 1) -> DataFrame:
    """(scan_id, y, x, kam): mean distance to the neighbours in a window that are there.

    Pixels with a component that isn't finite are missing, as centres (NaN) and as neighbours;
    fewer than min_neighbors give NaN. Each pixel goes once to each place of the window, and an
    equi-join brings the pairs together.
    """
    rows = df.select(*KEY, F.array(*comps).alias("c"))
    good = F.forall("c", _finite)
    ry, rx = size[0] // 2, size[1] // 2
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-ry, ry + 1) for b in range(-rx, rx + 1) if a or b])
    spread = rows.where(good).select("scan_id", (F.col("y")).alias("yy"), F.col("x").alias("xx"), F.col("c").alias("n"), F.explode(steps).alias("s"))
    spread = spread.select("scan_id", (F.col("yy") + F.col("s.a")).cast("int").alias("y"), (F.col("xx") + F.col("s.b")).cast("int").alias("x"), "n")
    distance = F.sqrt(F.aggregate(F.zip_with("c", "n", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
    mean = rows.where(good).join(spread, list(KEY)).groupBy(*KEY).agg(F.avg(distance).alias("k"), F.count("*").alias("n"))
    nan = F.lit(float("nan"))
    return rows.join(mean, list(KEY), "left").select(*KEY, F.when(F.col("n") >= max(1, min_neighbors), F.col("k")).otherwise(nan).alias("kam"))


def pseudo_voigt_fwhm(sigma: Column, gamma: Column) -> Column:
    """The fifth-order formula for the width of a Gaussian folded with a Lorentzian."""
    g, w = FWHM_FACTOR * F.abs(sigma), 2 * F.abs(gamma)
    terms = ((5, 0, 1.0), (4, 1, 2.69269), (3, 2, 2.42843), (2, 3, 4.47163), (1, 4, 0.07842), (0, 5, 1.0))
    total = F.lit(0.0)
    for p, q, k in terms:
        total = total + k * F.pow(g, F.lit(float(p))) * F.pow(w, F.lit(float(q)))
    return F.pow(total, F.lit(0.2))


def compare_maps(one: DataFrame, two: DataFrame, col: str, mask: DataFrame | None = None, step: float | None = None) -> DataFrame:
    """Statistics of two - one over common pixels that are finite in both, for each scan."""
    both = one.select(*KEY, F.col(col).alias("a")).join(two.select(*KEY, F.col(col).alias("b")), list(KEY))
    both = both if mask is None else both.join(mask.select(*KEY), list(KEY), "left_semi")
    both = both.where(_finite(F.col("a")) & _finite(F.col("b"))).withColumn("d", F.col("b") - F.col("a"))
    size = F.abs("d")
    return both.groupBy("scan_id").agg(
        F.count("*").alias("n"),
        F.median(size).alias("median_abs"),
        F.percentile(size, 0.95).alias("p95_abs"),
        F.avg("d").alias("mean"),
        F.stddev_pop("d").alias("std"),
        F.when((F.count("*") > 1) & (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0), F.corr("a", "b")).alias("pearson_r"),
        (F.avg((size <= step).cast("double")) if step is not None else F.lit(None).cast("double")).alias("within_step"),
    )


def geometric_mean(c: Column) -> Column:
    """exp of the mean logarithm of the positive values."""
    return F.exp(F.avg(F.when(F.abs(c) > 0, F.ln(F.abs(c)))))


def two_peak_separation(df: DataFrame) -> DataFrame:
    """(scan_id, y, x, d0, d1, mahalanobis) between two fitted peaks of two motors; zeros unless n_peaks is 2."""
    d = [F.get("mu2", F.lit(k)) - F.get("mu1", F.lit(k)) for k in (0, 1)]

    def pooled(i: int, j: int) -> Column:
        return (F.get(F.get("cov1", F.lit(i)), F.lit(j)) + F.get(F.get("cov2", F.lit(i)), F.lit(j))) / 2

    a, b, c = pooled(0, 0), pooled(0, 1), pooled(1, 1)
    q = F.try_divide(c * d[0] * d[0] - 2 * b * d[0] * d[1] + a * d[1] * d[1], a * c - b * b)
    two = F.col("n_peaks") == 2
    return df.select(*KEY, *[F.when(two, x).otherwise(F.lit(0.0)).alias(f"d{i}") for i, x in enumerate(d)], F.when(two, F.sqrt(F.greatest(q, F.lit(0.0)))).otherwise(F.lit(0.0)).alias("mahalanobis"))


# Geometry: formulas over the map of motors that stand still ---------------------------------


def magnification_col(motors: Column) -> Column:
    """d2 / d1 from obx, mainx and obpitch; NaN where they are missing or degenerate."""
    cos = F.cos(F.radians(F.try_element_at(motors, F.lit("obpitch"))))
    d1 = F.try_divide(F.try_element_at(motors, F.lit("obx")), cos)
    d2 = F.try_divide(F.abs(F.try_element_at(motors, F.lit("mainx"))), cos) - d1
    return F.when((d1 > 0) & (d2 > 0), F.try_divide(d2, d1)).otherwise(F.lit(float("nan")))


def objective_col(motors: Column, ffsel_tol: float = 1.0) -> Column:
    ffsel = F.try_element_at(motors, F.lit("ffsel"))
    return F.when(ffsel.isNull(), F.lit(float("nan"))).when(F.abs(ffsel) < ffsel_tol, F.lit(10.0)).otherwise(F.lit(2.0))


def pixel_size_col(motors: Column, nominal: float = NOMINAL_PIXEL_UM) -> Column:
    """Micrometres of the sample a pixel; the nominal size where the magnification can't be told."""
    m, o = magnification_col(motors), objective_col(motors)
    return F.when(F.isnan(m) | (m <= 0), F.lit(nominal)).otherwise(F.try_divide(F.lit(nominal), m * F.when(F.isnan(o), F.lit(2.0)).otherwise(o)))


def pixel_size_um(motors: dict, nominal: float = NOMINAL_PIXEL_UM) -> float:
    """The same for one scan's motors, with warnings where it falls back."""
    try:
        obx, mainx, pitch = (float(motors[k]) for k in ("obx", "mainx", "obpitch"))
        cos = math.cos(math.radians(pitch))
        d1 = obx / cos
        m = (abs(mainx) / cos - d1) / d1
    except (KeyError, TypeError, ValueError, ZeroDivisionError):
        d1 = m = -1.0
    if d1 <= 0 or m <= 0:
        warnings.warn("the magnification can't be told from obx, mainx and obpitch: using the nominal pixel size", stacklevel=2)
        return nominal
    if motors.get("ffsel") is None:
        warnings.warn("ffsel is missing: taking the objective to be out of the beam", stacklevel=2)
    return nominal / (m * (10.0 if motors.get("ffsel") is not None and abs(float(motors["ffsel"])) < 1 else 2.0))
