"""Background, thresholds, regions of interest, hot pixels and masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.core.cube import KEY, Cube

# Background ----------------------------------------------------------------------------------


def darkest_frames(cube: Cube, k: int = 5) -> DataFrame:
    """(scan_id, frame) of each scan's k frames of lowest total; ties go by frame."""
    totals = cube.voxels.groupBy("scan_id", cube.frame().alias("frame")).agg(F.sum("v").alias("total"))
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy("total", "frame"))
    return totals.select("scan_id", "frame", rank.alias("r")).where(F.col("r") <= k).select("scan_id", "frame")


def estimate_background(cube: Cube, mode: str = "mean", n_lowest: int = 5, percentile: float = 10.0, darks: DataFrame | None = None, rounded: bool = True) -> DataFrame:
    """(scan_id, y, x, bg): mean or median of the darkest frames, or a percentile (pmedian: the
    median) of all frames, by linear interpolation; darks(scan_id, y, x, v) override the frames.

    rounded: half to even, as counts. An unknown mode raises ValueError.
    """
    if darks is not None:
        bg = darks.groupBy(*KEY).agg(F.avg("v").alias("bg"))
    elif mode in ("mean", "lowest", "median"):
        dark = cube.voxels.withColumn("frame", cube.frame()).join(darkest_frames(cube, n_lowest), ["scan_id", "frame"], "left_semi")
        bg = dark.groupBy(*KEY).agg((F.median("v") if mode == "median" else F.avg("v")).alias("bg"))
    elif mode in ("pmedian", "percentile"):
        bg = cube.voxels.groupBy(*KEY).agg(F.percentile("v", 0.5 if mode == "pmedian" else percentile / 100).alias("bg"))
    else:
        raise ValueError(f"unknown background mode: {mode}")
    return bg.withColumn("bg", F.rint("bg").cast("long")) if rounded else bg


def subtract(cube: Cube, background: DataFrame | float) -> Cube:
    """v - bg, and 0 where v is lower; a background image or one number, rounded half to even."""
    if isinstance(background, DataFrame):
        rows = cube.voxels.join(background, list(KEY)).withColumn("bg", F.rint("bg").cast("long"))
    else:
        rows = cube.voxels.withColumn("bg", F.rint(F.lit(float(background))).cast("long"))
    return cube.with_voxels(rows.withColumn("v", F.greatest("v", "bg") - F.col("bg")).drop("bg"))


def threshold(cube: Cube, bottom: float | None = None, top: float | None = None) -> Cube:
    """0 where v is below bottom or above top."""
    v: Column = F.col("v")
    out = v
    if top is not None:
        out = F.when(v > top, 0).otherwise(out)
    if bottom is not None:
        out = F.when(v < bottom, 0).otherwise(out)
    return cube.with_voxels(cube.voxels.withColumn("v", out.cast("long")))


def zsum(cube: Cube) -> DataFrame:
    return cube.voxels.groupBy(*KEY).agg(F.sum("v").cast("double").alias("zsum"))


def signed_zsum(cube: Cube, background: DataFrame) -> DataFrame:
    """Each pixel's sum of v - bg, not clamped."""
    total = cube.voxels.groupBy(*KEY).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return total.join(background, list(KEY)).select(*KEY, (F.col("s") - F.col("n") * F.col("bg")).cast("double").alias("zsum"))


def signal_retained(cube: Cube, background: DataFrame, mask: DataFrame | None = None, ref_percentile: float = 10.0, lit_nsigma: float = 5.0) -> DataFrame:
    """How much of the lit voxels' signal above a percentile floor a background leaves, for each scan.

    A voxel is lit where v > floor + lit_nsigma * sqrt(max(floor, 1)). Pixels outside of mask
    count nowhere. retained is null where the signal isn't positive.
    """
    cube = cube if mask is None else cube.masked(mask)
    floor = estimate_background(cube, "percentile", percentile=ref_percentile, rounded=False).withColumnRenamed("bg", "floor")
    rows = cube.voxels.join(floor, list(KEY)).join(background, list(KEY))
    lit = F.col("v") > F.col("floor") + lit_nsigma * F.sqrt(F.greatest("floor", F.lit(1.0)))
    pixel = rows.groupBy(*KEY).agg(
        F.sum(F.when(lit, F.greatest(F.col("v") - F.col("bg"), F.lit(0)))).alias("kept"),
        F.sum(F.when(lit, F.col("v") - F.col("floor"))).alias("signal"),
        F.first("bg").alias("bg"),
        F.first("floor").alias("floor"),
    )
    over = F.col("bg") - F.col("floor")
    return pixel.groupBy("scan_id").agg(
        F.when(F.sum("signal") > 0, F.try_divide(F.sum("kept").cast("double"), F.sum("signal"))).alias("retained"),
        F.coalesce(F.sum("kept"), F.lit(0)).cast("double").alias("signal_kept"),
        F.coalesce(F.sum("signal"), F.lit(0.0)).alias("signal_floor"),
        F.median(over).alias("overshoot_median"),
        F.count_if(over > 0).alias("floored_px"),
        F.count("*").alias("grain_px"),
    )


# Regions and masks ---------------------------------------------------------------------------


def _with_top(z: DataFrame) -> DataFrame:
    """z with each scan's largest zsum as top: an aggregate that joins back, so that no scan's pixels meet in one task."""
    return z.join(z.groupBy("scan_id").agg(F.max("zsum").alias("top")), "scan_id")


def auto_roi(cube: Cube, threshold_rel: float = 0.05, pad: int = 20) -> DataFrame:
    """(scan_id, r1, r2, c1, c2): the padded box of pixels whose sum exceeds threshold_rel of the
    largest; the whole detector where there are none."""
    z = _with_top(zsum(cube))
    lit = F.col("zsum") > threshold_rel * F.col("top")
    ny, nx = cube.shape
    return z.groupBy("scan_id").agg(
        F.greatest(F.lit(0), F.coalesce(F.min(F.when(lit, F.col("y"))) - pad, F.lit(0))).cast("int").alias("r1"),
        F.least(F.lit(ny), F.coalesce(F.max(F.when(lit, F.col("y"))) + 1 + pad, F.lit(ny))).cast("int").alias("r2"),
        F.greatest(F.lit(0), F.coalesce(F.min(F.when(lit, F.col("x"))) - pad, F.lit(0))).cast("int").alias("c1"),
        F.least(F.lit(nx), F.coalesce(F.max(F.when(lit, F.col("x"))) + 1 + pad, F.lit(nx))).cast("int").alias("c2"),
    )


def otsu(values: DataFrame, col: str, bins: int = 256) -> DataFrame:
    """(scan_id, threshold): the centre of the bin that maximises the variance between classes.

    The histogram is the only thing that meets in one place: bins rows a scan. Values that are
    null, NaN or infinite don't count; equal values give themselves, none give 0.
    """
    x = F.col(col)
    fine = values.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select("scan_id", x.cast("double").alias("_x"))
    ends = fine.groupBy("scan_id").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.try_divide(F.col("_x") - F.col("lo"), width)), F.lit(bins - 1))
    hist = fine.join(ends, "scan_id").where("hi > lo").groupBy("scan_id", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    hist = hist.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    up, every = Window.partitionBy("scan_id").orderBy("bin"), Window.partitionBy("scan_id")
    w, m = F.sum("n").over(up), F.sum(F.col("n") * F.col("centre")).over(up)
    hist = hist.select("scan_id", "bin", "centre", w.alias("w"), m.alias("m"), F.sum("n").over(every).alias("wt"), F.sum(F.col("n") * F.col("centre")).over(every).alias("mt"))
    between = F.try_divide(F.pow(F.col("mt") * F.col("w") / F.col("wt") - F.col("m"), F.lit(2.0)), (F.col("w") * (F.col("wt") - F.col("w"))).cast("double"))
    best = hist.where("w < wt").groupBy("scan_id").agg(F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("k"), "centre"))["centre"].alias("t"))
    scans = values.select("scan_id").distinct()
    return scans.join(ends, "scan_id", "left").join(best, "scan_id", "left").select("scan_id", F.coalesce("t", "lo", F.lit(0.0)).alias("threshold"))


def _dilate(m: np.ndarray) -> np.ndarray:
    out = m.copy()
    out[1:] |= m[:-1]
    out[:-1] |= m[1:]
    out[:, 1:] |= m[:, :-1]
    out[:, :-1] |= m[:, 1:]
    return out


def close_and_fill(mask: np.ndarray, close: int = 2, fill: bool = True) -> np.ndarray:
    """Binary closing by a cross, so many times, then holes filled; outside counts as unset."""
    out = mask.copy()
    for _ in range(close):
        out = _dilate(out)
    for _ in range(close):
        out = ~_dilate(np.pad(~out, 1, constant_values=True))[1:-1, 1:-1]
    if fill:
        empty = np.pad(~out, 1, constant_values=True)
        outside = np.zeros_like(empty)
        outside[0] = outside[-1] = outside[:, 0] = outside[:, -1] = True
        while True:
            grown = _dilate(outside) & empty
            if (grown == outside).all():
                break
            outside = grown
        out = ~outside[1:-1, 1:-1]
    return out


def _morphology(cube: Cube, lit: DataFrame, close: int, fill: bool) -> DataFrame:
    """One image a scan: its lit pixels are the group."""
    if not close and not fill:
        return lit.select(*KEY)
    ny, nx = cube.shape

    def run(t: pa.Table) -> pa.Table:
        m = np.zeros((ny, nx), bool)
        m[t["y"].to_numpy(), t["x"].to_numpy()] = True
        y, x = np.nonzero(close_and_fill(m, close, fill))
        return pa.table({"scan_id": pa.array([t["scan_id"][0].as_py()] * len(y), pa.string()), "y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32))})

    return lit.select(*KEY).groupBy("scan_id").applyInArrow(run, "scan_id string, y int, x int")


def grain_mask(cube: Cube, threshold_rel: float = 0.05, method: str = "fraction", close: int = 2, fill: bool = True) -> DataFrame:
    """(scan_id, y, x) of the grain: sums above a fraction of the largest, or above Otsu's threshold."""
    z = zsum(cube)
    if method == "fraction":
        lit = _with_top(z).where(F.col("zsum") > threshold_rel * F.col("top"))
    elif method == "otsu":
        lit = z.join(otsu(z, "zsum"), "scan_id").where("zsum > threshold")
    else:
        raise ValueError(f"unknown mask method: {method}")
    return _morphology(cube, lit, close, fill)


def grain_mask_robust(cube: Cube, zsum_threshold: float | None = None, peak_threshold: float | None = None, close: int = 2, fill: bool = True) -> DataFrame:
    """(scan_id, y, x) of pixels bright in sum, or in one voxel on a logarithmic scale."""
    z = cube.voxels.groupBy(*KEY).agg(F.sum("v").cast("double").alias("zsum"), F.max("v").alias("peak"))
    z = z.withColumn("log_peak", F.log10(F.col("peak") + 1.0))
    scans = z.select("scan_id").distinct()
    tz = scans.select("scan_id", F.lit(zsum_threshold).alias("tz")) if zsum_threshold is not None else otsu(z, "zsum").withColumnRenamed("threshold", "tz")
    tp = scans.select("scan_id", F.lit(peak_threshold).alias("tp")) if peak_threshold is not None else otsu(z, "log_peak").select("scan_id", F.pow(F.lit(10.0), "threshold").alias("tp"))
    lit = z.join(tz, "scan_id").join(tp, "scan_id").where((F.col("zsum") > F.col("tz")) | (F.col("peak") > F.col("tp")))
    return _morphology(cube, lit, close, fill)


def inside_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule for points against (column, row) vertices."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
            crossings = crossings + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


def polygon_mask(pixels: DataFrame, vertices: list[tuple[float, float]]) -> DataFrame:
    return pixels.where(inside_polygon(F.col("x").cast("double"), F.col("y").cast("double"), vertices)).select(*KEY)


def support_count(cube: Cube, motor_axis: int, level: float) -> DataFrame:
    """(scan_id, y, x, support): along an axis, how many planes hold a voxel above level."""
    if not 0 <= motor_axis < len(cube.grid):
        raise ValueError(f"no motor axis {motor_axis}")
    plane = cube.voxels.groupBy(*KEY, f"i{motor_axis}").agg(F.max(F.when(F.col("v") > level, 1).otherwise(0)).alias("lit"))
    return plane.groupBy(*KEY).agg(F.sum("lit").cast("smallint").alias("support"))


# Hot pixels ----------------------------------------------------------------------------------


def _median3(img: np.ndarray) -> np.ndarray:
    p = np.pad(img, 1, mode="edge")
    ny, nx = img.shape
    return np.median(np.stack([p[a : a + ny, b : b + nx] for a in range(3) for b in range(3)]), axis=0)


def _hot(img: np.ndarray, med: np.ndarray, n_sigma: float, one_sided: bool, floor: float, protect: np.ndarray | None) -> np.ndarray:
    diff = img - med
    limit = n_sigma * max(1.4826 * float(np.median(np.abs(diff))), floor)
    hot = diff > limit if one_sided else np.abs(diff) > limit
    return hot if protect is None else hot & ~protect


def remove_hot_pixels(cube: Cube, n_sigma: float = 5.0, one_sided: bool = False, min_sigma: float | None = None, method: str = "frame", protect: np.ndarray | None = None) -> Cube:
    """Replaces pixels that stand out from their 3 by 3 median by it.

    frame: each frame by its own median absolute deviation; static: pixels that stand out in the
    temporal median, in all frames; hybrid: static, then frame. protect (rows, columns) is left
    alone. The cube must be dense; a frame is the unit of work.
    """
    if method not in ("frame", "static", "hybrid"):
        raise ValueError(f"unknown hot pixel method: {method}")
    ny, nx = cube.shape
    floor = 1e-6 if min_sigma is None else min_sigma
    frames = cube.frames()
    if method in ("static", "hybrid"):
        medians = cube.voxels.groupBy(*KEY).agg(F.median("v").alias("v")).groupBy("scan_id")
        medians = medians.agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda e: e["v"]).alias("still"))
        frames = frames.join(medians, "scan_id")
    else:
        frames = frames.withColumn("still", F.lit(None).cast("array<double>"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str, np.ndarray] = {}
        for b in it:
            out = []
            for scan, px, still in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                img = np.array(px, float).reshape(ny, nx)
                if still.is_valid:
                    if scan not in maps:
                        base = np.array(still.as_py(), float).reshape(ny, nx)
                        maps[scan] = _hot(base, _median3(base), n_sigma, one_sided, floor, protect)
                    img = np.where(maps[scan], np.trunc(_median3(img)), img)
                if method != "static":
                    med = _median3(img)
                    img = np.where(_hot(img, med, n_sigma, one_sided, floor, protect), med, img)
                out.append(img.ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["scan_id", "frame", "px"])

    done = frames.select("scan_id", F.col("frame").cast("int").alias("frame"), F.col("px").cast("array<long>").alias("px"), "still")
    return cube.from_frames(done.mapInArrow(run, "scan_id string, frame int, px array<bigint>"))


def preview(cube: Cube, roi_threshold: float = 0.05, n_bins: int = 64, **background) -> dict[str, DataFrame]:
    """Before and after of a preprocessing: sums, background, what it keeps, region and histogram."""
    bg = estimate_background(cube, **background)
    clean = subtract(cube, bg)
    z = zsum(clean)
    lit = z.where("zsum > 0")
    ends = lit.groupBy("scan_id").agg(F.min("zsum").alias("lo"), F.max("zsum").alias("hi"))
    at = F.least(F.floor(F.try_divide((F.col("zsum") - F.col("lo")) * n_bins, F.col("hi") - F.col("lo"))), F.lit(n_bins - 1))
    return {
        "raw_zsum": zsum(cube),
        "proc_zsum": z,
        "background": bg,
        "retained": signal_retained(cube, bg),
        "roi": auto_roi(clean, roi_threshold, 0),
        "histogram": lit.join(ends, "scan_id").groupBy("scan_id", F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n")),
    }
