"""Frame order, motor grids, stacked and partial scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_argmax(value: Column, index: Column) -> Column:
    """Aggregate: the smallest index of the largest value."""
    return -F.max(F.struct(value.alias("v"), (-index).alias("k")))["k"]


def snake_order(frames: DataFrame, n_fast: int, fast: str = "fast", slow: str = "slow") -> DataFrame:
    """Adds i0, i1: each acquisition row by its fast motor, rows by the slow motor of their first frame.

    Positions count as 32-bit floats, ties go in order of acquisition; slow motors are never
    sorted within a row, so that jitter doesn't tear it.
    """
    rows = frames.withColumn("_row", F.floor(F.col("frame") / n_fast))
    in_row = Window.partitionBy("scan_id", "_row").orderBy(F.col(fast).cast("float"), "frame")
    rows = rows.withColumn("i1", (F.row_number().over(in_row) - 1).cast("int"))
    firsts = rows.where("i1 = 0").select("scan_id", "_row", F.col(slow).cast("float").alias("_slow"))
    firsts = firsts.withColumn("i0", (F.row_number().over(Window.partitionBy("scan_id").orderBy("_slow", "_row")) - 1).cast("int"))
    return rows.join(firsts.select("scan_id", "_row", "i0"), ["scan_id", "_row"]).drop("_row")


def value_order(frames: DataFrame, n_fast: int, first: str = "slow", second: str = "fast") -> DataFrame:
    """Adds i0, i1 by the motors' values as 32-bit floats, then by frame."""
    k = F.row_number().over(Window.partitionBy("scan_id").orderBy(F.col(first).cast("float"), F.col(second).cast("float"), "frame")) - 1
    return frames.withColumn("_k", k).withColumns({"i0": F.floor(F.col("_k") / n_fast).cast("int"), "i1": (F.col("_k") % n_fast).cast("int")}).drop("_k")


def rocking_order(frames: DataFrame, motor: str) -> DataFrame:
    return frames.withColumn("i0", (F.row_number().over(Window.partitionBy("scan_id").orderBy(F.col(motor).cast("float"), "frame")) - 1).cast("int"))


#: What the metadata call the return of the fast motor, and our names.
MODES = {"REWIND": "raster", "ZIGZAG": "zigzag"}


def acquisition_mode(frames: DataFrame, n_fast: int, fast: str = "fast", recorded: Column | None = None) -> DataFrame:
    """(scan_id, mode): raster, zigzag or unknown, as recorded, else by each row's direction."""
    rows = frames.withColumn("_row", F.floor(F.col("frame") / n_fast)).groupBy("scan_id", "_row")
    ways = rows.agg(F.signum(F.max_by(fast, "frame") - F.min_by(fast, "frame")).cast("int").alias("way"), F.count("*").alias("n"))
    before = F.lag("way").over(Window.partitionBy("scan_id").orderBy("_row"))
    ways = ways.withColumn("turned", before != F.col("way"))
    told = ways.groupBy("scan_id").agg(
        F.when((F.count("*") < 2) | (F.max("n") < 2) | F.bool_or(F.col("way") == 0), F.lit("unknown"))
        .when(~F.bool_or(F.coalesce("turned", F.lit(False))), F.lit("raster"))
        .when(F.bool_and("turned"), F.lit("zigzag"))
        .otherwise(F.lit("unknown"))
        .alias("mode")
    )
    if recorded is None:
        return told
    known = F.lit(None).cast("string")
    for k, v in MODES.items():
        known = F.when(F.upper("_said") == k, F.lit(v)).otherwise(known)
    said = frames.groupBy("scan_id").agg(F.first(recorded, ignorenulls=True).alias("_said"))
    return told.join(said, "scan_id").select("scan_id", F.when(F.col("_said").isNull(), F.col("mode")).otherwise(F.coalesce(known, F.lit("unknown"))).alias("mode"))


def separability(grid: DataFrame, axis: str, motor: str, tolerance: float = 0.25) -> DataFrame:
    """(scan_id, spread, step, separable): how far a motor strays among the points of one index of its
    axis, against the median step between indexes."""
    per = grid.groupBy("scan_id", axis).agg((F.max(motor) - F.min(motor)).alias("spread"), F.avg(motor).alias("c"))
    per = per.withColumn("step", F.abs(F.col("c") - F.lag("c").over(Window.partitionBy("scan_id").orderBy(axis))))
    out = per.groupBy("scan_id").agg(F.max("spread").alias("spread"), F.coalesce(F.median("step"), F.lit(0.0)).alias("step"))
    return out.select("*", ((F.col("step") == 0) | (F.col("spread") <= tolerance * F.col("step"))).alias("separable"))


def stack_scans(voxels: DataFrame, stack_value: DataFrame, stack_axis: str, name: str = "stacked") -> DataFrame:
    """Sub-scans as one: their stack motor's order becomes the last motor index. stack_value(scan_id, value)."""
    order = stack_value.select("scan_id", (F.row_number().over(Window.orderBy("value", "scan_id")) - 1).cast("int").alias(stack_axis))
    return voxels.join(order, "scan_id").withColumn("scan_id", F.lit(name))


def partial_frames(frames: DataFrame, command: str, n_fast: int | None = None, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """An aborted scan's usable frames, and (scan_id, frames_used, frames_expected, complete).

    fscan2d keeps complete rows of n_fast and fails without one; other commands keep all frames.
    """
    counts = frames.groupBy("scan_id").agg(F.count("*").alias("n"))
    used = F.floor(F.col("n") / n_fast) * n_fast if command == "fscan2d" else F.col("n")
    info = counts.select("scan_id", used.cast("long").alias("frames_used"), F.lit(expected).cast("long").alias("frames_expected"))
    info = info.withColumn("complete", F.col("frames_used") == F.col("frames_expected"))
    if command == "fscan2d":
        info = info.withColumn("frames_used", F.when(F.col("frames_used") > 0, F.col("frames_used")).otherwise(F.raise_error(F.lit("no complete row")).cast("long")))
    kept = frames.join(info.select("scan_id", "frames_used"), "scan_id").where("frame < frames_used").drop("frames_used")
    return kept, info


def local_maxima(profile: DataFrame, value: str, index: str = "i0", sigma: float = 1.5, half: int = 4, apart: int = 3, top: int = 2) -> DataFrame:
    """(scan_id, y, x, k, index, height): up to two maxima of a smoothed profile that lie apart.

    Smoothing is a Gaussian over 2 * half + 1 samples, with zeros beyond the ends; a maximum is
    higher than the sample before it and not lower than the one after, so that no end is one. The
    second is the highest that is more than `apart` samples from the first. Heights count to nine
    decimals.
    """
    at = Window.partitionBy("scan_id", "y", "x").orderBy(index)
    weights = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-half, half + 1)}
    total = F.lit(0.0)
    for d, w in weights.items():
        total = total + F.coalesce(F.lag(value, -d).over(at).cast("double") * w, F.lit(0.0))
    s = profile.withColumn("_s", F.round(total / sum(weights.values()), 9))
    s = s.withColumns({"_p": F.lag("_s").over(at), "_n": F.lead("_s").over(at)}).where("_s > _p and _s >= _n")
    best = Window.partitionBy("scan_id", "y", "x").orderBy(F.desc("_s"), index)
    s = s.withColumn("_first", F.first(index).over(best))
    s = s.where((F.col(index) == F.col("_first")) | (F.abs(F.col(index) - F.col("_first")) > apart))
    s = s.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top)
    return s.select("scan_id", "y", "x", "k", F.col(index).alias("at"), F.col("_s").alias("height"))
