"""Detector cubes as tables.

Three layouts of one cube, each keyed by scan_id:
  voxels(scan_id, y, x, i0[, i1[, i2]], v)   one row a voxel
  curves(scan_id, y, x, v array)             one row a pixel, row-major over the motor grid
  frames(scan_id, frame, px array)           one row a motor point, row-major over the detector
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEY = ("scan_id", "y", "x")
PIXEL = ("y", "x")


@dataclass(frozen=True)
class Cube:
    """A cube's voxels with what is known of its grid. Operators return new cubes; nothing is changed in place.

    shape: detector rows and columns; grid: points along each motor axis; axes: a Column for each
    motor that gives its coordinate from i0, i1, i2.
    """

    voxels: DataFrame
    shape: tuple[int, int]
    grid: tuple[int, ...]
    axes: tuple[Column, ...]
    motor_names: tuple[str, ...] = ()
    invariant: dict = field(default_factory=dict)

    @property
    def index(self) -> tuple[str, ...]:
        return tuple(f"i{k}" for k in range(len(self.grid)))

    @property
    def points(self) -> int:
        n = 1
        for m in self.grid:
            n *= m
        return n

    def frame(self) -> Column:
        """The row-major number of a voxel's motor point."""
        out = F.col("i0")
        for k, m in enumerate(self.grid[1:], 1):
            out = out * m + F.col(f"i{k}")
        return out

    def with_voxels(self, voxels: DataFrame, **more) -> Cube:
        return replace(self, voxels=voxels, **more)

    def pixels(self) -> DataFrame:
        return self.voxels.select(*KEY).distinct()

    def dense(self) -> Cube:
        """With a row of 0 for every voxel of each scan's pixels and grid that has none."""
        scans = self.voxels.select("scan_id").distinct()
        ny, nx = self.shape
        full = scans.select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y"))
        full = full.select("scan_id", "y", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))
        for k, m in enumerate(self.grid):
            full = full.select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(f"i{k}"))
        on = [*KEY, *self.index]
        return self.with_voxels(full.join(self.voxels, on, "left").select(*on, F.coalesce("v", F.lit(0)).cast("long").alias("v")))

    def curves(self, fill: int = 0) -> DataFrame:
        """Packs each pixel's voxels, in order; missing points become fill."""
        packed = self.voxels.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(self.frame().alias("k"), F.col("v").alias("v")))).alias("p"), F.count("*").alias("n"))
        whole = F.transform("p", lambda e: e["v"])
        sparse = F.transform(
            F.sequence(F.lit(0), F.lit(self.points - 1)), lambda k: F.coalesce(F.element_at(F.map_from_entries(F.transform("p", lambda e: F.struct(e["k"], e["v"]))), k), F.lit(fill).cast("long"))
        )
        return packed.select(*KEY, F.when(F.col("n") == self.points, whole).otherwise(sparse).alias("v"))

    def frames(self) -> DataFrame:
        """Packs each motor point's pixels, in order, of a dense cube."""
        at = (F.col("y") * self.shape[1] + F.col("x")).alias("k")
        packed = self.voxels.groupBy("scan_id", self.frame().alias("frame")).agg(F.sort_array(F.collect_list(F.struct(at, F.col("v").alias("v")))).alias("p"))
        return packed.select("scan_id", "frame", F.transform("p", lambda e: e["v"]).alias("px"))

    def from_curves(self, curves: DataFrame) -> Cube:
        long = curves.select(*KEY, F.posexplode("v").alias("k", "v"))
        return self.with_voxels(self._unframe(long))

    def from_frames(self, frames: DataFrame) -> Cube:
        long = frames.select("scan_id", F.col("frame").alias("k"), F.posexplode("px").alias("p", "v"))
        nx = self.shape[1]
        long = long.select("scan_id", F.floor(F.col("p") / nx).cast("int").alias("y"), (F.col("p") % nx).cast("int").alias("x"), "k", "v")
        return self.with_voxels(self._unframe(long))

    def _unframe(self, long: DataFrame) -> DataFrame:
        index, size = [], self.points
        for k, m in enumerate(self.grid):
            size //= m
            index.append((F.floor(F.col("k") / size).cast("int") % m).alias(f"i{k}"))
        return long.select(*KEY, *index, F.col("v").cast("long").alias("v"))

    def roi(self, r1: int, r2: int, c1: int, c2: int) -> Cube:
        """Rows [r1, r2) and columns [c1, c2), counted anew from 0; the filter reaches the scan."""
        y, x = F.col("y"), F.col("x")
        cut = self.voxels.where((y >= r1) & (y < r2) & (x >= c1) & (x < c2)).withColumns({"y": (y - r1).cast("int"), "x": (x - c1).cast("int")})
        return self.with_voxels(cut, shape=(r2 - r1, c2 - c1))

    def masked(self, mask: DataFrame) -> Cube:
        """Voxels of mask's pixels only (keys scan_id, y, x)."""
        return self.with_voxels(self.voxels.join(mask.select(*KEY), list(KEY), "left_semi"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_li(spark: SparkSession, sf_dir: str) -> Cube:
    """lineitem as a two-motor scan on an 8 by 8 detector: discount by tax, quantities as counts."""
    t = _table(spark, sf_dir, "lineitem")
    v = (
        t.select(
            F.lit("li").alias("scan_id"),
            (F.col("l_suppkey") % 8).cast("int").alias("y"),
            (F.col("l_partkey") % 8).cast("int").alias("x"),
            F.round(F.col("l_discount") * 100).cast("int").alias("i0"),
            F.round(F.col("l_tax") * 100).cast("int").alias("i1"),
            "l_quantity",
        )
        .groupBy("scan_id", "y", "x", "i0", "i1")
        .agg(F.sum("l_quantity").cast("long").alias("v"))
    )
    return Cube(v, (8, 8), (11, 9), (F.col("i0") * 0.01, F.col("i1") * 0.01), ("chi", "mu")).dense()


def cube_ev(spark: SparkSession, sf_dir: str, by_day: bool = False) -> Cube:
    """events as a rocking scan on an 8 by 8 detector, by hour; by_day gives a scan for each day."""
    t = _table(spark, sf_dir, "events")
    scan = F.date_format("ts", "yyyy-MM-dd") if by_day else F.lit("ev")
    v = (
        t.select(
            scan.alias("scan_id"),
            (F.col("user_id") % 8).cast("int").alias("y"),
            (F.floor(F.col("user_id") / 8.0) % 8).cast("int").alias("x"),
            F.hour("ts").alias("i0"),
            F.round("value").alias("w"),
        )
        .groupBy("scan_id", "y", "x", "i0")
        .agg(F.sum("w").cast("long").alias("v"))
    )
    return Cube(v, (8, 8), (24,), (F.col("i0").cast("double"),), ("diffry",)).dense()
