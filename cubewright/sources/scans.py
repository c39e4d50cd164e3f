"""Scan files as a Spark data source, and scans as cubes.

`spark.read.format("scan_frames")` reads directories of scans in the BLISS layout from HDF5 where
h5py is there. Elsewhere scans come as a frames table
(scan_id, frame, px array, and a position column for each motor), from parquet.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cubewright.core.cube import Cube
from cubewright.operators import grid as G
from cubewright.sources.metadata import ScanCommand, parse_command

try:
    import h5py
except ImportError:
    h5py = None

#: Frames that one task reads at a time.
FRAMES_PER_PARTITION = 64


class FrameRange(InputPartition):
    def __init__(self, scan_id: str, start: int, stop: int):
        self.scan_id, self.start, self.stop = scan_id, start, stop


class ScanFrames(DataSource):
    """Options: path, scan_ids (comma-separated; default all), detector (default pco_ff)."""

    @classmethod
    def name(cls) -> str:
        return "scan_frames"

    def schema(self) -> str:
        return "scan_id string, frame int, ny int, nx int, px array<int>, title string, motors map<string,double>"

    def reader(self, schema) -> DataSourceReader:
        if h5py is None:
            raise ImportError("reading HDF5 scans needs h5py; frames tables can be read from parquet")
        return _FrameReader(self.options)


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.detector = options["path"], options.get("detector", "pco_ff")
        self.scan_ids = [s for s in options.get("scan_ids", "").split(",") if s]

    def partitions(self) -> list[FrameRange]:
        with h5py.File(self.path) as f:
            ids = self.scan_ids or [k for k in f if f"{k}/instrument/{self.detector}/image" in f]
            sizes = {k: f[f"{k}/instrument/{self.detector}/image"].shape[0] for k in ids}
        return [FrameRange(k, lo, min(n, lo + FRAMES_PER_PARTITION)) for k, n in sizes.items() for lo in range(0, n, FRAMES_PER_PARTITION)]

    def read(self, part: FrameRange):
        with h5py.File(self.path) as f:
            scan = f[part.scan_id]
            images = scan[f"instrument/{self.detector}/image"]
            total = images.shape[0]
            title = scan["title"][()]
            title = title.decode() if isinstance(title, bytes) else str(title)
            motors = {}
            for name, node in scan["instrument"].items():
                for leaf in ("value", "data"):
                    if leaf in node and getattr(node[leaf], "size", 0) in (1, total):
                        motors[name] = node[leaf][()].reshape(-1)
            for k in range(part.start, part.stop):
                img = images[k]
                yield part.scan_id, k, int(img.shape[0]), int(img.shape[1]), img.reshape(-1).astype(int).tolist(), title, {m: float(v[k if len(v) > 1 else 0]) for m, v in motors.items()}


def load_scan(frames: DataFrame, command: ScanCommand | str, shape: tuple[int, int], roi: tuple[int, int, int, int] | None = None, allow_partial: bool = False, zigzag: bool | None = None) -> Cube:
    """A frames table as a cube: motorless scans in order of acquisition, one motor by its value,
    two by rows (fscan2d) or by value. roi cuts before anything is sorted or shuffled.

    frames needs a position column named after each motor. A scan with too few frames is an
    error unless allow_partial, which keeps what partial_frames says.
    """
    command = parse_command(command) if isinstance(command, str) else command
    names = command.motor_names or ()
    grid = command.shape
    if allow_partial:
        frames, _ = G.partial_frames(frames, command.command, grid[-1] if len(grid) > 1 else None, command.points)
        used = frames.select("frame").distinct().count()
        grid = (used // grid[-1], grid[-1]) if len(grid) > 1 else (used,)
    order = frames.drop("px")
    if not names:
        order = order.withColumn("i0", F.col("frame"))
    elif len(grid) == 1:
        order = G.rocking_order(order, names[0])
    elif command.command == "fscan2d":
        order = G.snake_order(order, grid[-1], fast=names[1], slow=names[0])
    else:
        order = G.value_order(order, grid[-1], names[0], names[1])
    index = [f"i{k}" for k in range(len(grid))]
    long = frames.select("scan_id", "frame", F.posexplode("px").alias("p", "v"))
    nx = shape[1]
    long = long.select("scan_id", "frame", F.floor(F.col("p") / nx).cast("int").alias("y"), (F.col("p") % nx).cast("int").alias("x"), F.col("v").cast("long").alias("v"))
    axes = tuple(F.col(f"c{k}") for k in range(len(names))) or (F.col("i0").cast("double"),)
    cube = Cube(long, shape, grid, axes, tuple(names))
    if roi is not None:
        cube = cube.roi(*roi)
    placed = cube.voxels.join(order.select("scan_id", "frame", *index, *[F.col(m).cast("double").alias(f"c{k}") for k, m in enumerate(names)]), ["scan_id", "frame"])
    return replace(cube, voxels=placed.drop("frame"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScanFrames)
