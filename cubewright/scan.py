"""A scan with its preprocessing, analysis and maps: each step gives a new Scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from cubewright.core.cube import KEY, Cube
from cubewright.operators import fits, maps, moments as M, preprocess as P
from cubewright.plans.recipe import _coordinates, analyze
from cubewright.sources import store
from cubewright.sources.metadata import ScanCommand
from cubewright.sources.scans import load_scan


@dataclass(frozen=True)
class Scan:
    cube: Cube
    command: ScanCommand | None = None
    offset: tuple[int, int] = (0, 0)

    @classmethod
    def load(cls, frames: DataFrame, command: ScanCommand | str, shape: tuple[int, int], roi: tuple[int, int, int, int] | None = None, allow_partial: bool = False) -> Scan:
        cube = load_scan(frames, command, shape, roi, allow_partial)
        return cls(cube, command if isinstance(command, ScanCommand) else None, (roi[0], roi[2]) if roi else (0, 0))

    def _with(self, cube: Cube) -> Scan:
        return replace(self, cube=cube)

    # Preprocessing
    def estimate_background(self, mode: str = "mean", **options) -> DataFrame:
        return P.estimate_background(self.cube, mode, **options)

    def subtract(self, background: DataFrame | float) -> Scan:
        return self._with(P.subtract(self.cube, background))

    def threshold_removal(self, bottom: float | None = None, top: float | None = None) -> Scan:
        return self._with(P.threshold(self.cube, bottom, top))

    def remove_hot_pixels(self, **options) -> Scan:
        return self._with(P.remove_hot_pixels(self.cube, **options))

    def auto_roi(self, threshold_rel: float = 0.05, pad: int = 20) -> Scan:
        """Cut to the lit region; regions add up over several cuts."""
        r = P.auto_roi(self.cube, threshold_rel, pad).first()
        cut = self.cube.roi(r["r1"], r["r2"], r["c1"], r["c2"])
        return replace(self, cube=cut, offset=(self.offset[0] + r["r1"], self.offset[1] + r["c1"]))

    def final_roi(self) -> tuple[int, int, int, int]:
        """(r1, r2, c1, c2) on the whole detector."""
        (y, x), (ny, nx) = self.offset, self.cube.shape
        return y, y + ny, x, x + nx

    # Analysis
    def grain_mask(self, **options) -> DataFrame:
        return P.grain_mask(self.cube, **options)

    def analyze(self, method: str = "auto", mask: DataFrame | str | None = "auto", **options) -> DataFrame:
        return analyze(self.cube, method, mask, **options)

    def fit_status(self, result: DataFrame, mask: DataFrame | str | None = "auto", edge_tol_steps: float = 1.0, edge_bins: int = 3) -> DataFrame:
        """The result with a fit_status column."""
        mask = self.grain_mask() if isinstance(mask, str) else mask
        c = _coordinates(self.cube)
        ranges = [(float(x.min()), float(x.max())) for x in c]
        steps = []
        for x in c:
            values = sorted(set(x.tolist()))
            gaps = sorted(b - a for a, b in zip(values, values[1:], strict=False))
            steps.append(gaps[len(gaps) // 2] if gaps else 0.0)
        one = len(ranges) == 1
        mu = [F.col("mu")] if one else [F.get("mu", F.lit(i)) for i in range(len(ranges))]
        rows = result.join(M.edge_peak_mask(self.cube, edge_bins), list(KEY), "left")
        inside = None
        if mask is not None:
            rows = rows.join(mask.select(*KEY, F.lit(True).alias("_in")), list(KEY), "left")
            inside = F.coalesce("_in", F.lit(False))
        status = M.fit_status(mu, F.col("success"), ranges, steps, inside, edge_tol_steps, F.coalesce("edge", F.lit(False)), F.col("A"))
        return rows.withColumn("fit_status", status).drop("edge", "_in")

    def refit_edge_clipped(self, result: DataFrame, cov=None, **options) -> DataFrame:
        """result must carry fit_status; cov defaults to the healthy fits' median."""
        cov = fits.median_healthy_cov(result, "fit_status", len(self.cube.grid)) if cov is None else cov
        return fits.refit_edges(self.cube.curves(), _coordinates(self.cube), self.cube.grid, result, "fit_status", cov, **options)

    # Maps
    def orientation(self, result: DataFrame, **options) -> DataFrame:
        return maps.orientation(result, **options)

    def orientation_stamp(self, result: DataFrame, ranges: list[tuple[float, float]], **options) -> DataFrame:
        return maps.orientation_stamp(result, ranges, **options)

    def mosaicity(self, result: DataFrame, mode: str = "scalar", axes: tuple[int, ...] | None = None) -> DataFrame:
        return maps.mosaicity(result, mode, axes)

    def strain(self, result: DataFrame, motor: str = "ccmth", reference: float | None = None, mask: DataFrame | None = None) -> DataFrame:
        """The axis is the first whose motor's name contains `motor`, else axis 0."""
        axis = next((i for i, n in enumerate(self.cube.motor_names) if motor in n), 0)
        return maps.strain(result, F.get("mu", F.lit(axis)), motor, reference, mask)

    def kam(self, result: DataFrame, axes: tuple[int, ...] | None = None, mask: DataFrame | None = None, **options) -> DataFrame:
        """Pixels outside of mask are missing, not zeros."""
        comps: list[Column] = [F.get("mu", F.lit(a)) for a in (axes or range(len(self.cube.grid)))]
        rows = result if mask is None else result.join(mask.select(*KEY), list(KEY), "left_semi")
        return maps.kam(rows, comps, **options)

    def pixel_size_um(self) -> float:
        return maps.pixel_size_um(self.cube.invariant)

    # Sinks
    def save_maps(self, path: str, results: dict, **attrs) -> None:
        store.save_maps(path, results, {"title": self.command.title if self.command else None, "roi": list(self.final_roi())}, attrs)

    def save_bundle(self, path: str, **options) -> None:
        store.save_bundle(path, self.cube, **options)
