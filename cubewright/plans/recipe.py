"""Batch recipes: which scans, which preprocessing, which fits; run, resumed and aggregated."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cubewright.core.cube import Cube
from cubewright.operators import fits, moments as M, preprocess as P
from cubewright.sources import store

FITS = ("moments", "gauss1d", "gauss2p", "gauss2d", "gaussND", "pv")
#: What fits ask for: the number of motors, 0 for any.
RANKS = {"gauss1d": 1, "gauss2p": 1, "pv": 1, "gauss2d": 2}


@dataclass(frozen=True)
class ScanEntry:
    file: str
    scan_id: str
    alias: str


@dataclass(frozen=True)
class Recipe:
    output_dir: str
    scans: tuple[ScanEntry, ...]
    fits: tuple[str, ...] = ("moments",)
    preprocess: dict = field(default_factory=dict)
    fit_options: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Recipe:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f))

    @classmethod
    def from_dict(cls, d: dict) -> Recipe:
        """All faults at once, as one ValueError."""
        d, wrong = d or {}, []
        if not d.get("output_dir"):
            wrong.append("output_dir is missing")
        entries = []
        if not d.get("scans"):
            wrong.append("there are no scans")
        for k, s in enumerate(d.get("scans") or []):
            gone = [n for n in ("file", "scan_id") if not s.get(n)]
            wrong += [f"scan {k} has no {n}" for n in gone]
            if not gone:
                entries.append(ScanEntry(s["file"], str(s["scan_id"]), s.get("alias") or f"scan_{k:03d}"))
        names = [e.alias for e in entries]
        wrong += [f"alias {n} is used twice" for n in sorted({n for n in names if names.count(n) > 1})]
        chosen = tuple(d.get("fits") or ("moments",))
        wrong += [f"unknown fit {f}" for f in chosen if f not in FITS]
        if wrong:
            raise ValueError("; ".join(wrong))
        return cls(d["output_dir"], tuple(entries), chosen, d.get("preprocess") or {}, d.get("fit_options") or {})

    def recipe_hash(self) -> str:
        """Of what changes results: preprocessing, fits in any order, and their options."""
        said = json.dumps({"preprocess": self.preprocess, "fits": sorted(self.fits), "fit_options": self.fit_options}, sort_keys=True)
        return hashlib.sha256(said.encode()).hexdigest()[:16]

    def output_path(self, entry: ScanEntry) -> str:
        return f"{self.output_dir.rstrip('/')}/{entry.alias}"


def _coordinates(cube: Cube) -> np.ndarray:
    """The axes' values over the grid: one row a motor point, so bounded by the scan's grid."""
    rows = cube.voxels.select(cube.frame().alias("f"), *[c.alias(f"c{i}") for i, c in enumerate(cube.axes)]).groupBy("f")
    rows = rows.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(cube.axes))]).orderBy("f").collect()
    return np.array([[r[f"c{i}"] for r in rows] for i in range(len(cube.axes))])


def analyze(cube: Cube, method: str = "auto", mask: DataFrame | str | None = "auto", order: int = 2, two_peak: bool = False, **options) -> DataFrame:
    """Moments or a fit of every pixel of mask (auto: the grain mask; None: all).

    auto fits one Gaussian to scans of one motor and an N-D Gaussian to others; two_peak asks for
    two. A method for another number of motors is a ValueError.
    """
    dims = len(cube.grid)
    if method == "auto":
        method = ("gauss2p" if two_peak else "gauss1d") if dims == 1 else ("gaussND2" if two_peak else "gaussND")
    if method not in (*FITS, "gaussND2"):
        raise ValueError(f"unknown method: {method}")
    if method == "gaussND2" and dims < 2 or RANKS.get(method, dims) != dims:
        raise ValueError(f"{method} doesn't suit a scan of {dims} motors")
    mask = P.grain_mask(cube) if isinstance(mask, str) else mask
    if method == "moments":
        return M.moments(cube, order, mask)
    curves = (cube if mask is None else cube.masked(mask)).curves()
    coords = _coordinates(cube)
    if method == "gaussND2":
        return fits.fit_two_gaussians_nd(curves, coords, cube.grid, **options)
    run = {"gauss1d": fits.fit_gaussian_1d, "gauss2p": fits.fit_two_gaussians_1d, "pv": fits.fit_pseudo_voigt_1d}.get(method, fits.fit_gaussian_nd)
    return run(curves, coords[0] if method in ("gauss1d", "gauss2p", "pv") else coords, **options)


def process(cube: Cube, recipe: Recipe) -> tuple[dict[str, DataFrame], list[str]]:
    """(results by fit, notes): background, hot pixels, region, then the fits that suit the scan."""
    pre, notes, out = recipe.preprocess, [], {}
    if "background" in pre:
        cube = P.subtract(cube, P.estimate_background(cube, **(pre["background"] or {})))
    if "hot_pixels" in pre:
        cube = P.remove_hot_pixels(cube, **({"one_sided": True, "min_sigma": 1.0} | (pre["hot_pixels"] or {})))
    roi = pre.get("roi")
    if roi == "auto" or isinstance(roi, dict):
        r = P.auto_roi(cube, **(roi if isinstance(roi, dict) else {})).first()
        roi = (r["r1"], r["r2"], r["c1"], r["c2"])
    if roi:
        cube = cube.roi(*roi)
    mask = P.grain_mask(cube)
    for name in recipe.fits:
        if RANKS.get(name, len(cube.grid)) != len(cube.grid):
            notes.append(f"{name} skipped: the scan has {len(cube.grid)} motors")
            continue
        out[name] = analyze(cube, name, mask, **recipe.fit_options.get(name, {}))
    return out, notes


def run(spark: SparkSession, recipe: Recipe, load: Callable[[ScanEntry], Cube], force: bool = False, log: Callable[[str], None] = print) -> dict:
    """Processes each scan that isn't done with this recipe; a scan that fails doesn't stop the others."""
    done, failed, skipped = [], [], []
    digest = recipe.recipe_hash()
    for entry in recipe.scans:
        path = recipe.output_path(entry)
        have = store.read_attrs(spark, path)
        if not force and have and have["attrs"].get("recipe_hash") == digest:
            skipped.append(entry.alias)
            continue
        try:
            results, notes = process(load(entry), recipe)
            store.save_maps(path, results, {"file": entry.file, "scan_id": entry.scan_id}, {"recipe_hash": digest, "notes": notes, "alias": entry.alias})
            done.append(entry.alias)
        except Exception as e:
            log(f"{entry.alias}: {e}")
            failed.append(entry.alias)
    return {"done": done, "skipped": skipped, "failed": failed, "time_series": aggregate(spark, recipe)}


def aggregate(spark: SparkSession, recipe: Recipe) -> DataFrame | None:
    """One row for each finished scan, in the recipe's order; nulls for fits that it doesn't have."""
    rows = None
    for k, entry in enumerate(recipe.scans):
        if store.read_attrs(spark, recipe.output_path(entry)) is None:
            continue
        got, _ = store.load_maps(spark, recipe.output_path(entry))
        row = spark.range(1).select(F.lit(k).alias("position"), F.lit(entry.alias).alias("alias"))
        ok = F.col("success") > 0.5
        wanted = {
            "gauss1d": [("gauss1d_mu", F.median(F.when(ok, F.col("mu")))), ("gauss1d_fwhm", F.median(F.when(ok, F.col("sigma"))) * 2.3548), ("gauss1d_success", F.avg("success"))],
            "gauss2p": [("two_peak_fraction", F.avg((F.col("n_peaks") == 2).cast("double")))],
            "gauss2d": [("gauss2d_mu0", F.median(F.when(ok, F.get("mu", F.lit(0))))), ("gauss2d_mu1", F.median(F.when(ok, F.get("mu", F.lit(1))))), ("gauss2d_success", F.avg("success"))],
            "moments": [("com_mean", F.avg(F.when(~F.isnan(F.get("mu", F.lit(0))), F.get("mu", F.lit(0)))))],
        }
        for name, aggs in wanted.items():
            one = got[name].agg(*[c.alias(n) for n, c in aggs]) if name in got else spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n, _ in aggs])
            row = row.join(one)  # one row each
        rows = row if rows is None else rows.union(row)
    return None if rows is None else rows.orderBy("position")


def load_frames(spark: SparkSession) -> Callable[[ScanEntry], Cube]:
    """Loads entries from frames tables: file is a parquet path with title, ny, nx, px and motor columns."""
    from cubewright.sources.scans import load_scan

    def load(entry: ScanEntry) -> Cube:
        frames = spark.read.parquet(entry.file).where(F.col("scan_id") == entry.scan_id)
        one = frames.select("title", "ny", "nx").first()
        if one is None:
            raise ValueError(f"{entry.file} has no scan {entry.scan_id}")
        return load_scan(frames, one["title"], (one["ny"], one["nx"]))

    return load


def main(argv: list[str] | None = None) -> int:
    """run [--force] | validate | aggregate RECIPE. 0: done; 1: failed scans or no outputs; 2: a bad recipe."""
    parser = argparse.ArgumentParser(prog="cubewright")
    parser.add_argument("action", choices=("run", "validate", "aggregate"))
    parser.add_argument("recipe")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    try:
        recipe = Recipe.load(args.recipe)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("cubewright").getOrCreate()
    if args.action == "validate":
        missing = []
        for e in recipe.scans:
            p, fs = store._fs(spark, e.file)
            if not fs.exists(p):
                missing.append(e.file)
        print("\n".join(f"missing: {m}" for m in missing) or "the recipe is fine")
        return int(bool(missing))
    if args.action == "run":
        got = run(spark, recipe, load_frames(spark), args.force)
        print(json.dumps({k: v for k, v in got.items() if k != "time_series"}))
        if got["failed"]:
            return 1
    series = aggregate(spark, recipe)
    if series is None:
        return 1
    series.write.mode("overwrite").parquet(f"{recipe.output_dir.rstrip('/')}/time_series")
    return 0


if __name__ == "__main__":
    sys.exit(main())

