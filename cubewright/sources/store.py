"""Maps, bundles and map collections as directories of parquet tables with JSON attributes.

A directory holds one parquet table for each entry and `_attrs.json`, which is written last: a
directory without it is unfinished. Paths may be of any file system that Spark reaches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from cubewright.core.cube import KEY, Cube

ATTRS = "_attrs.json"
#: No result is written below a folder of this name.
GUARDED = "RAW_DATA"
KINDS = {
    "gauss1d": ("A", "sigma", "mu", "k", "m", "success"),
    "gaussND": ("A", "mu", "cov", "c", "success"),
    "gaussND_two": ("A1", "mu1", "cov1", "A2", "mu2", "cov2", "c", "n_peaks", "bic1", "bic2", "success"),
    "pseudovoigt": ("A", "sigma", "mu", "gamma", "eta", "k", "m", "success"),
    "moments": ("mu", "cov"),
    "gauss2p": ("params1", "params2", "n_peaks", "bic1", "bic2"),
}


def result_kind(df: DataFrame) -> str:
    """The kind of result whose columns df has; array for others."""
    cols = set(df.columns)
    found = [k for k, need in KINDS.items() if cols >= set(need)]
    return max(found, key=lambda k: len(KINDS[k])) if found else "array"


def _guard(path: str) -> None:
    if GUARDED in path.replace("\\", "/").split("/"):
        raise ValueError(f"{path} lies in {GUARDED}, where nothing is written")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_attrs(spark: SparkSession, path: str, attrs: dict) -> None:
    p, fs = _fs(spark, f"{path}/{ATTRS}")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(attrs, default=str, indent=1).encode()))
    out.close()


def read_attrs(spark: SparkSession, path: str) -> dict | None:
    """The attributes, or None for what is missing or unfinished."""
    p, fs = _fs(spark, f"{path}/{ATTRS}")
    if not fs.exists(p):
        return None
    reader = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    stream = fs.open(p)
    text = reader.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def save_maps(path: str, maps: dict, scan: dict | None = None, attrs: dict | None = None) -> None:
    """Writes nested dicts of maps (DataFrames), over what is there; the attributes come last."""
    _guard(path)
    flat: dict[str, DataFrame] = {}

    def walk(node: dict, prefix: str) -> None:
        for k, v in node.items():
            if isinstance(v, dict):
                walk(v, f"{prefix}{k}/")
            else:
                flat[prefix + k] = v

    walk(maps, "")
    if not flat:
        raise ValueError("there are no maps to save")
    spark = next(iter(flat.values())).sparkSession
    p, fs = _fs(spark, f"{path}/{ATTRS}")
    fs.delete(p, False)
    for name, df in flat.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    own = {"entries": {n: result_kind(d) for n, d in flat.items()}, "written": datetime.now(UTC).isoformat(), "scan": scan or {}}
    write_attrs(spark, path, own | {"attrs": attrs or {}})


def load_maps(spark: SparkSession, path: str) -> tuple[dict, dict]:
    """(nested dict of DataFrames, attributes)."""
    attrs = read_attrs(spark, path)
    if attrs is None:
        raise FileNotFoundError(f"{path} has no finished maps")
    out: dict = {}
    for name in attrs["entries"]:
        node = out
        *parents, leaf = name.split("/")
        for k in parents:
            node = node.setdefault(k, {})
        node[leaf] = spark.read.parquet(f"{path}/{name}")
    return out, attrs


@dataclass(frozen=True)
class Bundle:
    """What load_bundle gives. curves holds all pixels, or masked_only those of a mask."""

    curves: DataFrame
    shape: tuple[int, int]
    grid: tuple[int, ...]
    motor_names: tuple[str, ...]
    zsum: DataFrame
    masks: dict[str, DataFrame] = field(default_factory=dict)
    results: dict[str, DataFrame] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)
    masked_only: bool = False

    def dense(self, fill: int = 0) -> DataFrame:
        """Curves for every pixel of the detector; those that weren't saved hold fill."""
        points = 1
        for m in self.grid:
            points *= m
        ny, nx = self.shape
        full = self.curves.select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("y"))
        full = full.select("scan_id", "y", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("x"))
        missing = F.array_repeat(F.lit(fill).cast("long"), points)
        return full.join(self.curves, list(KEY), "left").select(*KEY, F.coalesce("v", missing).alias("v"))


def save_bundle(path: str, cube: Cube, results: dict[str, DataFrame] | None = None, masks: dict[str, DataFrame] | None = None, attrs: dict | None = None, masked_only: bool = False, mask: DataFrame | None = None) -> None:
    """A cube with its results and masks. masked_only keeps the curves of mask, or of masks["sig_mask"]."""
    _guard(path)
    masks = masks or {}
    mask = masks.get("sig_mask") if mask is None else mask
    if masked_only and mask is None:
        raise ValueError("masked_only needs a mask, or masks with a sig_mask")
    curves = cube.curves()
    entries = {
        "curves": curves.join(mask.select(*KEY), list(KEY), "left_semi") if masked_only else curves,
        "zsum": cube.voxels.groupBy(*KEY).agg(F.sum("v").cast("double").alias("zsum")),
    }
    entries |= {f"masks/{k}": v for k, v in masks.items()} | {f"results/{k}": v for k, v in (results or {}).items()}
    own = {"shape": list(cube.shape), "grid": list(cube.grid), "motor_names": list(cube.motor_names), "masked_only": masked_only, "invariant": cube.invariant}
    save_maps(path, entries, own, attrs)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    maps, attrs = load_maps(spark, path)
    s = attrs["scan"]
    return Bundle(maps["curves"], tuple(s["shape"]), tuple(s["grid"]), tuple(s["motor_names"]), maps["zsum"], maps.get("masks", {}), maps.get("results", {}), attrs["attrs"], s["masked_only"])


def long_maps(result: DataFrame, entry: str = "entry", mask: DataFrame | None = None) -> DataFrame:
    """(entry, name, layer, scan_id, y, x, value): a result's columns as one long table for display.

    Arrays give a layer for each element. Outside of mask, and where success is at most 0.5,
    values are NaN; fit_status and the keys are never masked.
    """
    keep = F.lit(True)
    rows = result
    if mask is not None:
        rows = rows.join(mask.select(*KEY, F.lit(True).alias("_in")), list(KEY), "left")
        keep = keep & F.coalesce("_in", F.lit(False))
    if "success" in result.columns:
        keep = keep & (F.col("success") > 0.5)
    cells = []
    for name, kind in result.dtypes:
        if name in KEY:
            continue
        always = name == "fit_status"
        value = F.flatten(name) if kind.startswith("array<array") else F.col(name) if kind.startswith("array") else F.array(F.col(name))
        shown = value.cast("array<double>") if always else F.transform(value.cast("array<double>"), lambda v: F.when(keep, v).otherwise(F.lit(float("nan"))))
        cells.append(F.struct(F.lit(name).alias("name"), shown.alias("values")))
    rows = rows.select(*KEY, F.explode(F.array(*cells)).alias("c")).select(*KEY, "c.name", F.posexplode("c.values").alias("layer", "value"))
    return rows.select(F.lit(entry).alias("entry"), "name", "layer", *KEY, "value")
