"""Per-pixel fits over packed curves, as numpy on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cubewright.functions import solver as S

#: Pixels fitted at a time, which bounds the Jacobian's memory.
PIXELS = 512
LOST = 1e30  # the criterion of a fit that failed


def _run(curves: DataFrame, fields: list[tuple[str, str]], fit: Callable[[np.ndarray], dict[str, np.ndarray]], carry: tuple[str, ...] = ()) -> DataFrame:
    """Applies fit to (pixels, points) blocks. fields: name and double, matrix or vector, or tinyint."""
    kinds = {"d": T.DoubleType(), "v": T.ArrayType(T.DoubleType()), "m": T.ArrayType(T.ArrayType(T.DoubleType())), "t": T.ByteType()}
    arrow = {"d": pa.float64(), "v": pa.list_(pa.float64()), "m": pa.list_(pa.list_(pa.float64())), "t": pa.int8()}
    keys = ["scan_id", "y", "x", *carry]
    schema = T.StructType([curves.schema[k] for k in keys] + [T.StructField(n, kinds[k]) for n, k in fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, PIXELS):
                part = b.slice(lo, PIXELS)
                y = part.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                extra = {c: part.column(3 + i).to_pylist() for i, c in enumerate(carry)}
                got = fit(y, extra) if carry else fit(y)
                cols = [part.column(i) for i in range(len(keys))]
                cols += [pa.array(got[n].tolist() if k in "vm" else np.asarray(got[n], float if k == "d" else np.int8), arrow[k]) for n, k in fields]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return curves.select(*keys, "v").mapInArrow(run, schema)


class _Scale:
    """Coordinates to [-1, 1] an axis and curves to at most 1, and back."""

    def __init__(self, coords: np.ndarray):  # (D, points)
        self.x = np.asarray(coords, float)
        self.mid = self.x.mean(axis=1)
        self.half = np.maximum(np.ptp(self.x, axis=1) / 2, 1e-12)
        self.unit = ((self.x - self.mid[:, None]) / self.half[:, None]).T

    @staticmethod
    def curves(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = np.maximum(y.max(axis=1), 1.0)
        return y / top[:, None], top

    def line(self, k: np.ndarray, b: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return k * top / self.half[0], (b - k * self.mid[0] / self.half[0]) * top


def _bic(rss: np.ndarray, n: int, p: int, ok: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = n * np.log(np.maximum(rss, 1e-30) / n) + p * math.log(n)
    return np.where(np.isfinite(out) & ok, out, LOST)


def _rss(y: np.ndarray, p: np.ndarray, model: S.Model, x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return ((y - model(p, x)[0]) ** 2).sum(axis=1)


def fit_gaussian_1d(curves: DataFrame, coords: np.ndarray, n_iter: int = 7) -> DataFrame:
    """A Gaussian on a line: A, sigma, mu, k, m, success. A curve without a peak above its line has
    zeros, that line and no success."""
    scale = _Scale(np.atleast_2d(coords))

    def fit(y: np.ndarray) -> dict[str, np.ndarray]:
        yn, top = scale.curves(y)
        x = scale.unit[:, 0]
        a, s, m, k, b, bad = S.peak_seed(yn, x)
        p, ok = S.least_squares(yn, x, np.stack([a, s, m, k, b], axis=1), S.gaussian_line, n_iter, 1e-4)
        line = np.where(bad[:, None], np.stack([k, b], axis=1), p[:, 3:])
        k, b = scale.line(line[:, 0], line[:, 1], top)
        out = {"A": p[:, 0] * top, "sigma": np.abs(p[:, 1]) * scale.half[0], "mu": scale.mid[0] + scale.half[0] * p[:, 2]}
        out = {n: np.where(bad, 0.0, v) for n, v in out.items()}
        return out | {"k": k, "m": b, "success": (ok & ~bad).astype(float)}

    return _run(curves, [(n, "d") for n in ("A", "sigma", "mu", "k", "m", "success")], fit)


def fit_pseudo_voigt_1d(curves: DataFrame, coords: np.ndarray, n_iter: int = 10) -> DataFrame:
    """A pseudo-Voigt peak on a line: A, sigma, mu, gamma, eta, k, m, success."""
    scale = _Scale(np.atleast_2d(coords))
    box = (np.array([-np.inf] * 4 + [0.0] + [-np.inf] * 2), np.array([np.inf] * 4 + [1.0] + [np.inf] * 2))

    def fit(y: np.ndarray) -> dict[str, np.ndarray]:
        yn, top = scale.curves(y)
        x = scale.unit[:, 0]
        a, s, m, k, b, bad = S.peak_seed(yn, x)
        start = np.stack([a, s, m, np.maximum(s, 1e-3), np.full(len(a), 0.5), k, b], axis=1)
        p, ok = S.least_squares(yn, x, start, S.pseudo_voigt_line, n_iter, 1e-4, box=box)
        k, b = scale.line(p[:, 5], p[:, 6], top)
        h = scale.half[0]
        return {"A": p[:, 0] * top, "sigma": np.abs(p[:, 1]) * h, "mu": scale.mid[0] + h * p[:, 2], "gamma": np.abs(p[:, 3]) * h, "eta": p[:, 4], "k": k, "m": b, "success": (ok & ~bad).astype(float)}

    return _run(curves, [(n, "d") for n in ("A", "sigma", "mu", "gamma", "eta", "k", "m", "success")], fit)


def fit_two_gaussians_1d(curves: DataFrame, coords: np.ndarray, n_iter: int = 12, delta_bic: float = 10.0) -> DataFrame:
    """One and two Gaussians on a line, and which of them the Bayesian criterion takes.

    params1 (A, sigma, mu, k, m, success); params2 (A, sigma, mu of the lower and the higher
    centre, k, m, success); n_peaks 0, 1 or 2; bic1, bic2. Two peaks must win by delta_bic, lie over
    two steps apart and be of plausible size.
    """
    scale = _Scale(np.atleast_2d(coords))
    lo = np.array([0.0, 1e-4, -1.5] * 2 + [-10.0] * 2)
    hi = np.array([4.0, 2.0, 1.5] * 2 + [10.0] * 2)

    def fit(y: np.ndarray) -> dict[str, np.ndarray]:
        yn, top = scale.curves(y)
        x = scale.unit[:, 0]
        n = len(x)
        step = float(np.abs(np.diff(x)).mean()) if n > 1 else 1.0
        a, s, m, k, b, bad = S.peak_seed(yn, x)
        p1, ok1 = S.least_squares(yn, x, np.stack([a, s, m, k, b], axis=1), S.gaussian_line, n_iter, 1e-4)
        ok1 &= ~bad
        first, second, two, smooth = S.two_maxima_1d(np.maximum(yn - k[:, None] * x - b[:, None], 0))
        i, wide = np.arange(len(y)), np.where(bad, 0.1, s)
        low = 0.6 * np.maximum(a, 1e-3)
        width = np.where(two, np.maximum(np.abs(x[second] - x[first]) / 4, step), 0.6 * wide)
        seeds = [
            np.where(two, np.maximum(smooth[i, first], 1e-3), low), width, np.where(two, x[first], m - wide),
            np.where(two, np.maximum(smooth[i, second], 1e-3), low), width, np.where(two, x[second], m + wide), k, b,
        ]
        p2, ok2 = S.least_squares(yn, x, np.stack(seeds, axis=1), S.two_gaussians_line, n_iter, 1e-2, box=(lo, hi))
        ok2 &= ~bad
        bic1, bic2 = _bic(_rss(yn, p1, S.gaussian_line, x), n, 5, ok1), _bic(_rss(yn, p2, S.two_gaussians_line, x), n, 8, ok2)
        plausible = (np.abs(p2[:, 2] - p2[:, 5]) > 2 * step) & (p2[:, [0, 3]] > 0).all(axis=1) & (np.abs(p2[:, [2, 5]]) < 1.5).all(axis=1)
        plausible &= ((np.abs(p2[:, [1, 4]]) > 1e-6) & (np.abs(p2[:, [1, 4]]) < 2)).all(axis=1)
        two = ok2 & plausible & (bic2 + delta_bic < bic1)
        swap = p2[:, 2] > p2[:, 5]
        p2 = np.where(swap[:, None], p2[:, [3, 4, 5, 0, 1, 2, 6, 7]], p2)
        h, mid = scale.half[0], scale.mid[0]

        def back(p: np.ndarray, ok: np.ndarray) -> np.ndarray:
            cols = []
            for j in range(0, p.shape[1] - 2, 3):
                cols += [p[:, j] * top, np.abs(p[:, j + 1]) * h, mid + h * p[:, j + 2]]
            return np.stack([*cols, *scale.line(p[:, -2], p[:, -1], top), ok.astype(float)], axis=1)

        return {"params1": back(p1, ok1), "params2": back(p2, ok2), "n_peaks": np.where(two, 2, np.where(ok1, 1, 0)), "bic1": bic1, "bic2": bic2}

    return _run(curves, [("params1", "v"), ("params2", "v"), ("n_peaks", "t"), ("bic1", "d"), ("bic2", "d")], fit)


class _SeedND:
    """Weighted moments of curves above their minimum, and the fit's first parameters."""

    def __init__(self, yn: np.ndarray, x: np.ndarray):
        self.c = yn.min(axis=1)
        self.w = np.maximum(yn - self.c[:, None], 0)
        total = self.w.sum(axis=1)
        safe = np.maximum(total, 1e-12)
        mu = self.w @ x / safe[:, None]
        d = x[None] - mu[:, None]
        self.cov = np.einsum("np,npi,npj->nij", self.w, d, d) / safe[:, None, None]
        self.a = np.maximum(yn.max(axis=1) - self.c, 1e-3)
        self.inv, fine = S.inverse_spd(self.cov)
        self.bad = ~fine | (total <= 1e-6) | (np.einsum("nii->ni", self.cov) <= 1e-10).any(axis=1)
        self.mu = np.where(self.bad[:, None], 0.0, mu)

    @staticmethod
    def lower(inv: np.ndarray, bad: np.ndarray) -> np.ndarray:
        dims = inv.shape[1]
        m = np.where(bad[:, None, None], np.eye(dims), inv + 1e-9 * np.eye(dims))
        low = np.zeros_like(m)
        for j in range(dims):
            root = np.sqrt(np.maximum(m[:, j, j] - (low[:, j, :j] ** 2).sum(axis=1), 1e-37))
            low[:, j, j] = root
            for i in range(j + 1, dims):
                low[:, i, j] = (m[:, i, j] - (low[:, i, :j] * low[:, j, :j]).sum(axis=1)) / root
        return low


def _start(a: np.ndarray, mu: np.ndarray, low: np.ndarray) -> np.ndarray:
    r, c = np.tril_indices(mu.shape[1])
    return np.hstack([a[:, None], mu, low[:, r, c]])


def _single_nd(yn: np.ndarray, x: np.ndarray, n_iter: int, freeze: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, _SeedND]:
    """(parameters, ok, covariances, seed)."""
    dims = x.shape[1]
    seed, model = _SeedND(yn, x), S.GaussianND(dims)
    start = np.hstack([_start(seed.a, seed.mu, seed.lower(seed.inv, seed.bad)), seed.c[:, None]])
    frozen = (lambda p: (np.abs(p[:, 1 : 1 + dims]) > 8).any(axis=1)) if freeze else None
    p, ok = S.least_squares(yn, x, start, model, n_iter, 0.1, adaptive=True, frozen=frozen)
    low = model.lower(p)
    cov, fine = S.inverse_spd(low @ low.transpose(0, 2, 1))
    return p, ok & fine & ~seed.bad, cov, seed


ND_FIELDS = [("A", "d"), ("mu", "v"), ("cov", "m"), ("c", "d"), ("success", "d")]


def fit_gaussian_nd(curves: DataFrame, coords: np.ndarray, n_iter: int = 10) -> DataFrame:
    """A Gaussian over any number of motors and a constant: A, mu, cov, c, success; zeros where it failed.

    coords: (D, points), row-major over the grid, as the curves are packed.
    """
    scale = _Scale(coords)

    def fit(y: np.ndarray) -> dict[str, np.ndarray]:
        yn, top = scale.curves(y)
        p, ok, cov, _ = _single_nd(yn, scale.unit, n_iter, freeze=True)
        dims = len(scale.half)
        out = {"A": p[:, 0] * top, "mu": scale.mid + scale.half * p[:, 1 : 1 + dims], "cov": cov * np.outer(scale.half, scale.half), "c": p[:, -1] * top}
        return {n: np.where(ok.reshape(-1, *[1] * (v.ndim - 1)), v, 0.0) for n, v in out.items()} | {"success": ok.astype(float)}

    return _run(curves, ND_FIELDS, fit)


def fit_two_gaussians_nd(curves: DataFrame, coords: np.ndarray, grid: tuple[int, ...], n_iter: int = 14, delta_bic: float = 10.0, apart: int = 2) -> DataFrame:
    """One and two Gaussians with a common constant: A1, mu1, cov1, A2, mu2, cov2, c, n_peaks, bic1,
    bic2, success. The higher peak comes first; one-peak pixels have the single fit and a zero second."""
    scale = _Scale(coords)
    dims = len(scale.half)
    single, double = S.GaussianND(dims), S.GaussianND(dims, 2)
    size, x = single.size, scale.unit
    steps = np.array([max(float(np.abs(np.diff(np.moveaxis(x[:, d].reshape(grid), d, 0).reshape(grid[d], -1)[:, 0])).mean()) if grid[d] > 1 else 0.0, 1e-12) for d in range(dims)])
    lo, hi = np.full(2 * size + 1, -np.inf), np.full(2 * size + 1, np.inf)
    for k in (0, size):
        lo[k], hi[k] = 0.0, 4.0
        lo[k + 1 : k + 1 + dims], hi[k + 1 : k + 1 + dims] = -1.5, 1.5
    lo[-1], hi[-1] = -10.0, 10.0

    def seeds(yn: np.ndarray, s: _SeedND) -> np.ndarray:
        first, second, two = S.two_maxima_nd(s.w, grid, apart)
        vals, vecs = np.linalg.eigh(np.where(s.bad[:, None, None], np.eye(dims), s.cov))
        axis = vecs[:, :, -1] * np.sqrt(np.maximum(vals[:, -1:], 0))
        nearer = ((x[None] - x[first][:, None]) ** 2).sum(axis=2) <= ((x[None] - x[second][:, None]) ** 2).sum(axis=2)
        parts, i = [], np.arange(len(yn))
        for at, mine, sign in ((first, nearer, 1.0), (second, ~nearer, -1.0)):
            w = s.w * mine
            d = x[None] - x[at][:, None]
            cov = np.einsum("np,npi,npj->nij", w, d, d) / np.maximum(w.sum(axis=1), 1e-12)[:, None, None]
            split = s.cov - 0.64 * axis[:, :, None] * axis[:, None, :]
            cov = np.where(two[:, None, None], cov, split) + np.diag(steps**2)
            inv, fine = S.inverse_spd(cov)
            mu = np.where(two[:, None], x[at], s.mu + sign * axis)
            a = np.where(two, np.maximum(s.w[i, at], 1e-3), 0.5 * s.a)
            parts.append(_start(a, mu, s.lower(inv, ~fine)))
        return np.clip(np.hstack([*parts, s.c[:, None]]), lo, hi)

    def fit(y: np.ndarray) -> dict[str, np.ndarray]:
        yn, top = scale.curves(y)
        n = len(x)
        p1, ok1, cov1, s = _single_nd(yn, x, 10, freeze=False)
        p2, ok2 = S.least_squares(yn, x, seeds(yn, s), double, n_iter, 0.1, adaptive=True, box=(lo, hi))
        ok2 &= ~s.bad
        bic1 = _bic(_rss(yn, p1, single, x), n, size + 1, ok1)
        bic2 = _bic(_rss(yn, p2, double, x), n, 2 * size + 1, ok2)
        covs, mus, amps, two = [], [], [], ok2 & (bic2 + delta_bic < bic1)
        for k in (0, 1):
            low = double.lower(p2, k)
            cov, fine = S.inverse_spd(low @ low.transpose(0, 2, 1))
            width = np.sqrt(np.maximum(np.einsum("nii->ni", cov), 0))
            mu, a = p2[:, k * size + 1 : k * size + 1 + dims], p2[:, k * size]
            two &= fine & (a > 0) & (np.abs(mu) < 1.5).all(axis=1) & ((width > 1e-6) & (width < 2)).all(axis=1)
            covs.append(cov)
            mus.append(mu)
            amps.append(a)
        two &= (np.abs(mus[0] - mus[1]) > 2 * steps).any(axis=1)
        swap = amps[1] > amps[0]
        one = ok1 & ~two

        def pick(pair: list[np.ndarray], alone: np.ndarray | None, first: bool) -> np.ndarray:
            tail = [1] * (pair[0].ndim - 1)
            b = np.where((swap == first).reshape(-1, *tail), pair[1], pair[0])
            rest = np.where(one.reshape(-1, *tail), alone, 0.0) if alone is not None else np.zeros_like(b)
            return np.where(two.reshape(-1, *tail), b, rest)

        got = two | one
        outer = np.outer(scale.half, scale.half)
        out = {"n_peaks": np.where(two, 2, np.where(ok1, 1, 0)), "bic1": bic1, "bic2": bic2, "success": got.astype(float)}
        for k, first in ((1, True), (2, False)):
            there = two if k == 2 else got
            out[f"A{k}"] = pick(amps, p1[:, 0] if first else None, first) * top
            out[f"mu{k}"] = np.where(there[:, None], scale.mid + scale.half * pick(mus, p1[:, 1 : 1 + dims] if first else None, first), 0.0)
            out[f"cov{k}"] = pick(covs, cov1 if first else None, first) * outer
        out["c"] = np.where(two, p2[:, -1], np.where(one, p1[:, -1], 0.0)) * top
        return out

    return _run(curves, [("A1", "d"), ("mu1", "v"), ("cov1", "m"), ("A2", "d"), ("mu2", "v"), ("cov2", "m"), ("c", "d"), ("n_peaks", "t"), ("bic1", "d"), ("bic2", "d"), ("success", "d")], fit)


# Refits of clipped pixels -------------------------------------------------------------------


def fit_fixed_cov(curves: DataFrame, coords: np.ndarray, grid: tuple[int, ...], cov: np.ndarray, n_iter: int = 30, pad_steps: float = 8.0, free_axes: tuple[int, ...] = (), scale_range: tuple[float, float] = (0.25, 4.0)) -> DataFrame:
    """A Gaussian of given covariance: A, mu, c, success and the widths' scale an axis (1 where fixed).
    Centres may lie up to pad_steps outside of the scanned range."""
    return _run(curves, [("A", "d"), ("mu", "v"), ("c", "d"), ("success", "d"), ("scale", "v")], lambda y: _fixed(y, coords, grid, cov, n_iter, pad_steps, free_axes, scale_range))


def _fixed(y: np.ndarray, coords: np.ndarray, grid: tuple[int, ...], cov: np.ndarray, n_iter: int, pad_steps: float, free: tuple[int, ...], scale_range: tuple[float, float]) -> dict[str, np.ndarray]:
    scale = _Scale(coords)
    dims, k = len(scale.half), len(free)
    model = S.FixedGaussian(np.linalg.inv(np.asarray(cov, float) / np.outer(scale.half, scale.half)), free)
    steps = np.array([np.median(d[d > 0]) if (d := np.diff(np.unique(scale.x[i]))).size else 0.0 for i in range(dims)])
    lo_mu, hi_mu = ((scale.x.min(axis=1) - pad_steps * steps - scale.mid) / scale.half, (scale.x.max(axis=1) + pad_steps * steps - scale.mid) / scale.half)
    box = (np.concatenate([[0.0], lo_mu, [scale_range[0]] * k, [0.0]]), np.concatenate([[50.0], hi_mu, [scale_range[1]] * k, [1.0]]))
    yn, top = scale.curves(y)
    cube = y.reshape(-1, *grid)
    mu = np.empty((len(y), dims))
    for d in range(dims):
        at = cube.sum(axis=tuple(1 + j for j in range(dims) if j != d)).argmax(axis=1)
        mu[:, d] = np.moveaxis(scale.unit[:, d].reshape(grid), d, 0).reshape(grid[d], -1)[at, 0]
    c = np.percentile(yn, 20, axis=1)
    start = np.hstack([np.maximum(yn.max(axis=1) - c, 1e-3)[:, None], mu, np.ones((len(y), k)), c[:, None]])
    p, ok = S.least_squares(yn, scale.unit, np.clip(start, *box), model, n_iter, 1e-2, adaptive=True, box=box)
    widths = np.ones((len(y), dims))
    widths[:, list(free)] = p[:, 1 + dims : 1 + dims + k]
    return {"A": p[:, 0] * top, "mu": scale.mid + scale.half * p[:, 1 : 1 + dims], "c": p[:, -1] * top, "success": (ok & (p[:, 0] > 0)).astype(float), "scale": widths}


def gated_moment(y: np.ndarray, x: np.ndarray, base_pct: float = 20.0, n_sigma: float = 5.0) -> np.ndarray:
    """Centres weighted by what stands out of a low percentile; the highest voxel where nothing does."""
    base = np.percentile(y, base_pct, axis=1)[:, None]
    w = np.where(y > base + n_sigma * np.sqrt(base + 1), y - base, 0.0)
    total = w.sum(axis=1)
    return np.where((total > 0)[:, None], w @ x / np.where(total > 0, total, 1)[:, None], x[y.argmax(axis=1)])


def refit_edges(curves: DataFrame, coords: np.ndarray, grid: tuple[int, ...], fits: DataFrame, status_col: str, cov: np.ndarray, edge_bins: int = 3, refine_widths: bool = True, fallback: str = "moments", pad_steps: float = 8.0) -> DataFrame:
    """Clipped and failed pixels (status 2 or 3) anew with a fixed covariance: the fits' columns and source.

    A second stage frees the widths along axes whose profile peaks inside. What still fails has a
    gated moment as its centre, and amplitude and constant by linear least squares (fallback
    none: stays as it was). source: 0 as it was, 2 refitted, 3 moment.
    """
    keys = ["scan_id", "y", "x"]
    todo = fits.where(f"{status_col} in (2, 3)").select(*keys)
    cov = np.asarray(cov, float)
    dims = len(grid)
    x = np.asarray(coords, float).T
    prec = np.linalg.inv(cov)

    def fit(y: np.ndarray) -> dict[str, np.ndarray]:
        got = _fixed(y, coords, grid, cov, 30, pad_steps, (), (0.25, 4.0))
        cube = y.reshape(-1, *grid)
        ok = got["success"] > 0.5
        covs = np.repeat(cov[None], len(y), axis=0)
        if refine_widths:
            inner = np.empty((len(y), dims), bool)
            for d in range(dims):
                at = cube.sum(axis=tuple(1 + j for j in range(dims) if j != d)).argmax(axis=1)
                inner[:, d] = (at >= edge_bins) & (at < grid[d] - edge_bins)
            for pattern in np.unique(inner[ok], axis=0) if ok.any() else ():
                free = tuple(np.flatnonzero(pattern).tolist())
                rows = np.flatnonzero(ok & (inner == pattern).all(axis=1))
                if free and len(rows):
                    more = _fixed(y[rows], coords, grid, cov, 30, pad_steps, free, (0.25, 4.0))
                    better = more["success"] > 0.5
                    for n in ("A", "mu", "c"):
                        got[n][rows[better]] = more[n][better]
                    s = more["scale"][better]
                    covs[rows[better]] = cov * s[:, :, None] * s[:, None, :]
        source = np.where(ok, 2, 0)
        left = np.flatnonzero(~ok)
        if len(left) and fallback == "moments":
            mu = gated_moment(y[left], x)
            d = x[None] - mu[:, None]
            e = np.exp(-0.5 * np.minimum(np.einsum("npi,ij,npj->np", d, prec, d), 60))
            em, ym = e.mean(axis=1, keepdims=True), y[left].mean(axis=1, keepdims=True)
            var = ((e - em) ** 2).sum(axis=1)
            a = np.maximum(((e - em) * (y[left] - ym)).sum(axis=1) / np.where(var > 0, var, 1), 0)
            got["A"][left], got["mu"][left], got["c"][left] = a, mu, np.maximum(ym[:, 0] - a * em[:, 0], 0)
            source[left] = 3
        return {"rA": got["A"], "rmu": got["mu"], "rcov": covs, "rc": got["c"], "source": source}

    again = _run(curves.join(todo, keys, "left_semi"), [("rA", "d"), ("rmu", "v"), ("rcov", "m"), ("rc", "d"), ("source", "t")], fit)
    new = F.col("source") > 0
    merged = fits.join(again, keys, "left")
    cols = [F.when(new, F.col(f"r{n}")).otherwise(F.col(n)).alias(n) for n in ("A", "mu", "cov", "c")]
    rest = [c for c in fits.columns if c not in (*keys, "A", "mu", "cov", "c", "success")]
    done = F.when(new, F.lit(1.0)).otherwise(F.col("success")).alias("success")
    return merged.select(*keys, *cols, done, *rest, F.coalesce("source", F.lit(0)).cast("tinyint").alias("source"))


def median_healthy_cov(fits: DataFrame, status_col: str, dims: int, least: float = 1e-3) -> np.ndarray:
    """The element-wise median covariance of good fits; ValueError without any."""
    def at(i: int, j: int):
        return F.get(F.get("cov", F.lit(i)), F.lit(j))

    good = fits.where((F.col(status_col) == 1) & (F.col("A") > 0))
    for d in range(dims):
        good = good.where((at(d, d) > 1e-6) & (F.sqrt(F.greatest(at(d, d), F.lit(0.0))) > least))
    row = good.agg(*[F.median(at(i, j)).alias(f"m{i}_{j}") for i in range(dims) for j in range(dims)]).first()
    if row["m0_0"] is None:
        raise ValueError("no healthy fits to take a covariance from")
    return np.array([[row[f"m{i}_{j}"] for j in range(dims)] for i in range(dims)])


def status_after_refit(status, source):
    """The status column, clipped where a refit has given the centre."""
    return F.when(source == 2, F.lit(2)).otherwise(status).cast("tinyint")
