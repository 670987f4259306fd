"""One image at a time in numpy: the physical form of the pipeline for image files.

A brick is one row of a tile relation and one task's work: read, background, filter, labels,
measurement.  No pixel ever crosses a shuffle; what leaves is the catalog.
"""

from __future__ import annotations

import math

import numpy as np

from ..config import FLAG_EDGE, BackgroundConfig, DetectConfig, MeasureConfig
from ..operators.convolve import gaussian_kernel
from ..operators.detect import label_runs


def clip_cells(cells: np.ndarray, kappa: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Background and scatter of each row of ``cells`` (NaN: no pixel), all rows at once."""
    x = np.sort(cells, axis=1)  # NaN last
    n0 = np.isfinite(x).sum(1)
    lo, hi = np.zeros(len(x), np.int64), n0.copy()  # a clipped set is a slice of the sorted pixels
    live, rows = n0 > 0, np.arange(len(x))
    place = np.arange(x.shape[1])
    for _ in range(max_iter):
        if not live.any():
            break
        k = np.flatnonzero(live)
        med = x[k, lo[k] + (hi[k] - lo[k]) // 2]
        inside = (place >= lo[k, None]) & (place < hi[k, None])
        dev = np.sort(np.where(inside, np.abs(x[k] - med[:, None]), np.inf), axis=1)
        sig = 1.4826 * dev[np.arange(len(k)), (hi[k] - lo[k]) // 2]
        ok = inside & (x[k] >= (med - kappa * sig)[:, None]) & (x[k] <= (med + kappa * sig)[:, None])
        cut = (sig > 0) & (ok.sum(1) < hi[k] - lo[k])
        lo[k[cut]], hi[k[cut]] = ok[cut].argmax(1), ok[cut].argmax(1) + ok[cut].sum(1)
        live[k[~cut]] = False
    inside = (place >= lo[:, None]) & (place < hi[:, None])
    n = np.maximum(hi - lo, 1)
    v = np.where(inside, x, 0.0)
    mean = v.sum(1) / n
    rms = np.sqrt((np.where(inside, x - mean[:, None], 0.0) ** 2).sum(1) / n)
    med = x[rows, np.minimum(lo + (hi - lo) // 2, x.shape[1] - 1)]
    with np.errstate(invalid="ignore"):
        bg = np.where((rms > 0) & (np.abs(mean - med) < 0.3 * rms), 2.5 * med - 1.5 * mean, med)
    empty = n0 == 0
    return np.where(empty, np.nan, bg), np.where(empty, np.nan, rms)


def background(image: np.ndarray, cfg: BackgroundConfig) -> tuple[np.ndarray, np.ndarray]:
    """Grids of background and scatter; edge cells may be ragged."""
    m, (nr, nc) = cfg.mesh, image.shape
    gr, gc = -(-nr // m), -(-nc // m)
    full = np.full((gr * m, gc * m), np.nan)
    full[:nr, :nc] = np.where(np.isfinite(image), image, np.nan)
    cells = full.reshape(gr, m, gc, m).swapaxes(1, 2).reshape(gr * gc, m * m)
    parts = [clip_cells(cells[i : i + 64], cfg.kappa, cfg.max_iter) for i in range(0, len(cells), 64)]
    return tuple(np.concatenate(p).reshape(gr, gc) for p in zip(*parts))


def interpolate(grid: np.ndarray, shape: tuple[int, int], mesh: int) -> np.ndarray:
    axes = []
    for n, g in zip(shape, grid.shape):
        f = (np.arange(n) + 0.5) / mesh - 0.5
        i = np.floor(f).astype(int)
        axes.append((np.clip(i, 0, g - 1), np.clip(i + 1, 0, g - 1), f - i))
    (r0, r1, dr), (c0, c1, dc) = axes
    dr, dc = dr[:, None], dc[None, :]
    at = lambda r, c: grid[r[:, None], c[None, :]]
    return at(r0, c0) * (1 - dr) * (1 - dc) + at(r0, c1) * (1 - dr) * dc + at(r1, c0) * dr * (1 - dc) + at(r1, c1) * dr * dc


def smooth(image: np.ndarray, sigma: float, truncate: float = 3.0) -> np.ndarray:
    taps = gaussian_kernel(sigma, truncate)
    r, x = len(taps) // 2, np.where(np.isfinite(image), image, 0.0)
    for axis in (1, 0):
        p = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = x.shape[axis]
        x = sum(t * (p[:, k : k + n] if axis else p[k : k + n]) for k, t in enumerate(taps))
    return x


def labels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and labels of the mask's pixels in raster order."""
    edge = np.diff(np.pad(mask, [(0, 0), (1, 1)]).astype(np.int8), axis=1)
    row, c0 = np.nonzero(edge == 1)
    c1 = np.nonzero(edge == -1)[1] - 1
    lab = label_runs(row.astype(np.int64), c0.astype(np.int64), c1.astype(np.int64))
    n = c1 - c0 + 1
    col = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(c0, n)
    return np.repeat(row, n), col, np.repeat(lab, n)


def signal(image: np.ndarray, bcfg: BackgroundConfig, dcfg: DetectConfig) -> tuple[np.ndarray, np.ndarray]:
    """Residual and signal to noise of each pixel."""
    bg, rms = background(image, bcfg)
    res = np.where(np.isfinite(image), image, np.nan) - interpolate(bg, image.shape, bcfg.mesh)
    noise = interpolate(rms, image.shape, bcfg.mesh)
    f = smooth(res, dcfg.sigma, dcfg.truncate)
    with np.errstate(invalid="ignore", divide="ignore"):
        return res, np.where(noise > 0, f / noise, 0.0)


def process(image: np.ndarray, wcs: dict | None, bcfg: BackgroundConfig, dcfg: DetectConfig, mcfg: MeasureConfig) -> dict[str, np.ndarray]:
    """Catalog columns of one image, brightest detection (signal to noise) first."""
    image = np.asarray(image, np.float64)
    nr, nc = image.shape
    res, snr = signal(image, bcfg, dcfg)
    r, c, lab = labels(snr > dcfg.thresh)
    k = int(lab.max()) if len(lab) else 0
    npix = np.bincount(lab, minlength=k + 1)
    order = np.argsort(lab, kind="stable")
    first = np.searchsorted(lab[order], np.arange(1, k + 1))
    keep = np.flatnonzero(npix[1:] >= dcfg.minarea) + 1
    if not len(keep):
        return {n: np.empty(0) for n in ("label", "npix", "x", "y", "ra", "dec", "a", "b", "theta", "ellipticity", "kron_radius", "flux_iso", "flux_auto", "flags", "peak_snr", "peak_row", "peak_col", "rmin", "rmax", "cmin", "cmax")}
    r, c, lab = r[order], c[order], lab[order]
    over = lambda fn, x: fn.reduceat(x, first)[keep - 1]
    rmin, rmax, cmin, cmax = over(np.minimum, r), over(np.maximum, r), over(np.minimum, c), over(np.maximum, c)
    s = snr[r, c]
    peak = over(np.maximum, s)
    top = np.full(k + 1, -1)
    back = np.flatnonzero(s == np.repeat(np.maximum.reduceat(s, first), np.diff(np.r_[first, len(s)])))[::-1]
    top[lab[back]] = back  # the first in raster order is written last
    v = res[r, c]
    good = np.isfinite(v)
    v0 = np.where(good, v, 0.0)
    w = np.maximum(v0, 0.0)
    iso, sw = over(np.add, v0), over(np.add, w)
    on = sw > 0
    d = np.where(on, sw, 1.0)
    x = np.where(on, over(np.add, w * c) / d, (cmin + cmax) / 2)
    y = np.where(on, over(np.add, w * r) / d, (rmin + rmax) / 2)
    at = np.full(k + 1, -1)
    at[keep] = np.arange(len(keep))
    sel = at[lab] >= 0
    who, ws = at[lab[sel]], w[sel]
    dx, dy = c[sel] - x[who], r[sel] - y[who]
    add = lambda e: np.bincount(who, e, len(keep))
    mxx, myy, mxy = add(ws * dx * dx) / d, add(ws * dy * dy) / d, add(ws * dx * dy) / d
    half = (mxx - myy) / 2
    disc = np.hypot(half, mxy)
    n = npix[keep]
    a = np.where(on, np.sqrt(np.maximum((mxx + myy) / 2 + disc, 0)), np.sqrt(n / math.pi))
    b = np.where(on, np.sqrt(np.maximum((mxx + myy) / 2 - disc, 0)), np.sqrt(n / math.pi))
    theta = np.where(on, 0.5 * np.degrees(np.arctan2(mxy, half)), 0.0)
    a = np.maximum(a, 0.5)
    b = np.minimum(np.maximum(b, 0.5), a)
    ct, st = np.cos(np.radians(theta)), np.sin(np.radians(theta))
    if mcfg.kron_min_radius >= math.sqrt(2):
        kron = np.full(len(keep), mcfg.kron_min_radius)
    else:
        pos = np.maximum(v[sel], 0.0)
        pos = np.where(np.isfinite(pos), pos, 0.0)
        u, t = dx * ct[who] + dy * st[who], dy * ct[who] - dx * st[who]
        si = add(pos)
        kron = np.maximum(np.where(si > 0, add(pos * np.sqrt((u / a[who]) ** 2 + (t / b[who]) ** 2)) / np.where(si > 0, si, 1), 1.0), mcfg.kron_min_radius)
    ap = mcfg.kron_factor * kron
    margin = np.ceil(ap * np.maximum(a, b)).astype(int) + 1
    auto = np.empty(len(keep))
    for i in range(len(keep)):
        r0, r1 = max(rmin[i] - margin[i], 0), min(rmax[i] + margin[i] + 1, nr)
        c0, c1 = max(cmin[i] - margin[i], 0), min(cmax[i] + margin[i] + 1, nc)
        ey, ex = np.arange(r0, r1)[:, None] - y[i], np.arange(c0, c1)[None, :] - x[i]
        u, t = (ex * ct[i] + ey * st[i]) / a[i], (ey * ct[i] - ex * st[i]) / b[i]
        auto[i] = np.nansum(res[r0:r1, c0:c1][u * u + t * t <= ap[i] * ap[i]])
    if wcs:
        px, py = x + 1 - wcs["crpix1"], y + 1 - wcs["crpix2"]
        ra, dec = wcs["crval1"] + wcs["cd1_1"] * px + wcs["cd1_2"] * py, wcs["crval2"] + wcs["cd2_1"] * px + wcs["cd2_2"] * py
    else:
        ra = dec = np.full(len(keep), np.nan)
    flags = np.where((rmin == 0) | (rmax + 1 >= nr) | (cmin == 0) | (cmax + 1 >= nc), FLAG_EDGE, 0)
    o = np.lexsort((keep, -peak))
    out = dict(label=keep, npix=n, x=x, y=y, ra=ra, dec=dec, a=a, b=b, theta=theta, ellipticity=1 - b / a, kron_radius=kron, flux_iso=iso, flux_auto=auto, flags=flags, peak_snr=peak, peak_row=r[top[keep]], peak_col=c[top[keep]], rmin=rmin, rmax=rmax, cmin=cmin, cmax=cmax)
    return {name: col[o] for name, col in out.items()}
