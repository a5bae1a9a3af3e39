"""What happens within one tile, on its arrays: indices, thresholds, morphology, blurs, distances, peaks, features.

Images are two-dimensional, of float64 or bool. Nothing here knows of Spark.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-6


def rescale(image: np.ndarray, low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """Stretched between two percentiles of the finite values, clipped to 0 and 1; 0 where there is no range."""
    good = image[np.isfinite(image)]
    if not good.size:
        return np.zeros(image.shape)
    a, b = np.quantile(good, [low, high])
    if not b > a:
        return np.zeros(image.shape)
    out = np.clip((image - a) / (b - a), 0, 1)
    return np.where(np.isnan(out), 0.0, out)


def indices(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> dict[str, np.ndarray]:
    """Plain colour indices."""
    most = np.maximum(np.maximum(red, green), blue)
    least = np.minimum(np.minimum(red, green), blue)
    double = 2 * green - red - blue
    return {"exg": double, "gli": double / (2 * green + red + blue + EPS), "brightness": (red + green + blue) / 3, "saturation": most - least, "dominance": green - np.maximum(red, blue)}


# The weights of the vegetation indices.
def vegetation(kind: str, red: np.ndarray, green: np.ndarray, blue: np.ndarray, nir: np.ndarray | None = None) -> np.ndarray:
    """The vegetation index of the generic detector ("rgb", or "nir" with that band) or of the one for young trees ("young")."""
    i = indices(red, green, blue)
    if kind == "nir":
        parts = [(0.75, (nir - red) / (nir + red + EPS)), (0.25, i["exg"])]
    elif kind == "rgb":
        parts = [(0.50, i["exg"]), (0.35, i["gli"]), (0.15, i["dominance"] - 0.15 * i["brightness"])]
    else:
        parts = [(0.46, i["exg"]), (0.34, i["gli"]), (0.14, i["dominance"]), (0.06, i["saturation"])]
    return rescale(sum(w * rescale(p) for w, p in parts))


def channels(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> dict[str, np.ndarray]:
    """The nine images that patch features are taken from."""
    i = indices(red, green, blue)
    return {
        "red": red, "green": green, "blue": blue, "exg": rescale(i["exg"]), "gli": rescale(i["gli"]), "brightness": i["brightness"],
        "saturation": i["saturation"], "green_dom": rescale(i["dominance"]), "veg": vegetation("young", red, green, blue),
    }


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The bin centre that separates two classes best, the lowest of equals; a constant is its own threshold."""
    lo, hi = float(values.min()), float(values.max())
    if not hi > lo:
        return lo
    k = np.minimum(np.floor((values - lo) / (hi - lo) * bins).astype(np.int64), bins - 1)
    n = np.bincount(k, minlength=bins).astype(float)
    some = np.flatnonzero(n)
    n, centre = n[some], lo + (some + 0.5) * (hi - lo) / bins
    w1, s1 = np.cumsum(n), np.cumsum(n * centre)
    w2, s2 = w1[-1] - w1, s1[-1] - s1
    gain = np.zeros(len(some))
    gain[:-1] = w1[:-1] * w2[:-1] * (s1[:-1] / w1[:-1] - s2[:-1] / w2[:-1]) ** 2
    return float(centre[np.argmax(np.round(gain, 6))])


def _shifted(image: np.ndarray, y: int, x: int, fill) -> np.ndarray:
    """image[r + y, c + x] at each place; fill beyond the edges."""
    h, w = image.shape
    out = np.full_like(image, fill)
    a, b, c, d = max(0, -y), min(h, h - y), max(0, -x), min(w, w - x)
    if a < b and c < d:
        out[a:b, c:d] = image[a + y : b + y, c + x : d + x]
    return out


def _runs_of(mask: np.ndarray, reach: int, any_: bool) -> np.ndarray:
    """Whether any (or all) of the places up to reach away in the row are in the mask."""
    padded = np.pad(mask, ((0, 0), (reach, reach)), constant_values=not any_)
    sums = np.cumsum(np.pad(padded, ((0, 0), (1, 0))), axis=1)
    held = sums[:, 2 * reach + 1 :] - sums[:, : -2 * reach - 1]
    return held > 0 if any_ else held == 2 * reach + 1


def _disk(mask: np.ndarray, radius: int, any_: bool) -> np.ndarray:
    """A disk is a stack of row runs, so the work grows with its diameter."""
    out = None
    for y in range(-radius, radius + 1):
        row = _shifted(_runs_of(mask, int(math.sqrt(radius * radius - y * y)), any_), y, 0, not any_)
        out = row if out is None else (out | row if any_ else out & row)
    return out


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Outside the image counts as inside the mask."""
    return _disk(mask, radius, False)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return _disk(mask, radius, True)


def opening(mask: np.ndarray, radius: int) -> np.ndarray:
    return dilate(erode(mask, radius), radius)


def closing(mask: np.ndarray, radius: int) -> np.ndarray:
    return erode(dilate(mask, radius), radius)


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node connected with each of n nodes, by the edges a to b: larger roots hook onto smaller ones, then paths are halved."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def components(mask: np.ndarray) -> np.ndarray:
    """4-connected components: at each place of the mask the first place (row by row) of its component, else -1."""
    place = np.arange(mask.size).reshape(mask.shape)
    right, down = mask[:, :-1] & mask[:, 1:], mask[:-1] & mask[1:]
    a, b = np.concatenate((place[:, :-1][right], place[:-1][down])), np.concatenate((place[:, 1:][right], place[1:][down]))
    return np.where(mask, roots(a, b, mask.size).reshape(mask.shape), -1)


def sizes_of(labels: np.ndarray) -> np.ndarray:
    """The size of the component at each place; 0 off the mask."""
    n = np.bincount(labels[labels >= 0], minlength=labels.size)
    return np.where(labels >= 0, n[np.maximum(labels, 0)], 0)


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    return mask & (sizes_of(components(mask)) >= least)


def fill_holes(mask: np.ndarray, least: int) -> np.ndarray:
    return ~drop_small(~mask, least)


def correlate(image: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """Along an axis, with half-sample symmetric edges."""
    reach, n = len(taps) // 2, image.shape[axis]
    at = np.arange(-reach, n + reach) % (2 * n)
    padded = image.take(np.where(at < n, at, 2 * n - 1 - at), axis=axis)
    out = np.zeros(image.shape)
    for k, w in enumerate(taps):
        out += w * padded.take(np.arange(k, k + n), axis=axis)
    return out


def reach_of(sigma: float) -> int:
    return int(4 * sigma + 0.5)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur cut at four sigmas."""
    taps = np.exp(-0.5 * (np.arange(-reach_of(sigma), reach_of(sigma) + 1) / sigma) ** 2)
    taps /= taps.sum()
    return correlate(correlate(image.astype(float), taps, 1), taps, 0)


def distance(mask: np.ndarray) -> np.ndarray:
    """Of masked places to the nearest unmasked one; infinite if there is none, 0 off the mask."""
    h, w = mask.shape
    up = np.where(mask, np.inf, 0.0)
    down = up.copy()
    for r in range(1, h):
        up[r] = np.minimum(up[r], up[r - 1] + 1)
    for r in range(h - 2, -1, -1):
        down[r] = np.minimum(down[r], down[r + 1] + 1)
    near = np.minimum(up, down) ** 2
    out = near.copy()
    for k in range(1, w):  # until no column that far away can be nearer
        worst = out.max()
        if k * k >= worst:
            break
        out[:, k:] = np.minimum(out[:, k:], near[:, :-k] + k * k)
        out[:, :-k] = np.minimum(out[:, :-k], near[:, k:] + k * k)
    return np.sqrt(out)


def square_max(image: np.ndarray, reach: int) -> np.ndarray:
    """The largest value of the square around each place."""
    out = image
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        out = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis).max(axis=-1)
    return out


def peaks(image: np.ndarray, reach: int, floor: float) -> np.ndarray:
    """Places (row, column) above the floor that are the largest of their square, from the highest down; of places of a
    plateau nearer than reach the first. None in a constant image."""
    top = image == square_max(image, reach)
    if top.all():
        return np.empty((0, 2), np.int64)
    found = np.argwhere(top & (image > floor))
    found = found[np.argsort(-image[tuple(found.T)], kind="stable")]
    kept: dict[tuple[int, int], list] = {}  # by squares of the reach's size
    out = []
    for y, x in found.tolist():
        cell = (y // reach, x // reach)
        near = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in kept.get((cell[0] + i, cell[1] + j), ()))
        if all(max(abs(y - a), abs(x - b)) >= reach for a, b in near):
            kept.setdefault(cell, []).append((y, x))
            out.append((y, x))
    return np.array(out, np.int64).reshape(-1, 2)


def patch_features(images: dict[str, np.ndarray], y: float, x: float, radius: float) -> list[float]:
    """Mean, deviation, quartiles and centre of each image in the square around a place (clipped at the tile's edges), then
    the inner square's mean of veg less the whole one's, and green over red and blue at the centre."""
    r, row, col = int(max(3, round(radius))), round(y), round(x)
    h, w = images["veg"].shape
    square = lambda n: (slice(max(0, row - n), max(0, min(h, row + n + 1))), slice(max(0, col - n), max(0, min(w, col + n + 1))))
    at = (min(max(row, 0), h - 1), min(max(col, 0), w - 1))
    out: list[float] = []
    for image in images.values():
        patch = image[square(r)]
        q = np.quantile(patch, [0.25, 0.75]) if patch.size else (0.0, 0.0)
        out += [float(patch.mean()) if patch.size else 0.0, float(patch.std()) if patch.size else 0.0, float(q[0]), float(q[1]), float(image[at])]
    inner, whole = images["veg"][square(r // 2)], images["veg"][square(r)]
    contrast = float(inner.mean() - whole.mean()) if inner.size and whole.size else 0.0
    return [*out, contrast, float(images["green"][at] / (images["red"][at] + images["blue"][at] + EPS))]
