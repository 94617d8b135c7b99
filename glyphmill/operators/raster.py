"""Pixel kernels in numpy: resizing, padding, turning, perspective crops, tensors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _kernel(x: np.ndarray, cubic: bool) -> np.ndarray:
    x = np.abs(x)
    if not cubic:
        return np.maximum(1 - x, 0)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def _weights(source: int, target: int, cubic: bool) -> np.ndarray:
    """Shares of source samples in target samples; the filter widens when shrinking."""
    scale = source / target
    width = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale - 0.5
    share = _kernel((np.arange(source)[None] - centre[:, None]) / width, cubic)
    return share / share.sum(1, keepdims=True)


def resize(img: np.ndarray, height: int, width: int, cubic: bool = False) -> np.ndarray:
    """An 8-bit image (height, width, channels) at another size, with a triangle or Catmull-Rom filter."""
    if img.shape[:2] == (height, width):
        return img
    rows, columns = _weights(img.shape[0], height, cubic), _weights(img.shape[1], width, cubic)
    out = np.tensordot(rows, img.astype(np.float64), (1, 0))
    out = np.tensordot(columns, out, (1, 1)).transpose(1, 0, 2)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two source samples of each target sample, and the second one's weight in 2048ths; samples beyond the edges are the edge's."""
    at = (np.arange(target) + 0.5) * (source / target) - 0.5
    low = np.floor(at).astype(np.int64)
    weight = np.floor((at - low) * 2048 + 0.5).astype(np.int64)
    weight[(low < 0) | (low >= source - 1)] = 0
    low = low.clip(0, source - 1)
    return low, np.minimum(low + 1, source - 1), weight


def resize_fixed(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """An 8-bit image at another size, bilinear between the two nearest samples in whole numbers: weights of 11 bits along rows, then along columns, one rounding at the end."""
    if img.shape[:2] == (height, width):
        return img
    left, right, across = _taps(img.shape[1], width)
    upper, lower, down = _taps(img.shape[0], height)
    rows = img.astype(np.int64)
    rows = rows[:, left] * (2048 - across)[:, None] + rows[:, right] * across[:, None]
    out = rows[upper] * (2048 - down)[:, None, None] + rows[lower] * down[:, None, None]
    return ((out + (1 << 21)) >> 22).astype(np.uint8)


def pad_rows(img: np.ndarray, rows: int) -> np.ndarray:
    return np.pad(img, ((rows, rows), (0, 0), (0, 0)))


def turn(img: np.ndarray, code: int) -> np.ndarray:
    """0: a quarter clockwise; 1: a half; 2: a quarter back."""
    if code not in (0, 1, 2):
        raise ValueError(f"no such rotation: {code}")
    return np.ascontiguousarray(np.rot90(img, (-1, 2, 1)[code]))


def perspective(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The matrix that takes four points to four others; least squares where they don't determine one."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a, b = np.array(rows, float), np.array(right, float)
    try:
        found = np.linalg.solve(a, b)
        if np.abs(a @ found - b).max() < 1e-8:
            return np.append(found, 1).reshape(3, 3)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.svd(np.c_[a, -b])[2][-1].reshape(3, 3)


def warp(img: np.ndarray, matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image under a perspective matrix: bilinear, cut to whole values; the nearest pixel at the far edges; black outside."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    h = np.linalg.inv(matrix)
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    sx, sy = (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w
    rows, columns = img.shape[:2]
    x0, y0 = np.floor(sx), np.floor(sy)
    base = (x0 >= 0) & (x0 < columns) & (y0 >= 0) & (y0 < rows)
    whole = base & (x0 + 1 < columns) & (y0 + 1 < rows)
    xi, yi = np.where(base, x0, 0).astype(int), np.where(base, y0, 0).astype(int)
    xj, yj = np.minimum(xi + 1, columns - 1), np.minimum(yi + 1, rows - 1)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    f = img.astype(float)
    mixed = (1 - fx) * (1 - fy) * f[yi, xi] + fx * (1 - fy) * f[yi, xj] + (1 - fx) * fy * f[yj, xi] + fx * fy * f[yj, xj]
    out = np.where(whole[..., None], np.nan_to_num(mixed), f[yi, xi])
    return np.where(base[..., None], out, 0).astype(np.uint8)


def _cubic_weights(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the samples at -1, 0, 1 and 2 for a place t after sample 0, by the cubic kernel of slope -3/4."""
    a = -0.75

    def outer(x: np.ndarray) -> np.ndarray:
        return a * (x**3 - 5 * x**2 + 8 * x - 4)

    def inner(x: np.ndarray) -> np.ndarray:
        return (a + 2) * x**3 - (a + 3) * x**2 + 1

    return [outer(t + 1), inner(t), inner(1 - t), outer(2 - t)]


def warp_cubic(img: np.ndarray, matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image under a perspective matrix: each pixel from four by four samples, those beyond the edges being the edge's; rounded and cut to 0 to 255."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    h = np.linalg.inv(matrix)
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    rows, columns = img.shape[:2]
    with np.errstate(divide="ignore", invalid="ignore"):
        sx, sy = (np.nan_to_num((h[k, 0] * x + h[k, 1] * y + h[k, 2]) / w, posinf=1e9, neginf=-1e9) for k in (0, 1))
    # far outside only the edge counts, wherever exactly a sample lies
    sx, sy = sx.clip(-4, columns + 3), sy.clip(-4, rows + 3)
    x0, y0 = np.floor(sx), np.floor(sy)
    across, down = _cubic_weights(sx - x0), _cubic_weights(sy - y0)
    out = np.zeros((height, width, img.shape[2]))
    for j in range(4):
        yj = (y0 + j - 1).clip(0, rows - 1).astype(int)
        line = np.zeros_like(out)
        for i in range(4):
            line += across[i][..., None] * img[yj, (x0 + i - 1).clip(0, columns - 1).astype(int)]
        out += down[j][..., None] * line
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def crop(img: np.ndarray, quad: np.ndarray, cubic: bool = False) -> np.ndarray | None:
    """The upright crop of a quadrilateral, turned if it is tall; None if it has no area. cubic: by warp_cubic(), else by warp()."""
    side = lambda i, j: np.hypot(*(quad[i] - quad[j]))
    width, height = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    if not width or not height:
        return None
    out = (warp_cubic if cubic else warp)(img, perspective(quad, np.array([(0, 0), (width, 0), (width, height), (0, height)])), height, width)
    return turn(out, 0) if height / width >= 1.5 else out


def tensor(img: np.ndarray, width: int | None = None) -> np.ndarray:
    """Channels first, values from -1 to 1, padded right with zeros to a width."""
    planes = ((img.astype(np.float32) / 255 - 0.5) / 0.5).transpose(2, 0, 1)
    return planes if width is None else np.pad(planes[:, :, :width], ((0, 0), (0, 0), (0, max(0, width - planes.shape[2]))))


def recogniser_input(img: np.ndarray, max_ratio: float, height: int = 48, red_first: bool = True, resized: Callable = resize) -> np.ndarray:
    """A crop at the recogniser's height, as wide as its ratio asks, padded to its batch's width. Planes: red first, or blue first."""
    width = int(np.floor(height * max_ratio + 0.5))
    own = min(int(np.ceil(height * (img.shape[1] / img.shape[0]))), width)
    small = resized(img, height, own)
    return tensor(small if red_first else small[:, :, ::-1], width)
