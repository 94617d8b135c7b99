"""Convex hulls and smallest rotated rectangles of point sets, in Arrow passes over rows of point arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise from the lowest (then leftmost) point, by two monotone chains.

    Up to three points come back as they are. Points on an edge are no corners.
    """
    if len(points) <= 3:
        return points
    unique = np.unique(points, axis=0)  # by x, then y
    if len(unique) < 3:
        return unique

    def chain(run: list) -> list:
        kept: list = []
        for x, y in run:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2:]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                kept.pop()
            kept.append((x, y))
        return kept[:-1]

    listed = unique.tolist()
    hull = np.array(chain(listed) + chain(listed[::-1]))
    start = np.lexsort((hull[:, 0], hull[:, 1]))[0]
    return np.roll(hull, -start, 0)


def min_area_rect(points: np.ndarray, truncate: bool = True) -> tuple[np.ndarray, tuple[float, float], float]:
    """Centre, sides and angle (degrees) of the smallest rectangle with a side along an edge of the hull; the first of equals.

    truncate: sides are cut to whole numbers.
    """
    if not len(points):
        raise ValueError("no points")
    cut = (lambda v: float(int(v))) if truncate else float
    if len(points) == 1:
        return points[0].astype(float), (0.0, 0.0), 0.0
    if len(points) == 2:
        dx, dy = points[1] - points[0]
        return points.mean(0), (cut(np.hypot(dx, dy)), 0.0), float(np.degrees(np.arctan2(dy, dx)))
    hull = convex_hull(points).astype(float)
    if len(hull) < 3:
        low, high = points.min(0), points.max(0)
        return (low + high) / 2, (cut(high[0] - low[0]), cut(high[1] - low[1])), 0.0
    edges = np.roll(hull, -1, 0) - hull
    length = np.hypot(edges[:, 0], edges[:, 1])
    u = edges[length > 1e-6] / length[length > 1e-6, None]
    v = np.stack([-u[:, 1], u[:, 0]], 1)
    on_u, on_v = hull @ u.T, hull @ v.T
    width, height = np.ptp(on_u, axis=0), np.ptp(on_v, axis=0)
    k = int(np.round(width * height, 9).argmin())
    middle = (on_u[:, k].min() + on_u[:, k].max()) / 2 * u[k] + (on_v[:, k].min() + on_v[:, k].max()) / 2 * v[k]
    return middle, (cut(width[k] + 1e-9), cut(height[k] + 1e-9)), float(np.degrees(np.arctan2(u[k, 1], u[k, 0])))


def box_corners(centre: np.ndarray, sides: tuple[float, float], degrees: float) -> np.ndarray:
    angle = np.radians(degrees)
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    return centre + np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * np.array(sides) / 2 @ turn.T


def rectangles(shapes: DataFrame, keys: list[str], truncate: bool = True) -> DataFrame:
    """keys, hull_points, hull_area, cx, cy, w, h, angle of rows with arrays xs and ys."""
    kinds = ", ".join(f"{k} {dict(shapes.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for xs, ys in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True):
                points = np.stack([xs, ys], 1).astype(float)
                hull = convex_hull(points)
                area = abs(np.sum(hull[:, 0] * np.roll(hull[:, 1], -1) - np.roll(hull[:, 0], -1) * hull[:, 1])) / 2 if len(hull) > 2 else 0.0
                (cx, cy), (w, h), angle = min_area_rect(points, truncate)
                rows.append((len(hull), float(area), float(cx), float(cy), w, h, angle))
            names = ["hull_points", "hull_area", "cx", "cy", "w", "h", "angle"]
            kinds_ = [pa.int32(), *[pa.float64()] * 6]
            made = [pa.array([r[n] for r in rows], kinds_[n]) for n in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + made, names=keys + names)

    return shapes.select(*keys, "xs", "ys").mapInArrow(run, f"{kinds}, hull_points int, hull_area double, cx double, cy double, w double, h double, angle double")
