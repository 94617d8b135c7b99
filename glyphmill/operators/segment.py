"""From probability maps to boxes: threshold, dilation, components, boundaries, areas, scores.

Pixels are rows (image_id, y, x, p) where relations can say it; connected components and rectangles, which
need an image's mask at once, run in one Arrow pass per image batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import quads as Q
from glyphmill.schemas import CORNERS

#: Side of a tile of pixels that boxes meet.
TILE = 16


def pixels(maps: DataFrame, image: str = "image_id") -> DataFrame:
    """image, y, x, p of maps (image, w, probs in rows)."""
    exploded = maps.select(image, "w", F.posexplode("probs").alias("i", "p"))
    return exploded.select(image, F.expr("CAST(i DIV w AS INT)").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), F.col("p").cast("double").alias("p"))


def mask(points: DataFrame, thresh: float) -> DataFrame:
    """The pixels over the threshold."""
    return points.where(F.col("p") > thresh)


def dilated(foreground: DataFrame, image: str = "image_id") -> DataFrame:
    """Foreground grown by a two by two window that looks forward: a pixel is set if it, its right, lower or lower right one is."""
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))
    near = foreground.select(image, "y", "x", F.explode(offsets).alias("o")).select(image, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    return near.where("y >= 0 AND x >= 0").distinct()


def label_mask(fg: np.ndarray) -> np.ndarray:
    """4-connected components of a boolean mask, numbered from 1 by their first pixel in raster order.

    Runs of each row are joined to overlapping runs of the row above by union-find.
    """
    h, w = fg.shape
    edge = np.diff(np.pad(fg, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        a, b = int(first[y - 1]), int(first[y])
        stop_a, stop_b = b, int(first[y + 1])
        while a < stop_a and b < stop_b:
            if starts[a] < ends[b] and starts[b] < ends[a]:
                i, j = find(a), find(b)
                up[max(i, j)] = min(i, j)
            if ends[a] < ends[b]:
                a += 1
            else:
                b += 1
    roots = np.array([find(i) for i in range(len(rows))], int)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    labels = np.zeros((h, w), np.int32)
    for y, s, e, k in zip(rows, starts, ends, number, strict=True):
        labels[y, s:e] = k
    return labels


def boundary_mask(labels: np.ndarray) -> np.ndarray:
    """Pixels of a component one of whose four neighbours is outside the image or of another label."""
    around = np.pad(labels, 1)
    same = np.ones(labels.shape, bool)
    for dy, dx in ((0, 1), (2, 1), (1, 0), (1, 2)):
        same &= around[dy : dy + labels.shape[0], dx : dx + labels.shape[1]] == labels
    return (labels > 0) & ~same


def components(maps: DataFrame, thresh: float, dilate: bool = False, image: str = "image_id") -> DataFrame:
    """image, label, y, x, is_boundary of every foreground pixel; a map is one row, its pixels never meet another task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h, w, probs in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                fg = np.array(probs, np.float64).reshape(h, w) > thresh
                if dilate:
                    fg = dilate_mask(fg)
                labels = label_mask(fg)
                y, x = np.nonzero(labels)
                columns = [pa.array(np.full(len(y), key)), pa.array(labels[y, x]), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(boundary_mask(labels)[y, x])]
                yield pa.RecordBatch.from_arrays(columns, names=[image, "label", "y", "x", "is_boundary"])

    return maps.select(image, "h", "w", "probs").mapInArrow(run, f"{image} long, label int, y int, x int, is_boundary boolean")


def dilate_mask(fg: np.ndarray, forward: bool = True) -> np.ndarray:
    """A pixel is set if it, its right, lower or lower right one is; or, not forward, its left, upper or upper left one."""
    if not forward:
        return dilate_mask(fg[::-1, ::-1])[::-1, ::-1]
    out = fg.copy()
    out[:, :-1] |= fg[:, 1:]
    out[:-1] |= fg[1:]
    out[:-1, :-1] |= fg[1:, 1:]
    return out


def contour_areas(parts: DataFrame, image: str = "image_id") -> DataFrame:
    """image, label, pixels, boundary, area: half the absolute shoelace sum over boundary pixels in raster order."""
    edge = parts.where("is_boundary")
    order = Window.partitionBy(image, "label").orderBy("y", "x")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = {c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)) for c in "xy"}
    term = edge.select(image, "label", (F.col("x") * following["y"] - following["x"] * F.col("y")).alias("term"))
    sums = term.groupBy(image, "label").agg(F.sum("term").alias("s"), F.count("*").alias("boundary"))
    sizes = parts.groupBy(image, "label").agg(F.count("*").alias("pixels"))
    area = F.when(F.col("boundary") < 3, 0.0).otherwise(F.abs(F.col("s")) / 2)
    return sizes.join(sums, [image, "label"]).select(image, "label", "pixels", "boundary", area.cast("double").alias("area"))


def candidates(areas: DataFrame, most: int = 1000, image: str = "image_id") -> DataFrame:
    """The largest components of each image with rank (from 1): by area, then label."""
    rank = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("area"), "label"))
    return areas.withColumn("rank", rank).where(F.col("rank") <= most)


def inside(x: np.ndarray, y: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against one polygon."""
    found = np.zeros(np.broadcast(x, y).shape, bool)
    for (xi, yi), (xj, yj) in zip(quad, np.roll(quad, 1, 0), strict=True):
        if yi != yj:
            found ^= ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)
    return found


def mean_inside(probs: np.ndarray, quad: np.ndarray) -> float:
    """Mean of the map over pixels whose centres lie in a quadrilateral, 0 if none does."""
    h, w = probs.shape
    low, high = np.floor(quad.min(0)).astype(int), np.ceil(quad.max(0)).astype(int)
    (x0, y0), (x1, y1) = np.clip(low, 0, (w - 1, h - 1)), np.clip(high, 0, (w - 1, h - 1))
    if x0 >= x1 or y0 >= y1:
        return 0.0
    y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    chosen = inside(x + 0.5, y + 0.5, quad)
    return float(probs[y0 : y1 + 1, x0 : x1 + 1][chosen].mean()) if chosen.any() else 0.0


def order_corners(points: np.ndarray) -> np.ndarray:
    left, right = np.split(points[np.argsort(points[:, 0], kind="stable")], 2)
    tl, bl = left[np.argsort(left[:, 1], kind="stable")]
    tr, br = right[np.argsort(right[:, 1], kind="stable")]
    return np.array([tl, tr, br, bl])


def box_scores(points: DataFrame, boxes: DataFrame, image: str = "image_id", box: str = "box_id") -> DataFrame:
    """image, box and score: the mean of p over the pixels (image, y, x, p) whose centres lie in a box, 0 where none does.

    boxes: image, box, CORNERS, and h and w of their maps, to whose last pixels bounds are cut; bounds of no width or
    height hold nothing. Boxes and pixels meet on tiles of TILE by TILE pixels, so a pixel is tested against the boxes of its
    tile alone; a tile of very many boxes is one more key that adaptive execution splits.
    """
    box_keys = [image, box]
    around = Q.bounds()

    def cut(v: Column, size: str) -> Column:
        return F.least(F.greatest(v, F.lit(0)), F.col(size) - 1).cast("int")

    ends = {"from_x": cut(F.floor(around["left"]), "w"), "to_x": cut(F.ceil(around["right"]), "w"), "from_y": cut(F.floor(around["top"]), "h"), "to_y": cut(F.ceil(around["bottom"]), "h")}
    placed = boxes.select(*box_keys, *CORNERS, *(v.alias(k) for k, v in ends.items())).where("from_x < to_x AND from_y < to_y")

    def tiles(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.expr(f"{low} DIV {TILE}"), F.expr(f"{high} DIV {TILE}")))

    tiled = placed.withColumn("tile_y", tiles("from_y", "to_y")).withColumn("tile_x", tiles("from_x", "to_x"))
    pixel_tiles = points.select(image, "y", "x", "p", F.expr(f"y DIV {TILE}").cast("long").alias("tile_y"), F.expr(f"x DIV {TILE}").cast("long").alias("tile_x"))
    met = tiled.join(pixel_tiles, [image, "tile_y", "tile_x"]).where("x BETWEEN from_x AND to_x AND y BETWEEN from_y AND to_y")
    sums = met.where(Q.holds(F.col("x") + 0.5, F.col("y") + 0.5)).groupBy(*box_keys).agg(F.avg("p").alias("score"))
    return boxes.select(*box_keys).join(sums, box_keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
