"""Borders of regions followed in order, polygons filled by rows, and polygons grown with round corners.

A border is a cycle of cracks: sides of foreground pixels towards background, walked with the foreground on the right.
The next crack of each is known from three pixels, so all borders of a mask are one permutation; its cycles, and the
place of each crack in its cycle, come from pointer jumping over whole arrays. A cycle that begins (by rows, then columns) with the
upper side of a pixel is an outer border, one that begins with a lower side goes around a hole.

Results in odd cases: an empty mask has no borders; a single pixel is a border of one point, a line one of the points
there and back; images that repeat have their borders each; null maps have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.batches import bounded_batches
from glyphmill.operators.segment import dilate_mask

#: Steps (y, x) east, south, west, north: along the upper, right, lower and left side of a pixel.
STEPS = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])


def cracks(labels: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """y, x and side of each crack of regions of one label (above 0), and the number of the crack after it. diagonal: pixels that touch at corners are joined."""
    held = np.pad(labels, 1)
    around = np.stack([np.roll(held, (1, 0), (0, 1)), np.roll(held, (0, -1), (0, 1)), np.roll(held, (-1, 0), (0, 1)), np.roll(held, (0, 1), (0, 1))], 2)
    y, x, side = np.nonzero((held[:, :, None] > 0) & (around != held[:, :, None]))
    number = np.full((*held.shape, 4), -1)
    number[y, x, side] = np.arange(len(y))
    own, left = held[y, x], (side + 3) % 4
    ahead = np.stack([y, x]) + STEPS[side].T
    across = ahead + STEPS[left].T
    straight, turn = held[ahead[0], ahead[1]] == own, held[across[0], across[1]] == own
    if not diagonal:
        turn &= straight
    after = np.where(straight, number[ahead[0], ahead[1], side], number[y, x, (side + 1) % 4])
    after = np.where(turn, number[across[0], across[1], left], after)
    return np.stack([y - 1, x - 1, side], 1), after


def cycles(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least member of the cycle of each number of a permutation, and its place after that, by doubling."""
    n = len(after)
    least, jump = np.arange(n), after.copy()
    for _ in range(max(1, n).bit_length()):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    last = after == least
    left, jump = (~last).astype(np.int64), np.where(last, np.arange(n), after)
    for _ in range(max(1, n).bit_length()):
        left, jump = left + left[jump], jump[jump]
    return least, left[least] - left


def follow(labels: np.ndarray, diagonal: bool = True) -> list[tuple[bool, np.ndarray]]:
    """Borders (whether around a hole, points x, y in order) of labelled regions, by their first pixels in raster order."""
    where, after = cracks(labels, diagonal)
    if not len(where):
        return []
    least, place = cycles(after)
    order = np.lexsort((place, least))
    where, least = where[order], least[order]
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    new = np.r_[True, (where[1:, :2] != where[:-1, :2]).any(1)]
    new[starts] = True
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(where)], strict=True):
        points = where[a:b][new[a:b]][:, 1::-1]
        if len(points) > 1 and (points[0] == points[-1]).all():
            points = points[:-1]
        out.append((bool(where[a, 2]), points))
    return out


def corners_of(points: np.ndarray) -> np.ndarray:
    """The points of a closed border where its direction changes."""
    if len(points) < 3:
        return points
    step = np.roll(points, -1, 0) - points
    return points[(step != np.roll(step, 1, 0)).any(1)]


def area_of(points: np.ndarray) -> float:
    """Area within a closed line through points in order."""
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))) / 2


def borders(maps: DataFrame, thresh: float, dilate: bool = False, image: str = "image_id") -> DataFrame:
    """image, border (from 0, by first pixel), is_hole, n_points, area, xs and ys (the corners of straight runs) of maps (image, h, w, probs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h, w, probs in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                fg = np.array(probs or [], np.float64).reshape(h, w) > thresh if probs else np.zeros((1, 1), bool)
                found = follow((dilate_mask(fg) if dilate else fg).astype(np.int32))
                kept = [corners_of(p) for _, p in found]
                columns = [
                    pa.array([key] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([hole for hole, _ in found], pa.bool_()),
                    pa.array([len(p) for _, p in found], pa.int32()), pa.array([area_of(p) for _, p in found], pa.float64()),
                    *(pa.array([k[:, c].tolist() for k in kept], pa.list_(pa.int32())) for c in (0, 1)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[image, "border", "is_hole", "n_points", "area", "xs", "ys"])

    return maps.select(image, "h", "w", "probs").mapInArrow(run, f"{image} long, border int, is_hole boolean, n_points int, area double, xs array<int>, ys array<int>")


def filled(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """Pixels of a polygon with whole corners (x, y; any number, also concave or crossing itself): its edges, and what lies between each second and the next crossing of a row.

    Edges are sorted by their rows; an edge crosses the rows from its upper end up to the one before its lower end, and
    has a pixel (rounded half up) in every row that it touches.
    """
    mask = np.zeros((height, width), bool)
    x0, y0 = points[:, 0].astype(np.int64), points[:, 1].astype(np.int64)
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)

    def mark(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        inside = (y >= 0) & (y < height) & (b >= 0) & (a < width)
        change = np.zeros((height, width + 1), np.int32)
        np.add.at(change, (y[inside], np.maximum(a[inside], 0)), 1)
        np.add.at(change, (y[inside], np.minimum(b[inside] + 1, width)), -1)
        np.logical_or(mask, np.cumsum(change, 1)[:, :width] > 0, out=mask)

    flat = y0 == y1
    mark(y0[flat], np.minimum(x0, x1)[flat], np.maximum(x0, x1)[flat])
    up = y0 > y1
    top, foot = np.where(up, y1, y0)[~flat], np.where(up, y0, y1)[~flat]
    begin, end = np.where(up, x1, x0)[~flat], np.where(up, x0, x1)[~flat]
    rows = np.repeat(np.arange(len(top)), foot - top + 1)
    y = np.arange(len(rows)) - np.repeat(np.cumsum(foot - top + 1) - (foot - top + 1), foot - top + 1) + top[rows]
    # twice the crossing, and twice the edge's height: rounding half up in whole numbers
    rise = (foot - top)[rows]
    x = (2 * (begin[rows] * rise + (y - top[rows]) * (end - begin)[rows]) + rise) // (2 * rise)
    mark(y, x, x)
    crosses = y < foot[rows]
    exact = begin[rows] + (y - top[rows]) * (end - begin)[rows] / rise
    order = np.lexsort((exact[crosses], y[crosses]))
    y, x = y[crosses][order], x[crosses][order]
    mark(y[::2], x[::2], x[1::2])
    return mask


def filled_means(probs: np.ndarray, polygons: list[np.ndarray]) -> np.ndarray:
    """Means of the map over filled polygons, whose corners are cut to whole numbers from the corner of their bounds; 0 where there is none.

    As filled(), for all polygons at once and without masks: spans of pixels by polygon and row, of which each adds what
    those before it left, from sums along the map's rows.
    """
    h, w = probs.shape
    of = np.repeat(np.arange(len(polygons)), [len(p) for p in polygons])
    out = np.zeros(len(polygons))
    if not len(of):
        return out
    points = np.concatenate([p for p in polygons if len(p)])
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    some = of[first]
    low, high = np.zeros((len(polygons), 2), np.int64), np.zeros((len(polygons), 2), np.int64)
    low[some] = np.clip(np.floor(np.minimum.reduceat(points, first)), 0, (w - 1, h - 1))
    high[some] = np.clip(np.ceil(np.maximum.reduceat(points, first)), 0, (w, h))
    keep = (high > low).all(1)[of]
    of, points = of[keep], points[keep]
    if not len(of):
        return out
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    after = np.arange(1, len(of) + 1)
    after[np.r_[first[1:], len(of)] - 1] = first
    at = np.trunc(points - low[of]).astype(np.int64)
    x0, y0, x1, y1 = at[:, 0], at[:, 1], at[after, 0], at[after, 1]
    flat = y0 == y1
    spans = [(of[flat], y0[flat], np.minimum(x0, x1)[flat], np.maximum(x0, x1)[flat])]
    up = y0 > y1
    top, foot = np.where(up, y1, y0)[~flat], np.where(up, y0, y1)[~flat]
    begin, end, whose = np.where(up, x1, x0)[~flat], np.where(up, x0, x1)[~flat], of[~flat]
    size = foot - top + 1
    edge = np.repeat(np.arange(len(top)), size)
    y = np.arange(len(edge)) - np.repeat(np.cumsum(size) - size, size) + top[edge]
    rise, run = (foot - top)[edge], (y - top[edge]) * (end - begin)[edge]
    x = (2 * (begin[edge] * rise + run) + rise) // (2 * rise)
    spans.append((whose[edge], y, x, x))
    crosses = y < foot[edge]
    exact = begin[edge] + run / rise
    order = np.flatnonzero(crosses)[np.lexsort((exact[crosses], y[crosses], whose[edge][crosses]))]
    spans.append((whose[edge][order][::2], y[order][::2], x[order][::2], x[order][1::2]))
    who, y, a, b = (np.concatenate(c) for c in zip(*spans, strict=True))
    # from the polygon's bounds to the map
    last = np.minimum(high, (w - 1, h - 1))
    y, a, b = y + low[who, 1], np.maximum(a + low[who, 0], low[who, 0]), np.minimum(b + low[who, 0], last[who, 0])
    there = (y >= low[who, 1]) & (y <= last[who, 1]) & (a <= b)
    who, y, a, b = who[there], y[there], a[there], b[there]
    order = np.lexsort((a, y, who))
    who, y, a, b = who[order], y[order], a[order], b[order]
    row = np.cumsum(np.r_[False, (who[1:] != who[:-1]) | (y[1:] != y[:-1])][: len(who)]) * (w + 1)
    done = np.maximum.accumulate(row + b + 1)
    start = np.maximum(a, np.r_[0, done[:-1]][: len(who)] - row)
    new = start <= b
    sums = np.pad(np.cumsum(probs, 1), ((0, 0), (1, 0)))
    held = np.bincount(who[new], (b - start + 1)[new], len(polygons))
    total = np.bincount(who[new], (sums[y, b + 1] - sums[y, np.minimum(start, w)])[new], len(polygons))
    return np.divide(total, held, out=out, where=held > 0)


def mean_filled(probs: np.ndarray, points: np.ndarray) -> float:
    """filled_means() of one polygon."""
    return float(filled_means(probs, [points])[0])


def arc_step(distance: float, tolerance: float) -> float:
    """The angle whose chord stays within tolerance of an arc of radius distance."""
    return 2 * float(np.arccos(max(0.0, 1 - min(tolerance, distance) / distance)))


def grown_line(points: np.ndarray, distance: float, tolerance: float) -> np.ndarray:
    """A closed line at distance outside a polygon (corners with its inside on the left): arcs around convex corners; at concave ones it runs back over the corner, inside what it encloses."""
    edge = np.roll(points, -1, 0) - points
    out = np.stack([edge[:, 1], -edge[:, 0]], 1) / np.hypot(edge[:, 0], edge[:, 1])[:, None] * distance
    line = []
    for k, corner in enumerate(points):
        a, b = out[k - 1], out[k]
        turn = float(np.arctan2(a[0] * b[1] - a[1] * b[0], a @ b))
        line.append(corner + a)
        if turn > 0:
            start, parts = np.arctan2(a[1], a[0]), int(np.ceil(turn / arc_step(distance, tolerance) - 1e-9))
            line += [corner + distance * np.array([np.cos(start + turn * i / parts), np.sin(start + turn * i / parts)]) for i in range(1, parts)]
        elif turn < 0:
            line.append(corner)
        line.append(corner + b)
    return np.array(line)


def outer_ring(line: np.ndarray) -> np.ndarray:
    """The outer border of what a closed line that may cross itself encloses, as points in order.

    All crossings of its segments cut them; from the lowest point the walk takes the rightmost way at every meeting.
    """
    line = line[np.hypot(*(np.roll(line, -1, 0) - line).T) > 1e-9]
    a, d = line, np.roll(line, -1, 0) - line
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    apart = a[None] - a[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (apart[..., 0] * d[None, :, 1] - apart[..., 1] * d[None, :, 0]) / cross
        u = (apart[..., 0] * d[:, None, 1] - apart[..., 1] * d[:, None, 0]) / cross
    meets = (np.abs(cross) > 1e-12) & (t > -1e-9) & (t < 1 + 1e-9) & (u > -1e-9) & (u < 1 + 1e-9)
    near = {}

    def node(p: np.ndarray) -> tuple[int, int]:
        key = tuple(np.round(p * 1e6).astype(np.int64).tolist())
        for dx in (0, -1, 1):
            for dy in (0, -1, 1):
                if (key[0] + dx, key[1] + dy) in near:
                    return key[0] + dx, key[1] + dy
        near[key] = p
        return key

    ways: dict[tuple, set] = {}
    for k in range(len(a)):
        stops = sorted({0.0, 1.0, *t[k, meets[k]].clip(0, 1).tolist()})
        nodes = [node(a[k] + s * d[k]) for s in stops]
        for p, q in zip(nodes, nodes[1:], strict=False):
            if p != q:
                ways.setdefault(p, set()).add(q)
                ways.setdefault(q, set()).add(p)
    start = min(near, key=lambda p: (p[1], p[0]))
    ring, at, heading = [start], start, 0.0  # from the lowest point everything lies above: the walk comes from the left
    while True:

        def right_turn(q: tuple, at: tuple = at, heading: float = heading) -> float:
            """How far to the left of the way back: the least is the rightmost way."""
            return (np.arctan2(q[1] - at[1], q[0] - at[0]) - heading - np.pi - 1e-12) % (2 * np.pi)

        nxt = min(ways[at], key=right_turn)
        heading = np.arctan2(nxt[1] - at[1], nxt[0] - at[0])
        at = nxt
        if at == start or len(ring) > 2 * sum(map(len, ways.values())):
            return np.array([near[p] for p in ring])
        ring.append(at)


def grown(points: np.ndarray, distance: float, tolerance: float = 1.0) -> np.ndarray:
    """A simple polygon of any corners, grown by distance on all sides with round corners (chords within tolerance of the arcs); of what it encloses the outer ring."""
    points = points[(points != np.roll(points, 1, 0)).any(1)].astype(float)
    x, y = points[:, 0], points[:, 1]
    signed = float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2
    if len(points) < 3 or signed == 0 or distance <= 0:
        return points
    points = points if signed > 0 else points[::-1]
    line = grown_line(points, distance, tolerance)
    edge = np.roll(points, -1, 0) - points
    before = np.roll(edge, 1, 0)
    convex = (before[:, 0] * edge[:, 1] - before[:, 1] * edge[:, 0] >= 0).all()
    return line[np.hypot(*(np.roll(line, -1, 0) - line).T) > 1e-9] if convex else outer_ring(line)


def grown_convex(points: np.ndarray, distance: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Points of many convex polygons (n by corners by 2, inside on the left), each grown by its distance with round corners, and how many each has."""
    n, k = points.shape[:2]
    edge = np.roll(points, -1, 1) - points
    b = np.stack([edge[..., 1], -edge[..., 0]], 2) / np.hypot(edge[..., 0], edge[..., 1])[..., None]
    a = np.roll(b, 1, 1)
    turn = np.arctan2(a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0], (a * b).sum(2))
    step = 2 * np.arccos(np.maximum(0.0, 1 - np.minimum(tolerance, distance) / distance))
    parts = np.where(turn > 1e-12, np.ceil(turn / step[:, None] - 1e-9), 0).astype(np.int64).ravel()
    size = parts + 1
    corner = np.repeat(np.arange(n * k), size)
    i = np.arange(len(corner)) - np.repeat(np.cumsum(size) - size, size)
    angle = np.arctan2(a[..., 1], a[..., 0]).ravel()[corner] + turn.ravel()[corner] * i / np.maximum(parts, 1)[corner]
    grown_ = points.reshape(-1, 2)[corner] + distance[corner // k][:, None] * np.stack([np.cos(angle), np.sin(angle)], 1)
    return grown_, size.reshape(n, k).sum(1)


def _grown(polygons: list[np.ndarray], ratio: float, tolerance: float) -> list[tuple[float, np.ndarray]]:
    """Distance and ring of each polygon; convex ones of as many corners at once."""
    out: list = [(0.0, p) for p in polygons]
    for corners in {len(p) for p in polygons if len(p)}:
        which = np.array([n for n, p in enumerate(polygons) if len(p) == corners])
        held = np.stack([polygons[n] for n in which.tolist()])
        edge = np.roll(held, -1, 1) - held
        length = np.hypot(edge[..., 0], edge[..., 1])
        signed = (held[..., 0] * np.roll(held[..., 1], -1, 1) - np.roll(held[..., 0], -1, 1) * held[..., 1]).sum(1) / 2
        distance = np.divide(np.abs(signed) * ratio, length.sum(1), out=np.zeros(len(held)), where=length.sum(1) > 0)
        left = np.where((signed < 0)[:, None, None], held[:, ::-1], held)
        edge = np.roll(left, -1, 1) - left
        before = np.roll(edge, 1, 1)
        plain = (distance > 0) & (length > 0).all(1) & (before[..., 0] * edge[..., 1] - before[..., 1] * edge[..., 0] >= 0).all(1) & (corners > 2)
        # corners that turn once around in all: a line that crosses itself turns more often
        turns = np.arctan2(before[..., 0] * edge[..., 1] - before[..., 1] * edge[..., 0], (before * edge).sum(2)).sum(1)
        plain &= np.abs(turns - 2 * np.pi) < 1e-6
        if plain.any():
            made, sizes = grown_convex(left[plain], distance[plain], tolerance)
            for n, d, ring in zip(which[plain].tolist(), distance[plain].tolist(), np.split(made, np.cumsum(sizes)[:-1]), strict=True):
                out[n] = d, ring
        for n, d in zip(which[~plain].tolist(), distance[~plain].tolist(), strict=True):
            out[n] = d, grown(polygons[n], d, tolerance)
    return out


def grown_polygons(polygons: DataFrame, keys: list[str], ratio: float = 1.6, tolerance: float = 1.0) -> DataFrame:
    """keys, distance, n_points, area, xs and ys of polygons (keys, arrays xs and ys) grown by area * ratio / perimeter with round corners."""
    kinds = ", ".join(f"{k} {dict(polygons.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [np.stack([np.array(xs or [], float), np.array(ys or [], float)], 1) for xs, ys in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True)]
            distances, rings = zip(*_grown(given, ratio, tolerance), strict=True) if given else ((), ())
            ends = np.cumsum([0, *map(len, rings)]).astype(np.int32)
            flat = np.concatenate(rings) if rings else np.zeros((0, 2))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(flat[:, c]))) for c in (0, 1)]
            areas = [area_of(r) if len(r) else 0.0 for r in rings]
            made = [pa.array(distances, pa.float64()), pa.array(np.diff(ends)), pa.array(areas, pa.float64()), *lists]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + made, names=[*keys, "distance", "n_points", "area", "xs", "ys"])

    return polygons.select(*keys, "xs", "ys").mapInArrow(run, f"{kinds}, distance double, n_points int, area double, xs array<double>, ys array<double>")


#: Polygons of an image that are scored with one copy of its map.
SCORED = 1024


def polygon_scores(maps: DataFrame, polygons: DataFrame, image: str = "image_id", polygon: str = "polygon_id") -> DataFrame:
    """image, polygon and score: the mean of the map (image, h, w, probs) over the filled polygon (image, polygon, arrays xs and ys), 0 without pixels or without a map.

    Polygons come to their map in lists of about SCORED, by hash; of polygons that repeat each has its score; those of a null image are left out.
    """
    parts = polygons.groupBy(image).agg(F.ceil(F.count("*") / SCORED).alias("parts"))
    part = F.pmod(F.xxhash64(polygon, "xs", "ys"), "parts").alias("part")
    listed = F.collect_list(F.struct(F.col(polygon).alias("id"), "xs", "ys"))
    lists = polygons.join(parts, image).groupBy(image, part).agg(listed.alias("polygons"))
    held = lists.join(maps.select(image, "h", "w", "probs"), image, "left").select(image, "polygons", "h", "w", "probs")
    bounded_batches(polygons.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                # only one list at a time becomes Python objects
                key, some, h, w, probs = (batch.column(n)[row].as_py() for n in range(5))
                grid = np.array(probs, np.float64).reshape(h, w) if probs else None
                given = [np.stack([np.array(p["xs"] or [], float), np.array(p["ys"] or [], float)], 1) for p in some]
                scores = filled_means(grid, given) if grid is not None else np.zeros(len(some))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.int64()), pa.array([p["id"] for p in some], pa.int64()), pa.array(scores, pa.float64())], names=[image, polygon, "score"])

    return held.mapInArrow(run, f"`{image}` long, `{polygon}` long, score double")
