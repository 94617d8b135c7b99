"""Borders, filled polygons and round corners against plain versions and cases by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.config import DetConfig, Quirks
from glyphmill.operators import detection, segment
from glyphmill.operators import outlines as O
from glyphmill.schemas import CORNERS

RING = np.array([[0, 0, 0, 0, 0, 0], [0, 1, 1, 1, 1, 0], [0, 1, 0, 0, 1, 0], [0, 1, 0, 0, 1, 0], [0, 1, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0]], bool)


def test_ring_has_two_borders():
    (outer, around), (inner, hole) = O.follow(RING.astype(int))
    assert (outer, inner) == (False, True)
    assert O.corners_of(around).tolist() == [[1, 1], [4, 1], [4, 4], [1, 4]] and len(around) == 12
    assert sorted(map(tuple, hole.tolist())) == [(1, 2), (1, 3), (2, 1), (2, 4), (3, 1), (3, 4), (4, 2), (4, 3)]
    assert O.area_of(around) == 9 and O.area_of(hole) == 7
    assert len(O.corners_of(hole)) == 8


def test_point_line_and_nothing():
    one, line = np.zeros((3, 4), int), np.zeros((3, 4), int)
    one[1, 1] = line[1, 0:4] = 1
    assert [p.tolist() for _, p in O.follow(one)] == [[[1, 1]]] and O.follow(np.zeros((2, 2), int)) == []
    (_, there_and_back), = O.follow(line)
    assert there_and_back.tolist() == [[0, 1], [1, 1], [2, 1], [3, 1], [2, 1], [1, 1]] and O.corners_of(there_and_back).tolist() == [[0, 1], [3, 1]]


def traced(fg, start, entered):
    """One border, pixel by pixel: clockwise around each pixel from where the walk came, until the first step repeats."""
    around = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]  # x, y from north, clockwise
    at, came, steps = start, entered, []
    while True:
        k = around.index(came)
        for i in range(1, 9):
            x, y = at[0] + around[(k + i) % 8][0], at[1] + around[(k + i) % 8][1]
            if 0 <= y < fg.shape[0] and 0 <= x < fg.shape[1] and fg[y, x]:
                break
        else:
            return [at]
        last = around[(k + i - 1) % 8]
        step = (at, (x, y))
        if steps and step == steps[0]:
            return [a for a, _ in steps]
        steps.append(step)
        came = (at[0] + last[0] - x, at[1] + last[1] - y)
        at = (x, y)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(0.2, 0.85))
def test_borders_equal_tracing(seed, share):
    """Each outer border as traced from its first pixel, coming from above; as many holes as there are background regions inside."""
    fg = np.random.default_rng(seed).random((8, 9)) < share
    found = O.follow(fg.astype(int))
    for hole, points in found:
        x, y = points[0].tolist()
        expected = traced(fg, (x, y), (0, 1) if hole else (0, -1))
        if not hole:
            assert points.tolist() == [list(p) for p in expected]
        else:
            assert sorted(map(tuple, points.tolist())) == sorted(expected)
    outside = segment.label_mask(np.pad(~fg, 1, constant_values=True))
    assert sum(h for h, _ in found) == outside.max() - 1
    labels = segment.label_mask(fg)
    outer = [p for h, p in O.follow(labels, diagonal=False) if not h]
    assert len(outer) == labels.max() and all(len({labels[y, x] for x, y in p}) == 1 for p in outer)


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_cycles(n):
    order = np.random.default_rng(n).permutation(n)
    least, place = O.cycles(order)
    for start in np.unique(least).tolist():
        at, k = start, 0
        while True:
            assert (least[at], place[at]) == (start, k)
            at, k = int(order[at]), k + 1
            if at == start:
                break


def test_true_area_of_a_concave_shape():
    """A U: through pixel centres 4 x 4, less the gap of 2 x 2 and the triangle below it that the diagonal steps cut off."""
    fg = np.zeros((7, 7), bool)
    fg[1:6, 1:3] = fg[1:6, 4:6] = fg[4:6, 1:6] = True
    (_, points), = O.follow(fg.astype(int))
    assert O.area_of(points) == 16 - 4 - 1


def plain_fill(points, h, w):
    """Row by row: edges' own pixels, and the pixels between crossings in pairs."""
    mask = np.zeros((h, w), bool)
    edges = list(zip(points, [*points[1:], points[0]], strict=True))
    for y in range(h):
        cuts = []
        for (xa, ya), (xb, yb) in edges:
            if ya == yb:
                if y == ya:
                    mask[y, max(0, min(xa, xb)) : max(0, max(xa, xb) + 1)] = True
                continue
            (xa, ya), (xb, yb) = sorted(((xa, ya), (xb, yb)), key=lambda p: p[1])
            if ya <= y <= yb:
                x = xa + (y - ya) * (xb - xa) / (yb - ya)
                at = math.floor(x + 0.5)
                if 0 <= at < w:
                    mask[y, at] = True
                if y < yb:
                    cuts.append((x, at))
        cuts.sort()
        for (_, a), (_, b) in zip(cuts[::2], cuts[1::2], strict=True):
            mask[y, max(0, a) : max(0, b + 1)] = True
    return mask


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 12), st.integers(-3, 12)), min_size=3, max_size=8))
def test_fill_equals_plain_rows(points):
    assert (O.filled(np.array(points), 10, 9) == plain_fill(points, 10, 9)).all()


def test_mean_of_filled_polygon():
    probs = np.arange(36.0).reshape(6, 6)
    square = np.array([(1.2, 1.7), (3.9, 1.7), (3.9, 3.9), (1.2, 3.9)])
    assert O.mean_filled(probs, square) == pytest.approx(probs[1:4, 1:4].mean())
    assert O.mean_filled(probs, square + 50) == 0.0 and O.mean_filled(probs, np.array([(2, 2), (2, 2), (2, 2.0)])) == 0.0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.floats(-3, 12), st.floats(-3, 12)), max_size=7), max_size=5))
def test_means_of_many_polygons_equal_masks(listed):
    """All polygons of a map at once against the mask of each."""
    probs = np.random.default_rng(1).random((8, 9))
    polygons = [np.array(p, float).reshape(-1, 2) for p in listed]
    for points, mean in zip(polygons, O.filled_means(probs, polygons), strict=True):
        expected = 0.0
        if len(points):
            low = np.clip(np.floor(points.min(0)), 0, (8, 7)).astype(int)
            high = np.clip(np.ceil(points.max(0)), 0, (9, 8)).astype(int)
            if (high > low).all():
                part = probs[low[1] : high[1] + 1, low[0] : high[0] + 1]
                mask = plain_fill([tuple(p) for p in np.trunc(points - low).astype(int).tolist()], *part.shape)
                expected = part[mask].mean() if mask.any() else 0.0
        assert mean == pytest.approx(expected)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=6), max_size=6))
def test_many_polygons_grow_as_each(listed):
    polygons = [np.array(p, float).reshape(-1, 2) for p in listed]
    for points, (distance, ring) in zip(polygons, O._grown(polygons, 1.6, 0.25), strict=True):
        around = around_of(points) if len(points) else 0.0
        assert distance == pytest.approx(O.area_of(points) * 1.6 / around if around else 0.0)
        alone = O.grown(points, distance, 0.25) if len(points) else points
        assert (O.area_of(ring) if len(ring) else 0.0) == pytest.approx(O.area_of(alone) if len(alone) else 0.0, rel=1e-6, abs=1e-6)


def around_of(points):
    return float(np.hypot(*(np.roll(points, -1, 0) - points).T).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=4, max_size=12), st.floats(0.5, 20))
def test_convex_polygons_grow_by_the_closed_form(listed, d):
    from glyphmill.operators.shapes import convex_hull

    hull = convex_hull(np.unique(np.array(listed, float), axis=0))
    if len(hull) < 3 or O.area_of(hull) == 0:
        return
    expected = O.area_of(hull) + around_of(hull) * d + math.pi * d * d
    for points in (hull, hull[::-1]):
        assert O.area_of(O.grown(points, d, 1e-4)) == pytest.approx(expected, rel=1e-3)


def test_concave_polygons_keep_their_outer_ring():
    """A U with a gap of 4: grown by 1 the gap stays, by 3 it closes and the result has no hole or loop."""
    shape = np.array([(0, 0), (12, 0), (12, 10), (8, 10), (8, 2), (4, 2), (4, 10), (0, 10)], float)
    for d in (1.0, 1.9, 3.0, 6.0):
        ring = O.grown(shape, d, 1e-3)
        step = 0.05
        ys, xs = np.mgrid[-8:20:step, -8:22:step]
        distance = np.full(xs.shape, np.inf)
        for a, b in zip(shape, np.roll(shape, -1, 0), strict=True):
            t = np.clip(((xs - a[0]) * (b - a)[0] + (ys - a[1]) * (b - a)[1]) / ((b - a) @ (b - a)), 0, 1)
            distance = np.minimum(distance, np.hypot(xs - a[0] - t * (b - a)[0], ys - a[1] - t * (b - a)[1]))
        within = (distance <= d) | segment.inside(xs, ys, shape)
        holes = segment.label_mask(np.pad(~within, 1, constant_values=True))[1:-1, 1:-1]
        assert O.area_of(ring) == pytest.approx(((holes != 1)).sum() * step * step, rel=0.01)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(0.3, 3))
def test_grown_stars_hold_all_near_points(seed, d):
    """Star-shaped polygons with sharp notches: points nearer than the distance lie inside, others outside."""
    rng = np.random.default_rng(seed)
    turn = np.sort(rng.uniform(0, 2 * np.pi, 9))
    if np.diff(np.r_[turn, turn[0] + 2 * np.pi]).max() > 3 or np.diff(turn).min() < 0.05:
        return
    shape = np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(2, 9, 9)[:, None]
    ring = O.grown(shape, d, 1e-4)
    x, y = rng.uniform(-14, 14, (2, 2000))
    distance = np.full(x.shape, np.inf)
    for a, b in zip(shape, np.roll(shape, -1, 0), strict=True):
        t = np.clip(((x - a[0]) * (b - a)[0] + (y - a[1]) * (b - a)[1]) / ((b - a) @ (b - a)), 0, 1)
        distance = np.minimum(distance, np.hypot(x - a[0] - t * (b - a)[0], y - a[1] - t * (b - a)[1]))
    near, held = (distance <= d - 0.01) | segment.inside(x, y, shape), segment.inside(x, y, ring)
    assert held[near].all()
    far = (distance > d + 0.01) & ~segment.inside(x, y, shape)
    outermost = np.hypot(x, y) > np.hypot(*shape.T).max() + d + 0.01
    assert not held[far & outermost].any() and O.area_of(ring) >= O.area_of(shape)


PLAIN = DetConfig(use_dilation=False, box_thresh=0.1, thresh=0.5)


def ring_map():
    probs = np.zeros((40, 60))
    probs[5:35, 5:55] = 0.9
    probs[12:28, 15:45] = 0.0
    return probs


def test_borders_switch_finds_the_hole():
    """Components give the ring alone; borders the hole too (last found first), whose score is that of its inside."""
    found = detection.detect_boxes(ring_map(), 60, 40, PLAIN, Quirks())
    assert len(found) == 1 and found[0][0][0].tolist() < [5, 5]
    both = detection.outlines(ring_map() > 0.5, DetConfig(borders=True), Quirks())
    assert [len(p) for p in both] == [8, 4] and both[1].tolist() == [[5, 5], [54, 5], [54, 34], [5, 34]]
    assert len(detection.outlines(ring_map() > 0.5, DetConfig(borders=True, max_candidates=1), Quirks())) == 1
    scores = [s for _, s in detection.detect_boxes(ring_map(), 60, 40, DetConfig(use_dilation=False, box_thresh=0.0, thresh=0.5, borders=True), Quirks())]
    assert scores[0] < 0.2 < 0.5 < scores[1] < 0.9


def test_order_of_candidates_by_true_area():
    """A comb has a large sum in raster order and a small area; the block beside it is the larger one."""
    fg = np.zeros((30, 60), bool)
    fg[2:20:2, 2:22] = fg[2:20, 2] = True
    fg[4:20, 30:46] = True
    first = [detection.component_outlines(fg, raster)[0][:, 0].min() for raster in (True, False)]
    assert first == [2.0, 30.0]
    assert sorted(len(p) for p in detection.component_outlines(fg, True)) == sorted(len(p) for p in detection.component_outlines(fg, False))


def test_filled_scores_and_round_corners():
    probs = np.zeros((40, 60))
    probs[10:30, 10:50] = 0.8
    plain, = detection.detect_boxes(probs, 60, 40, PLAIN, Quirks())
    filled, = detection.detect_boxes(probs, 60, 40, DetConfig(use_dilation=False, box_thresh=0.1, thresh=0.5, filled_score=True), Quirks())
    grown, = detection.detect_boxes(probs, 60, 40, DetConfig(use_dilation=False, box_thresh=0.1, thresh=0.5, round_corners=True), Quirks())
    assert filled[1] == pytest.approx(0.8) and plain[1] == pytest.approx(0.8)
    assert np.abs(grown[0] - plain[0]).max() <= 2  # a rectangle with round corners has the same smallest rectangle, sides cut to whole numbers
    assert detection.detect_boxes(probs, 60, 40, DetConfig(use_dilation=False, box_thresh=0.1, thresh=0.5, grown_min_side=400), Quirks()) == []


def test_dilation_looks_back():
    fg = np.zeros((3, 3), bool)
    fg[1, 1] = True
    assert segment.dilate_mask(fg, forward=False)[1:, 1:].all() and segment.dilate_mask(fg, forward=False).sum() == 4


def test_box_scores_by_tiles(spark, monkeypatch):
    """Whatever the side of a tile, each box has the mean of plain sums; boxes outside, without a map or without area have 0; rows that repeat keep their score."""
    rng = np.random.default_rng(3)
    grids = {k: rng.random((9, 13)) for k in range(3)}
    maps = spark.createDataFrame([(k, 13, g.ravel().tolist()) for k, g in grids.items()], "image_id long, w int, probs array<double>")
    rows = []
    for n in range(60):
        centre, size = rng.uniform(-2, 14, 2), rng.uniform(0.2, 8, 2)
        quad = (centre + np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * size / 2 + rng.normal(0, 0.3, (4, 2))).ravel()
        rows.append((n % 4, n, *map(float, quad), 9, 13))
    rows.append((1, 900, *[3.5] * 8, 9, 13))
    boxes = spark.createDataFrame(rows, "image_id long, box_id long, " + ", ".join(f"{c} double" for c in CORNERS) + ", h int, w int")
    for side in (1, 4, 16):
        monkeypatch.setattr(segment, "TILE", side)
        found = segment.box_scores(segment.pixels(maps), boxes).collect()
        assert len(found) == len(rows)
        scores = {r["box_id"]: r["score"] for r in found}
        for image, n, *quad, _, _ in rows:
            expected = segment.mean_inside(grids[image], np.array(quad).reshape(4, 2)) if image in grids else 0.0
            assert scores[n] == pytest.approx(expected)
    assert segment.box_scores(segment.pixels(maps), boxes.limit(0)).count() == 0


def test_relational_borders_and_polygons_on_odd_rows(spark):
    maps = spark.createDataFrame([(1, 6, 6, RING.astype(float).ravel().tolist()), (1, 6, 6, RING.astype(float).ravel().tolist()), (2, 2, 2, [0.0] * 4), (3, None, None, None)], "image_id long, h int, w int, probs array<double>")
    found = O.borders(maps, 0.5).collect()
    assert sorted((r["image_id"], r["border"], r["is_hole"], r["n_points"], r["area"], len(r["xs"])) for r in found) == [(1, 0, False, 12, 9.0, 4)] * 2 + [(1, 1, True, 8, 7.0, 8)] * 2
    polygons = spark.createDataFrame([(2, 1, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]), (3, 2, [0.0], [0.0]), (9, 3, [1.0, 2.0], [1.0, 2.0]), (2, 4, [], []), (2, 5, None, None)], "image_id long, polygon_id long, xs array<double>, ys array<double>")
    assert sorted((r["polygon_id"], r["score"]) for r in O.polygon_scores(maps, polygons).collect()) == [(k, 0.0) for k in range(1, 6)]
    grown = {r["polygon_id"]: (r["n_points"], r["area"]) for r in O.grown_polygons(polygons, ["polygon_id"]).collect()}
    assert grown[4] == grown[5] == (0, 0.0) and grown[1][1] > 0.5
    assert O.borders(maps.limit(0), 0.5).count() == 0 and O.polygon_scores(maps, polygons.limit(0)).count() == 0
