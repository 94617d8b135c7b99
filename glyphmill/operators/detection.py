"""From one probability map to boxes: outlines, rectangles, scores and growing, one candidate after the other."""

from __future__ import annotations

import numpy as np

from glyphmill.config import DetConfig, Quirks
from glyphmill.operators.outlines import area_of, corners_of, follow, grown, mean_filled
from glyphmill.operators.segment import boundary_mask, dilate_mask, label_mask, mean_inside, order_corners
from glyphmill.operators.shapes import box_corners, min_area_rect


def component_outlines(fg: np.ndarray, raster_areas: bool) -> list[np.ndarray]:
    """Boundary pixels (x, y) of 4-connected components, those of largest area first, then by first pixel."""
    labels = label_mask(fg)
    y, x = np.nonzero(boundary_mask(labels))
    order = np.argsort(labels[y, x], kind="stable")
    points, of = np.stack([x, y], 1)[order].astype(float), labels[y, x][order]
    parts = np.split(points, np.flatnonzero(np.diff(of)) + 1) if len(of) else []
    if raster_areas:
        areas = [area_of(p) if len(p) > 2 else 0.0 for p in parts]
    else:
        areas = [area_of(p) for hole, p in follow(labels, diagonal=False) if not hole]
    return [parts[k] for k in sorted(range(len(parts)), key=lambda k: (-areas[k], k))]


def outlines(fg: np.ndarray, det: DetConfig, quirks: Quirks) -> list[np.ndarray]:
    """Candidates' points, at most det.max_candidates; those of too few points count among these and are left out then."""
    if det.borders:
        found, least = [corners_of(p).astype(float) for _, p in reversed(follow(fg.astype(np.int32)))], 3
    else:
        found, least = component_outlines(fg, quirks.raster_areas), 4
    return [p for p in found[: det.max_candidates] if len(p) >= least]


def detect_boxes(probs: np.ndarray, width: int, height: int, det: DetConfig, quirks: Quirks) -> list[tuple[np.ndarray, float]]:
    """Boxes (four ordered corners in the source image) and scores of one probability map, in the order of candidates."""
    h, w = probs.shape
    fg = probs > det.thresh
    boxes = []
    for points in outlines(dilate_mask(fg, quirks.dilate_forward) if det.use_dilation else fg, det, quirks):
        centre, sides, angle = min_area_rect(points, quirks.truncate_sides)
        if min(sides) < det.min_side:
            continue
        quad = box_corners(centre, sides, angle)
        score = mean_filled(probs, quad) if det.filled_score else mean_inside(probs, quad)
        if score < det.box_thresh:
            continue
        grow = sides[0] * sides[1] * det.unclip_ratio / (2 * (sides[0] + sides[1]))
        if det.round_corners:
            centre, sides, angle = min_area_rect(grown(quad, grow), quirks.truncate_sides)
        else:
            sides = tuple(float(int(s + 2 * grow)) if quirks.truncate_sides else s + 2 * grow for s in sides)
        if min(sides) < det.grown_min_side:
            continue
        quad = order_corners(box_corners(centre, sides, angle) * (width / w, height / h)).clip(0, (width - 1, height - 1))
        if min(int(np.hypot(*(quad[0] - quad[1]))), int(np.hypot(*(quad[0] - quad[3])))) > 3:
            boxes.append((quad, score))
    return boxes
