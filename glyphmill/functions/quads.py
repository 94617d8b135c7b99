"""Quadrilaterals as eight columns x1, y1 .. x4, y4 (top left, top right, bottom right, bottom left), in expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.sizing import whole

C = F.col
X, Y = [f"x{n}" for n in (1, 2, 3, 4)], [f"y{n}" for n in (1, 2, 3, 4)]


def side(i: int, j: int) -> Column:
    return F.sqrt((C(X[i]) - C(X[j])) ** 2 + (C(Y[i]) - C(Y[j])) ** 2)


def area() -> Column:
    terms = (C(X[i]) * C(Y[(i + 1) % 4]) - C(X[(i + 1) % 4]) * C(Y[i]) for i in range(4))
    return F.abs(sum(terms, F.lit(0.0))) / 2


def perimeter() -> Column:
    return sum((side((i + 1) % 4, i) for i in range(4)), F.lit(0.0))


def unclip_distance(ratio: float = 1.6) -> Column:
    """How far a box grows on every side; null without a perimeter."""
    return area() * ratio / F.nullif(perimeter(), F.lit(0.0))


def ordered() -> dict[str, Column]:
    """The corners in order: by x (ties as they came), the left pair and the right pair then by y."""
    points = F.array_sort(F.array(*(F.struct(C(x).alias("x"), F.lit(n).alias("n"), C(y).alias("y")) for n, (x, y) in enumerate(zip(X, Y, strict=True)))))
    a, b, c, d = (points[n] for n in range(4))
    left, right = a["y"] > b["y"], c["y"] > d["y"]

    def pick(swap: Column, first: Column, second: Column, axis: str) -> Column:
        return F.when(swap, second[axis]).otherwise(first[axis])

    out = {}
    for axis in "xy":
        out |= {f"{axis}1": pick(left, a, b, axis), f"{axis}4": pick(left, b, a, axis), f"{axis}2": pick(right, c, d, axis), f"{axis}3": pick(right, d, c, axis)}
    return out


def clipped(w: Column, h: Column, inclusive: bool = False) -> dict[str, Column]:
    """Corners moved into the image: up to its last pixel, or up to its size if inclusive."""
    less = 0 if inclusive else 1
    return {x: F.greatest(F.least(C(x), w - less), F.lit(0.0)) for x in X} | {y: F.greatest(F.least(C(y), h - less), F.lit(0.0)) for y in Y}


def scaled(fx: Column, fy: Column) -> dict[str, Column]:
    return {x: C(x) * fx for x in X} | {y: C(y) * fy for y in Y}


def unmapped(ratio_h: Column, ratio_w: Column, top: Column, w: Column, h: Column, resize_first: bool = True) -> dict[str, Column]:
    """Corners in the original image, clamped to its size. resize_first: scale, then take the padding off (a quirk)."""

    def inside(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), most)

    ys = {y: C(y) * ratio_h - top if resize_first else (C(y) - top) * ratio_h for y in Y}
    return {x: inside(C(x) * ratio_w, w) for x in X} | {y: inside(v, h) for y, v in ys.items()}


def rectangle(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> dict[str, Column]:
    """The corners of a rotated rectangle."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    out = {}
    for n, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1))):
        dx, dy = w / 2 * sx, h / 2 * sy
        out |= {X[n]: cx + dx * cos - dy * sin, Y[n]: cy + dx * sin + dy * cos}
    return out


def crop_size() -> dict[str, Column]:
    """Width and height of the crop of a quadrilateral, and whether it is turned for being tall."""
    width, height = whole(F.greatest(side(0, 1), side(2, 3))), whole(F.greatest(side(0, 3), side(1, 2)))
    tall = F.coalesce(F.try_divide(height, width) >= 1.5, F.lit(False))
    return {"crop_w": F.when(tall, height).otherwise(width), "crop_h": F.when(tall, width).otherwise(height), "rotated": tall}


def long_enough(least: int = 3) -> Column:
    """Both sides from the top left corner, as whole numbers, longer than least."""
    return (whole(side(0, 1)) > least) & (whole(side(0, 3)) > least)


def holds(x: Column, y: Column, corners: list[tuple[Column, Column]] | None = None) -> Column:
    """Even-odd test of a point."""
    points = corners or [(C(a), C(b)) for a, b in zip(X, Y, strict=True)]
    inside = F.lit(False)
    for i in range(4):
        (xi, yi), (xj, yj) = points[i], points[i - 1]
        crossed = ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi)
        inside = inside != F.coalesce(crossed, F.lit(False))
    return inside


def bounds() -> dict[str, Column]:
    """The upright rectangle around the corners: left, top, right, bottom."""
    return {"left": F.least(*map(C, X)), "top": F.least(*map(C, Y)), "right": F.greatest(*map(C, X)), "bottom": F.greatest(*map(C, Y))}


def placed(left: Column, top: Column, right: Column, bottom: Column, around: dict[str, Column] | Column | None = None) -> dict[str, Column]:
    """Corners of an upright rectangle inside the quadrilateral's bounds, bent as the quadrilateral is (bilinear in its sides)."""
    box = bounds() if around is None else around
    width, height = (F.greatest(F.abs(box[b] - box[a]), F.lit(1e-6)) for a, b in (("left", "right"), ("top", "bottom")))
    u, v = [(x - box["left"]) / width for x in (left, right)], [(y - box["top"]) / height for y in (top, bottom)]

    def at(axis: list[str], s: Column, t: Column) -> Column:
        upper, lower = (C(axis[i]) + (C(axis[j]) - C(axis[i])) * s for i, j in ((0, 1), (3, 2)))
        return upper + (lower - upper) * t

    out = {}
    for n, (s, t) in enumerate(((u[0], v[0]), (u[1], v[0]), (u[1], v[1]), (u[0], v[1]))):
        out |= {X[n]: at(X, s, t), Y[n]: at(Y, s, t)}
    return out


def grown(ratio: float = 1.6) -> dict[str, Column]:
    """The corners of a rotated rectangle that grew on every side by its unclip distance, around the same centre."""
    distance, out = unclip_distance(ratio), {}
    for n in range(4):
        along, across = ((n, (n + 1) % 4), (n, (n + 3) % 4))
        for axis in (X, Y):
            steps = [(C(axis[i]) - C(axis[j])) / F.nullif(side(i, j), F.lit(0.0)) * distance for i, j in (along, across)]
            out[axis[n]] = C(axis[n]) + steps[0] + steps[1]
    return out
