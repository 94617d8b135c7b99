"""Image sizes as column expressions: bounded resizing, padding, detector and recogniser inputs. No pixel is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.config import DetConfig, GlobalConfig


def whole(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")


def to_32(side: Column, ratio: Column) -> Column:
    """A scaled side cut to a whole number, then rounded to a multiple of 32 (half up)."""
    return (F.floor(whole(side * ratio) / 32.0 + 0.5) * 32).cast("int")


def bounded_size(h: Column, w: Column, g: GlobalConfig = GlobalConfig()) -> dict[str, Column]:
    """new_h, new_w, ratio_h, ratio_w and status of resizing to sides between the bounds: shrink first, then grow.

    A side that rounds to zero is an error (`status`), with null sizes and ratios.
    """
    shrinks = F.greatest(h, w) > g.max_side_len
    by = F.lit(float(g.max_side_len)) / F.greatest(h, w)
    h1, w1 = (F.when(shrinks, to_32(s, by)).otherwise(s) for s in (h, w))
    grows = F.least(h1, w1) < g.min_side_len
    up = F.try_divide(F.lit(float(g.min_side_len)), F.least(h1, w1))
    h2, w2 = (F.when(grows, to_32(s, up)).otherwise(s) for s in (h1, w1))
    bad = (F.least(h1, w1) <= 0) | (F.least(h2, w2) <= 0)
    good = F.coalesce(~bad, F.lit(False))
    # the ratio of the last resize that fired: from the size before it
    base_h, base_w = (F.when(grows, a).otherwise(b) for a, b in ((h1, h), (w1, w)))
    return {
        "new_h": F.when(good, h2), "new_w": F.when(good, w2),
        "ratio_h": F.when(good, F.try_divide(base_h.cast("double"), h2)), "ratio_w": F.when(good, F.try_divide(base_w.cast("double"), w2)),
        "status": F.when(good, "ok").otherwise("preprocess_error"),
    }


def vertical_padding(h: Column, w: Column, g: GlobalConfig = GlobalConfig()) -> Column:
    """Rows to add above and below a low or wide image; a ratio of -1 turns the test of width off."""
    wide = F.lit(False) if g.width_height_ratio == -1 else w / h > g.width_height_ratio
    target = F.greatest(whole(w / g.width_height_ratio), F.lit(g.min_height)) * 2
    return F.when((h <= g.min_height) | wide, F.floor(F.abs(target - h) / 2).cast("int")).otherwise(0)


def detector_limit(h: Column, w: Column, d: DetConfig = DetConfig()) -> Column:
    longest = F.greatest(h, w)
    by_length = F.when(longest < 960, 960).when(longest < 1500, 1500).otherwise(2000)
    return F.lit(d.limit_side_len) if d.limit_type == "min" else by_length


def detector_size(h: Column, w: Column, d: DetConfig = DetConfig()) -> tuple[Column, Column]:
    limit = detector_limit(h, w, d).cast("double")
    if d.limit_type == "max":
        ratio = F.when(F.greatest(h, w) > limit, limit / F.greatest(h, w)).otherwise(1.0)
    else:
        ratio = F.when(F.least(h, w) < limit, limit / F.least(h, w)).otherwise(1.0)
    return to_32(h, ratio), to_32(w, ratio)


def padded_width(w: Column, h: Column, step: int, height: int = 48, least: int = 320) -> Column:
    """The width that a crop of w by h takes at the recogniser's height, as a multiple of step; a crop of no height is as wide as high."""
    own = F.coalesce(F.ceil(F.try_divide(height * w, h)), F.lit(height))
    return (F.ceil(F.greatest(F.lit(least), own) / step) * step).cast("int")
