"""Settings of the recognition dataflow, with a switch for each quirk whose corrected form is also offered."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Quirks:
    """True: behave as the reference does; False: the corrected form (but for scores_by_box)."""

    unmap_resize_first: bool = True  # boxes are scaled back before padding is taken off
    overwrite_ratios: bool = True  # if both resizes fire, the second ratio stands alone
    truncate_sides: bool = True  # sides of rotated rectangles are whole numbers
    recogniser_red_first: bool = True  # the detector is fed blue first, the recogniser red first
    bilinear_crops: bool = True  # crops are bilinear and black outside the image, not cubic with the edge going on
    filtered_resize: bool = True  # resizing is by a triangle filter that widens when shrinking, not between the two nearest samples in whole numbers
    shifted_columns: bool = True  # classes that the dictionary lacks make no character but keep their step, so that later characters of a line have columns of earlier steps
    scores_by_box: bool = True  # boxes carry their own scores into reading order; False (as the reference lists them, which nothing reads): those of candidates in their order
    raster_areas: bool = True  # candidates rank by a sum over boundary pixels in raster order, not by the area that their outer border encloses
    dilate_forward: bool = True  # dilation looks right and down, not left and up
    token_confidences: bool = True  # a word's confidence is that of the kept step of its own number, not its characters' mean


@dataclass(frozen=True)
class DetConfig:
    limit_side_len: int = 736
    batch: int = 8  # images that are held as tensors at once
    limit_type: str = "min"
    thresh: float = 0.3
    box_thresh: float = 0.5
    max_candidates: int = 1000
    unclip_ratio: float = 1.6
    use_dilation: bool = True
    min_side: int = 3
    grown_min_side: int = 3
    borders: bool = False  # candidates are outer borders and those of holes, less the points within straight runs, last found first
    filled_score: bool = False  # a box's score is of its filled polygon with whole corners, not of the pixel centres inside
    round_corners: bool = False  # boxes grow with round corners, and the result's smallest rectangle counts


@dataclass(frozen=True)
class RecConfig:
    height: int = 48
    width: int = 320
    batch: int = 6
    width_step: int = 0  # 0: a line is padded to the widest of its batch, of its own image; else to a multiple of so many pixels, whatever its mates


@dataclass(frozen=True)
class GlobalConfig:
    text_score: float = 0.5
    min_height: int = 30
    width_height_ratio: float = 8.0
    max_side_len: int = 2000
    min_side_len: int = 30
    return_word_box: bool = False  # lines have word_results
    return_single_char_box: bool = False  # and these are of characters, whatever the line's words


@dataclass(frozen=True)
class Config:
    det: DetConfig = field(default_factory=DetConfig)
    rec: RecConfig = field(default_factory=RecConfig)
    glob: GlobalConfig = field(default_factory=GlobalConfig)
    quirks: Quirks = field(default_factory=Quirks)
