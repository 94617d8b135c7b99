"""Images to scored text lines: detect, crop and recognise are stages from DataFrame to DataFrame; decoding is expressions.

An image's rows never depend on another's, so nothing shuffles before the final order; a failing image is a row
with an error beside the results, not a failed job. Empty tables give empty results; images that repeat are read
again each; null pixels or sizes count as undecodable.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphmill.batches import bounded_batches
from glyphmill.config import Config
from glyphmill.functions import quads, sizing
from glyphmill.operators import decode, wordboxes
from glyphmill.operators.detection import detect_boxes
from glyphmill.operators.inference import backend
from glyphmill.operators.raster import crop as cropped
from glyphmill.operators.raster import pad_rows, recogniser_input, resize, resize_fixed, tensor
from glyphmill.schemas import CORNERS, ERROR, OcrError, error_of
from glyphmill.sources.images import pixels_of


def _to_32(v: float) -> int:
    return int(np.floor(int(v) / 32 + 0.5)) * 32


def bounded(img: np.ndarray, glob, overwrite: bool = True, resized: Callable = resize) -> tuple[np.ndarray, float, float]:
    """The image within the bounds of its sides, and the ratios back to its size before."""
    ratio_h = ratio_w = 1.0
    for fires, by in ((lambda h, w: max(h, w) > glob.max_side_len, lambda h, w: glob.max_side_len / max(h, w)), (lambda h, w: min(h, w) < glob.min_side_len, lambda h, w: glob.min_side_len / min(h, w))):
        h, w = img.shape[:2]
        if fires(h, w):
            new_h, new_w = _to_32(h * by(h, w)), _to_32(w * by(h, w))
            if new_h <= 0 or new_w <= 0:
                raise OcrError("Preprocess", "a side rounds to zero")
            img = resized(img, new_h, new_w)
            step_h, step_w = h / new_h, w / new_w
            ratio_h, ratio_w = (step_h, step_w) if overwrite else (ratio_h * step_h, ratio_w * step_w)
    return img, ratio_h, ratio_w


@dataclass(frozen=True)
class Recognition:
    """detector and recogniser: a backend's kind and arguments; characters: the dictionary without blank and space."""

    detector: tuple = ("brightness",)
    recogniser: tuple = ("columns", 40)
    characters: tuple[str, ...] = tuple("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ.,")
    config: Config = field(default_factory=Config)

    @property
    def resized(self) -> Callable:
        return resize if self.config.quirks.filtered_resize else resize_fixed

    def prepared(self, img: np.ndarray) -> tuple[np.ndarray, dict]:
        """The image within bounds and padded, and the way back: ratios, rows of padding above, original size."""
        g = self.config.glob
        small, ratio_h, ratio_w = bounded(img, g, self.config.quirks.overwrite_ratios, self.resized)
        h, w = small.shape[:2]
        wide = g.width_height_ratio != -1 and w / h > g.width_height_ratio
        top = abs(max(int(w / g.width_height_ratio), g.min_height) * 2 - h) // 2 if h <= g.min_height or wide else 0
        return pad_rows(small, top), {"ratio_h": ratio_h, "ratio_w": ratio_w, "top": top, "height": img.shape[0], "width": img.shape[1]}

    def detector_input(self, img: np.ndarray) -> np.ndarray:
        h, w = img.shape[:2]
        d = self.config.det
        limit = d.limit_side_len if d.limit_type == "min" else 960 if max(h, w) < 960 else 1500 if max(h, w) < 1500 else 2000
        ratio = min(1.0, limit / max(h, w)) if d.limit_type == "max" else max(1.0, limit / min(h, w))
        return tensor(self.resized(img, _to_32(h * ratio), _to_32(w * ratio))[:, :, ::-1])

    def boxes(self, probs: np.ndarray, width: int, height: int) -> list[dict]:
        """Quadrilaterals in the padded image and their scores, in reading order."""
        found = detect_boxes(probs, width, height, self.config.det, self.config.quirks)
        scores = [score for _, score in found]
        found.sort(key=lambda f: (int(f[0][0][1]), int(f[0][0][0])))
        if not self.config.quirks.scores_by_box:
            found = [(quad, score) for (quad, _), score in zip(found, scores, strict=True)]
        return [{"box_id": n, "det_score": score, **dict(zip(CORNERS, map(float, quad.ravel()), strict=True))} for n, (quad, score) in enumerate(found)]


_NUMBERS = [T.StructField(c, T.DoubleType()) for c in CORNERS]
BOX = T.StructType([T.StructField("box_id", T.IntegerType()), T.StructField("det_score", T.DoubleType()), *_NUMBERS])
PLACE = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("ratio_h", "ratio_w")), *(T.StructField(c, T.IntegerType()) for c in ("top", "height", "width"))])
PIXELS = [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())]
DETECTED = T.StructType([T.StructField("image_id", T.LongType()), *PIXELS, T.StructField("place", PLACE), T.StructField("boxes", T.ArrayType(BOX)), T.StructField("error", ERROR)])
CROP = T.StructType([T.StructField("image_id", T.LongType()), *BOX.fields, T.StructField("place", PLACE), *PIXELS, T.StructField("error", ERROR)])
STEPS = T.StructType([
    *(f for f in CROP.fields if f not in PIXELS), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("probs", T.ArrayType(T.DoubleType())),
    T.StructField("ratio", T.DoubleType()), T.StructField("max_ratio", T.DoubleType()),
])


def _rows(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


def detect(images: DataFrame, recognition: Recognition = Recognition()) -> DataFrame:
    """DETECTED: padded pixels (red first), the way back to the image, and boxes in them, for each image.

    At most config.det.batch images are held as tensors at once; those of them whose inputs have one shape are one call
    of the detector. A failing image has an error (code, message) and no boxes.
    """
    most = recognition.config.det.batch
    bounded_batches(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, most) for b in batches for a in range(0, b.num_rows, most)):
            keys, heights, widths, channels = (batch.column(n).to_pylist() for n in range(4))
            rows: list[dict] = [{"image_id": key} for key in keys]
            alike = defaultdict(list)
            for n, row in enumerate(rows):
                try:
                    if heights[n] is None or heights[n] <= 0 or not batch.column(4)[n].is_valid:
                        raise OcrError("ImageError", "undecodable image")
                    padded, place = recognition.prepared(pixels_of(heights[n], widths[n], channels[n], batch.column(4)[n].as_buffer()))
                    fed = recognition.detector_input(padded)
                    row |= {"height": padded.shape[0], "width": padded.shape[1], "data": padded.tobytes(), "place": place, "boxes": []}
                    alike[fed.shape].append((row, fed))
                except (ValueError, np.linalg.LinAlgError) as why:
                    row["error"] = error_of(why)
            for some in alike.values():
                try:
                    maps = backend(*recognition.detector).run(np.stack([fed for _, fed in some]))[:, 0]
                    for (row, _), probs in zip(some, maps, strict=True):
                        row["boxes"] = recognition.boxes(probs, row["width"], row["height"])
                except (ValueError, np.linalg.LinAlgError) as why:
                    for row, _ in some:
                        row["error"] = error_of(why)
            yield _rows(rows, DETECTED)

    return images.select("image_id", "height", "width", "nChannels", "data").mapInArrow(run, DETECTED)


def crop(detected: DataFrame, recognition: Recognition = Recognition()) -> DataFrame:
    """CROP: a row for each detected box, its corners in the padded image and the pixels of its upright crop (red first).

    A box without area has an error and no pixels; so has a failed image, which is one row without a box.
    """
    cubic = not recognition.config.quirks.bilinear_crops
    bounded_batches(detected.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column("data")
            for n, image in enumerate(batch.drop_columns(["data"]).to_pylist()):
                if image["error"]:
                    yield _rows([{"image_id": image["image_id"], "error": image["error"]}], CROP)
                    continue
                rows = []
                for box in image["boxes"]:
                    img = np.frombuffer(pixels[n].as_buffer(), np.uint8).reshape(image["height"], image["width"], 3)
                    cut = cropped(img, np.array([box[c] for c in CORNERS]).reshape(4, 2), cubic)
                    made = {"error": error_of(OcrError("Preprocess", "box without area"))} if cut is None else {"height": cut.shape[0], "width": cut.shape[1], "data": cut.tobytes()}
                    rows.append({"image_id": image["image_id"], "place": image["place"], **box, **made})
                if rows:
                    yield _rows(rows, CROP)

    return detected.select(*DETECTED.names).mapInArrow(run, CROP)


def recognise(crops: DataFrame, recognition: Recognition = Recognition(), parts: int = 0) -> DataFrame:
    """STEPS: crops less their pixels, with each step's greatest class and probability, the crop's ratio and its batch's.

    An image's crops go to the recogniser by rising ratio, config.rec.batch at once; they stand together in crop()'s
    output, so batches form within a task and nothing is shuffled. With config.rec.width_step a crop's padded width depends
    on itself alone: crops of one width, of whatever images, are one batch, and a task holds less than a batch of each width.
    parts: then crops are first dealt to so many partitions by width and key, which fills batches where images
    have few lines; a common width is dealt to several.
    """
    c = recognition.config
    bounded_batches(crops.sparkSession)
    step = c.rec.width_step
    least = c.rec.width / c.rec.height

    def read(batch: list[dict], most: float) -> list[dict]:
        """One call of the recogniser for crops that are padded to one ratio."""
        images = (np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3) for r in batch)
        try:
            steps = backend(*recognition.recogniser).run(np.stack([recogniser_input(img, most, c.rec.height, c.quirks.recogniser_red_first, recognition.resized) for img in images]))
        except ValueError as why:
            return [r | {"error": error_of(why)} for r in batch]
        return [r | {"tokens": tokens, "probs": probs, "ratio": r["width"] / r["height"], "max_ratio": most} for r, tokens, probs in zip(batch, steps.argmax(2).tolist(), steps.max(2).tolist(), strict=True)]

    def shown(rows: list[dict]) -> pa.RecordBatch:
        return _rows([{k: v for k, v in r.items() if k in STEPS.names} for r in rows], STEPS)

    def of_image(rows: list[dict]) -> pa.RecordBatch:
        """An image's crops by rising ratio, each batch as wide as its widest."""
        made = [r for r in rows if r["error"]]
        ranked = sorted((r for r in rows if not r["error"]), key=lambda r: r["width"] / r["height"])
        for a in range(0, len(ranked), c.rec.batch):
            batch = ranked[a : a + c.rec.batch]
            made += read(batch, max([least, *(r["width"] / r["height"] for r in batch)]))
        return shown(made)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            pixels = batch.column("data")
            for n, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
                yield row | {"data": pixels[n].as_buffer()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in itertools.groupby(rows_of(batches), key=lambda r: r["image_id"]):
            yield of_image(list(rows))

    def run_by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for row in rows_of(batches):
            if row["error"]:
                yield shown([row])
                continue
            width = padded_width(row["width"], row["height"])
            held[width].append(row | {"data": bytes(row["data"])})  # not the whole batch that it came in
            if len(held[width]) == c.rec.batch:
                yield shown(read(held.pop(width), width / c.rec.height))
        for width, rows in held.items():
            yield shown(read(rows, width / c.rec.height))

    def padded_width(width: int, height: int) -> int:
        return -(-max(c.rec.width, -(-c.rec.height * width // height)) // step) * step

    if parts and step:
        width = sizing.padded_width(F.col("width"), F.col("height"), step, c.rec.height, c.rec.width)
        salt = F.pmod(F.xxhash64("image_id", "box_id"), F.lit(-(-parts // 8)))
        crops = crops.repartition(parts, width, salt)
    return crops.select(*CROP.names).mapInArrow(run_by_width if step else run, STEPS)


def lines_of(recognised: DataFrame, recognition: Recognition = Recognition()) -> DataFrame:
    """image_id, box_id, text, score, corners in the original image and error, of lines that score enough, in expressions alone.

    With return_word_box there is word_results too (see operators/wordboxes.py); its windows stay within a line.
    """
    c = recognition.config
    place, known = F.col("place"), F.col("error").isNull()
    found = recognised.withColumn("kept", decode.kept(F.col("tokens"), F.col("probs")))
    found = found.withColumns({"text": decode.text_of(F.col("kept"), decode.symbols(recognition.characters)), "score": decode.score_of(F.col("kept"))})
    found = found.where(~known | (F.col("score") >= c.glob.text_score))
    corners = quads.unmapped(place["ratio_h"], place["ratio_w"], place["top"], place["width"], place["height"], c.quirks.unmap_resize_first)
    found = found.withColumns({k: F.when(known, v) for k, v in ({"text": F.col("text"), "score": F.col("score")} | corners).items()})
    shown = ["image_id", "box_id", "text", "score", *CORNERS, "error"]
    if not c.glob.return_word_box:
        return found.select(*shown)
    if not c.quirks.shifted_columns:
        found = found.withColumn("kept", F.filter("kept", lambda s: s["token"] < len(recognition.characters) + 2))
    found = found.withColumn("line_cols", wordboxes.line_columns(F.size("tokens"), F.col("ratio"), F.col("max_ratio")))
    return wordboxes.word_results(found, c.glob.return_single_char_box, c.quirks.token_confidences).select(*shown, "word_results")


def ocr(images: DataFrame, recognition: Recognition = Recognition()) -> DataFrame:
    """image_id, box_id, text, score, corners and error (code and message; null unless the image or the box failed).

    detect(), crop() and recognise() run as one chain in a task, so no pixel is shuffled; a failed image is one row.
    """
    return lines_of(recognise(crop(detect(images, recognition), recognition), recognition), recognition)


def image_summary(images: DataFrame, results: DataFrame) -> DataFrame:
    """For each image, also those without lines: lines, characters and mean score (0 for none)."""
    totals = results.where("error IS NULL" if "error" in results.columns else "true").groupBy("image_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.char_length("text")).alias("n_chars"), F.avg("score").alias("mean_score")
    )
    zero = {"n_lines": 0, "n_chars": 0, "mean_score": 0.0}
    return images.select("image_id").distinct().join(totals, "image_id", "left").fillna(zero)
