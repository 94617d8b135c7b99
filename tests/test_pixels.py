"""Pixel kernels behind switches against plain sums, interlaced files, and pixels held in bounded batches."""

import struct
import zlib

import numpy as np
import pytest

from glyphmill.config import Config, DetConfig, GlobalConfig, Quirks, RecConfig
from glyphmill.operators import inference, raster
from glyphmill.plans.pipeline import Recognition, crop, detect, lines_of, ocr, recognise
from glyphmill.schemas import CORNERS
from glyphmill.sources import images


def test_fixed_point_resize_by_whole_numbers():
    img = np.random.default_rng(3).integers(0, 256, (7, 11, 3), dtype=np.uint8)
    for height, width in ((14, 5), (3, 30), (7, 12), (1, 1)):
        out = raster.resize_fixed(img, height, width)

        def taps(source, target, k):
            at = (k + 0.5) * source / target - 0.5
            low = int(np.floor(at))
            weight = int(np.floor((at - low) * 2048 + 0.5))
            if low < 0 or low >= source - 1:
                low, weight = min(max(low, 0), source - 1), 0
            return (low, 2048 - weight), (min(low + 1, source - 1), weight)

        for y in range(height):
            for x in range(width):
                for c in range(3):
                    total = sum(a * b * int(img[j, i, c]) for j, a in taps(7, height, y) for i, b in taps(11, width, x))
                    assert out[y, x, c] == (total + 2**21) // 2**22
    assert raster.resize_fixed(img, 7, 11) is img


def test_cubic_crops_by_plain_sums():
    img = np.random.default_rng(2).integers(0, 256, (9, 12, 3), dtype=np.uint8)
    quad = np.array([(-2.0, -1.0), (10.0, 1.5), (11.0, 8.5), (1.0, 7.0)])
    out = raster.crop(img, quad, cubic=True)
    back = np.linalg.inv(raster.perspective(quad, np.array([(0, 0), (out.shape[1], 0), (out.shape[1], out.shape[0]), (0, out.shape[0])])))

    def kernel(x, a=-0.75):
        x = abs(x)
        return (a + 2) * x**3 - (a + 3) * x**2 + 1 if x <= 1 else a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a if x < 2 else 0

    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            u, v, w = back @ (x, y, 1)
            u, v = u / w, v / w
            i0, j0 = int(np.floor(u)), int(np.floor(v))
            total = sum(kernel(u - i) * kernel(v - j) * img[min(max(j, 0), 8), min(max(i, 0), 11)].astype(float) for i in range(i0 - 1, i0 + 3) for j in range(j0 - 1, j0 + 3))
            assert (np.abs(out[y, x] - np.clip(total, 0, 255)) <= 0.5 + 1e-6).all()
    same = raster.warp_cubic(img, np.eye(3), 9, 12)
    assert (same == img).all() and (raster.crop(img, quad) != out).any()


def interlaced(img, depth=8):
    """A PNG in seven passes, rows unfiltered; grey of one bit a sample where depth is 1."""
    rows = b""
    for y, x, down, across in images.PASSES:
        for row in img[y::down, x::across]:
            if row.size:
                rows += b"\0" + (np.packbits(row[:, 0] > 0).tobytes() if depth == 1 else row.tobytes())

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], depth, 0 if depth == 1 else 2, 0, 0, 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("size", [(1, 1), (2, 3), (5, 4), (8, 8), (13, 21)])
def test_interlaced_png(spark, tmp_path, size):
    img = np.random.default_rng(1).integers(0, 256, (*size, 3), dtype=np.uint8)
    assert (images.decoded(interlaced(img)) == img).all()
    dots = np.repeat((img[:, :, :1] > 127) * np.uint8(255), 3, 2)
    assert (images.decoded(interlaced(dots, 1)) == dots).all()
    assert images.decoded(interlaced(img)[:-20]) is None
    if size == (13, 21):
        (tmp_path / "a.png").write_bytes(interlaced(img))
        file = images.image_files(spark, str(tmp_path)).first()
        assert bytes(file["data"]) == img[:, :, ::-1].tobytes()


def drawn(rng, lines):
    img = np.zeros((40 + 40 * lines, 320, 3), np.uint8)
    for k in range(lines):
        img[20 + 40 * k : 36 + 40 * k, 20 : 20 + int(rng.integers(60, 280))] = rng.integers(150, 256)
    return img


def test_images_are_held_in_bounded_batches(spark):
    """200 images in one Arrow batch: the detector never sees more than the setting says."""
    rng = np.random.default_rng(5)
    frame = images.raw_images(spark, [(k, drawn(rng, 1)) for k in range(200)]).coalesce(1)

    class Watched(inference.BrightnessDetector):
        """A detector of one's own."""

        def run(self, batch):
            if len(batch) > 3:
                raise RuntimeError("too many images at once")
            return super().run(batch)

    settings = Recognition(detector=(Watched,), config=Config(det=DetConfig(limit_type="max", batch=3), glob=GlobalConfig(text_score=0.3)))
    found = detect(frame, settings).collect()
    assert len(found) == 200 and all(r["error"] is None and len(r["boxes"]) == 1 for r in found)


@pytest.mark.parametrize("quirks", [Quirks(), Quirks(bilinear_crops=False, filtered_resize=False)])
def test_lines_do_not_hang_on_their_mates(spark, quirks):
    """With widths by steps, texts are the same however images are dealt, and with the exchange; without, a line's padding is its batch's."""
    rng = np.random.default_rng(6)
    frame = images.raw_images(spark, [(k, drawn(rng, 1 + k % 4)) for k in range(12)])
    config = lambda step: Config(det=DetConfig(limit_type="max"), rec=RecConfig(width_step=step, batch=4), glob=GlobalConfig(text_score=0.1), quirks=quirks)
    seen = Recognition(config=config(64))

    def lines(rows):
        return sorted((r["image_id"], r["box_id"], r["text"], round(r["score"], 6)) for r in rows.collect())

    expected = lines(ocr(frame, seen))
    assert len(expected) == sum(1 + k % 4 for k in range(12)) and all(t for _, _, t, _ in expected)
    assert lines(ocr(frame.coalesce(1), seen)) == lines(ocr(frame.repartition(7), seen)) == expected
    alone = [x for k in range(12) for x in lines(ocr(frame.where(f"image_id = {k}"), seen))]
    assert alone == expected
    crops = crop(detect(frame, seen), seen)
    assert lines(lines_of(recognise(crops, seen, parts=5), seen)) == expected
    widths = {r["max_ratio"] * 48 for r in recognise(crops, seen).collect()}
    assert all(w % 64 == 0 and w >= 320 for w in widths)
    plain = Recognition(config=config(0))
    assert [x[:2] for x in lines(ocr(frame, plain))] == [x[:2] for x in expected]
    assert recognise(crops.limit(0), seen).count() == 0 and set(CORNERS) <= set(crops.columns)


def jpeg(spark, img, quality=0.9, grey=False, progressive=False):
    """Pixels as a file by the JVM's own writer (colours at half the size)."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(img.shape[1], img.shape[0], 10 if grey else 1)
    values = img.astype(int)
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            r, g, b = values[y, x].tolist()
            image.setRGB(x, y, (r << 16 | g << 8 | b) - (1 << 24))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    if progressive:
        how.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.stream.MemoryCacheImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def smooth(height, width):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([(x * 5 + y) % 256 * 0 + 128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 40 + x * 1.5 + y], 2).clip(0, 255).astype(np.uint8)


def test_baseline_jpeg_equals_the_file_source(spark, tmp_path, monkeypatch):
    """Bytes read what Spark's own reader has of the same files, to rounding; without an imaging library."""
    import builtins

    real = builtins.__import__

    def without(name, *rest):
        if name.startswith("PIL"):
            raise ImportError(name)
        return real(name, *rest)

    files = {}
    for size in ((1, 1), (8, 8), (17, 33), (48, 31)):
        for quality in (0.5, 0.95):
            files[f"{size[0]}x{size[1]}-{quality}.jpg"] = jpeg(spark, smooth(*size), quality)
    noise = np.random.default_rng(1).integers(0, 256, (20, 20, 1), dtype=np.uint8)
    files["grey.jpg"] = jpeg(spark, np.repeat(noise, 3, 2), 0.8, grey=True)
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = {r["origin"].rsplit("/", 1)[1]: r for r in images.image_files(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(builtins, "__import__", without)
    for name, data in files.items():
        r = read[name]
        theirs = images.pixels_of(r["height"], r["width"], r["nChannels"], bytes(r["data"])).astype(int)
        ours = images.decoded(data).astype(int)
        assert ours.shape == theirs.shape and np.abs(ours - theirs).max() <= 4 and np.abs(ours - theirs).mean() < 0.8, name
    whole = files["17x33-0.95.jpg"]
    assert images.decoded(jpeg(spark, smooth(16, 16), progressive=True)) is None
    assert images.decoded(whole[: len(whole) // 2]) is None and images.decoded(b"\xff\xd8\xff") is None and images.decoded(b"\xff\xd8" + bytes(50)) is None


def test_jpeg_with_restart_markers():
    """Each unit of a grey picture begins anew after its marker."""
    from glyphmill.sources.jpeg import jpeg_pixels

    def segment(kind, body):
        return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body

    levels = [3, 60, -50, 9]  # of the four blocks, in eighths of a step of 16
    # codes: sizes 0 to 11 have codes of four bits, the end of a block one bit
    head = segment(0xDB, b"\0" + bytes([16] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, 16, 16, 1) + b"\1\x11\0")
    head += segment(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0") + segment(0xDD, struct.pack(">H", 1))
    scan = b""
    for k, v in enumerate(levels):
        size = abs(v).bit_length()
        bits = f"{size:04b}" + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "") + "0"
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + k]) if k < 3 else b"\xff\xd9")
    pixels = jpeg_pixels(b"\xff\xd8" + head + segment(0xDA, b"\1\1\0\0\x3f\0") + scan)
    expected = [min(255, max(0, 128 + v * 16 / 8)) for v in levels]
    assert [int(pixels[y, x, 0]) for y in (0, 8) for x in (0, 8)] == expected and (pixels[:8, :8] == pixels[0, 0]).all()


def test_json_with_words_and_on_several_lines(spark, tmp_path):
    import json

    from glyphmill.sources import sinks

    frame = images.raw_images(spark, [(1, drawn(np.random.default_rng(1), 2)), (2, drawn(np.random.default_rng(2), 1))])
    seen = Recognition(config=Config(det=DetConfig(limit_type="max"), glob=GlobalConfig(text_score=0.1, return_word_box=True)))
    lines = ocr(frame, seen).where("error IS NULL")
    for pretty in (False, True):
        made = {r["image_id"]: r["value"] for r in sinks.as_json(lines, words=True, pretty=pretty).collect()}
        assert ("\n" in made[1]) == pretty
        rows = lines.where("image_id = 1").orderBy("box_id").collect()
        held = json.loads(made[1])
        assert held["txts"] == [r["text"] for r in rows] and [len(w) for w in held["word_results"]] == [len(r["word_results"]) for r in rows]
        first = rows[0]["word_results"][0]
        assert held["word_results"][0][0] == {"text": first["text"], "score": first["score"], "box": [{"x": first[f"x{n}"], "y": first[f"y{n}"]} for n in (1, 2, 3, 4)]}
    assert json.loads(sinks.as_json(lines).where("image_id = 2").first()["value"])["word_results"] == [[]]
    assert sinks.as_json(lines.limit(0)).count() == 0


@pytest.mark.parametrize(("shifted", "columns"), [(True, [0, 1]), (False, [1, 3])])
def test_classes_without_characters(spark, shifted, columns):
    """Steps 0 and 2 have a class that the dictionary lacks: A and B take the columns of the first two steps, or their own."""
    config = Config(glob=GlobalConfig(text_score=0.1, return_word_box=True, return_single_char_box=True), quirks=Quirks(shifted_columns=shifted))
    seen = Recognition(characters=("A", "B"), config=config)
    place = (1.0, 1.0, 0, 40, 80)
    row = (1, 0, 0.9, *[0.0, 0.0, 80.0, 0.0, 80.0, 40.0, 0.0, 40.0], place, None, [9, 1, 8, 2], [0.9] * 4, 2.0, 2.0)
    from glyphmill.plans.pipeline import STEPS

    found = lines_of(spark.createDataFrame([row], STEPS), seen).first()
    assert found["text"] == "AB"
    # a column is 20 wide; a word of two characters spreads over its columns
    wide = 20 * (columns[1] - columns[0])
    assert [(w["text"], w["x1"], w["x2"]) for w in found["word_results"]] == [(t, max(0.0, (c + 0.5) * 20 - wide / 2), min(80.0, (c + 0.5) * 20 + wide / 2)) for t, c in zip("AB", columns, strict=True)]


def test_scores_in_the_order_of_candidates():
    """The lower block is larger, so it is the first candidate; in reading order it is the second box."""
    probs = np.zeros((60, 60))
    probs[5:15, 5:25], probs[30:55, 5:55] = 0.6, 0.9
    det = DetConfig(use_dilation=False, box_thresh=0.1, thresh=0.5)
    own, listed = (Recognition(config=Config(det=det, quirks=Quirks(scores_by_box=v, raster_areas=False))).boxes(probs, 60, 60) for v in (True, False))
    assert [round(b["det_score"], 2) for b in own] == [0.6, 0.9] and [round(b["det_score"], 2) for b in listed] == [0.9, 0.6]
    assert [b["y1"] for b in own] == [b["y1"] for b in listed]
