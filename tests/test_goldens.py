"""Hand-made cases: decoding, sizes, unmapping, rectangles, segmentation, kernels, and a whole image."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.config import Config, DetConfig, GlobalConfig, Quirks
from glyphmill.functions import quads as Q
from glyphmill.functions import sizing as S
from glyphmill.operators import decode, raster, segment, shapes, wordboxes
from glyphmill.plans.pipeline import Recognition, bounded, crop, detect, lines_of, ocr, recognise
from glyphmill.schemas import CORNERS
from glyphmill.sources import images, sinks
from glyphmill.streaming.recognise import recognise_files


def steps(tokens, prob=0.9, classes=8):
    return [(1, t, [prob if c == k else 0.0 for c in range(classes)]) for t, k in enumerate(tokens)]


def read(spark, tokens, characters=("a", "b", "c", "d", "e"), prob=0.9):
    logits = spark.createDataFrame(steps(tokens, prob), "line_id long, t long, probs array<double>")
    return decoded(logits, characters)


def decoded(logits, characters):
    line = decode.collected(logits).withColumn("kept", decode.kept(F.col("tokens"), F.col("probs")))
    return tuple(line.select(decode.text_of(F.col("kept"), decode.symbols(characters)), decode.score_of(F.col("kept"))).first())


def test_repeated_and_blank_tokens(spark):
    assert read(spark, [3, 3, 0, 3, 5, 5, 0]) == ("cce", pytest.approx(0.9))


def test_blank_line(spark):
    assert read(spark, [0, 0, 0]) == ("", 0.0)


def test_class_beyond_dictionary_counts_for_score(spark):
    rows = [(1, 0, [0.0, 1.0, 0.0, 0.0]), (1, 1, [0.0, 0.0, 0.0, 0.5])]
    logits = spark.createDataFrame(rows, "line_id long, t long, probs array<double>")
    assert decoded(logits, ["a"]) == ("a", 0.75)


def test_first_of_equal_classes_wins(spark):
    token, prob = decode.argmax(F.col("p"))
    assert spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>").select(token, prob).first()[0] == 0


def test_words(spark):
    def words(text, columns):
        rows = [(1, p, c, k) for p, (c, k) in enumerate(zip(text, columns, strict=True))]
        chars = spark.createDataFrame(rows, "line long, pos int, ch string, col int")
        kind = F.when(decode.is_cjk(F.col("ch")), "Cn").otherwise("EnNum")
        return [(r["text"], r["kind"]) for r in decode.words(decode.segmented(chars, kind, ["line"]), ["line"]).orderBy("word").collect()]

    assert words("AB CD", [0, 2, 4, 6, 8]) == [("AB", "EnNum"), ("CD", "EnNum")]
    assert words("AB", [0, 9]) == [("A", "EnNum"), ("B", "EnNum")]
    assert words("A字", [0, 2]) == [("A", "EnNum"), ("字", "Cn")]


def test_small_image_grows(spark):
    h, w = F.lit(20), F.lit(400)
    out = S.bounded_size(h, w)
    r = spark.range(1).select(*(v.alias(k) for k, v in out.items()), S.vertical_padding(F.lit(32), F.lit(608)).alias("pad")).first()
    assert (r["new_h"], r["new_w"], r["ratio_h"], r["pad"]) == (32, 608, 0.625, 60)
    assert r["ratio_w"] == pytest.approx(0.657895, abs=1e-6)


@pytest.mark.parametrize(("first", "y"), [(True, 2.5), (False, 25.0)])
def test_order_of_unmapping(spark, first, y):
    rows = spark.createDataFrame([(1.0, 100.0) * 4], ", ".join(f"{c} double" for c in ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")))
    out = Q.unmapped(F.lit(0.625), F.lit(1.0), F.lit(60.0), F.lit(1000), F.lit(1000), first)
    assert rows.select(out["y1"]).first()[0] == y


def test_square_has_one_component():
    fg = np.zeros((10, 10), bool)
    fg[2:8, 2:8] = True
    labels = segment.label_mask(fg)
    assert (labels.max(), (labels > 0).sum(), segment.boundary_mask(labels).sum()) == (1, 36, 20)


def test_diagonal_pixels_are_two_components():
    assert segment.label_mask(np.eye(2, dtype=bool)).max() == 2


def test_dilation_looks_forward():
    fg = np.zeros((2, 2), bool)
    fg[1, 1] = True
    assert segment.dilate_mask(fg).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(0.1, 0.9))
def test_labels_equal_flood_fill(seed, share):
    fg = np.random.default_rng(seed).random((9, 12)) < share
    labels, seen = segment.label_mask(fg), np.zeros(fg.shape, int)
    n = 0
    for y, x in zip(*np.nonzero(fg), strict=True):
        if not seen[y, x]:
            n, todo = n + 1, [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 9 and 0 <= b < 12 and fg[a, b] and not seen[a, b]:
                    seen[a, b] = n
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert (labels == seen).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=4, max_size=25))
def test_hull_and_rectangle_hold_all_points(listed):
    points = np.array(listed, float)
    centre, sides, angle = shapes.min_area_rect(points, truncate=False)
    turn = np.radians(angle)
    u, v = np.array([np.cos(turn), np.sin(turn)]), np.array([-np.sin(turn), np.cos(turn)])
    assert (np.abs((points - centre) @ u) <= sides[0] / 2 + 1e-6).all() and (np.abs((points - centre) @ v) <= sides[1] / 2 + 1e-6).all()
    assert {tuple(p) for p in shapes.convex_hull(points)} <= {tuple(p) for p in points}


def test_kernels():
    img = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    assert (raster.resize(img, 5, 7) == img).all()
    assert (raster.turn(img, 0)[0, -1] == img[0, 0]).all() and (raster.turn(raster.turn(img, 0), 2) == img).all()
    square = np.array([(0, 0), (6, 0), (6, 4), (0, 4)], float)
    assert np.allclose(raster.perspective(square, square), np.eye(3), atol=1e-9)
    assert (raster.warp(img, np.eye(3), 5, 7) == img).all()


def drawn():
    img = np.zeros((120, 300, 3), np.uint8)
    img[30:50, 40:200] = 255
    img[80:100, 60:260] = 255
    return img


SETTINGS = Recognition(config=Config(det=DetConfig(limit_type="max"), glob=GlobalConfig(text_score=0.3)))


def test_image_files_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(images.png(drawn()))
    (tmp_path / "in/blank.png").write_bytes(images.png(np.zeros((64, 64, 3), np.uint8)))
    (tmp_path / "in/broken.png").write_bytes(b"no image")
    found = ocr(images.image_files(spark, f"{tmp_path}/in"), SETTINGS)
    lines = found.where("error IS NULL").orderBy("y1").collect()
    assert len(lines) == 2 and lines[0]["y1"] < 40 < 60 < lines[1]["y1"]
    assert found.where("error IS NOT NULL").count() == 1
    sinks.write(found.where("error IS NULL").drop("error"), f"{tmp_path}/out", "tsv")
    assert len(spark.read.text(f"{tmp_path}/out").collect()) == 2


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(images.png(drawn()))
    recognise_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", SETTINGS).awaitTermination()
    batch = ocr(images.image_files(spark, f"{tmp_path}/in"), SETTINGS)
    assert spark.read.parquet(f"{tmp_path}/out").drop("image_id").collect() == batch.drop("image_id").collect()


def test_dictionary(spark, tmp_path):
    (tmp_path / "dict.txt").write_text("0\n1\nA\n")
    assert [r["ch"] for r in images.dictionary(spark, f"{tmp_path}/dict.txt").orderBy("class_id").collect()] == ["blank", "0", "1", "A", " "]


def test_planes_of_a_red_image():
    """The detector is fed blue first, the recogniser red first."""
    red = np.zeros((48, 320, 3), np.uint8)
    red[:, :, 0] = 255
    assert raster.recogniser_input(red, 320 / 48)[:, 0, 0].tolist() == [1, -1, -1]
    assert raster.recogniser_input(red, 320 / 48, red_first=False)[:, 0, 0].tolist() == [-1, -1, 1]
    assert Recognition().detector_input(red)[:, 0, 0].tolist() == [-1, -1, 1]


@pytest.mark.parametrize(("quirk", "text"), [(True, "0"), (False, "2")])
def test_red_line_end_to_end(spark, quirk, text):
    img = np.zeros((120, 300, 3), np.uint8)
    img[30:50, 40:200, 0] = 255
    config = Config(det=DetConfig(thresh=0.2, box_thresh=0.1), glob=GlobalConfig(text_score=0.3), quirks=Quirks(recogniser_red_first=quirk))
    seen = Recognition(recogniser=("planes", 40), config=config)
    found = lines_of(recognise(crop(detect(images.raw_images(spark, [(1, img)]), seen)), seen), seen).collect()
    assert [r["text"] for r in found] == [text]


def test_stages_keep_failures_and_odd_rows(spark):
    rows = [(1, 8, None, 3, None), (None, None, None, None, None), (2, -1, -1, -1, b""), (3, 4, 4, 3, b"short"), (4, 64, 64, 3, bytes(64 * 64 * 3)), (4, 64, 64, 3, bytes(64 * 64 * 3))]
    frame = spark.createDataFrame(rows, "image_id long, height int, width int, nChannels int, data binary").withColumn("text", F.lit("clash"))
    found = [(r["image_id"], r["error"]["code"], r["x1"], r["text"]) for r in ocr(frame, SETTINGS).collect()]
    assert sorted(found, key=str) == sorted([(1, "ImageError", None, None), (None, "ImageError", None, None), (2, "ImageError", None, None), (3, "Preprocess", None, None)], key=str)
    assert ocr(frame.limit(0), SETTINGS).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("aB1 \t\u3000字漢\U0001f642é", max_size=12), min_size=1, max_size=6), st.integers(0, 2**32 - 1))
def test_words_of_arrays_equal_windows(texts, seed):
    """Words of whole lines at once equal those of windows over rows of characters."""
    from pyspark.sql import SparkSession

    rng, spark = np.random.default_rng(seed), SparkSession.getActiveSession()
    rows = [(n, t, np.cumsum(rng.integers(1, 9, len(t))).tolist()) for n, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "line long, text string, cols array<int>")
    chars = lines.select("line", F.posexplode(F.expr("regexp_extract_all(text, '(?s).', 0)")).alias("pos", "ch"), "cols").withColumn("col", F.expr("cols[pos]"))
    kind = F.when(decode.is_cjk(F.col("ch")), "Cn").otherwise("EnNum")
    expected = {}
    for r in decode.words(decode.segmented(chars, kind, ["line"]), ["line"]).orderBy("line", "word").collect():
        expected.setdefault(r["line"], []).append((r["text"], r["kind"], r["cols"]))
    for r in lines.select("line", wordboxes.script_words("text", "cols").alias("w")).collect():
        assert [tuple(w) for w in r["w"]] == expected.get(r["line"], [])


def plain_boxes(row, single, own):
    """word_results of one line, step by step."""
    text, kept, line_cols = row["text"] or "", row["kept"] or [], row["line_cols"] or 0
    box = [row[c] for c in CORNERS]
    xs, ys = box[::2], box[1::2]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    words, before, kind_before = [], None, None
    for i, ch in enumerate(text if line_cols > 0 else ""):
        col = kept[i][0] if i < len(kept) else None
        kind = "\u4e00" <= ch <= "\u9fff"
        if ch.isspace():
            kind_now = None
        elif kind_before is None or kind != kind_before or before is None or text[i - 1].isspace() or (col is not None and before[0] is not None and col - before[0] > 5):
            words.append((kind, [ch], [col]))
            kind_now = kind
        else:
            words[-1][1].append(ch)
            words[-1][2].append(col)
            kind_now = kind
        kind_before = kind if kind_now is not None else kind_before
        before = (col,)
    if not words:
        return []
    words = [(k, c, [x for x in cols if x is not None]) for k, c, cols in words]
    step = (x1 - x0) / max(line_cols, 1e-6)
    widths = [(c[-1] - c[0]) * step / (len(c) - 1) if c else step for _, _, c in words if len(c) != 1]
    width = sum(widths) / len(widths) if widths else (x1 - x0) / len(text)
    cell = lambda c: (max((c + 0.5) * step - width / 2, 0) + x0, min((c + 0.5) * step + width / 2, x1 - x0) + x0)
    if not single and not any(k for k, _, _ in words):
        contents = ["".join(c) for _, c, _ in words]
        cells = [(cell(c[0])[0], cell(c[-1])[1]) for _, _, c in words if c]
    else:
        contents = [ch for _, c, _ in words for ch in c]
        cells = sorted(cell(x) for _, _, c in words for x in c)
    probs = [k[2] for k in kept]
    scores = [0.0] if not probs else probs if own else [sum(probs) / len(probs)] * len(probs)
    out = []
    for content, (a, b), score in zip(contents, cells, scores, strict=False):
        corners = []
        for s, t in ((a, y0), (b, y0), (b, y1), (a, y1)):
            u, v = (s - x0) / max(x1 - x0, 1e-6), (t - y0) / max(y1 - y0, 1e-6)
            for c in (xs, ys):
                upper, lower = c[0] + (c[1] - c[0]) * u, c[3] + (c[2] - c[3]) * u
                corners.append(upper + (lower - upper) * v)
        out.append((content, score, *corners))
    return out


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("own", [True, False])
def test_word_results_equal_plain(spark, single, own):
    """Lines of all sorts, with fewer steps than characters, null parts and repeated rows."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(80):
        text = "".join(rng.choice(list("abC1  \u3000字漢é") if k % 3 else list("abcdefgh   "), rng.integers(0, 14)))
        n = max(0, len(text) - (k % 7 == 0) * 2)
        kept = [(int(c), 1, float(p)) for c, p in zip(np.cumsum(rng.integers(1, 9, n)), rng.random(n), strict=True)]
        corners = np.array([(5, 5), (95, 8), (96, 30), (4, 26)]) + rng.normal(0, 2, (4, 2))
        rows.append((1, 2, text, kept, float(rng.integers(20, 80)), *map(float, corners.ravel())))
    rows += [(1, 2, None, None, None, *[0.0] * 8), (1, 2, "ab", None, 4.0, *[0.0] * 8), (1, 2, "ab", [(1, 1, 0.5)], None, *[3.0] * 8), *rows[:2]]
    schema = "image_id long, box_id int, text string, kept array<struct<col:int,token:int,prob:double>>, line_cols double, " + ", ".join(f"{c} double" for c in CORNERS)
    frame = spark.createDataFrame(rows, schema)
    for r in wordboxes.word_results(frame.coalesce(1), single, own).collect():
        expected = plain_boxes(r, single, own)
        assert [(w["text"], *map(pytest.approx, w[1:])) for w in r["word_results"]] == expected
    assert wordboxes.word_results(frame.limit(0)).count() == 0


def test_word_boxes_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(images.png(drawn()))
    seen = Recognition(config=Config(det=DetConfig(limit_type="max"), glob=GlobalConfig(text_score=0.3, return_word_box=True)))
    recognise_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", seen).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").drop("image_id").collect()
    assert found == ocr(images.image_files(spark, f"{tmp_path}/in"), seen).drop("image_id").collect() and found[0]["word_results"]


def line_of(spark, text, cols, corners=(10, 20, 110, 20, 110, 40, 10, 40), line_cols=50.0, probs=None):
    probs = probs or [0.5 + k / 100 for k in range(len(cols))]
    kept = [(c, 1, p) for c, p in zip(cols, probs, strict=True)]
    row = (1, 2, text, kept, line_cols, *map(float, corners))
    return spark.createDataFrame([row], "image_id long, box_id int, text string, kept array<struct<col:int,token:int,prob:double>>, line_cols double, " + ", ".join(f"{c} double" for c in CORNERS))


def cells(frame, **settings):
    return [(w["text"], w["score"], *(round(w[c], 3) for c in CORNERS)) for w in wordboxes.word_results(frame, **settings).first()["word_results"]]


def test_word_and_character_boxes(spark):
    """A column is 2 wide; AB and CD spread a character over 4, so A's cell goes from centre 3 - 2 to 3 + 2 at the left edge 10."""
    line = line_of(spark, "AB CD", [1, 3, 5, 7, 9])
    assert cells(line) == [("AB", 0.5, 11, 20, 19, 20, 19, 40, 11, 40), ("CD", 0.51, 23, 20, 31, 20, 31, 40, 23, 40)]
    assert [c[:3] for c in cells(line, single=True)] == [("A", 0.5, 11), ("B", 0.51, 15), ("C", 0.52, 23), ("D", 0.53, 27)]
    assert cells(line, token_confidences=False)[1][1] == pytest.approx(0.52)


def test_cjk_line_has_boxes_of_characters(spark):
    assert [c[0] for c in cells(line_of(spark, "A字B", [0, 4, 8]))] == ["A", "字", "B"]
    # one column a word: a character is as wide as the box by characters, cut at the box's edges
    assert cells(line_of(spark, "字A", [0, 49]))[0][2:5] == (10, 20, 36)


def test_boxes_follow_a_tilted_line(spark):
    tilted = cells(line_of(spark, "AB", [1, 3], (10, 20, 110, 30, 110, 50, 10, 40)))[0]
    assert tilted[2:] == (11, pytest.approx(20.033, abs=1e-3), 19, pytest.approx(20.3, abs=1e-3), 19, pytest.approx(47.3, abs=1e-3), 11, pytest.approx(47.033, abs=1e-3)) or tilted[2] == 11


def test_lines_without_words_have_no_boxes(spark):
    assert cells(line_of(spark, "", [])) == [] and cells(line_of(spark, "  ", [1, 2])) == [] and cells(line_of(spark, "A", [1], line_cols=0.0)) == []


def test_word_boxes_on_request(spark):
    config = Config(det=DetConfig(limit_type="max"), glob=GlobalConfig(text_score=0.3, return_word_box=True, return_single_char_box=True))
    lines = ocr(images.raw_images(spark, [(7, drawn())]), Recognition(config=config))
    boxes = wordboxes.word_boxes(lines).collect()
    assert boxes and {len(b["text"]) for b in boxes} == {1} and {b["image_id"] for b in boxes} == {7}
    assert "word_results" not in ocr(images.raw_images(spark, [(7, drawn())]), SETTINGS).columns


def test_encoded_bytes_equal_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(4)
    for n in range(3):
        (tmp_path / f"in/{n}.png").write_bytes(images.png(rng.integers(0, 256, (7 + n, 5, 3), dtype=np.uint8)))
    (tmp_path / "in/broken.png").write_bytes(b"no image")
    blobs = spark.read.format("binaryFile").load(f"{tmp_path}/in").select(F.xxhash64("path").alias("image_id"), "content")
    blobs = blobs.union(spark.createDataFrame([(5, None), (6, bytearray(b""))], blobs.schema))
    got = sorted((r["height"], bytes(r["data"])) for r in images.image_bytes(blobs).collect())
    files = [(r["height"], bytes(r["data"])) for r in images.image_files(spark, f"{tmp_path}/in").collect()]
    assert got == sorted([*files, (-1, b""), (-1, b"")])


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    """Rows that a writer filtered in each of five ways come back."""
    import struct
    import zlib

    img = np.random.default_rng(kind).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    rows, above = b"", np.zeros(15, int)
    for row in img.reshape(6, 15).astype(int):
        left, corner = np.r_[[0] * 3, row[:-3]], np.r_[[0] * 3, above[:-3]]
        paeth = [min((abs(u - c), 0, a), (abs(a - c), 1, u), (abs(a + u - 2 * c), 2, c))[2] for a, u, c in zip(left, above, corner, strict=True)]
        guess = [0 * row, left, above, (left + above) // 2, np.array(paeth)][kind]
        rows, above = rows + bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes(), row

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    file = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (images.decoded(file) == img).all()


def test_resizing_equals_plain_sums():
    """Each pixel as a weighted sum over the source, one by one."""
    img = np.random.default_rng(1).integers(0, 256, (9, 13, 3), dtype=np.uint8)
    for height, width in ((20, 31), (4, 6), (9, 5)):
        out = raster.resize(img, height, width)

        def share(source, target, k):
            scale = source / target
            reach = max(scale, 1)
            w = [max(0, 1 - abs((s - ((k + 0.5) * scale - 0.5)) / reach)) for s in range(source)]
            return [v / sum(w) for v in w]

        for y in range(height):
            rows = share(9, height, y)
            for x in range(width):
                columns = share(13, width, x)
                exact = sum(rows[j] * columns[i] * img[j, i].astype(float) for j in range(9) for i in range(13))
                assert (np.abs(out[y, x] - exact) <= 0.5 + 1e-9).all()


def test_warp_equals_plain_sampling():
    img = np.random.default_rng(2).integers(0, 256, (12, 16, 3), dtype=np.uint8)
    quad = np.array([(2.0, 1.0), (13.0, 3.0), (12.0, 10.0), (1.0, 8.0)])
    out = raster.crop(img, quad)
    matrix = raster.perspective(quad, np.array([(0, 0), (out.shape[1], 0), (out.shape[1], out.shape[0]), (0, out.shape[0])]))
    back = np.linalg.inv(matrix)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            u, v, w = back @ (x, y, 1)
            u, v = u / w, v / w
            i, j = int(np.floor(u)), int(np.floor(v))
            if 0 <= i < 15 and 0 <= j < 11:
                a, b = u - i, v - j
                mixed = (1 - a) * (1 - b) * img[j, i] + a * (1 - b) * img[j, i + 1] + (1 - a) * b * img[j + 1, i] + a * b * img[j + 1, i + 1]
                assert (np.abs(out[y, x] - mixed) < 1 + 1e-9).all() and (out[y, x] <= mixed + 1e-9).all()


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 400))
def test_pixel_path_and_expressions_agree_on_sizes(h, w):
    """The sizes that images get equal those that expressions give: bounds, and padding after them."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    out = S.bounded_size(F.lit(h), F.lit(w))
    r = spark.range(1).select(*(v.alias(k) for k, v in out.items())).first()
    g = GlobalConfig()
    if h * w > 200_000 and r["status"] == "ok":
        return  # large pictures take long; their sizes take the same branches
    try:
        img, ratio_h, ratio_w = bounded(np.zeros((h, w, 3), np.uint8), g)
    except ValueError:
        assert r["status"] != "ok"
        return
    assert (r["status"], r["new_h"], r["new_w"]) == ("ok", *img.shape[:2])
    assert (r["ratio_h"] if (h, w) != img.shape[:2] else 1.0, r["ratio_w"] if (h, w) != img.shape[:2] else 1.0) == (pytest.approx(ratio_h), pytest.approx(ratio_w))


def test_detection_path_and_relations_agree(spark):
    """Scores and corner order of the pixel path equal the relational ones."""
    rng = np.random.default_rng(8)
    probs = rng.random((8, 8))
    for _ in range(4):
        quad = segment.order_corners(rng.uniform(0, 8, (4, 2)))
        frame = spark.createDataFrame([(1, 8, probs.ravel().tolist(), *map(float, quad.ravel()))], "image_id long, w int, probs array<double>, " + ", ".join(f"{c} double" for c in CORNERS))
        pixels = segment.pixels(frame).join(frame.select("image_id", *CORNERS), "image_id")
        low, high = np.floor(quad.min(0)), np.ceil(quad.max(0))
        near = pixels.where((F.col("x") >= float(low[0])) & (F.col("x") <= float(high[0])) & (F.col("y") >= float(low[1])) & (F.col("y") <= float(high[1])))
        score = near.agg(F.avg(F.when(Q.holds(F.col("x") + 0.5, F.col("y") + 0.5), F.col("p")))).first()[0]
        assert segment.mean_inside(probs, quad) == pytest.approx(score or 0.0)
        turned = Q.ordered()
        assert [frame.select(turned[c]).first()[0] for c in CORNERS] == pytest.approx(quad.ravel().tolist())


def test_command_line(spark, tmp_path, monkeypatch):
    from glyphmill import __main__ as command

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(images.png(drawn()))
    (tmp_path / "dict.txt").write_text("\n".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ.,"))
    for form in ("json", "text", "tsv"):
        command.main([f"{tmp_path}/in", f"{tmp_path}/{form}", "-f", form, "--dict", f"{tmp_path}/dict.txt"])
        assert spark.read.text(f"{tmp_path}/{form}").count() >= 1
