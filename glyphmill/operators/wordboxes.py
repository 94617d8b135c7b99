"""Words of recognised lines, and boxes of words or characters within them, from the steps that made their characters.

A step's column and the line's columns give where a character stands along the box; cells are rectangles in the
box's upright bounds, bent back into its quadrilateral. Lines of Latin words and digits alone have boxes of words,
all others (or all, if asked) boxes of characters. One Arrow function takes many lines at once, as flat arrays of
their characters with line numbers: nothing is exploded, grouped or joined, and it runs in streams as it stands.

Results in odd cases: null or empty texts, lines without columns and lines of white space alone have no boxes; characters
beyond a line's kept steps have no column and no cell; lines that repeat are treated alike, each from its own row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.batches import bounded_batches
from glyphmill.operators.decode import GAP, SPACE
from glyphmill.schemas import CORNERS

LINE = ["image_id", "box_id"]
LATIN, CJK = "EnNum", "Cn"
WORDS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("cols", T.ArrayType(T.IntegerType()))]))
RESULTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("score", *CORNERS))]))
NUMBERS = pa.struct([("text", pa.string()), ("score", pa.float64()), *((c, pa.float64()) for c in CORNERS)])


def _spaces() -> np.ndarray:
    found = re.compile(SPACE).match
    return np.array([c for c in range(0x3001) if found(chr(c))], np.uint32)


SPACES = _spaces()


def by_script(codes: np.ndarray) -> np.ndarray:
    """1 for characters of the CJK block, 0 for all others."""
    return ((codes >= 0x4E00) & (codes <= 0x9FFF)).astype(np.int8)


def by_letters(codes: np.ndarray) -> np.ndarray:
    """1 for the letters A to Z in either case, 0 for all others."""
    low = codes | 0x20
    return ((low >= 97) & (low <= 122) & (codes < 128)).astype(np.int8)


def line_columns(steps: Column, ratio: Column, max_ratio: Column) -> Column:
    """Columns that the line itself takes of its batch's padded width."""
    return F.when(max_ratio > 0, steps * ratio / max_ratio).otherwise(0.0)


def texts_of(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of runs of code points; ends: of each run."""
    size = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.r_[0, np.cumsum(size)][np.r_[0, ends]].astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(at), pa.py_buffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode()))


class Lines:
    """The characters of many lines that are no white space, and their words.

    line, code, kind and col (-1 for none) of each character; first: of each word, its first character. A word ends at
    white space, where the kind changes, or where more than GAP columns lie between a character and the one before.
    """

    def __init__(self, text: pa.Array, cols: pa.ListArray, kinds: Callable[[np.ndarray], np.ndarray]):
        self.n = len(text)
        text = pc.fill_null(text, "")
        sizes = pc.utf8_length(text).to_numpy()
        codes = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), "<u4")
        line = np.repeat(np.arange(self.n), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        starts, held = list_spans(cols)
        known = place < held[line]
        col = np.full(len(codes), -1, np.int64)
        col[known] = cols.values.to_numpy(zero_copy_only=False)[(starts[line] + place)[known]]
        space = np.isin(codes, SPACES)
        before = np.r_[False, line[1:] == line[:-1]][: len(line)]  # has a character before it
        previous = np.roll(col, 1)
        apart = before & (col >= 0) & (previous >= 0) & (col - previous > GAP) | before & np.roll(space, 1)
        keep = ~space
        self.line, self.code, self.col, apart = line[keep], codes[keep], col[keep], apart[keep]
        self.kind = kinds(self.code)
        new = np.r_[True, (self.line[1:] != self.line[:-1]) | (self.kind[1:] != self.kind[:-1])][: len(self.line)]
        self.first = np.flatnonzero(new | apart)
        self.word = np.cumsum(new | apart) - 1
        self.word_line, self.ends = self.line[self.first], np.r_[self.first[1:], len(self.line)][: len(self.first)]

    def words(self) -> pa.Array:
        """Text of each word."""
        return texts_of(self.code, self.ends)

    def per_line(self, lines: np.ndarray) -> np.ndarray:
        """Offsets of rows (their lines, in order) by line."""
        return np.searchsorted(lines, np.arange(self.n + 1)).astype(np.int32)


def list_spans(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list starts in the values, and its length; null lists are empty."""
    offsets = lists.offsets.to_numpy()
    return offsets[:-1].astype(np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def segmenter(kinds: Callable[[np.ndarray], np.ndarray], names: tuple[str, str]):
    @F.arrow_udf(WORDS)
    def words(text: pa.Array, cols: pa.Array) -> pa.Array:
        found = Lines(text, cols, kinds)
        has = found.col >= 0
        at = np.r_[0, np.cumsum(has)][np.r_[0, found.ends]].astype(np.int32)
        kind = pa.array(names, pa.string()).take(pa.array(found.kind[found.first]))
        parts = [found.words(), kind, pa.ListArray.from_arrays(at, pa.array(found.col[has].astype(np.int32)))]
        return pa.ListArray.from_arrays(found.per_line(found.word_line), pa.StructArray.from_arrays(parts, ["text", "kind", "cols"]))

    return words


#: Words of lines (text, columns of its characters) as structs of text, kind and columns.
script_words = segmenter(by_script, (LATIN, CJK))
letter_words = segmenter(by_letters, ("other", "letter"))


def _means(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Mean of values by group, NaN for none."""
    count = np.bincount(groups, minlength=n)
    return np.divide(np.bincount(groups, values, n), count, out=np.full(n, np.nan), where=count > 0)


def _boxes(single: bool, own: bool, text: pa.Array, kept: pa.Array, line_cols: np.ndarray, corner: dict[str, np.ndarray]) -> pa.Array:
    cols = pa.ListArray.from_arrays(kept.offsets, kept.values.field("col"))
    starts, held = list_spans(kept)
    line_cols = np.where(np.isnan(line_cols), 0.0, line_cols)
    found = Lines(pc.if_else(pa.array(line_cols > 0), text, pa.scalar("", pa.string())), cols, by_script)
    xs, ys = (np.array([corner[f"{axis}{k}"] for k in (1, 2, 3, 4)]) for axis in "xy")
    left, right, top, bottom = xs.min(0), xs.max(0), ys.min(0), ys.max(0)
    step = (right - left) / np.maximum(line_cols, 1e-6)
    # words of one column tell no width; a word without any counts as one column wide
    has = found.col >= 0
    size = np.bincount(found.word[has], minlength=len(found.first))
    low, high = np.full(len(size), np.iinfo(np.int64).max), np.full(len(size), -1)
    np.minimum.at(low, found.word[has], found.col[has])
    np.maximum.at(high, found.word[has], found.col[has])
    spread = size != 1
    width = np.where(size > 1, (high - low) / np.maximum(size - 1, 1), 1.0) * step[found.word_line]
    width = _means(width[spread], found.word_line[spread], found.n)
    chars = pc.fill_null(pc.utf8_length(text), 0).to_numpy()
    width = np.where(np.isnan(width), np.divide(right - left, chars, out=np.zeros(found.n), where=chars > 0), width)

    latin = np.ones(found.n, bool)
    latin[found.line[found.kind == 1]] = False
    by_word = latin & (not single)
    # cells (line, first and last column) in order; contents (line, text) of their own number
    whole, each = by_word[found.word_line] & (size > 0), ~by_word[found.line] & has
    cell_line = np.r_[found.word_line[whole], found.line[each]]
    a, b = np.r_[low[whole], found.col[each]], np.r_[high[whole], found.col[each]]
    order = np.lexsort((a, cell_line))
    cell_line, a, b = cell_line[order], a[order], b[order]
    word_in, char_in = by_word[found.word_line], ~by_word[found.line]
    content_line = np.r_[found.word_line[word_in], found.line[char_in]]
    words = found.words().filter(pa.array(word_in))
    content = pa.concat_arrays([words, texts_of(found.code[char_in], np.arange(1, int(char_in.sum()) + 1))])
    order = np.argsort(content_line, kind="stable")
    content_at = found.per_line(content_line[order])
    nth = np.arange(len(cell_line)) - found.per_line(cell_line)[:-1][cell_line]
    paired = (nth < np.diff(content_at)[cell_line]) & (nth < np.maximum(held, 1)[cell_line])
    k, nth, a, b = cell_line[paired], nth[paired], a[paired], b[paired]

    probs = np.r_[kept.values.field("prob").to_numpy(zero_copy_only=False).astype(float), 0.0]
    step_line = np.repeat(np.arange(found.n), held)
    steps = np.arange(len(step_line)) + np.repeat(starts - (np.cumsum(held) - held), held)
    score = probs[np.where(held[k] > 0, starts[k] + nth, -1)] if own else np.nan_to_num(_means(probs[steps], step_line, found.n))[k]
    reach, across = (right - left)[k], np.maximum(right - left, 1e-6)[k]
    u = [np.maximum((a + 0.5) * step[k] - width[k] / 2, 0.0) / across, np.minimum((b + 0.5) * step[k] + width[k] / 2, reach) / across]
    tall = np.maximum(bottom - top, 1e-6)[k]
    v = [np.zeros(len(k)), (bottom - top)[k] / tall]
    made = {}
    for n, (s, t) in enumerate(((u[0], v[0]), (u[1], v[0]), (u[1], v[1]), (u[0], v[1])), 1):
        for axis, c in (("x", xs), ("y", ys)):
            upper, lower = (c[i][k] + (c[j] - c[i])[k] * s for i, j in ((0, 1), (3, 2)))
            made[f"{axis}{n}"] = upper + (lower - upper) * t
    texts = content.take(pa.array(order[content_at[:-1][k] + nth]))
    listed = pa.StructArray.from_arrays([texts, pa.array(score), *(pa.array(made[c]) for c in CORNERS)], fields=list(NUMBERS))
    return pa.ListArray.from_arrays(found.per_line(k), listed)


def word_results(lines: DataFrame, single: bool = False, token_confidences: bool = True) -> DataFrame:
    """lines with word_results: an array of (text, score, corners) for each line, empty where it has no text or columns.

    lines: text, kept (steps with col, token, prob), line_cols and corners. Words are boxed where all of a line's are
    Latin and single isn't asked, else characters. Contents, cells and scores pair up to the shortest of the three.
    token_confidences: the score of the n-th content is that of the n-th kept step; else the mean of all.
    """

    @F.arrow_udf(RESULTS)
    def boxes(text: pa.Array, kept: pa.Array, line_cols: pa.Array, corner: pa.Array) -> pa.Array:
        corners = {c: pc.fill_null(corner.field(n), 0.0).to_numpy() for n, c in enumerate(CORNERS)}
        return _boxes(single, token_confidences, text, kept, line_cols.to_numpy(zero_copy_only=False).astype(float), corners)

    bounded_batches(lines.sparkSession)
    given = F.struct(*(F.col(c).cast("double").alias(c) for c in CORNERS))
    return lines.withColumn("word_results", boxes(F.col("text"), F.col("kept"), F.col("line_cols").cast("double"), given))


def word_boxes(lines: DataFrame) -> DataFrame:
    """A row for each box of word_results: image_id, box_id, word_id, text, score and corners."""
    return lines.select(*LINE, F.posexplode("word_results").alias("word_id", "w")).select(*LINE, "word_id", "w.*")
