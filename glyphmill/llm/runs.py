"""Periodic runs of words in texts, and texts less the repetitions of their runs.

A run is a stretch of consecutive words of smallest period q (words q apart are identical), of at least LEAST words and
two periods, that no neighbouring word extends. Documents of a batch stand in one array of word hashes, apart by
numbers that occur once. For each period p the grid has a point every max(p, LEAST - p) words: any stretch of matches
(words p apart that are equal) long enough for a run covers one. All (period, point) pairs where the words match go
into one binary search: how far the match extends to both sides (longest common extensions), by differences of prefix
hashes. What is long enough is a run of period p; of equal stretches the least period is kept, as a stretch of two
periods p or more has a smallest period that divides p. The words of each run are then compared themselves; a document
in which hashes agreed and words don't is searched again without hashes.

Pairs grow with n log n of a document's n words. They are searched in blocks of PAIRS, texts in groups of some
GROUP bytes (or a longer text alone), so memory depends on the longest text. Rows are independent: nothing shuffles.

Results in odd cases: null and empty texts, and texts of white space alone, have no words, no runs and an empty
collapsed text; rows that repeat are treated alike; empty tables give empty results; other columns pass through, the
new ones replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphmill.llm.shared import append_columns
from glyphmill.llm.words import _STEP, Words, powers

LEAST = 12
#: Pairs of a period and a grid point that are searched at once.
PAIRS = 1 << 18
#: Bytes of texts that are searched at once.
GROUP = 1 << 22

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


class Extensions:
    """How far two places of an array agree, by prefix hashes."""

    def __init__(self, values: np.ndarray):
        self.power = powers(_STEP, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:-1], out=self.sums[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` values from i and from j agree; i < j."""
        s = self.sums
        return (s[i + length] - s[i]) * self.power[j - i] == s[j + length] - s[j]

    def search(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The greatest length, up to most, to which values from i and j agree (back: those that end before i and j), of all pairs at once."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) >> 1
            shift = middle if back else 0
            same = self.equal(i[open_] - shift, j[open_] - shift, middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1
        return low


def grid_pairs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points whose word equals the one a period later, and the periods, in blocks. Documents stand by rising length."""
    points, periods, held = [], [], 0
    for p in range(1, int(counts[-1]) // 2 + 1 if len(counts) else 0):
        first = int(np.searchsorted(counts, max(LEAST, 2 * p)))
        if first == len(counts):
            break
        step, begin = max(p, LEAST - p), int(starts[first])
        right = values[begin + p :: step]
        hits = np.flatnonzero(values[begin::step][: len(right)] == right)
        if hits.size:
            points.append(begin + hits * step)
            periods.append(np.full(hits.size, p))
            held += hits.size
            if held >= PAIRS:
                yield np.concatenate(points), np.concatenate(periods)
                points, periods, held = [], [], 0
    if points:
        yield np.concatenate(points), np.concatenate(periods)


def least_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period, by start, then period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def hashed_runs(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs of documents in one array (starts, counts: of each, by rising length)."""
    reach = Extensions(values)
    found = [np.zeros(0, np.int64)] * 3
    for i, p in grid_pairs(values, starts, counts):
        of = np.searchsorted(starts, i, "right") - 1
        begin, end = starts[of], starts[of] + counts[of]
        half = (np.maximum(p, LEAST - p) + 1) // 2  # a stretch that is long enough has half its length on one side
        ahead = i + p + half <= end
        long = np.zeros(len(i), bool)
        long[ahead] = reach.equal(i[ahead], i[ahead] + p[ahead], half[ahead])
        behind = ~long & (i - half >= begin) & (i + p < end)
        long[behind] = reach.equal(i[behind] - half[behind], i[behind] + p[behind] - half[behind], half[behind])
        i, p, begin, end = i[long], p[long], begin[long], end[long]
        to, back = reach.search(i, i + p, end - i - p), reach.search(i, i + p, i - begin, back=True)
        enough = to + back >= np.maximum(p, LEAST - p)
        made = (i - back)[enough], (i + p + to)[enough], p[enough]
        found = least_periods(*(np.concatenate(c) for c in zip(found, made, strict=True)))
    return found


def plain_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Start, end and period of the runs of one document, by comparing words alone."""
    numbers = {w: n for n, w in enumerate(dict.fromkeys(words))}
    values, found = np.array([numbers[w] for w in words], np.int64), []
    for p in range(1, len(words) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.r_[False, values[:-p] == values[p:], False]))
        found += [(a, b + p, p) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= max(p, LEAST - p)]
    return list(zip(*(c.tolist() for c in least_periods(*np.array(found, np.int64).reshape(-1, 3).T)), strict=True))


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1 .. of each range, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def differing(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words numbered a and b differ in any byte."""
    size = words.ends[a] - words.starts[a]
    out = size != words.ends[b] - words.starts[b]
    for at in range(0, len(a), PAIRS):
        some = np.flatnonzero(~out[at : at + PAIRS]) + at
        other = words.bytes[ranges(words.starts[a[some]], size[some])] != words.bytes[ranges(words.starts[b[some]], size[some])]
        out[np.repeat(some, size[some])[other]] = True
    return out


def runs_of(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    words = Words(column)
    counts = words.counts
    order = np.argsort(counts, kind="stable")
    sizes = counts[order]
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    # each document's words, and a value of its own (small numbers, as no word's hash is) behind them
    number = np.full(int(sizes.sum()) + len(sizes), -1)
    inside = ranges(starts, sizes)
    number[inside] = ranges(words.first[:-1][order], sizes)
    values = np.zeros(len(number), np.uint64)
    values[inside] = words.hashes()[number[inside]]
    values[number < 0] = np.arange(len(sizes), dtype=np.uint64)
    start, end, period = hashed_runs(values, starts, sizes)
    left = ranges(start, end - start - period)
    wrong = differing(words, number[left], number[left + np.repeat(period, end - start - period)])
    if wrong.any():
        again = np.unique(np.searchsorted(starts, left[wrong], "right") - 1)
        keep = ~np.isin(np.searchsorted(starts, start, "right") - 1, again)
        found = [np.array([start[keep], end[keep], period[keep]])]
        for d in again.tolist():
            a, n = int(starts[d]), int(sizes[d])
            made = plain_runs([words.text_of(words.starts[w], words.ends[w]) for w in number[a : a + n].tolist()])
            found.append(np.array([(a + s, a + e, p) for s, e, p in made], np.int64).reshape(-1, 3).T)
        start, end, period = least_periods(*np.concatenate(found, 1))
    gone = np.zeros(len(number) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = number[(np.cumsum(gone[:-1]) == 0) & (number >= 0)]
    of = np.searchsorted(words.first, kept, "right") - 1  # documents without words start where the next one does
    last = np.r_[of[1:] != of[:-1], True][: len(of)]
    length = words.ends[kept] - words.starts[kept] + ~last
    source = ranges(words.starts[kept], length)
    text = words.bytes[np.minimum(source, max(0, len(words.bytes) - 1))]
    text[np.cumsum(length)[~last] - 1] = 32
    size = np.bincount(of, length, len(counts)).astype(np.int64)[order]
    collapsed = pa.StringArray.from_buffers(len(counts), pa.py_buffer(np.cumsum(np.r_[0, size]).astype(np.int32)), pa.py_buffer(text.tobytes()))
    doc = np.searchsorted(starts, start, "right") - 1
    listed = pa.StructArray.from_arrays([pa.array(c) for c in (start - starts[doc], end - start, period)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
    found = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32), listed)
    back = np.argsort(order)
    return pa.array(counts), found.take(pa.array(back)), collapsed.take(pa.array(back))


def groups(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of some GROUP bytes, or one longer text."""
    sizes = np.cumsum([0, *pc.fill_null(pc.binary_length(column), 0).to_pylist()])
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + GROUP, "right")) - 1)
        yield column.slice(a, b - a)
        a = b


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, runs (start, length, period; by start, then period) and collapsed: the words that are in no run after its first period, joined by spaces."""

    def kernel(column: pa.Array) -> list[pa.Array]:
        made = [runs_of(some) for some in groups(column)]
        empty = pa.array([], pa.int64()), pa.array([], pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN]))), pa.array([], pa.string())
        return [pa.concat_arrays(list(parts)) for parts in zip(*(made or [empty]), strict=True)]

    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return append_columns(df, [text], T.StructType(new), kernel)
