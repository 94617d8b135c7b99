"""Removal of passages that repeat across documents, by exact grouping behind a count-min prefilter.

A window is `size` consecutive words of a document. Pass 1: every partition sketches, for each of its
documents, the anchors of its windows (the least hash of an eight-word run in a window, so that equal windows
have equal anchors and neighbouring windows mostly share one); the partitions' sketches merge cell by
cell, counting to two. The merged sketch never underestimates in how many documents a window's anchor
stands, and so never how many hold the window. Pass 2 hashes the windows whose anchor is estimated in two or
more documents, and groups exactly these. Windows in one document alone that pass by chance fall out
there, so nothing is lost and nothing is removed in error.

The sketch grows with the text up to 2^max_bits cells a row (two rows, one bit a cell once merged): a worker gets at
most 128 MB of it, and sends what it sketches itself in runs of some CELLS cells. Beyond what the sketch can tell apart
the filter passes more windows; results stay.

Results in odd cases: null or empty texts, and texts with fewer words than a window, lose nothing (a null
text stays null); a window that repeats within one document only stays; rows that share a key are parts of
one document for ownership; a null key owns nothing and loses nothing; empty tables give empty results;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.shared import append_columns, fresh, release, small_batches, stored
from glyphmill.llm.words import Words, grams, mix

WINDOW = 50
#: Words in the runs whose least hash anchors a window.
RUN = 8
MIN_BITS, MAX_BITS = 16, 29
#: Windows of a partition that are compared with each other before any are sent.
HELD = 1 << 20
#: Cells that a task sketches before it sends them on.
CELLS = 1 << 21
#: Cells (a power of two) of one row of the sketch that are merged in one group.
SHARD = 16


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Least of each run of span values, by doubling."""
    have, low = 1, values
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return low


class Windows:
    """Windows of a text column: position of each in the column's words, its text, its anchor."""

    def __init__(self, words: Words, size: int):
        self.hashes = words.hashes()
        n = max(0, len(self.hashes) - size + 1)
        text = np.repeat(np.arange(len(words.counts)), words.counts)
        self.at = np.flatnonzero(text[:n] == text[size - 1 :]) if n else np.zeros(0, np.int64)
        self.text = text[self.at]
        run = min(RUN, size)
        self.anchor = sliding_min(grams(self.hashes, run), size - run + 1)[self.at] if n else np.zeros(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """Each text's distinct anchors."""
        if not len(self.at):
            return self.anchor
        new = np.r_[True, (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])]
        anchor, text = self.anchor[new], self.text[new]
        order = np.lexsort((anchor, text))
        anchor, text = anchor[order], text[order]
        return anchor[np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]]


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchors + np.uint64((row * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)


def sketch(df: DataFrame, text: str, size: int, bits: int) -> np.ndarray:
    """Two rows of one bit a cell, set where the anchors of two or more documents fall; merged over all partitions."""
    shard = min(SHARD, bits)

    def sent(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for r, parts in enumerate(held):
            used, n = np.unique(np.concatenate(parts), return_counts=True)
            if not len(used):
                continue
            first = np.flatnonzero(np.r_[True, used[1:] >> np.uint64(shard) != used[:-1] >> np.uint64(shard)])
            made = list(zip(first, [*first[1:], len(used)], strict=True))
            for at in range(0, len(made), 256):
                some = made[at : at + 256]
                low = (used & np.uint64((1 << shard) - 1)).astype("<u4")
                once, twice = ([low[a:b][pick[a:b]].tobytes() for a, b in some] for pick in (n == 1, n > 1))
                keys = pa.array([r] * len(some), pa.int32()), pa.array([int(used[a]) >> shard for a, _ in some], pa.int32())
                yield pa.RecordBatch.from_arrays([*keys, pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["row", "shard", "once", "twice"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            anchors = Windows(Words(batch.column(0)), size).anchors()
            for r in range(2):
                held[r].append(cells(anchors, r, bits))
            if sum(map(len, held[0])) >= CELLS:
                yield from sent(held)
                held = [[], []]
        if held[0]:
            yield from sent(held)

    def merge(key, table):
        seen = np.zeros(1 << shard, np.uint8)
        for once, twice in zip(table["once"], table["twice"], strict=True):
            one, two = np.frombuffer(once.as_py(), "<u4"), np.frombuffer(twice.as_py(), "<u4")
            seen[one] = np.minimum(seen[one] + 1, 2)
            seen[two] = 2
        return pa.table({"row": [key[0].as_py()], "shard": [key[1].as_py()], "bits": [np.packbits(seen == 2, bitorder="little").tobytes()]}, schema=pa.schema([("row", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary())]))

    parts = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(partial, "row int, shard int, once binary, twice binary")
    merged = parts.groupBy("row", "shard").applyInArrow(merge, "row int, shard int, bits binary")
    filled = np.zeros((2, -(-(1 << bits) // 8)), np.uint8)
    for r in merged.toLocalIterator():  # at most MAX_BITS cells in all
        at = r["shard"] << shard >> 3
        filled[r["row"], at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return filled


def estimated_repeated(anchors: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(anchors), bool)
    for r in range(2):
        cell = cells(anchors, r, bits)
        found &= (filled[r][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def found_windows(df: DataFrame, key: str, text: str, size: int, filled, bits: int) -> DataFrame:
    """For each document with windows estimated repeated: __key, the windows to ask about (at, high, low) and those gone already.

    A window that a smaller key of the same partition has too is gone without asking, so that however common
    a window is, few of its rows leave a partition.
    """

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, at, high, low = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not len(keys):
            return
        order = np.lexsort((keys, low, high))
        h, w, k = high[order], low[order], keys[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
        gone = np.empty(len(keys), bool)
        gone[order] = k > k[np.flatnonzero(new)][np.cumsum(new) - 1]
        order = np.lexsort((at, gone, keys))
        keys, at, high, low, gone = (c[order] for c in (keys, at, high, low, gone))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        lost = np.concatenate([[0], np.cumsum(gone)]).astype(np.int32)
        ends = np.r_[first, len(keys)]
        asked = (ends - lost[ends]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(asked, pa.array(c[~gone])) for c in (at, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(keys[first]), *lists, pa.ListArray.from_arrays(lost[ends], pa.array(at[gone]))], names=["__key", "at", "high", "low", "gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            words = Words(batch.column(1))
            windows = Windows(words, size)
            chosen = np.flatnonzero(estimated_repeated(windows.anchor, filled.value, bits))
            at, of = windows.at[chosen], windows.text[chosen]
            high = grams(windows.hashes, size)[at].view(np.int64)
            low = (grams(mix(windows.hashes), size)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            parts.append((batch.column(0).to_numpy()[of], (at - words.first[of]).astype(np.int32), high, low))
            held += len(at)
            if held >= HELD:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    plain = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return plain.mapInArrow(run, "__key long, at array<int>, high array<long>, low array<int>, gone array<int>")


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, max_bits: int = MAX_BITS) -> DataFrame:
    """For each document that loses words: __key and the first words of its windows that a smaller key has too (__at, array)."""
    spark = df.sparkSession
    small_batches(spark)
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(1 + total * 8 / 6 * 2 / (size - RUN + 2))), MIN_BITS, max_bits)) if size > RUN else max_bits
    filled = spark.sparkContext.broadcast(sketch(df, text, size, bits))
    found = stored(found_windows(df, key, text, size, filled, bits), "windows")
    asked = found.select("__key", F.explode(F.arrays_zip("at", "high", "low")).alias("w")).select("__key", "w.*")
    owner = F.min("__key").over(Window.partitionBy("high", "low"))  # as many rows as partitions at most, for each document's
    lost = asked.withColumn("__owner", owner).where("__key > __owner").select("__key", "at")
    lost = lost.union(found.select("__key", F.explode("gone").alias("at")))
    lost = stored(lost.groupBy("__key").agg(F.array_sort(F.collect_set("at")).alias("__at")), "lost")
    release(spark)
    return lost


def without(column: pa.Array, lost: list, size: int, spaced: bool) -> tuple[list, list, list]:
    """Each text without the words of its lost windows, how many words it had, how many it lost.

    spaced: the kept words joined by one space; else a text that loses nothing stays as it is, and of the
    others go the lost words with the white space that follows each run of them.
    """
    words = Words(column)
    texts, counts, gone = [], words.counts.tolist(), []
    for n, starts in enumerate(lost):
        a, b = int(words.first[n]), int(words.first[n + 1])
        keep = np.ones(b - a, bool)
        if starts is not None and len(starts):
            edge = np.zeros(b - a + 1, np.int32)
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.minimum(np.asarray(starts) + size, b - a), -1)
            keep = np.cumsum(edge[:-1]) == 0
        gone.append(int((~keep).sum()))
        begin, end = int(words.texts[n]), int(words.texts[n + 1])
        if spaced:
            data = b" ".join([words.text_of(s, e) for s, e in zip(words.starts[a:b][keep].tolist(), words.ends[a:b][keep].tolist(), strict=True)])
        elif keep.all():
            data = words.text_of(begin, end)
        else:
            starts_, step = np.r_[words.starts[a:b], end], np.flatnonzero(np.diff(np.r_[False, ~keep, False]))
            kept, at = [], begin
            for first, after in zip(step[::2].tolist(), step[1::2].tolist(), strict=True):
                kept.append(words.text_of(at, int(starts_[first])))
                at = int(starts_[after])
            data = b"".join([*kept, words.text_of(at, end)])
        texts.append(data.decode("utf-8"))
    return texts, counts, gone


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW, spaced: bool = False, max_bits: int = MAX_BITS) -> DataFrame:
    """df with text cut, and n_words, n_removed: a word goes if a window over it also starts in a document of smaller key."""
    lost = repeated_windows(df, key, text, size, max_bits)
    k, at = fresh(df, "key", "at")
    lost = lost.toDF(k, at)
    joined = df.join(lost, df[key].cast("long") == lost[k], "left").drop(k)
    fields = T.StructType([T.StructField(text, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def kernel(column, starts):
        texts, counts, gone = without(column, [None if x is None else np.asarray(x) for x in starts.to_pylist()], size, spaced)
        null = column.is_null().to_pylist()
        return [[None if z and not spaced else t for t, z in zip(texts, null, strict=True)], counts, gone]

    return append_columns(joined, [text, at], fields, kernel).drop(at)
