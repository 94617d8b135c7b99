"""Token-id files in directly addressable codes, in the order of their documents' keys.

A file holds the ids of whole documents. Each id is cut into chunks of CHUNK bits, the lowest first: level 0 has one
chunk of every id, level 1 one of each id that goes on, and so on. A bitmap for each level but the last says which of
its ids go on; a rank directory (the set bits before every 512 bits, and before each 64 bits within these) says how
many of them stand before a place, which is the place of the next chunk. So any id is read with a look at each of its
levels, without decoding others, and a run of ids is a run of chunks on each level.

Layout, all little-endian: magic `DAC1`, number of levels (4 bytes), of ids, documents and documents without a key (8
bytes each), ids on each level (8 bytes each); then keys (8 bytes a document that has one) and ends (8 bytes a
document); then for each level its chunks, padded to 8 bytes, and, but for the last, its bitmap in 8-byte words,
the counts before each 512 bits (8 bytes each) and before each 64 bits within them (2 bytes each, padded to 8 bytes).

Files are rows of a Parquet table (part, number, n_ids, n_docs, first: ids before it in its part, content), so that
Spark's committer writes them to any store and a task that is lost is written again. Documents are sent once to ranges
of keys, sorted, encoded and written in the same pass; a file is closed once it has FILE_IDS ids, at the end of a
document. Readers get the places of all files from sums over parts, as many rows as tasks wrote.

Results in odd cases: a null or empty text has the end id alone; documents with a null key come first; rows that share a
key stand in the order of their texts' hashes, and rows that repeat are written each; an empty table gives no files,
no documents and no ids; places outside the files have no row; other columns are not written.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.bpe import Encoder, batches, loaded
from glyphmill.llm.shared import small_batches

CHUNK = 8
#: Ids from which a file ends.
FILE_IDS = 1 << 18
FILES = "part int, number int, n_ids long, n_docs long, first long, content binary"


def padded(values: np.ndarray) -> bytes:
    data = values.tobytes()
    return data + b"\0" * (-len(data) % 8)


def pack(ids: np.ndarray, keys: list, ends: np.ndarray) -> bytes:
    """A file of ids, with the key (null ones first) and the end of each of its documents."""
    known = [k for k in keys if k is not None]
    levels, left = [], ids.astype(np.uint32)
    while len(left) or not levels:
        more = left >> np.uint32(CHUNK)
        goes = more > 0
        levels.append([left.astype(np.uint8), goes])
        left = more[goes]
    head = [len(ids), len(keys), len(keys) - len(known), *(len(chunks) for chunks, _ in levels)]
    out = [b"DAC1", np.uint32(len(levels)).tobytes(), np.array(head, "<u8").tobytes(), np.array(known, "<i8").tobytes(), np.asarray(ends, "<u8").tobytes()]
    for n, (chunks, goes) in enumerate(levels):
        out.append(padded(chunks))
        if n + 1 < len(levels):
            bits = np.packbits(goes, bitorder="little")
            words = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), "<u8")
            before = np.cumsum(np.r_[0, np.bitwise_count(words)])[:-1]
            wide = before[::8]
            near = before - np.repeat(wide, 8)[: len(before)]
            out += [words.tobytes(), wide.astype("<u8").tobytes(), padded(near.astype("<u2"))]
    return b"".join(out)


class TokenFile:
    """A file of pack(): its documents, and any of its ids."""

    def __init__(self, content: bytes | memoryview):
        held = np.frombuffer(content, np.uint8)
        if held[:4].tobytes() != b"DAC1":
            raise ValueError("no token file")
        at = 8

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            found = held[at : at + size].view(kind)
            at += size + -size % 8
            return found

        levels = int(held[4:8].view("<u4")[0])
        self.n, docs, nulls = (int(v) for v in take(3, "<u8"))
        sizes = [int(v) for v in take(levels, "<u8")]
        self.keys: list = [None] * nulls + take(docs - nulls, "<i8").tolist()
        self.ends = take(docs, "<u8").astype(np.int64)
        self.levels = []
        for n, size in enumerate(sizes):
            chunks, words = take(size, "u1"), -(-size // 64)
            self.levels.append((chunks, *((take(words, "<u8"), take(-(-words // 8), "<u8"), take(words, "<u2")) if n + 1 < levels else (None,) * 3)))

    def ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many of a level's ids before each place go on."""
        _, words, wide, near = self.levels[level]
        word = np.minimum(at >> 6, len(words) - 1)
        bits = at - (word << 6)  # 64 at the end of the last word
        low = words[word] & np.where(bits < 64, (np.uint64(1) << (bits & 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
        return wide[word >> 3].astype(np.int64) + near[word] + np.bitwise_count(low)

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        at, which = np.asarray(places, np.int64), np.arange(len(places))
        out = np.zeros(len(at), np.uint32)
        for level, (chunks, words, _, _) in enumerate(self.levels):
            out[which] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK * level)
            if words is None:
                break
            goes = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            which, at = which[goes], self.ranks(level, at[goes])
        return out

    def run(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b: neighbours on every level."""
        out, which = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, (chunks, words, _, _) in enumerate(self.levels):
            out[which] |= chunks[a:b].astype(np.uint32) << np.uint32(CHUNK * level)
            if words is None or a == b:
                break
            held = np.unpackbits(words[a >> 6 : (b + 63) >> 6].view(np.uint8), bitorder="little")
            which = which[held[a & 63 : (a & 63) + b - a].astype(bool)]
            a, b = self.ranks(level, np.array([a, b])).tolist()
        return out


def write_files(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """The ids of each text (by the tokenizer file at path) and end_id, as files in a folder that must not exist yet."""
    small_batches(df.sparkSession)

    def files(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), itertools.count(), 0
        encoder, end = loaded(Encoder, path), np.array([end_id], "<i4")
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(h) for h in held])
            values = [part, next(number), size, len(keys), first, pack(np.concatenate(held), keys, ends)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "number", "n_ids", "n_docs", "first", "content"])

        for batch in rows:
            of = iter(batch.column(0).to_pylist())
            for run in batches(batch.column(1).to_pylist()):
                for ids in encoder.encode_batch(run):
                    held.append(np.concatenate([ids, end]))
                    keys.append(next(of))
                    size += len(held[-1])
                    if size >= FILE_IDS:
                        yield closed()
                        first += size
                        keys, held, size = [], [], 0
        if held:
            yield closed()

    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    ordered.select("key", "text").mapInArrow(files, FILES).write.option("compression", "none").parquet(folder)


def open_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder, with first: the ids of all files before each."""
    files = spark.read.schema(FILES).parquet(folder)
    parts = sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each task that wrote
    before = itertools.accumulate((n for _, n in parts), initial=0)
    known = spark.createDataFrame([(part, b) for (part, _), b in zip(parts, before, strict=False)], "part int, before long")
    return files.join(F.broadcast(known), "part").withColumn("first", F.col("first") + F.col("before")).drop("before")


def documents_of(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids (binary, 32-bit little-endian) of each document."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for n, first in enumerate(batch.column(0).to_pylist()):
                held = TokenFile(batch.column(1)[n].as_buffer())
                starts = np.r_[0, held.ends[:-1]].astype(np.int64)
                bounds = pa.py_buffer(np.r_[0, 4 * held.ends].astype(np.int32))
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(held.run(0, held.n).astype("<u4").tobytes())])
                columns = pa.array(held.keys, pa.int64()), pa.array(starts + first), pa.array(held.ends - starts), ids
                yield pa.RecordBatch.from_arrays(list(columns), names=[key, "start", "n_tokens", "ids"])

    return files.select("first", "content").mapInArrow(read, f"`{key}` long, start long, n_tokens long, ids binary")


def ids_at(files: DataFrame, places: DataFrame, place: str = "place") -> DataFrame:
    """place and id of distinct places (counted over all files). Places meet files by slots of FILE_IDS, each file is read once for all of its places."""
    small_batches(files.sparkSession)
    last = F.col("first") + F.col("n_ids")
    slots = files.select("part", "number", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / FILE_IDS), F.floor((last - 1) / FILE_IDS))).alias("slot"))
    asked = places.select(F.col(place).cast("long").alias("place")).where("place IS NOT NULL").distinct().withColumn("slot", F.floor(F.col("place") / FILE_IDS))
    found = asked.join(slots, "slot").where("place >= first AND place < last")
    # at most as many as the file has ids
    wanted = found.groupBy("part", "number").agg(F.array_sort(F.collect_list("place")).alias("places"))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for n, first in enumerate(batch.column(0).to_pylist()):
                at = batch.column(2)[n].values.to_numpy()
                ids = TokenFile(batch.column(1)[n].as_buffer()).ids(at - first)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.astype(np.int32))], names=["place", "id"])

    return files.join(wanted, ["part", "number"]).select("first", "content", "places").mapInArrow(read, "place long, id int")
