"""Best-fit packing of token pieces into sequences of a fixed capacity, by the linear grouping scheme.

The plan needs the histogram of piece lengths alone, which has at most `capacity` entries however many
pieces there are. Large lengths are sorted, cut into groups of equal cardinality and rounded up to each
group's largest; a linear programme over configurations of these few sizes (solved by column generation)
says how many sequences of each configuration to open; actual pieces then take the slots of their group,
which leaves what rounding up gave away; all others go, longest first, where they fit best. Everything is
counted in runs (so many pieces of one length, in so many sequences), so the plan is a table whose size
depends on the capacity and the number of groups, not on the data; executors look up the place of
the n-th piece of a length.

Results in odd cases: an empty table gives no rows; a null or empty text is a document of the end token
alone; pieces of one length rank by key and piece number, so equal rows share no place; a piece longer than
the capacity or shorter than 1 raises ValueError.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.bpe import CONTRACTIONS, SHORT, Lockstep, Vocabulary, batches
from glyphmill.llm.shared import append_columns, stored

CAPACITY = 2048
GROUPS = 32
#: Lengths up to this part of the capacity are small, which best fit places. Rounding up costs most where large
#: lengths are many and different, so plans are made for each of these parts and the one of fewest sequences is kept.
SMALL = (1 / 2, 1 / 3, 1 / 5)
#: Chunks of text whose ids a worker keeps.
KEPT_CHUNKS = 700_000
#: Rows of one length that one task ranks.
RANKED_ROWS = 50_000


class ChunkIds:
    """Ids of a text as the tokenizers library gives them, found once for each chunk between ASCII white space.

    Only for tokenizers whose words never span white space (it is dropped), as `word_bpe_49k.json`. New chunks
    of Latin-1 characters are split into words here and merged together; the library itself encodes all others.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = Vocabulary(path)
        self.lockstep = Lockstep(self.vocab)
        letters = "".join(c for c in map(chr, range(256)) if c.isalpha())
        numbers = "".join(c for c in map(chr, range(256)) if regex.match(r"\p{N}", c))
        self.words = re.compile(rf"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+").findall
        self.added = re.compile("|".join(map(re.escape, self.vocab.added)) or "(?!)").search
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _lowered(self, text: str) -> str | None:
        """A Latin-1 text in lower case, if nothing in it needs the library: each character stays one Latin-1 character."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        lower = text.lower()
        return None if self.added(lower) else lower

    def learn(self, plain: set[bytes], others: set[bytes]) -> None:
        """Keep the ids of these chunks too; the oldest chunks go once there are too many. plain: lower-case Latin-1."""
        if len(self.kept) > KEPT_CHUNKS:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        plain, others = plain - kept.keys(), others - kept.keys()
        for chunks in (plain, others):
            kept.update((c, older[c]) for c in chunks & older.keys())
            chunks -= older.keys()
        others |= {c for c in plain if len(c) > SHORT}
        plain -= others
        split = {c: [w.encode("utf-8") for w in self.words(c.decode("utf-8"))] for c in plain if not c.isalpha()}
        words = [c for c in plain if c not in split]
        kept.update(zip(words, self.lockstep.merge(words), strict=True))
        rest = list({w for found in split.values() for w in found})
        ids = dict(zip(rest, self.lockstep.merge(rest), strict=True))
        kept.update((c, b"".join([ids[w] for w in found])) for c, found in split.items())
        if others:
            found = self.tokenizer.encode_batch([c.decode("utf-8") for c in others], add_special_tokens=False)
            kept.update(zip(others, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        lower = [self._lowered(t) for t in texts]
        split = [(t if low is None else low).encode("utf-8").split() for t, low in zip(texts, lower, strict=True)]
        self.learn(set().union(*(c for c, low in zip(split, lower, strict=True) if low is not None)), set().union(*(c for c, low in zip(split, lower, strict=True) if low is None)))
        kept = self.kept
        return [b"".join([kept[c] for c in chunks]) for chunks in split]


_loaded: dict[str, ChunkIds] = {}

PIECE = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
]))


def token_pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: key, piece, start, length, ids_crc32 and, if kept, ids (binary, uint32)."""
    size = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))

    def kernel(column):
        if path not in _loaded:
            _loaded[path] = ChunkIds(path)
        made = []
        for run in batches([t or "" for t in column.to_pylist()]):
            for ids in _loaded[path].encode_batch(run):
                ids += end
                cut = [ids[a : a + size] for a in range(0, len(ids), size)]
                made.append([(n, n * capacity, len(p) // 4, zlib.crc32(p), p if keep_ids else None) for n, p in enumerate(cut)])
        return [pa.array(made, type=kind)]

    pieces = append_columns(df.select(key, text), [text], T.StructType([T.StructField("pieces", PIECE)]), kernel)
    made = pieces.select(key, F.explode("pieces").alias("p")).select(key, "p.*")
    return made if keep_ids else made.drop("ids")


def fractional_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often each is used, of a least fractional cover of the demand.

    Column generation: the best new configuration under the current prices is an integer knapsack.
    """
    n, need, each = len(sizes), np.array(demand, float), np.array(sizes)
    columns = np.zeros((n, n))
    for g, s in enumerate(sizes):
        columns[g, g] = capacity // s
    used = np.linalg.solve(columns, need)
    for _ in range(60 * n):
        prices = np.linalg.solve(columns.T, np.ones(n))
        best, last = np.full(2 * capacity + 1, -np.inf), np.full(capacity + 1, -1)  # rooms below 0 stand at the end
        best[0] = 0
        for room in range(1, capacity + 1):
            values = best[room - each] + prices
            take = int(values.argmax())
            if values[take] > best[room - 1] + 1e-12:
                best[room], last[room] = values[take], take
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        new, room = np.zeros(n), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                new[last[room]] += 1
                room -= sizes[last[room]]
        step = np.linalg.solve(columns, new)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        used = np.maximum(used - ratio[leave] * step, 0)
        used[leave], columns[:, leave] = ratio[leave], new
    return [(columns[:, c].astype(int), float(used[c])) for c in range(n)]


class Plan:
    """Where runs of pieces go: the pieces [rank, rank + n) of a length, one each to sequences [sequence, sequence + n), at an offset."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL[0]):
        if counts and not 1 <= min(counts) <= max(counts) <= capacity:
            raise ValueError(f"lengths must lie between 1 and {capacity}")
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by what is left: (first sequence, sequences)
        self.rooms: list[int] = []  # those with sequences, sorted
        self.next = dict.fromkeys(counts, 0)
        self.left = dict(counts)
        self._configure({s: c for s, c in counts.items() if s > small * capacity}, groups)
        for size in sorted(counts, reverse=True):
            self._best_fit(size)

    def _place(self, size: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((size, self.next[size], n, sequence, offset))
        self.next[size] += n
        self.left[size] -= n

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _give(self, room: int, sequence: int, n: int) -> None:
        if n and room:
            if not self.room[room]:
                bisect.insort(self.rooms, room)
            self.room[room].append((sequence, n))

    def _configure(self, counts: dict[int, int], groups: int) -> None:
        total = sum(counts.values())
        if not total:
            return
        cut, members, filled = -(-total // groups), [[]], 0
        for size in sorted(counts, reverse=True):
            n = counts[size]
            while n:
                take = min(n, cut - filled)
                members[-1].append([size, take])
                n, filled = n - take, filled + take
                if filled == cut:
                    members.append([])
                    filled = 0
        by_size: dict[int, list] = defaultdict(list)  # groups that round up to the same size are one
        for group in filter(None, members):
            by_size[group[0][0]] += group
        sizes = sorted(by_size, reverse=True)
        queues = [by_size[s] for s in sizes]
        for config, times in fractional_configurations(sizes, [sum(n for _, n in q) for q in queues], self.capacity):
            slots = [g for g in range(len(sizes)) for _ in range(config[g])]
            n = int(times + 1e-6)
            if not slots or not n:
                continue
            waiting = [self._take(queues[g], n) for g in slots]
            first = self._open(n)
            while n:
                step = min((runs[0][1] for runs in waiting if runs), default=0)
                step = min([n, *(r[0][1] for r in waiting if r)]) if step else n
                offset = 0
                for runs in waiting:
                    if runs:
                        self._place(runs[0][0], step, first, offset)
                        offset += runs[0][0]
                        runs[0][1] -= step
                        if not runs[0][1]:
                            runs.pop(0)
                self._give(self.capacity - offset, first, step)
                first, n = first + step, n - step

    @staticmethod
    def _take(queue: list, n: int) -> list:
        """Up to n pieces off a group's queue, as runs of one length; a group may run short, which leaves a slot empty."""
        taken = []
        while n and queue:
            size, there = queue[0]
            take = min(n, there)
            taken.append([size, take])
            queue[0][1] -= take
            n -= take
            if not queue[0][1]:
                queue.pop(0)
        return taken

    def _best_fit(self, size: int) -> None:
        while n := self.left[size]:
            at = bisect.bisect_left(self.rooms, size)
            if at == len(self.rooms):
                new = -(-n // (self.capacity // size))
                self._give(self.capacity, self._open(new), new)
                continue
            room = self.rooms[at]
            sequence, there = self.room[room].pop()
            if not self.room[room]:
                self.rooms.pop(at)
            each = min(room // size, n)  # the sequence that a piece went to stays the tightest that takes the next
            full = min(there, n // each)
            for k in range(each):
                self._place(size, full, sequence, self.capacity - room + k * size)
            self._give(room - each * size, sequence, full)
            self._give(room, sequence + full, there - full)

    def lookup(self) -> tuple[np.ndarray, ...]:
        """The rows as columns, sorted by length and rank."""
        return tuple(np.array(sorted(self.rows), np.int64).reshape(-1, 5).T)


def best_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """The plan of fewest sequences over the parts that may count as small; ends at the first that none can beat."""
    least, best = -(-sum(size * n for size, n in counts.items()) // capacity), None
    for small in SMALL:
        plan = Plan(counts, capacity, groups, small)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (key, piece, length, ...) with sequence_id and offset. Pieces are stored first, as they are read twice."""
    pieces = stored(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = best_plan(counts, capacity, groups)
    length, rank, n, sequence, offset = plan.lookup()
    split = -(-max(counts.values(), default=1) // RANKED_ROWS)
    place = pieces.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(split)))
    by_part = Window.partitionBy("length", "__part").orderBy(key, "piece")
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = place.groupBy("length", "__part").count().select("length", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    ranked = place.withColumn("__rank", F.row_number().over(by_part) - 1).join(starts, ["length", "__part"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__first")).drop("__part", "__first")
    stride = int(max(counts.values(), default=0)) + 1
    edges = length * stride + rank

    def kernel(sizes, ranks):
        sizes, ranks = sizes.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        row = np.searchsorted(edges, sizes * stride + ranks, "right") - 1
        return [pa.array(sequence[row] + ranks - rank[row]), pa.array(offset[row])]

    fields = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return append_columns(ranked, ["length", "__rank"], fields, kernel).drop("__rank")
