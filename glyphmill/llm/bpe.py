"""Byte-level byte-pair encoding: identifiers by a contiguous rank array, counts by a heap over a linked list.

Both work from a tokenizer file (JSON: vocabulary, merges, added tokens) whose path is a parameter; every
worker loads it once. Words repeat, so each worker keeps a bounded table of the words it has merged.

Results in odd cases: a null or empty text has no tokens (empty array, count 0); texts of any length are
read whole; a word longer than SHORT bytes is merged by heap in both operators, with the same result.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphmill.llm.shared import append_columns

#: Words kept by a worker, in each of two generations.
KEPT_WORDS = 200_000
#: Bytes of a word up to which repeated scans of a rank array are cheaper than a heap.
SHORT = 96
NONE = 1 << 40

# Contractions that the pre-tokenizer takes as words, and the white space of Unicode.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _split_pattern(letter: str, number: str, white: str) -> str:
    return rf"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+"


def _latin_class(kind: str) -> str:
    found = [chr(c) for c in range(256) if regex.match(rf"\p{{{kind}}}", chr(c))]
    return "".join(re.escape(c) for c in found)


#: For texts of Latin-1 characters alone, a pattern that the standard library runs faster, and the one for all others.
LATIN_WORDS = re.compile(_split_pattern(_latin_class("L"), _latin_class("N"), "\\t-\\r \\x85\\xa0")).findall
ALL_WORDS = regex.compile(_split_pattern("\\p{L}", "\\p{N}", WHITE)).findall


def pre_tokens(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ALL_WORDS(text)
    return LATIN_WORDS(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        value = {s: b for b, s in enumerate(symbols)}
        end = spec["model"].get("end_of_word_suffix") or ""
        self.byte_id = [vocab[s] for s in symbols]
        self.last_id = [vocab[s + end] for s in symbols]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << 20 | vocab[right], n)
            self.merged.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(value[c] for c in token.removesuffix(end))
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if self.added else None

    def pieces(self, text: str) -> list[str]:
        """The text cut at added tokens; those stand at the odd places."""
        return self.cut(text) if self.cut and any(t in text for t in self.added) else [text]


def merge_ranks(word: bytes, vocab: Vocabulary) -> tuple[list[int], list[int]]:
    """Part ids and part boundaries of one word, by repeated scans of the array of adjacent ranks."""
    get, merged = vocab.rank.get, vocab.merged
    byte_id = vocab.byte_id
    parts = [byte_id[b] for b in word]
    bounds = list(range(len(word) + 1))
    ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)
        parts[i] = left = merged[low]
        del parts[i + 1], bounds[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(left << 20 | parts[i + 1], NONE)
        if i:
            ranks[i - 1] = get(parts[i - 1] << 20 | left, NONE)
    return parts, bounds


def merge_heap(word: bytes, vocab: Vocabulary) -> tuple[int, list[int], list[int]]:
    """Number of merges that a heap of adjacent pairs makes in one word, with the linked symbols that are left.

    Symbol i's successor is follow[i]; a symbol that was merged away is -1. An entry of the heap is stale if
    the pair it was made for no longer stands at its place.
    """
    get, merged = vocab.rank.get, vocab.merged
    byte_id, end = vocab.byte_id, len(word)
    symbol = [byte_id[b] for b in word]
    follow, before = list(range(1, end + 1)), list(range(-1, end - 1))
    heap = [r << 32 | i for i in range(end - 1) if (r := get(symbol[i] << 20 | symbol[i + 1], NONE)) != NONE]
    heapq.heapify(heap)
    merges = 0
    while heap:
        entry = heapq.heappop(heap)
        rank, i = entry >> 32, entry & 0xFFFFFFFF
        j = follow[i]
        if symbol[i] < 0 or j >= end or get(symbol[i] << 20 | symbol[j], NONE) != rank:
            continue
        symbol[i], symbol[j] = merged[rank], -1
        merges += 1
        follow[i] = k = follow[j]
        if k < end:
            before[k] = i
            if (r := get(symbol[i] << 20 | symbol[k], NONE)) != NONE:
                heapq.heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get(symbol[h] << 20 | symbol[i], NONE)) != NONE:
            heapq.heappush(heap, r << 32 | h)
    return merges, symbol, follow


class Lockstep:
    """merge_ranks for many words at once: a row of parts, boundaries and adjacent ranks for each word of about one length."""

    ROWS = 8192

    def __init__(self, vocab: Vocabulary):
        self.byte_id, self.last_id = np.array(vocab.byte_id, np.int32), np.array(vocab.last_id, np.int32)
        self.merged = np.array([*vocab.merged, 0], np.int32)
        self.none = len(vocab.merged)
        self.bits = max(16, 2 + len(vocab.rank).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        for key, rank in vocab.rank.items():
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, `none` for those that never merge."""
        keys = left.astype(np.int64) << 20 | right
        at = self._slot(keys)
        there = self.keys[at]
        found = self.ranks[at]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            found[open_] = self.ranks[at[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        missing = self.keys[at] != keys
        found[missing] = self.none
        return found

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Part ids of each word, as little-endian 32-bit integers; words are not empty."""
        order = sorted(range(len(words)), key=lambda n: len(words[n]))
        out: list = [None] * len(words)
        for a in range(0, len(order), self.ROWS):
            self._merge(words, order[a : a + self.ROWS], out)
        return out

    def _merge(self, words: list[bytes], chosen: list[int], out: list) -> None:
        sizes = np.array([len(words[n]) for n in chosen])
        width, which = int(sizes[-1]) + 1, np.array(chosen)
        filled = np.arange(width) < sizes[:, None]
        parts = np.zeros((len(chosen), width), np.int32)
        parts[filled] = self.byte_id[np.frombuffer(b"".join([words[n] for n in chosen]), np.uint8)]
        last = np.array([words[n][-1] for n in chosen])
        parts[np.arange(len(chosen)), sizes - 1] = self.last_id[last]
        bounds = np.minimum(np.arange(width, dtype=np.int16), sizes[:, None].astype(np.int16))
        ranks = np.full((len(chosen), width), self.none, np.int32)
        pairs = filled[:, 1:]
        ranks[:, :-1][pairs] = self.rank(parts[:, :-1][pairs], parts[:, 1:][pairs])
        columns = np.arange(width)
        while True:
            i = ranks.argmin(1)
            low = ranks[np.arange(len(i)), i]
            going = low < self.none
            if not going.all():
                done = parts[~going]
                there = bounds[~going] < bounds[~going][:, -1:]  # as many parts as boundaries before the end of the word
                flat, at = done[there].astype("<i4").tobytes(), 0
                for n, end in zip(which[~going].tolist(), (4 * there.sum(1).cumsum()).tolist(), strict=True):
                    out[n] = flat[at:end]
                    at = end
                if not going.any():
                    return
                parts, bounds, ranks, which, i, low = parts[going], bounds[going], ranks[going], which[going], i[going], low[going]
            # every word left loses one part, so the arrays lose one column
            rows, columns = np.arange(len(i)), columns[:-1]
            step = columns + (columns > i[:, None])
            parts, bounds = np.take_along_axis(parts, step, 1), np.take_along_axis(bounds, step, 1)
            ranks = np.take_along_axis(ranks, columns + (columns >= i[:, None]), 1)
            parts[rows, i] = left = self.merged[low]
            after = bounds[rows, i + 1] < bounds[:, -1]  # a part follows
            ranks[rows, i] = np.where(after, self.rank(left, parts[rows, i + 1]), self.none)
            r = np.flatnonzero(i)
            ranks[r, i[r] - 1] = self.rank(parts[r, i[r] - 1], left[r])


class Kept(dict):
    """What words came to, for the latest words: two generations of bounded size."""

    def __init__(self, make, limit: int = KEPT_WORDS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word):
        made = self.older.get(word)
        if made is None:
            made = self.make(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = made
        return made


class Encoder:
    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.lockstep = Lockstep(self.vocab)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Keep the ids of these words too; the oldest words go once there are too many."""
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        kept, older = self.words, self.older
        new = words - kept.keys()
        kept.update((w, older[w]) for w in new & older.keys())
        new -= older.keys()
        data = {w: w.encode("utf-8") for w in new}
        short = [w for w in new if len(data[w]) <= SHORT]
        kept.update(zip(short, self.lockstep.merge([data[w] for w in short]), strict=True))
        for w in new.difference(short):
            kept[w] = np.array([s for s in merge_heap(data[w], self.vocab)[1] if s >= 0], "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text; words new to this worker are merged together."""
        split = [[piece if n % 2 else pre_tokens(piece) for n, piece in enumerate(self.vocab.pieces(t))] for t in texts]
        self.learn({w for pieces in split for words in pieces[::2] for w in words})
        ids, added = self.words, {t: np.array([i], "<i4").tobytes() for t, i in self.vocab.added.items()}
        return [np.frombuffer(b"".join([added[p] if n % 2 else b"".join([ids[w] for w in p]) for n, p in enumerate(pieces)]), "<i4") for pieces in split]

    def decode(self, ids) -> str:
        of = self.vocab.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


def batches(texts: list[str], most: int = 1 << 22):
    """Runs of texts of about `most` characters, or a longer one alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


class Counter:
    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.words = Kept(self.word_count)

    def word_count(self, word: str) -> int:
        data = word.encode("utf-8")
        return len(data) - merge_heap(data, self.vocab)[0]

    def count(self, text: str) -> int:
        total = 0
        for n, piece in enumerate(self.vocab.pieces(text)):
            total += 1 if n % 2 else sum(map(self.words.__getitem__, pre_tokens(piece)))
        return total


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One encoder or counter a worker: its table of words serves all tasks that the worker runs."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each text, as array<int>; a null or empty text has none."""

    def kernel(column):
        encode = loaded(Encoder, path).encode_batch
        made = [ids for run in batches([t or "" for t in column.to_pylist()]) for ids in encode(run)]
        ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
        return [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made) if made else [], pa.int32()))]

    return append_columns(df, [text], T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType(), False))]), kernel)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text of each id array, special tokens kept, broken UTF-8 replaced; a null array gives an empty text."""

    def kernel(column):
        decode = loaded(Encoder, path).decode
        values, ends = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_pylist()
        return [pa.array([decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)], type=pa.string())]

    return append_columns(df, [ids], T.StructType([T.StructField(decoded, T.StringType())]), kernel)


def count_tokens(df: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of each text; none are made."""

    def kernel(column):
        counted = loaded(Counter, path).count
        return [pa.array([counted(t or "") for t in column.to_pylist()], type=pa.int64())]

    return append_columns(df, [text], T.StructType([T.StructField(count, T.LongType())]), kernel)
