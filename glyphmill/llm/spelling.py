"""Spelling variants: words one edit apart, each with its commonest neighbour as its form.

Words are maximal runs of LETTERS, A-Z in lower case. Two words are near if one inserted, deleted or replaced character
makes one of the other. Halve a word: one edit leaves one of its two segments as it is, the first at the start of the
near word, or the second at its end. So every word's two segments go to automaton shards by their hashes, and every word
goes to each shard that may hold a segment of a near word of its own length or of one character less (its first or last
characters, of as many as segments of that length have), at most four. A shard is one Aho-Corasick automaton of its
segments, whatever their halves and lengths; it scans each of its words once. Of its hits count those of first
segments at a word's start and of second segments at its end, in words of the right lengths; for these pairs the rest is
compared by characters. A pair that both segments find counts by the first alone.

Pairs are never rows: a shard returns, for each word, how many near words it found and the best of them. A shard that
many words share (a common prefix) is dealt into tiles of some TILE words that are held by some TILE that are scanned.
Counting is by task first, so a common word is a row of each task. Tables of words are stored, never collected.

Forms: the near word of greatest count (of equals the first in code-point order), if it occurs at least TIMES as often.
Roots follow forms by pointer jumping; counts grow TIMES with each step, so a few rounds end it.

Results in odd cases: null and empty texts have no words; a null key counts as the text `null` where words are spoiled;
rows that repeat are counted each; an empty table has no words; words of any length take part; words without near ones
have no form and are their own root; other columns are not used.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import bounded, forget, let, small_batches, stored

LETTERS = "A-Za-zÀ-ÿ"
FIND = re.compile("[a-zÀ-ÿ]+").findall
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
#: Distinct words that a task counts before it sends them on.
COUNTED = 300_000
#: Segments a shard is made for, and words of a tile from which shards are cut into several.
SHARD, TILE = 1 << 15, 1 << 17
#: Pairs, and characters of pairs, that are compared at once.
PAIRS, CHARS = 1 << 18, 1 << 23


def spoiled(word: str, key: str, every: int) -> str:
    """The word, less a character where every divides the hash of key and word."""
    h = zlib.crc32(f"{key}:{word}".encode())
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, spoil: int = 0) -> DataFrame:
    """word and n of the words of all texts that are long (two characters at least) and frequent enough. spoil: every so many (key, word) lose a character."""
    if least_chars < 2:
        raise ValueError("a word of one character has no two segments")
    small_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                for word, n in Counter(FIND(t.encode().translate(LOWER).decode())).items():
                    if spoil and not zlib.crc32(f"{k}:{word}".encode()) % spoil:
                        word = spoiled(word, k, spoil)
                    if len(word) >= least_chars:
                        total[word] += n
                if len(total) >= COUNTED:
                    yield sent()
                    total.clear()
        if total:
            yield sent()

    held = df.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("key"), F.col(text).alias("text"))
    counted = held.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def half(length):
    """Characters of the first segment of a word of so many."""
    return length // 2


def with_shards(words: DataFrame, shards: int) -> DataFrame:
    """words once for each shard they are scanned in: shard, and held (1 if their first segment is in it, 2 if the second is, or 3)."""
    size = F.char_length("word")

    def keys(length) -> list:
        first = F.floor(length / 2).cast("int")
        parts = F.substring("word", F.lit(1), first), F.substring("word", size - (length - first) + 1, length - first)
        return [F.pmod(F.xxhash64(p), F.lit(shards)).cast("int") for p in parts]

    def visits(k):
        held = lambda s: F.when(k[0] == s, 1).otherwise(0) + F.when(k[1] == s, 2).otherwise(0)
        return F.transform(F.array_distinct(k), lambda s: F.struct(s.alias("shard"), held(s).alias("held")))

    return words.select("word", "n", F.inline(let(F.array(*keys(size), *keys(size - 1)), visits)))


def tiles(visits: DataFrame, most: int) -> DataFrame:
    """visits dealt to tiles (shard, i, j): words held in part i of a shard meet words scanned in part j; scanned and held say which a row is."""
    sizes = visits.groupBy("shard").count().where(F.col("count") > most).select("shard", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    sizes = stored(sizes, "crowded")
    dealt = visits.join(bounded(sizes), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts")).cast("int"))
    other, own = F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")
    scanned = F.transform(other, lambda i: F.struct(i.alias("i"), own.alias("j"), F.when(i == own, F.col("held")).otherwise(0).alias("held"), F.lit(True).alias("scanned")))
    holding = F.transform(F.filter(other, lambda j: j != own), lambda j: F.struct(own.alias("i"), j.alias("j"), F.col("held").alias("held"), F.lit(False).alias("scanned")))
    rows = F.when(F.col("held") > 0, F.concat(scanned, holding)).otherwise(scanned)
    return dealt.select("shard", "word", "n", F.inline(rows))


class Shard:
    """An automaton of words' segments (held: of which word, 1 the first, 2 the second, 3 both), and the words that have them."""

    def __init__(self, words: list[str], held: np.ndarray):
        self.automaton = ahocorasick.Automaton()
        self.words = words
        of: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        for k in np.flatnonzero(held).tolist():
            word, cut = words[k], half(len(words[k]))
            for which, segment in enumerate((word[:cut], word[cut:])):
                if held[k] >> which & 1:
                    of[segment][which].append(k)
        self.owners: list[np.ndarray] = []
        for segment, (first, second) in of.items():
            self.automaton.add_word(segment, (len(segment), len(self.owners)))
            self.owners += [np.array(first, np.int64), np.array(second, np.int64)]
        if of:
            self.automaton.make_automaton()

    def hits(self, scanned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scanned words and the owners' lists of the segments that stand at their start (even numbers) or their end (odd ones)."""
        found: list[int] = []
        if self.owners:
            scan = self.automaton.iter
            for k in scanned.tolist():
                word = self.words[k]
                last = len(word) - 1
                for end, (size, owners) in scan(word):
                    if end + 1 == size:
                        found += (k, owners)
                    if end == last:
                        found += (k, owners + 1)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def near_pairs(words: list[str], held: np.ndarray, scanned: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of near words (numbers of a scanned and a held word) in blocks, each pair once. words stand in order; held as in Shard; scanned: numbers.

    Of two words of one length the scanned one is the greater; else the scanned one is longer.
    """
    shard = Shard(words, held)
    who, lists = shard.hits(scanned)
    sizes = np.array([len(o) for o in shard.owners], np.int64)
    length = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    start = np.cumsum(np.r_[0, length])[:-1]
    ends = np.cumsum(sizes[lists]) if len(lists) else np.zeros(0, np.int64)
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        u = np.repeat(who[a:b], sizes[lists[a:b]])
        first = np.repeat(lists[a:b] % 2 == 0, sizes[lists[a:b]])
        v = np.concatenate([shard.owners[n] for n in lists[a:b].tolist()])
        more = length[u] - length[v]
        fits = (more == 1) | (more == 0) & (u > v)
        yield _verified(u[fits], v[fits], first[fits], more[fits], length, start, data)
        a = b


def _verified(u, v, first, more, length, start, data) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (u, v) one edit apart, of those whose first (or second) segments are equal; u has 0 or 1 characters more."""
    kept = [np.zeros(0, np.int64)]
    kinds = length[v] << 2 | more << 1 | first
    order = np.argsort(kinds, kind="stable")
    cuts = np.flatnonzero(np.diff(kinds[order])) + 1
    for some in np.split(order, cuts):
        if not some.size:
            continue
        n, longer, by_first = int(length[v[some[0]]]), bool(more[some[0]]), bool(first[some[0]])
        step = max(1, CHARS // n)
        for at in range(0, some.size, step):
            part = some[at : at + step]
            y = data[start[v[part]][:, None] + np.arange(n)]
            x = data[start[u[part]][:, None] + np.arange(n)]
            same = x == y
            if longer:  # u without a character: as much as the start shares, and then the rest
                z = data[start[u[part]][:, None] + np.arange(1, n + 1)] == y
                ahead = np.where(same.all(1), n, (~same).argmax(1))
                behind = np.where(z.all(1), n, (~z[:, ::-1]).argmax(1))
                near = ahead + behind >= n
            else:
                near = (~same).sum(1) == 1
            if not by_first:  # found by its first segment too
                near &= ~same[:, : half(n)].all(1)
            kept.append(part[near])
    chosen = np.concatenate(kept)
    return u[chosen], v[chosen]


def best_near(words: DataFrame) -> DataFrame:
    """word, n_near, and the near word of greatest count (best, best_n), of words that have near ones. words: word, n."""
    shards = max(1, -(-4 * words.count() // SHARD))
    dealt = tiles(with_shards(words, shards), TILE)

    def scan(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table["word"]))  # by bytes, which is by code points
        names, n = table["word"].to_pylist(), table["n"].to_numpy()
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        count, best = np.zeros(len(names), np.int64), np.full(len(names), len(names))
        for u, v in near_pairs(names, table["held"].to_numpy(), np.flatnonzero(table["scanned"].to_numpy())):
            for a, b in ((u, v), (v, u)):
                np.add.at(count, a, 1)
                np.minimum.at(best, a, place[b])
        some = np.flatnonzero(count)
        top = order[best[some]]
        return pa.table({"word": pa.array([names[k] for k in some.tolist()], pa.string()), "n_near": pa.array(count[some]), "best": pa.array([names[k] for k in top.tolist()], pa.string()), "best_n": pa.array(n[top])})

    found = dealt.groupBy("shard", "i", "j").applyInArrow(scan, "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root (where forms end) of stored rows word, form; forms make no circles."""
    up, before = forms.select("word", F.col("form").alias("root")), None
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(up.join(bounded(above), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if before is not None:
            forget(before)
        before, up = jumped, jumped.select("word", "root")
        if not jumped.where("moved").take(1):
            return up


def spelling_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form and form_n (null for none) and root of words (word, n: distinct words of two characters or more, of LETTERS in lower case)."""
    words = stored(words.select("word", "n"), "words")
    near = best_near(words)
    found = words.join(near, "word", "left").withColumn("better", F.col("best_n") >= times * F.col("n"))
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("better"), F.col("best")).alias("form"), F.when(F.col("better"), F.col("best_n")).alias("form_n"))
    found = stored(found, "forms")
    forget(words)
    up = roots(found.where("form IS NOT NULL"))
    return found.join(bounded(up), "word", "left").withColumn("root", F.coalesce("root", "word"))
