"""Exact set-similarity self-join of word n-grams, by signature trees, and the groups that its links connect.

Every document has a set of n-gram hashes (64 bits). Equal sets are one class, represented by its least key.
Two ways bring classes together in tasks of bounded size, and in both a signature tree does the join:

1. Clusters. Classes that agree in a band of bucket minima are connected; a cluster's sets meet in one task.
   Its tree's nodes hold the OR of their members' token bitmaps and the range of their sizes; traversing
   the tree against itself drops pairs of nodes whose greatest possible overlap is too small for the
   threshold, or which are connected already; the pairs of members that are left are compared exactly.
   Clusters beyond CHUNK classes are dealt to tasks of that size, whose groups' leaders meet again.
2. Blocks. What clusters may miss is found without loss: similar sets share a token among their first
   n - ceil(t n) + 1 in any order that is the same for all (here tokens that are frequent in a partition
   come last). Classes of different clusters that share such a token meet in a block, together with their
   size band and its neighbour; trees of their bitmaps leave the pairs that may reach the threshold, and
   these are compared exactly. A block beyond CHUNK classes is dealt to pairs of chunks.

Results in odd cases: a null or empty text, or one without words, has an empty set, links with nothing and is
its own component; a text with fewer words than n has its whole sequence as the one n-gram; rows that share
a key are one node; a null key gets a null component; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.components import components
from glyphmill.llm.shared import append_columns, bounded, forget, release, small_batches, stored
from glyphmill.llm.words import Words, grams, mix

BUCKETS, BAND = 64, 4
CHUNK = 8192
FANOUT = 16
#: A token that stands in this many documents of a partition comes last in the order; at most HEAVY of them do.
LOCAL, HEAVY = 12, 1 << 17
#: Bits of a bitmap for each token, before rounding up to a power of two.
DENSITY = 4
#: Blocks carry bitmaps of the tokens of one residue of this many; all others count as tokens that may be shared.
SAMPLED = 4


def token_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within it, and the first of each text's (with the end)."""
    words = Words(column, fold=True)
    hashes = words.hashes()
    run, out, ends = grams(hashes, n), [], [0]
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= n:
            own = np.sort(run[a : b - n + 1])
            own = own[np.r_[True, own[1:] != own[:-1]]]
        elif b > a:
            own = grams(hashes[a:b], b - a) + np.uint64(b - a)
        else:
            own = run[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return (np.concatenate(out) if out else run[:0]), np.array(ends)


def heavy_tokens(df: DataFrame, text: str, n: int) -> np.ndarray:
    """Tokens that many documents of one partition hold, sorted; which ones decides the order of tokens, never a result."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            found, count = np.unique(token_sets(batch.column(0), n)[0], return_counts=True)
            found, count = found[count > 1], count[count > 1]
            both = np.concatenate([seen, found])
            seen, back = np.unique(both, return_inverse=True)
            times = np.bincount(back, np.concatenate([times, count]), len(seen)).astype(np.int64)
        often = np.flatnonzero(times >= LOCAL)
        often = often[np.argsort(times[often])[-HEAVY:]]
        yield pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(times[often])], names=["token", "times"])

    counted = df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(local, "token long, times long")
    top = counted.groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(HEAVY)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], np.int64).view(np.uint64))


def _lists(made: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
    flat = np.concatenate(made) if made else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64), kind))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Token bitmap as 64-bit words; halves of a bitmap OR-ed together are the bitmap of half the size."""
    flags = np.zeros(bits, np.uint8)
    flags[tokens & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def width(size: int) -> int:
    return 1 << max(6, (DENSITY * size - 1).bit_length())


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def prefix_length(size: int, t: int) -> int:
    """Tokens of a set of which a set at least t percent similar must hold one."""
    return size - -(-t * size // 100) + 1


SKETCH = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bitmap", T.BinaryType()),
])


def sketches(df: DataFrame, key: str, text: str, n: int, t: int) -> DataFrame:
    """For each document: __key, size and 128-bit digest of its set, bands of bucket minima, prefix tokens, bitmap."""
    shared = df.sparkSession.sparkContext.broadcast(heavy_tokens(df, text, n))  # at most HEAVY tokens

    def kernel(column):
        heavy, (tokens, ends) = shared.value, token_sets(column, n)
        d1 = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens), dtype=np.uint64)])
        d2 = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        common = heavy[np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)] == tokens if len(heavy) else np.zeros(len(tokens), bool)
        bands, prefixes, bitmaps = [], [], []
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            own = tokens[a:b]
            bucket = own >> np.uint64(58)
            lowest = np.zeros(BUCKETS, np.uint64)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if b > a else []
            lowest[bucket[first].astype(np.int64) if b > a else []] = own[first]
            rows = lowest.reshape(-1, BAND)
            filled = np.flatnonzero(rows.any(1))
            band = np.zeros(len(filled), np.uint64)
            for c in range(BAND):
                band = mix(band + rows[filled, c] + np.uint64(0x9E3779B97F4A7C15))
            bands.append(mix(band + filled.astype(np.uint64)))
            p = prefix_length(b - a, t) if b > a else 0
            rare = own[~common[a:b]][:p]
            prefixes.append(np.concatenate([rare, own[common[a:b]][: p - len(rare)]]))
            some = own[(own >> np.uint64(40)) % np.uint64(SAMPLED) == 0]
            bitmaps.append(bitmap(some, width(max(1, len(some)))).tobytes())
        digest = [(d[ends[1:]] - d[ends[:-1]]).view(np.int64) for d in (d1, d2)]
        return [np.diff(ends), *digest, _lists(bands, pa.int64()), _lists(prefixes, pa.int64()), bitmaps]

    plain = df.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return append_columns(plain, ["__text"], SKETCH, kernel).drop("__text")


class Groups:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return int(i)

    def unite(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


class SignatureTree:
    """Members in order of size, FANOUT to a node, level upon level; a node ORs bitmaps and keeps the range of sizes.

    spare is the most tokens that any member of a node has beyond its set bits (two tokens on one bit, or tokens
    that its bitmap leaves out): two members share at most as many tokens as their nodes share bits, and spare
    ones besides.
    """

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, t: int):
        self.t = t
        spare = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, spare)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def may_reach(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of nodes of a level, whether any of their members could be similar enough."""
        bits, low, high, spare = self.levels[level]
        t, can = self.t, np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            sized = np.flatnonzero((100 * high[x] >= t * low[y]) & (100 * high[y] >= t * low[x]))
            x, y = x[sized], y[sized]
            most = np.bitwise_count(bits[x] & bits[y]).sum(1, dtype=np.int64) + np.minimum(spare[x], spare[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            # overlap o of sets of sizes p and q is enough if 100 o >= t (p + q - o)
            can[a + sized] = (100 + t) * most >= t * (low[x] + low[y])
        return can

    def children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the children of each pair of nodes, first at most second."""
        end = len(self.levels[level - 1][0])
        x = (i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
        y = (j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
        there = (x < end) & (y < end) & (x <= y)
        return x[there], y[there]

    def pairs(self, apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members that may be similar, in runs. apart(level, i, j): which pairs of nodes are still of interest.

        Depth first, so that what the caller learns from a run prunes the next.
        """
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            keep = apart(level, i, j)
            i, j = i[keep], j[keep]
            keep = self.may_reach(level, i, j)
            i, j = i[keep], j[keep]
            if not level:
                keep = i < j
                if keep.any():
                    yield i[keep], j[keep]
                continue
            # pairs of a node with itself last, so they are taken first
            order = np.argsort(i == j, kind="stable")
            i, j = i[order], j[order]
            step = 4 if level > 1 else 16
            for a in range(0, len(i), step):
                stack.append((level - 1, *self.children(level, i[a : a + step], j[a : a + step])))


def node_spans(values: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of the members of each node of a level."""
    at = np.arange(0, len(values), FANOUT**level)
    return np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)


def linked_groups(sets: list[np.ndarray], t: int) -> np.ndarray:
    """For each set (sorted distinct tokens), the least index of those that links connect it with; by a signature tree."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    bits = width(int(sizes.max()))
    tree = SignatureTree(np.stack([bitmap(sets[k], bits) for k in order]), sizes[order], t)
    groups = Groups(len(sets))
    spans: dict[int, tuple] = {}

    def apart(level, i, j):
        low, high = spans.get(level) or spans.setdefault(level, node_spans(groups.roots(), level))
        return ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])) | ((i == j) & (low[i] != high[i]))

    for i, j in tree.pairs(apart):
        united = False
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if groups.find(a) == groups.find(b):
                continue
            x, y = sets[order[a]], sets[order[b]]
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if 100 * common >= t * (len(x) + len(y) - common):
                groups.unite(a, b)
                united = True
        if united:
            spans.clear()
    roots, least = groups.roots(), np.full(len(sets), len(sets))
    np.minimum.at(least, roots, order)
    out = np.empty(len(sets), np.int64)
    out[order] = least[roots]
    return out


def cluster_links(docs: DataFrame, clusters: DataFrame, n: int, t: int) -> DataFrame:
    """Edges (a, b) that connect the linked classes of each cluster. clusters (stored): __key, cluster, size; docs: __key, __text."""

    def tokens(column):
        flat, ends = token_sets(column, n)
        return [_lists([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.int64())]

    def join(table):
        keys = table["__key"].to_numpy()
        order = np.argsort(keys)
        flat, ends = table["tokens"].combine_chunks(), None
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.chunk(0)
        ends = flat.offsets.to_numpy()
        values = flat.values.to_numpy().view(np.uint64)
        least = linked_groups([values[ends[k] : ends[k + 1]] for k in order], t)
        keys = keys[order]
        return pa.table({"a": keys, "b": keys[least]})

    part = F.when(F.col("size") > CHUNK, F.pmod(F.xxhash64("__key"), F.ceil(2 * F.col("size") / CHUNK))).otherwise(F.lit(0))
    chosen = docs.join(bounded(clusters).withColumn("part", part.cast("long")), "__key")
    fields = T.StructType([T.StructField("tokens", T.ArrayType(T.LongType()))])
    sets = append_columns(chosen, ["__text"], fields, tokens).select("__key", "cluster", "part", "tokens")
    return sets.groupBy("cluster", "part").applyInArrow(join, "a long, b long").where("a <> b")


def block_pairs(reps: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) of classes of different clusters that share a prefix token and may be similar by their bitmaps.

    reps: __key, n, cluster, prefix, bitmap.
    """
    wide = -8 * np.log(t / 100 * (1 - 1e-9))  # similar sets are in one band, or the larger near the lower end of the next
    home, guest = (F.floor(F.log(F.col("n") * part) / wide) for part in (1.0, t / 100 * (1 - 1e-9)))
    tokens = reps.select("__key", "n", "cluster", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("token")
    shared = stored(shared, "shared")
    release(reps.sparkSession)
    found = tokens.join(bounded(shared), "token")
    bands = F.array(F.struct(home.alias("band"), F.lit(True).alias("home")), F.when(home != guest, F.struct(guest.alias("band"), F.lit(False).alias("home"))))
    found = stored(found.withColumn("b", F.explode(F.array_compact(bands))).select("*", "b.*").drop("b"), "blocks")
    forget(shared)
    # tokens of one passage bring the same sets together: of blocks with the same members (by 128 bits), one is joined
    members = [F.bit_xor(F.xxhash64("__key", "home", F.lit(k))).alias(f"m{k}") for k in (0, 1)]
    sized = found.groupBy("token", "band").agg(F.count("*").alias("size"), F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.max("home").alias("any"), *members)
    sized = sized.where("low < high AND any").groupBy("band", "size", "m0", "m1").agg(F.min("token").alias("token"))
    sized = sized.select("token", "band", F.ceil(F.col("size") / CHUNK).alias("chunks"))
    dealt = found.join(sized, ["token", "band"]).withColumn("own", F.pmod(F.xxhash64("__key"), "chunks"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
    dealt = dealt.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    dealt = stored(dealt.drop("other", "chunks"), "dealt")
    forget(found)
    release(reps.sparkSession)
    # bitmaps come last, for the members of the blocks that are joined
    dealt = dealt.join(reps.select("__key", "bitmap"), "__key")

    def join(table):
        size = table["n"].to_numpy()
        order = np.argsort(size, kind="stable")
        size = size[order]
        keys, cluster, home, own = (table[c].to_numpy()[order] for c in ("__key", "cluster", "home", "own"))
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        raw = table["bitmap"].to_pylist()
        bits = [np.frombuffer(raw[k], np.uint64) for k in order]
        words = min(map(len, bits))
        tree = SignatureTree(np.stack([folded(b, words) for b in bits]), size, t)

        def apart(level, i, j):
            low, high = node_spans(cluster, level)
            return ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))

        a, b = [keys[:0]], [keys[:0]]
        for i, j in tree.pairs(apart):
            keep = (home[i] | home[j]) & (cluster[i] != cluster[j]) & ((own[i] != own[j]) | (one == two))
            a.append(np.minimum(keys[i[keep]], keys[j[keep]]))
            b.append(np.maximum(keys[i[keep]], keys[j[keep]]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    columns = ["__key", "n", "cluster", "home", "bitmap", "token", "band", "own", "one", "two"]
    return dealt.select(*columns).groupBy("token", "band", "one", "two").applyInArrow(join, "a long, b long").distinct()


def similar_pairs(docs: DataFrame, pairs: DataFrame, n: int, t: int) -> DataFrame:
    """The pairs whose sets are similar, compared exactly. docs: __key, __text."""
    fields = T.StructType([T.StructField("tokens", T.ArrayType(T.LongType()))])

    def tokens(column):
        flat, ends = token_sets(column, n)
        return [_lists([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.int64())]

    wanted = stored(pairs.select(F.col("a").alias("__key")).union(pairs.select("b")).distinct(), "wanted")
    sets = stored(append_columns(docs.join(bounded(wanted), "__key"), ["__text"], fields, tokens).select("__key", "tokens"), "sets")
    both = pairs.join(sets.select(F.col("__key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("__key").alias("b"), F.col("tokens").alias("y")), "b")
    common = both.select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("o"))
    found = stored(common.where(100 * F.col("o") >= t * (F.col("p") + F.col("q") - F.col("o"))).select("a", "b"), "similar")
    forget(sets)
    release(docs.sparkSession)
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, t: int = 80) -> DataFrame:
    """key, n_shingles and component_id (least key that links reach) for each document; t: similarity in percent."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    sketched = stored(sketches(df.withColumn(key, F.col(key).cast("long")), key, text, n, t), "sketches")
    digest = ["n", "d1", "d2"]
    classes = sketched.where("n > 0 AND __key IS NOT NULL").groupBy(*digest).agg(F.min("__key").alias("rep"))
    member = stored(sketched.select("__key", *digest).join(classes, digest, "left").select("__key", "n", F.coalesce("rep", "__key").alias("rep")), "members")
    first = F.min_by(F.struct("bands", "prefix", "bitmap"), "__key").alias("s")
    reps = sketched.where("n > 0 AND __key IS NOT NULL").groupBy(*digest).agg(F.min("__key").alias("__key"), first)
    reps = stored(reps.select("__key", "n", "s.*"), "reps")
    forget(sketched)
    release(spark)
    # 1. clusters
    bands = reps.select("__key", F.explode("bands").alias("band"))
    centres = bands.groupBy("band").agg(F.min("__key").alias("centre"), F.max("__key").alias("last")).where("centre < last").select("band", "centre")
    star = bands.join(centres, "band").where("__key > centre").select(F.col("__key").alias("a"), F.col("centre").alias("b"))
    label = components(star).withColumnRenamed("node", "__key").withColumnRenamed("component", "cluster")
    sized = stored(label.join(label.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("__key", "cluster", "size"), "sized")
    links = stored(cluster_links(docs, sized, n, t), "links")
    release(spark)
    large = sized.where(F.col("size") > CHUNK)
    while large.take(1):  # leaders of the groups that the tasks found meet in smaller clusters
        leaders = large.join(links.select(F.col("a").alias("__key")), "__key", "left_anti").select("__key", "cluster")
        before, large = large, stored(leaders.join(leaders.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("__key", "cluster", "size"), "leaders")
        links = stored(links.union(cluster_links(docs, large, n, t)).distinct(), "links")
        if large.count() >= 0.9 * before.count():
            break  # most are apart: what links them is left to the blocks
        large = large.where(F.col("size") > CHUNK)
    # 2. blocks; of a cluster that was dealt to several tasks, only what is connected already counts as one
    whole = sized.where(F.col("size") <= CHUNK).select("__key", "cluster")
    if sized.where(F.col("size") > CHUNK).take(1):
        known = components(links).select(F.col("node").alias("__key"), "component")
        dealt = sized.where(F.col("size") > CHUNK).select("__key").join(known, "__key", "left")
        whole = whole.union(dealt.select("__key", F.coalesce("component", "__key")))
    placed = reps.join(bounded(stored(whole, "whole")), "__key", "left").withColumn("cluster", F.coalesce("cluster", "__key")).drop("bands")
    pairs = stored(block_pairs(placed, t), "pairs")
    forget(reps)
    release(spark)
    if pairs.take(1):
        links = links.union(similar_pairs(docs, pairs, n, t))
    if not links.take(1):
        return member.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"))
    final = components(links).select(F.col("node").alias("rep"), "component")
    return member.join(final, "rep", "left").select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
