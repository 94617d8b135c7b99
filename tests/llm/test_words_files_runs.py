"""The operators on spelling, token files and periodic runs against plain versions, and their odd cases."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.llm import queries, runs, spelling, tokenfiles
from test_operators import BYTE_BPE, ODD, documents, table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=60), max_size=8))
def test_runs_equal_plain(docs):
    texts = [" ".join(d) for d in docs]
    _, found, collapsed = runs.runs_of(pa.array(texts, pa.string()))
    for d, rs, c in zip(docs, found.to_pylist(), collapsed.to_pylist(), strict=True):
        expected = brute.periodic_runs(d)
        assert [(r["start"], r["length"], r["period"]) for r in rs] == expected
        assert c == brute.collapsed(d, expected)


def test_runs_of_long_periods_and_blocks(monkeypatch):
    rng = random.Random(4)
    docs = []
    for period in (1, 2, 5, 11, 12, 37, 150):
        unit = [f"w{rng.randrange(50)}" for _ in range(period)]
        docs += [[*(f"x{k}" for k in range(rng.randrange(9))), *(unit * 9)[: max(12, 2 * period) + cut], "end"] for cut in (-1, 0, 1, period // 2)]
    expected = [brute.periodic_runs(d) for d in docs]
    for pairs in (1 << 18, 7):
        monkeypatch.setattr(runs, "PAIRS", pairs)
        found = runs.runs_of(pa.array([" ".join(d) for d in docs]))[1].to_pylist()
        assert [[tuple(r.values()) for r in rs] for rs in found] == expected


def test_runs_where_hashes_collide(monkeypatch):
    """Words are compared themselves: where all hashes agree, the document is searched without them."""
    monkeypatch.setattr(runs.Words, "hashes", lambda self: np.full(len(self.starts), 1 << 60, np.uint64))
    docs = [["a", "b"] * 9, [f"w{k}" for k in range(30)], ["a"] * 20 + ["b"] * 20, []]
    found = runs.runs_of(pa.array([" ".join(d) for d in docs]))[1].to_pylist()
    assert [[tuple(r.values()) for r in rs] for rs in found] == [brute.periodic_runs(d) for d in docs]


def test_runs_query_equals_plain(spark, sf_dir):
    texts = {d["doc_id"]: d["text"] for d in documents(spark, sf_dir)}
    rows, some = queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        words = brute.with_tail(r["doc_id"], brute.WORD.findall(texts[r["doc_id"]] or ""))
        found = brute.periodic_runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        some += bool(found)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (found and 1000 * best[1] // best[2] or None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute.collapsed(words, found).encode()).hexdigest()
    assert some > 10


def test_runs_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "GROUP", 100)
    texts = [*ODD, "a b " * 30, *ODD, "w " * 200_000]
    docs = table(spark, texts).withColumns({c: F.lit(7) for c in ("Runs", "collapsed", "_runs", "start")})
    rows = runs.periodic_runs(docs.union(docs)).orderBy("doc_id").collect()
    for r, t in zip(rows, [t for t in texts for _ in "12"], strict=True):
        words = brute.WORD.findall(t or "")
        found = [(0, len(words), 1)] if len(words) > 10_000 else brute.periodic_runs(words)
        assert [tuple(x) for x in r["runs"]] == found and r["collapsed"] == brute.collapsed(words, found) and r["n_words"] == len(words) and r["start"] == 7
    assert runs.periodic_runs(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300), min_size=1, max_size=9), st.integers(0, 3))
def test_token_file_round_trip(docs, nulls):
    """Every run of ids, and any ids in any order, read by rank directories."""
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    keys = [None if k < nulls else k * 3 for k in range(len(docs))]
    held = tokenfiles.TokenFile(tokenfiles.pack(ids, keys, ends))
    assert held.keys == keys and held.ends.tolist() == ends.tolist() and held.n == len(ids)
    rng = np.random.default_rng(len(ids))
    places = rng.integers(0, len(ids), 50)
    assert held.ids(places).tolist() == ids[places].tolist() and held.ids(np.arange(len(ids))).tolist() == ids.tolist()
    for a, b in [(0, len(ids)), *zip([0, *ends], ends), *np.sort(rng.integers(0, len(ids) + 1, (20, 2)), 1)]:
        assert held.run(int(a), int(b)).tolist() == ids[a:b].tolist()


def test_token_file_of_one_level_and_none():
    assert tokenfiles.TokenFile(tokenfiles.pack(np.zeros(0, np.uint32), [], np.zeros(0, int))).run(0, 0).tolist() == []
    assert tokenfiles.TokenFile(tokenfiles.pack(np.arange(200), [1], np.array([200]))).run(50, 60).tolist() == list(range(50, 60))
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(b"PAR1" + bytes(60))


def test_token_files_query_equals_library(spark, sf_dir, monkeypatch):
    from tokenizers import Tokenizer

    library, start, expected = Tokenizer.from_file(BYTE_BPE), 0, {}
    for d in documents(spark, sf_dir):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        expected[d["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for size in (1 << 18, 5000):
        monkeypatch.setattr(tokenfiles, "FILE_IDS", size)
        rows = queries.QUERIES["op12_token_files"](spark, sf_dir).collect()
        assert len(rows) == len(expected) and {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows} == expected


def test_token_files_odd_rows_and_any_place(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "FILE_IDS", 300)
    library, texts = Tokenizer.from_file(BYTE_BPE), [*ODD, "a b c", "word " * 2000]
    docs = table(spark, texts).withColumns({c: F.lit(7) for c in ("key", "tie", "part", "ids", "start", "content")})
    docs = docs.union(docs.where("doc_id = 5")).union(docs.where("doc_id IN (2, 6)").withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    tokenfiles.write_files(docs, BYTE_BPE, f"{tmp_path}/files", end_id=0)
    files = tokenfiles.open_files(spark, f"{tmp_path}/files")
    rows = tokenfiles.documents_of(files).orderBy("start").collect()
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    assert [r["doc_id"] for r in rows] == [None, None, *sorted([*range(len(texts)), 5])]
    assert sorted(bytes(r["ids"]) for r in rows[:2]) == sorted(np.array(ids[k], "<u4").tobytes() for k in (2, 6))
    assert all(bytes(r["ids"]) == np.array(ids[r["doc_id"]], "<u4").tobytes() for r in rows[2:])
    whole = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4")
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist() and files.count() > 2
    asked = [0, 5, 5, len(whole) - 1, 299, 300, 301, 2000, -1, len(whole), None]
    found = tokenfiles.ids_at(files, spark.createDataFrame([(a,) for a in asked], "place long")).collect()
    assert {r["place"]: r["id"] for r in found} == {a: int(whole[a]) for a in (0, 5, len(whole) - 1, 299, 300, 301, 2000)} and len(found) == 7
    tokenfiles.write_files(docs.limit(0), BYTE_BPE, f"{tmp_path}/none")
    none = tokenfiles.open_files(spark, f"{tmp_path}/none")
    assert none.count() == 0 and tokenfiles.documents_of(none).count() == 0


def spelled(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("ab\u00e9", min_size=2, max_size=7), max_size=60), st.integers(1, 9))
def test_near_pairs_equal_plain(words, block):
    """Each near pair once, whatever the blocks; distances are recomputed for all pairs."""
    names = sorted(words)
    old, spelling.PAIRS = spelling.PAIRS, block
    try:
        found = [frozenset((names[a], names[b])) for u, v in spelling.near_pairs(names, np.full(len(names), 3), np.arange(len(names))) for a, b in zip(u, v, strict=True)]
    finally:
        spelling.PAIRS = old
    assert len(found) == len(set(found)) and set(found) == {frozenset((a, b)) for a in names for b in names if a < b and brute.edit_distance(a, b) == 1}


def test_shards_hold_segments_at_any_place():
    """The automaton scans whole words: a segment within one is a hit that is not counted."""
    words = ["abcdefgh", "xxabcdxx", "xxxxefgh", "abcdefxh"]
    shard = spelling.Shard(words, np.array([3, 0, 0, 0]))
    who, lists = shard.hits(np.arange(4))
    assert sorted(zip(who.tolist(), (lists % 2).tolist(), strict=True)) == [(0, 0), (0, 1), (2, 1), (3, 0)]


@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 17), (40, 25)])
def test_spelling_query_equals_plain(spark, sf_dir, monkeypatch, sizes):
    """Also with many small shards, of which most are cut into tiles."""
    monkeypatch.setattr(spelling, "SHARD", sizes[0])
    monkeypatch.setattr(spelling, "TILE", sizes[1])
    if sizes[0] == 40:
        counts = dict(sorted(brute.spelling_words(documents(spark, sf_dir)).items(), key=lambda x: zlib.crc32(x[0].encode()))[:1500])
        found = spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    else:
        counts, found = brute.spelling_words(documents(spark, sf_dir)), queries.QUERIES["op11_spelling_variants"](spark, sf_dir).collect()
    expected = brute.spelling_groups(counts)
    assert len(found) == len(counts) and spelled(found) == expected and sum(e[0] is not None for e in expected.values()) >= (10 if len(found) > 2000 else 0)


def test_spelling_odd_rows_and_long_chains(spark):
    rng = random.Random(8)
    chain = ["letterhead", "letterheax", "letterhezx", "letterhxzx"]
    long = "q" * 4000
    texts = [None, "", " 12 ", *ODD, *(" ".join([w] * 2 * 11**k) for k, w in enumerate(chain[::-1])), f"{long} {long} {long}z {long}z", "r" * 9000, "r" * 9000, "ÉTÉESTBON ÉtÉestbon x\u00d7\u00d7\u00d7\u00d7\u00d7\u00d7 x\u00d7\u00d7\u00d7\u00d7\u00d7\u00d7"]
    texts += [" ".join(rng.choices(["prefixes", "prefixed", "prefixez", "prefxes", "sprefixes"], k=40)) for _ in range(3)]
    docs = table(spark, texts).withColumns({c: F.lit(7) for c in ("word", "key", "shard")})
    docs = docs.union(docs.limit(20)).union(docs.where("doc_id > 40").withColumn("doc_id", F.lit(None).cast("long")))
    plain = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    for spoil in (0, 5):
        counts = brute.spelling_words(plain, spoil or 1 << 40)
        counts = spelled_nulls(plain, spoil) if spoil else counts
        found = spelling.spelling_groups(spelling.word_counts(docs, spoil=spoil)).collect()
        assert spelled(found) == brute.spelling_groups(counts)
    assert spelling.spelling_groups(spelling.word_counts(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.word_counts(docs, least_chars=1)
    chained = {r["word"]: r["root"] for r in spelling.spelling_groups(spelling.word_counts(docs)).collect()}
    assert {chained[w] for w in chain} == {"letterhead"}


def spelled_nulls(docs, spoil):
    return brute.spelling_words([{"doc_id": "null" if d["doc_id"] is None else d["doc_id"], "text": d["text"]} for d in docs], spoil)
