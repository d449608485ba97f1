"""Repeated words and bytes against plain counting of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import byterepeats, repeats, wordrepeats


def plain(tokens, window):
    counts = Counter(tuple(t[i : i + window]) for t in tokens.values() for i in range(len(t) - window + 1))
    out = {}
    for k, t in tokens.items():
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if counts[tuple(t[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[k] = gone
    return out


@pytest.mark.parametrize(("window", "k"), [(35, 8), (12, 4)])
def test_words(spark, corpus, window, k):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in wordrepeats.remove_repeats(docs, window=window, anchor=k).collect()}
    tokens = {i: t.split() for i, t in corpus}
    for i, gone in plain(tokens, window).items():
        kept = " ".join(w for w, g in zip(tokens[i], gone, strict=True) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(gone), sum(gone), kept)


@pytest.mark.parametrize(("window", "k"), [(400, 32), (60, 16)])
def test_bytes(spark, corpus, window, k):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in byterepeats.remove_repeats(docs, window=window, anchor=k).collect()}
    tokens = {i: t.encode() for i, t in corpus}
    for i, gone in plain(tokens, window).items():
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(b for b, g in zip(tokens[i], gone, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(gone), sum(gone), spans, kept)


def test_long_texts_in_blocks():
    bounds = np.array([0, 5, 45, 52])
    parts = list(repeats.blocks_of(bounds, window=4, size=10))
    starts = [s for a, b, rows in parts for x, y in zip(a, b, strict=True) for s in range(x, y - 3)]
    assert sorted(starts) == [*range(0, 2), *range(5, 42), *range(45, 49)]


def test_merge_tells_repeats():
    runs = [byterepeats.sorted_run([b"abcdefgh", b"zzzzzz"], 4), byterepeats.sorted_run([b"xxcdefyy"], 4), byterepeats.sorted_run([b"qrst"], 4)]
    found = byterepeats.merge(runs, 4)
    windows = [{r[0][p : p + 4] for p in np.flatnonzero(f)} for r, f in zip(runs, found, strict=True)]
    assert windows == [{b"cdef", b"zzzz"}, {b"cdef"}, set()]


def test_odd_rows(odd_docs, no_docs):
    empty = hashlib.sha256(b"").hexdigest()
    words = wordrepeats.remove_repeats(odd_docs).collect()
    assert len(words) == odd_docs.count() and {r["n_words"] for r in words if r["doc_id"] in (None, 1, 2)} == {0}
    assert [(r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in words if r["doc_id"] == 4] == [(30000, empty)]
    data = byterepeats.remove_repeats(odd_docs).collect()
    assert [r["n_removed"] for r in data if r["doc_id"] == 4] == [60000] and [r["n_bytes"] for r in data if r["doc_id"] is None] == [0]
    assert wordrepeats.remove_repeats(no_docs).count() == 0 and byterepeats.remove_repeats(no_docs).count() == 0


def notices(window):
    """Texts that share a passage shorter than a window, and some of them a longer one, among different words."""
    rng = random.Random(7)
    word = lambda: f"u{rng.randrange(10**9)}"
    passage = [word() for _ in range(window - 1)]
    more = [word() for _ in range(window)]
    out = []
    for i in range(60):
        before, after = [word() for _ in range(window + i % 3)], [word() for _ in range(window)]
        if i % 10 == 0:
            before[-3:], after[:4] = more[:3], more[3:7]
        out.append((i, " ".join([*before, *passage, *after])))
    return [*out, out[5]]


@pytest.mark.parametrize(("window", "k"), [(35, 8), (12, 4)])
def test_hot_anchor_of_words_is_cut(spark, window, k):
    data = notices(window)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    named = repeats.one_each(docs.selectExpr("text", "xxhash64(doc_id, text) AS doc"))
    found = repeats.repeated_segments(named, wordrepeats.word_values, window, k)
    _, chosen = repeats.bounded_segments(named, found, wordrepeats.word_values, window, k, 300)
    sizes = {r["anchor"]: r["n"] for r in chosen.groupBy("anchor").agg(F.sum(F.col("windows") + window - 1).alias("n")).collect()}
    assert max(sizes.values()) <= 300
    got = {r["doc_id"]: r for r in wordrepeats.remove_repeats(docs, window=window, anchor=k, most=300).collect()}
    tokens = {(j, i): t.split() for j, (i, t) in enumerate(data)}
    for (_, i), gone in plain(tokens, window).items():
        kept = " ".join(w for w, g in zip(dict(data)[i].split(), gone, strict=True) if not g)
        assert (got[i]["n_removed"], got[i]["kept"]) == (sum(gone), kept)


@pytest.mark.parametrize(("window", "k"), [(400, 32), (60, 16)])
def test_hot_anchor_of_bytes_is_cut(spark, window, k):
    data = notices(window // 10)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    named = repeats.one_each(docs.selectExpr("text", "xxhash64(doc_id, text) AS doc"))
    found = repeats.repeated_segments(named, byterepeats.byte_values, window, k, wide=True)
    _, chosen = repeats.bounded_segments(named, found, byterepeats.byte_values, window, k, 3000)
    assert max(r["n"] for r in chosen.groupBy("anchor").agg(F.sum(F.col("windows") + window - 1).alias("n")).collect()) <= 3000
    got = {r["doc_id"]: r for r in byterepeats.remove_repeats(docs, window=window, anchor=k, most=3000).collect()}
    for (_, i), gone in plain({(j, i): t.encode() for j, (i, t) in enumerate(data)}, window).items():
        kept = bytes(b for b, g in zip(dict(data)[i].encode(), gone, strict=True) if not g)
        assert (got[i]["n_removed"], bytes(got[i]["kept"])) == (sum(gone), kept)


def test_finer_levels_move_texts_of_hot_anchors_only(spark, monkeypatch):
    """Documents that share nothing, or little, are not read again for each level."""
    rng = random.Random(17)
    plain_ones = [(1000 + i, " ".join(f"v{rng.randrange(10**9)}" for _ in range(60))) for i in range(100)]
    data = [*notices(40), *plain_ones, plain_ones[0]]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    named = repeats.one_each(docs.selectExpr("text", "xxhash64(doc_id, text) AS doc"))
    found = repeats.repeated_segments(named, byterepeats.byte_values, 400, 32, wide=True)
    levels, finer = [], repeats.finer_segments
    monkeypatch.setattr(repeats, "finer_segments", lambda texts, *rest: levels.append(texts.count()) or finer(texts, *rest))
    repeats.bounded_segments(named, found, byterepeats.byte_values, 400, 32, 3000)
    assert len(levels) > 1 and set(levels) <= set(range(1, 61))


def test_shards_have_a_bounded_share():
    assert byterepeats.shard_count(0, 4) == 8 and byterepeats.shard_count(10**9 + 1, 4) == 1001


def test_rows_repeated_in_full_cost_as_much_as_one(spark):
    """Many rows of one id and text, of which one other document has a part."""
    rng = random.Random(3)
    words = [f"u{rng.randrange(10**9)}" for _ in range(120)]
    data = [(1, " ".join(words))] * 3000 + [(2, " ".join(words[40:90] + words[:20]))]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    segments = repeats.segment_table(repeats.one_each(docs.selectExpr("text", "xxhash64(doc_id, text) AS doc")), wordrepeats.word_values, 35, 8)
    assert segments.count() < 40
    got = wordrepeats.remove_repeats(docs).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("n_removed").alias("a"), F.max("n_removed").alias("b")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 3000, 120, 120), (2, 1, 50, 50)]
    got = byterepeats.remove_repeats(docs, window=60, anchor=16).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("n_removed").alias("a"), F.max("n_removed").alias("b")).orderBy("doc_id").collect()
    assert got[0]["rows"] == 3000 and got[0]["a"] == got[0]["b"] == len(data[0][1]) and got[1]["a"] > 0
