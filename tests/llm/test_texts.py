"""Classifiers, tokens, media, pipeline."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import bpe, media, quality, toxicity


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz" * 2 + "éèßüñó0123456789'!?.,-ΣİАбв中文😀 \t\n\x85　\x1c\x1f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(rng.choice("aho!=-") for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "a<|endoftext|>B c<|startoftext|>", "a" * 500, "!" * 200, "It's we'll I'd THEY'RE"]
    encoder = bpe.Encoder(bpe.vocabulary_path())
    for group in bpe.groups(texts, 1000):
        for text, (ids, decoded) in zip(group, encoder.encode(group), strict=True):
            e = want.encode(text, add_special_tokens=False)
            assert memoryview(ids).cast("I").tolist() == e.ids, text
            assert decoded == want.decode(e.ids, skip_special_tokens=False)


def test_bpe_table_of_several_groups_in_a_batch(spark):
    texts = {i: f"word{i} another one. " * n for i, n in enumerate((30_000, 3, 40_000, 0, 50_000, 2))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    want = {i: (len(ids) // 4, d) for i, (ids, d) in zip(texts, bpe.Encoder(bpe.vocabulary_path()).encode(list(texts.values())), strict=True)}
    got = bpe.encode_table(docs, bpe.vocabulary_path(), full=True).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["decoded"]) for r in got} == want and len(got) == len(texts)


def test_bpe_table(odd_docs, no_docs):
    rows = bpe.encode_table(odd_docs, bpe.vocabulary_path(), full=True).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], dtype="<u4").tobytes()).hexdigest()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (None, 1, 2)} == {0}
    assert bpe.encode_table(no_docs, bpe.vocabulary_path()).count() == 0


def marked(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [f"{rng.choice('bcdfgmnst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'ing', 'er'])}" for _ in range(rng.randrange(30, 200))]
        good, toxic = i % 3 != 0, i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["blurgh", "snargle,", "frumpo"]))
        text = " ".join(w if good else f"{w}{rng.choice(['###', '%%%', ' |'])}" for w in words)
        rows.append((i, text.capitalize() + ".", int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def right(got, marks, label):
    return got.join(marks.select("doc_id", label), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_quality(spark, odd_docs, no_docs):
    m = marked(spark)
    got = quality.score_table(m.select("doc_id", "text"), m)
    assert right(got, m, "quality") > 0.95
    for r in got.take(50):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    none = m.where("1 = 0")
    assert {r["score"] for r in quality.score_table(odd_docs, none).collect()} == {0.5}
    assert quality.score_table(odd_docs, m).count() == odd_docs.count()
    assert quality.score_table(no_docs, m).count() == 0
    kept = quality.keep_good(m.select("doc_id", "text"), m)
    assert kept.columns == ["doc_id", "text"] and abs(kept.count() - m.where("quality = 1").count()) < 20


def test_scores_do_not_depend_on_ids(spark):
    m = marked(spark, 200)
    twice = m.select("doc_id", "text").union(m.select(F.col("doc_id") + 100_000, "text"))
    rows = quality.score_table(twice, m).collect()
    by = {r["doc_id"]: r["score"] for r in rows}
    assert all(by[i] == by[i + 100_000] for i in range(200))


def test_toxicity(spark, odd_docs, no_docs):
    m = marked(spark, 2000)  # no term is chosen beforehand, so that it takes more rows to learn which ones tell
    got = toxicity.score_table(m.select("doc_id", "text"), m)
    assert right(got, m, "toxic") > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.take(50))
    assert {r["score"] for r in toxicity.score_table(odd_docs, m.where("1 = 0")).collect()} == {0.0}
    assert toxicity.score_table(odd_docs, m).count() == odd_docs.count()
    assert toxicity.score_table(no_docs, m).count() == 0


def test_machine_learns_a_pair():
    """Two terms that only tell something together."""
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(3000)]
    y = np.array([int({0, 1} <= set(r.tolist())) for r in rows])
    machine = toxicity.train(rows[:2000], y[:2000], np.ones(2000), inputs=6)
    machine = toxicity.scaled(machine, rows[2000:], y[2000:], np.ones(1000))
    assert np.mean((machine.scores(rows) > 0.5) == y) > 0.95
    assert machine.factors[0] @ machine.factors[1] > 0


def test_toxicity_of_a_pair_of_words(spark):
    """Words that are as frequent in either class, and toxic only where both stand."""
    rng = random.Random(2)
    rows = []
    for i in range(2400):
        words = [f"{rng.choice('bcdfgm')}{rng.choice('aeiou')}{rng.choice('lnrst')}" for _ in range(12)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["blurgh"] * a + ["snargle"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    m = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_table(m.select("doc_id", "text"), m).join(m.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    hit = got["score"][got["toxic"] == 1].to_numpy()[:, None] > got["score"][got["toxic"] == 0].to_numpy()[None]
    assert hit.mean() > 0.9  # the area under the curve; either word alone tells nothing


def told(text):
    data = (text or "").encode()
    padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    return len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), 44 + len(padded)


def test_only_chunks_that_many_ask_for_have_copies(spark):
    asked = spark.range(500).select(F.col("id").alias("row_id"), F.lit(0).alias("place"), F.when(F.col("id") < 300, 0).otherwise(F.col("id")).cast("string").cast("binary").alias("digest"))
    shared = asked.select("digest").distinct().withColumn("stored", F.concat(F.lit("of "), F.col("digest").cast("string")))
    assert [(bytes(r[0]), r[1]) for r in media.often_asked(asked, 100).collect()] == [(b"0", 3)]
    for limit in (1000, 0):  # broadcast, and joined
        got = media.fetch(asked, shared, limit, 100).collect()
        assert sorted((r["row_id"], r["stored"]) for r in got) == [(i, f"of {0 if i < 300 else i}") for i in range(500)]


def test_media(spark, corpus, odd_docs, no_docs):
    long = " ".join(t for _, t in corpus) * 2
    data = [*corpus, (3000, long), (3001, long[5000:]), (3002, long), (3003, "x" * 40000), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    for limit in (media.MOST_SHARED, 0):  # shared digests broadcast, and joined
        stored = media.store(docs, "doc_id", "text", limit)
        assert stored.where(F.exists("chunks", lambda c: c["data"].isNull())).count() > 0
        got = media.read_back(stored, "doc_id").collect()
        assert len(got) == len(data)
        want = dict(data)
        for r in got:
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == told(want[r["doc_id"]])
    assert media.media_table(odd_docs).count() == odd_docs.count() and media.media_table(no_docs).count() == 0


def pieces(data):
    ends = media.cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_chunks_move_with_their_content():
    data = random.Random(3).randbytes(60_000)
    assert b"".join(pieces(data)) == data
    assert len(set(pieces(data)) & set(pieces(b"some bytes before" + data))) > 0.8 * len(pieces(data))


def test_pipeline_stages(spark, corpus, tmp_path):
    m = marked(spark, 150)
    docs = m.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in corpus[:60]], "doc_id long, text string"))
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")), "n_chars": F.length("text").cast("long"), "extra": F.lit(1)})
    m.select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [now.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(now.count())
    start, good, lines, near, mixed, encoded = counts
    assert good < start and lines == good and near < lines and mixed > near and encoded == mixed
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == encoded
