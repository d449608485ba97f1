"""The registered queries and the pipeline's stages over small folders with odd rows, against plain versions of each contract."""

import hashlib
import io
import random
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F
from test_near import Sets, plain_line, true_links
from test_repeats import plain

import corpus_pipeline
from tabulon.llm import bpe, embeddings, quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sample():
    rng = random.Random(12)
    passage, line = prose(rng, 60), "a line of boiler plate that very many documents share"
    out = [(None, None), (1, ""), (1, ""), (2, " \t\n\x0b"), (3, "one"), (3, "one"), (4, "x " * 4000), (5, "naïve Ünïcode 漢字 😀 THE end"), (None, "no id here but text")]
    for i in range(10, 70):
        words = prose(rng, rng.randrange(20, 120)).split()
        if i % 6 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage.split()
        if i % 5 == 0:
            words[len(words) // 2 : len(words) // 2] = ["\n" + line + "\n"]
        out.append((i, " ".join(words)))
    out += [(100 + i, out[20 + i][1]) for i in range(8)] + [(200 + i, out[30 + i][1] + " more") for i in range(8)]
    return [(k, t, "en", None if i % 9 == 4 else f"s{i % 4}", len(t or "")) for i, (k, t) in enumerate(out)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = sample()
    clash = {c: F.lit("clash") for c in ("score", "taken", "component", "id", "key", "h", "pos", "line", "doc", "copies", "n_lines_", "goes", "row")}
    spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(3).write.parquet(f"{path}/documents.parquet")
    ids = sorted({r[0] for r in rows if r[0] is not None})
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    vectors = [(i, (base[i % 12] + rng.normal(size=16) * 0.05).tolist(), i % 2 if i % 11 else None) for i in range(60)]
    vectors += [(60, None, 0), (61, [0.0] * 16, 0), (62, [1e300] * 16, 1), (63, [1e300] * 15 + [9e299], 1), (64, [None] * 16, 1), (65, [float("inf")] * 16, 1), (66, vectors[1][1], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows, vectors


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def run(spark, folder, name, types):
    got = queries.QUERIES[name](spark, folder)
    assert dict(got.dtypes).items() >= types.items()
    return [r.asDict() for r in got.collect()]


def bag(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_all_give_nothing_for_nothing(spark, empty_folder):
    for name, q in queries.QUERIES.items():
        assert q(spark, empty_folder).count() == 0, name
    assert corpus_pipeline.run(spark, empty_folder).count() == 0


def test_op1(spark, folder):
    path, rows, _ = folder
    got = run(spark, path, "op1_mix", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    assert bag((r["doc_id"], r["size"]) for r in got) == bag((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    sums = {}
    for r in rows:
        sums[r[3]] = sums.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sums.values()), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sums[s]]
        target |= {s: 2.0 * sums[s] if s in full else weight[s] * level for s in (full or open_)}
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    for r in got:
        assert any(r["source_size"] == sums[s] and abs(r["target"] - target[s]) < 1e-6 for s in names) and 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(sums.values())) <= max(r["size"] for r in got)
    again = run(spark, path, "op1_mix", {})
    assert bag(tuple(r.values()) for r in again) == bag(tuple(r.values()) for r in got)


def test_op2_and_op3(spark, folder):
    path, rows, _ = folder
    tokens = {i: (r[1] or "").encode().split() for i, r in enumerate(rows)}
    want = [(rows[i][0], len(g), sum(g), sha(b" ".join(w for w, x in zip(tokens[i], g, strict=True) if not x))) for i, g in plain(tokens, 35).items()]
    got = run(spark, path, "op2_word_repeats", {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"})
    assert bag((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == bag(want)
    data = {i: (r[1] or "").encode() for i, r in enumerate(rows)}
    spans = lambda g: sum(x and (j == 0 or not g[j - 1]) for j, x in enumerate(g))
    want = [(rows[i][0], len(g), sum(g), spans(g), sha(bytes(b for b, x in zip(data[i], g, strict=True) if not x))) for i, g in plain(data, 400).items()]
    got = run(spark, path, "op3_byte_repeats", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    assert bag((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == bag(want)


def statistics_of(texts):
    data = [t.encode() for t in texts]
    return quality.statistics(np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0, *map(len, data)]))


def test_op4(spark, folder):
    """Scores against densities by plain numpy."""
    path, rows, _ = folder
    got = run(spark, path, "op4_quality", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 5 == 0
    x = statistics_of([r[1] or "" for r in rows])
    part = {y: x[[i for i, r in enumerate(rows) if r[0] is not None and not held(r[0]) and int(r[0] % 3 > 0) == y]] for y in (0, 1)}
    n = sum(map(len, part.values()))
    cov = {y: np.cov(p.T, bias=True) for y, p in part.items()}
    pooled = sum(len(part[y]) * cov[y] for y in (0, 1)) / n
    log = []
    for y in (0, 1):
        c = 0.9 * cov[y] + 0.05 * np.diag(np.diag(cov[y])) + 0.05 * pooled + 1e-3 * np.eye(len(pooled))
        d = x - part[y].mean(axis=0)
        log.append(np.log(len(part[y]) / n) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (d * np.linalg.solve(c, d.T).T).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -30, 30)))
    have = sorted((str(r["doc_id"]), r["score"]) for r in got)
    for (k, a), (j, b) in zip(have, sorted((str(r[0]), s) for r, s in zip(rows, want, strict=True)), strict=True):
        assert k == j and abs(a - b) < 1e-6
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_statistics_of_a_text():
    """Each text alone has the statistics that it has among others."""
    texts = ["", "One two two two.\nTHREE!! 44 $$", " \n", "漢字 mixed Ünï", "x " * 50]
    together = statistics_of(texts)
    assert np.allclose(together, np.concatenate([statistics_of([t]) for t in texts]))
    row = dict(zip(quality.NAMES, together[1], strict=True))
    assert np.isclose(row["words"], np.log1p(7)) and np.isclose(row["distinct"], np.log1p(6) / np.log1p(7) * 4) and np.isclose(row["repeat"], np.log(1 / 12 + 0.01))


def test_op5(spark, folder):
    from tokenizers import Tokenizer

    path, rows, _ = folder
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = run(spark, path, "op5_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    assert bag((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == bag(want)


def signed64(x):
    return x - (1 << 64) if x >> 63 else x


def without_similar_lines(rows):
    """Texts less all but the first of similar lines; rows equal in id and text are one document."""
    order = sorted({(r[0] is None, r[0] or 0, signed64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)), r[1]) for r in rows if r[1] is not None})
    seen: dict[str, int] = {}
    for *_, t in order:
        for x in map(plain_line, t.split("\n")):
            if x:
                seen.setdefault(x, len(seen))
    sets = Sets()
    for a, b in true_links(list(seen)):
        sets.join(a, b)
    first, kept = set(), {}
    for null, k, _, t in order:
        stay = []
        for x in t.split("\n"):
            group = sets.find(seen[p]) if (p := plain_line(x)) else None
            if group is None or group not in first:
                stay.append(x)
            first.add(group)
        kept[None if null else k, t] = "\n".join(stay)
    return [(r[0], 0 if r[1] is None else r[1].count("\n") + 1, kept.get((r[0], r[1]))) for r in rows]


def test_op6(spark, folder):
    path, rows, _ = folder
    want = [(k, n, n - (t.count("\n") + 1 if t else int(n > 0 and t == "" and r[1] == "")), sha((t or "").encode())) for (k, n, t), r in zip(without_similar_lines(rows), rows, strict=True)]
    got = run(spark, path, "op6_lines", {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"})
    assert bag((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in got) == bag(want)


def test_op7(spark, folder):
    path, _, vectors = folder
    unit = {}
    for k, v, label in vectors:
        if label is not None and v is not None and all(e is not None and np.isfinite(e) for e in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            unit[k] = x / np.linalg.norm(x), label
    links, sets = dict.fromkeys([v[0] for v in vectors], 0), Sets()
    for a, (x, la) in unit.items():
        for b, (y, lb) in unit.items():
            if a != b and la == lb and x @ y >= 0.98:
                links[a] += 1
                sets.join(a, b)
    got = run(spark, path, "op7_embeddings", {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})
    assert bag((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == bag((k, n, sets.find(k), sets.find(k) == k) for k, n in links.items())


@pytest.mark.parametrize("hashes", [1, 2, 3, 4])
def test_op7_buckets_reach_their_recall(hashes):
    """Pairs just above the cosine, of random vectors, share a bucket of some table."""
    rng = np.random.default_rng(hashes)
    for width in (64, 384):
        x = rng.normal(size=(400, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        r = rng.normal(size=x.shape)
        r -= (r * x).sum(axis=1, keepdims=True) * x
        y = 0.981 * x + np.sqrt(1 - 0.981**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
        a, b = embeddings.codes(x, embeddings.TABLES, hashes), embeddings.codes(y, embeddings.TABLES, hashes)
        meet = (a[:, :, :1] == b).any(axis=(1, 2)) | (b[:, :, :1] == a).any(axis=(1, 2))
        assert meet.mean() >= 0.95


def test_op8(spark, folder):
    path, rows, _ = folder

    def fingerprint(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [(r[0], fingerprint(r[1])) for r in rows]
    distinct, sets = sorted({p for _, p in prints}), Sets()
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                sets.join(a, b)
    least: dict[int, int] = {}
    for k, p in prints:
        if k is not None:
            least[sets.find(p)] = min(k, least.get(sets.find(p), k))
    got = run(spark, path, "op8_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    assert bag((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == bag((k, f"{p:016x}", least.get(sets.find(p))) for k, p in prints)


def test_op9(spark, folder):
    path, rows, _ = folder
    got = run(spark, path, "op9_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert bag([r["doc_id"]] for r in got) == bag([r[0]] for r in rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    texts = {}
    for r in got:
        texts.setdefault(dict((k, t) for k, t, *_ in rows).get(r["doc_id"]), set()).add(r["score"]) if r["doc_id"] is not None else None
    assert all(len(s) == 1 for s in texts.values())


def test_a_machine_adds_up_all_pairs():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [np.array(r, dtype=np.int32) for r in ([1, 4, 5, 8], [], [0, 2])]
    for r, z in zip(rows, machine.sums(rows), strict=True):
        x = 1 / np.sqrt(max(1, len(r)))
        assert np.isclose(z, 0.3 + sum(machine.weights[i] * x for i in r) + sum(machine.factors[i] @ machine.factors[j] * x * x for i in r for j in r if i < j), atol=1e-5)


def test_op10(spark, folder):
    path, rows, _ = folder
    types = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    got = run(spark, path, "op10_media", types)
    want, features = [], {}
    for k, t, *_ in rows:
        data = (t or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(padded)
        media = out.getvalue()
        want.append((k, len(data), len(padded), sha(padded), zlib.crc32(padded[-64:]), len(media), sha(media)))
    assert bag((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in got) == bag(want)
    for r in got:
        assert features.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
        assert r["feature"].startswith("mean=")


def test_stages_against_plain_versions(spark, folder):
    path, rows, _ = folder
    docs = spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    names = corpus_pipeline.COLUMNS
    score = {(r["doc_id"], r["score"]) for r in queries.QUERIES["op4_quality"](spark, path).collect()}
    kept = stages["quality"](spark, docs, path)
    assert kept.columns == names
    by_id = {k: s for k, s in score if k is not None}
    assert bag(tuple(r) for r in kept.where("doc_id IS NOT NULL").collect()) == bag(r for r in rows if r[0] is not None and by_id[r[0]] >= 0.3)
    lines = stages["lines"](spark, docs, path)
    assert lines.columns == names and bag((r["doc_id"], r["text"]) for r in lines.collect()) == bag((k, t) for k, _, t in without_similar_lines(rows))
    prints = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op8_simhash"](spark, path).collect() if r["doc_id"] is not None}
    one = stages["simhash"](spark, docs, path)
    assert one.columns == names and bag([r["doc_id"]] for r in one.where("doc_id IS NOT NULL").collect()) == bag([k] for k in {v for v in prints.values() if v is not None})
    mixed = stages["mix"](spark, docs, path)
    taken = {}
    for r in queries.QUERIES["op1_mix"](spark, path).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    words = sum(len(WORD.findall(r[1] or "")) for r in rows)
    assert mixed.columns == names and abs(sum(got.values()) - 1.5 * words) <= 4000
    assert sum(abs(taken.get(k, 0) - got.get(k, 0)) for k in taken) <= 0.1 * words  # the two shuffle by other names
    coded = stages["bpe"](spark, docs, path)
    assert bag((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in coded.collect()) == bag((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in queries.QUERIES["op5_bpe"](spark, path).collect())


def test_equal_rows_are_mixed_as_often_as_each(spark, tmp_path):
    """Rows repeated in full: together as often as the mix takes them, whether the cut falls among them or not."""
    rows = [(7, "one two three four", "en", "a", 18)] * 9 + [(8, "five six", "en", "b", 8)] * 3
    got = corpus_pipeline.mixed(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    words = sum(len(r["text"].split()) for r in got)
    assert abs(words - 1.5 * 42) <= 4 and {tuple(r) for r in got} <= set(rows)
