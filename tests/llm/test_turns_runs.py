"""Conversation repair, periodic runs and token files, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import bpe, queries, repair, runs, tokenfiles

BLANKS = " \t\n\x0b\x0c\r"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- repair


def all_repairs(rows, most_inserts=3):
    """Every way to edit a few rows: (cost, audit)."""
    out = []

    def go(i, cost, audit, faces, inserts):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", faces):
            out.append((cost, audit))
        for r in "ua" if inserts < most_inserts else "":
            go(i, cost + 3, audit + "I", faces + r, inserts + 1)
        if i < len(rows):
            initial, faulty, cut = rows[i]
            go(i + 1, cost + 4, audit + "D", faces, inserts)
            if not faulty:
                go(i + 1, cost + 3 * cut, audit + "K", faces + initial, inserts)
                for r in "ua":
                    go(i + 1, cost + 3 + 3 * cut, audit + "R", faces + r, inserts)

    go(0, 0, "", "", 0)
    return min(out)


def plain_repair(rows):
    """By a table of the best (cost, audit) for each number of rows and state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    now = {0: (0, "")}
    for row in [*rows, None]:
        for _ in range(4):
            for s, (c, a) in list(now.items()):
                for r in "ua":
                    if (t := step.get((s, r))) is not None and ((c + 3, a + "I") < now.get(t, (1 << 60, ""))):
                        now[t] = c + 3, a + "I"
        if row is None:
            return min(now[s] for s in (0, 3) if s in now)
        after = {}

        def put(t, v, after=after):
            if t is not None:
                after[t] = min(v, after.get(t, (1 << 60, "")))

        initial, faulty, cut = row
        for s, (c, a) in now.items():
            put(s, (c + 4, a + "D"))
            if not faulty:
                put(step.get((s, initial)), (c + 3 * cut, a + "K"))
                for r in "ua":
                    put(step.get((s, r)), (c + 3 + 3 * cut, a + "R"))
        now = after


def faces(rng, n, roles="suauaua"):
    return [(rng.choice(roles), rng.random() < 0.15, rng.random() < 0.3) for _ in range(n)]


def test_derivation_is_the_least_of_all_edits(monkeypatch):
    rng = random.Random(3)
    for _ in range(60):
        rows = faces(rng, rng.randrange(4), "suax ")
        assert repair.best_repair(rows) == all_repairs(rows) == plain_repair(rows)
    monkeypatch.setattr(repair, "BLOCK", 3)
    for _ in range(400):
        rows = faces(rng, rng.randrange(25))
        assert repair.best_repair(rows) == plain_repair(rows)
        assert repair.derivations(rows, 0, [repair.GOAL])[repair.GOAL] == plain_repair(rows)


def plain_conversations(rows, plant=True):
    """conv_id -> result columns. rows: (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        live = []
        for _, turn, role, text in sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
            role, text = role if role is not None else " ", text if text is not None else " "
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if plant else 9
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            role = "user" if h == 4 else role
            live += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in live:
            blank, again = not text.strip(BLANKS), (role, text) in seen
            cut = not blank and text.rstrip(BLANKS)[-1] not in ".!?"
            seen.add((role, text))
            marks.append((role[:1], blank or again, cut))
            for i, x in enumerate((blank, again and not blank, cut and not again)):
                counts[i] += x
        turns = [t for t, _, _ in live if t is not None]
        initials = [r[:1] for _, r, _ in live]
        cost, audit = plain_repair(marks)
        lines, left, state = [], list(live), ""
        for e in audit:
            made = "assistant" if state == "u" else "user"
            if e != "I":
                _, role, text = left.pop(0)
            if e != "D":
                lines.append(f"{role if e == 'K' else made}:{'' if e == 'I' else text}")
                state = lines[-1][0]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, sha("\n".join(lines)))
    return out


def conversations():
    rng = random.Random(11)
    out = []
    for c in [None, *range(60)]:
        for t in range(rng.randrange(1, 9)):
            role = "system" if t == 0 and rng.random() < 0.3 else ("user", "assistant")[t % 2] if rng.random() < 0.9 else rng.choice(["tool", "", "user", None])
            text = rng.choice([f"{prose(rng, 5)}.", f"{prose(rng, 4)}!\n", "same words.", "no end", "", " \t\x0b", None, "é漢?"])
            out.append((c, None if rng.random() < 0.05 else t + (t > 5) * 3, role, text))
    out += [(7, 1, "user", "a tie."), (7, 1, "assistant", "a tie."), (7, 1, "user", "a tie."), (8, None, None, None), (90, None, "user", "x."), (91, 5, "user", "x" * 50_000 + "?")]
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("turns"))
    rows = conversations()
    clash = {c: F.lit("clash") for c in ("conv", "seq", "row", "result", "live", "cost", "idx", "h")}
    spark.createDataFrame(rows, TURNS).withColumns(clash).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path, rows


def test_op11(spark, turns):
    path, rows = turns
    got = queries.QUERIES["op11_repair"](spark, path)
    assert {"conv_id": "bigint", **dict.fromkeys(COLUMNS[:6], "bigint"), "audit": "string", "repaired_sha256": "string"} == dict(got.dtypes)
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == plain_conversations(rows)
    assert got.count() == len({r[0] for r in rows})


def test_conversations_cut_into_blocks_give_the_same(spark, turns, monkeypatch):
    monkeypatch.setattr(repair, "LONG", 2)
    monkeypatch.setattr(repair, "BLOCK", 2)
    path, rows = turns
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_repair"](spark, path).collect()} == plain_conversations(rows)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(5)
    rows = [(1, t, ("user", "assistant")[t % 2] if rng.random() < 0.97 else "user", rng.choice(["same.", f"{t}.", f"{t}", f"w{t % 900}!"])) for t in range(12_000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(2, 40) for t in range(4)]
    got = repair.repair(spark.createDataFrame(rows, TURNS).repartition(5), full=True).collect()
    want = plain_conversations(rows, plant=False)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert all(sha("\n".join(r["repaired"])) == r["repaired_sha256"] for r in got)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in r["repaired"])) for r in got)


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(none).count() == 0
    assert repair.repair(spark.createDataFrame([(1, 1, "user", "x."), (1, 2, "user", "y.")], TURNS), F.lit(False)).first().asDict() == {"conv_id": 1, **dict.fromkeys(COLUMNS[:6], 0), "audit": "", "repaired_sha256": sha(""), "repaired": []}


# ---- runs


def plain_runs(s, exponent=4, least=6):
    out = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(all(s[i + k] == s[i + k + d] for k in range(n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def repetitive(rng):
    s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
    if len(s) > 8 and rng.random() < 0.6:
        a, p = rng.randrange(len(s)), rng.randrange(1, 9)
        s = s[:a] + [s[min(a + (i - a) % p, len(s) - 1)] for i in range(a, len(s))] + [rng.randrange(3) for _ in range(rng.randrange(8))]
    return [b"%d" % x for x in s]


def test_runs_match_a_search_of_every_period():
    rng = random.Random(1)
    for _ in range(1500):
        words = repetitive(rng)
        for exponent, least in ((4, 6), (2, 2), (3, 1), (5, 6)):
            assert sorted(runs.runs_of(words, exponent, least)) == plain_runs(words, exponent, least) == runs.runs_in(words, exponent, least)


def test_automaton_has_every_part_once():
    words = [b"a", b"b", b"a", b"b", b"a", b"c"] * 3
    link, size, ends = runs.suffix_automaton(words)
    assert sum(n - size[p] for n, p in zip(size, link, strict=True) if p >= 0) == len({tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)})
    assert [size[e] for e in ends] == list(range(1, len(words) + 1))


def run_documents():
    rng = random.Random(2)
    out = [(None, None), (None, "no id " * 9), (1, ""), (1, ""), (2, BLANKS), (3, "one"), (3, "one"), (4, "x " * 30_000), (5, "é漢 " * 5), (6, "a b " * 4), (7, "a b a b a b a")]
    for i in range(10, 400):
        words = prose(rng, rng.randrange(1, 200), 40).split()
        if i % 4 == 0:
            at, p = rng.randrange(len(words)), rng.randrange(1, 12)
            words[at:at] = prose(rng, p).split() * rng.randrange(2, 9)
        out.append((i, rng.choice(BLANKS).join(words)))
    return out


def plain_op12(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs.runs_in(words) if n > 300 else plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def key(r):
    return tuple((v is not None, v) for v in r)


def test_op12(spark, tmp_path):
    rows = run_documents()
    clash = {c: F.lit("clash") for c in ("runs", "best", "n_words", "collapsed", "start", "h")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_runs"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", **dict.fromkeys(["n_runs", "start", "length", "period", "exponent_milli"], "bigint"), "runs_sha256": "string", "collapsed_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_op12(*r) for r in rows), key=key)


def test_find_runs_of_any_exponent(spark):
    rows = [(i, " ".join(w.decode() for w in repetitive(random.Random(i)))) for i in range(80)]
    for exponent, least in ((2, 2), (3, 6)):
        got = runs.find_runs(spark.createDataFrame(rows, "id long, body string"), key="id", text="body", exponent=exponent, least=least).collect()
        assert {r["id"]: [tuple(x) for x in r["runs"]] for r in got} == {i: plain_runs(t.split(), exponent, least) for i, t in rows}
    with pytest.raises(ValueError):
        runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string"), exponent=1)


# ---- token files


def odd_texts():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz" * 2 + "éèßüñó0123456789'!?.,-ΣİАбв中文😀 \t\n\x85　\x1c\x1f"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([*range(1, 0x250), *range(0x300, 0x330), *range(0x2000, 0x2030), 0x1F600, 0xAC00, 0x1100, 0x1161])) for _ in range(60)) for _ in range(300)]
    return [*out, "", " ", "a<|endoftext|>B c<|startoftext|>, <|endoftext|", "!" * 200, "a.. x!? ...", "क़ख x.", "It's we'll I'd THEY'RE", "x " * 5000, "a" * 3000]


def test_chunks_encode_as_the_whole_text_does():
    library = Tokenizer.from_file(bpe.vocabulary_path())
    encoder = tokenfiles.ChunkEncoder(open(bpe.vocabulary_path(), "rb").read())
    assert encoder.letters_apart and encoder.type.itemsize == 2
    for text in odd_texts():
        assert np.frombuffer(encoder.encode([text])[0], dtype=encoder.type).tolist() == library.encode(text, add_special_tokens=False).ids, text


def token_documents():
    out = [(None, None), (None, "no id"), (1, ""), (1, "b"), (1, ""), (2, BLANKS), (4, "x " * 30_000)]
    return out + [(10 + 3 * i, t) for i, t in enumerate(odd_texts()[:300])]


def test_op13(spark, tmp_path):
    rows = token_documents()
    clash = {c: F.lit("clash") for c in ("id", "n", "shard", "first", "name", "start")}
    spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_tokens"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    library = Tokenizer.from_file(bpe.vocabulary_path())
    encoded = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows]
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    found = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)]).tolist()[:-1]
    assert sorted(((r[0], r[2], r[3]) for r in found), key=key) == sorted(((k, len(ids), crc(ids)) for k, ids in encoded), key=key)


def test_sequences_are_views_of_the_mapped_file(spark, tmp_path):
    rows = [(i, prose(random.Random(i), 50)) for i in range(60)]
    folder = tmp_path.as_uri()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    shards = tokenfiles.write_tokens(docs, bpe.vocabulary_path(), folder, length=64, batch=4).orderBy("shard").collect()
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 1]]
    assert sum(s["n_tokens"] for s in shards) == len(want) and sum(s["n_documents"] for s in shards) == 60
    flat = []
    for s in shards:
        assert s["first"] == len(flat)
        file = tokenfiles.TokenFile(folder, s["name"])
        assert len(file) == s["n_sequences"] == -(-s["n_tokens"] // 64)
        before = pa.total_allocated_bytes()
        views = [file.sequence(k) for k in range(len(file))]
        assert pa.total_allocated_bytes() == before and not any(v.flags.owndata or v.flags.writeable for v in views)
        masks = [file.mask(k).to_pylist() for k in range(len(file))]
        assert all(all(m) for m in masks[:-1]) and sum(map(sum, masks)) == s["n_tokens"]
        flat += np.concatenate(views)[: s["n_tokens"]].tolist()
        middle = s["n_tokens"] // 3
        assert np.concatenate(list(file.span(middle, 300))).tolist() == np.concatenate(views)[middle : middle + 300].tolist()
        raw = open(f"{tmp_path}/{s['name']}", "rb").read()
        assert raw[:6] == raw[-6:] == b"ARROW1" and file.file.schema.field("ids").type == pa.list_(pa.field("item", pa.uint16(), False), 64)
    assert flat == want


def test_a_lost_attempt_leaves_nothing_that_is_read(spark, tmp_path):
    """A file of an attempt that failed lies in the folder; the table of shards doesn't name it."""
    folder = tmp_path.as_uri()
    writer = tokenfiles.ShardWriter(folder, 0, np.dtype("<u2"), pa.int64(), 8, 2)
    writer.add(pa.array([99]), [b"\x01\x00" * 40])
    shards = tokenfiles.write_tokens(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), bpe.vocabulary_path(), folder)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in tokenfiles.read_documents(shards, folder).collect()) == [(1, 0, 3), (2, 3, 1)]


def test_no_documents_no_tokens(spark, tmp_path):
    shards = tokenfiles.write_tokens(spark.createDataFrame([], "doc_id long, text string"), bpe.vocabulary_path(), tmp_path.as_uri())
    assert shards.count() == 0 and tokenfiles.read_documents(shards, tmp_path.as_uri()).count() == 0
