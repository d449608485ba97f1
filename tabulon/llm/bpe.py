"""BPE encoding and decoding of whole texts by walking one trie of words.

Each task keeps a trie over the symbols of the distinct words it has met. A node stands for a prefix and holds
only the last token of that prefix's encoding: the one token ending there that the encoding of the rest may be
followed by. So the encoding of a prefix is worked out once, whichever words share it, and a word's tokens are
read off its path by stepping back over token lengths. The step from prefix to prefix is exact because whether
BPE keeps a boundary depends only on the two tokens beside it: it does unless some piece at the left token's
right edge and some piece at the right token's left edge would have merged before either was used up.

Defined results: a null or blank text gives no tokens and an empty decoded text; special tokens written out in
a text count as such, as the tokenizer file says; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: A task's trie starts anew beyond so many nodes or words; results don't change.
MAX_NODES, MAX_WORDS = 3_000_000, 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, file: str | bytes):
        """file: a tokenizer file's path, or what stands in it."""
        spec = json.loads(file if isinstance(file, bytes) else Path(file).read_bytes())
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for at, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = at
            self.parts.setdefault(whole, (x, y, at))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile(f"({'|'.join(map(regex.escape, self.special))})")
        self.controls = regex.compile("[\x1c-\x1f]")  # str.split takes these for white space
        self.symbol = dict(enumerate(byte_symbols()))
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # (node, symbol) -> node
        self.last: list[int] = [-1]
        self.encoded = {t: struct.pack("<I", i) for t, i in self.special.items()}
        self.decoded = {t: t for t in self.special}

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The pieces that stand at a token's edge while it is put together, each with the rank of the merge that uses it up."""
        if (found := self.edges.get((token, right))) is None:
            found, t = [(token, float("inf"))], token
            while t in self.parts:
                a, b, at = self.parts[t]
                t = b if right else a
                found.append((t, at))
            self.edges[token, right] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves the boundary between tokens a and b alone. Of equal merges the left one comes first."""
        rank = self.rank
        right = self.edge(b, False)
        self.fits[a, b] = found = not any([(at := rank.get((x, y))) is not None and at < x_used and at <= y_used for x, x_used in self.edge(a, True) for y, y_used in right])
        return found

    def last_token(self, text: str, n: int, path: list[int], end: str) -> tuple[int, int]:
        """The last token of text[:n] + end, and its length; path[i] is the node of the first i symbols."""
        ids, fits, last = self.ids, self.fits, self.last
        for size in range(1, min(n, self.longest) + 1):  # exactly one fits; most are short
            t = ids.get(text[n - size : n] + end)
            if t is not None and (size == 1 or t in self.parts):
                if size == n:
                    return t, size
                before = last[path[n - size]]
                if (fit := fits.get((before, t))) is None:
                    fit = self.follows(before, t)
                if fit:
                    return t, size
        raise ValueError(f"no token ends {text[:n]!r}")

    def walk(self, symbols: str, path: list[int]) -> list[int]:
        """Token ids of one word. path: the nodes of the prefix that it shares with the word before it; gets the rest,
        with the prefixes that the trie doesn't have yet."""
        child, last, node = self.child, self.last, path[-1]
        for i in range(len(path), len(symbols)):
            edge = node << 10 | ord(symbols[i - 1])
            node = child.get(edge)
            if node is None:
                node = child[edge] = len(last)
                last.append(self.last_token(symbols, i, path, "")[0])
            path.append(node)
        t, size = self.last_token(symbols, len(symbols), path, self.end)
        out, at = [t], len(symbols) - size
        while at:
            t = last[path[at]]
            out.append(t)
            at -= len(self.names[t])
        return out[::-1]

    def pieces_of(self, chunk: str) -> list[str]:
        """The words in a run without white space, as the tokenizer's normaliser and splitter make them."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        return self.pieces.findall(chunk.lower())

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks: their words go depth first through the trie (in sorted order)."""
        split = {c: self.pieces_of(c) for c in chunks}
        names, pack = self.names, [struct.Struct(f"<{n}I").pack for n in range(64)]
        done: dict[str, tuple[bytes, str]] = {}
        path, before = [0], ""
        for symbols, word in sorted([(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.symbol), w) for w in {p for ps in split.values() for p in ps}]):
            shared = 0
            if before[:3] == symbols[:3]:
                for x, y in zip(before, symbols, strict=False):
                    if x != y:
                        break
                    shared += 1
            del path[min(shared, len(path) - 1) + 1 :]
            ids, before = self.walk(symbols, path), symbols
            done[word] = pack[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids), " ".join([names[i] for i in ids])
        for c, ps in split.items():
            if len(ps) == 1:
                self.encoded[c], self.decoded[c] = done[ps[0]]
            else:
                self.encoded[c], self.decoded[c] = b"".join([done[p][0] for p in ps]), " ".join([done[p][1] for p in ps])

    def chunks(self, text: str) -> list[str]:
        if "<|" in text and (found := self.specials.split(text))[1:]:
            return [c for i, t in enumerate(found) for c in ([t] if i % 2 else self.chunks(t))]
        return [c for c in self.spaces.split(text) if c] if self.controls.search(text) else text.split()

    def encode(self, batch: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text (the file names no decoder:
        tokens joined by spaces)."""
        rows = [self.chunks(t) for t in batch]
        new = set().union(*rows).difference(self.encoded)
        if len(self.last) > MAX_NODES or len(self.encoded) > MAX_WORDS:
            self.clear()
            new = set().union(*rows).difference(self.encoded)
        self.learn(new)
        return [(b"".join(map(self.encoded.__getitem__, r)), " ".join(map(self.decoded.__getitem__, r))) for r in rows]


#: Texts are encoded in groups of about so many characters: their new words go through the trie together.
GROUP = 1 << 20


def groups(rows: list[str], size: int = GROUP) -> Iterator[list[str]]:
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += len(r)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def encode_table(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", full: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and with full=True also ids and the decoded text."""
    file = Path(path).read_bytes()  # goes to the executors with the code: they need not have the driver's files
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file)
        for batch in batches:
            at = 0
            # a group's ids and texts go on before the next one is encoded
            for g in groups(pc.fill_null(batch.column(1), "").to_pylist()):
                rows = encoder.encode(g)
                columns = [batch.column(0).slice(at, len(g)), pa.array([len(i) // 4 for i, _ in rows], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows]), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows])]
                if full:
                    ends = np.cumsum([0, *(len(i) // 4 for i, _ in rows)]).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([i for i, _ in rows]), dtype="<i4"))), pa.array([d for _, d in rows], pa.string())]
                at += len(g)
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(key, text).mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(documents(spark, sf_dir), vocabulary_path())
