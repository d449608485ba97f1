"""Token ids as Arrow files of equal-length sequences.

Documents are encoded in ascending order of their ids and their tokens, each document's followed by an end id, are packed one
after another into sequences of one length. A shard is an Arrow file (the stream format between two magic marks, with a footer that
tells where each batch lies) whose batches have two columns of fixed-size lists: `ids`, and `mask`, false where the shard's last
sequence is filled up. Nothing is compressed and there are no nulls, so a batch's ids are one plain array: sequence k is a view of
the mapped file, found by two divisions, and nothing is copied or decoded. Beside it lies an Arrow file with each document's id,
first position and number of tokens. Ids have two bytes where the vocabulary allows it, else four.

Spread over tasks: a range of the ids is a shard, written by one task straight into the shared folder, under a name of the attempt's
own. The table of shards, which Spark commits, has the names that count; what a lost attempt left is never read. Where a shard
begins in the whole comes from the shards' sums, a row each.

Defined results: a null or empty text has the end id alone; rows with one id are in the order of their texts' hashes, and rows repeated
in full follow each other, each with tokens of its own; a null id comes first; special tokens written out in a text count as such;
other columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import os
import sys
import types
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .common import documents, keep, shared_dir

#: Tokens of a sequence, sequences of a batch, and the id that ends a document.
LENGTH, BATCH, END = 2048, 512, 1
#: Chunks that a task remembers; it starts anew beyond them, results don't change.
MOST_CHUNKS = 1_000_000
#: Marks that may stand behind a word.
MARKS = ",.;:!?"


class ChunkEncoder:
    """Ids of texts by the tokenizers library. White space always parts tokens of a word vocabulary, so each distinct chunk between
    white space goes through the library once; where letters and marks are parted too, letters do so without the marks behind
    them, many at a time, and are told apart by the tokens that end words."""

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec.decode())
        self.library.no_truncation()
        self.library.no_padding()
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # each word comes once; remembering it costs more
        size, suffix = self.library.get_vocab_size(), json.loads(spec)["model"].get("end_of_word_suffix")
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.letters_apart = bool(suffix) and r"|[\\p{L}]+|" in spec.decode() and r"[^\\s\\p{L}\\p{N}]+" in spec.decode()
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.spaces, self.controls = regex.compile(r"\p{White_Space}+"), regex.compile("[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        # str.split also cuts at these four, which are no white space to the library
        return [c for c in self.spaces.split(text) if c] if self.controls.search(text) else text.split()

    def apart(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.type).tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def words(self, words: list[str], at_once: int = 64) -> list[bytes]:
        """Ids of words of letters, `at_once` of them in one text."""
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        out = []
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.type)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * self.type.itemsize
            if len(cuts) == len(group):
                whole = ids.tobytes()
                out += [whole[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
            else:  # some word was parted after all
                out += self.apart(group)
        return out

    def learn(self, new: set[str]) -> None:
        chunks, words, marks = [], [], []
        for c in new if self.letters_apart else ():
            w = c.rstrip(MARKS)
            if not w.isalpha():
                continue
            if w.isascii():
                words.append(w.lower())
            elif unicodedata.is_normalized("NFC", w) and w.lower().isalpha():
                words.append(w)
            else:
                continue
            chunks.append(c)
            marks.append(c[len(w) :])
        known = self.known
        others = list(new.difference(chunks).union(set(marks).difference(known, [""])))
        known.update(zip(others, self.apart(others), strict=True))
        each = list(set(words))
        found = dict(zip(each, self.words(each), strict=True))
        for c, w, m in zip(chunks, words, marks, strict=True):
            known[c] = found[w] + known[m] if m else found[w]

    def encode(self, batch: list[str]) -> list[bytes]:
        rows = [self.chunks(t) for t in batch]
        if len(self.known) > MOST_CHUNKS:
            self.known = {}
        self.learn(set().union(*rows).difference(self.known))
        known = self.known.__getitem__
        return [b"".join(map(known, r)) for r in rows]


def worker_encoder(spec: bytes) -> ChunkEncoder:
    """The encoder of this worker process: later tasks find the chunks that earlier ones met. Code is sent by value, so module
    variables don't outlive a task."""
    own = sys.modules.setdefault("tabulon_worker", types.ModuleType("tabulon_worker"))
    if getattr(own, "spec", None) != spec:
        own.spec, own.encoder = spec, ChunkEncoder(spec)
    return own.encoder


def word_split(spec: bytes) -> bool:
    """Whether the tokenizer drops white space, so that chunks can be encoded apart."""
    pre = json.loads(spec).get("pre_tokenizer") or {}
    return any(p.get("type") == "Split" and p.get("behavior") == "Removed" for p in pre.get("pretokenizers", [pre]))


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path that Spark would take, as Arrow opens it."""
    if not urlparse(uri).scheme:
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Packs documents into the sequences of one shard."""

    def __init__(self, folder: str, shard: int, kind: np.dtype, key_type: pa.DataType, length: int, batch: int):
        self.length, self.batch, self.kind = length, batch, kind
        fs, at = place(folder)
        fs.create_dir(at, recursive=True)
        self.names = [f"shard-{shard:06d}-{uuid.uuid4().hex}.{end}" for end in ("arrow", "documents.arrow")]
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.files = [fs.open_output_stream(f"{at}/{n}") for n in self.names]
        self.ids = pa.ipc.new_file(self.files[0], self.schema)
        self.documents_schema = pa.schema([("id", key_type), ("start", pa.int64()), ("n", pa.int64())])
        self.index = pa.ipc.new_file(self.files[1], self.documents_schema)
        self.held, self.size, self.total, self.documents, self.sequences = [], 0, 0, 0, 0

    def add(self, keys: pa.Array, encoded: list[bytes]) -> None:
        counts = np.array([len(e) // self.kind.itemsize for e in encoded], dtype=np.int64)
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(counts)], schema=self.documents_schema))
        self.total += int(counts.sum())
        self.documents += len(encoded)
        for e in encoded:
            self.held.append(e)
            self.size += len(e)
            if self.size >= self.length * self.batch * self.kind.itemsize:
                self.flush()

    def flush(self, last: bool = False) -> None:
        """Write the full batches; at the end also what is left, filled up with zeros."""
        flat = np.frombuffer(b"".join(self.held), dtype=self.kind)
        step = self.length * self.batch
        whole = len(flat) // step * step
        for at in range(0, whole, step):
            self.write(flat[at : at + step], step)
        rest = flat[whole:]
        if last and len(rest):
            n = -(-len(rest) // self.length) * self.length
            self.write(np.concatenate([rest, np.zeros(n - len(rest), dtype=self.kind)]), len(rest))
            rest = rest[:0]
        self.held, self.size = [rest.tobytes()], len(rest) * self.kind.itemsize

    def write(self, flat: np.ndarray, used: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((flat, np.arange(len(flat)) < used), self.schema, strict=True)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += len(flat) // self.length

    def close(self) -> None:
        self.flush(last=True)
        for x in (self.ids, self.index, *self.files):
            x.close()


class TokenFile:
    """Random access to a shard: sequences and masks as views of the mapped file (of what is read at once where it can't be mapped)."""

    def __init__(self, folder: str, name: str):
        fs, at = place(folder)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(f"{at}/{name}") if local else fs.open_input_file(f"{at}/{name}")
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = len(self.file.get_batch(0)) if self.file.num_record_batches else 1

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.batch + len(self.file.get_batch(n - 1)) if n else 0

    def flat(self, batch: int) -> np.ndarray:
        """All ids of a batch, one after another: a view."""
        ids = self.file.get_batch(batch).column("ids")
        return ids.values.to_numpy(zero_copy_only=True)[ids.offset * self.length : (ids.offset + len(ids)) * self.length]

    def sequence(self, k: int) -> np.ndarray:
        b, i = divmod(k, self.batch)
        return self.flat(b)[i * self.length : (i + 1) * self.length]

    def mask(self, k: int) -> pa.Array:
        b, i = divmod(k, self.batch)
        return self.file.get_batch(b).column("mask").values.slice(i * self.length, self.length)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from a position on, as views of the batches that they lie in."""
        step = self.length * self.batch
        while n > 0:
            b, i = divmod(start, step)
            part = self.flat(b)[i : i + n]
            yield part
            start, n = start + len(part), n - len(part)


SHARD = "shard int, name string, documents_name string, n_documents long, n_tokens long, n_sequences long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, batch: int = BATCH, end: int = END) -> DataFrame:
    """Writes the files below folder and returns the table of shards, with first: tokens before the shard. The order of rows repeated
    in full comes from their place in the input, which must be a table that was read or written."""
    spark, spec = docs.sparkSession, Path(tokenizer).read_bytes()  # goes along with the code: executors need not have the driver's files
    if not word_split(spec):
        raise ValueError("the tokenizer keeps white space")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, shard = worker_encoder(spec), None, TaskContext.get().partitionId()
        last = np.array([end], dtype=encoder.type).tobytes()
        for b in batches:
            keys, rows = b.column(0), pc.fill_null(b.column(1), "")
            for at in range(0, len(rows), 256):
                found = [e + last for e in encoder.encode(rows.slice(at, 256).to_pylist())]
                if writer is None:
                    writer = ShardWriter(folder, shard, encoder.type, keys.type, length, batch)
                writer.add(keys.slice(at, 256), found)
        if writer is not None:
            writer.close()
            row = [shard, *writer.names, writer.documents, writer.total, writer.sequences]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3], strict=True)], names=["shard", "name", "documents_name", "n_documents", "n_tokens", "n_sequences"])

    order = [F.col("__key").asc_nulls_first(), F.col("__hash"), F.col("__seq")]
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), F.xxhash64(F.col(f"`{text}`")).alias("__hash"), F.monotonically_increasing_id().alias("__seq"))
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("__key", "__text")
    shards = keep(ranges.mapInArrow(run, SHARD), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return shards.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(shards: DataFrame, folder: str, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files: start counts the tokens of all documents before it."""
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (r for b in batches for r in b.to_pylist()):
            ids, index = TokenFile(folder, shard["name"]), TokenIndex(folder, shard["documents_name"])
            for b in index.batches():
                crcs = []
                for start, n in zip(b.column("start").to_pylist(), b.column("n").to_pylist(), strict=True):
                    crc = 0
                    for part in ids.span(start, n):
                        crc = zlib.crc32(part.astype("<u4").data, crc)
                    crcs.append(crc)
                yield pa.RecordBatch.from_arrays([b.column("id"), pc.add(b.column("start"), shard["first"]), b.column("n"), pa.array(crcs, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return shards.repartitionByRange(parts, "shard").mapInArrow(run, f"`{key}` {key_type}, start long, n_tokens long, ids_crc32 long")


class TokenIndex:
    """The documents of a shard."""

    def __init__(self, folder: str, name: str):
        fs, at = place(folder)
        self.file = pa.ipc.open_file(fs.open_input_file(f"{at}/{name}"))

    def batches(self) -> Iterator[pa.RecordBatch]:
        return (self.file.get_batch(i) for i in range(self.file.num_record_batches))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark).rstrip('/')}/tabulon/tokens-{uuid.uuid4().hex}"
    return read_documents(write_tokens(docs, vocabulary_path(), folder), folder, docs.schema["doc_id"].dataType.simpleString())
