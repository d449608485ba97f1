"""Media columns whose payloads are stored once: content-defined chunks, joined by digest.

A text's bytes are padded and stored as the samples of an 8-bit mono WAV file. A rolling gear hash cuts the file where
its bits say so, wherever that content stands, so that files share chunks. Chunk digests are counted by Spark. A chunk
whose digest stands once stays in its document's list; of the others, documents keep the digest, and the chunk store,
a table of its own, keeps the bytes once (a task hands over each of its shared chunks once, and one of those stays).
Reading back joins digests with the store, puts the ordered chunk list together and verifies each chunk and the file by
their digests before the samples are looked at.

Defined results: null and blank texts are one block of zeros; equal texts have equal values; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_small, keep, mixed, texts

BLOCK = 64
#: Chunk sizes: none below the least but the last, none above the most, about the mean.
LEAST, MEAN_BITS, MOST = 512, 11, 8192
#: So many shared digests (16 bytes each) may be broadcast.
MOST_SHARED = 2_000_000
#: So many chunks of the store (8 kB each at most, a quarter of that on average) may be broadcast.
MOST_CHUNKS = 8_000
#: Beyond it, a chunk has a copy for so many places that ask for it.
MOST_ASKED = 1_000
GEAR = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def payload(text: bytes) -> bytes:
    return text + b"\0" * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def to_wav(samples: bytes, rate: int = 8000) -> bytes:
    """A WAV file with unsigned 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    size = struct.unpack("<I", media[40:44])[0]
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or len(media) != 44 + size:
        raise ValueError("not a WAV file of this kind")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash at a byte is a sum over the last 32 bytes, each shifted by its distance."""
    x = GEAR[np.frombuffer(data, dtype=np.uint8)].astype(np.uint32)
    reach = 1
    while reach < 32:  # doubling: sums over 1, 2, 4, ... 32 bytes
        x[reach:] = x[reach:] + (x[:-reach] << np.uint32(reach))
        reach *= 2
    marks = np.flatnonzero((x >> np.uint32(32 - MEAN_BITS)) == 0) + 1
    out, at, i = [], 0, 0
    while len(data) - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        end = int(marks[i]) if i < len(marks) else len(data)
        at = min(end, at + MOST, len(data))
        out.append(at)
    if at < len(data) or not out:
        out.append(len(data))
    return out


def chunked(text: bytes) -> list[tuple[bytes, bytes]]:
    """Digest and bytes of each chunk of a text's media file, in order."""
    media = to_wav(payload(text))
    ends = cuts(media)
    return [(hashlib.blake2b(c := media[a:b], digest_size=16).digest(), c) for a, b in zip([0, *ends], ends, strict=False)]


def shared_digests(docs: DataFrame, text: str) -> DataFrame:
    """Digests of the chunks that stand more than once in all media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (texts(batch.column(0).slice(at, 256)) for at in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([pa.array([d for t in part for d, _ in chunked(t)], pa.binary())], names=["digest"])

    return docs.select(text).mapInArrow(run, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


CHUNKS = "chunks array<struct<digest: binary, data: binary>>"


def store(docs: DataFrame, key: str, text: str, limit: int = MOST_SHARED) -> DataFrame:
    """The written media table: (key, chunks), and rows with a null key whose chunks are the shared ones. A document's
    shared chunks have no data there. Up to `limit` shared digests are broadcast (16 bytes each, counted first); beyond
    it, each text gets its own shared digests by joins."""
    spark = docs.sparkSession
    shared = keep(shared_digests(docs, text), "media-shared")
    small = shared.limit(limit + 1).count() <= limit
    everywhere = spark.sparkContext.broadcast({bytes(r[0]) for r in shared.toLocalIterator()} if small else set())
    if small:
        rows = docs.select(F.col(key), F.col(text).alias("__text"), F.lit(None).cast("array<binary>").alias("__shared"))
    else:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    found = [(h, d) for t, h in zip(texts(batch.column(0).slice(at, 256)), batch.column(1).slice(at, 256).to_pylist(), strict=True) for d in {d for d, _ in chunked(t)}]
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["__hash", "digest"])

        hashed = docs.select(F.col(key), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"))
        mine = hashed.select("__text", "__hash").mapInArrow(own, "__hash long, digest binary").join(shared, "digest").distinct()
        rows = hashed.join(mine.groupBy("__hash").agg(F.collect_list("digest").alias("__shared")), "__hash", "left").select(key, "__text", F.coalesce("__shared", F.array()).alias("__shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()  # shared chunks that this task has stored
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, lists, out = part.column(0), [], []
                for t, own_shared in zip(texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    known = everywhere.value if own_shared is None else set(own_shared)
                    row = []
                    for d, c in chunked(t):
                        if d not in known:
                            row.append({"digest": d, "data": c})
                            continue
                        row.append({"digest": d, "data": None})
                        if d not in given:
                            given.add(d)
                            out.append({"digest": d, "data": c})
                    lists.append(row)
                yield pa.RecordBatch.from_arrays([keys, pa.array([True] * len(lists)), pa.array(lists, kind)], names=[key, "is_row", "chunks"])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, keys.type), pa.array([False]), pa.array([out], kind)], names=[key, "is_row", "chunks"])

    made = rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, is_row boolean, {CHUNKS}")
    return keep(made.withColumn("row_id", F.monotonically_increasing_id()), "media")


def describe(media: bytes) -> tuple:
    """What is told of a media file that was read back."""
    data = from_wav(media)
    x = np.frombuffer(data, dtype=np.uint8)
    high = x >= 128
    feature = f"mean={x.mean():.6f};std={x.std():.6f};peak={int(x.max())};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};zeros={int(np.count_nonzero(x == 0))}"
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature


def verified(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """The media file of an ordered chunk list."""
    for digest, data in chunks:
        if data is None or hashlib.blake2b(data, digest_size=16).digest() != digest:
            raise ValueError("a stored chunk is missing or damaged")
    return b"".join(data for _, data in chunks)


TOLD = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
TOLD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def told(keys: list, key_type: pa.DataType, rows: list[tuple], key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(TOLD_TYPES))], names=[key, *TOLD])


def fetch(asked: DataFrame, shared: DataFrame, limit: int = MOST_CHUNKS, most: int = MOST_ASKED) -> DataFrame:
    """asked: (row_id, place, digest, ...), with the stored chunk of each. Up to `limit` chunks are broadcast; beyond it they are joined, where a
    chunk that more than `most` places ask for has a copy for each `most` of them, so that there are no more copies than chunks
    and places / `most`."""
    if shared.limit(limit + 1).count() <= limit:
        return asked.join(F.broadcast(shared), "digest", "left")
    often = keep(often_asked(asked, most), "media-often")
    copies = F.coalesce("__copies", F.lit(1).cast("long"))
    dealt = lambda df, salt: join_small(df, often, ["digest"], how="left", limit=MOST_SHARED, copies=1).withColumn("__salt", salt).drop("__copies")
    spread = dealt(shared, F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return dealt(asked, F.pmod(F.xxhash64("row_id", "place"), copies)).join(spread, ["digest", "__salt"], "left").drop("__salt")


def often_asked(asked: DataFrame, most: int) -> DataFrame:
    """(digest, __copies) of the chunks that more than `most` places ask for."""
    return asked.groupBy("digest").agg(F.ceil(F.count("*") / most).alias("__copies")).where("__copies > 1")


def read_back(table: DataFrame, key: str) -> DataFrame:
    """(key, *TOLD) of every row of a stored media table."""
    key_type = table.schema[key].dataType.simpleString()
    types = f"{key} {key_type}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    refers = F.exists("chunks", lambda c: c["data"].isNull())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [describe(verified([(c["digest"], c["data"]) for c in chunks])) for chunks in part.column(1).to_pylist()]
                yield told(part.column(0).to_pylist(), part.column(0).type, rows, key)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        now, chunks, done, key_kind = None, [], [], None
        for batch in batches:
            key_kind = batch.column(1).type
            for row_id, k, _, digest, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is not None and now[0] != row_id:
                    done.append((now[1], describe(verified(chunks))))
                    chunks = []
                now = row_id, k
                chunks.append((digest, unpack(data) if data is not None else None))
            if done:
                yield told([d[0] for d in done], key_kind, [d[1] for d in done], key)
                done = []
        if now is not None:
            yield told([now[1]], key_kind, [describe(verified(chunks))], key)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data = pa.array([None if d is None else pack(d) for d in batch.column(batch.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data], names=batch.schema.names)

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    direct = table.where(F.col("is_row") & ~refers).select(key, "chunks").mapInArrow(whole, types)
    pieces = table.where(F.col("is_row") & refers).select("row_id", key, F.posexplode("chunks").alias("place", "c")).select("row_id", key, "place", "c.digest", "c.data")
    stored = pieces.where("data IS NOT NULL").mapInArrow(packed, f"row_id long, {key} {key_type}, place int, digest binary, data binary")
    shared = table.where(~F.col("is_row")).select(F.explode("chunks").alias("c")).select("c.digest", "c.data").mapInArrow(packed, "digest binary, data binary")
    shared = keep(shared.dropDuplicates(["digest"]).withColumnRenamed("data", "stored"), "media-chunks")
    fetched = fetch(pieces.where("data IS NULL").drop("data"), shared).select("row_id", key, "place", "digest", F.col("stored").alias("data"))
    ordered = stored.union(fetched).repartition(n, "row_id").sortWithinPartitions("row_id", "place")
    return direct.union(ordered.mapInArrow(in_order, types))


def media_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = MOST_SHARED) -> DataFrame:
    """(key, *TOLD): what reading the stored media of each row gives."""
    return read_back(store(docs, key, text, limit), key)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # the unpadded size comes along with the key
    sized = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("row"), "text")
    return media_table(sized, key="row").select("row.doc_id", "row.n_bytes", *TOLD)
