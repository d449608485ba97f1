"""Near duplicates among embeddings by cross-polytope hashing, with multiprobe buckets and exact verification.

A vector is rotated by sign flips and fast Hadamard transforms; its hash is the axis, with sign, that it lies nearest
to. Some hashes together name a bucket of a table, and a vector also visits the buckets that its second-best axes name.
Vectors that meet in a bucket are compared exactly. A pair that could meet in several places counts in the first of
them alone, so links are counted without listing them: a bucket gives each vector its number of links and one link to
its local component. Buckets beyond a size are split into blocks, and each pair of blocks is a group of its own.
Equal vectors are one from the start.

Defined results: vectors that are null, zero, or hold nulls or non-finite components, and vectors without a label, link
with nothing; a repeated id keeps a row each time; vectors of different lengths are never compared; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, keep
from .components import components
from .simhash import local_stars

COSINE = 0.98
#: Tables, and how many vectors a bucket should hold.
TABLES, FILL = 6, 48
#: So many hashes name a bucket at most.
MOST_HASHES = 4
#: Rows of a bucket that are compared at once.
BLOCK = 512
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, tables: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """For each vector and table its bucket and `hashes` further ones: int64 (rows, tables, 1 + hashes)."""
    rng = np.random.default_rng(seed)
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = np.zeros((len(x), tables, 1 + hashes), dtype=np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        best, second = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            a = size.argmax(axis=1)
            axis = lambda i, y=y: 2 * i + (y[rows, i] < 0)
            best.append(axis(a))
            size[rows, a] = -1
            second.append(axis(size.argmax(axis=1)))
        for probe in range(1 + hashes):
            code = np.zeros(len(x), dtype=np.int64)
            for k in range(hashes):
                code = code * (2 * width) + (second[k] if probe == k + 1 else best[k])
            out[:, t, probe] = code
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first, so that squares of very large or small numbers stay numbers
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def bucket_links(uid: np.ndarray, x: np.ndarray, code: np.ndarray, copies: np.ndarray, table: int, probe: np.ndarray, block: np.ndarray, blocks: tuple[int, int], limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uid, least uid of its local component, and links, of the rows of one bucket (or of one pair of its blocks)."""
    near = x @ x.T >= limit
    a, b = np.nonzero(np.triu(near, 1))
    keep_ = uid[a] != uid[b]
    if blocks[0] != blocks[1]:
        keep_ &= block[a] != block[b]
    a, b = a[keep_], b[keep_]
    if len(a):
        # the place where a pair counts: its first table with a shared bucket; there both at home, else the one with the smaller id at home, else the other
        swap = uid[a] > uid[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ca, cb = code[a], code[b]
        home = ca[:, :, 0] == cb[:, :, 0]
        a_home, b_home = (cb[:, :, 1:] == ca[:, :, :1]).any(axis=2), (ca[:, :, 1:] == cb[:, :, :1]).any(axis=2)
        first = (home | a_home | b_home).argmax(axis=1)
        rows = np.arange(len(a))
        way = np.where(home[rows, first], 0, np.where(a_home[rows, first], 1, 2))
        here = np.where((probe[a] == 0) & (probe[b] == 0), 0, np.where((probe[a] == 0) & (probe[b] > 0), 1, np.where((probe[a] > 0) & (probe[b] == 0), 2, 3)))
        ok = (first == table) & (way == here)
        a, b = a[ok], b[ok]
    root = local_stars(len(uid), iter([(a, b)])) if len(a) else np.arange(len(uid))
    links = np.bincount(a, copies[b], minlength=len(uid)) + np.bincount(b, copies[a], minlength=len(uid))
    got = np.flatnonzero(links)
    return uid[got], uid[root[got]], links[got].astype(np.int64)


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    # single precision stays as it is; all else is compared as it is in double precision
    number = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast(f"array<{number}>").alias("v"))
    sound = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("sound", F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & sound, F.lit(False)))
    same = keep(rows.where("sound").groupBy("label", "v").agg(F.min("key").alias("least"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    # so many hashes name a bucket of a label that it holds about FILL of the label's vectors
    width = same.agg(F.max(F.size("v")).alias("width")).first()["width"] or 2
    axes = 2 << max(1, (width - 1).bit_length())
    hashes = F.least(F.lit(MOST_HASHES), F.greatest(F.lit(1), F.ceil(F.log(F.col("n") / FILL) / log(axes)))).cast("int").alias("hashes")
    by_label = same.groupBy("label").agg(F.count("*").alias("n")).select("label", hashes)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vs, of = part.column(3).to_pylist(), part.column(4).to_numpy()
                for h in np.unique(of):
                    rows_ = np.flatnonzero(of == h)
                    code = np.zeros((len(rows_), tables, 1 + h), dtype=np.int64)
                    for w in {len(vs[i]) for i in rows_}:
                        mine = np.flatnonzero([len(vs[i]) == w for i in rows_])
                        code[mine] = codes(unit(np.array([vs[rows_[i]] for i in mine])), tables, h) * 4096 + w
                    pick = pa.array(np.repeat(rows_, tables * (1 + h)))
                    flat = code.reshape(len(rows_), -1)
                    yield pa.RecordBatch.from_arrays([
                        *(part.column(i).take(pick) for i in range(4)), pa.array(list(np.repeat(flat, tables * (1 + h), axis=0)), pa.list_(pa.int64())),
                        pa.array(np.tile(np.repeat(np.arange(tables), 1 + h), len(rows_)).astype(np.int32)), pa.array(np.tile(np.arange(1 + h), tables * len(rows_)).astype(np.int32)), pa.array(flat.ravel()),
                    ], names=["label", "uid", "copies", "v", "codes", "tab", "probe", "bucket"])

    where = ["label", "tab", "bucket"]
    label_type = same.schema["label"].dataType.simpleString()
    placed = same.join(by_label, "label").select("label", "uid", "copies", "v", "hashes").mapInArrow(spread, f"label {label_type}, uid long, copies long, v array<{number}>, codes array<long>, tab int, probe int, bucket long")
    full = keep(placed.groupBy(*where).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*where, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "vector-buckets")
    placed = join_small(placed, full, where, how="left", copies=1).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("uid", "probe"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = placed.withColumn("other", F.explode(other)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    at = [*where, "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = cosine

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def done() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            uid, copies, x, code, probe, block = (np.array([h[i] for h in held]) for i in range(6))
            out = bucket_links(uid, unit(x), code.reshape(len(held), tables, -1), copies, now[1], probe, block, now[3:], limit)
            return pa.RecordBatch.from_arrays([pa.array(o) for o in out], names=["uid", "near", "links"]) if len(out[0]) else None

        for batch in batches:
            c = {name: batch.column(name) for name in batch.schema.names}
            x = c["v"].to_pylist()
            code = c["codes"].flatten().to_numpy().reshape(batch.num_rows, -1)
            uid, copies, probe, block = (c[k].to_numpy() for k in ("uid", "copies", "probe", "block"))
            for r, k in enumerate(zip(*(c[name].to_pylist() for name in at), strict=True)):
                if k != now:
                    if got := done():
                        yield got
                    held, now = [], k
                held.append((uid[r], copies[r], np.array(x[r]), code[r], probe[r], block[r]))
        if now and (got := done()):
            yield got

    found = keep(placed.repartition(parts, *at).sortWithinPartitions(*at).mapInArrow(compare, "uid long, near long, links long"), "vector-links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("uid").alias("a"), F.col("near").alias("b"))).withColumnRenamed("id", "uid")
    each = same.select("label", "v", "uid", "copies", "least").join(links, "uid", "left").join(comp, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    each = keep(each.select("label", "v", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-components")
    least = each.groupBy("component").agg(F.min("least").alias("component_id"))
    named = each.join(least, "component").select("label", "v", "n_links", "component_id")
    linked = rows.where("sound").join(named, ["label", "v"]).select("key", "n_links", "component_id")
    alone = rows.where("NOT sound").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
