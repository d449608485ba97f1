"""Near duplicates by SimHash fingerprints, searched through a Gray-order hierarchical index.

A fingerprint has 64 bits over a text's word shingles. Equal fingerprints are one from the start. Of two that differ
in at most 2 bits, at least two of four 16-bit blocks agree, so each fingerprint goes to six shards by pairs of blocks.
A shard's fingerprints are sorted by Gray rank; runs of neighbours become nodes that hold the bits all of them share
(a mask and a pattern), and nodes become nodes again. A search starts from the top, adds up the differences on the
shared bits, and drops a whole node once they exceed the limit. Links become components by union-find.

Defined results: null and blank texts have fingerprint 0 and link like any other; fewer words than a shingle make one
shingle of them all; repeated rows share a component; a null id takes part, but is never the smallest of others; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep, texts
from .components import components

SHINGLE, LIMIT, SEED = 3, 2, 42
BLOCK, FAN = 16, 8
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


class GrayIndex:
    """Nodes over fingerprints in Gray order; level 0 has the fingerprints themselves."""

    def __init__(self, values: np.ndarray):
        rank = values.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        self.order = np.argsort(rank, kind="stable")
        self.values = values[self.order]
        ones = zeros = self.values
        self.levels = [(np.full(len(values), ~np.uint64(0)), self.values)]
        while len(ones) > 4 * FAN:
            cuts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(zeros, cuts)
            self.levels.append((~(ones ^ zeros), ones))

    def search(self, first: int, last: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (query, found) within the limit, for the queries in places first to last; found > query."""
        top = len(self.levels[-1][1])
        query, node = np.repeat(np.arange(first, last), top), np.tile(np.arange(top), last - first)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            near = np.bitwise_count((self.values[query] ^ pattern[node]) & mask[node]) <= limit
            query, node = query[near], node[near]
            if level:
                below = len(self.levels[level - 1][1])
                query, node = np.repeat(query, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                ok = (node < below) & ((node + 1) * FAN ** (level - 1) > query)  # found > query
                query, node = query[ok], node[ok]
        later = node > query
        return query[later], node[later]


def local_stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches through the pairs."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def links_in_shards(values: DataFrame, limit: int = LIMIT) -> DataFrame:
    """values: distinct fp. Links (a, b) whose components are those of all pairs within the limit; at most one a fingerprint and shard."""
    pairs = list(combinations(range(4), 2))
    block = lambda i: F.shiftrightunsigned("fp", 48 - BLOCK * i).bitwiseAND(0xFFFF)
    shards = F.array(*[F.struct(F.lit(k).alias("pair"), (block(i) * 65536 + block(j)).alias("shared")) for k, (i, j) in enumerate(pairs)])
    spread = values.select("fp", F.explode(shards).alias("s")).select("fp", "s.pair", "s.shared")
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        fp, pair = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        for k, (i, j) in enumerate(pairs):
            mine = fp[pair == k]
            if len(mine) < 2:
                continue
            # the shared blocks go to the top, so that the Gray order keeps those of one shard together
            turned = np.zeros(len(mine), dtype=np.uint64)
            for to, src in enumerate([i, j, *(x for x in range(4) if x not in (i, j))]):
                turned |= (mine >> np.uint64(48 - BLOCK * src) & np.uint64(0xFFFF)) << np.uint64(48 - BLOCK * to)
            index = GrayIndex(turned)
            root = local_stars(len(mine), (index.search(a, min(a + 512, len(mine)), limit) for a in range(0, len(mine), 512)))
            own = mine[index.order].view(np.int64)
            leaf = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(own[leaf]), pa.array(own[root[leaf]])], names=["a", "b"])

    return spread.select("fp", "pair", "shared").repartition(n, "pair", "shared").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(key, fp, component_id) for every row."""
    prints = keep(fingerprints(docs, key, text, size), "fingerprints")
    groups = keep(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-groups")
    found = components(links_in_shards(groups.select("fp"), limit))
    joined = groups.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = joined.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, whole, less all but the one with the smallest key of each group of near duplicates; a row without a
    key gives way to those with one, and rows repeated in full are one."""
    named = docs.withColumn("__row", F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key"), F.xxhash64(text).alias("text")))
    found = near_duplicates(named, key="__row", text=text)
    stays = found.where(F.col("__row") == F.col("component_id")).select("__row").distinct()
    return named.join(stays, "__row").dropDuplicates(["__row"]).drop("__row")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
