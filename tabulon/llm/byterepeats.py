"""Remove repeated byte passages by a distributed merge sort of suffixes that knows common prefixes.

Segments that may repeat (see repeats) are cut from the texts that hold them. Each task sorts the suffixes that start
where a window starts, each as long as a window, and writes them as a run for each shard: in order, front-coded, each
by the length of the prefix that it shares with the one before and the place of the rest. Runs are exchanged by shard,
and a loser tree merges those of a shard. Its players carry the prefix length that they share with the last winner, and
bytes are compared only beyond it; a winner that shares a whole window with the last one is a repeat, and so is that one.

Segments that stand more than once repeat as a whole; they meet the others in the merge as one. The different segments of
one anchor are few (see repeats), and there are so many shards that each has a bounded share of the suffixes.

Defined results: a null or blank text is empty; a passage cut inside a character leaves its other bytes as they are, so what
is kept is binary; repeated rows are repeated texts; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts
from .repeats import bounded_segments, merged, one_each, repeated_segments, spans_by_document
from .wordrepeats import ranges

WINDOW, ANCHOR = 400, 32
#: A task writes its runs whenever it holds so many suffixes.
RUN_SUFFIXES = 400_000
#: A shard has about so many suffixes at most, and an anchor's different segments so many bytes.
SHARD_SUFFIXES, ANCHOR_BYTES = 1_000_000, 800_000


def byte_values(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data.astype(np.uint64), bounds


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the prefix that two strings of one length share."""
    if a == b:
        return len(a)
    return len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def sorted_run(parts: list[bytes], window: int) -> tuple[bytes, list[int], list[int]]:
    """All parts as one string, the places of their window starts in order of the windows, and shared prefixes."""
    text = b"".join(parts)
    starts, at = [], 0
    for p in parts:
        starts += range(at, at + len(p) - window + 1)
        at += len(p)
    whole = sorted([(text[s : s + window], s) for s in starts])
    prefixes = [0, *(shared_prefix(x[0], y[0]) for x, y in zip(whole, whole[1:], strict=False))]
    return text, [s for _, s in whole], prefixes


def merge(runs: list[tuple[bytes, list[int], list[int]]], window: int) -> list[np.ndarray]:
    """For each run, which places of its text start a window that stands elsewhere too. A loser tree over the runs."""
    found = [np.zeros(len(r[0]), dtype=bool) for r in runs]
    size = 1
    while size < len(runs):
        size *= 2
    texts_ = [r[0] for r in runs]
    places = [r[1] for r in runs]
    prefixes = [r[2] for r in runs]
    shared = [0 if r[1] else -1 for r in runs] + [-1] * (size - len(runs))  # with the last winner; -1: no more
    next_ = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; where both share as much with the last winner, bytes decide, from there on."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = places[a][next_[a]], places[b][next_[b]]
        s, t = texts_[a][p + x : p + window], texts_[b][q + x : q + window]
        if s <= t:
            shared[b] = x + shared_prefix(s, t)
            return a, b
        shared[a] = x + shared_prefix(s, t)
        return b, a

    row = list(range(size))
    node_row = row
    at = size
    while at > 1:
        winners = []
        for i in range(0, len(node_row), 2):
            w, lose = play(node_row[i], node_row[i + 1])
            loser[(at + i) // 2] = lose
            winners.append(w)
        node_row = winners
        at //= 2
    winner = node_row[0]
    before: tuple[int, int] | None = None
    while shared[winner] >= 0:
        n = next_[winner]
        place = places[winner][n]
        if shared[winner] >= window and before:
            found[winner][place] = True
            found[before[0]][before[1]] = True
        before = winner, place
        n += 1
        next_[winner] = n
        shared[winner] = prefixes[winner][n] if n < len(places[winner]) else -1
        node, own = (winner + size) >> 1, shared[winner]
        while node:
            other = loser[node]
            theirs = shared[other]
            if theirs > own:
                loser[node], winner, own = winner, other, theirs
            elif theirs == own and own >= 0:
                w, lose = play(winner, other)
                loser[node], winner, own = lose, w, shared[w]
            node >>= 1
    return found


def shard_count(suffixes: int, partitions: int) -> int:
    return max(2 * partitions, -(-suffixes // SHARD_SUFFIXES))


def front_coded_runs(docs: DataFrame, chosen: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, segments, text, places, prefixes): the sorted runs of each task for each shard. segments: anchors, digests
    and lengths, 64-bit integers."""
    per = chosen.groupBy("doc").agg(F.collect_list(F.struct("anchor", "digest", "at", "windows")).alias("wanted"))

    def written(held: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        for shard, rows in held.items():
            text, places, prefixes = sorted_run([r[2] for r in rows], window)
            names = np.array([[r[0], r[1], len(r[2])] for r in rows], dtype=np.int64)
            coded = [names.tobytes(), text, np.array(places, dtype=np.int32).tobytes(), np.array(prefixes, dtype=np.int16).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([c], pa.binary()) for c in coded)], names=["shard", "segments", "text", "places", "prefixes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = defaultdict(list), 0
        for batch in batches:
            for text, wanted in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    held[w["anchor"] % shards].append((w["anchor"], w["digest"], text[w["at"] : w["at"] + w["windows"] + window - 1]))
                    n += w["windows"]
                if n > RUN_SUFFIXES:
                    yield from written(held)
                    held, n = defaultdict(list), 0
        yield from written(held)

    return docs.join(per, "doc").select("text", "wanted").mapInArrow(run, "shard int, segments binary, text binary, places binary, prefixes binary")


def merged_shards(runs: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, first, last): repeated windows of the segments in the runs."""

    def result(rows: list[list]) -> pa.RecordBatch:
        out: list[np.ndarray] = []
        loaded = [(r[1], np.frombuffer(r[2], dtype=np.int32).tolist(), np.frombuffer(r[3], dtype=np.int16).tolist()) for r in rows]
        for flags, r in zip(merge(loaded, window), rows, strict=True):
            names = np.frombuffer(r[0], dtype=np.int64).reshape(-1, 3)
            begin = np.concatenate([[0], np.cumsum(names[:, 2])])[:-1]
            flags = np.insert(flags, begin, False)  # so that no run of flags goes on in the next segment
            begin = begin + np.arange(len(begin)) + 1
            first, last = ranges(flags)
            owner = np.searchsorted(begin, first, "right") - 1
            out.append(np.column_stack([names[owner, 0], names[owner, 1], first - begin[owner], last - begin[owner]]))
        table = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], names=["anchor", "digest", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for i, s in enumerate(batch.column(0).to_pylist()):
                if rows and s != shard:
                    yield result(rows)
                    rows = []
                shard = s
                rows.append([batch.column(c)[i].as_py() for c in range(1, 5)])
        if rows:
            yield result(rows)

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, "anchor long, digest long, first long, last long")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, most: int = ANCHOR_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): kept has the bytes that stay. most: the bytes of an anchor's different segments,
    beyond which they are cut finer."""
    named = docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(key, text).alias("doc"))
    unique = one_each(named)
    repeated = repeated_segments(unique, byte_values, window, anchor, wide=True)
    repeated, chosen = bounded_segments(unique, repeated, byte_values, window, anchor, most)
    whole = chosen.where("copies > 1").select("anchor", "digest", F.lit(0).cast("long").alias("first"), (F.col("windows") - 1).cast("long").alias("last"))
    suffixes = chosen.where("others").agg(F.sum("windows")).first()[0] or 0
    shards = shard_count(suffixes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = merged_shards(front_coded_runs(unique, chosen.where("others"), window, shards), window)
    spans = spans_by_document(repeated, whole.union(found), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for t, s in zip(texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    gone = merged(s)
                    stay, last = [], 0
                    for first, past in gone:
                        stay.append(t[last:first])
                        last = past
                    rows.append((len(t), sum(b - a for a, b in gone), len(gone), b"".join([*stay, t[last:]])))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], pa.binary() if i == 3 else pa.int64()) for i in range(4))], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    types = f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return named.join(spans, "doc", "left").select(key, "text", "spans").mapInArrow(run, types)


def op3_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
