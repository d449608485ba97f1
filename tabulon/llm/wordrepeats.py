"""Remove repeated word passages, found by a compressed FM-index for each shard.

Segments that may repeat (see repeats) go to shards by anchor. A shard's index has the Burrows-Wheeler transform of its
segments' words in a wavelet tree of packed bits. The segments are streamed against it by backward search: from the right,
a match is prolonged to the left while it occurs at least twice (equal segments count with their number), which gives each
place its matching statistic; where it reaches the window, that window is reported.

Defined results: a null or blank text has no words and keeps an empty text; words keep their case; repeated rows are
repeated texts; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, powers, span_hashes, texts, word_spans
from .repeats import bounded_segments, merged, one_each, repeated_segments, spans_by_document

WINDOW, ANCHOR = 35, 8
#: A shard's segments are indexed in groups of about so many words; those of one anchor
#: stay together, and are cut finer beyond so many.
INDEX_WORDS = 400_000


def word_values(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, bounds)
    return span_hashes(data, starts, ends, powers(len(data))), first


class Bits:
    """Packed bits with counts of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Counts of a symbol in a prefix of a text; a level for each bit, stored side by side."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.lowest = self.places(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def places(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i

    def count(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i."""
        return self.places(symbol, i) - self.lowest[symbol]


class FMIndex:
    """Of some segments (arrays of symbols from 1 up) with weights; occurrences count with their segment's weight."""

    def __init__(self, parts: list[np.ndarray], weights: np.ndarray):
        sizes = np.array([len(p) for p in parts])
        n = int(sizes.sum()) + len(parts)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        text = np.zeros(n, dtype=np.int64)
        ends = self.first + sizes
        inner = np.ones(n, dtype=bool)
        inner[ends] = False
        text[inner] = np.concatenate(parts)
        # a different end for each segment, below all words: the order of suffixes is settled within a segment
        rank = text + len(parts)
        rank[ends] = np.arange(len(parts))
        order = np.argsort(rank, kind="stable")
        reach = 1
        while True:
            sorted_rank = rank[order]
            if reach > 1 and (sorted_rank[1:] != sorted_rank[:-1]).all():
                break
            following = np.zeros(n, dtype=np.int64)
            following[: n - reach] = rank[reach:] + 1
            both = rank * (n + len(parts) + int(text.max(initial=0)) + 2) + following
            order = np.argsort(both, kind="stable")
            done = both[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(done[1:] != done[:-1])])
            reach *= 2
        self.text = text
        self.tree = WaveletTree(text[order - 1], max(1, int(text.max(initial=1)).bit_length()))
        totals = np.bincount(text)
        self.smaller = np.concatenate([[0], np.cumsum(totals)])
        owner = np.searchsorted(self.first, order, "right") - 1
        self.weight = np.concatenate([[0], np.cumsum(weights[owner])])
        self.n = n

    def repeated_windows(self, window: int) -> np.ndarray:
        """For each place of the text whether the window that starts there occurs at least twice: all segments are streamed
        side by side, each from its end."""
        found = np.zeros(self.n, dtype=bool)
        left = self.first
        ends = np.append(self.first[1:], self.n) - 1  # past the last word
        live = np.flatnonzero(ends - left >= window)
        past = ends[live].copy()  # where the present match ends
        at = past.copy()  # where it starts
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.n, dtype=np.int64)
        left = left[live]
        while len(at):
            symbol = self.text[at - 1]
            before = self.smaller[symbol]
            next_low, next_high = before + self.tree.count(symbol, low), before + self.tree.count(symbol, high)
            good = self.weight[next_high] - self.weight[next_low] >= 2
            at = np.where(good, at - 1, at)
            low, high = np.where(good, next_low, 0), np.where(good, next_high, self.n)
            found[at[good & (past - at >= window)]] = True
            # the match can't go on: the next window to the left that is still open starts anew
            stuck = ~good
            past = np.where(stuck, np.where(past - at >= window, at - 1 + window, past - 1), past)
            at = np.where(stuck, past, at)
            on = (at > left) & (past - left >= window)
            at, past, low, high, left = at[on], past[on], low[on], high[on], left[on]
        return found


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def search_shards(parts: DataFrame, window: int) -> DataFrame:
    """parts: (anchor, digest, copies, words). Returns (anchor, digest, first, last): repeated windows of the segments."""

    def index(rows: list[tuple]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        segs = [np.array([known.setdefault(w, len(known) + 1) for w in r[3].split(b" ")], dtype=np.int64) for r in rows]
        fm = FMIndex(segs, np.array([r[2] for r in rows], dtype=np.int64))
        first, last = ranges(fm.repeated_windows(window))
        owner = np.searchsorted(fm.first, first, "right") - 1
        own = fm.first[owner]
        anchors, digests = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(anchors[owner]), pa.array(digests[owner]), pa.array(first - own), pa.array(last - own)], names=["anchor", "digest", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words = [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts(batch.column(3)), strict=True):
                if words > INDEX_WORDS and row[0] != rows[-1][0]:
                    yield index(rows)
                    rows, words = [], 0
                rows.append(row)
                words += row[3].count(b" ") + 1
        if rows:
            yield index(rows)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, digest long, first long, last long")


def cut_parts(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, copies, words) of chosen segments, from the texts that hold them."""
    per = chosen.groupBy("doc").agg(F.collect_list(F.struct("anchor", "digest", "copies", "at", "windows")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out = []
                for text, wanted in zip(texts(batch.column(0).slice(at, 128)), batch.column(1).slice(at, 128).to_pylist(), strict=True):
                    words = text.split()
                    out += [(w["anchor"], w["digest"], w["copies"], b" ".join(words[w["at"] : w["at"] + w["windows"] + window - 1]).decode()) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["anchor", "digest", "copies", "words"])

    return docs.join(per, "doc").select("text", "wanted").mapInArrow(run, "anchor long, digest long, copies long, words string")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, most: int = INDEX_WORDS) -> DataFrame:
    """(key, n_words, n_removed, kept): kept has the words that stay, joined by single spaces. most: the words of an anchor's
    different segments, beyond which they are cut finer."""
    named = docs.select(F.col(key), F.col(text).alias("text"), F.xxhash64(key, text).alias("doc"))
    unique = one_each(named)
    repeated = repeated_segments(unique, word_values, window, anchor)
    repeated, chosen = bounded_segments(unique, repeated, word_values, window, anchor, most)
    found = search_shards(cut_parts(unique, chosen, window), window)
    spans = spans_by_document(repeated, found, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n, removed, kept = [], [], []
                for t, s in zip(texts(part.column(1)), part.column(2).to_pylist(), strict=True):
                    words = t.split()
                    gone, stay, last = 0, [], 0
                    for first, past in merged(s):
                        stay += words[last:first]
                        gone += past - first
                        last = past
                    stay += words[last:]
                    n.append(len(words))
                    removed.append(gone)
                    kept.append(b" ".join(stay).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[key, "n_words", "n_removed", "kept"])

    types = f"{key} {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return named.join(spans, "doc", "left").select(key, "text", "spans").mapInArrow(run, types)


def op2_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
