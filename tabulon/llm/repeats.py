"""Where repeated passages may be: the part that word and byte repeats share.

Two equal windows (of so many tokens) have the same anchor: the short token string inside them whose hash is least, the
leftmost of equals. Windows that follow each other and share an anchor are a segment. Segments whose anchor stands only
once in the corpus hold no repeated window; the others are gathered by anchor, equal ones counted as one with their
number, and an index of each shard of anchors tells which of their windows repeat. Every comparison that decides is on
the tokens themselves; hashes of 64 bits only choose what is compared, and name documents and equal segments.

Where an anchor has many different segments, these are cut by how far a window starts before the anchor, and what all
windows of a piece share is its anchor: equal windows have the same place of the anchor, so they stay together. That is done
again, with half the width each time, until the different segments of each anchor are few; at the width of one window the
anchor is the window itself, and all its segments are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, join_small, keep, mixed, powers, text_bytes

#: Tokens of a long text are looked at in blocks of so many, which overlap by a window.
BLOCK_TOKENS = 1 << 21
#: Texts are looked at in groups of about so many bytes, whose arrays of 64-bit integers fit a processor's cache.
SEGMENT_BYTES = 1 << 18


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def segments(tokens: np.ndarray, bounds: np.ndarray, window: int, k: int, pows: tuple[np.ndarray, np.ndarray], wide: bool = False) -> tuple[np.ndarray, ...]:
    """tokens: a 64-bit value each, of concatenated texts (bounds). Returns for each segment its text, its first token
    (from the text's start), its number of windows, its anchor's hash and the hash of its tokens.

    wide: the half of the windows that reach far to the left of the anchor are a segment of their own, and what all of a
    segment's windows share beside the anchor counts as the anchor: fewer are alike by chance, for twice the segments."""
    n = len(tokens)
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < window:
        return none
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((tokens + np.uint64(1)) * pows[0][:n], out=sums[1:])
    grams = mixed((sums[k:] - sums[: n - k + 1]) * pows[1][: n - k + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = window_minima((grams & ~np.uint64(0xFFFFFF)) | place, window - k + 1) & np.uint64(0xFFFFFF)
    starts = np.arange(len(anchor))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
    fits = starts + window <= bounds[text + 1]
    starts, text, anchor = starts[fits], text[fits], anchor[fits].astype(np.int64)
    if not len(starts):
        return none
    half = window // 2
    far = (anchor - starts >= half) & wide
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1) | (far[1:] != far[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    end = begin + count + window - 1
    digest = mixed((sums[end] - sums[begin]) * pows[1][begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    name = grams[anchor[first]]
    if wide:
        side = far[first]
        a, b = np.where(side, anchor[first] - half, anchor[first]), np.where(side, anchor[first] + k, anchor[first] + window - half + 1)
        name = mixed((sums[b] - sums[a]) * pows[1][a] + side.astype(np.uint64) + np.uint64(1))
    return text[first], begin - bounds[text[first]], count, name, digest


def blocks_of(bounds: np.ndarray, window: int, size: int = BLOCK_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token ranges to look at together: (starts, ends, rows); rows of many tokens come in overlapping blocks, alone."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        if bounds[row + 1] - bounds[row] > size:
            for at in range(bounds[row], max(bounds[row] + 1, bounds[row + 1] - window + 1), size):
                yield np.array([at]), np.array([min(at + size + window - 1, bounds[row + 1])]), np.array([row])
            row += 1
        else:
            last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
            yield bounds[row:last], bounds[row + 1 : last + 1], np.arange(row, last)
            row = last


def one_each(rows: DataFrame) -> DataFrame:
    """(doc, copies, text): rows repeated in full as one, with their number. rows: doc (a 64-bit name of key and text), text."""
    again = keep(rows.groupBy("doc").agg(F.count("*").alias("copies")).where("copies > 1"), "rows-repeated")
    if again.isEmpty():
        return rows.select("doc", F.lit(1).cast("long").alias("copies"), "text")
    marked = join_small(rows.select("doc", "text"), again, ["doc"], how="left", limit=1_000_000, copies=1)
    few = marked.where("copies IS NOT NULL").groupBy("doc").agg(F.first("copies").alias("copies"), F.first("text").alias("text"))
    return marked.where("copies IS NULL").select("doc", F.lit(1).cast("long").alias("copies"), "text").union(few)


SEGMENT = "anchor long, digest long, doc long, copies long, at long, windows int"


def segment_batch(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, copies: np.ndarray, at: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    columns = [anchor.view(np.int64), digest.view(np.int64), doc, copies, at, windows.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "digest", "doc", "copies", "at", "windows"])


def segment_table(docs: DataFrame, tokenize: Callable, window: int, k: int, wide: bool = False) -> DataFrame:
    """(anchor, digest, doc, copies, at, windows) of all segments. docs: as one_each gives them. tokenize(data, bounds): token
    values and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pows = powers(1 << 16)
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            names, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in byte_groups(bounds, SEGMENT_BYTES):
                tokens, own = tokenize(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                for starts, ends, rows in blocks_of(own, window):
                    if len(pows[0]) <= ends[-1] - starts[0]:
                        pows = powers(int(ends[-1] - starts[0]) + (1 << 16))
                    text, at, count, anchor, digest = segments(tokens[starts[0] : ends[-1]], np.append(starts, ends[-1]) - starts[0], window, k, pows, wide)
                    at = at + (starts - own[rows])[text]
                    yield segment_batch(anchor, digest, names[a + rows[text]], copies[a + rows[text]], at, count)

    return docs.select("doc", "copies", "text").mapInArrow(run, SEGMENT)


def repeated_segments(docs: DataFrame, tokenize: Callable, window: int, k: int, wide: bool = False) -> DataFrame:
    """The segments whose anchor stands more than once, written."""
    found = segment_table(docs, tokenize, window, k, wide)
    # written first: a join of two plain exchanges is one whose large partitions Spark splits
    often = keep(found.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "anchors")
    return keep(found.join(often, "anchor"), "segments")


def finer_segments(docs: DataFrame, hot: DataFrame, tokenize: Callable, window: int, k: int, width: int) -> DataFrame:
    """Segments cut where the distance from a window's start to the anchor passes a multiple of width, with the tokens that all
    windows of a piece share as its anchor."""
    per = hot.groupBy("doc").agg(F.collect_set(F.struct("at", "windows")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(2))
            names, copies, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b in byte_groups(bounds, SEGMENT_BYTES):
                tokens, own = tokenize(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                lists = wanted.slice(a, b - a)
                row = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                start, count = own[row] + flat.field(0).to_numpy(), flat.field(1).to_numpy().astype(np.int64)
                for starts, ends, rows in blocks_of(own, window):
                    low, high = starts[0], ends[-1]
                    # of a long row's blocks, which overlap, that in which the segment was found
                    last = low + BLOCK_TOKENS if len(rows) == 1 and own[rows[0] + 1] - own[rows[0]] > BLOCK_TOKENS else high
                    mine = np.flatnonzero((start >= low) & (start < last))
                    if len(mine):
                        which, begin, n, name, digest = pieces(tokens[low:high], start[mine] - low, count[mine], window, k, width)
                        text = row[mine[which]]
                        yield segment_batch(name, digest, names[a + text], copies[a + text], begin + low - own[text], n)

    return docs.join(per, "doc").select("doc", "copies", "text", "wanted").mapInArrow(run, SEGMENT)


def pieces(tokens: np.ndarray, start: np.ndarray, count: np.ndarray, window: int, k: int, width: int) -> tuple[np.ndarray, ...]:
    """For each piece of the segments (first window, number of windows): its segment, first window, number of windows, anchor
    and the hash of its tokens."""
    pows = powers(len(tokens))
    sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum((tokens + np.uint64(1)) * pows[0][: len(tokens)], out=sums[1:])
    grams = mixed((sums[k:] - sums[: len(tokens) - k + 1]) * pows[1][: len(tokens) - k + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    least = window_minima((grams & ~np.uint64(0xFFFFFF)) | place, window - k + 1) & np.uint64(0xFFFFFF)
    anchor = least[start].astype(np.int64)
    far, near = anchor - start, anchor - start - count + 1
    times = far // width - near // width + 1
    which = np.repeat(np.arange(len(start)), times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    part = far[which] // width - step
    most, fewest = np.minimum(far[which], part * width + width - 1), np.maximum(near[which], part * width)
    begin, n = anchor[which] - most, most - fewest + 1
    a, b = anchor[which] - part * width, anchor[which] - np.minimum(part * width + width - 1, window - k) + window
    name = mixed((sums[b] - sums[a]) * pows[1][a] + (part + (width << 20)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    end = begin + n + window - 1
    digest = mixed((sums[end] - sums[begin]) * pows[1][begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return which, begin, n, name, digest


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those docs whose name is wanted, written, so that no level of finer segments moves or reads the texts of the others."""
    return keep(join_small(docs, keep(wanted, "docs-hot"), ["doc"], how="left_semi", limit=1_000_000, copies=1), "texts-hot")


def bounded_segments(docs: DataFrame, repeated: DataFrame, tokenize: Callable, window: int, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """repeated, with finer segments where an anchor's different ones have more than `most` tokens, and its distinct segments."""
    width = window - k + 1
    settled, chosen, texts = None, None, None
    while True:
        one = distinct_segments(repeated)
        hot = keep(one.groupBy("anchor").agg(F.sum(F.col("windows") + window - 1).alias("n")).where(F.col("n") > most).select("anchor"), "anchors-hot")
        done = width == 1 or hot.isEmpty()
        # hot anchors are few: each has `most` tokens at least
        rest, few = (repeated, one) if done else (t.join(F.broadcast(hot), "anchor", "left_anti") for t in (repeated, one))
        settled, chosen = (rest, few) if settled is None else (settled.union(rest), chosen.union(few))
        if done:
            return settled, chosen
        width = (width + 1) // 2
        few = keep(repeated.join(F.broadcast(hot), "anchor", "left_semi"), "segments-hot")
        if texts is None:
            texts = texts_of(docs, few.select("doc").distinct())
        found = finer_segments(texts, few, tokenize, window, k, width)
        found = keep(found, "segments-finer")
        often = keep(found.groupBy("anchor").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor"), "anchors")
        repeated = keep(found.join(often, "anchor"), "segments")


def distinct_segments(repeated: DataFrame) -> DataFrame:
    """(anchor, digest, copies, doc, at, windows, others): equal segments as one, of one of the documents that hold it; others:
    whether its anchor also has different segments."""
    one = repeated.groupBy("anchor", "digest").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc", "at", "windows")).alias("one"))
    one = keep(one.select("anchor", "digest", "copies", "one.*"), "segments-distinct")
    mixed_up = one.groupBy("anchor").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("anchor", F.lit(True).alias("others"))
    return one.join(mixed_up, "anchor", "left").withColumn("others", F.coalesce("others", F.lit(False)))


def spans_by_document(repeated: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(doc, spans): token ranges (first, past) covered by repeated windows. found: (anchor, digest, first, last), windows of a
    segment, counted from its start."""
    hits = repeated.join(found, ["anchor", "digest"]).select("doc", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") + window).alias("past"))
    return hits.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "past"))).alias("spans"))


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Sorted ranges, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        first, past = s["first"], s["past"]
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], past)
        else:
            out.append((first, past))
    return out
