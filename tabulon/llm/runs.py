"""Periodic runs of words inside documents, found by a suffix automaton with link-cut access, and their collapse.

A run is a longest stretch of consecutive words with a smallest period q that is at least `exponent` periods long. The words of
a text are read one by one. Its suffix automaton's link tree is kept as paths by a link-cut tree: the nodes that were last seen
to end at the same place make one path, whose colour is that place. Reading word r accesses the node of the text so far: each
path segment met on the way to the root was last seen d = r - colour words ago, and its lowest node says how long the common
suffix is. Where that is d or more there is a square of period d, where it is (exponent - 1) d or more a run reaches r; it is
reported at the word where its period ends. As the colour is the *last* place, d is the smallest period.

Only stretches that can hold a run are read: each word of a run of four periods stands at least four times in the text and, if
the run has six words, inside some four words that stand three times. What is cut off lies in no run, so this loses nothing.

Defined results: a null, empty or blank text has no words and no runs, and its collapsed text is empty; repeated rows and rows with
one id give a row each; other columns are ignored; an empty table gives none. A null doc_id is not damaged in op12_runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts

EXPONENT, LEAST = 4, 6


def suffix_automaton(symbols: Sequence) -> tuple[list[int], list[int], list[int]]:
    """(link, size, ends): each state's suffix link and longest length, and the state of each prefix. The root is 0, its link -1."""
    steps: list[dict] = [{}]
    link, size, ends, last = [-1], [0], [], 0
    for c in symbols:
        new = len(size)
        size.append(size[last] + 1)
        link.append(0)
        steps.append({})
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                steps.append(dict(steps[q]))
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        ends.append(new)
    return link, size, ends


def runs_of(symbols: Sequence, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, in no order."""
    link, size, ends = suffix_automaton(symbols)
    nodes, n = len(size), len(ends)
    left, right, colour = [-1] * nodes, [-1] * nodes, [-1] * nodes
    up = link  # within a path's splay tree the parent, at its root the node above the path
    found = []
    for r, x in enumerate(ends):
        below = -1
        while x >= 0:
            # splay x to the root of its path; the colour stands at the root
            while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
                z = up[y]
                if z >= 0 and (left[z] == y or right[z] == y):
                    turns = (y, x) if (left[z] == y) == (left[y] == x) else (x, x)
                else:
                    turns = (x,)
                for a in turns:
                    b = up[a]
                    c = up[b]
                    if left[b] == a:
                        left[b] = m = right[a]
                        right[a] = b
                    else:
                        right[b] = m = left[a]
                        left[a] = b
                    if m >= 0:
                        up[m] = b
                    up[b], up[a] = a, c
                    if c >= 0 and left[c] == b:
                        left[c] = a
                    elif c >= 0 and right[c] == b:
                        right[c] = a
                    else:
                        colour[a] = colour[b]
            seen = colour[x]
            if seen >= 0:
                d, common = r - seen, size[x]
                if common >= (exponent - 1) * d and common + d >= least and (r + 1 == n or symbols[r + 1] != symbols[r + 1 - d]):
                    found.append((r - d - common + 1, common + d, d))
            if right[x] >= 0:
                colour[right[x]] = seen  # what is deeper stays a path of its own
            right[x] = below
            below, x = x, up[x]
        colour[below] = r
    return found


def stretches(ids: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int]]:
    """(first, end) of the stretches that can hold runs: see above. ids: words as small numbers."""
    if len(ids) < max(least, 2):
        return []
    fit = np.bincount(ids)[ids] >= exponent
    if exponent >= 4 and least >= 6 and fit.any():
        k = int(ids.max()) + 1
        pairs = ids[:-1] * k + ids[1:]
        if k >= 1 << 15:
            pairs = np.unique(pairs, return_inverse=True)[1]
            k = int(pairs.max()) + 1
        else:
            k *= k
        at = np.flatnonzero(fit[:-3] & fit[1:-2] & fit[2:-1] & fit[3:])
        _, which, times = np.unique(pairs[at] * k + pairs[at + 2], return_inverse=True, return_counts=True)
        at = at[times[which] >= 3]
        fit = np.zeros(len(ids), dtype=bool)
        for i in range(4):
            fit[at + i] = True
    edges = np.flatnonzero(np.diff(fit.astype(np.int8), prepend=0, append=0))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= max(least, 2)]


def runs_in(words: list[bytes], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(ids) - len(numbers) < exponent - 1:  # no word stands so often
        return []
    return sorted((a + s, n, q) for a, b in stretches(np.array(ids, dtype=np.int64), exponent, least) for s, n, q in runs_of(ids[a:b], exponent, least))


def find_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed) for each row: its runs by start, then period, and its words but those that any run holds after
    its first period, joined by one space. exponent: how many periods a run has at least, 2 or more; least: and words."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = [key, "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, left = [], [], []
            for t in texts(batch.column(1)):
                words = t.split()  # of bytes: at ASCII white space alone
                counts.append(len(words))
                runs.append(found := runs_in(words, exponent, least))
                if found:
                    gone = np.zeros(len(words), dtype=bool)
                    for start, length, period in found:
                        gone[start + period : start + length] = True
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                left.append(b" ".join(words).decode())
            rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), rows, pa.array(left, pa.string())], names=names)

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): a tenth of the documents, by a hash of the id, repeat some of their words from a place on: from word a on, word i
    is the original word a + (i - a) % p."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(f"`{text}`"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    one = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))  # words are split once
    return docs.select(F.col(f"`{key}`"), F.when(h % 10 == 0, F.get(one, F.lit(0))).otherwise(F.col(f"`{text}`")).alias(text))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(documents(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]  # noqa: E731  runs are in order, so the first of equals stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
