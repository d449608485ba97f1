"""A quality score by regularised quadratic discriminant analysis of document statistics.

Statistics of the whole text (shares of kinds of characters, word lengths, repetition, the most unusual line)
are transformed towards normal shapes. Each class of the labels gets a mean and a covariance, shrunk towards
its diagonal and the pooled covariance; a document's score is the logistic function of the difference of
the two log densities, which are Mahalanobis distances by Cholesky factors that are worked out once.
The sums that the classes need are Spark aggregates over all labelled rows.

Defined results: null and blank texts have the statistics of an empty text and get a score like any other;
without labels of both classes every score is 0.5; repeated rows repeat; rows labelled twice count twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_groups, documents, join_small, keep, labels, powers, span_hashes, text_bytes, word_spans

#: Bytes of text that statistics are worked out for at a time: they take some 60 bytes for each.
GROUP = 1 << 20
THRESHOLD = 0.3
SHRINK, POOL, RIDGE = 0.05, 0.05, 1e-3

KINDS = {
    "letter": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)],
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "stop": b".,;:?'\"-",
    "bang": b"!",
    "symbol": b"#$%&*|<>{}[]\\^_`~=+@/()",
    "line": b"\n",
}
NAMES = ["words", "length", "distinct", "repeat", "share_upper", "share_digit", "share_stop", "share_bang", "share_symbol", "worst_symbol", "worst_upper", "worst_repeat", "line_length", "spread"]


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text."""
    rows = len(bounds) - 1
    sums = {}
    for name, members in KINDS.items():
        table = np.zeros(256, dtype=bool)
        table[list(members)] = True
        sums[name] = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
    per = lambda name, at: np.diff(sums[name][at]).astype(float)
    starts, ends, first = word_spans(data, bounds)
    hashes = span_hashes(data, starts, ends, powers(len(data)))
    words = np.diff(first).astype(float)
    doc = np.repeat(np.arange(rows), np.diff(first))
    again = np.zeros(len(starts) + 1, dtype=np.int64)
    again[1:-1] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]) if len(starts) else 0
    again_sums = np.concatenate([[0], np.cumsum(again[:-1])])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=rows).astype(float)
    size = ends - starts
    mean_size = np.bincount(doc, size, minlength=rows) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, size.astype(float) ** 2, minlength=rows) / np.maximum(words, 1) - mean_size**2, 0))
    # lines: cut at line ends and between texts
    cuts = np.unique(np.concatenate([bounds, np.flatnonzero(data == 0x0A) + 1])) if len(data) else np.zeros(1, dtype=np.int64)
    line_doc = np.searchsorted(bounds, cuts[:-1], "right") - 1
    n = np.maximum(np.diff(cuts), 1).astype(float)
    line_words = np.searchsorted(starts, cuts)
    in_line = np.maximum(np.diff(line_words), 1)

    def worst(share: np.ndarray) -> np.ndarray:
        out = np.zeros(rows)
        np.maximum.at(out, line_doc, share)
        return out

    log = lambda share: np.log(share + 1e-2)
    letters, length = per("letter", bounds) + 40, np.diff(bounds) + 40.0  # a few characters tell little
    long_line = n / (n + 60)
    return np.column_stack([
        np.log1p(words), mean_size.clip(0, 40) / 4, (np.log1p(distinct) / np.log1p(np.maximum(words, 1))) * 4, log(np.diff(again_sums[first]) / (words + 5)),
        log(per("upper", bounds) / letters), log(per("digit", bounds) / length), log(per("stop", bounds) / length), log(per("bang", bounds) / length), log(per("symbol", bounds) / length),
        log(worst(long_line * per("symbol", cuts) / n)), log(worst(long_line * per("upper", cuts) / n)), log(worst(np.diff(again_sums[line_words]) / (in_line + 5))),
        np.log1p(length / (1 + per("line", bounds))) / 2, np.log1p(spread) * 2,
    ])


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    kept = [key, *(c for c in carry if c not in (key, *NAMES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(len(kept)))
            rows = [statistics(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in byte_groups(bounds, GROUP)]
            x = np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(c) for c in x.T)], names=[*kept, *NAMES])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, types + "".join(f", {c} double" for c in NAMES))


@dataclass
class Model:
    """Means and inverse Cholesky factors by class, and what the log densities add."""

    centres: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [o - 0.5 * (((x - c) @ f.T) ** 2).sum(axis=1) for c, f, o in zip(self.centres, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))


def fit(rows: DataFrame, label: str) -> Model | None:
    """rows: NAMES and a 0/1 label. One aggregate; what comes to the driver has a fixed size."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in NAMES), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{i}_{j}") for i, j in pairs)).collect()
    if len(got) < 2 or min(r["n"] for r in got) < 2:
        return None
    counts, means, covs = [], [], []
    for r in sorted(got, key=lambda r: r[label]):
        mean = np.array([r[f"s_{c}"] for c in NAMES]) / r["n"]
        square = np.zeros((d, d))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"p_{i}_{j}"] / r["n"]
        counts.append(r["n"])
        means.append(mean)
        covs.append(square - np.outer(mean, mean))
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
    model = Model([], [], [])
    for n, mean, cov in zip(counts, means, covs, strict=True):
        cov = (1 - SHRINK - POOL) * cov + SHRINK * np.diag(np.diag(cov)) + POOL * pooled + RIDGE * np.eye(d)
        lower = np.linalg.cholesky(cov)
        model.centres.append(mean)
        model.factors.append(np.linalg.inv(lower))
        model.offsets.append(float(np.log(n / sum(counts)) - np.log(np.diag(lower)).sum()))
    return model


def fold(key: Column, n: int, held: int) -> Column:
    """Whether a row is held out: crc32 of the key as text, modulo n. A null key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)) == held


def training(stats: DataFrame, marks: DataFrame, key: str, label: str) -> DataFrame:
    """Statistics and label of the labelled rows that are not held out."""
    marked = marks.select(F.col(key), F.col(label).cast("int").alias("__label"))
    return join_small(stats.where(~fold(F.col(key), 5, 0)), marked, [key], limit=1_000_000, copies=1).select("__label", *NAMES)


def keep_good(docs: DataFrame, marks: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of docs, whole, that the classifier predicts to be good."""
    labelled = join_small(docs.select(key, text), marks.select(key).distinct(), [key], limit=1_000_000, copies=1)
    model = fit(training(with_statistics(labelled, key, text), marks, key, label), "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(batch.schema.get_field_index(text)))
            for a, b in byte_groups(bounds, GROUP):
                score = model.scores(statistics(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])) if model else np.full(b - a, 0.5)
                yield batch.slice(a, b - a).filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def score_table(docs: DataFrame, marks: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, held_out, score, predicted) for every row."""
    stats = keep(with_statistics(docs, key, text, carry), "quality-statistics")
    model = fit(training(stats.select(key, *NAMES), marks, key, label), "__label")
    extra = [c for c in stats.columns if c not in (key, *NAMES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES])
            score = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *extra)), pa.array(score)], names=[key, *extra, "score"])

    types = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in (key, *extra))
    scored = stats.mapInArrow(run, f"{types}, score double")
    return scored.select(key, *extra, fold(F.col(key), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_table(documents(spark, sf_dir), labels(spark, sf_dir))
